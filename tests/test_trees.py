"""Trees grown from sums by cell against MLlib's over the rows."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tabscope.operators import experiments as X
from tabscope.operators import models as M
from tabscope.operators import trees as T

FEATURES = ["a", "b", "c"]
FIXED = {"featuresCol": "__features", "labelCol": "y", "featureSubsetStrategy": "all", "seed": 3}


@pytest.fixture(scope="module")
def rows(spark):
    """Three features (many, few and two values), rows without test flag, and folds with a missing one."""
    rng, made = random.Random(4), []
    for i in range(2400):
        a, b, c = rng.gauss(0, 3), float(rng.randrange(7)), float(rng.random() < 0.3)
        made.append((i, a, b, c, 50 + a * a + 4 * b * c + rng.gauss(0, 1), None if i % 97 == 0 else i % 5 == 0, None if i % 89 == 0 else i // 5 % 3))
    return spark.createDataFrame(made, "id long, a double, b double, c double, y double, __test boolean, __fold int").repartition(3, "id").cache()


def by_mllib(est, rows, k=0):
    a = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(rows)
    train, test = a.where(~F.col("__test")), a.where("__test")
    out = [M._metrics(est.fit(train).transform(test), "y")]
    return out + [M._metrics(est.fit(train.where(F.col("__fold") != f)).transform(train.where(F.col("__fold") == f)), "y") for f in range(k)]


@pytest.mark.parametrize(("kind", "params"), [
    (RandomForestRegressor, {"numTrees": 2, "bootstrap": False, "maxDepth": 30}),
    (RandomForestRegressor, {"numTrees": 1, "bootstrap": False, "maxDepth": 6, "maxBins": 8, "minInstancesPerNode": 20, "minInfoGain": 0.05}),
    (RandomForestRegressor, {"numTrees": 1, "bootstrap": False, "maxDepth": 5, "minWeightFractionPerNode": 0.1}),
    (GBTRegressor, {"maxIter": 1, "maxDepth": 3}),
    (GBTRegressor, {"maxIter": 12, "maxDepth": 4, "stepSize": 0.3}),
])
def test_without_chance_the_scores_are_mllibs(rows, kind, params):
    est = kind(**FIXED, **params)
    assert sum(T.fit_scores(est, rows, FEATURES, "y"), ()) == pytest.approx(sum(by_mllib(est, rows), ()), rel=1e-9)


def test_every_fold_is_fitted_as_mllib_does(rows):
    est = RandomForestRegressor(**FIXED, numTrees=1, bootstrap=False, maxDepth=7)
    got, want = T.fit_scores(est, rows, FEATURES, "y", 3), by_mllib(est, rows, 3)
    assert len(got) == 4 and sum(got, ()) == pytest.approx(sum(want, ()), rel=1e-9)
    est = GBTRegressor(**FIXED, maxIter=3, maxDepth=4)
    assert sum(T.fit_scores(est, rows, FEATURES, "y", 3), ()) == pytest.approx(sum(by_mllib(est, rows, 3), ()), rel=1e-9)


@pytest.mark.parametrize(("kind", "params"), [
    (RandomForestRegressor, {"featureSubsetStrategy": "2", "numTrees": 40, "maxDepth": 6, "subsamplingRate": 0.5}),
    (GBTRegressor, {"featureSubsetStrategy": "0.6", "maxIter": 30, "maxDepth": 4, "subsamplingRate": 0.8, "stepSize": 0.2}),
])
def test_with_chance_the_scores_are_near_mllibs(rows, kind, params):
    est = kind(**FIXED | params)
    ((r2, rmse),), ((want, want_rmse),) = T.fit_scores(est, rows, FEATURES, "y"), by_mllib(est, rows)
    assert r2 == pytest.approx(want, abs=0.02) and rmse == pytest.approx(want_rmse, rel=0.15)
    assert T.fit_scores(est, rows, FEATURES, "y") == [(pytest.approx(r2, rel=1e-9), pytest.approx(rmse, rel=1e-9))]


def test_every_row_is_drawn_for_every_tree(spark):
    """Poisson weights of mean 1 and variance 1, Bernoulli weights of the rate; sums follow the weights."""
    at, y, every = np.arange(250) % 250, np.arange(250) + 1.0, np.ones(250, bool)
    for est, mean, var in ((RandomForestRegressor(**FIXED, numTrees=400), 1, 1), (RandomForestRegressor(**FIXED, numTrees=400, subsamplingRate=0.5), 0.5, 0.5),
                           (GBTRegressor(**FIXED, maxIter=400, subsamplingRate=0.9), 0.9, 0.09), (RandomForestRegressor(**FIXED, numTrees=400, bootstrap=False), 1, 0)):
        st, sums = T.Settings.of(est), T._Sums(400)
        sums.slots_of(at, 250)
        sums.add(at, y, every, st, np.random.default_rng(1))
        w = sums.w[:, :250]
        assert w.mean() == pytest.approx(mean, rel=0.02) and w.var() == pytest.approx(var, rel=0.05)
        assert np.allclose(sums.s[:, :250], w * y) and np.corrcoef(w[:, 0], w[:, 1])[0, 1] < 0.2 if var else True


def test_what_is_not_fitted_by_cell(rows, monkeypatch):
    est = RandomForestRegressor(**FIXED, numTrees=2, maxDepth=3)
    assert T.fit_scores(RandomForestRegressor(**FIXED, weightCol="b"), rows, FEATURES, "y") is None
    assert T.fit_scores(GBTRegressor(**FIXED, lossType="absolute"), rows, FEATURES, "y") is None
    assert T.fit_scores(est, rows.where("__test"), FEATURES, "y") is None
    assert T.fit_scores(est, rows.where("__fold = 1"), FEATURES, "y", 3) is None
    assert T.fit_scores(est, rows.where("not __test"), FEATURES, "y") == [(None, None)]
    monkeypatch.setattr(T, "MOST_BINS", 32 * 60)
    assert T.fit_scores(est, rows, FEATURES, "y") is None
    monkeypatch.setattr(M, "TASK_ROWS", 1000)
    df = rows.where("__test is not null").drop("__fold")
    out = M.compare_models(df, FEATURES, "y", F.col("__test"), rf_params={"numTrees": 5, "maxDepth": 5}, gbt_params={"maxIter": 3, "maxDepth": 3}).collect()
    assert len(out) == 3 and out[1]["r2"] > 0.8  # too many cells: fitted over the rows


def test_a_constant_target(rows):
    est = RandomForestRegressor(**FIXED, numTrees=3, maxDepth=3)
    assert T.fit_scores(est, rows.withColumn("y", F.lit(0.1)), FEATURES, "y") == [(1.0, 0.0)]
    ((r2, rmse),) = T.fit_scores(est, rows.withColumn("y", F.when(F.col("__test"), 0.1).otherwise(F.col("a"))), FEATURES, "y")
    assert r2 == 0.0 and rmse > 0


def over_the_rows(*_):
    raise AssertionError("fitted over the rows")


def test_larger_experiments_are_not_read_for_every_level(rows, monkeypatch):
    """Beyond a task's rows MLlib's tree fits, which read the rows once a level, aren't called."""
    monkeypatch.setattr(M, "TASK_ROWS", 1000)
    monkeypatch.setattr(RandomForestRegressor, "_fit", over_the_rows)
    found = X.run_experiments(rows.select("id", *FEATURES, "y"), FEATURES, "y", F.col("id") % 5 == 0, F.col("id"), scorer="forest",
                              rf_params={"numTrees": 20, "maxDepth": 8}).collect()
    assert [(r["method"], r["error"]) for r in found] == [(m, None) for m in X.METHODS]
    assert found[0]["r2"] > 0.9 and found[0]["cv_r2_mean"] > 0.8 and found[0]["cv_r2_std"] > 0


def test_larger_comparisons_are_not_read_for_every_level(rows, monkeypatch):
    monkeypatch.setattr(M, "TASK_ROWS", 1000)
    monkeypatch.setattr(RandomForestRegressor, "_fit", over_the_rows)
    monkeypatch.setattr(GBTRegressor, "_fit", over_the_rows)
    out = M.compare_models(rows.select("id", *FEATURES, "y"), FEATURES, "y", F.col("id") % 5 == 0, rf_params={"numTrees": 20, "maxDepth": 12}).collect()
    assert [r["name"] for r in out] == ["Linear Regression", "Random Forest", "Gradient Boosting"]
    assert min(out[1]["r2"], out[2]["r2"]) > 0.9 > out[0]["r2"]


def test_the_checks_hold_of_larger_tables(spark, tmp_path, monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(M, "TASK_ROWS", 1000)
    monkeypatch.setattr(RandomForestRegressor, "_fit", over_the_rows)
    monkeypatch.setattr(GBTRegressor, "_fit", over_the_rows)
    rng = random.Random(8)
    made = [(i // 4, i % 90, float(rng.randint(1, 50)) if i % 40 else None, rng.uniform(900, 90000)) for i in range(3000)]
    spark.createDataFrame(made, "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = __spark_entry__.queries()["model_comparison_checks"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(True, True, True, True, 3)]
