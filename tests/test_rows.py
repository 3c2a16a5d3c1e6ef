"""Global row numbers, contiguous folds, shuffled importance and bounded distinct sets against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.operators import linear as L
from tabscope.operators import rows as R
from tabscope.operators.profile import SET_BITS, target_kind, target_type


def test_row_numbers_with_hot_and_null_segments(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(10 ** 9), 7) for _ in range(4000)]
    df = spark.createDataFrame(data, "g string, x long, row_nr int").repartition(7)
    got = {(r.g, r.x): r.row_nr for r in R.number_rows(df, ["x"], ["g"]).collect()}
    assert len(got) == len(data)
    for g in {r[0] for r in data}:
        assert [got[g, x] for x in sorted(r[1] for r in data if r[0] == g)] == list(range(sum(r[0] == g for r in data)))
    whole = R.number_rows(df, ["x"]).select("x", "row_nr").collect()
    assert [r.x for r in sorted(whole, key=lambda r: r.row_nr)] == sorted(r[1] for r in data)
    assert R.number_rows(df.where("false"), ["x"], ["g"]).collect() == []


def test_equal_rows_get_different_numbers(spark):
    df = spark.createDataFrame([(None,)] * 5 + [(1,)] * 20, "x int").repartition(6)
    out = R.number_rows(df, ["x"]).collect()
    assert sorted(r.row_nr for r in out) == list(range(25)) and {r.row_nr for r in out if r.x is None} == set(range(5))


@pytest.mark.parametrize("n,k", [(23, 5), (25, 5), (3, 5), (1, 2), (10, 3)])
def test_contiguous_folds_as_array_split(spark, n, k):
    got = R.contiguous_folds(spark.range(n).repartition(3), ["id"], k).orderBy("id").collect()
    want = [f for f, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
    assert [r.fold for r in got] == want


def shuffled_by_hand(rows, fit, repeats, seed=42):
    rows = sorted(rows, key=lambda r: str(r[0]))
    y = np.array([r[3] for r in rows])
    x = np.array([r[1:3] for r in rows])
    sst = ((y - y.mean()) ** 2).sum()
    out = [[], []]
    for rep in range(repeats):
        order = sorted(range(len(rows)), key=lambda i: hashlib.md5(f"{seed}:{rep}:{rows[i][0]}".encode()).hexdigest())
        for f in (0, 1):
            z = x.copy()
            z[:, f] = x[order, f]
            out[f].append((((y - fit(z)) ** 2).sum() - ((y - fit(x)) ** 2).sum()) / sst)
    return [(np.mean(v), np.std(v)) for v in out]


def test_shuffled_importance_of_a_model_that_is_not_linear(spark):
    rng = random.Random(8)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)]
    rows = [(*r, r[1] * r[1] + 0.2 * r[2] + rng.gauss(0, 0.1)) for r in rows]
    df = spark.createDataFrame([*rows, (999, 1.0, 1.0, None)], "id long, a double, b double, y double")
    got = R.shuffled_importance(lambda t: t.withColumn("prediction", F.col("a") * F.col("a") + 0.2 * F.col("b")), df, ["a", "b"], "y", ["id"], 4)
    want = shuffled_by_hand(rows, lambda z: z[:, 0] ** 2 + 0.2 * z[:, 1], 4)
    got = {r.feature: r for r in got.collect()}
    for name, (mean, dev), rank in zip("ab", want, (1, 2)):
        assert got[name].importance == pytest.approx(mean) and got[name].importance_std == pytest.approx(dev) and got[name].rank == rank


def test_shuffled_importance_of_a_forest_and_of_no_rows(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rng = random.Random(9)
    df = spark.createDataFrame([(i, a := rng.random(), rng.random(), 5 * a) for i in range(400)], "id long, a double, b double, y double")
    assembler = VectorAssembler(inputCols=["a", "b"], outputCol="__features")
    model = RandomForestRegressor(featuresCol="__features", labelCol="y", numTrees=10, seed=1).fit(assembler.transform(df))
    predict = lambda t: model.transform(assembler.transform(t))
    got = {r.feature: r.importance for r in R.shuffled_importance(predict, df, ["a", "b"], "y", ["id"]).collect()}
    assert got["a"] > 1 and abs(got["b"]) < 0.2 * got["a"]
    assert R.shuffled_importance(predict, df.where("false"), ["a", "b"], "y", ["id"]).collect() == []


def test_shuffles_agree_with_the_closed_form(spark):
    rng = random.Random(10)
    rows = [(i, rng.gauss(0, 2), rng.gauss(5, 1)) for i in range(800)]
    df = spark.createDataFrame([(*r, 2 * r[1] - 3 * r[2] + rng.gauss(0, 1)) for r in rows], "id long, a double, b double, y double")
    test = F.col("id") % 5 == 0
    closed = {r.feature: r.importance for r in L.importance(L.linear_analysis(df, ["a", "b"], "y", test)).where("kind = 'permutation'").collect()}
    x = np.array([r[1:] for r in rows if r[0] % 5])
    y = np.array([r.y for r in df.orderBy("id").collect() if r.id % 5])
    a, b1, b2 = np.linalg.lstsq(np.c_[np.ones(len(x)), x], y, rcond=None)[0]
    got = R.shuffled_importance(lambda t: t.withColumn("prediction", a + b1 * F.col("a") + b2 * F.col("b")), df.where(test), ["a", "b"], "y", ["id"], 40)
    for r in got.collect():
        assert r.importance == pytest.approx(closed[r.feature], rel=0.1)


def test_bounded_sets_give_the_types_of_exact_counts(spark):
    size = 1 << SET_BITS
    rows = [("few", i % 20) for i in range(200)] + [("more", i % 21) for i in range(200)] + [("void", None)] * 5
    rows += [(None, i % 21) for i in range(420)] + [("key", i) for i in range(3 * size)]
    rows += [("at", i % (size + 200)) for i in range(20 * (size + 200))] + [("above", i % (size + 200)) for i in range(20 * (size + 200) - 1)]
    df = spark.createDataFrame(rows, "g string, x long")
    for t in (df, df.withColumn("x", F.col("x").cast("double")), df.withColumn("x", F.col("x").cast("decimal(20,2)"))):
        want = {r.g: (r.n_rows, r.target_type) for r in target_kind(t, "x", ["g"]).collect()}
        assert {r.g: (r.n_rows, r.target_type) for r in target_type(t, "x", ["g"]).collect()} == want
    assert want["few"][1] == want["at"][1] == want[None][1] == "classification" and want["more"][1] == want["above"][1] == want["key"][1] == "regression"
    assert target_type(df.where("false"), "x").first().target_type == "unknown"
    assert target_type(df, "g").first().target_type == "classification"


def test_few_large_segments_are_not_brought_to_one_task_each(spark):
    """The rows meet their segment's first row and size by broadcast: no shuffle of the rows on the segment."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(3000).select((F.col("id") % 3).alias("g"), "id").repartition(4)
        out = R.contiguous_folds(df, ["id"], 5, ["g"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        got = {(r.g, r.fold): r.n for r in out.groupBy("g", "fold").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(g, f): 200 for g in range(3) for f in range(5)}
