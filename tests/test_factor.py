"""QR factors merged in a tree and the randomised range finder against numpy on the collected rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.operators import factor as Q


def _frame(spark, x, extra=None, parts=6):
    rows = [tuple(float(v) for v in r) + (extra[i] if extra else ()) for i, r in enumerate(x)]
    names = [f"x{i}" for i in range(x.shape[1])] + (["g"] if extra else [])
    kinds = ", ".join(f"{n} {'string' if n == 'g' else 'double'}" for n in names)
    return spark.createDataFrame(rows, kinds).repartition(parts)


def test_factor_holds_means_and_scatter(spark, monkeypatch):
    monkeypatch.setattr(Q, "FAN", 2)  # several levels of the tree
    x = np.random.default_rng(1).normal(size=(500, 5)) * [1, 10, 1e-3, 5, 2] + [0, 1e6, 3, -7, 1]
    row = Q.qr_factor(_frame(spark, x, parts=9), [f"x{i}" for i in range(5)]).first()
    mean, r = Q._opened(row["m"], 5)
    c = x - x.mean(axis=0)
    assert row["n"] == 500 and np.allclose(mean, x.mean(axis=0), rtol=1e-12)
    assert np.allclose(r.T @ r, c.T @ c, rtol=1e-7, atol=1e-7)


def test_segments_hot_null_and_flushed_early(spark, monkeypatch):
    monkeypatch.setattr(Q, "HELD_BYTES", 1)  # every batch is passed on at once
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 3))
    x[:, 2] = 2 * x[:, 0] - 3 * x[:, 1] + 4 + 0.1 * rng.normal(size=900)
    g = [("hot",) if i % 3 else (None,) if i % 2 else ("b",) for i in range(900)]
    out = {r["g"]: r for r in Q.qr_ols(_frame(spark, x, g), ["x0", "x1"], "x2", ["g"]).collect()}
    assert set(out) == {"hot", "b", None}
    for name, r in out.items():
        own = x[[i for i in range(900) if g[i][0] == name]]
        b, res, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(own)), own[:, :2]]), own[:, 2], rcond=None)
        assert r["n"] == len(own) and r["rank"] == 2
        assert np.allclose([r["intercept"], *r["coefficients"]], b, atol=1e-10)
        assert r["r2"] == pytest.approx(1 - res[0] / ((own[:, 2] - own[:, 2].mean()) ** 2).sum(), abs=1e-10)


def test_ill_conditioned_fit_that_moments_lose(spark):
    t = np.linspace(0, 1, 400)
    x = np.column_stack([1e6 + t, 1e6 + t + 1e-5 * np.sin(40 * t)])
    y = 3 * x[:, 0] - 2 * x[:, 1]
    r = Q.qr_ols(_frame(spark, np.column_stack([x, y])), ["x0", "x1"], "x2").first()
    assert np.allclose(r["coefficients"], [3, -2], atol=1e-2) and r["rank"] == 2


def test_missing_values_lengths_and_empty_tables(spark):
    rows = [([1.0, 2.0],), ([2.0, 1.0],), ([4.0, 4.0],), (None,), ([1.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    assert Q.qr_factor(df, "v").first()["n"] == 3
    assert Q.qr_factor(df.where("false"), "v").collect() == []
    assert Q.qr_pca(df.where("v is null"), "v").collect() == []
    assert Q.range_pca(df.where("false"), "v", 2).collect() == []
    one = Q.qr_pca(df.limit(1), "v").first()
    assert one["n"] == 1 and one["eigenvalues"] == [0.0, 0.0] and one["sd"] == [0.0, 0.0]
    flat = spark.createDataFrame([(1.0, 5.0)] * 10, "x0 double, x1 double")
    assert Q.qr_ols(flat, ["x0"], "x1").first()["r2"] is None


def test_components_match_the_correlation_matrix(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6))
    x[:, 5] = 9.0
    r = Q.qr_pca(_frame(spark, x), [f"x{i}" for i in range(6)]).first()
    corr = np.corrcoef(x[:, :5].T)
    w = np.sort(np.linalg.eigvalsh(corr))[::-1]
    assert np.allclose(r["eigenvalues"], [*w, 0.0], atol=1e-10)
    v = np.array(r["loadings"]).reshape(6, 6)
    assert np.allclose(corr @ v[0, :5], w[0] * v[0, :5], atol=1e-10)
    assert r["n_components"] == int(np.searchsorted(np.cumsum(w) / 5, 0.95, side="right")) + 1


def test_range_finder_on_two_thousand_columns(spark):
    rng = np.random.default_rng(4)
    n, k, rank = 600, 2000, 12
    strength = 2.0 ** -np.arange(rank) * 50
    x = (rng.normal(size=(n, rank)) * strength) @ np.linalg.qr(rng.normal(size=(k, rank)))[0].T + 3 + 1e-3 * rng.normal(size=(n, k))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(5)
    out = Q.range_pca(df, "v", 8).orderBy("component").collect()
    _, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose([r["singular_value"] for r in out], s[:8], rtol=1e-6)
    assert np.allclose([r["explained"] for r in out], s[:8] ** 2 / (s ** 2).sum(), rtol=1e-6)
    for r in out[:4]:
        assert abs(np.dot(r["loading"], v[r["component"]])) == pytest.approx(1, abs=1e-6)


def test_range_finder_refuses_what_the_driver_could_not_hold(spark, monkeypatch):
    monkeypatch.setattr(Q, "SKETCH_BYTES", 8)
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    with pytest.raises(ValueError):
        Q.range_pca(df, "v", 1)


def test_every_direction_is_exact(spark):
    x = np.random.default_rng(5).normal(size=(300, 7))
    got = [r["singular_value"] for r in Q.range_pca(_frame(spark, x), [f"x{i}" for i in range(7)], 7).orderBy(F.col("component")).collect()]
    assert np.allclose(got, np.linalg.svd(x - x.mean(axis=0))[1], rtol=1e-9)
