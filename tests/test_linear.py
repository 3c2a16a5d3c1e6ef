import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabscope.functions import linalg
from tabscope.operators import linear as L
from tabscope.operators.correlation import corr_long


def _frame(spark, n=2000, seed=0):
    rng = np.random.default_rng(seed)
    x1 = rng.normal(size=n)
    x2 = 0.5 * x1 + rng.normal(size=n)
    x3 = rng.uniform(size=n)
    y = 2.0 + 3.0 * x1 - 1.5 * x2 + 0.2 * x3 + rng.normal(scale=0.5, size=n)
    pdf = pd.DataFrame({"k": np.arange(n), "x1": x1, "x2": x2, "x3": x3, "y": y})
    return spark.createDataFrame(pdf), pdf


def test_holdout_ols_matches_lstsq(spark):
    df, pdf = _frame(spark)
    a = L.linear_analysis(df, ["x1", "x2", "x3"], "y", (F.col("k") % 5) == 0).collect()[0]
    tr, te = pdf[pdf.k % 5 != 0], pdf[pdf.k % 5 == 0]
    X = np.c_[np.ones(len(tr)), tr[["x1", "x2", "x3"]]]
    beta = np.linalg.lstsq(X, tr.y, rcond=None)[0]
    assert np.allclose(a["coef"], beta[1:], atol=1e-9) and abs(a["intercept"] - beta[0]) < 1e-9
    pred = beta[0] + te[["x1", "x2", "x3"]].to_numpy() @ beta[1:]
    r2 = 1 - ((te.y - pred) ** 2).sum() / ((te.y - te.y.mean()) ** 2).sum()
    assert abs(a["r2"] - r2) < 1e-9


def test_collinear_features_give_minimum_norm(spark):
    n = 500
    rng = np.random.default_rng(4)
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"k": np.arange(n), "x": x, "x2": 2 * x, "y": 4 * x + rng.normal(scale=0.1, size=n)})
    a = L.linear_analysis(spark.createDataFrame(pdf), ["x", "x2"], "y", F.lit(False)).collect()[0]
    b = np.asarray(a["coef"])
    # minimum-norm split of the slope along (1, 2)
    assert abs(b[1] / b[0] - 2.0) < 1e-6


def test_vif_matches_regression_definition(spark):
    df, pdf = _frame(spark)
    got = {r["feature"]: r["vif"] for r in L.vif(df, ["x1", "x2", "x3"], basis="std").collect()}
    for c in ["x1", "x2", "x3"]:
        others = [o for o in ["x1", "x2", "x3"] if o != c]
        X = np.c_[np.ones(len(pdf)), pdf[others]]
        res = pdf[c] - X @ np.linalg.lstsq(X, pdf[c], rcond=None)[0]
        r2 = 1 - (res ** 2).sum() / ((pdf[c] - pdf[c].mean()) ** 2).sum()
        assert abs(got[c] - 1 / (1 - r2)) < 1e-8
        assert got[c] >= 1.0


def test_permutation_closed_form_matches_shuffles():
    rng = np.random.default_rng(7)
    n = 3000
    X = rng.normal(size=(n, 2))
    y = X @ np.array([1.5, -0.7]) + rng.normal(size=n)
    b = np.array([1.4, -0.6])
    a = 0.05
    pred = a + X @ b
    sst = ((y - y.mean()) ** 2).sum()
    base = 1 - ((y - pred) ** 2).sum() / sst
    drops = []
    for _ in range(400):
        Xp = X.copy()
        Xp[:, 0] = rng.permutation(Xp[:, 0])
        drops.append(base - (1 - ((y - a - Xp @ b) ** 2).sum() / sst))
    m = np.c_[X, y]
    closed = linalg.perm_importance(b, a, m.mean(axis=0), np.cov(m.T, bias=True))
    assert abs(closed[0] - np.mean(drops)) < 0.01 * closed[0]


def test_pairwise_complete_correlation_and_constant(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "b": rng.normal(size=300), "c": np.ones(300)})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double")
    rows = {(r["feature_a"], r["feature_b"]): r for r in corr_long(df, ["a", "b", "c"]).collect()}
    exp = pdf[["a", "b"]].corr().loc["a", "b"]
    assert abs(rows[("a", "b")]["r"] - exp) < 1e-12
    assert rows[("a", "c")]["r"] is None and rows[("b", "c")]["r"] is None


def test_exact_cv_matches_refits(spark):
    df, pdf = _frame(spark, n=600, seed=11)
    fold = (F.col("k") % 3).cast("int")
    got = L.ols_cv(df, ["x1", "x2"], "y", fold, prepared=True).collect()[0]
    scores = []
    for f in range(3):
        tr, te = pdf[pdf.k % 3 != f], pdf[pdf.k % 3 == f]
        X = np.c_[np.ones(len(tr)), tr[["x1", "x2"]]]
        beta = np.linalg.lstsq(X, tr.y, rcond=None)[0]
        pred = beta[0] + te[["x1", "x2"]].to_numpy() @ beta[1:]
        scores.append(1 - ((te.y - pred) ** 2).sum() / ((te.y - te.y.mean()) ** 2).sum())
    assert abs(got["cv_r2_mean"] - np.mean(scores)) < 1e-9 and abs(got["cv_r2_std"] - np.std(scores)) < 1e-9


def test_blocked_moments_match_aggregate_kernel(spark):
    from tabscope.operators.moments import moments
    rng = np.random.default_rng(12)
    n = 900
    pdf = pd.DataFrame({"g": rng.integers(0, 3, n), **{f"c{i}": rng.normal(loc=1e4, size=n) for i in range(6)}})
    pdf.loc[::17, "c2"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                               "g long, " + ", ".join(f"c{i} double" for i in range(6)))
    cols = [f"c{i}" for i in range(6)]
    a = {r["g"]: r for r in moments(df, cols, ["g"], wide=False).collect()}
    b = {r["g"]: r for r in moments(df, cols, ["g"], wide=True).collect()}
    for g in a:
        assert a[g]["n"] == b[g]["n"]
        assert np.allclose(a[g]["mean"], b[g]["mean"], rtol=1e-12)
        assert np.allclose(a[g]["cov"], b[g]["cov"], rtol=1e-9, atol=1e-9)


def test_blocked_correlation_by_segment_matches_pandas(spark):
    rng = np.random.default_rng(21)
    n = 1200
    base = rng.normal(size=n)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, n), **{f"c{i}": base * (i % 3) + rng.normal(size=n) for i in range(6)}})
    pdf.loc[::11, "c1"] = np.nan
    pdf.loc[::13, "c4"] = np.nan
    pdf.loc[pdf.g == 3, "c5"] = 7.0  # constant within one segment -> undefined r there
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                               "g long, " + ", ".join(f"c{i} double" for i in range(6)))
    cols = [f"c{i}" for i in range(6)]
    got = {(r["g"], r["feature_a"], r["feature_b"]): r for r in corr_long(df, cols, by=["g"]).collect()}
    assert len(got) == 4 * 15
    for g, part in pdf.groupby("g"):
        exp = part[cols].corr()
        for i in range(6):
            for j in range(i + 1, 6):
                r = got[(g, cols[i], cols[j])]["r"]
                e = exp.iloc[i, j]
                if np.isnan(e):
                    assert r is None
                else:
                    assert abs(r - e) < 1e-9, (g, i, j, r, e)


def test_systems_of_many_segments_are_solved_at_once(spark):
    """Segments of every kind (constant, collinear, without test or training rows) as the helpers solve each alone."""
    rng = np.random.default_rng(8)
    parts = []
    for s in range(120):
        rows = rng.normal(size=(int(rng.integers(4, 40)), 4)) * 10 + 5
        if s % 5 == 0:
            rows[:, 0] = 3
        if s % 7 == 0:
            rows[:, 1] = 2 * rows[:, 0]
        if s % 9 == 0:
            rows[:, 3] = 2
        cut = len(rows) if s % 4 == 0 else 3
        parts.append([(len(z), z.mean(axis=0) if len(z) else np.zeros(4), np.cov(z.T, bias=True) if len(z) else np.zeros((4, 4))) for z in (rows[:cut], rows[cut:])])
    stack = lambda i, j: np.array([p[i][j] for p in parts])
    b, a, r2, mse, perm, b_all, sd, vif = linalg.holdout_many(*[stack(i, j) for i in range(2) for j in range(3)])
    for s, (tr, te) in enumerate(parts):
        want, at = linalg.ols(tr[1], tr[2])
        assert np.allclose(b[s], want) and np.isclose(a[s], at)
        if te[0]:
            assert np.allclose((r2[s], mse[s]), linalg.r2_sse(want, at, te[1], te[2]))
            assert np.allclose(perm[s], linalg.perm_importance(want, at, te[1], te[2]))
        _, mean, cov = linalg.merge([tr, te])
        assert np.allclose(b_all[s], linalg.ols(mean, cov)[0])
        alone = linalg.vif_from_gram(linalg.corr_from_cov(cov[:3, :3], mean=mean[:3])[0], True)
        big = lambda v: np.where(v > 1e9, np.inf, v)
        assert np.allclose(big(vif[s]), big(alone), equal_nan=True)


def test_holdout_of_segments_too_small_or_untested(spark):
    data = [("a", i, float(i % 7), float(3 * (i % 7) + 1), i % 5 == 0) for i in range(60)]
    data += [("few", i, float(i), float(i), i % 5 == 0) for i in range(8)] + [("untested", i, float(i), 2.0 * i, False) for i in range(30)]
    data += [(None, i, float(i), 5.0, True) for i in range(30)]
    df = spark.createDataFrame(data, "g string, k int, x double, y double, t boolean")
    got = {r["g"]: r for r in L.linear_analysis(df, ["x"], "y", F.col("t"), ["g"]).collect()}
    assert got["a"]["fitted"] and np.isclose(got["a"]["r2"], 1) and np.allclose(got["a"]["coef"], [3])
    assert not got["few"]["fitted"] and got["few"]["r2"] == 0 and got["few"]["coef"] is None and (got["few"]["n_train"], got["few"]["n_test"]) == (6, 2)
    assert got["untested"]["fitted"] and got["untested"]["r2"] is None and got["untested"]["perm_importance"] is None
    assert not got[None]["fitted"] and got[None]["n_test"] == 30
