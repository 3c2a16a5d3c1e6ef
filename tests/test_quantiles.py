import numpy as np
import pandas as pd

from tabscope.operators.quantiles import quantiles_wide


def _np_q(v, p):
    v = np.sort(np.asarray(v, float))
    pos = p * (len(v) - 1)
    lo, hi = v[int(np.floor(pos))], v[min(int(np.floor(pos)) + 1, len(v) - 1)]
    if lo == hi or pos == np.floor(pos):  # numpy's lerp gives NaN next to an infinity even at weight 0
        return float(lo)
    return float(np.quantile(v, p, method="linear"))


def test_matches_numpy_with_ties_skew_and_infinities(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=400), np.full(300, 2.5), rng.integers(0, 5, 200).astype(float)])
    vals[::97] = np.inf
    vals[5] = -np.inf
    pdf = pd.DataFrame({"g": (np.arange(len(vals)) % 3).astype(int), "x": vals})
    pdf.loc[::50, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    names = [f"p{i}" for i in range(len(probs))]
    out = {r["g"]: r for r in quantiles_wide(df, ["x"], probs, names, by=["g"]).collect()}
    for g, part in pdf.groupby("g"):
        v = part["x"].dropna().to_numpy()
        for p, nm in zip(probs, names):
            exp = _np_q(v, p)
            got = out[g][nm]
            if np.isinf(exp):
                assert got == exp
            else:
                assert abs(got - exp) <= 1e-9 * max(1, abs(exp)), (g, p, got, exp)


def test_drop_inf_and_partitioning_invariance(spark):
    rng = np.random.default_rng(5)
    v = rng.lognormal(size=3000)
    v[::11] = np.inf
    pdf = pd.DataFrame({"x": v})
    df = spark.createDataFrame(pdf)
    a = quantiles_wide(df, ["x"], [0.25, 0.75], ["q1", "q3"], drop_inf=True).collect()[0]
    b = quantiles_wide(df.repartition(7), ["x"], [0.25, 0.75], ["q1", "q3"], drop_inf=True).collect()[0]
    fin = v[np.isfinite(v)]
    assert abs(a["q1"] - _np_q(fin, 0.25)) < 1e-12 and abs(a["q3"] - _np_q(fin, 0.75)) < 1e-12
    assert a["q1"] == b["q1"] and a["q3"] == b["q3"]


def test_hot_value_resolves_without_spread(spark):
    # a third of the rows share one value: resolved from the bucket's min == max, not by sorting
    v = np.concatenate([np.full(1000, 7.0), np.linspace(0, 100, 2000)])
    df = spark.createDataFrame(pd.DataFrame({"x": v}))
    r = quantiles_wide(df, ["x"], [0.5], ["m"]).collect()[0]
    assert abs(r["m"] - _np_q(v, 0.5)) < 1e-12


def test_hot_segment_matches_each_segment(spark):
    # segment 0 holds a third of all rows; results per segment equal numpy on that segment alone
    rng = np.random.default_rng(9)
    n = 3000
    g = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 40, n))
    x = rng.gamma(2.0, 10.0, n)
    pdf = pd.DataFrame({"g": g, "x": x})
    out = {r["g"]: r for r in quantiles_wide(spark.createDataFrame(pdf), ["x"], [0.1, 0.5, 0.9], ["a", "b", "c"], by=["g"]).collect()}
    for key, part in pdf.groupby("g"):
        for p, nm in ((0.1, "a"), (0.5, "b"), (0.9, "c")):
            assert abs(out[key][nm] - _np_q(part["x"].to_numpy(), p)) < 1e-9
