"""Null keys, infinities, empty tables and both kernels."""

import math

import pytest

from tabscope.operators import linear as L
from tabscope.operators.correlation import BLOCKED_MIN_K, corr_long, redundant_pairs
from tabscope.operators.moments import moments
from tabscope.operators.prepare import impute_median
from tabscope.operators.profile import choose_target, target_kind
from tabscope.operators.quantiles import quantiles
from tabscope.operators.segments import seg_bytes
from tabscope.plans import recommend as RC
from tabscope.plans import rules as RU

INF = float("inf")


def table(spark):
    rows = [("s", float(i), float(i * i), 1.0, INF if i == 3 else float(-i), None if i % 3 else float(i), float(i % 4)) for i in range(12)]
    rows += [(None, *r[1:]) for r in rows] + [("void", None, None, None, None, None, None)] * 4
    return spark.createDataFrame(rows, "g string, a double, b double, c double, d double, e double, f double")


def test_kernels_agree_on_infinities_constants_nulls_and_empty_segments(spark):
    df, cols = table(spark), ["a", "b", "c", "d", "e", "f"]
    wide = {(r["g"], r["feature_a"], r["feature_b"]): (r["n"], r["r"]) for r in corr_long(df, cols, ["g"]).collect()}
    for i, x in enumerate(cols):
        for y in cols[i + 1:]:
            assert 2 < BLOCKED_MIN_K <= len(cols)
            for r in corr_long(df, [x, y], ["g"]).collect():
                n, v = wide[r["g"], x, y]
                assert n == r["n"], (x, y)
                assert (v is None) == (r["r"] is None) and (v is None or math.isclose(v, r["r"], abs_tol=1e-9)), (x, y, v, r["r"])
    assert wide["s", "a", "d"] == (12, None) and wide[None, "a", "c"][1] is None and wide["void", "a", "b"] == (0, None)
    assert wide[None, "a", "b"] == wide["s", "a", "b"]
    assert not [r for r in redundant_pairs(corr_long(df, ["a", "b", "d"], ["g"]), ["g"]).collect() if "d" in (r["feature_a"], r["feature_b"])]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_moment_kernels_have_one_contract(spark, by):
    for df in (table(spark), table(spark).where("g = 'void'"), table(spark).limit(0)):
        narrow = {tuple(r[b] for b in by): r for r in moments(df, ["a", "b", "f"], by, wide=False).collect()}
        wide = {tuple(r[b] for b in by): r for r in moments(df, ["a", "b", "f"], by, wide=True).collect()}
        assert narrow.keys() == wide.keys()
        for k, r in narrow.items():
            assert r["n"] == wide[k]["n"]
            for x, y in zip([*r["mean"], *r["cov"]], [*wide[k]["mean"], *wide[k]["cov"]]):
                assert (x is None and y is None) or math.isclose(x, y, abs_tol=1e-9)


def test_quantiles_of_null_segments_and_of_the_widest_range(spark):
    got = {(r["g"], r["prob"]): r["value"] for r in quantiles(table(spark), ["a"], [0.25, 0.5], ["g"]).collect()}
    assert got == {(g, p): v for g in ("s", None) for p, v in ((0.25, 2.75), (0.5, 5.5))}
    spread = [(x,) for x in (-1.7e308, -1.0, 5e-324, 1e-300, 3.0, 1.7e308, 1e-310)]
    assert quantiles(spark.createDataFrame(spread, "a double"), ["a"], [0.5]).collect()[0]["value"] == 1e-310


def test_impute_keeps_the_rows_of_every_segment(spark):
    out = impute_median(table(spark).select("g", "a", "e"), ["a", "e"], ["g"]).collect()
    assert len(out) == 28
    assert sorted(r["e"] for r in out if r["g"] is None) == sorted([0.0, 3.0, 6.0, 9.0] + [4.5] * 8)
    assert [r["a"] for r in out if r["g"] == "void"] == [0.0] * 4


def test_vif_takes_infinities_as_missing(spark):
    with_inf = {r["feature"]: r["vif"] for r in L.vif(table(spark).where("g = 's'"), ["b", "d", "f"]).collect()}
    without = {r["feature"]: r["vif"] for r in L.vif(table(spark).where("g = 's' and a <> 3"), ["b", "d", "f"]).collect()}
    assert with_inf == without and all(v is not None for v in with_inf.values())


def test_nan_is_no_distinct_value(spark):
    df = spark.createDataFrame([(float(i % 3),) for i in range(100)] + [(float("nan"),), (None,)], "t double")
    assert target_kind(df, "t").collect()[0]["n_distinct"] == 3
    df = spark.createDataFrame([(float(i % 10), float(i)) for i in range(40)] + [(float("nan"), 1.0)], "sale_price double, z double")
    assert choose_target(df).collect()[0]["target"] == "z"


def test_a_fit_without_test_rows_is_not_scored(spark):
    df = spark.createDataFrame([(None,), (0.1,), (0.3,), (0.9,)], "r2 double")
    assert [r[0] for r in df.select(L.r2_band(df["r2"])).collect()] == ["not_scored", "critical", "warning", "ok"]


def test_missing_evidence_is_unknown_and_lint_keeps_null_segments(spark):
    fields = ", ".join(f"{c} {'boolean' if c == 'poor_model_fit' else 'int' if c == 'weak_feature_pct' else 'long' if 'count' in c or 'total' in c else 'double'}"
                       for c in RU.EVIDENCE_FIELDS)
    none = [None] * len(RU.EVIDENCE_FIELDS)
    bad = [55.0, 1.0, 0, 0.1, 0.5, 10, 0.5, 5, 0.0, 0.0, 0.5, False]
    ev = spark.createDataFrame([("u", *none), (None, *bad)], "g string, " + fields)
    dec = RU.decision_table(ev, ["g"])
    got = {r["g"]: (r["decision"], r["severity"], r["confidence"]) for r in dec.collect()}
    assert got == {"u": ("UNKNOWN", "LOW", 0.35), None: ("DATA_ISSUE", "CRITICAL", 0.93)}
    kept, _ = RC.lint(dec, RC.recommendations(dec, ["g"]), ["g"])
    assert not [r for r in kept.collect() if r["fallback"]]


def test_sizes_for_broadcasts_count_strings_and_arrays(spark):
    small = spark.createDataFrame([("x" * 1000, [0.0] * 500)] * 3, "g string, v array<double>")
    assert 3 * 5000 <= seg_bytes(small, ["g"]) <= 3 * 5200
