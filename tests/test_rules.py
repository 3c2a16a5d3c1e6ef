"""Literal evidence rows: one per decision branch and one on each side of the thresholds."""

from pyspark.sql import functions as F

from tabscope.plans import recommend as RC
from tabscope.plans import rules as RU

COLS = ("case", "data_quality_score", "missing_percentage", "redundant_pairs_count", "max_redundancy_correlation",
        "r2_score", "weak_feature_pct", "strongest_correlation", "total_features", "nonlinear_gain",
        "best_improvement", "best_model_r2", "poor_model_fit")

# (case, dq, miss, red, maxr, r2, weak, strong, total, gain, imp, best, poor) -> (decision, severity, confidence)
CASES = [
    (("dq_low", 65.0, 0.0, 0, 0.0, 0.5, 0, 0.5, 5, 0.0, 0.0, 0.5, False), ("DATA_ISSUE", "HIGH", 0.78)),
    (("dq_crit", 55.0, 0.0, 0, 0.0, 0.5, 0, 0.5, 5, 0.0, 0.0, 0.5, False), ("DATA_ISSUE", "CRITICAL", 0.93)),
    (("miss_10", 90.0, 10.0, 0, 0.0, 0.5, 0, 0.5, 5, 0.0, 0.0, 0.5, False), ("DATA_ISSUE", "HIGH", 0.78)),
    (("miss_20", 90.0, 20.0, 0, 0.0, 0.5, 0, 0.5, 5, 0.0, 0.0, 0.5, False), ("DATA_ISSUE", "CRITICAL", 0.78)),
    (("dq_70", 70.0, 9.9, 0, 0.0, 0.5, 0, 0.5, 5, 0.0, 0.0, 0.5, False), ("WEAK_FEATURES", "LOW", 0.55)),
    (("weak_sig", 90.0, 0.0, 5, 0.9, 0.05, 0, 0.5, 5, 0.0, 0.01, 0.06, True), ("WEAK_SIGNAL", "CRITICAL", 0.9)),
    (("weak_sig_gain", 90.0, 0.0, 0, 0.0, 0.05, 0, 0.5, 5, 0.1, 0.1, 0.15, True), ("WEAK_SIGNAL", "CRITICAL", 0.82)),
    (("multi_3", 90.0, 0.0, 3, 0.9, 0.4, 0, 0.5, 5, 0.0, 0.0, 0.4, False), ("MULTICOLLINEARITY", "HIGH", 0.8)),
    (("multi_6", 90.0, 0.0, 6, 0.9, 0.4, 0, 0.5, 5, 0.0, 0.0, 0.4, False), ("MULTICOLLINEARITY", "CRITICAL", 0.86)),
    (("multi_10", 90.0, 0.0, 10, 0.9, 0.4, 0, 0.5, 5, 0.0, 0.0, 0.4, False), ("MULTICOLLINEARITY", "CRITICAL", 0.9)),
    (("weakfeat_hi", 90.0, 0.0, 0, 0.0, 0.15, 80, 0.1, 5, 0.0, 0.0, 0.15, True), ("WEAK_FEATURES", "HIGH", 0.92)),
    (("nonlin_hi", 90.0, 0.0, 0, 0.0, 0.15, 0, 0.5, 5, 0.6, 0.6, 0.75, True), ("NON_LINEARITY", "HIGH", 0.84)),
    (("nonlin_med", 90.0, 0.0, 0, 0.0, 0.25, 0, 0.5, 5, 0.2, 0.2, 0.45, True), ("NON_LINEARITY", "MEDIUM", 0.75)),
    (("gap", 90.0, 0.0, 0, 0.0, 0.2, 85, 0.05, 2, 0.0, 0.0, 0.3, True), ("FEATURE_GAP", "HIGH", 0.7)),
    (("weak_gt70", 90.0, 0.0, 0, 0.0, 0.4, 75, 0.5, 5, 0.0, 0.0, 0.4, False), ("WEAK_FEATURES", "HIGH", 0.9)),
    (("weak_gt50", 90.0, 0.0, 0, 0.0, 0.4, 60, 0.5, 5, 0.0, 0.0, 0.4, False), ("WEAK_FEATURES", "MEDIUM", 0.85)),
    (("strong_low", 90.0, 0.0, 0, 0.0, 0.4, 0, 0.14, 5, 0.0, 0.0, 0.4, False), ("WEAK_FEATURES", "MEDIUM", 0.65)),
    (("fine", 90.0, 0.0, 0, 0.0, 0.6, 0, 0.5, 5, 0.0, 0.0, 0.6, False), ("WEAK_FEATURES", "LOW", 0.55)),
]


def _ev(spark):
    rows = [c for c, _ in CASES]
    schema = ("case string, data_quality_score double, missing_percentage double, redundant_pairs_count long, "
              "max_redundancy_correlation double, r2_score double, weak_feature_pct int, strongest_correlation double, "
              "total_features long, nonlinear_gain double, best_improvement double, best_model_r2 double, poor_model_fit boolean")
    return spark.createDataFrame(rows, schema)


def test_decision_branches(spark):
    got = {r["case"]: r for r in RU.decision_table(_ev(spark), ["case"]).collect()}
    for c, (dec, sev, conf) in CASES:
        r = got[c[0]]
        assert (r["decision"], r["severity"], r["confidence"]) == (dec, sev, conf), c[0]


def test_bands_and_verdict(spark):
    got = {r["case"]: r for r in RU.decision_table(_ev(spark), ["case"]).collect()}
    assert got["dq_crit"]["data_quality"] == "poor" and got["dq_low"]["data_quality"] == "fair"
    assert got["multi_6"]["multicollinearity"] == "critical" and got["multi_3"]["multicollinearity"] == "high"
    assert got["weak_gt70"]["feature_strength"] == "critical" and got["weak_gt50"]["feature_strength"] == "weak"
    assert got["weak_sig"]["model_perf"] == "critical" and got["fine"]["model_perf"] == "good"
    assert got["nonlin_hi"]["is_model_problem"] and got["dq_low"]["is_data_problem"] and got["gap"]["is_feature_problem"]


def test_recommendations_and_lint(spark):
    dec = RU.decision_table(_ev(spark), ["case"])
    recs = RC.recommendations(dec, ["case"])
    counts = {r["case"]: r["n"] for r in recs.groupBy("case").agg(F.count("*").alias("n")).collect()}
    assert counts["weak_sig"] == 3 and counts["dq_low"] == 2 and counts["fine"] == 2
    validated, report = RC.lint(dec, recs, ["case"])
    v = validated.collect()
    # the second FEATURE_GAP action has no allowed keyword and is always dropped
    gap = [r["action"] for r in v if r["case"] == "gap"]
    assert gap == ["Collect additional domain variables with direct target relevance"]
    rep = {r["case"]: r for r in report.collect()}
    assert not rep["gap"]["recommendations_match_decision"] and rep["gap"]["correction_count"] == 1
    assert rep["weak_sig_gain"]["improvement_is_meaningful"]
    top = RC.top_actions(validated, ["case"]).where("case = 'weak_sig'").collect()
    assert len(top) == 3 and all(r["priority"] in ("CRITICAL", "HIGH") for r in top)


def test_risk_and_financial(spark):
    ev = _ev(spark)
    dec = RU.decision_table(ev, ["case"]).select("case", "severity")
    items = RU.risk_items(ev.join(dec, "case"), ["case"])
    s = {r["case"]: r for r in RU.risk_summary(items, ["case"]).collect()}
    assert s["weak_sig"]["highest_risk"] == "Model Reliability Risk" and s["weak_sig"]["overall_risk_band"] == "CRITICAL"
    fin = {r["case"]: r for r in RU.financial(ev, F.lit(2), ["case"]).collect()}
    f = fin["fine"]
    assert f["annual_value_at_stake"] == 5760000.0 and f["implementation_cost"] == 23000.0
    assert abs(f["estimated_avoidable_loss"] - round(5760000 * 0.08 * 0.4, 2)) < 1e-6
