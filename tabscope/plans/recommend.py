"""Recommendations over decision rows (REC1-REC4), ranked insights (INS1) and output checks (CHK1).

The recommendation rules are a 13-row dimension table broadcast-joined on
the decision name; lint, dedup and top-k are window and anti-join plans
partitioned by segment, so their size is bounded by rows per segment.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscope.functions.columns import seg_cols

DEFAULT_ROOT_CAUSE = "Primary issue identified from evidence."
SEV = "<severity>"

# Recommendation rows per decision (priority, action, reason, impact, effort).
# Priority "<severity>" means the decision's severity; reason "<trigger>" means "<root cause> Trigger: <dominant signal>".
RECOMMENDATION_RULES = (
    ("DATA_ISSUE", 0, SEV, "Fix missing values and schema consistency before retraining", "<trigger>", "HIGH", "HIGH"),
    ("DATA_ISSUE", 1, "HIGH", "Run data validation checks (nulls, duplicates, outliers)",
     "Data defects must be controlled before any model-level change.", "HIGH", "MEDIUM"),
    ("MULTICOLLINEARITY", 0, SEV, "Remove or merge highly correlated feature pairs", "<trigger>", "HIGH", "LOW"),
    ("MULTICOLLINEARITY", 1, "MEDIUM", "If instability remains after feature pruning, apply PCA or regularization as a secondary step",
     "Dimensionality reduction should follow direct redundancy cleanup, not replace it.", "MEDIUM", "MEDIUM"),
    ("WEAK_SIGNAL", 0, SEV, "Introduce new predictive features aligned with the target outcome", "<trigger>", "HIGH", "HIGH"),
    ("WEAK_SIGNAL", 1, "HIGH", "Expand feature engineering with interaction and non-linear terms guided by domain knowledge",
     "Current feature set shows weak signal; domain context is '<domain>'.", "HIGH", "MEDIUM"),
    ("WEAK_SIGNAL", 2, "HIGH", "Reassess whether available data is suitable for the prediction target before model tuning",
     "When all tested methods show negligible gain, data relevance is the primary constraint.", "HIGH", "MEDIUM"),
    ("NON_LINEARITY", 0, SEV, "Benchmark tree-based models (Random Forest / Gradient Boosting)", "<trigger>", "HIGH", "MEDIUM"),
    ("NON_LINEARITY", 1, "MEDIUM", "Add interaction and non-linear transformed features",
     "Feature transforms can expose structure missed by linear assumptions.", "MEDIUM", "MEDIUM"),
    ("FEATURE_GAP", 0, SEV, "Collect additional domain variables with direct target relevance", "<trigger>", "HIGH", "HIGH"),
    ("FEATURE_GAP", 1, "HIGH", "Prioritize data acquisition plan with subject-matter experts",
     "Missing explanatory variables limit modeling gains from algorithm tuning.", "HIGH", "HIGH"),
    ("*", 0, SEV, "Perform targeted feature engineering on low-signal predictors", "<trigger>", "HIGH", "MEDIUM"),
    ("*", 1, "MEDIUM", "Re-assess domain feature coverage and interactions",
     "Weak predictive signal indicates current features are not sufficiently informative.", "MEDIUM", "MEDIUM"),
)
RULE_DECISIONS = ("DATA_ISSUE", "MULTICOLLINEARITY", "WEAK_SIGNAL", "NON_LINEARITY", "FEATURE_GAP")

# Allowed action keywords per decision (whole-word match) used by the lint.
ALLOWED_ACTION_KEYWORDS = {
    "DATA_ISSUE": ["data", "missing", "quality", "clean"],
    "MULTICOLLINEARITY": ["multicollinearity", "pca", "redundant", "vif", "correlated"],
    "NON_LINEARITY": ["non-linear", "tree", "boost", "interaction", "random forest", "gradient boosting"],
    "WEAK_FEATURES": ["feature", "engineering", "domain", "signal"],
    "WEAK_SIGNAL": ["feature", "engineering", "domain", "signal", "predictive", "target", "collect", "data"],
    "FEATURE_GAP": ["collect", "feature", "domain", "variables"],
}
PRIORITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}


def rules_table(spark: SparkSession) -> DataFrame:
    schema = "rule_decision string, seq int, priority string, action string, reason string, impact string, effort string"
    return spark.createDataFrame(list(RECOMMENDATION_RULES), schema)


def recommendations(dec: DataFrame, by: Sequence[str] = (), domain: Column | None = None,
                    root_cause: Column | None = None) -> DataFrame:
    """REC1: (by..., decision, seq, priority, action, reason, impact, effort, evidence) -- 2 or 3 rows per decision.

    ``evidence`` is the payload of a row: the signals of the decision and, as far as ``dec`` carries them,
    r2_percentage, weak_feature_pct and (first row of DATA_ISSUE) missing_percentage; 0 where not given."""
    by = seg_cols(by)
    spark = dec.sparkSession
    d = dec.withColumn("__rule", F.when(F.col("decision").isin(*RULE_DECISIONS), F.col("decision")).otherwise(F.lit("*")))
    d = d.withColumn("__domain", domain if domain is not None else F.lit("generic"))
    d = d.withColumn("__root", root_cause if root_cause is not None else F.lit(DEFAULT_ROOT_CAUSE))
    j = d.join(F.broadcast(rules_table(spark)), F.col("__rule") == F.col("rule_decision"))
    prio = F.when(F.col("priority") == SEV, F.coalesce(F.col("severity"), F.lit("MEDIUM"))).otherwise(F.col("priority"))
    reason = F.when(F.col("reason") == "<trigger>", F.concat(F.col("__root"), F.lit(" Trigger: "), F.col("dominant_signal"))) \
        .otherwise(F.replace(F.col("reason"), F.lit("<domain>"), F.col("__domain")))
    given = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in dec.columns else F.lit(0.0)
    payload = F.struct(F.col("dominant_signal"), F.col("secondary_signals"), given("r2_percentage").alias("r2_percentage"),
                       given("weak_feature_pct").alias("weak_feature_pct"),
                       F.when((F.col("__rule") == "DATA_ISSUE") & (F.col("seq") == 0), given("missing_percentage")).alias("missing_percentage"))
    return j.select(*by, "decision", "seq", prio.alias("priority"), "action", reason.alias("reason"), "impact", "effort", payload.alias("evidence"))


def _rec(seq, priority, action, reason, impact, effort, **evidence):
    """One row; ``evidence``: the two figures that the rule looked at, by name."""
    shown = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("double"))]
    return F.struct(F.lit(seq).alias("seq"), F.lit(priority).alias("priority"), F.lit(action).alias("action"), reason.alias("reason"),
                    F.lit(impact).alias("impact"), F.lit(effort).alias("effort"),
                    (F.create_map(*shown) if shown else F.create_map().cast("map<string,double>")).alias("evidence"))


def legacy_recommendations(ev: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """REC2: up to four threshold rules, ordered CRITICAL > HIGH > MEDIUM > LOW (stable), with the reason and the
    figures behind each; a row without any evidence gets one row that asks for it."""
    by = seg_cols(by)
    fields = ["weak_feature_pct", "strongest_correlation", "weak_features", "redundant_pairs_count", "max_redundancy_correlation", "r2_score",
              "r2_percentage", "data_quality_score", "missing_percentage"]
    absent = F.coalesce(*[F.col(c).cast("string") for c in fields]).isNull()
    ev = ev.select(*by, absent.alias("__absent"), *[F.coalesce(F.col(c), F.lit(0).cast(ev.schema[c].dataType)).alias(c) for c in fields])
    weak, red, r2, dq = F.col("weak_feature_pct"), F.col("redundant_pairs_count"), F.col("r2_score"), F.col("data_quality_score")
    strong, maxr, r2p, miss = (F.col(c) for c in ("strongest_correlation", "max_redundancy_correlation", "r2_percentage", "missing_percentage"))
    have = ~F.col("__absent")
    cands = F.array(
        F.when(~have, _rec(0, "LOW", "Collect required evidence signals",
                           F.lit("Evidence was unavailable, so targeted recommendations could not be generated reliably."), "MEDIUM", "LOW")),
        F.when(have & (weak > 50), _rec(0, "CRITICAL", "Add domain-specific features", F.format_string(
            "%d%% of features are weak (correlation < 0.15). Strongest predictor is only %.2f. Insufficient signal in current feature set.", weak, strong),
            "HIGH", "HIGH", weak_features=F.col("weak_features"), strongest_correlation=strong)),
        F.when(have & (red > 2), _rec(1, "HIGH", "Remove multicollinear features", F.format_string(
            "%d pairs of features show high correlation (max: %.2f). Redundant features distort model coefficients.", red, maxr),
            "HIGH", "LOW", redundant_pairs=red, max_correlation=maxr)),
        F.when(have & (r2 < 0.3) & (weak <= 50), _rec(2, "HIGH", "Try non-linear models (Random Forest, Gradient Boosting)", F.format_string(
            "Model R² = %.1f%% is poor despite reasonable features. Linear relationships may not capture data patterns.", r2p),
            "MEDIUM", "MEDIUM", r2_score=r2, r2_percentage=r2p)),
        F.when(have & (dq < 70), _rec(3, "CRITICAL", "Improve data quality - handle missing values", F.format_string(
            "Data quality score is only %s/100 with %.1f%% missing values. Poor data quality undermines all analysis.", dq.cast("string"), miss),
            "HIGH", "HIGH", quality_score=dq, missing_percentage=miss)),
    )
    x = ev.select(*by, F.explode(F.filter(cands, lambda s: s.isNotNull())).alias("r")).select(*by, "r.*")
    rank = F.when(F.col("priority") == "CRITICAL", 0).when(F.col("priority") == "HIGH", 1).when(F.col("priority") == "MEDIUM", 2).otherwise(3)
    w = (Window.partitionBy(*[F.col(f"`{b}`") for b in by]) if by else Window.partitionBy(F.lit(0))).orderBy(rank, F.col("seq"))
    return x.withColumn("position", F.row_number().over(w))


def _keyword_match(action_key: Column, decision: Column) -> Column:
    m = None
    for dec, kws in ALLOWED_ACTION_KEYWORDS.items():
        pat = r"(?<!\w)(" + "|".join(re.escape(k.lower()) for k in kws) + r")(?!\w)"
        m = F.when(decision == dec, action_key.rlike(pat)) if m is None else m.when(decision == dec, action_key.rlike(pat))
    return m.otherwise(F.lit(True))


# Texts of the lint's flags and corrections.
LINT_TEXTS = {
    "collinear": "Conflict detected: R²=%.3f is below 0.10, but primary decision is MULTICOLLINEARITY. Expected WEAK_SIGNAL.",
    "weak_signal": "Conflict detected: WEAK_SIGNAL selected with R²=%.3f and best improvement %.1f%% (not negligible).",
    "negligible": "Best observed improvement %.1f%% is below 5%% and should be treated as negligible.",
    "empty": "Removed recommendation with empty action.",
    "duplicate": "Removed duplicate recommendation: %s.",
    "mismatch": "Removed decision-mismatched recommendation: %s.",
    "fallback": "Inserted fallback recommendation to preserve decision alignment.",
}
# Root causes of the insights and the confidence of the two that have one of their own.
INSIGHT_ROOT_CAUSES = (
    "Feature set insufficient for robust prediction.",
    "Feature redundancy detected; not primary cause of low R².",
    "Data defects can limit model performance.",
)
INSIGHT_CONFIDENCE = (0.85, 0.7)


def _lint_status(dec: DataFrame, recs: DataFrame, by: Sequence[str]) -> DataFrame:
    """recs with the decision's columns and ``status``: kept, empty, mismatch or duplicate (of an earlier kept action)."""
    from tabscope.operators.segments import seg_join
    r = seg_join(recs.drop("decision"), dec.select(*by, "decision", "severity", "dominant_signal"), by)
    key = F.lower(F.trim(F.coalesce(F.col("action"), F.lit(""))))
    r = r.withColumn("__key", key)
    w = (Window.partitionBy(*[F.col(f"`{b}`") for b in by], "__key") if by else Window.partitionBy("__key")).orderBy("seq")
    r = r.withColumn("__rn", F.row_number().over(w))
    match = _keyword_match(F.col("__key"), F.col("decision"))
    return r.withColumn("status", F.when(F.col("__key") == "", "empty").when(~match, "mismatch").when(F.col("__rn") > 1, "duplicate").otherwise("kept"))


def lint_rows(dec: DataFrame, recs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """REC3: what the lint found, one row each: (by..., kind, code, seq, text); kind is flag (of the decision) or correction (of a
    recommendation, whose seq it names; the fallback's is null)."""
    from tabscope.operators.segments import seg_join
    by = seg_cols(by)
    r2, imp, d = F.col("r2_score"), F.col("best_improvement"), F.col("decision")
    none = F.lit(None).cast("int")
    found = lambda kind, code, seq, text: F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"), seq.alias("seq"), text.alias("text"))
    flags = F.array(
        F.when((d == "MULTICOLLINEARITY") & (r2 < 0.10), found("flag", "collinear", none, F.format_string(LINT_TEXTS["collinear"], r2))),
        F.when((d == "WEAK_SIGNAL") & (r2 >= 0.10) & (imp >= 0.05), found("flag", "weak_signal", none, F.format_string(LINT_TEXTS["weak_signal"], r2, imp * 100))),
        F.when(imp < 0.05, found("flag", "negligible", none, F.format_string(LINT_TEXTS["negligible"], imp * 100))))
    rows = dec.select(*by, F.explode(F.array_compact(flags)).alias("f")).select(*by, "f.*")
    status = _lint_status(dec, recs, by)
    action = F.trim("action")
    text = (F.when(F.col("status") == "empty", F.lit(LINT_TEXTS["empty"]))
            .when(F.col("status") == "duplicate", F.format_string(LINT_TEXTS["duplicate"], action)).otherwise(F.format_string(LINT_TEXTS["mismatch"], action)))
    rows = rows.unionByName(status.where("status <> 'kept'").select(*by, F.lit("correction").alias("kind"), F.col("status").alias("code"), F.col("seq").cast("int").alias("seq"), text.alias("text")))
    kept = status.groupBy(*[F.col(f"`{b}`") for b in by]).agg(F.count_if(F.col("status") == "kept").alias("__kept"))
    left = seg_join(dec.select(*by, "decision"), kept, by, "left").where("coalesce(__kept, 0) = 0 AND decision <> 'UNKNOWN'")
    return rows.unionByName(left.select(*by, F.lit("correction").alias("kind"), F.lit("fallback").alias("code"), none.alias("seq"), F.lit(LINT_TEXTS["fallback"]).alias("text")))


def lint(dec: DataFrame, recs: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """REC3: validated recommendations and a per-segment report.

    Drops empty actions, keyword-mismatched actions and later duplicates (case-insensitive), fills a missing
    priority with the severity, and inserts one fallback row when nothing is left (unless UNKNOWN).
    Returns (validated (by..., seq, priority, action, reason, impact, effort, fallback, evidence if recs have it), report);
    ``lint_rows`` has one row for each finding.
    """
    by = seg_cols(by)
    from tabscope.operators.segments import seg_join
    r = _lint_status(dec, recs, by)
    payload = [recs.schema["evidence"].dataType] if "evidence" in recs.columns else []
    kept = r.where(F.col("status") == "kept").select(
        *by, "seq", F.coalesce(F.nullif(F.col("priority"), F.lit("")), F.col("severity")).alias("priority"),
        F.trim("action").alias("action"),
        F.coalesce(F.nullif(F.trim("reason"), F.lit("")),
                   F.concat(F.lit("Aligned with decision "), F.col("decision"), F.lit(": "), F.col("dominant_signal"))).alias("reason"),
        "impact", "effort", F.lit(False).alias("fallback"), *[F.col("evidence") for _ in payload])
    has = kept.select(*by).distinct()
    need = dec.where(F.col("decision") != "UNKNOWN")
    need = seg_join(need, has.withColumn("__has", F.lit(1)), by, "left_anti") if by else (need if has.isEmpty() else need.limit(0))
    fb = need.select(*by, F.lit(0).alias("seq"), F.col("severity").alias("priority"),
                     F.concat(F.lit("Execute primary remediation for "), F.col("decision")).alias("action"),
                     F.concat(F.lit("No aligned recommendations remained after validation. Triggered by: "),
                              F.coalesce(F.col("dominant_signal"), F.lit("N/A"))).alias("reason"),
                     F.lit("HIGH").alias("impact"), F.lit("MEDIUM").alias("effort"), F.lit(True).alias("fallback"),
                     *[F.struct(*[(F.coalesce("dominant_signal", F.lit("N/A")) if f.name == "dominant_signal" else F.col("secondary_signals") if f.name == "secondary_signals"
                                   else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields]).alias("evidence") for kind in payload])
    validated = kept.unionByName(fb)
    counts = r.groupBy(*by).agg(
        F.count_if(F.col("status") == "mismatch").alias("n_mismatch"),
        F.count_if(F.col("status") != "kept").alias("n_removed"))
    rep = seg_join(dec.select(*by, "decision", "r2_score", "best_improvement"), counts, by, "left")
    rep = seg_join(rep, fb.select(*by, F.lit(1).alias("__fb")), by, "left")
    r2, imp, d = F.col("r2_score"), F.col("best_improvement"), F.col("decision")
    consistent = ~(((d == "MULTICOLLINEARITY") & (r2 < 0.10)) | ((d == "WEAK_SIGNAL") & (r2 >= 0.10) & (imp >= 0.05)))
    flags = ((d == "MULTICOLLINEARITY") & (r2 < 0.10)).cast("int") + ((d == "WEAK_SIGNAL") & (r2 >= 0.10) & (imp >= 0.05)).cast("int") \
        + (imp < 0.05).cast("int")
    report = rep.select(
        *by, "decision",
        consistent.alias("decision_priority_consistent"),
        (imp >= 0.05).alias("improvement_is_meaningful"),
        (F.coalesce(F.col("n_mismatch"), F.lit(0)) == 0).alias("recommendations_match_decision"),
        F.lit(True).alias("no_conflicting_priorities"), F.lit(True).alias("summary_aligned_with_decision"),
        F.lit(True).alias("all_recommendations_have_evidence"),
        flags.alias("flag_count"),
        (F.coalesce(F.col("n_removed"), F.lit(0)) + F.coalesce(F.col("__fb"), F.lit(0))).cast("long").alias("correction_count"),
    )
    return validated, report


def top_actions(recs: DataFrame, by: Sequence[str] = (), n: int = 3) -> DataFrame:
    """REC4: first n recommendations per segment by priority rank, stable in list order."""
    by = seg_cols(by)
    rank = F.coalesce(*[F.when(F.col("priority") == k, F.lit(v)) for k, v in PRIORITY_RANK.items()], F.lit(99))
    w = (Window.partitionBy(*[F.col(f"`{b}`") for b in by]) if by else Window.partitionBy(F.lit(0))).orderBy(rank, F.col("seq"))
    return recs.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def insights(ctx: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """INS1: ranked insights per segment, deduplicated on whitespace/case-normalised content.

    ``ctx`` columns: r2 (unrounded), target, strongest_feature, best_improvement, n_high_pairs, pair_a, pair_b,
    pair_r, n_null_columns; where given also root_cause, confidence (of the model insight) and actions (array, in order
    of the recommendations).  Returns (by..., rank, severity, category, content, root_cause, confidence, actions): the
    model insight takes the first three actions, collinearity the second and third, data quality the third and fourth.
    """
    by = seg_cols(by)
    given = lambda c, kind: F.col(c).cast(kind) if c in ctx.columns else F.lit(None).cast(kind)
    actions = F.coalesce(given("actions", "array<string>"), F.array().cast("array<string>"))
    more = lambda i, confidence: [
        (F.coalesce(given("root_cause", "string"), F.lit(INSIGHT_ROOT_CAUSES[0])) if i == 0 else F.lit(INSIGHT_ROOT_CAUSES[i])).alias("root_cause"),
        confidence.cast("double").alias("confidence"), F.slice(actions, i + 1, 3 if i == 0 else 2).alias("actions")]
    r2 = F.col("r2")
    imp = F.coalesce(F.col("best_improvement"), F.lit(0.0))
    note = F.when(imp >= 0.05, F.format_string("Best experiment improvement: +%.1f%% (meaningful)", imp * 100)).otherwise(
        F.format_string("Best experiment improvement: +%.1f%% (below 5%% threshold → negligible; no tested method materially helps)", imp * 100))
    prefix = F.when(r2 < 0, F.format_string("Model performs worse than baseline (R²=%.3f). ", r2)).otherwise(F.lit(""))
    content1 = F.concat(prefix, F.format_string("Model explains only %.1f%% of %s variance (%s strongest), leaving %.1f%% unexplained. ",
                                                r2 * 100, F.coalesce(F.col("target"), F.lit("target")),
                                                F.coalesce(F.col("strongest_feature"), F.lit("top feature")), 100 - r2 * 100),
                        note, F.lit("."))
    items = F.array(
        F.struct(F.lit(1).alias("rank"), F.when(r2 < 0.3, "CRITICAL").otherwise("MEDIUM").alias("severity"),
                 F.lit("MODEL_PERFORMANCE").alias("category"), content1.alias("content"), *more(0, given("confidence", "double"))),
        F.when(F.col("n_high_pairs") > 0, F.struct(
            F.lit(2).alias("rank"), F.lit("HIGH").alias("severity"), F.lit("MULTICOLLINEARITY").alias("category"),
            F.format_string("Detected redundant feature pair: %s ↔ %s (r=%.2f). May cause unstable coefficient attribution.",
                            F.col("pair_a"), F.col("pair_b"), F.col("pair_r")).alias("content"), *more(1, F.lit(INSIGHT_CONFIDENCE[0])))),
        F.when(F.col("n_null_columns") > 0, F.struct(
            F.lit(3).alias("rank"), F.lit("MEDIUM").alias("severity"), F.lit("DATA_QUALITY").alias("category"),
            F.format_string("Detected %d data quality issue(s). Address before advanced modeling.", F.col("n_null_columns")).alias("content"), *more(2, F.lit(INSIGHT_CONFIDENCE[1])))),
    )
    x = ctx.select(*by, F.explode(F.filter(items, lambda s: s.isNotNull())).alias("s")).select(*by, "s.*")
    fp = F.lower(F.trim(F.regexp_replace("content", r"\s+", " ")))
    w = (Window.partitionBy(*[F.col(f"`{b}`") for b in by], "__fp") if by else Window.partitionBy("__fp")).orderBy("rank")
    return x.withColumn("__fp", fp).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__fp", "__rn")


def action_lists(recs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., actions, n_recs): the actions of each segment in order; two or three, by the rules."""
    by = seg_cols(by)
    each = F.sort_array(F.collect_list(F.struct("seq", "action")))
    return recs.groupBy(*[F.col(f"`{b}`") for b in by]).agg(F.transform(each, lambda r: r["action"]).alias("actions"), F.count(F.lit(1)).alias("n_recs"))


def output_violations(ana_top: DataFrame, ins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """CHK1 as rows: (by..., check, offending) for each R² that is not finite, each strongest feature that is not first in
    the standardized importance, and each insight text that a segment has more than once.  No rows: nothing is wrong."""
    by = seg_cols(by)
    held = [F.col(f"`{b}`") for b in by]
    r2 = F.col("r2").cast("double")
    wrong = lambda check, value: F.struct(F.lit(check).alias("check"), value.cast("string").alias("offending"))
    each = F.array(
        F.when(r2.isNull() | F.isnan(r2) | (F.abs(r2) == float("inf")), wrong("r2_finite", F.coalesce(r2.cast("string"), F.lit("null")))),
        F.when(F.col("strongest_feature") != F.col("rank1_feature"), wrong("strongest_matches_rank1", F.concat_ws(" vs ", "strongest_feature", "rank1_feature"))))
    rows = ana_top.select(*held, F.explode(F.array_compact(each)).alias("v")).select(*held, "v.*")
    twice = ins.groupBy(*held, "content").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return rows.unionByName(twice.select(*held, F.lit("insights_unique").alias("check"), F.coalesce("content", F.lit("null")).alias("offending")))


def output_checks(ana_top: DataFrame, ins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """CHK1: (by..., r2_finite, strongest_matches_rank1, insights_unique) -- one row per segment."""
    by = seg_cols(by)
    from tabscope.operators.segments import seg_join
    u = ins.groupBy(*by).agg((F.count(F.lit(1)) == F.count_distinct("content")).alias("insights_unique"))
    r2 = F.col("r2")
    base = ana_top.select(*by, (r2.isNotNull() & ~F.isnan(r2) & (F.abs(r2) < F.lit(float("inf")))).alias("r2_finite"),
                          F.coalesce(F.col("strongest_feature") == F.col("rank1_feature"), F.lit(True)).alias("strongest_matches_rank1"))
    return seg_join(base, u, by, "left").select(*by, "r2_finite", "strongest_matches_rank1",
                                                F.coalesce("insights_unique", F.lit(True)).alias("insights_unique"))
