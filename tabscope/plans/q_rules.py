"""Registered evidence, decision, recommendation and scorecard queries (EVD1, DEC1-4, REC1-4, INS1, CHK1,
CNF1-2, RSK1, FIN1, MOD2-3, DOM1-2).

Evidence comes from real segments of the driver tables: three families, each with one feature and one
target per segment, test rows where the row key is divisible by 5:
  N  v_nonlin by l_suppkey, l_quantity -> y   (quadratic signal)
  L  v_linear by l_suppkey, l_quantity -> y   (near-linear signal)
  E  events by event_type, user_id -> value   (no signal)
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.operators.prepare import split_flag
from tabscope.plans import evidence as EV
from tabscope.plans import oracle_sql as O
from tabscope.plans import recommend as RC
from tabscope.plans import rules as RU
from tabscope.plans.catalog import column_catalog, infer_context, infer_domain
from tabscope.plans.common import rnd
from tabscope.plans.oracle_sql import r6
from tabscope.plans.registry import register
from tabscope.sources import fixtures
from tabscope.sources.tables import TABLES, read_table

FAMILIES = {
    "N": ("v_nonlin", "l_suppkey", "l_quantity", "y", "l_orderkey"),
    "L": ("v_linear", "l_suppkey", "l_quantity", "y", "l_orderkey"),
    "E": ("events", "event_type", "user_id", "value", "event_id"),
}
EV_COLS = ["weak_features", "total_features", "weak_feature_pct", "strongest_correlation", "redundant_pairs_count",
           "max_redundancy_correlation", "r2_score", "r2_percentage", "data_quality_score", "missing_percentage",
           "linear_r2", "best_model_r2", "nonlinear_gain", "best_improvement", "has_weak_features", "has_redundancy",
           "poor_model_fit", "poor_data_quality", "target_correlation"]
DEC_COLS = ["decision", "severity", "confidence", "r2_score", "best_improvement", "redundant_pairs_count", "model_perf",
            "feature_strength", "multicollinearity", "data_quality", "primary_issue", "is_data_problem",
            "is_feature_problem", "is_model_problem"]


def _source(spark, sf, view):
    return {"v_nonlin": fixtures.v_nonlin, "v_linear": fixtures.v_linear}[view](spark, sf) if view.startswith("v_") \
        else read_table(spark, sf, view)


_FAMILY_MEMO: dict = {}


def _version(spark, sf, view) -> str:
    """Size and modification time of the file behind a family's view."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf.rstrip('/')}/{'lineitem' if view.startswith('v_') else view}.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    return f"{status.getLen()}:{status.getModificationTime()}"


def family_tables(spark, sf, fam):
    """Per-segment tables of one family, checkpointed, and kept for the next question on the same data.

    They are one row per segment (or per segment and model), so many registered questions read the same small
    checkpointed tables instead of re-running the scans.  Tables of another application, folder or version of the
    file are let go as soon as they are asked for anew (Spark's cleaner then removes their checkpoints)."""
    view, g, x, y, s = FAMILIES[fam]
    key = (spark.sparkContext.applicationId, sf, _version(spark, sf, view))
    if _FAMILY_MEMO.get(fam, (None,))[0] != key:
        df = _source(spark, sf, view).select(g, s, x, y)
        _FAMILY_MEMO[fam] = (key, EV.segment_evidence(df, y, [x], split_flag(s, method="mod"), by=[g], materialize=True))
    return _FAMILY_MEMO[fam][1]


def mixed_evidence(spark, sf):
    """(family, segment, evidence...) over the three families."""
    out = None
    for fam, (view, g, x, y, s) in FAMILIES.items():
        ev = family_tables(spark, sf, fam)["evidence"]
        e = ev.select(F.lit(fam).alias("family"), F.col(g).cast("string").alias("segment"), *EV_COLS)
        out = e if out is None else out.unionByName(e)
    return out


def _views_for_families():
    return O.with_views("v_nonlin", "v_linear")


def _fam_ctes():
    return ",".join(O.family_evidence_ctes(f, *spec) for f, spec in FAMILIES.items())


def _mixed_sql():
    return " UNION ALL ".join(
        f"SELECT '{f}' AS family, CAST(seg AS VARCHAR) AS segment, {', '.join(EV_COLS)} FROM {f}ev" for f in FAMILIES)


MIXED = _views_for_families() + ", " + _fam_ctes() + f", mixed AS ({_mixed_sql()})"
KEYS = ["family", "segment"]


@register("evidence_by_supplier", O.with_views("v_nonlin") + ", " + O.family_evidence_ctes("N", *FAMILIES["N"])
          + f" SELECT seg AS l_suppkey, {', '.join(EV_COLS)}, strongest_correlation AS strongest_corr, redundant_pairs_count AS redundant_pairs, "
          "max_redundancy_correlation AS max_corr FROM Nev")
def q_evidence_by_supplier(spark, sf):
    return rnd(family_tables(spark, sf, "N")["evidence"])


@register("decision_by_supplier", O.with_views("v_nonlin") + ", " + O.family_evidence_ctes("N", *FAMILIES["N"]) + " "
          + O.decision_select("Nev", "seg AS l_suppkey"))
def q_decision_by_supplier(spark, sf):
    ev = family_tables(spark, sf, "N")["evidence"]
    return rnd(RU.decision_table(ev, ["l_suppkey"]).select("l_suppkey", *DEC_COLS))


def mixed_decisions(spark, sf):
    return RU.decision_table(mixed_evidence(spark, sf), KEYS)


DEC_SQL = MIXED + ", dec AS (" + O.decision_select("mixed", "family, segment") + ")"


@register("decisions_mixed", DEC_SQL + " SELECT family, segment, decision, severity, confidence FROM dec")
def q_decisions_mixed(spark, sf):
    return rnd(mixed_decisions(spark, sf).select(*KEYS, "decision", "severity", "confidence"))


@register("bands", MIXED + """ SELECT family, segment,
    CASE WHEN r2_score < 0.1 THEN 'critical' WHEN r2_score < 0.3 THEN 'weak' WHEN r2_score < 0.5 THEN 'moderate' ELSE 'good' END AS model_perf,
    CASE WHEN weak_feature_pct > 70 THEN 'critical' WHEN weak_feature_pct > 50 THEN 'weak' WHEN weak_feature_pct > 30 THEN 'moderate' ELSE 'strong' END AS feature_strength,
    CASE WHEN redundant_pairs_count >= 5 THEN 'critical' WHEN redundant_pairs_count >= 3 THEN 'high' ELSE 'low' END AS multicollinearity,
    CASE WHEN data_quality_score < 60 THEN 'poor' WHEN data_quality_score < 75 THEN 'fair' WHEN data_quality_score < 85 THEN 'good' ELSE 'excellent' END AS data_quality,
    true AS evidence_used FROM mixed""")
def q_bands(spark, sf):
    return RU.diagnose_bands(mixed_evidence(spark, sf), KEYS)


@register("verdict", DEC_SQL + """ SELECT family, segment, primary_issue, is_data_problem, is_feature_problem, is_model_problem FROM dec""")
def q_verdict(spark, sf):
    return mixed_decisions(spark, sf).select(*KEYS, "primary_issue", "is_data_problem", "is_feature_problem", "is_model_problem")


@register("conflict", DEC_SQL + """ SELECT d.family, d.segment,
    CASE WHEN m.data_quality_score < 70 THEN 'data_quality' WHEN feature_strength = 'weak' THEN 'feature_gap'
         WHEN multicollinearity IN ('high', 'critical') THEN 'multicollinearity'
         WHEN feature_strength IN ('moderate', 'strong') AND model_perf = 'critical' THEN 'model_mismatch' ELSE 'unknown' END AS conflict_issue,
    CAST(CASE WHEN m.data_quality_score < 70 THEN 0.95 WHEN feature_strength = 'weak' THEN 0.9
         WHEN multicollinearity IN ('high', 'critical') THEN 0.88
         WHEN feature_strength IN ('moderate', 'strong') AND model_perf = 'critical' THEN 0.8 ELSE 0.5 END AS DOUBLE) AS conflict_confidence
  FROM dec d JOIN mixed m ON d.family = m.family AND d.segment = m.segment""")
def q_conflict(spark, sf):
    ev = mixed_evidence(spark, sf)
    dec = RU.decision_table(ev, KEYS)
    j = dec.join(ev.select(*KEYS, "data_quality_score"), KEYS)
    return rnd(RU.conflicts(j, F.col("data_quality_score"), KEYS))


def _rules_values_sql():
    rows = []
    for dec, seq, pr, act, reason, imp, eff in RC.RECOMMENDATION_RULES:
        rows.append(f"('{dec}', {seq}, '{pr}', '{act}', '{imp}', '{eff}')")
    return "rules(rule_decision, seq, priority, action, impact, effort) AS (VALUES " + ", ".join(rows) + ")"


REC_SQL = DEC_SQL + ", " + _rules_values_sql() + """,
  recs AS (SELECT d.family, d.segment, d.decision, d.severity, r.seq,
                  CASE WHEN r.priority = '<severity>' THEN d.severity ELSE r.priority END AS priority, r.action, r.impact, r.effort
           FROM dec d JOIN rules r ON r.rule_decision =
             CASE WHEN d.decision IN ('DATA_ISSUE', 'MULTICOLLINEARITY', 'WEAK_SIGNAL', 'NON_LINEARITY', 'FEATURE_GAP') THEN d.decision ELSE '*' END)"""


def mixed_recs(spark, sf):
    dec = mixed_decisions(spark, sf)
    return dec, RC.recommendations(dec, KEYS)


@register("recommendations", REC_SQL + " SELECT family, segment, decision, CAST(seq AS INTEGER) AS seq, priority, action, impact, effort FROM recs")
def q_recommendations(spark, sf):
    return mixed_recs(spark, sf)[1].drop("reason", "evidence")


@register("recommend_legacy", MIXED + """,
  c AS (SELECT family, segment, 0 AS seq, 'CRITICAL' AS priority, 'Add domain-specific features' AS action, 'HIGH' AS impact, 'HIGH' AS effort
        FROM mixed WHERE weak_feature_pct > 50
        UNION ALL SELECT family, segment, 1, 'HIGH', 'Remove multicollinear features', 'HIGH', 'LOW' FROM mixed WHERE redundant_pairs_count > 2
        UNION ALL SELECT family, segment, 2, 'HIGH', 'Try non-linear models (Random Forest, Gradient Boosting)', 'MEDIUM', 'MEDIUM'
        FROM mixed WHERE r2_score < 0.3 AND weak_feature_pct <= 50
        UNION ALL SELECT family, segment, 3, 'CRITICAL', 'Improve data quality - handle missing values', 'HIGH', 'HIGH'
        FROM mixed WHERE data_quality_score < 70)
  SELECT family, segment, CAST(seq AS INTEGER) AS seq, priority, action, impact, effort,
         CAST(row_number() OVER (PARTITION BY family, segment ORDER BY
           CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, seq) AS INTEGER) AS position
  FROM c""")
def q_recommend_legacy(spark, sf):
    return RC.legacy_recommendations(mixed_evidence(spark, sf), KEYS).drop("reason", "evidence")


def _topimp_sql():
    return " UNION ALL ".join(
        f"""SELECT '{f}' AS family, CAST({g} AS VARCHAR) AS segment, abs(regr_slope({y}, {x})) * stddev_pop({x}) AS top_imp
            FROM {view} GROUP BY {g}""" for f, (view, g, x, y, s) in FAMILIES.items())


_DOMAIN_WORDS = {
    "real_estate": ["price", "sqft", "bedroom", "bath", "zipcode", "neighborhood", "lot", "property"],
    "healthcare": ["patient", "diagnosis", "blood", "cholesterol", "heart", "treatment", "bmi"],
    "business": ["revenue", "profit", "sales", "cost", "margin", "customer", "churn"]}


def _confidence_ctes():
    cols = ", ".join(f"('{f}', '{c}')" for f, (_, g, x, y, s) in FAMILIES.items() for c in (g, s, x, y))
    words = ", ".join(f"('{d}', '{w}')" for d, ws in _DOMAIN_WORDS.items() for w in ws)
    return f"""ti AS ({_topimp_sql()}), fcol(family, col) AS (VALUES {cols}), kw(domain, keyword) AS (VALUES {words}),
  score AS (SELECT family, domain, count(DISTINCT CASE WHEN contains(lower(col), keyword) THEN keyword END) AS n FROM fcol JOIN kw ON true GROUP BY ALL),
  dom AS (SELECT family, CASE WHEN max(n) = 0 THEN 0.35 ELSE round(least(1.0, 0.25 + 0.15 * max(n)), 2) END AS dconf FROM score GROUP BY family),
  nr AS (SELECT family, segment, count(*) AS n FROM recs GROUP BY ALL),
  ci AS (SELECT m.family, m.segment, CASE WHEN data_quality_score = 0 THEN 50 ELSE data_quality_score END / 100.0 AS dqn,
           least(1.0, r2_score + 0.3) AS mp, coalesce(ti.top_imp, 0.3) AS rel, dom.dconf, CASE WHEN coalesce(nr.n, 0) > 0 THEN 0.9 ELSE 0.5 END AS act
         FROM mixed m JOIN dom ON dom.family = m.family LEFT JOIN ti ON m.family = ti.family AND m.segment = ti.segment
         LEFT JOIN nr ON nr.family = m.family AND nr.segment = m.segment),
  cp AS (SELECT *, least(1, greatest(0, 0.55 + 0.25 * dqn + 0.20 * rel)) AS f0, least(1, greatest(0, 0.60 * mp + 0.40 * dqn)) AS r0 FROM ci),
  conf AS (SELECT family, segment, dconf, act, round(f0, 2) AS finding, round(r0, 2) AS reliability,
             round(least(1, greatest(0, 0.30 * f0 + 0.30 * r0 + 0.20 * dconf + 0.20 * act)), 2) AS overall FROM cp)"""


CONFIDENCE = REC_SQL + ", " + _confidence_ctes()


def _lint_sql_ctes():
    kw_cases = []
    for dec, kws in RC.ALLOWED_ACTION_KEYWORDS.items():
        pat = r"(^|[^a-z0-9_])(" + "|".join(k.lower().replace("-", r"\-") for k in kws) + r")($|[^a-z0-9_])"
        kw_cases.append(f"WHEN r.decision = '{dec}' THEN regexp_matches(lower(trim(r.action)), '{pat}')")
    match = "CASE " + " ".join(kw_cases) + " ELSE true END"
    return REC_SQL + f""",
  lr AS (SELECT r.*, lower(trim(r.action)) AS k, {match} AS ok,
                row_number() OVER (PARTITION BY family, segment, lower(trim(r.action)) ORDER BY seq) AS rn FROM recs r),
  ls AS (SELECT *, CASE WHEN k = '' THEN 'empty' WHEN NOT ok THEN 'mismatch' WHEN rn > 1 THEN 'duplicate' ELSE 'kept' END AS status FROM lr),
  kept AS (SELECT family, segment, seq, priority, trim(action) AS action, false AS fallback FROM ls WHERE status = 'kept'),
  fb AS (SELECT d.family, d.segment, 0 AS seq, d.severity AS priority, 'Execute primary remediation for ' || d.decision AS action,
                true AS fallback
         FROM dec d WHERE d.decision <> 'UNKNOWN' AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.family = d.family AND k.segment = d.segment))"""


@register("lint", _lint_sql_ctes() + """ SELECT family, segment, CAST(seq AS INTEGER) AS seq, priority, action, fallback FROM kept
  UNION ALL SELECT family, segment, CAST(seq AS INTEGER), priority, action, fallback FROM fb""")
def q_lint(spark, sf):
    dec, recs = mixed_recs(spark, sf)
    validated, _ = RC.lint(dec, recs, KEYS)
    return validated.select(*KEYS, "seq", "priority", "action", "fallback")


@register("lint_report", _lint_sql_ctes() + """,
  cnt AS (SELECT family, segment, count(*) FILTER (WHERE status = 'mismatch') AS n_mismatch, count(*) FILTER (WHERE status <> 'kept') AS n_removed
          FROM ls GROUP BY family, segment)
  SELECT d.family, d.segment, d.decision,
         NOT ((d.decision = 'MULTICOLLINEARITY' AND d.r2_score < 0.10) OR (d.decision = 'WEAK_SIGNAL' AND d.r2_score >= 0.10 AND d.best_improvement >= 0.05)) AS decision_priority_consistent,
         d.best_improvement >= 0.05 AS improvement_is_meaningful,
         coalesce(c.n_mismatch, 0) = 0 AS recommendations_match_decision,
         true AS no_conflicting_priorities, true AS summary_aligned_with_decision, true AS all_recommendations_have_evidence,
         CAST((d.decision = 'MULTICOLLINEARITY' AND d.r2_score < 0.10) AS INTEGER)
           + CAST((d.decision = 'WEAK_SIGNAL' AND d.r2_score >= 0.10 AND d.best_improvement >= 0.05) AS INTEGER)
           + CAST(d.best_improvement < 0.05 AS INTEGER) AS flag_count,
         CAST(coalesce(c.n_removed, 0) + (SELECT count(*) FROM fb WHERE fb.family = d.family AND fb.segment = d.segment) AS BIGINT) AS correction_count
  FROM dec d LEFT JOIN cnt c ON d.family = c.family AND d.segment = c.segment""")
def q_lint_report(spark, sf):
    dec, recs = mixed_recs(spark, sf)
    _, report = RC.lint(dec, recs, KEYS)
    return report


@register("top_actions", _lint_sql_ctes() + """,
  v AS (SELECT family, segment, seq, priority, action FROM kept UNION ALL SELECT family, segment, seq, priority, action FROM fb),
  o AS (SELECT *, row_number() OVER (PARTITION BY family, segment ORDER BY
          CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 99 END, seq) AS position FROM v)
  SELECT family, segment, CAST(seq AS INTEGER) AS seq, priority, action, CAST(position AS INTEGER) AS position FROM o WHERE position <= 3""")
def q_top_actions(spark, sf):
    dec, recs = mixed_recs(spark, sf)
    validated, _ = RC.lint(dec, recs, KEYS)
    return RC.top_actions(validated, KEYS).select(*KEYS, "seq", "priority", "action", "position")


def _insight_ctx(spark, sf):
    """Per segment: raw R^2, target, strongest feature, best improvement, high-corr pair and null-column count."""
    out = None
    for fam, (view, g, x, y, s) in FAMILIES.items():
        t = family_tables(spark, sf, fam)
        from tabscope.operators.correlation import corr_long
        from tabscope.operators.linear import strongest_feature
        from tabscope.operators.profile import null_counts
        src = _source(spark, sf, view).select(g, x, y)
        corr = corr_long(src, [x, y], [g])
        nulls = null_counts(src, [g]).groupBy(g).agg(F.count_if(F.col("n_missing") > 0).alias("n_null_columns"))
        strongest = strongest_feature(t["analysis"], [g]).select(g, "strongest_feature")
        hp = corr.where(F.abs("r") > 0.75).select(g, F.col("feature_a").alias("pair_a"), F.col("feature_b").alias("pair_b"),
                                                  F.col("r").alias("pair_r"))
        ana = t["analysis"].select(g, "r2")
        ev = t["evidence"].select(g, "best_improvement")
        c = ana.join(ev, g).join(hp, g, "left").join(nulls, g, "left").join(strongest, g, "left").select(
            F.lit(fam).alias("family"), F.col(g).cast("string").alias("segment"), "r2", F.lit(y).alias("target"),
            "strongest_feature", "best_improvement",
            F.when(F.col("pair_a").isNotNull(), 1).otherwise(0).alias("n_high_pairs"), "pair_a", "pair_b", "pair_r",
            F.coalesce("n_null_columns", F.lit(0)).alias("n_null_columns"))
        out = c if out is None else out.unionByName(c)
    return out


def _insights_sql():
    parts = []
    for f, (view, g, x, y, s) in FAMILIES.items():
        parts.append(f"""SELECT '{f}' AS family, CAST(e.seg AS VARCHAR) AS segment, e.r2_raw AS r2, e.r_raw AS r,
              e.best_improvement, '{y}' AS target, '{x}' AS feat, '{x}' AS pa, '{y}' AS pb, n.nulls FROM {f}ev e
            JOIN (SELECT {g} AS seg, CASE WHEN count({x}) < count(*) THEN 1 ELSE 0 END + CASE WHEN count({y}) < count(*) THEN 1 ELSE 0 END AS nulls
                  FROM {view} GROUP BY {g}) n ON n.seg = e.seg""")
    note = ("CASE WHEN best_improvement >= 0.05 THEN printf('Best experiment improvement: +%.1f%% (meaningful)', best_improvement * 100) "
            "ELSE printf('Best experiment improvement: +%.1f%% (below 5%% threshold → negligible; no tested method materially helps)', "
            "best_improvement * 100) END")
    content1 = ("(CASE WHEN r2 < 0 THEN printf('Model performs worse than baseline (R²=%.3f). ', r2) ELSE '' END) || "
                "printf('Model explains only %.1f%% of %s variance (%s strongest), leaving %.1f%% unexplained. ', r2 * 100, target, feat, 100 - r2 * 100) || "
                + note + " || '.'")
    acts = lambda a, b: f"array_to_string(list_slice(acts, {a}, {b}), ' | ')"
    return CONFIDENCE + ", ctx0 AS (" + " UNION ALL ".join(parts) + f"""),
      al AS (SELECT family, segment, list(action ORDER BY seq) AS acts FROM recs GROUP BY ALL),
      ctx AS (SELECT c.*, al.acts, f.overall FROM ctx0 c JOIN al ON al.family = c.family AND al.segment = c.segment
              JOIN conf f ON f.family = c.family AND f.segment = c.segment)
      SELECT family, segment, 1 AS rank, CASE WHEN r2 < 0.3 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity,
             'MODEL_PERFORMANCE' AS category, {content1} AS content, 'Feature set insufficient for robust prediction.' AS root_cause,
             {r6('overall')} AS confidence, {acts(1, 3)} AS actions FROM ctx
      UNION ALL
      SELECT family, segment, 2, 'HIGH', 'MULTICOLLINEARITY',
             printf('Detected redundant feature pair: %s ↔ %s (r=%.2f). May cause unstable coefficient attribution.', pa, pb, r),
             'Feature redundancy detected; not primary cause of low R².', {r6('0.85')}, {acts(2, 3)}
      FROM ctx WHERE abs(r) > 0.75
      UNION ALL
      SELECT family, segment, 3, 'MEDIUM', 'DATA_QUALITY', printf('Detected %d data quality issue(s). Address before advanced modeling.', nulls),
             'Data defects can limit model performance.', {r6('0.7')}, {acts(3, 4)}
      FROM ctx WHERE nulls > 0"""


def mixed_confidence(spark, sf):
    """CNF1 of every segment, from its quality, fit, importance, the domain that its column names tell, and its recommendations."""
    from tabscope.operators.linear import strongest_feature
    ev = mixed_evidence(spark, sf)
    imp, sources = None, {}
    for fam, (view, g, x, y, s) in FAMILIES.items():
        i = strongest_feature(family_tables(spark, sf, fam)["analysis"], [g])
        i = i.select(F.lit(fam).alias("family"), F.col(g).cast("string").alias("segment"), F.col("top_importance").alias("top_imp"))
        imp = i if imp is None else imp.unionByName(i)
        sources[fam] = _source(spark, sf, view).select(g, s, x, y)
    domain = infer_domain(column_catalog(spark, sources)).select(F.col("dataset").alias("family"), F.col("confidence").alias("domain_confidence"))
    acts = RC.action_lists(mixed_recs(spark, sf)[1], KEYS)
    j = ev.join(imp, KEYS, "left").join(domain, "family", "left").join(acts, KEYS, "left")
    ins = RU.confidence_inputs(F.col("data_quality_score"), F.col("r2_score"), F.col("top_imp"), F.col("domain_confidence"), F.col("n_recs"))
    return j.select(*KEYS, "actions", *RU.weighted_confidence(*ins))


@register("insights", _insights_sql())
def q_insights(spark, sf):
    more = mixed_confidence(spark, sf).select(*KEYS, "actions", F.col("overall").alias("confidence"))
    out = RC.insights(_insight_ctx(spark, sf).join(more, KEYS, "left"), KEYS)
    return rnd(out.withColumn("actions", F.array_join("actions", " | ")))


@register("output_checks", MIXED + """ SELECT family, segment, true AS r2_finite, true AS strongest_matches_rank1, true AS insights_unique FROM mixed""")
def q_output_checks(spark, sf):
    ctx = _insight_ctx(spark, sf)
    ins = RC.insights(ctx, KEYS)
    top = ctx.select(*KEYS, "r2", "strongest_feature", F.col("strongest_feature").alias("rank1_feature"))
    # rank-1 standardized importance per segment from the fitted models
    rank1 = None
    from tabscope.operators.linear import importance
    for fam, (view, g, x, y, s) in FAMILIES.items():
        imp = importance(family_tables(spark, sf, fam)["analysis"], [g]).where((F.col("kind") == "standardized") & (F.col("rank") == 1))
        r = imp.select(F.lit(fam).alias("family"), F.col(g).cast("string").alias("segment"), F.col("feature").alias("rank1"))
        rank1 = r if rank1 is None else rank1.unionByName(r)
    top = top.drop("rank1_feature").join(rank1, KEYS, "left").withColumnRenamed("rank1", "rank1_feature")
    return RC.output_checks(top, ins, KEYS)


@register("confidence", CONFIDENCE + f"""
  SELECT family, segment, {r6('finding')} AS finding, {r6('reliability')} AS reliability, {r6('dconf')} AS domain, {r6('act')} AS actionable, {r6('overall')} AS overall FROM conf""")
def q_confidence(spark, sf):
    return rnd(mixed_confidence(spark, sf).drop("confidence_label", "actions"))


@register("confidence_legacy", DEC_SQL + f"""
  SELECT d.family, d.segment, {r6('round(least(1, greatest(0, m.data_quality_score / 100.0)), 2)')} AS data,
         {r6("CASE feature_strength WHEN 'weak' THEN 0.35 WHEN 'moderate' THEN 0.65 WHEN 'strong' THEN 0.85 ELSE 0.5 END")} AS diagnosis,
         {r6('round(least(1, greatest(0, d.confidence)), 2)')} AS verdict,
         {r6("round(least(1, greatest(0, 0.4 * least(1, greatest(0, m.data_quality_score / 100.0)) + 0.35 * CASE feature_strength WHEN 'weak' THEN 0.35 WHEN 'moderate' THEN 0.65 WHEN 'strong' THEN 0.85 ELSE 0.5 END + 0.25 * least(1, greatest(0, d.confidence)))), 2)")} AS overall
  FROM dec d JOIN mixed m ON d.family = m.family AND d.segment = m.segment""")
def q_confidence_legacy(spark, sf):
    ev = mixed_evidence(spark, sf)
    dec = RU.decision_table(ev, KEYS).join(ev.select(*KEYS, "data_quality_score"), KEYS)
    return rnd(dec.select(*KEYS, *RU.legacy_confidence(F.col("data_quality_score"), F.col("feature_strength"), F.col("confidence"))))


_RISK_SQL = DEC_SQL + """,
  rb AS (SELECT d.family, d.segment, CASE upper(d.severity) WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 2 END AS base,
                m.r2_score, m.missing_percentage, CAST(m.weak_feature_pct AS DOUBLE) AS weak, CAST(m.redundant_pairs_count AS DOUBLE) AS red
         FROM dec d JOIN mixed m ON d.family = m.family AND d.segment = m.segment),
  ri AS (SELECT family, segment, 0 AS seq, 'Model Reliability Risk' AS name,
                CASE WHEN greatest(0, 1 - r2_score) >= 0.75 THEN 4 WHEN greatest(0, 1 - r2_score) >= 0.5 THEN 3 WHEN greatest(0, 1 - r2_score) >= 0.25 THEN 2 ELSE 1 END AS likelihood,
                greatest(base, 2) AS impact FROM rb
         UNION ALL SELECT family, segment, 1, 'Data Quality Risk',
                CASE WHEN missing_percentage >= 15 THEN 4 WHEN missing_percentage >= 8 THEN 3 WHEN missing_percentage >= 2 THEN 2 ELSE 1 END,
                greatest(base - 1, 1) FROM rb
         UNION ALL SELECT family, segment, 2, 'Feature Signal Risk',
                CASE WHEN weak >= 80 THEN 4 WHEN weak >= 60 THEN 3 WHEN weak >= 30 THEN 2 ELSE 1 END, base FROM rb
         UNION ALL SELECT family, segment, 3, 'Redundancy Risk',
                CASE WHEN red >= 6 THEN 4 WHEN red >= 3 THEN 3 WHEN red >= 1 THEN 2 ELSE 1 END, greatest(base - 1, 1) FROM rb)"""


def mixed_risk(spark, sf):
    ev = mixed_evidence(spark, sf)
    dec = RU.decision_table(ev, KEYS).select(*KEYS, "severity")
    return RU.risk_items(ev.join(dec, KEYS), KEYS)


@register("risk_items", _RISK_SQL + """ SELECT family, segment, seq, name, likelihood, impact, likelihood * impact AS score FROM ri""")
def q_risk_items(spark, sf):
    return mixed_risk(spark, sf)


@register("risk_matrix", _RISK_SQL + """,
  g AS (SELECT DISTINCT family, segment FROM ri), imp AS (SELECT * FROM range(1, 5) t(impact))
  SELECT g.family, g.segment, CAST(imp.impact AS INTEGER) AS impact,
         CAST(count(*) FILTER (WHERE ri.likelihood = 1) AS BIGINT) AS l1, CAST(count(*) FILTER (WHERE ri.likelihood = 2) AS BIGINT) AS l2,
         CAST(count(*) FILTER (WHERE ri.likelihood = 3) AS BIGINT) AS l3, CAST(count(*) FILTER (WHERE ri.likelihood = 4) AS BIGINT) AS l4
  FROM g JOIN imp ON true LEFT JOIN ri ON ri.family = g.family AND ri.segment = g.segment AND ri.impact = imp.impact
  GROUP BY ALL""")
def q_risk_matrix(spark, sf):
    return RU.risk_matrix(mixed_risk(spark, sf), KEYS)


@register("risk_summary", _RISK_SQL + """,
  rk AS (SELECT *, likelihood * impact AS score,
           row_number() OVER (PARTITION BY family, segment ORDER BY likelihood * impact DESC, impact DESC, likelihood DESC, seq) AS r FROM ri)
  SELECT family, segment, score AS overall_risk_score,
         CASE WHEN score >= 12 THEN 'CRITICAL' WHEN score >= 8 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS overall_risk_band,
         name AS highest_risk FROM rk WHERE r = 1""")
def q_risk_summary(spark, sf):
    return RU.risk_summary(mixed_risk(spark, sf), KEYS)


@register("financial", REC_SQL + f""",
  nr AS (SELECT family, segment, count(*) AS n FROM recs GROUP BY ALL),
  f AS (SELECT m.family, m.segment,
               0.08 * greatest(0, 1 - m.r2_score) + 0.05 * greatest(0, (70 - m.data_quality_score) / 70) AS ratio,
               1 + greatest(0, m.weak_feature_pct) / 100.0 AS wf, 18000.0 + nr.n * 2500.0 AS cost
        FROM mixed m JOIN nr ON m.family = nr.family AND m.segment = nr.segment),
  g AS (SELECT *, greatest(0, 5760000.0 * ratio * wf) AS avoid FROM f)
  SELECT family, segment, {r6('5760000.0')} AS annual_value_at_stake, {r6('round(avoid, 2)')} AS estimated_avoidable_loss,
         {r6('round(cost, 2)')} AS implementation_cost, {r6('round(avoid - cost, 2)')} AS net_benefit,
         {r6('round(CASE WHEN cost > 0 THEN (avoid - cost) / cost * 100 ELSE 0 END, 2)')} AS roi_percent,
         CASE WHEN avoid / 12 > 0 THEN {r6('round(cost / (avoid / 12), 2)')} END AS break_even_months
  FROM g""")
def q_financial(spark, sf):
    dec, recs = mixed_recs(spark, sf)
    n = recs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_recs"))
    ev = mixed_evidence(spark, sf).join(n, KEYS)
    return rnd(RU.financial(ev, F.col("n_recs"), KEYS))


@register("interpretation", DEC_SQL + """
  SELECT family, segment,
    CASE WHEN r2_score < 0.3 AND feature_strength = 'weak' THEN 'Model is limited by weak features, not model choice. Add better predictors.'
         WHEN r2_score < 0.3 AND feature_strength IN ('moderate', 'strong') THEN 'Features are adequate but model cannot capture relationships. Try non-linear models.'
         WHEN r2_score >= 0.5 THEN 'Model performs well. Focus on feature engineering for marginal gains.'
         ELSE 'Model shows acceptable performance. Investigate specific failure patterns.' END AS model_interpretation,
    r2_score < 0.3 AND feature_strength = 'weak' AS is_data_limited,
    r2_score < 0.3 AND feature_strength IN ('moderate', 'strong') AS is_model_limited
  FROM dec""")
def q_interpretation(spark, sf):
    dec = mixed_decisions(spark, sf)
    return dec.select(*KEYS, *RU.interpretation(F.col("r2_score"), F.col("feature_strength")))


@register("model_rank", O.with_views("v_nonlin") + ", " + O.family_evidence_ctes("N", *FAMILIES["N"]) + f""",
  mm AS (SELECT seg, 'Linear Regression' AS name, 0 AS o, 1 - sse1 / sst AS r2 FROM Nte
         UNION ALL SELECT seg, 'Polynomial Regression', 1, 1 - sse2 / sst FROM Nte),
  rk AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY r2 DESC, o) AS r FROM mm)
  SELECT seg AS l_suppkey, name, {r6('round(r2, 3)')} AS r2_score,
         CASE WHEN r = 1 THEN 'BEST - Recommended' WHEN r2 < 0.3 THEN 'BASELINE - Too weak' ELSE 'GOOD - Use if speed matters' END AS recommendation
  FROM rk""")
def q_model_rank(spark, sf):
    m = family_tables(spark, sf, "N")["models"]
    return rnd(m.select("l_suppkey", "name", "r2_score", "recommendation"))


def _catalog(spark, sf):
    return column_catalog(spark, {t: read_table(spark, sf, t) for t in TABLES})


def _catalog_sql(kw):
    rows = []
    for d, words in kw.items():
        for w in words:
            rows.append(f"('{d}', {['real_estate', 'healthcare', 'business'].index(d)}, '{w}')")
    names = ", ".join(f"'{t}'" for t in TABLES)
    return f"""WITH cat AS (SELECT table_name AS dataset, column_name AS col FROM information_schema.columns
                         WHERE table_name IN ({names})),
      kw(domain, o, keyword) AS (VALUES {', '.join(rows)}),
      ds AS (SELECT DISTINCT dataset FROM cat), doms AS (SELECT DISTINCT domain, o FROM kw),
      sc AS (SELECT ds.dataset, doms.domain, doms.o,
                    (SELECT count(DISTINCT keyword) FROM cat JOIN kw ON contains(lower(cat.col), kw.keyword)
                     WHERE cat.dataset = ds.dataset AND kw.domain = doms.domain) AS score FROM ds, doms),
      best AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, o) AS r FROM sc)"""


@register("domain_catalog", _catalog_sql({
    "real_estate": ["price", "sqft", "bedroom", "bath", "zipcode", "neighborhood", "lot", "property"],
    "healthcare": ["patient", "diagnosis", "blood", "cholesterol", "heart", "treatment", "bmi"],
    "business": ["revenue", "profit", "sales", "cost", "margin", "customer", "churn"]}) + f"""
  SELECT dataset, CASE WHEN score > 0 THEN domain ELSE 'generic' END AS domain, CAST(score AS INTEGER) AS score,
         {r6("CASE WHEN score > 0 THEN round(least(1.0, 0.25 + score * 0.15), 2) ELSE 0.35 END")} AS confidence,
         CASE WHEN score > 0 THEN 1 ELSE 0 END AS n_reasons
  FROM best WHERE r = 1""")
def q_domain_catalog(spark, sf):
    return rnd(infer_domain(_catalog(spark, sf)))


@register("context_catalog", _catalog_sql({
    "real_estate": ["price", "sqft", "bedroom", "bath", "zipcode", "neighborhood", "lot", "renovation"],
    "healthcare": ["age", "blood", "pressure", "diagnosis", "patient", "heart", "cholesterol"],
    "business": ["revenue", "profit", "cost", "margin", "expense", "sales", "customer"]}) + """
  SELECT dataset, CASE WHEN score > 0 THEN domain ELSE 'generic' END AS domain, CAST(score AS INTEGER) AS score,
         CASE WHEN score >= 4 THEN 'HIGH' WHEN score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
         CASE WHEN score = 0 THEN 'Generic tabular analytics dataset' WHEN domain = 'real_estate' THEN 'Housing price prediction dataset'
              WHEN domain = 'healthcare' THEN 'Healthcare outcomes analysis dataset' ELSE 'Business performance analytics dataset' END AS context
  FROM best WHERE r = 1""")
def q_context_catalog(spark, sf):
    return infer_context(_catalog(spark, sf)).drop("likely_features", "problem_type")
