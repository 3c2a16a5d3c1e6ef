"""Registered queries over hard inputs: null and all-null segments, infinities, and evidence that meets every rule.

``v_hard`` is lineitem with a segment column that is null for some suppliers, a segment whose measure is always
null, and infinities in one segment.  ``v_rules`` gives each customer an evidence row, so that every branch of the
decision table, every recommendation and the row without evidence occur.  The rule rows of the oracles below are
written out by hand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.operators import correlation as C
from tabscope.operators import linear as L
from tabscope.operators import prepare, profile, quality
from tabscope.plans import oracle_sql as O
from tabscope.plans import recommend as RC
from tabscope.plans import rules as RU
from tabscope.plans.catalog import column_catalog, infer_context, infer_domain
from tabscope.plans.common import rnd
from tabscope.plans.oracle_sql import r6
from tabscope.plans.registry import register
from tabscope.sources import fixtures
from tabscope.sources.tables import read_table

HARD = {
    "seg": "CASE WHEN l_suppkey % 10 = 0 THEN NULL WHEN l_suppkey % 10 = 1 THEN 'empty' ELSE concat('s', CAST(l_suppkey % 4 AS VARCHAR(9))) END",
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "a": "CASE WHEN l_suppkey % 10 = 1 OR l_orderkey % 23 = 0 THEN NULL ELSE l_quantity END",
    "b": "CASE WHEN l_orderkey % 101 = 0 AND l_suppkey % 4 = 2 THEN CAST('Infinity' AS DOUBLE) "
         "WHEN l_orderkey % 103 = 0 AND l_suppkey % 4 = 2 THEN CAST('-Infinity' AS DOUBLE) ELSE l_extendedprice END",
    "d": "l_discount",
    "e": "l_tax",
    "f": "l_quantity * l_discount",
}
HARD_SQL = "v_hard AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in HARD.items()) + " FROM lineitem)"


def v_hard(spark, sf):
    return read_table(spark, sf, "lineitem").selectExpr(*[f"{x} AS {n}" for n, x in HARD.items()])


@register("hard_numeric_summary", "WITH " + HARD_SQL + " UNION ALL ".join(
    f"""SELECT seg, '{c}' AS "column", {r6(f'avg({c})')} AS mean, {r6(f'quantile_cont({c}, 0.5)')} AS median, {r6(f'coalesce(stddev_samp({c}), 0)')} AS std_dev,
        {r6(f'quantile_cont({c}, 0.25)')} AS q1, {r6(f'quantile_cont({c}, 0.75)')} AS q3 FROM v_hard WHERE {c} IS NOT NULL GROUP BY seg""" for c in ("a", "d")))
def q_hard_numeric_summary(spark, sf):
    return rnd(profile.numeric_summary(v_hard(spark, sf).select("seg", "a", "d"), by=["seg"]))


@register("hard_quality", "WITH " + HARD_SQL + "," + O.quality_parts_ctes("v_hard", ["a", "b", "d"], ["a", "b", "d"], [], ["seg"]) + O.quality_score_select(["seg"]))
def q_hard_quality(spark, sf):
    return quality.quality_score(v_hard(spark, sf).select("seg", "a", "b", "d"), by=["seg"])


@register("hard_impute", "WITH " + HARD_SQL + f""", m AS (SELECT seg, quantile_cont(a, 0.5) AS ma FROM v_hard GROUP BY seg)
  SELECT v.seg, v.l_orderkey, v.l_linenumber, {r6('coalesce(v.a, m.ma, 0)')} AS a FROM v_hard v JOIN m ON v.seg IS NOT DISTINCT FROM m.seg""")
def q_hard_impute(spark, sf):
    return rnd(prepare.impute_median(v_hard(spark, sf).select("seg", "l_orderkey", "l_linenumber", "a"), ["a"], by=["seg"]))


def _corr_sql(cols):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols[i + 1:], i + 1):
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            fa, fb = (f"CASE WHEN isfinite({c}) THEN {c} END" for c in (a, b))
            inf = f"coalesce(bool_or(({both}) AND NOT (isfinite({a}) AND isfinite({b}))), false)"
            parts.append(f"SELECT seg, {i} AS i, {j} AS j, '{a}' AS feature_a, '{b}' AS feature_b, CAST(count(*) FILTER (WHERE {both}) AS BIGINT) AS n, "
                         f"CASE WHEN {inf} OR isnan(corr({fa}, {fb})) THEN NULL ELSE {r6(f'corr({fa}, {fb})')} END AS r FROM v_hard GROUP BY seg")
    return "WITH " + HARD_SQL + " UNION ALL ".join(parts)


@register("hard_corr_three", _corr_sql(["a", "b", "d"]))
def q_hard_corr_three(spark, sf):
    """The JVM kernel."""
    return rnd(C.corr_long(v_hard(spark, sf), ["a", "b", "d"], by=["seg"]))


@register("hard_corr_five", _corr_sql(["a", "b", "d", "e", "f"]))
def q_hard_corr_five(spark, sf):
    """The blocked kernel, same rule."""
    return rnd(C.corr_long(v_hard(spark, sf), ["a", "b", "d", "e", "f"], by=["seg"]))


@register("hard_vif", "WITH " + HARD_SQL + f""", c AS (SELECT corr(b, d) AS r FROM v_hard WHERE isfinite(b))
  SELECT 'b' AS feature, 'std' AS basis, {r6('1 / (1 - r * r)')} AS vif FROM c UNION ALL SELECT 'd', 'std', {r6('1 / (1 - r * r)')} FROM c""")
def q_hard_vif(spark, sf):
    return rnd(L.vif(v_hard(spark, sf), ["b", "d"]))


@register("ols_encoded", O.with_views("v_defect") + f""", t AS (SELECT flag, avg(discount) AS m FROM v_defect WHERE l_orderkey % 5 <> 0 GROUP BY flag),
  s AS (SELECT v.discount AS y, t.m AS p, avg(v.discount) OVER () AS my FROM v_defect v JOIN t ON v.flag = t.flag WHERE l_orderkey % 5 = 0),
  r AS (SELECT 1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my)) AS r2, sqrt(avg((y - p) * (y - p))) AS rmse FROM s)
  SELECT (SELECT count(*) FROM v_defect WHERE l_orderkey % 5 <> 0) AS n_train, (SELECT count(*) FROM s) AS n_test, {r6('r2')} AS r2, {r6('rmse')} AS rmse,
    CASE WHEN r2 < 0.2 THEN 'critical' WHEN r2 < 0.5 THEN 'warning' ELSE 'ok' END AS severity FROM r""")
def q_ols_encoded(spark, sf):
    """REG1 on a string feature: least squares on indicators predicts the training mean of each category."""
    ana = L.linear_analysis(fixtures.v_defect(spark, sf), ["flag"], "discount", prepare.split_flag("l_orderkey", method="mod"))
    return rnd(L.ols_holdout(ana))


def _catalog_inputs(spark, sf):
    """Three datasets with a target each: their columns, kinds of target, and numbers of high-correlation pairs."""
    sales = fixtures.v_sales(spark, sf)
    part, orders = read_table(spark, sf, "part"), read_table(spark, sf, "orders")
    parts = [("sales", sales, "l_extendedprice", ["l_quantity", "l_extendedprice", "net", "gross"]), ("part", part, "p_size", ["p_size", "p_retailprice"]),
             ("orders", orders, "o_totalprice", ["o_orderkey", "o_totalprice"])]
    kinds = pairs = None
    for name, df, target, numeric in parts:
        kind = profile.target_type(df, target).select(F.lit(name).alias("dataset"), "target_type")
        high = C.high_corr_pairs(C.corr_long(df, numeric)).agg(F.count(F.lit(1)).alias("n_high_pairs")).select(F.lit(name).alias("dataset"), "n_high_pairs")
        kinds, pairs = (kind, high) if kinds is None else (kinds.unionByName(kind), pairs.unionByName(high))
    return column_catalog(spark, {n: df for n, df, _, _ in parts}), kinds, pairs


_KINDS_SQL = "WITH k AS (" + " UNION ALL ".join(
    f"""SELECT '{n}' AS dataset, CASE WHEN count(DISTINCT {t}) <= 20 OR count(DISTINCT {t}) * 1.0 / count(*) <= 0.05 THEN 'classification' ELSE 'regression' END AS kind
    FROM {tbl}""" for n, t, tbl in (("sales", "l_extendedprice", "lineitem"), ("part", "p_size", "part"), ("orders", "o_totalprice", "orders"))) + ")"


@register("domain_from_data", _KINDS_SQL + f""" SELECT dataset, 'real_estate' AS domain, 1 AS score,
  {r6("CASE kind WHEN 'regression' THEN 0.5 ELSE 0.4 END")} AS confidence, CASE kind WHEN 'regression' THEN 2 ELSE 1 END AS n_reasons FROM k""")
def q_domain_from_data(spark, sf):
    """DOM1 with the kinds of the targets, read from the tables."""
    catalog, kinds, _ = _catalog_inputs(spark, sf)
    return rnd(infer_domain(catalog, kinds))


@register("context_from_data", _KINDS_SQL + """, h AS (SELECT corr(l_extendedprice, l_extendedprice * (1 - l_discount)) > 0.75 AS high FROM lineitem)
  SELECT dataset, 'real_estate' AS domain, CAST(1 + CASE WHEN dataset = 'sales' AND high THEN 1 ELSE 0 END AS INTEGER) AS score,
    CASE WHEN dataset = 'sales' AND high THEN 'MEDIUM' ELSE 'LOW' END AS confidence, 'Housing price prediction dataset' AS context, kind AS problem_type FROM k, h""")
def q_context_from_data(spark, sf):
    """DOM2 with the kinds of the targets and the high-correlation pairs, read from the tables."""
    catalog, kinds, pairs = _catalog_inputs(spark, sf)
    return infer_context(catalog, pairs, kinds).drop("likely_features")


_X = "c_custkey"
RULE_FIELDS = {
    "data_quality_score": f"CAST(CASE {_X} % 8 WHEN 0 THEN 55.5 WHEN 1 THEN 65.5 ELSE 90.5 END AS DOUBLE)",
    "missing_percentage": f"CAST(CASE WHEN {_X} % 8 = 1 AND {_X} % 16 = 1 THEN 25.5 ELSE 2.5 END AS DOUBLE)",
    "redundant_pairs_count": f"CAST(CASE WHEN {_X} % 8 = 3 THEN 3 + {_X} % 9 ELSE {_X} % 2 END AS BIGINT)",
    "max_redundancy_correlation": f"CAST(CASE WHEN {_X} % 8 = 3 THEN 0.95 ELSE 0.5 END AS DOUBLE)",
    "r2_score": f"CAST(CASE {_X} % 8 WHEN 2 THEN 0.064 WHEN 7 THEN 0.75 ELSE 0.125 + ({_X} % 3) * 0.125 END AS DOUBLE)",
    "r2_percentage": f"CAST(CASE {_X} % 8 WHEN 2 THEN 6.5 WHEN 7 THEN 75.0 ELSE 12.5 + ({_X} % 3) * 12.5 END AS DOUBLE)",
    "weak_features": f"CAST({_X} % 5 AS BIGINT)",
    "weak_feature_pct": f"CAST(CASE {_X} % 8 WHEN 4 THEN 80 + {_X} % 20 WHEN 6 THEN 90 WHEN 7 THEN CASE {_X} % 3 WHEN 0 THEN 75 WHEN 1 THEN 55 ELSE 20 END ELSE 40 END AS INT)",
    "strongest_correlation": f"CAST(CASE {_X} % 8 WHEN 4 THEN 0.06 WHEN 6 THEN 0.07 ELSE 0.25 END AS DOUBLE)",
    "total_features": f"CAST(CASE WHEN {_X} % 8 = 6 THEN 2 ELSE 6 END AS BIGINT)",
    "nonlinear_gain": f"CAST(CASE WHEN {_X} % 8 = 5 THEN 0.25 + ({_X} % 4) * 0.125 ELSE 0.03125 END AS DOUBLE)",
    "best_improvement": f"CAST(CASE WHEN {_X} % 16 < 8 THEN 0.03125 ELSE 0.25 END AS DOUBLE)",
    "best_model_r2": f"CAST(CASE {_X} % 8 WHEN 4 THEN 0.125 WHEN 7 THEN NULL ELSE 0.5 END AS DOUBLE)",
    "poor_model_fit": f"{_X} % 8 IN (5, 6)",
}
RULES_SQL = "v_rules AS (SELECT c_custkey AS seg, " + ", ".join(f"CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE {x} END AS {n}" for n, x in RULE_FIELDS.items()) + " FROM customer)"


def v_rules(spark, sf):
    # written once: the rule tables read each field many times
    return read_table(spark, sf, "customer").selectExpr(
        "c_custkey AS seg", *[f"CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE {x} END AS {n}" for n, x in RULE_FIELDS.items()]).checkpoint(eager=True)


DECISIONS = "WITH " + RULES_SQL + """,
  numbered AS (SELECT *, coalesce(best_model_r2, -1.0) AS best,
    CASE WHEN data_quality_score IS NULL THEN 0
         WHEN data_quality_score < 70 OR missing_percentage >= 10 THEN 1
         WHEN r2_score < 0.10 THEN 2
         WHEN redundant_pairs_count >= 3 THEN 3
         WHEN weak_feature_pct >= 80 AND strongest_correlation < 0.12 AND coalesce(best_model_r2, -1.0) < 0.20 THEN 4
         WHEN poor_model_fit AND nonlinear_gain >= 0.15 AND coalesce(best_model_r2, -1.0) >= 0.25 THEN 5
         WHEN total_features < 3 AND poor_model_fit AND weak_feature_pct >= 85 AND strongest_correlation < 0.10 THEN 6
         WHEN weak_feature_pct > 50 OR strongest_correlation < 0.15 THEN 7 ELSE 8 END AS rule FROM v_rules),
  dec AS (SELECT *,
    CASE rule WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'DATA_ISSUE' WHEN 2 THEN 'WEAK_SIGNAL' WHEN 3 THEN 'MULTICOLLINEARITY' WHEN 5 THEN 'NON_LINEARITY'
      WHEN 6 THEN 'FEATURE_GAP' ELSE 'WEAK_FEATURES' END AS decision,
    CASE rule WHEN 0 THEN 'LOW' WHEN 1 THEN CASE WHEN data_quality_score < 60 OR missing_percentage >= 20 THEN 'CRITICAL' ELSE 'HIGH' END
      WHEN 2 THEN 'CRITICAL' WHEN 3 THEN CASE WHEN redundant_pairs_count <= 5 THEN 'HIGH' ELSE 'CRITICAL' END WHEN 4 THEN 'HIGH'
      WHEN 5 THEN CASE WHEN r2_score < 0.2 THEN 'HIGH' ELSE 'MEDIUM' END WHEN 6 THEN 'HIGH'
      WHEN 7 THEN CASE WHEN weak_feature_pct > 70 THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'LOW' END AS severity,
    CASE rule WHEN 0 THEN 'No evidence was provided'
      WHEN 1 THEN printf('Data quality score %.1f/100; missing %.1f%%', data_quality_score, missing_percentage)
      WHEN 2 THEN printf('Model fit is critically low (R²=%.3f); ', r2_score) || CASE WHEN best_improvement < 0.05
        THEN printf('best improvement +%.1f%% is negligible', best_improvement * 100) ELSE printf('best improvement +%.1f%% still leaves very low fit', best_improvement * 100) END
      WHEN 3 THEN printf('%d feature pairs above redundancy threshold (max %.2f)', redundant_pairs_count, max_redundancy_correlation)
      WHEN 5 THEN printf('Linear fit is weak (R²=%.3f); non-linear gain=%.3f', r2_score, nonlinear_gain)
      WHEN 6 THEN printf('Only %d features available with weak fit (R²=%.3f)', total_features, r2_score)
      WHEN 8 THEN 'No critical risk thresholds crossed'
      ELSE printf('%d%% weak features; strongest correlation %.2f', weak_feature_pct, strongest_correlation) END AS dominant_signal,
    CASE rule WHEN 0 THEN 'Run evidence builder before decisioning'
      WHEN 1 THEN printf('R² currently %.3f', r2_score)
      WHEN 2 THEN printf('Strongest predictor correlation %.2f', strongest_correlation) || ' | ' ||
        printf('Redundant pairs observed: %d (max %.2f)', redundant_pairs_count, max_redundancy_correlation)
      WHEN 3 THEN printf('Weak feature percentage %d%%', weak_feature_pct) || ' | ' || printf('Model fit R²=%.3f', r2_score)
      WHEN 4 THEN printf('Best model R²=%.3f', best) || ' | ' || printf('Linear model R²=%.3f', r2_score)
      WHEN 5 THEN printf('Best non-linear model R²=%.3f', best)
      WHEN 6 THEN printf('Weak feature percentage %d%%', weak_feature_pct)
      WHEN 7 THEN printf('Model fit R²=%.3f', r2_score)
      ELSE printf('R²=%.3f', r2_score) || ' | ' || printf('Weak feature percentage %d%%', weak_feature_pct) END AS secondary
    FROM numbered)"""


@register("decisions_every_rule", DECISIONS + " SELECT seg, decision, severity, dominant_signal, secondary AS secondary_signals FROM dec")
def q_decisions_every_rule(spark, sf):
    dec = RU.decision_table(v_rules(spark, sf), ["seg"])
    return dec.select("seg", "decision", "severity", "dominant_signal", F.array_join("secondary_signals", " | ").alias("secondary_signals"))


@register("recommendations_every_rule", DECISIONS + """,
  rows(name, seq, priority, action, said, impact, effort) AS (VALUES
    ('DATA_ISSUE', 0, NULL, 'Fix missing values and schema consistency before retraining', NULL, 'HIGH', 'HIGH'),
    ('DATA_ISSUE', 1, 'HIGH', 'Run data validation checks (nulls, duplicates, outliers)', 'Data defects must be controlled before any model-level change.', 'HIGH', 'MEDIUM'),
    ('MULTICOLLINEARITY', 0, NULL, 'Remove or merge highly correlated feature pairs', NULL, 'HIGH', 'LOW'),
    ('MULTICOLLINEARITY', 1, 'MEDIUM', 'If instability remains after feature pruning, apply PCA or regularization as a secondary step',
     'Dimensionality reduction should follow direct redundancy cleanup, not replace it.', 'MEDIUM', 'MEDIUM'),
    ('WEAK_SIGNAL', 0, NULL, 'Introduce new predictive features aligned with the target outcome', NULL, 'HIGH', 'HIGH'),
    ('WEAK_SIGNAL', 1, 'HIGH', 'Expand feature engineering with interaction and non-linear terms guided by domain knowledge',
     'Current feature set shows weak signal; domain context is ''generic''.', 'HIGH', 'MEDIUM'),
    ('WEAK_SIGNAL', 2, 'HIGH', 'Reassess whether available data is suitable for the prediction target before model tuning',
     'When all tested methods show negligible gain, data relevance is the primary constraint.', 'HIGH', 'MEDIUM'),
    ('NON_LINEARITY', 0, NULL, 'Benchmark tree-based models (Random Forest / Gradient Boosting)', NULL, 'HIGH', 'MEDIUM'),
    ('NON_LINEARITY', 1, 'MEDIUM', 'Add interaction and non-linear transformed features', 'Feature transforms can expose structure missed by linear assumptions.', 'MEDIUM', 'MEDIUM'),
    ('FEATURE_GAP', 0, NULL, 'Collect additional domain variables with direct target relevance', NULL, 'HIGH', 'HIGH'),
    ('FEATURE_GAP', 1, 'HIGH', 'Prioritize data acquisition plan with subject-matter experts', 'Missing explanatory variables limit modeling gains from algorithm tuning.', 'HIGH', 'HIGH'),
    ('other', 0, NULL, 'Perform targeted feature engineering on low-signal predictors', NULL, 'HIGH', 'MEDIUM'),
    ('other', 1, 'MEDIUM', 'Re-assess domain feature coverage and interactions', 'Weak predictive signal indicates current features are not sufficiently informative.', 'MEDIUM', 'MEDIUM'))
  SELECT d.seg, d.decision, CAST(r.seq AS INTEGER) AS seq, coalesce(r.priority, d.severity) AS priority, r.action,
    coalesce(r.said, 'Primary issue identified from evidence. Trigger: ' || d.dominant_signal) AS reason, r.impact, r.effort
  FROM dec d JOIN rows r ON r.name = CASE WHEN d.decision IN ('UNKNOWN', 'WEAK_FEATURES') THEN 'other' ELSE d.decision END""")
def q_recommendations_every_rule(spark, sf):
    return RC.recommendations(RU.decision_table(v_rules(spark, sf), ["seg"]), ["seg"]).drop("evidence")


@register("recommend_legacy_every_rule", "WITH " + RULES_SQL + """,
  c AS (SELECT seg, 'LOW' AS priority, 3 AS rank, 0 AS seq, 'Collect required evidence signals' AS action,
      'Evidence was unavailable, so targeted recommendations could not be generated reliably.' AS reason FROM v_rules WHERE data_quality_score IS NULL
    UNION ALL SELECT seg, 'CRITICAL', 0, 0, 'Add domain-specific features',
      printf('%d%% of features are weak (correlation < 0.15). Strongest predictor is only %.2f. Insufficient signal in current feature set.', weak_feature_pct, strongest_correlation)
      FROM v_rules WHERE weak_feature_pct > 50
    UNION ALL SELECT seg, 'HIGH', 1, 1, 'Remove multicollinear features',
      printf('%d pairs of features show high correlation (max: %.2f). Redundant features distort model coefficients.', redundant_pairs_count, max_redundancy_correlation)
      FROM v_rules WHERE redundant_pairs_count > 2
    UNION ALL SELECT seg, 'HIGH', 1, 2, 'Try non-linear models (Random Forest, Gradient Boosting)',
      printf('Model R² = %.1f%% is poor despite reasonable features. Linear relationships may not capture data patterns.', r2_percentage)
      FROM v_rules WHERE r2_score < 0.3 AND weak_feature_pct <= 50
    UNION ALL SELECT seg, 'CRITICAL', 0, 3, 'Improve data quality - handle missing values',
      printf('Data quality score is only %.1f/100 with %.1f%% missing values. Poor data quality undermines all analysis.', data_quality_score, missing_percentage)
      FROM v_rules WHERE data_quality_score < 70)
  SELECT seg, priority, action, reason, CAST(row_number() OVER (PARTITION BY seg ORDER BY rank, seq) AS INTEGER) AS position FROM c""")
def q_recommend_legacy_every_rule(spark, sf):
    return RC.legacy_recommendations(v_rules(spark, sf), ["seg"]).select("seg", "priority", "action", "reason", "position")


_MATCH = "CASE " + " ".join(
    f"WHEN decision = '{d}' THEN regexp_matches(lower(trim(action)), '(^|[^a-z0-9_])(" + "|".join(k.replace("-", "\\-") for k in kws) + ")($|[^a-z0-9_])')"
    for d, kws in RC.ALLOWED_ACTION_KEYWORDS.items()) + " ELSE true END"


@register("lint_rows", DECISIONS + """,
  first(name, action) AS (VALUES ('DATA_ISSUE', 'Fix missing values and schema consistency before retraining'), ('MULTICOLLINEARITY', 'Remove or merge highly correlated feature pairs'),
    ('WEAK_SIGNAL', 'Introduce new predictive features aligned with the target outcome'), ('NON_LINEARITY', 'Benchmark tree-based models (Random Forest / Gradient Boosting)'),
    ('FEATURE_GAP', 'Collect additional domain variables with direct target relevance'), ('other', 'Perform targeted feature engineering on low-signal predictors')),
  f AS (SELECT d.seg, d.decision, first.action AS a0 FROM dec d JOIN first ON first.name = CASE WHEN d.decision IN ('UNKNOWN', 'WEAK_FEATURES') THEN 'other' ELSE d.decision END),
  given AS (SELECT seg, decision, 0 AS seq, a0 AS action FROM f WHERE seg % 5 <> 0
    UNION ALL SELECT seg, decision, 1, ' ' || upper(a0) FROM f WHERE seg % 3 = 0 UNION ALL SELECT seg, decision, 2, '  ' FROM f WHERE seg % 4 = 0
    UNION ALL SELECT seg, decision, 3, 'Buy a bigger computer' FROM f WHERE seg % 5 = 0),
  told AS (SELECT *, """ + _MATCH + """ AS ok, row_number() OVER (PARTITION BY seg, lower(trim(action)) ORDER BY seq) AS nth FROM given),
  status AS (SELECT *, CASE WHEN trim(action) = '' THEN 'empty' WHEN NOT ok THEN 'mismatch' WHEN nth > 1 THEN 'duplicate' ELSE 'kept' END AS code FROM told),
  m AS (SELECT d.seg, d.decision, coalesce(v.r2_score, 0) AS r2, coalesce(v.best_improvement, 0) AS imp FROM dec d JOIN v_rules v ON v.seg = d.seg)
  SELECT seg, 'flag' AS kind, 'collinear' AS code, CAST(NULL AS INTEGER) AS seq,
    printf('Conflict detected: R²=%.3f is below 0.10, but primary decision is MULTICOLLINEARITY. Expected WEAK_SIGNAL.', r2) AS text FROM m WHERE decision = 'MULTICOLLINEARITY' AND r2 < 0.10
  UNION ALL SELECT seg, 'flag', 'weak_signal', NULL, printf('Conflict detected: WEAK_SIGNAL selected with R²=%.3f and best improvement %.1f%% (not negligible).', r2, imp * 100)
    FROM m WHERE decision = 'WEAK_SIGNAL' AND r2 >= 0.10 AND imp >= 0.05
  UNION ALL SELECT seg, 'flag', 'negligible', NULL, printf('Best observed improvement %.1f%% is below 5%% and should be treated as negligible.', imp * 100) FROM m WHERE imp < 0.05
  UNION ALL SELECT seg, 'correction', code, CAST(seq AS INTEGER), CASE code WHEN 'empty' THEN 'Removed recommendation with empty action.'
      WHEN 'duplicate' THEN 'Removed duplicate recommendation: ' || trim(action) || '.' ELSE 'Removed decision-mismatched recommendation: ' || trim(action) || '.' END
    FROM status WHERE code <> 'kept'
  UNION ALL SELECT seg, 'correction', 'fallback', NULL, 'Inserted fallback recommendation to preserve decision alignment.' FROM dec d
    WHERE decision <> 'UNKNOWN' AND NOT EXISTS (SELECT 1 FROM status s WHERE s.seg = d.seg AND s.code = 'kept')""")
def q_lint_rows(spark, sf):
    """REC3 findings over recommendations that are empty, repeated, off topic or missing, for every decision."""
    dec = RU.decision_table(v_rules(spark, sf), ["seg"]).checkpoint(eager=True)
    own = RC.recommendations(dec, ["seg"]).where("seq = 0").select("seg", "decision", "action", "priority", "reason", "impact", "effort")
    seg = F.col("seg")
    made = F.array(F.when(seg % 5 != 0, F.struct(F.lit(0).alias("seq"), F.col("action"))), F.when(seg % 3 == 0, F.struct(F.lit(1).alias("seq"), F.concat(F.lit(" "), F.upper("action")).alias("action"))),
                   F.when(seg % 4 == 0, F.struct(F.lit(2).alias("seq"), F.lit("  ").alias("action"))), F.when(seg % 5 == 0, F.struct(F.lit(3).alias("seq"), F.lit("Buy a bigger computer").alias("action"))))
    given = own.select("seg", "decision", "priority", "reason", "impact", "effort", F.explode(F.array_compact(made)).alias("r")).select("seg", "decision", "r.*", "priority", "reason", "impact", "effort")
    return RC.lint_rows(dec, given, ["seg"])


@register("output_violations", """
  WITH t AS (SELECT c_custkey AS seg, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN CAST('infinity' AS DOUBLE) WHEN c_custkey % 17 = 0 THEN CAST('nan' AS DOUBLE) ELSE c_acctbal / 20000 END AS r2,
      CASE WHEN c_custkey % 3 = 0 THEN 'age' ELSE 'income' END AS strongest, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'age' ELSE 'income' END AS rank1 FROM customer)
  SELECT seg, 'r2_finite' AS "check", CASE WHEN r2 IS NULL THEN 'null' WHEN isnan(r2) THEN 'NaN' ELSE 'Infinity' END AS offending FROM t WHERE r2 IS NULL OR NOT isfinite(r2)
  UNION ALL SELECT seg, 'strongest_matches_rank1', strongest || ' vs ' || rank1 FROM t WHERE strongest <> rank1
  UNION ALL SELECT seg, 'insights_unique', 'fit ' || CAST(seg % 9 AS VARCHAR) FROM t WHERE seg % 6 = 0""")
def q_output_violations(spark, sf):
    """CHK1 over outputs that break each check in some segments."""
    k = F.col("c_custkey")
    r2 = F.when(k % 5 == 0, F.lit(None).cast("double")).when(k % 7 == 0, F.lit(float("inf"))).when(k % 17 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal") / 20000)
    base = read_table(spark, sf, "customer").select(
        k.alias("seg"), r2.alias("r2"), F.when(k % 3 == 0, "age").otherwise("income").alias("strongest_feature"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 4 == 0, "age").otherwise("income").alias("rank1_feature"))
    text = F.concat(F.lit("fit "), (F.col("seg") % 9).cast("string"))
    ins = base.select("seg", F.explode(F.when(F.col("seg") % 6 == 0, F.array(text, F.lit("other"), text)).otherwise(F.array(text, F.lit("other")))).alias("content"))
    return RC.output_violations(base, ins, ["seg"])


@register("one_hot_clash", """
  WITH t AS (SELECT o_orderstatus AS a, o_orderpriority AS p, o_totalprice AS "a_O", o_custkey AS "A_P" FROM orders)
  SELECT count(*) AS n, round(sum("a_O"), 2) AS kept_o, sum("A_P") AS kept_p, sum(CASE WHEN a = 'O' THEN 1 ELSE 0 END) AS ind_o, sum(CASE WHEN a = 'P' THEN 1 ELSE 0 END) AS ind_p FROM t""")
def q_one_hot_clash(spark, sf):
    """ENC1 where columns have the names that indicators would get."""
    t = read_table(spark, sf, "orders").select(F.col("o_orderstatus").alias("a"), F.col("o_totalprice").alias("a_O"), F.col("o_custkey").alias("A_P"))
    enc = prepare.one_hot(t, ["a"])
    return enc.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("a_O"), 2).alias("kept_o"), F.sum("A_P").alias("kept_p"),
                   F.sum("a_O_enc").alias("ind_o"), F.sum("a_P_enc").alias("ind_p"))
