"""Rules over the evidence table as column expressions (DEC1-DEC4, MOD3, CNF1-CNF2, RSK1, FIN1).

Every function maps a DataFrame with one row per segment to another; the
rules are ``F.when`` chains evaluated inside whole-stage codegen, so they
cost nothing next to the aggregations that produce the evidence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.columns import seg_cols

# Decision-rule thresholds and confidences.
DQ_ISSUE, DQ_CRITICAL = 70, 60
MISS_ISSUE, MISS_CRITICAL = 10, 20
R2_WEAK_SIGNAL = 0.10
MEANINGFUL_IMPROVEMENT = 0.05
RED_PAIRS, RED_HIGH_MAX = 3, 5
BASE_DATA_ISSUE, DATA_ISSUE_BOOST = 0.78, 0.15
BASE_MULTI, MULTI_CAP, MULTI_WEIGHT = 0.74, 8, 0.02
BASE_NONLIN, NONLIN_CAP, NONLIN_WEIGHT = 0.69, 0.5, 0.3
BASE_WEAK, WEAK_CAP, WEAK_DEN = 0.65, 90, 300


def _c(name: str) -> Column:
    return F.col(name)


EVIDENCE_FIELDS = ("data_quality_score", "missing_percentage", "redundant_pairs_count", "max_redundancy_correlation", "r2_score",
                   "weak_feature_pct", "strongest_correlation", "total_features", "nonlinear_gain", "best_improvement",
                   "best_model_r2", "poor_model_fit")


def _clip2(x: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 2)


def _fmt(pattern: str, *cols: Column) -> Column:
    return F.format_string(pattern, *cols)


def decision_table(ev: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """DEC1 + DEC2 + DEC3: decision, severity, confidence, dominant_signal, secondary_signals, the four bands
    and the verdict flags, per evidence row (first matching rule wins).

    A row without any evidence (all fields null) is UNKNOWN; a single missing field counts as 0."""
    by = seg_cols(by)
    absent = F.coalesce(*[F.col(c).cast("string") for c in EVIDENCE_FIELDS]).isNull()
    ev = ev.withColumn("__absent", absent).withColumns(
        {c: F.coalesce(F.col(c), F.lit(0).cast(ev.schema[c].dataType)) for c in EVIDENCE_FIELDS if c not in ("best_model_r2", "poor_model_fit")}
        | {"poor_model_fit": F.coalesce("poor_model_fit", F.lit(False))})
    dq, miss = _c("data_quality_score"), _c("missing_percentage")
    red, maxr = _c("redundant_pairs_count"), _c("max_redundancy_correlation")
    r2, weak = _c("r2_score"), _c("weak_feature_pct")
    strong, total = _c("strongest_correlation"), _c("total_features")
    gain, imp = _c("nonlinear_gain"), _c("best_improvement")
    best = F.coalesce(_c("best_model_r2"), F.lit(-1.0))
    poor = _c("poor_model_fit")

    conds = [
        F.col("__absent"),
        (dq < DQ_ISSUE) | (miss >= MISS_ISSUE),
        r2 < R2_WEAK_SIGNAL,
        red >= RED_PAIRS,
        (weak >= 80) & (strong < 0.12) & (best < 0.20),
        poor & (gain >= 0.15) & (best >= 0.25),
        (total < 3) & poor & (weak >= 85) & (strong < 0.10),
        (weak > 50) | (strong < 0.15),
    ]
    weak_conf = BASE_WEAK + F.least(weak, F.lit(WEAK_CAP)) / WEAK_DEN
    outcomes = [
        ("UNKNOWN", F.lit("LOW"), F.lit(0.35), F.lit("No evidence was provided"), F.array(F.lit("Run evidence builder before decisioning"))),
        ("DATA_ISSUE", F.when((dq < DQ_CRITICAL) | (miss >= MISS_CRITICAL), F.lit("CRITICAL")).otherwise(F.lit("HIGH")),
         BASE_DATA_ISSUE + F.when(dq < DQ_CRITICAL, F.lit(DATA_ISSUE_BOOST)).otherwise(F.lit(0.0)),
         _fmt("Data quality score %.1f/100; missing %.1f%%", dq, miss),
         F.array(_fmt("R² currently %.3f", r2))),
        ("WEAK_SIGNAL", F.lit("CRITICAL"),
         F.when(imp < MEANINGFUL_IMPROVEMENT, F.lit(0.9)).otherwise(F.lit(0.82)),
         F.concat(_fmt("Model fit is critically low (R²=%.3f); ", r2),
                  F.when(imp < MEANINGFUL_IMPROVEMENT, _fmt("best improvement +%.1f%% is negligible", imp * 100))
                  .otherwise(_fmt("best improvement +%.1f%% still leaves very low fit", imp * 100))),
         F.array(_fmt("Strongest predictor correlation %.2f", strong),
                 _fmt("Redundant pairs observed: %d (max %.2f)", red, maxr))),
        ("MULTICOLLINEARITY", F.when(red <= RED_HIGH_MAX, F.lit("HIGH")).otherwise(F.lit("CRITICAL")),
         BASE_MULTI + F.least(red, F.lit(MULTI_CAP)) * MULTI_WEIGHT,
         _fmt("%d feature pairs above redundancy threshold (max %.2f)", red, maxr),
         F.array(_fmt("Weak feature percentage %d%%", weak), _fmt("Model fit R²=%.3f", r2))),
        ("WEAK_FEATURES", F.lit("HIGH"), weak_conf,
         _fmt("%d%% weak features; strongest correlation %.2f", weak, strong),
         F.array(_fmt("Best model R²=%.3f", best), _fmt("Linear model R²=%.3f", r2))),
        ("NON_LINEARITY", F.when(r2 < 0.2, F.lit("HIGH")).otherwise(F.lit("MEDIUM")),
         BASE_NONLIN + F.least(gain, F.lit(NONLIN_CAP)) * NONLIN_WEIGHT,
         _fmt("Linear fit is weak (R²=%.3f); non-linear gain=%.3f", r2, gain),
         F.array(_fmt("Best non-linear model R²=%.3f", best))),
        ("FEATURE_GAP", F.lit("HIGH"), F.lit(0.70),
         _fmt("Only %d features available with weak fit (R²=%.3f)", total, r2),
         F.array(_fmt("Weak feature percentage %d%%", weak))),
        ("WEAK_FEATURES", F.when(weak > 70, F.lit("HIGH")).otherwise(F.lit("MEDIUM")), weak_conf,
         _fmt("%d%% weak features; strongest correlation %.2f", weak, strong),
         F.array(_fmt("Model fit R²=%.3f", r2))),
    ]
    default = ("WEAK_FEATURES", F.lit("LOW"), F.lit(0.55), F.lit("No critical risk thresholds crossed"),
               F.array(_fmt("R²=%.3f", r2), _fmt("Weak feature percentage %d%%", weak)))

    def chain(idx: int, cast=None):
        e = None
        for cond, out in zip(conds, outcomes):
            v = out[idx] if isinstance(out[idx], Column) else F.lit(out[idx])
            e = F.when(cond, v) if e is None else e.when(cond, v)
        d = default[idx] if isinstance(default[idx], Column) else F.lit(default[idx])
        return e.otherwise(d)

    out = ev.select(
        *by,
        chain(0).alias("decision"),
        chain(1).alias("severity"),
        _clip2(chain(2)).alias("confidence"),
        chain(3).alias("dominant_signal"),
        chain(4).alias("secondary_signals"),
        "r2_score", "best_improvement", "redundant_pairs_count",
        *bands(r2, weak, red, dq),
    )
    return with_verdict(out)


def bands(r2: Column, weak: Column, red: Column, dq: Column) -> list[Column]:
    """DEC2: model_perf, feature_strength, multicollinearity and data_quality bands."""
    return [
        F.when(r2 < 0.1, "critical").when(r2 < 0.3, "weak").when(r2 < 0.5, "moderate").otherwise("good").alias("model_perf"),
        F.when(weak > 70, "critical").when(weak > 50, "weak").when(weak > 30, "moderate").otherwise("strong").alias("feature_strength"),
        F.when(red >= 5, "critical").when(red >= 3, "high").otherwise("low").alias("multicollinearity"),
        F.when(dq < 60, "poor").when(dq < 75, "fair").when(dq < 85, "good").otherwise("excellent").alias("data_quality"),
    ]


def diagnose_bands(ev: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """DEC2 (``diagnose``): bands plus evidence_used; all 'unknown' when a required field is null."""
    by = seg_cols(by)
    req = ["r2_score", "weak_feature_pct", "redundant_pairs_count", "data_quality_score"]
    missing = F.lit(False)
    for c in req:
        missing = missing | _c(c).isNull()
    cols = bands(_c("r2_score"), _c("weak_feature_pct"), _c("redundant_pairs_count"), _c("data_quality_score"))
    names = ["model_perf", "feature_strength", "multicollinearity", "data_quality"]
    return ev.select(*by, *[F.when(missing, F.lit("unknown")).otherwise(c).alias(n) for c, n in zip(cols, names)],
                     (~missing).alias("evidence_used"))


def with_verdict(dec: DataFrame) -> DataFrame:
    """DEC3: primary_issue and the data/feature/model problem flags."""
    d = _c("decision")
    return dec.withColumn("primary_issue", F.lower(d)) \
        .withColumn("is_data_problem", d == "DATA_ISSUE") \
        .withColumn("is_feature_problem", d.isin("MULTICOLLINEARITY", "WEAK_FEATURES", "FEATURE_GAP")) \
        .withColumn("is_model_problem", d == "NON_LINEARITY")


def conflicts(dec: DataFrame, dq: Column, by: Sequence[str] = ()) -> DataFrame:
    """DEC4: primary issue by ordered rules over quality and bands, with its confidence."""
    by = seg_cols(by)
    fs, mc, mp = _c("feature_strength"), _c("multicollinearity"), _c("model_perf")
    issue = (F.when(dq < 70, "data_quality").when(fs == "weak", "feature_gap").when(mc.isin("high", "critical"), "multicollinearity")
             .when(fs.isin("moderate", "strong") & (mp == "critical"), "model_mismatch").otherwise("unknown"))
    conf = (F.when(dq < 70, 0.95).when(fs == "weak", 0.9).when(mc.isin("high", "critical"), 0.88)
            .when(fs.isin("moderate", "strong") & (mp == "critical"), 0.8).otherwise(0.5))
    return dec.select(*by, issue.alias("conflict_issue"), conf.alias("conflict_confidence"))


def interpretation(r2: Column, feature_strength: Column) -> list[Column]:
    """MOD3: (model_interpretation, is_data_limited, is_model_limited)."""
    low = r2 < 0.3
    data_lim = low & (feature_strength == "weak")
    model_lim = low & feature_strength.isin("moderate", "strong")
    text = (F.when(data_lim, "Model is limited by weak features, not model choice. Add better predictors.")
            .when(model_lim, "Features are adequate but model cannot capture relationships. Try non-linear models.")
            .when(r2 >= 0.5, "Model performs well. Focus on feature engineering for marginal gains.")
            .otherwise("Model shows acceptable performance. Investigate specific failure patterns."))
    return [text.alias("model_interpretation"), data_lim.alias("is_data_limited"), model_lim.alias("is_model_limited")]


def _clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def weighted_confidence(dq: Column, model: Column, relevance: Column, domain: Column, actionable: Column) -> list[Column]:
    """CNF1: finding, reliability, domain, actionable, overall (rounded 2) and its label."""
    finding = _clamp(0.55 + 0.25 * dq + 0.20 * relevance)
    reliability = _clamp(0.60 * model + 0.40 * dq)
    dom = _clamp(domain)
    act = _clamp(actionable)
    overall = _clamp(0.30 * finding + 0.30 * reliability + 0.20 * dom + 0.20 * act)
    ov = F.round(overall, 2)
    return [F.round(finding, 2).alias("finding"), F.round(reliability, 2).alias("reliability"), F.round(dom, 2).alias("domain"),
            F.round(act, 2).alias("actionable"), ov.alias("overall"),
            F.when(ov >= 0.8, "HIGH").when(ov >= 0.6, "MEDIUM").otherwise("LOW").alias("confidence_label")]


def confidence_inputs(quality_overall: Column, r2: Column, top_importance: Column, domain_conf: Column, n_recs: Column) -> list[Column]:
    """Inputs of CNF1 as the pipeline maps them: dq = score/100 (0.5 if missing or 0), model = min(1, r2 + .3),
    relevance = top standardized importance (0.3 if none), domain (0.5 if none), actionable .9 with recommendations."""
    dq = F.when(quality_overall.isNull() | (quality_overall == 0), F.lit(50.0)).otherwise(quality_overall) / 100
    return [dq, F.least(F.lit(1.0), r2 + 0.3), F.coalesce(top_importance, F.lit(0.3)), F.coalesce(domain_conf, F.lit(0.5)),
            F.when(F.coalesce(n_recs, F.lit(0)) > 0, F.lit(0.9)).otherwise(F.lit(0.5))]


def legacy_confidence(dq_score: Column, feature_strength: Column, verdict_conf: Column) -> list[Column]:
    """CNF2: data, diagnosis, verdict, overall."""
    q = _clamp(dq_score / 100.0)
    f = F.when(feature_strength == "weak", 0.35).when(feature_strength == "moderate", 0.65) \
        .when(feature_strength == "strong", 0.85).otherwise(0.5)
    v = _clamp(F.coalesce(verdict_conf, F.lit(0.5)))
    overall = _clamp(0.4 * q + 0.35 * f + 0.25 * v)
    return [F.round(q, 2).alias("data"), F.round(f, 2).alias("diagnosis"), F.round(v, 2).alias("verdict"), F.round(overall, 2).alias("overall")]


# Risk likelihood thresholds and impact levels.
RISK_THRESHOLDS = {"model": (0.25, 0.5, 0.75), "data": (2.0, 8.0, 15.0), "feature": (30.0, 60.0, 80.0), "redundancy": (1.0, 3.0, 6.0)}
IMPACT_LEVEL = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
RISK_NAMES = ("Model Reliability Risk", "Data Quality Risk", "Feature Signal Risk", "Redundancy Risk")


def _likelihood(v: Column, t) -> Column:
    return F.when(v >= t[2], 4).when(v >= t[1], 3).when(v >= t[0], 2).otherwise(1)


def _risk(seq: int, likelihood: Column, impact: Column) -> Column:
    return F.struct(F.lit(seq).alias("seq"), F.lit(RISK_NAMES[seq]).alias("name"), likelihood.alias("likelihood"), impact.alias("impact"))


def risk_items(ev_dec: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """RSK1: four risks per segment, (by..., seq, name, likelihood, impact, score)."""
    by = seg_cols(by)
    sev = F.upper(F.coalesce(_c("severity"), F.lit("MEDIUM")))
    base = F.lit(2)
    for k, v in IMPACT_LEVEL.items():
        base = F.when(sev == k, F.lit(v)).otherwise(base)
    r2 = F.coalesce(_c("r2_score").cast("double"), F.lit(0.0))
    miss = F.coalesce(_c("missing_percentage").cast("double"), F.lit(0.0))
    weak = F.coalesce(_c("weak_feature_pct").cast("double"), F.lit(0.0))
    red = F.coalesce(_c("redundant_pairs_count").cast("double"), F.lit(0.0))
    items = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit(RISK_NAMES[0]).alias("name"),
                 _likelihood(F.greatest(F.lit(0.0), 1 - r2), RISK_THRESHOLDS["model"]).alias("likelihood"),
                 F.greatest(base, F.lit(2)).alias("impact")),
        _risk(1, _likelihood(miss, RISK_THRESHOLDS["data"]), F.greatest(base - 1, F.lit(1))),
        _risk(2, _likelihood(weak, RISK_THRESHOLDS["feature"]), base),
        _risk(3, _likelihood(red, RISK_THRESHOLDS["redundancy"]), F.greatest(base - 1, F.lit(1))),
    )
    x = ev_dec.select(*by, F.explode(items).alias("r")).select(*by, "r.*")
    return x.withColumn("score", F.col("likelihood") * F.col("impact"))


def risk_summary(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """RSK1: (by..., overall_risk_score, overall_risk_band, highest_risk) -- highest by (score, impact, likelihood),
    first in list order on ties."""
    by = seg_cols(by)
    w = (Window.partitionBy(*[F.col(f"`{b}`") for b in by]) if by else Window.partitionBy(F.lit(0))).orderBy(
        F.col("score").desc(), F.col("impact").desc(), F.col("likelihood").desc(), F.col("seq"))
    top = items.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") == 1)
    s = F.col("score")
    band = F.when(s >= 12, "CRITICAL").when(s >= 8, "HIGH").when(s >= 4, "MEDIUM").otherwise("LOW")
    return top.select(*by, s.alias("overall_risk_score"), band.alias("overall_risk_band"), F.col("name").alias("highest_risk"))


def risk_matrix(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """RSK1: 4 x 4 impact-by-likelihood counts, (by..., impact, l1, l2, l3, l4)."""
    by = seg_cols(by)
    grid = items.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(1), F.lit(4))).alias("impact"))
    piv = items.groupBy(*by, "impact").pivot("likelihood", [1, 2, 3, 4]).count()
    from tabscope.operators.segments import seg_join
    m = seg_join(grid, piv, by + ["impact"], "left")
    return m.select(*by, "impact", *[F.coalesce(F.col(str(i)), F.lit(0)).cast("long").alias(f"l{i}") for i in range(1, 5)])


# Financial defaults.
FINANCIAL_DEFAULTS = {
    "monthly_decision_volume": 400, "average_decision_value": 1200.0, "implementation_base_cost": 18000.0,
    "implementation_cost_per_recommendation": 2500.0, "loss_sensitivity": 0.08, "quality_penalty_weight": 0.05,
}
QUALITY_BASELINE = 70.0


def financial(ev: DataFrame, n_recs: Column, by: Sequence[str] = (), **overrides) -> DataFrame:
    """FIN1: annual value at stake, avoidable loss, cost, net benefit, ROI %, break-even months (null if no benefit)."""
    by = seg_cols(by)
    cfg = {**FINANCIAL_DEFAULTS, **overrides}
    volume = max(1, int(cfg["monthly_decision_volume"]))
    avg = max(1.0, float(cfg["average_decision_value"]))
    base = max(0.0, float(cfg["implementation_base_cost"]))
    per = max(0.0, float(cfg["implementation_cost_per_recommendation"]))
    loss = max(0.0, float(cfg["loss_sensitivity"]))
    qw = max(0.0, float(cfg["quality_penalty_weight"]))
    r2 = F.coalesce(_c("r2_score").cast("double"), F.lit(0.0))
    dq = F.coalesce(_c("data_quality_score").cast("double"), F.lit(0.0))
    weak = F.greatest(F.lit(0.0), F.coalesce(_c("weak_feature_pct").cast("double"), F.lit(0.0)))
    value = float(volume) * avg * 12.0
    ratio = loss * F.greatest(F.lit(0.0), 1 - r2) + qw * F.greatest(F.lit(0.0), (QUALITY_BASELINE - dq) / QUALITY_BASELINE)
    avoid = F.greatest(F.lit(0.0), value * ratio * (1 + weak / 100.0))
    cost = base + n_recs * per
    net = avoid - cost
    roi = F.when(cost > 0, net / cost * 100.0).otherwise(F.lit(0.0))
    monthly = avoid / 12.0
    be = F.when(monthly > 0, cost / monthly)
    return ev.select(*by, F.lit(round(value, 2)).alias("annual_value_at_stake"), F.round(avoid, 2).alias("estimated_avoidable_loss"),
                     F.round(cost, 2).cast("double").alias("implementation_cost"), F.round(net, 2).alias("net_benefit"),
                     F.round(roi, 2).alias("roi_percent"), F.round(be, 2).alias("break_even_months"))
