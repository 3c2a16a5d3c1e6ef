"""Per-segment signals, feature analysis, model table and the evidence row (AGG15, COR4-5, AGG14, MOD2, EVD1).

Each builder returns one row per segment; the evidence is an equi-join of
these small tables on the segment keys, so a million segments run through
the same plan as one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.columns import analysed_columns, is_stat_numeric, seg_cols
from tabscope.operators import correlation as C
from tabscope.operators import linear as L
from tabscope.operators.moments import moments, sub_moments
from tabscope.operators.profile import missing_total, target_type
from tabscope.operators.quality import quality_score
from tabscope.operators.segments import seg_join
from tabscope.session import ensure_checkpoint_dir

# Evidence flags and model-record labels.
WEAK_PCT_FLAG = 50
REDUNDANCY_FLAG = 3
POOR_FIT_R2 = 0.3
POOR_QUALITY = 70
MODEL_BEST = "BEST - Recommended"
MODEL_WEAK = "BASELINE - Too weak"
MODEL_GOOD = "GOOD - Use if speed matters"
MODEL_WEAK_R2 = 0.3


def signals(df: DataFrame, target: str | None, by: Sequence[str] = (), columns: Sequence[str] | None = None,
            corr: DataFrame | None = None, quality: DataFrame | None = None) -> DataFrame:
    """AGG15: (by..., n_rows, n_features, numeric_ratio, target_type, avg_correlation, max_correlation,
    data_quality_score, missing_percentage)."""
    by = seg_cols(by)
    cols = analysed_columns(df, by, columns)
    has_t = target is not None and target in cols
    n_features = max(len(cols) - (1 if has_t else 0), 0)
    numeric = [c for c in cols if is_stat_numeric(df.schema[c].dataType)]
    num_feats = [c for c in numeric if c != target]
    base = df.select(*[F.col(f"`{c}`") for c in by + cols])
    ensure_checkpoint_dir(df.sparkSession)
    # a row for each pair and segment, read four times below: written, so that its scans run once
    corr = corr if corr is not None else C.corr_long(base, numeric, by).checkpoint(eager=True)
    q = quality if quality is not None else quality_score(base, by, cols)
    miss = missing_total(base, by, cols)
    if has_t:
        tk = target_type(base, target, by)
    else:
        tk = base.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.lit("unknown").alias("target_type"))
    out = seg_join(tk, q.select(*by, F.col("overall_score").alias("data_quality_score")), by)
    out = seg_join(out, miss.select(*by, F.col("missing_pct").alias("missing_percentage")), by)
    if has_t and target in numeric and num_feats:
        out = seg_join(out, C.target_corr_mean(corr, target, by), by, "left")
    else:
        out = out.withColumn("avg_correlation", F.lit(0.0))
    if len(num_feats) > 1:
        out = seg_join(out, C.max_feature_corr(corr, target if has_t else None, by), by, "left")
    else:
        out = out.withColumn("max_correlation", F.lit(0.0))
    return out.select(
        *by, "n_rows", F.lit(n_features).alias("n_features"),
        F.lit(round(len(num_feats) / max(n_features, 1), 3)).cast("double").alias("numeric_ratio"), "target_type",
        F.coalesce("avg_correlation", F.lit(0.0)).alias("avg_correlation"),
        F.coalesce("max_correlation", F.lit(0.0)).alias("max_correlation"),
        F.round("data_quality_score", 1).alias("data_quality_score"), F.round("missing_percentage", 2).alias("missing_percentage"),
    )


def feature_analysis(df: DataFrame, target: str, by: Sequence[str] = (), columns: Sequence[str] | None = None,
                     corr: DataFrame | None = None, include_target: bool = True) -> DataFrame:
    """COR4 + COR5 + AGG14: (by..., weak_features, predictor_count, redundant_pairs_count, max_redundancy_correlation).

    ``include_target=True`` keeps the reference's rule that a pair with the target counts as redundant.
    """
    by = seg_cols(by)
    cols = analysed_columns(df, by, columns)
    numeric = [c for c in cols if is_stat_numeric(df.schema[c].dataType)]
    segs = df.groupBy(*by).agg(F.lit(1).alias("__one"))
    if target not in numeric:
        return segs.select(*by, F.lit(0).cast("long").alias("weak_features"), F.lit(0).alias("predictor_count"),
                           F.lit(0).cast("long").alias("redundant_pairs_count"), F.lit(0.0).alias("max_redundancy_correlation"))
    corr = corr if corr is not None else C.corr_long(df.select(*[F.col(f"`{c}`") for c in by + numeric]), numeric, by)
    return feature_from_corr(segs, corr, target, len(numeric), by, include_target)


def feature_from_corr(segs: DataFrame, corr: DataFrame, target: str, n_numeric: int, by: Sequence[str] = (),
                      include_target: bool = True) -> DataFrame:
    """``feature_analysis`` of the segments ``segs`` from their correlations."""
    by = list(by)
    weak = C.weak_features(corr, target, by).select(*by, "weak_features")
    red = C.redundant_pairs(corr, by, target, include_target=include_target, cap=None).groupBy(*by).agg(
        F.count(F.lit(1)).alias("redundant_pairs_count"), F.max("correlation").alias("max_redundancy_correlation"))
    out = seg_join(seg_join(segs, weak, by, "left"), red, by, "left")
    return out.select(
        *by, F.coalesce("weak_features", F.lit(0)).cast("long").alias("weak_features"),
        F.lit(max(n_numeric - 1, 0)).alias("predictor_count"),
        F.coalesce("redundant_pairs_count", F.lit(0)).cast("long").alias("redundant_pairs_count"),
        F.coalesce("max_redundancy_correlation", F.lit(0.0)).alias("max_redundancy_correlation"),
    )


def rank_models(models: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MOD2: (by..., name, r2_score, rmse, training_time, interpretability, recommendation) from unrounded r2/rmse;
    best by r2 (first in model order on ties), then the weak/good labels; values rounded as published."""
    by = seg_cols(by)
    w = (Window.partitionBy(*[F.col(f"`{b}`") for b in by]) if by else Window.partitionBy(F.lit(0))).orderBy(
        F.col("r2").desc_nulls_last(), F.col("model_order"))
    r = models.withColumn("__rk", F.row_number().over(w))
    rec = F.when(F.col("__rk") == 1, F.lit(MODEL_BEST)).when(F.col("r2") < MODEL_WEAK_R2, F.lit(MODEL_WEAK)).otherwise(F.lit(MODEL_GOOD))
    return r.select(*by, "name", F.round("r2", 3).alias("r2_score"), F.round("rmse", 3).alias("rmse"),
                    F.round("training_time", 4).alias("training_time"), "interpretability", rec.alias("recommendation"))


def closed_form_models(df: DataFrame, features: Sequence[str], target: str, test_flag: Column, by: Sequence[str] = ()) -> DataFrame:
    """Model table from exact least squares: 'Linear Regression' on the features and 'Polynomial Regression'
    on the features plus their squares (median-imputed, as the model comparison prepares data).
    (by..., name, model_order, r2, rmse, training_time, interpretability)."""
    by = seg_cols(by)
    feats = list(features)
    d = df.withColumn("__test", test_flag)
    d = L.prepare_xy(d, feats, target, by, fill="median", keep=["__test"])
    sq = [f"{f}__sq" for f in feats]
    for f, s in zip(feats, sq):
        d = d.withColumn(s, F.col(f"`{f}`") * F.col(f"`{f}`"))
    # one Gram pass over features, squares and target; the linear model reads its part of it
    k = 2 * len(feats) + 1
    m = moments(d, feats + sq + [target], by, part=F.col("__test"), part_name="__test").checkpoint(eager=True)
    lin = L.linear_analysis(d, feats, target, F.col("__test"), by, prepared=True, split_moments=sub_moments(m, k, [*range(len(feats)), k - 1]))
    poly = L.linear_analysis(d, feats + sq, target, F.col("__test"), by, prepared=True, split_moments=m)
    a = lin.select(*by, F.lit("Linear Regression").alias("name"), F.lit(0).alias("model_order"), "r2", "rmse", "fitted")
    b = poly.select(*by, F.lit("Polynomial Regression").alias("name"), F.lit(1).alias("model_order"), "r2", "rmse", "fitted")
    return a.unionByName(b).where("fitted").select(
        *by, "name", "model_order", "r2", "rmse", F.lit(0.0).alias("training_time"),
        F.when(F.col("model_order") == 0, F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("interpretability"))


def evidence(sig: DataFrame, fa: DataFrame, r2: DataFrame, models: DataFrame | None, by: Sequence[str] = ()) -> DataFrame:
    """EVD1: the 21 evidence fields per segment, and the mean correlation with the target.

    ``sig``: signals(); ``fa``: feature_analysis(); ``r2``: (by..., r2_score) of the holdout OLS;
    ``models``: ranked model table (by..., name, r2_score) or None.
    """
    by = seg_cols(by)
    e = seg_join(seg_join(sig, fa, by), r2.select(*by, F.col("r2").alias("__r2")), by, "left")
    if models is not None:
        m = models.groupBy(*by).agg(
            F.max(F.when(F.lower("name").contains("linear regression"), F.col("r2_score"))).alias("__lin"),
            F.max("r2_score").alias("__best"))
        e = seg_join(e, m, by, "left")
    else:
        e = e.withColumn("__lin", F.lit(None).cast("double")).withColumn("__best", F.lit(None).cast("double"))
    total = F.col("predictor_count")
    pct = F.least(F.lit(100), F.greatest(F.lit(0), F.bround(F.col("weak_features") / F.greatest(total, F.lit(1)) * 100, 0).cast("int")))
    strong = F.round(F.abs(F.col("max_correlation")), 2)
    r2s = F.coalesce(F.col("__r2"), F.lit(0.0))
    both = F.col("__lin").isNotNull() & F.col("__best").isNotNull()
    gain = F.when(both, F.col("__best") - F.col("__lin")).otherwise(F.lit(0.0))
    e = e.select(
        *by,
        F.col("weak_features").cast("long").alias("weak_features"),
        total.cast("long").alias("total_features"),
        pct.alias("weak_feature_pct"),
        strong.alias("strongest_correlation"),
        F.col("redundant_pairs_count").cast("long").alias("redundant_pairs_count"),
        F.round("max_redundancy_correlation", 2).alias("max_redundancy_correlation"),
        F.round(r2s, 4).alias("r2_score"),
        F.round(r2s * 100, 1).alias("r2_percentage"),
        F.round("data_quality_score", 1).alias("data_quality_score"),
        F.round("missing_percentage", 1).alias("missing_percentage"),
        F.round("__lin", 4).alias("linear_r2"),
        F.round("__best", 4).alias("best_model_r2"),
        F.round(gain, 4).alias("nonlinear_gain"),
        F.round(F.greatest(gain, F.lit(0.0)), 4).alias("best_improvement"),
        (pct > WEAK_PCT_FLAG).alias("has_weak_features"),
        (F.col("redundant_pairs_count") >= REDUNDANCY_FLAG).alias("has_redundancy"),
        (r2s < POOR_FIT_R2).alias("poor_model_fit"),
        (F.col("data_quality_score") < POOR_QUALITY).alias("poor_data_quality"),
        F.round("avg_correlation", 3).alias("target_correlation"),
        # the record names these three twice
        strong.alias("strongest_corr"),
        F.col("redundant_pairs_count").cast("long").alias("redundant_pairs"),
        F.round("max_redundancy_correlation", 2).alias("max_corr"),
    )
    return e


def segment_evidence(df: DataFrame, target: str, features: Sequence[str], test_flag: Column, by: Sequence[str] = (),
                     include_target_pairs: bool = True, materialize: bool = False) -> dict[str, DataFrame]:
    """Evidence for every segment of ``df`` (columns analysed: features + target).

    Returns the intermediate tables too: signals, feature_analysis, analysis (OLS), models, evidence.
    """
    by = seg_cols(by)
    cols = list(features) + [target]
    work = df.withColumn("__test", test_flag)
    base = work.select(*[F.col(f"`{c}`") for c in by + cols])
    numeric = [c for c in cols if is_stat_numeric(df.schema[c].dataType)]
    ensure_checkpoint_dir(df.sparkSession)
    corr = C.corr_long(base, numeric, by).checkpoint(eager=True)
    sig = signals(base, target, by, cols, corr=corr)
    fa = feature_analysis(base, target, by, cols, corr=corr, include_target=include_target_pairs)
    num_feats = [c for c in features if c in numeric]
    ana = L.linear_analysis(work, num_feats, target, F.col("__test"), by)
    models = rank_models(closed_form_models(work, num_feats, target, F.col("__test"), by), by)
    if materialize:
        # each is one row per segment (or per segment and model); checkpoint them before the evidence
        # join so the evidence reads them instead of recomputing their scans
        sig, fa, ana, models = (t.checkpoint(eager=True) for t in (sig, fa, ana, models))
    ev = evidence(sig, fa, ana.select(*by, "r2"), models, by)
    if materialize:
        ev = ev.checkpoint(eager=True)
    return {"signals": sig, "feature_analysis": fa, "analysis": ana, "models": models, "evidence": ev}
