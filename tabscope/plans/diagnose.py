"""End-to-end diagnosis of a table or of every segment of it: the whole analysis as one call.

Returns the result tables (all DataFrames, one row per segment unless noted):
  quality        five-part quality score
  signals        table signals
  analysis       holdout OLS, coefficients, importances, VIF (arrays per segment)
  models         model table (closed-form linear / polynomial, or MLlib when ``mllib_models`` and no segments)
  evidence       the evidence row
  decision       root cause, severity, confidence, bands, verdict flags
  recommendations, validated_recommendations, lint_report, top_actions   (rows per segment)
  risk_items (4 rows per segment), risk_summary, financial, confidence
  gate           whether the segment can be analysed, and why not
  importance     standardized and permutation importance, a row for each feature
  domain         domain told by the column names (one row)
  insights       ranked insights with root cause, confidence and actions
  interpretation whether the data or the model is the limit
  lint_rows      one row for each flag and correction of the lint
  output_violations  rows that contradict one another; none if all is well
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.columns import is_stat_numeric, seg_cols
from tabscope.operators import linear as L
from tabscope.operators.correlation import corr_long
from tabscope.operators.prepare import encode_features, split_flag
from tabscope.operators.profile import null_counts, validity_gate
from tabscope.operators.quality import quality_score
from tabscope.operators.segments import seg_join
from tabscope.plans import evidence as EV
from tabscope.plans import recommend as RC
from tabscope.plans import rules as RU
from tabscope.plans.catalog import column_catalog, infer_domain


def diagnose(df: DataFrame, target: str, features: Sequence[str] | None = None, by: Sequence[str] = (),
             split_key: str | None = None, test_flag: Column | None = None, mllib_models: bool = False,
             materialize: bool = True) -> dict[str, DataFrame]:
    """Run the analysis for ``target`` on ``df`` per segment ``by``.

    The test set is ``test_flag`` if given, else a hash split of ``split_key`` (20%).  With
    ``materialize`` the per-segment tables are checkpointed (one row per segment), so the many
    downstream rule tables read them instead of re-running the scans.
    """
    by = seg_cols(by)
    if test_flag is None:
        if split_key is None:
            raise ValueError("give split_key (a row key column) or test_flag")
        test_flag = split_flag(split_key)
    if features is None:
        skip = set(by) | {target} | ({split_key} if split_key else set())
        features = [f.name for f in df.schema.fields if f.name not in skip and (is_stat_numeric(f.dataType) or isinstance(f.dataType, (T.StringType, T.BooleanType)))]
    given = list(features)
    # strings and booleans become indicators; more than MAX_CATEGORIES values raise an error that names the columns
    df, features = encode_features(df, given)
    t = EV.segment_evidence(df, target, list(features), test_flag, by, materialize=materialize and not (mllib_models and not by))
    if mllib_models and not by:
        from tabscope.operators.models import compare_models
        models = EV.rank_models(compare_models(df, list(features), target, test_flag))
        sig, fa, ana = t["signals"], t["feature_analysis"], t["analysis"]
        t["models"] = models
        t["evidence"] = EV.evidence(sig, fa, ana.select(*by, "r2"), models, by)
    if materialize and mllib_models and not by:
        t = {k: v.checkpoint(eager=True) for k, v in t.items()}
    ev = t["evidence"]
    dec = RU.decision_table(ev, by)
    if materialize:
        dec = dec.checkpoint(eager=True)
    recs = RC.recommendations(dec, by)
    validated, report = RC.lint(dec, recs, by)
    top = RC.top_actions(validated, by)
    risk = RU.risk_items(seg_join(ev, dec.select(*by, "severity"), by), by)
    n_recs = recs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_recs"))
    fin = RU.financial(seg_join(ev, n_recs, by), F.col("n_recs"), by)
    imp = L.strongest_feature(t["analysis"], by)
    domain = infer_domain(column_catalog(df.sparkSession, {"table": df.select(*[F.col(f"`{c}`") for c in given + [target]])}))
    acts = RC.action_lists(recs, by)
    conf_in = seg_join(seg_join(seg_join(ev, imp, by, "left"), acts, by, "left"), domain.select(F.col("confidence").alias("domain_confidence")), [])
    conf = conf_in.select(*by, *RU.weighted_confidence(*RU.confidence_inputs(
        F.col("data_quality_score"), F.col("r2_score"), F.col("top_importance"), F.col("domain_confidence"), F.col("n_recs"))))
    table = df.select(*[F.col(f"`{c}`") for c in by + given + [target]])
    numeric = [c for c in given + [target] if is_stat_numeric(df.schema[c].dataType)]
    pairs = corr_long(table.select(*[F.col(f"`{c}`") for c in by + numeric]), numeric, by).where(F.abs("r") > 0.75)
    pairs = pairs.groupBy(*[F.col(f"`{b}`") for b in by]).agg(F.count(F.lit(1)).alias("n_high_pairs"), F.min(F.struct("i", "j", "feature_a", "feature_b", "r")).alias("p"))
    pairs = pairs.select(*by, "n_high_pairs", F.col("p.feature_a").alias("pair_a"), F.col("p.feature_b").alias("pair_b"), F.col("p.r").alias("pair_r"))
    nulls = null_counts(table, by).groupBy(*[F.col(f"`{b}`") for b in by]).agg(F.count_if(F.col("n_missing") > 0).alias("n_null_columns"))
    ctx = t["analysis"].select(*by, "r2")
    for other in (ev.select(*by, "best_improvement"), imp.select(*by, "strongest_feature"), pairs, nulls, acts, conf.select(*by, F.col("overall").alias("confidence"))):
        ctx = seg_join(ctx, other, by, "left")
    ctx = ctx.withColumns({"target": F.lit(target), **{c: F.coalesce(F.col(c), F.lit(0)) for c in ("r2", "n_high_pairs", "n_null_columns")}})
    ins = RC.insights(ctx, by)
    ranked = L.importance(t["analysis"], by)
    top_ranked = ranked.where("kind = 'standardized' AND rank = 1").select(*by, F.col("feature").alias("rank1_feature"))
    return {
        "quality": quality_score(table, by),
        **t,
        "gate": validity_gate(table, target, by),
        "importance": ranked,
        "domain": domain,
        "insights": ins,
        "interpretation": dec.select(*by, *RU.interpretation(F.col("r2_score"), F.col("feature_strength"))),
        "lint_rows": RC.lint_rows(dec, recs, by),
        "output_violations": RC.output_violations(seg_join(ctx.select(*by, "r2", "strongest_feature"), top_ranked, by, "left"), ins, by),
        "decision": dec,
        "recommendations": recs,
        "validated_recommendations": validated,
        "lint_report": report,
        "top_actions": top,
        "risk_items": risk,
        "risk_summary": RU.risk_summary(risk, by),
        "financial": fin,
        "confidence": conf,
    }
