"""Domain inference from column names (DOM1, DOM2).

The column catalog is one row per (dataset, column) taken from table
schemas.  Each row is matched against the fixed keyword lists with an array
expression (substring containment, no join), and the distinct keywords found
are scored per dataset.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Domain keywords, in domain tie-break order.
DOMAIN_KEYWORDS = {
    "real_estate": ["price", "sqft", "bedroom", "bath", "zipcode", "neighborhood", "lot", "property"],
    "healthcare": ["patient", "diagnosis", "blood", "cholesterol", "heart", "treatment", "bmi"],
    "business": ["revenue", "profit", "sales", "cost", "margin", "customer", "churn"],
}
# Keywords, descriptions and likely features of the context variant.
CONTEXT_KEYWORDS = {
    "real_estate": ["price", "sqft", "bedroom", "bath", "zipcode", "neighborhood", "lot", "renovation"],
    "healthcare": ["age", "blood", "pressure", "diagnosis", "patient", "heart", "cholesterol"],
    "business": ["revenue", "profit", "cost", "margin", "expense", "sales", "customer"],
}
DOMAIN_CONTEXT = {
    "real_estate": "Housing price prediction dataset",
    "healthcare": "Healthcare outcomes analysis dataset",
    "business": "Business performance analytics dataset",
    "generic": "Generic tabular analytics dataset",
}
DOMAIN_LIKELY_FEATURES = {
    "real_estate": ["location", "condition", "age", "amenities"],
    "healthcare": ["lifestyle", "medical_history", "treatment", "biomarkers"],
    "business": ["marketing", "segment", "seasonality", "pricing_strategy"],
    "generic": ["domain_features", "interaction_terms", "external_signals", "time_features"],
}
DOMAIN_ORDER = ["real_estate", "healthcare", "business"]


def column_catalog(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(dataset, ordinal, column) from the schemas of the given tables (metadata only)."""
    rows = [(name, i, c) for name, df in tables.items() for i, c in enumerate(df.columns)]
    return spark.createDataFrame(rows, "dataset string, ordinal int, column string")


def _scores(catalog: DataFrame, kw: Mapping[str, list[str]]) -> DataFrame:
    """(dataset, domain, domain_order, score): distinct keywords of the domain found inside any column name.

    Matching is an array expression per catalog row (no join); scores are per-dataset conditional distinct counts.
    """
    name = F.lower(F.col("column"))
    hits = catalog.select("dataset", *[
        F.filter(F.array(*[F.lit(k) for k in kw[d]]), lambda k: F.instr(name, k) > 0).alias(d) for d in DOMAIN_ORDER])
    per = hits.groupBy("dataset").agg(*[F.array_distinct(F.flatten(F.collect_list(d))).alias(d) for d in DOMAIN_ORDER])
    long = per.select("dataset", F.explode(F.array(*[
        F.struct(F.lit(d).alias("domain"), F.lit(i).alias("domain_order"), F.size(F.col(d)).alias("score"))
        for i, d in enumerate(DOMAIN_ORDER)])).alias("s")).select("dataset", "s.*")
    return long


def infer_domain(catalog: DataFrame, target_types: DataFrame | None = None) -> DataFrame:
    """DOM1: (dataset, domain, score, confidence, n_reasons); ties go to real_estate, healthcare, business."""
    s = _scores(catalog, DOMAIN_KEYWORDS)
    w = Window.partitionBy("dataset").orderBy(F.col("score").desc(), "domain_order")
    best = s.withColumn("__rk", F.row_number().over(w)).where("__rk = 1")
    if target_types is not None:
        best = best.join(target_types.select("dataset", "target_type"), "dataset", "left")
    else:
        best = best.withColumn("target_type", F.lit("unknown"))
    dom = F.when(F.col("score") > 0, F.col("domain")).otherwise(F.lit("generic"))
    reasons = (F.when(dom != "generic", 1).otherwise(0)
               + F.when((F.col("target_type") == "regression") & (dom == "real_estate"), 1).otherwise(0)
               + F.when((F.col("target_type") == "classification") & (dom == "healthcare"), 1).otherwise(0))
    conf = F.when(dom == "generic", F.lit(0.35)).otherwise(
        F.least(F.lit(1.0), 0.25 + F.col("score") * 0.15 + F.when(reasons > 1, 0.1).otherwise(0.0)))
    return best.select("dataset", dom.alias("domain"), "score", F.round(conf, 2).alias("confidence"), reasons.alias("n_reasons"))


def infer_context(catalog: DataFrame, high_corr_counts: DataFrame | None = None, target_types: DataFrame | None = None) -> DataFrame:
    """DOM2: (dataset, domain, score, confidence, context, likely_features, problem_type); real estate scores +1
    when the dataset has high-correlation pairs; HIGH >= 4, MEDIUM >= 2, else LOW.

    ``target_types``: (dataset, target_type) as from ``profile.target_type``; a dataset without one, or with an
    unknown one, counts as regression."""
    spark = catalog.sparkSession
    s = _scores(catalog, CONTEXT_KEYWORDS)
    w = Window.partitionBy("dataset").orderBy(F.col("score").desc(), "domain_order")
    best = s.withColumn("__rk", F.row_number().over(w)).where("__rk = 1")
    if high_corr_counts is not None:
        best = best.join(high_corr_counts.select("dataset", "n_high_pairs"), "dataset", "left")
    else:
        best = best.withColumn("n_high_pairs", F.lit(0))
    dom = F.when(F.col("score") > 0, F.col("domain")).otherwise(F.lit("generic"))
    score = F.col("score") + F.when((dom == "real_estate") & (F.coalesce("n_high_pairs", F.lit(0)) > 0), 1).otherwise(0)
    ctx = spark.createDataFrame([(d, DOMAIN_CONTEXT[d], DOMAIN_LIKELY_FEATURES[d]) for d in DOMAIN_CONTEXT],
                                "d string, context string, likely_features array<string>")
    b = best.select("dataset", dom.alias("d"), score.alias("score"))
    out = b.join(F.broadcast(ctx), "d")
    if target_types is not None:
        out = out.join(target_types.select("dataset", "target_type"), "dataset", "left")
    else:
        out = out.withColumn("target_type", F.lit(None).cast("string"))
    problem = F.when(F.col("target_type") == "classification", "classification").otherwise("regression")
    conf = F.when(F.col("score") >= 4, "HIGH").when(F.col("score") >= 2, "MEDIUM").otherwise("LOW")
    return out.select("dataset", F.col("d").alias("domain"), "score", conf.alias("confidence"), "context", "likely_features", problem.alias("problem_type"))
