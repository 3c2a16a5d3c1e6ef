"""Evidence of a growing table: additive state per segment and event-time window, read out as evidence rows.

Everything the evidence needs beside quartiles, duplicates and medians is a sum: rows, nulls, pairwise moments
(COR1) and the moments of complete rows of each side of the split (REG1).  One streaming aggregation keeps them, with
a watermark that closes windows, so late rows within it still count and the state stays bounded by the open windows.
``read_out`` turns state rows into the evidence fields of ``plans.evidence``; fields that aren't additive (the data
quality score, and what follows from it) are null.

State is one row per (window, segment) and O(width squared) numbers, however many rows arrived.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.columns import analysed_columns, as_double, finite_or_null, is_stat_numeric, seg_cols
from tabscope.operators import correlation as C
from tabscope.operators import linear as L
from tabscope.operators.segments import seg_join
from tabscope.plans.evidence import evidence, feature_from_corr, rank_models
from tabscope.streaming.profile import scratch_path

SIDES = ("train", "test")


def _numeric(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if is_stat_numeric(df.schema[c].dataType)]


def evidence_state(stream: DataFrame, target: str, features: Sequence[str], test_flag: Column, by: Sequence[str] = (),
                   time: str | None = None, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """The streaming (or batch) aggregation: ([window], by..., n_rows, n_null, pairwise sums, moments of both sides).

    With ``time``, rows are grouped by tumbling event-time windows behind a watermark, and rows without a time take no
    part; without it there is one group a segment.  A row whose ``test_flag`` is null is on neither side.
    """
    by = seg_cols(by)
    cols = [*features, target]
    numeric = _numeric(stream, cols)
    feats = [c for c in features if c in numeric]
    keys = [F.col(f"`{b}`") for b in by]
    if time is not None:
        stream = stream.withWatermark(time, watermark)
        keys = [F.window(F.col(f"`{time}`"), window).alias("window"), *keys]
    # correlations see the values as they are, the fit sees them prepared (REG1: infinite and missing features are 0)
    nulls = sum((F.when(F.col(f"`{c}`").isNull() | (F.isnan(F.col(f"`{c}`")) if c in numeric else F.lit(False)), 1).otherwise(0) for c in cols), F.lit(0))
    side = F.when(test_flag, F.lit("test")).when(~test_flag, F.lit("train"))
    y = as_double(stream, target)
    fit = [F.coalesce(finite_or_null(as_double(stream, c)), F.lit(0.0)) for c in feats]
    quads = [v * v for v in fit]
    base = stream.select(*([F.col(f"`{time}`")] if time is not None else []), *[F.col(f"`{b}`") for b in by], nulls.alias("__null"),
                         F.when(y.isNotNull(), side).alias("__side"), *[as_double(stream, c).alias(f"__x{i}") for i, c in enumerate(numeric)],
                         *[v.alias(f"__f{i}") for i, v in enumerate([*fit, *quads, y])])
    k = len(feats) * 2 + 1
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.sum("__null").alias("n_null"), *C.pair_sums(len(numeric))]
    for s in SIDES:
        own = [F.when(F.col("__side") == s, F.col(f"__f{i}")) for i in range(k)]
        aggs.append(F.count_if(F.col("__side") == s).alias(f"n_{s}"))
        aggs += [F.avg(own[i]).alias(f"m_{s}_{i}") for i in range(k)]
        aggs += [F.covar_pop(own[i], own[j]).alias(f"c_{s}_{i}_{j}") for i in range(k) for j in range(i, k)]
    return base.groupBy(*keys).agg(*aggs)


def _side_moments(state: DataFrame, keys: list[str], s: str, places: Sequence[int]) -> DataFrame:
    cov = [F.col(f"c_{s}_{min(i, j)}_{max(i, j)}") for i in places for j in places]
    return state.where(F.col(f"n_{s}") > 0).select(
        *keys, F.lit(s == "test").alias("__test"), F.col(f"n_{s}").alias("n"),
        F.array(*[F.col(f"m_{s}_{i}") for i in places]).alias("mean"), F.array(*cov).alias("cov"))


def read_out(state: DataFrame, source: DataFrame, target: str, features: Sequence[str], by: Sequence[str] = (),
             include_target_pairs: bool = True) -> DataFrame:
    """([window], by..., n_rows, evidence fields) of state rows (a written table; ``source`` gives the column types)."""
    keys = (["window"] if "window" in state.columns else []) + seg_cols(by)
    cols = [*features, target]
    numeric = _numeric(source, cols)
    feats = [c for c in features if c in numeric]
    k = len(feats)
    corr = C.pairs_from_sums(state, numeric, keys)
    sig = state.select(*keys, "n_rows", F.lit(None).cast("double").alias("data_quality_score"),
                       F.round(F.col("n_null") / (F.col("n_rows") * len(cols)) * 100, 2).alias("missing_percentage"))
    sig = seg_join(sig, C.target_corr_mean(corr, target, keys), keys, "left") if k else sig.withColumn("avg_correlation", F.lit(0.0))
    sig = seg_join(sig, C.max_feature_corr(corr, target, keys), keys, "left") if k > 1 else sig.withColumn("max_correlation", F.lit(0.0))
    sig = sig.fillna(0.0, ["avg_correlation", "max_correlation"])
    fa = feature_from_corr(state.select(*keys), corr, target, len(numeric), keys, include_target_pairs)

    def fitted(places: list[int], names: list[str]) -> DataFrame:
        both = _side_moments(state, keys, "train", places).unionByName(_side_moments(state, keys, "test", places))
        return L.linear_analysis(state, names, target, F.lit(False), keys, prepared=True, split_moments=both)

    line = fitted([*range(k), 2 * k], feats)
    quad = fitted(list(range(2 * k + 1)), feats + [f"{f}__sq" for f in feats])
    models = None
    for order, (name, a) in enumerate((("Linear Regression", line), ("Polynomial Regression", quad))):
        m = a.where("fitted").select(*keys, F.lit(name).alias("name"), F.lit(order).alias("model_order"), "r2", "rmse",
                                     F.lit(0.0).alias("training_time"), F.lit("HIGH" if order == 0 else "MEDIUM").alias("interpretability"))
        models = m if models is None else models.unionByName(m)
    ev = evidence(sig, fa, line.select(*keys, "r2"), rank_models(models, keys), keys)
    return seg_join(state.select(*keys, "n_rows"), ev, keys)


def run_evidence(stream: DataFrame, spark: SparkSession, target: str, features: Sequence[str], test_flag: Column, by: Sequence[str] = (),
                 time: str | None = None, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Run over everything available; the evidence of the final state.

    The state goes out in update mode: a micro-batch writes the rows it changed to a folder of its own (a retry
    overwrites it), and the latest batch that wrote a (window, segment) holds its state."""
    out = scratch_path(spark, "evidence-state")
    state = evidence_state(stream, target, features, test_flag, by, time, window, watermark)
    keys = (["window"] if time is not None else []) + seg_cols(by)

    def keep(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (state.writeStream.outputMode("update").foreachBatch(keep)
         .option("checkpointLocation", scratch_path(spark, "evidence-stream")).trigger(availableNow=True).start())
    q.awaitTermination()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        final = spark.createDataFrame([], state.schema)
    else:
        final = latest_state(spark.read.parquet(out), keys)
    return read_out(final.checkpoint(eager=True), stream, target, features, by)


def latest_state(written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each (window, segment), the row of its last batch: a combining maximum, no sort."""
    row = F.struct(F.col("batch").cast("long").alias("__batch"), *[F.col(f"`{c}`") for c in written.columns if c != "batch" and c not in keys])
    top = written.select(*keys, row.alias("__row")).groupBy(*keys).agg(F.max_by("__row", "__row.__batch").alias("__row"))
    return top.select(*keys, "__row.*").drop("__batch")
