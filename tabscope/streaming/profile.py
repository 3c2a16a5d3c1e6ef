"""Running profile of a growing table with Structured Streaming.

Null counts, row counts and moment sums are algebraic, so they are kept as
streaming aggregation state (``complete`` output) and updated per micro-batch;
the quantile-based and duplicate-based parts of the quality score need the
whole table and are recomputed in batch from the sink when required.
``foreach_batch_quality`` covers the other case: a quality row per
micro-batch (e.g. per landed file), appended to a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabscope.functions.columns import seg_cols
from tabscope.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh directory under the session's checkpoint directory (shared storage on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tabscope-{name}-{uuid.uuid4().hex[:12]}"


def null_count_stream(stream: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Streaming aggregation: (by..., n_rows, n_null_<col>...) updated per micro-batch."""
    by = seg_cols(by)
    return stream.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"),
                                   *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n_null_{c}") for c in columns])


def run_to_table(agg: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run a streaming aggregation over everything available, then return its final state as a batch table.

    Each micro-batch writes the complete state to a folder of its own below the checkpoint directory (a batch that
    is retried overwrites its folder); the last one is read back, so no state passes through the driver."""
    out = scratch_path(spark, f"state-{name}")
    done: list[int] = []

    def keep(state: DataFrame, batch_id: int) -> None:
        state.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        done.append(batch_id)

    q = (agg.writeStream.outputMode("complete").foreachBatch(keep)
         .option("checkpointLocation", scratch_path(spark, f"stream-{name}")).trigger(availableNow=True).start())
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], agg.schema)
    return spark.read.schema(agg.schema).parquet(f"{out}/batch={max(done)}")


def foreach_batch_quality(stream: DataFrame, out_path: str, checkpoint: str, by: Sequence[str] = ()):
    """Append one quality-score row per (micro-batch, segment) to ``out_path`` (parquet)."""
    from tabscope.operators.quality import quality_score

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        quality_score(batch, by).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out_path)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parquet_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
