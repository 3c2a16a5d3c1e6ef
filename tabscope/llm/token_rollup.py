"""Token counts kept up to date by signed deltas.

A rollup is a folder with two append-only tables, partitioned by batch:

``changes``  one row for each document that a batch added or took away, by tokenizer version: signed counts of
             documents and tokens, with the source and language they were counted under;
``totals``   their sums by source, language and tokenizer version.

All counts are additive.  What a document counts for now is the sum of its changes, and the totals are the sum of
all batches' totals.  An ``insert`` adds its row.  A ``delete`` takes back all that the doc_id counts for; a
``revise`` does the same and adds its row, under its own source and language.  Within a batch events have a total
order: by ``seq`` (null before all others), at equal seq deletes, then revises, then inserts, and revises at equal seq by
a hash of their row.  What stands before the last delete or revise of a doc_id has no effect, so of several
revises one counts.

A batch is committed once its totals are complete (the writer's ``_SUCCESS``), which comes after its changes are.
Committing a batch id again is a no-op; a batch that broke off is written anew over its remains.  Readers see
committed batches only.  The totals of a
batch have one row for each group, so reading all batches stays cheap.

Only the documents of a batch are tokenised, where they are; sums are made with map-side combining, so a source
that holds a third of all rows is no burden.  The lookup of what documents count for joins the batch's doc_ids
with the changes.

Defined cases: null text counts as empty (no tokens, one document); null source, lang and doc_id are values like
any other; rows with equal doc_id inserted in one batch all count; deleting what isn't there changes nothing;
an empty batch is committed and changes nothing; events with a null or unknown op change nothing; equal revises are
one; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm.tokens import tokenizer

KEYS = ["source", "lang", "tokenizer"]
CHANGES = "doc_id bigint, source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, batch string"
TOTALS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, batch string"
BLANK_WORDS = "blank_words"


def count_column(text: Column, tokenizers: dict[str, str | None]) -> Column:
    """array<bigint>: the tokens of a text under each version, in order.  A version without a file counts the
    runs of characters other than ASCII white space."""
    paths = list(tokenizers.values())

    @F.arrow_udf("array<bigint>")
    def count(col: pa.Array) -> pa.Array:
        texts = [t or "" for t in col.to_pylist()]
        made = [[len(t.encode().split()) for t in texts] if p is None else [len(tokenizer(p).ids(t)) // 4 for t in texts] for p in paths]
        return pa.array(list(zip(*made)), pa.list_(pa.int64()))

    return count(text)


class TokenRollup:
    """tokenizers: version -> tokenizer file, or None for blank-separated words."""

    def __init__(self, spark: SparkSession, path: str, tokenizers: dict[str, str | None]) -> None:
        self.spark, self.path, self.tokenizers = spark, path.rstrip("/"), tokenizers

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.path}/totals/batch={batch}/_SUCCESS")

    def batches(self) -> list[str]:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/totals")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName().removeprefix("batch=") for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n for n in names if self.committed(n))

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{table}/batch={b}" for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths)

    def changes(self) -> DataFrame:
        return self._read("changes", CHANGES)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of all committed batches."""
        sums = self._read("totals", TOTALS).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def commit(self, batch: str, events: DataFrame) -> bool:
        """events: (op, seq, doc_id, source, lang, text), op being insert, delete or revise.  False if the batch
        is committed already."""
        if not batch or any(c in batch for c in "/=%:\\ "):
            raise ValueError(f"not a batch name: {batch!r}")
        if self.committed(batch):
            return False
        seq = F.coalesce(F.col("seq").cast("bigint"), F.lit(-(2**63)))
        events = events.select("op", seq.alias("seq"), F.col("doc_id").cast("bigint").alias("doc_id"),
                               *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")])
        place = F.struct("seq", (F.col("op") == "revise").alias("revised"), F.when(F.col("op") == "revise", F.xxhash64("source", "lang", "text")).alias("h"))
        resets = (events.where("op in ('delete', 'revise')").groupBy("doc_id").agg(F.max(place).alias("reset"))
                  .withColumnRenamed("doc_id", "r_id"))
        same = F.col("doc_id").eqNullSafe(F.col("r_id"))
        inserted = events.where("op = 'insert'").join(resets, same, "left").where("reset is null or seq >= reset.seq")
        revised = events.where("op = 'revise'").withColumn("at", place).join(resets, same).where("at = reset").dropDuplicates(["doc_id"])
        added = inserted.select("doc_id", "source", "lang", "text").unionByName(revised.select("doc_id", "source", "lang", "text"))
        counts = F.arrays_zip(F.array(*[F.lit(v) for v in self.tokenizers]).alias("tokenizer"),
                              count_column(F.col("text"), self.tokenizers).alias("n_tokens"))
        plus = added.select("doc_id", "source", "lang", F.explode(counts).alias("c")).select(
            "doc_id", "source", "lang", "c.tokenizer", F.lit(1).cast("bigint").alias("n_docs"), "c.n_tokens")
        now = (self.changes().join(resets, same).groupBy("doc_id", *KEYS)
               .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0"))
        minus = now.select("doc_id", *KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))
        at = f"{self.path}/changes/batch={batch}"
        plus.unionByName(minus).write.mode("overwrite").parquet(at)
        written = self.spark.read.schema(CHANGES).parquet(at)
        sums = written.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        return True


def inserts(docs: DataFrame) -> DataFrame:
    """All rows of a documents table as insert events."""
    return docs.select(F.lit("insert").alias("op"), F.lit(0).alias("seq"), "doc_id", "source", "lang", "text")
