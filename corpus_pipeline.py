"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, as written to and reread from Parquet; all but the last return the
columns of ``documents``.

1. language_id: documents whose language can't be told (no letter in the text) go.
2. simhash_near_dedup: of each group of near-duplicates the document with the least doc_id stays.
3. decontamination: documents in which a benchmark window of 10 words occurs go.
4. secret_scan: secrets and linked credential parts are replaced in the text; every document stays.
5. best_fit_packing: the documents' tokens, packed into sequences of 4096; one row for each piece.

Nulls, empty and very long texts, repeated rows, empty tables and further columns: as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm.common import read_table, scratch_table
from tabscope.llm.decontam import drop_contaminated
from tabscope.llm.lang_id import keep_identified, train
from tabscope.llm.packing import pack_documents
from tabscope.llm.queries import word_tokenizer
from tabscope.llm.secret_scan import redact
from tabscope.llm.simhash import keep_one_of_each
from tabscope.session import ensure_checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return keep_identified(docs, train(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs, radius=2, shingle=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"), window=10)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pack_documents(docs, word_tokenizer(), capacity=4096, end_id=1)
    return out.select("doc_id", F.col("piece").cast("bigint").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no trained network, fingerprint components or packing; tests/llm/test_pipeline.py holds the rows against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
