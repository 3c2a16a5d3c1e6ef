"""Registered queries of the training-data operators: one ``opN_<name>`` each, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents, linked within 2 bits."""
    from tabscope.llm.simhash import simhash_near_duplicates

    out = simhash_near_duplicates(read_table(spark, sf_dir, "documents"), radius=2, shingle=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words found in all documents."""
    from tabscope.llm.decontam import contamination

    out = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written into WARC archives with revisit records, as read back."""
    from tabscope.llm.warc import archive_round_trip

    out = archive_round_trip(read_table(spark, sf_dir, "pages"))
    return out.select(F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      F.col("refers_to").cast("bigint").alias("refers_to"))


ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def word_tokenizer() -> str:
    """File of the public word tokenizer; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenised and packed into sequences of 4096 tokens."""
    from tabscope.llm.packing import pack_documents

    out = pack_documents(read_table(spark, sf_dir, "documents"), word_tokenizer(), capacity=4096, end_id=1)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labels of two thirds of them."""
    from tabscope.llm.lang_id import identify, train

    docs = read_table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    net = train(docs.where(F.coalesce(third != 1, F.lit(True))))
    out = identify(docs.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "text"), net)
    return out.select("doc_id", "held_out", "lang_pred", "score")


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked credential parts in all documents."""
    from tabscope.llm.secret_scan import BASE, scan, told

    out = scan(read_table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return out.select("carry.doc_id", *counts, F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


@query
def op5_hamming_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all embeddings to every hundredth of them."""
    from tabscope.llm.hamming_ann import nearest_neighbours

    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op9_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations less those that are prefixes of longer ones, rendered in parts (one for ordinary logs)."""
    from tabscope.llm.chat_collapse import collapse_and_render

    return collapse_and_render(read_table(spark, sf_dir, "conversations"))


ORACLES["op9_chat_collapse"] = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations),
p AS (SELECT *, sha256(string_agg(length(role)::VARCHAR || ':' || role || length(text)::VARCHAR || ':' || text, '')
    OVER (PARTITION BY conv_id ORDER BY place)) AS h, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
w AS (SELECT h, n, min(conv_id) AS conv_id, count(*) AS n_equal FROM p WHERE place = n GROUP BY h, n),
m AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n AND p.place = w.n AND p.h = w.h))
SELECT conv_id, part, max(n)::BIGINT AS n_turns, max(n_equal)::BIGINT AS n_equal, string_agg(turn, '' ORDER BY place) AS rendered
FROM (SELECT *, ((sum(length(turn)) OVER (PARTITION BY conv_id ORDER BY place) - length(turn)) // 16777216)::BIGINT AS part
  FROM (SELECT m.*, t.place, '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) AS turn
    FROM m JOIN t ON t.conv_id IS NOT DISTINCT FROM m.conv_id)) GROUP BY conv_id, part
"""


@query
def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across all documents, one row for each place where one stands."""
    from tabscope.llm.paragraph_dedup import repeated_passages

    return repeated_passages(read_table(spark, sf_dir, "documents"))


@query
def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by source, language and tokenizer version, kept by deltas: two batches of inserts, one
    that deletes a fifth of the documents and changes a tenth (revised under a wrong source, deleted, inserted anew), one
    that puts the deleted ones back; the second is committed again at the end.  The totals are those of the documents."""
    from tabscope.llm.common import scratch_path
    from tabscope.llm.token_rollup import BLANK_WORDS, TokenRollup, inserts

    rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"), {"word_bpe_49k": word_tokenizer(), BLANK_WORDS: None})
    events = inserts(read_table(spark, sf_dir, "documents"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    rollup.commit("load-1", events.where(part < 5))
    rollup.commit("load-2", events.where(part >= 5))
    gone, changed = events.where(part.isin(2, 7)), events.where(part == 4)
    wrong = changed.withColumns({"op": F.lit("revise"), "seq": F.lit(1), "source": F.lit("wrong"), "text": F.lit("")})
    rollup.commit("change", gone.withColumn("op", F.lit("delete")).unionByName(wrong).unionByName(
        changed.withColumns({"op": F.lit("delete"), "seq": F.lit(2)})).unionByName(changed.withColumn("seq", F.lit(3))))
    rollup.commit("back", gone)
    rollup.commit("load-2", events.where(part >= 5))
    return rollup.totals()


@query
def op12_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every hundredth embedding; a seventh of the labels are moved on by one, so that labels and
    vectors disagree."""
    from tabscope.llm.bond_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=10, scale=256, window=(30, 90))


ORACLES["op12_bond_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 10
"""


def noisy_words(docs: DataFrame, every: int, least_length: int, least_count: int) -> DataFrame:
    """(word, n): runs of letters of all documents, one letter taken out of every so many (by a hash of document and
    run), of ``least_length`` letters that occur ``least_count`` times."""
    from tabscope.llm.spelling import letter_runs

    run, doc = F.col("run"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    hashed = F.crc32(F.concat(doc, F.lit(":"), run).cast("binary"))
    at = (F.col("h") % F.char_length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    words = letter_runs(docs, least_length).withColumn("h", hashed).select(F.when(F.col("h") % every == 0, less).otherwise(run).alias("word"))
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    from tabscope.llm.spelling import group_spellings

    out = group_spellings(noisy_words(read_table(spark, sf_dir, "documents"), 199, 6, 5), factor=5, least_length=6)
    return out.select("word", "form", "root", "n", "n_near", "form_n")


@query
def op11_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base quality rules and robust outliers of all documents, by language and source."""
    from tabscope.llm.robust_outliers import quality_verdicts

    out = quality_verdicts(read_table(spark, sf_dir, "documents"))
    counts = [F.col(c).cast("bigint").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("carry.doc_id", *counts, "base_failed", "kept")
