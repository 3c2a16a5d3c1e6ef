"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one window) and
every window is the set of its ``shingle``-word shingles at their places.  A document contains a window if, in
some stretch of document words as long as the window, at least ``containment`` of the window's shingles stand
at their places; at 1.0 the stretch equals the window word for word.

1. Filter.  The hashes of all item shingles become a bit table whose size has a fixed bound (``MAX_BITS``); it
   only saves work.  One pass over the documents keeps, for each text, its word count and the stretches that
   some passing shingle touches; everything later works on those stretches with the real words.
2. Rarity.  Occurrences of item shingles in the corpus are counted (map-side combining); each window orders its
   shingles by that count, rarest first.  If at least r of m shingles must match, one of the rarest m-r+1 must,
   so only these prefix shingles are joined (one for exact containment).
3. Bounds.  A meeting at document word p and window place o fixes the stretch [p-o, p-o+length); it must lie
   inside the document.
4. Verification compares the words of the stretch with those of the window.

Windows that occur become word counts by merging intervals, and items by a join on the window.  No pair of
documents or of items is ever formed; a passage that a third of all documents share makes one joined row for
each of its occurrences, and adaptive execution splits its join partition.

Defined cases: null or wordless texts have no words and no hits; null or wordless items have no window; an item
without item_id marks words but is not listed; equal rows keep their rows; empty tables give no hits or no
rows; other columns are ignored.  Long texts are hashed in chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscope.llm.common import alnum_words, scratch_table, small_side, span_hashes

MIN_BITS, MAX_BITS = 16, 27
CHUNK = 200_000


def words_column(text: Column) -> Column:
    @F.arrow_udf("array<string>")
    def split(col: pa.Array) -> pa.Array:
        return pa.array([[w.decode() for w in alnum_words(t or b"")] for t in col.cast(pa.binary()).to_pylist()], pa.list_(pa.string()))

    return split(text)


def _hash_column(gram: Column) -> Column:
    @F.arrow_udf("bigint")
    def hashed(col: pa.Array) -> pa.Array:
        grams = [g.encode() for g in col.to_pylist()]
        ends = np.cumsum([len(g) for g in grams], dtype=np.int64)
        return pa.array(span_hashes(b"".join(grams), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends).view(np.int64))

    return hashed(gram)


def item_windows(items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(win, win_text, words, k): the distinct windows; and (win, item_id): the items that hold them."""
    words = items.select("item_id", words_column(F.col("text")).alias("w")).where("size(w) > 0")
    cut = words.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window)), lambda s: F.slice("w", s + 1, window))).alias("words"))
    held = scratch_table(cut.select("item_id", F.array_join("words", " ").alias("win_text")).distinct(), "decontam-held")
    wins = scratch_table(held.select("win_text").distinct().withColumn("win", F.monotonically_increasing_id())
                         .withColumn("words", F.split("win_text", " "))
                         .withColumn("k", F.least(F.lit(shingle), F.size("words"))), "decontam-windows")
    return wins, scratch_table(held.join(wins.select("win", "win_text"), "win_text").select("win", "item_id"), "decontam-items")


def _grams(words: Column, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - k)), lambda i: F.array_join(F.slice(words, i + 1, k), " "))


def shingle_filter(grams: DataFrame) -> np.ndarray:
    """Bit table over the hashes of the distinct ``gram``; 2^MAX_BITS entries at most, however many shingles."""
    hashes = scratch_table(grams.select("gram").distinct().select(_hash_column(F.col("gram")).alias("h")), "decontam-hashes")
    bits = min(MAX_BITS, max(MIN_BITS, (1024 * hashes.count()).bit_length()))
    places = hashes.select(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("place")).distinct()
    table = np.zeros(1 << bits, bool)
    table[places.toPandas()["place"].to_numpy(np.int64)] = True
    return np.packbits(table)


def touched_stretches(words: list[bytes], table: np.ndarray, lengths: list[int], context: int) -> list[tuple[int, int]]:
    """Merged [start, end) word ranges that shingles in the table cover, widened by ``context`` words."""
    n, shift = len(words), np.uint64(64 - (8 * len(table)).bit_length() + 1)
    marks = []
    for k in lengths:
        for at in range(0, n - k + 1, CHUNK):
            part = words[at:at + CHUNK + k - 1]
            size = np.fromiter(map(len, part), np.int64, len(part))
            ends = np.cumsum(size + 1) - 1
            h = span_hashes(b" ".join(part), (ends - size)[:len(part) - k + 1], ends[k - 1:]) >> shift
            found = np.flatnonzero(table[h >> np.uint64(3)] >> (7 - (h & np.uint64(7))).astype(np.uint8) & 1) + at
            if len(found):
                marks.append(np.stack([np.maximum(found - context, 0), np.minimum(found + k + context, n)], axis=1))
    if not marks:
        return []
    spans = np.concatenate(marks)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return list(zip(spans[first, 0].tolist(), reach[np.concatenate([first[1:], [True]])].tolist()))


def _scan(docs: DataFrame, table: np.ndarray, lengths: list[int], context: int) -> DataFrame:
    """(row, doc_id, text_hash, n_words, stretches) of every document, written once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def scan(batches):
        out = pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1).cast(pa.binary()):
                words = alnum_words(text.as_py() or b"")
                counts.append(len(words))
                found.append([{"start": a, "text": b" ".join(words[a:b]).decode()}
                              for a, b in touched_stretches(words, shared.value, lengths, context)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(found, out)],
                                             names=["doc_id", "text_hash", "n_words", "stretches"])

    scanned = docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(scan, f"doc_id {kind}, text_hash bigint, n_words bigint, stretches array<struct<start:int,text:string>>")
    return scratch_table(scanned.withColumn("row", F.monotonically_increasing_id()), "decontam-scan")


def find_windows(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5,
                 containment: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, doc_id, text_hash, n_words) of every document; (row, start, length, win) of every occurrence of a window;
    (win, item_id)."""
    wins, held = item_windows(items, window, shingle)
    places = scratch_table(wins.select("win", "k", F.posexplode(_grams(F.col("words"), F.col("k"))).alias("offset", "gram")), "decontam-grams")
    lengths = [r.k for r in places.select("k").distinct().orderBy("k").collect()]  # at most ``shingle`` values
    context = window - min(lengths, default=window) if containment < 1 else 0
    scan = _scan(docs, shingle_filter(places), lengths, context)

    stretch = scan.where("size(stretches) > 0").select("row", "n_words", F.explode("stretches").alias("s")).select(
        "row", "n_words", F.col("s.start").alias("at"), F.split("s.text", " ").alias("w"))
    near = None
    for k in lengths:
        reach = window - k
        grams = stretch.where(F.size("w") >= k).select("row", "n_words", "at", "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("i"))
        lead = F.least(F.col("i"), F.lit(reach))
        part = grams.select("row", "n_words", (F.col("at") + F.col("i")).alias("pos"), F.array_join(F.slice("w", F.col("i") + 1, k), " ").alias("gram"),
                            F.lit(k).alias("k"), lead.alias("lead"),
                            F.array_join(F.slice("w", F.col("i") - lead + 1, lead + k + reach), " ").alias("around"))
        near = part if near is None else near.unionByName(part)
    if near is None:
        empty = scan.where("false").select("row", F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("length"), F.lit(0).cast("bigint").alias("win"))
        return scan.drop("stretches"), empty, held

    known = places.select("gram").distinct()
    counts = near.groupBy("gram").agg(F.count("*").alias("seen")).join(known, "gram", "left_semi")
    rarest = Window.partitionBy("win").orderBy("seen", "gram", "offset")
    need = F.ceil(F.lit(containment) * (F.size("words") - F.col("k") + 1))
    # A shingle that occurs nowhere can't be met: it stays in the order with a count of zero, as the rarest.
    ordered = (places.join(counts, "gram", "left").fillna(0, ["seen"]).withColumn("nth", F.row_number().over(rarest))
               .join(wins.select("win", "words", "win_text"), "win"))
    prefix = scratch_table(ordered.where(F.col("nth") <= F.size("words") - F.col("k") + 1 - need + 1)
                           .select("gram", "win", "offset", "k", "words", "win_text", need.alias("need")).where("gram is not null"), "decontam-prefix")

    met = near.join(prefix, ["gram", "k"])
    size = F.size("words")
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + size <= F.col("n_words")) & (F.col("lead") >= F.col("offset"))
    seen = F.slice(F.split("around", " "), F.greatest(F.lit(1), F.col("lead") - F.col("offset") + 1), size)
    met = met.where(inside).select("row", start.cast("bigint").alias("start"), size.cast("bigint").alias("length"), "win", "win_text", "words", "k", "need", seen.alias("found"))
    if containment >= 1:
        met = met.where(F.array_join("found", " ") == F.col("win_text"))
    else:
        same = F.arrays_zip(_grams(F.col("found"), F.col("k")).alias("a"), _grams(F.col("words"), F.col("k")).alias("b"))
        met = met.where((F.size("found") == F.size("words")) & (F.size(F.filter(same, lambda g: g["a"] == g["b"])) >= F.col("need")))
    return scan.drop("stretches"), scratch_table(met.select("row", "start", "length", "win").distinct(), "decontam-found"), held


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, containment: float = 1.0) -> DataFrame:
    """One row for each row of docs: row, doc_id, text_hash (xxhash64 of the text), n_words, n_hit (words inside an occurrence), items (sorted
    item_ids, as strings)."""
    rows, found, held = find_windows(docs, items, window, shingle, containment)
    before = Window.partitionBy("row").orderBy("start", "length", "win").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    hit = found.select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    listed = (found.select("row", "win").distinct().join(held, "win").where("item_id is not null")
              .groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    return (rows.join(hit, "row", "left").join(listed, "row", "left")
            .select("row", "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, containment: float = 1.0) -> DataFrame:
    """The rows of docs in which no item window occurs, all columns as they are.  Decisions come back by doc_id
    and text hash, so rows that share a doc_id are judged each by its own text."""
    names = docs.columns
    flagged = scratch_table(contamination(docs, items, window, shingle, containment).where("n_hit > 0")
                            .select("doc_id", "text_hash").distinct(), "decontam-flagged")
    flagged = small_side(flagged.withColumnRenamed("doc_id", "flagged_id"))
    same = docs["doc_id"].eqNullSafe(flagged["flagged_id"]) & (F.xxhash64(docs["text"]) == flagged["text_hash"])
    return docs.join(flagged, same, "left_anti").select(*names)
