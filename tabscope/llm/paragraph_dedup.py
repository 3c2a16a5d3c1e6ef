"""Repeated passages found by MinHash banding of paragraphs.

Paragraphs.  A passage that was pasted into other text shares no line ends with it, so the unit of comparison is a
sentence (it ends at ``.``, ``!``, ``?`` or a line end) of at least ``min_words`` words; words are runs of letters and
digits, A-Z lowered; each character of a script written without blanks is a word, and the sentence ends of other
scripts count as ends.  Shorter sentences of a line that follow one another are taken together up to one whose last
word's hash says so, once there are ``min_words`` of them; that end depends on the words alone, so it falls on the
same place wherever the passage stands.  Stretches of fewer than ``MIN_DISTINCT`` different words are no paragraphs.
Paragraphs of equal words are one content from here on, with a count.

Banding.  ``tune_bands`` picks rows and bands so that two contents with Jaccard similarity ``threshold`` on
``shingle``-word shingles share a band with probability ``recall`` or more.  Only bands that hold two contents or
more go on.

Verification.  In bands of up to ``SMALL`` contents all pairs are joined and their exact Jaccard similarity is
computed.  Larger bands, which are what thousands of near copies make, are cut into blocks of ``BLOCK`` contents;
every two blocks meet in one task, which compares all of their contents and returns only enough links to connect
what it found similar.  So no band is capped, none is gathered whole, and no band's pairs are written out.

Clusters are the connected components of the links; of each cluster the paragraph that stands first (least doc_id,
nulls last, then place) is kept and the others are removals.

Pieces.  A passage that stands inside a longer sentence, or in text without sentence marks, is no paragraph of its
own.  So the words of a whole text are cut once more, whatever marks stand between them: a cut is a word whose hash,
taken with the word before it, is less than those of the ``REACH`` words on either side.  That depends on these words
alone, so all cuts of a passage but those next to its ends are the same in any surroundings.  From every cut a piece
goes to the first later cut that gives it ``min_words`` words (stretches without a cut are cut every ``LONGEST``
words).  Pieces are compared by the XXH64 of their words; those that two documents hold join the runs below.

Passages.  Repeated paragraphs and pieces of one document with at most ``gap`` other words between them (sentences
that are too short to be compared, words that were changed) form a run; runs of ``min_passage`` words or more are
reported, so that a single repeated line of boilerplate is not.

Defined cases: null and empty texts have no paragraphs; equal rows count as two documents; null doc_id takes part;
empty tables give no rows; other columns are ignored; long texts are read whole, in groups of paragraphs.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscope.llm.common import ALNUM_FOLD, free_tables, settled_table, span_hashes
from tabscope.llm.components import connected_components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.99
MIN_WORDS, MIN_DISTINCT, MIN_PASSAGE, GAP = 8, 5, 25, 12
REACH, LONGEST, HELD, HELD_BYTES = 4, 64, 200_000, 1 << 18
SMALL, BLOCK = 32, 1024
MAX_BANDS = 5
SALT = 16
# Sentence ends beside ASCII, from Armenian to full width; marks between words of East Asian scripts; scripts without
# blanks (Thai and Lao, Tibetan, Myanmar, Khmer and Tai, kana and bopomofo, Han, half-width kana).
ENDS = re.compile("[\u0589\u061f\u06d4\u0964\u0965\u0f0d\u0f0e\u104a\u104b\u1362\u1367\u1368\u17d4\u17d5\u1803\u1809\u203c\u203d\u2047-\u2049\u3002\uff01\uff0e\uff1f\uff61]")
MARKS = re.compile("[\u0f0b\u3000\u3001\u3008-\u301f\u30fb\uff02-\uff0d\uff0f\uff1a-\uff1e\uff20\uff3b-\uff40\uff5b-\uff60\uff62-\uff65]")
UNSPACED = re.compile("[\u0e01-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u3005-\u3007\u3041-\u312f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
FOLD = bytes(2 if c == 10 else 1 if c in b".!?" else ALNUM_FOLD[c] for c in range(256))


def tune_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_bands: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows for which at most ``max_bands`` bands reach the recall at the threshold."""
    best = None
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if best is None or bands <= max_bands:
            best = (bands, rows)
    return best


def spaced(text: bytes) -> bytes:
    """The text with blanks around each character of the scripts that have none, and with ASCII sentence ends."""
    if text.isascii():
        return text
    plain = MARKS.sub(" ", ENDS.sub(".", text.decode("utf-8", "replace")))
    return UNSPACED.sub(r" \g<0> ", plain).encode()


def cut_text(text: bytes, min_words: int = MIN_WORDS):
    """(unit, start, words) of each paragraph of a UTF-8 text; unit counts stretches, start counts words."""
    at = unit = 0
    for line in text.translate(FOLD).split(b"\2"):
        short: list[bytes] = []
        for words in [*map(bytes.split, line.split(b"\1")), None]:
            long = words is not None and len(words) >= min_words
            if short and (words is None or long or (len(short) >= min_words and xxhash.xxh32_intdigest(short[-1]) % 4 == 0)):
                if len(short) >= min_words and len(set(short)) >= MIN_DISTINCT:
                    yield unit, at, short
                at, unit, short = at + len(short), unit + 1, []
            if long:
                if len(set(words)) >= MIN_DISTINCT:
                    yield unit, at, words
                at, unit = at + len(words), unit + 1
            elif words:
                short = short + words


def _words_of(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text with single blanks starts and ends."""
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(joined)]])


def _cuts(joined: bytes, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts of ``counts`` words (one or more each), all joined by blanks: (places, shift).  A place counts the words before
    it and its text's shift; texts are shifted ``reach`` apart, so that none sees the words of another."""
    n, first = len(starts), np.cumsum(counts) - counts
    before_it, hashes = np.arange(n) - 1, []
    before_it[first] = first
    for at in range(0, n, HELD):  # the hash of each word with the one before it
        base, to = starts[max(0, at - 1)], min(n, at + HELD)
        hashes.append(span_hashes(joined[base:ends[to - 1]], starts[before_it[at:to]] - base, ends[at:to] - base))
    h, shift = np.concatenate(hashes), reach * (np.arange(len(counts)) + 1)
    at = np.arange(n) + np.repeat(shift, counts)
    wide = np.full(n + reach * (len(counts) + 1), np.iinfo(np.uint64).max, np.uint64)
    wide[at] = h
    least = np.minimum.reduce([wide[k:len(wide) - reach + 1 + k] for k in range(reach)])
    marked = np.zeros(len(wide) + 1, bool)
    marked[first + shift] = marked[first + shift + counts] = True
    marked[at[(h < least[at - reach]) & (h <= least[at + 1])] + 1] = True
    found = np.flatnonzero(marked)
    wanting = np.flatnonzero(np.diff(found) > LONGEST)
    for i in wanting:
        marked[found[i]:found[i + 1]:LONGEST] = True
    return np.flatnonzero(marked) if len(wanting) else found, shift


def cuts(words: list[bytes], reach: int = REACH) -> np.ndarray:
    """The places between the words (and both ends) where pieces may begin and end."""
    joined = b" ".join(words)
    return _cuts(joined, *_words_of(joined), np.array([len(words)]), reach)[0] - reach


def cut_pieces(texts: list[bytes], counts: list[int], min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, n, key) of each piece of texts whose ``counts`` words (one or more) are joined by blanks; text is a
    place in the list, start and n count words."""
    joined, counts = b" ".join(texts), np.array(counts, np.int64)
    starts, ends = _words_of(joined)
    places, shift = _cuts(joined, starts, ends, counts, REACH)
    text = np.searchsorted(np.cumsum(counts) - counts + shift, places, "right") - 1
    last = np.searchsorted(places, places + min_words)
    held = np.flatnonzero(last < len(places))
    held = held[text[held] == text[last[held]]]
    text, start, end = text[held], places[held] - shift[text[held]], places[last[held]] - shift[text[held]]
    begin, stop = starts[start], ends[end - 1]
    # a word's first and last bytes and its length tell most words apart: where they tell enough, no set is built
    raw = np.frombuffer(joined, np.uint8).astype(np.int64)
    mark = raw[starts] | raw[ends - 1] << 8 | (ends - starts) << 16
    marks = np.sort(mark[start[:, None] + np.arange(min_words)], axis=1)
    plain = (marks[:, 1:] != marks[:, :-1]).sum(axis=1) + 1 >= MIN_DISTINCT
    unsure = np.flatnonzero(~plain)
    plain[unsure] = [len(set(joined[a:b].split())) >= MIN_DISTINCT for a, b in zip(begin[unsure].tolist(), stop[unsure].tolist())]
    digest = xxhash.xxh64_intdigest
    key = np.array([digest(joined[a:b]) for a, b in zip(begin[plain].tolist(), stop[plain].tolist())], np.uint64)
    return text[plain], (start - (np.cumsum(counts) - counts)[text])[plain], (end - start)[plain], key


def paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, pieces: bool = False) -> DataFrame:
    """(row, doc_id, unit, start, n, key, text) of every paragraph; start and n count words, key is the XXH64 of
    the words.  With ``pieces`` also of every piece, of which unit and text are null."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        names = ["row", "doc_id", "unit", "start", "n", "key", "text"]
        for batch in batches:
            source, columns = [], [[] for _ in range(5)]
            held, counts, owner, size = [], [], [], 0

            def flush():
                text, start, n, key = cut_pieces(held, counts, min_words)
                at = pa.array(np.array(owner, np.int32)[text])
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.nulls(len(at), pa.int32()), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int32)),
                     pa.array(key.view(np.int64)), pa.nulls(len(at), pa.string())], names=names)

            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                text = spaced(text.as_py() or b"")
                for unit, start, words in cut_text(text, min_words):
                    joined = b" ".join(words)
                    source.append(i)
                    for c, v in zip(columns, (unit, start, len(words), xxhash.xxh64_intdigest(joined), joined.decode())):
                        c.append(v)
                if pieces and len(words := text.translate(ALNUM_FOLD).split()) >= min_words:
                    held.append(b" ".join(words))
                    counts.append(len(words))
                    owner.append(i)
                    size += len(held[-1])
                    if size >= HELD_BYTES:
                        yield flush()
                        held, counts, owner, size = [], [], [], 0
            if held:
                yield flush()
            at = pa.array(source, pa.int32())
            unit, start, n, key, joined = columns
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(unit, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int32()),
                 pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(joined, pa.string())], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return settled_table(rows.mapInArrow(cut, f"row bigint, doc_id {kind}, unit int, start bigint, n int, key bigint, text string"), "paragraphs", compression="zstd")


def signatures(texts: list[bytes], count: int, shingle: int = SHINGLE) -> np.ndarray:
    """(n, count) MinHash values of word shingles; texts shorter than a shingle are one shingle."""
    joined = b" ".join(texts)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(joined)]])
    words = np.array([t.count(b" ") + 1 for t in texts], np.int64)
    grams = np.maximum(words - shingle + 1, 1)
    first_word, first_gram = np.cumsum(words) - words, np.cumsum(grams) - grams
    word = np.arange(grams.sum()) - np.repeat(first_gram, grams) + np.repeat(first_word, grams)
    h = span_hashes(joined, starts[word], ends[word + np.repeat(np.minimum(words, shingle) - 1, grams)])
    out = np.empty((len(texts), count), np.uint64)
    for k in range(count):
        x = h * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1 | 1) + np.uint64(0xC2B2AE3D27D4EB4F * (k + 1) & (1 << 64) - 1)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), first_gram)
    return out


def band_column(text: Column, bands: int, rows: int, shingle: int = SHINGLE) -> Column:
    @F.arrow_udf("array<bigint>")
    def fold(col: pa.Array) -> pa.Array:
        texts = col.cast(pa.binary()).to_pylist()
        out = np.empty((len(texts), bands), np.uint64)
        at, held = 0, 0
        for i, t in enumerate(texts):  # blocks of about 1 MB
            held += len(t)
            if held >= 1 << 20 or i + 1 == len(texts):
                mins = signatures(texts[at:i + 1], bands * rows, shingle)
                for b in range(bands):
                    x = np.full(len(mins), b + 1, np.uint64)
                    for r in range(rows):
                        x = (x ^ mins[:, b * rows + r]) * np.uint64(0x94D049BB133111EB)
                        x ^= x >> np.uint64(32)
                    out[at:i + 1, b] = x
                at, held = i + 1, 0
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, bands), pa.int32()), pa.array(out.reshape(-1).view(np.int64)))

    return fold(text)


def shingle_set(text: str, shingle: int = SHINGLE) -> set[str]:
    words = text.split(" ")
    return {" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def _jaccard_column(a: Column, b: Column, shingle: int) -> Column:
    @F.arrow_udf("double")
    def jaccard(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left.to_pylist(), right.to_pylist()):
            x, y = shingle_set(x, shingle), shingle_set(y, shingle)
            out.append(len(x & y) / len(x | y))
        return pa.array(out, pa.float64())

    return jaccard(a, b)


def connecting_links(keys: list[int], texts: list[str], threshold: float, shingle: int) -> list[tuple[int, int]]:
    """Pairs of keys that connect whatever pairs of similar texts connect; all pairs are compared."""
    number: dict[str, int] = {}
    sets = [[number.setdefault(g, len(number)) for g in shingle_set(t, shingle)] for t in texts]
    seen: list[list[int]] = [[] for _ in number]
    size, root = np.array([len(s) for s in sets]), list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for i, s in enumerate(sets):
        shared = np.bincount(np.concatenate([np.array(seen[g], np.int64) for g in s]), minlength=len(sets)) if i else np.zeros(len(sets), np.int64)
        for j in np.flatnonzero(shared >= np.maximum(1, np.ceil(threshold * (size[i] + size - shared) - 1e-9))).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                out.append((keys[i], keys[j]))
        for g in s:
            seen[g].append(i)
    return out


def _rows_of(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ``keys`` (written, distinct), with the other columns of ``keys``.

    One way at every size: each key stands once for every salt and the rows carry any one salt, so that the copies of
    a content that very many documents hold meet their key in ``SALT`` tasks; the aggregation that follows collapses
    them before it brings a key together.  Always shuffled (``merge``): Spark reckons ``keys`` by its file, a small
    part of the salted rows that a broadcast would bring to the driver."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int")
    spread = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__salt"))
    return rows.withColumn("__salt", salt).join(spread.hint("merge"), [key, "__salt"]).drop("__salt")


def similar_links(contents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE) -> DataFrame:
    """contents: (key, text), repeats allowed.  (src, dst) links whose components are those of the similar pairs
    that share a band."""
    bands, rows = tune_bands(threshold, recall)
    # equal texts have equal bands: from here on a content is one row
    signed = contents.select("key", band_column(F.col("text"), bands, rows, shingle).alias("bands")).dropDuplicates(["key"])
    signed = settled_table(signed, "paragraph-bands")
    each = signed.select("key", F.explode("bands").alias("band"))
    met = each.groupBy("band").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    met = settled_table(met, "paragraph-shared")
    # a band of two contents names its pair already; only larger ones look their members up
    couples = settled_table(met.where("n = 2").select(F.col("lo").alias("key"), F.col("hi").alias("other")).distinct(), "paragraph-couples")
    members = settled_table(_rows_of(each, met.where("n > 2").select("band"), "band").distinct(), "paragraph-members")
    free_tables(signed, met)
    sizes = settled_table(members.groupBy("band").count().withColumnRenamed("count", "size"), "paragraph-sizes")
    wanted = members.select("key").union(couples.select("key")).union(couples.select("other")).distinct()
    wanted = settled_table(wanted, "paragraph-wanted")
    texts = settled_table(_rows_of(contents, wanted, "key").groupBy("key").agg(F.first("text").alias("text")), "paragraph-texts")

    small = members.join(sizes.where(F.col("size") <= SMALL), "band").select("band", "key")
    pairs = small.join(small.withColumnRenamed("key", "other"), "band").where("key < other").select("key", "other").union(couples).distinct()
    paired = pairs.join(texts.hint("merge"), "key").join(texts.withColumnsRenamed({"key": "other", "text": "other_text"}).hint("merge"), "other")
    near = paired.where(_jaccard_column(F.col("text"), F.col("other_text"), shingle) >= threshold).select(F.col("key").alias("src"), F.col("other").alias("dst"))

    large = members.join(sizes.where(F.col("size") > SMALL), "band").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    large = large.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).join(texts.hint("merge"), "key")
    met = large.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"), "key", "text")

    def compare(table: pa.Table) -> pa.Table:
        links = connecting_links(table["key"].to_pylist(), table["text"].to_pylist(), threshold, shingle)
        return pa.table({"src": pa.array([x for x, _ in links], pa.int64()), "dst": pa.array([x for _, x in links], pa.int64())})

    links = settled_table(near.unionByName(met.groupBy("band", "a", "b").applyInArrow(compare, "src bigint, dst bigint")).distinct(), "paragraph-links")
    free_tables(members, couples, sizes, wanted, texts)
    return links


def repeated_paragraphs(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE,
                        min_words: int = MIN_WORDS) -> DataFrame:
    """(row, doc_id, unit, start, n, cluster, first_doc_id, removed) of every paragraph that another document
    repeats."""
    return _repeated_units(paragraphs(docs, min_words), threshold, recall, shingle)


def _repeated_units(units: DataFrame, threshold: float, recall: float, shingle: int) -> DataFrame:
    links = similar_links(units.select("key", "text"), threshold, recall, shingle)
    labels = connected_components(links).withColumnRenamed("node", "key")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "unit")
    contents = settled_table(units.groupBy("key").agg(F.count("*").alias("copies"), F.min(place).alias("first"),
                                                      F.min("row").alias("low"), F.max("row").alias("high")), "paragraph-contents")
    named = contents.join(labels.hint("merge"), "key", "left").where("copies > 1 or label is not null").select("key", "first", "low", "high", F.coalesce("label", "key").alias("cluster"))
    named = settled_table(named, "paragraph-named")
    free_tables(links, contents)
    heads = named.groupBy("cluster").agg(F.min("first").alias("head"), F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    clusters = settled_table(named.select("key", "cluster").join(heads.select("cluster", "head").hint("merge"), "cluster"), "paragraph-clusters")
    free_tables(named)
    found = units.select("row", "doc_id", "unit", "start", "n", "key").join(clusters.hint("merge"), "key")
    kept = (F.col("row") == F.col("head.row")) & (F.col("unit") == F.col("head.unit"))
    return found.select("row", "doc_id", "unit", "start", "n", "cluster", F.col("head.doc_id").alias("first_doc_id"), (~kept).alias("removed"))


def repeated_pieces(pieces: DataFrame) -> DataFrame:
    """(row, doc_id, unit, start, n, cluster, first_doc_id, removed) of every piece that another document holds."""
    ends = pieces.groupBy("key").agg(F.min("row").alias("low"), F.max("row").alias("high"))
    shared = settled_table(ends.where("low <> high").select("key"), "piece-shared")
    found = settled_table(_rows_of(pieces, shared, "key").select("row", "doc_id", "start", "n", "key"), "piece-found")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "start")
    heads = found.groupBy("key").agg(F.min(place).alias("head"))
    heads = settled_table(heads.select("key", F.col("head.row").alias("head_row"), F.col("head.start").alias("head_start"), F.col("head.doc_id").alias("first_doc_id")), "piece-heads")
    kept = (F.col("row") == F.col("head_row")) & (F.col("start") == F.col("head_start"))
    return _rows_of(found, heads, "key").select("row", "doc_id", F.lit(None).cast("int").alias("unit"), "start", "n", F.col("key").alias("cluster"), "first_doc_id", (~kept).alias("removed"))


def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE, min_words: int = MIN_WORDS,
                      min_passage: int = MIN_PASSAGE, gap: int = GAP) -> DataFrame:
    """doc_id, start_word, n_words, n_paragraphs, n_removed (both count paragraphs and pieces), first_doc_id (the
    least doc_id that any of the passage's clusters begins in) of every repeated passage."""
    cut = paragraphs(docs, min_words, pieces=True)
    # pieces first: their rows are the most, and what is left of them is small
    pieces = settled_table(repeated_pieces(cut.where("unit is null").drop("unit", "text")), "piece-runs")
    units = settled_table(_repeated_units(cut.where("unit is not null"), threshold, recall, shingle), "paragraph-runs")
    free_tables(cut)
    found = units.unionByName(pieces)
    order = Window.partitionBy("row").orderBy("start", "n", F.col("unit").isNull())
    reached = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("fresh", F.coalesce(F.col("start") - reached > gap, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    passages = runs.groupBy("row", "doc_id", "run").agg(
        F.min("start").alias("start_word"), (F.max(F.col("start") + F.col("n")) - F.min("start")).alias("n_words"), F.count("*").alias("n_paragraphs"),
        F.sum(F.col("removed").cast("bigint")).alias("n_removed"), F.min("first_doc_id").alias("first_doc_id"))
    return passages.where(F.col("n_words") >= min_passage).drop("row", "run")
