"""Spelling variants of words by pivotal grams.

Words within one edit of each other are found without comparing all pairs.  The bigrams of all words have one global
order, rare ones first.  A word's *prefix* is its three rarest positioned bigrams (and any as rare as the third);
its *pivots* are two disjoint bigrams of the prefix whose total frequency is least, chosen by dynamic programming.
One edit breaks at most one of two disjoint bigrams.  So of two words one edit apart, the one whose prefix ends at
the rarer bigram has a pivot that stands unbroken in the other's prefix, and pivots are joined to prefixes only.

Position limits.  The edit lies to the right of the unbroken pivot or to its left, and in the nearer or the farther half
of the letters there.  In each of these four cases all other letters are equal and stand where the two lengths put
them, so the join key is a hash of those letters, the pivot's place and the length: lists stay short for common
bigrams too, and no bigram's list is ever compared as a whole.  Pairs that meet are verified by edit distance.

A word's form is its most frequent near word, if that is ``factor`` times as frequent; roots follow forms to the last
by pointer doubling (each step multiplies n by the factor, so chains are short and have no cycles).

Defined cases: null and empty words are dropped; equal words are one, their counts added; null counts are 0; an empty
table gives an empty result; very long words work like short ones (the work is linear in their length); any script
works, since bigrams are counted in 65,536 hashed classes, which is all the driver ever holds; words of fewer than
four code points can't be given (``least_length``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import scratch_table, span_hashes

CLASSES = 1 << 16
RUN = r"[A-Za-zÀ-ÿ]"


def lower_ascii(word: Column) -> Column:
    """A-Z to a-z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


def letter_runs(docs: DataFrame, least_length: int = 1) -> DataFrame:
    """(doc_id, run): one row for each maximal run of at least ``least_length`` letters, lower-cased in A-Z."""
    runs = F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(runs).alias("run")).withColumn("run", lower_ascii(F.col("run")))


def _letters(words: pd.Series) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Code points of all words, the same as bytes (four each), and each word's start and length."""
    joined = "".join(words).encode("utf-32-le", "surrogatepass")
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(joined, np.uint32).astype(np.uint64), joined, np.cumsum(size) - size, size


def _classes(letters: np.ndarray) -> np.ndarray:
    """Class of the bigram at each place (the last has none and gets that of a bigram with 0)."""
    after = np.append(letters[1:], np.uint64(0)) if len(letters) else letters
    mixed = (letters * np.uint64(0x9E3779B97F4A7C15)) ^ ((after + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often each class of bigrams stands in the words; a table of fixed size."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            letters, _, start, size = _letters(batch["word"])
            inner = np.ones(len(letters), bool)
            inner[start + size - 1] = False
            total += np.bincount(_classes(letters)[inner], minlength=CLASSES)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"gram": seen, "c": total[seen]})

    out = np.zeros(CLASSES, np.int64)
    counted = words.select("word").mapInPandas(count, "gram bigint, c bigint").groupBy("gram").agg(F.sum("c").alias("c"))
    for r in counted.toLocalIterator():
        out[r["gram"]] = r["c"]
    return out


def pivots(places: list[int], cost: list[int], k: int = 2, q: int = 2) -> list[int]:
    """Indices of k pairwise disjoint q-grams of least total cost; places ascend.  best[j][i] is the least cost of j
    grams among the first i, with the choice that gives it."""
    best = [[(0, ())] * (len(places) + 1)]
    fits = [0] * len(places)
    for i in range(1, len(places)):
        fits[i] = fits[i - 1]
        while places[fits[i]] + q <= places[i]:
            fits[i] += 1
    for _ in range(k):
        row: list = [(float("inf"), ())]
        for i, c in enumerate(cost):
            total, taken = best[-1][fits[i]]
            row.append(min(row[-1], (total + c, taken + (i,))))
        best.append(row)
    return list(best[k][-1][1])


def _place_keys(joined: bytes, start: np.ndarray, own: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the four cases for bigrams at ``at`` in words of length ``own``, when the word holding the pivot has
    length ``size``; and which of them can be (the letters named must not overlap)."""
    keys, can = [], []
    after, before = size - at - 2, at + size - own
    right_near, right_far = after // 2, after - after // 2
    left_near = before // 2
    # to the right of the pivot: the far half is equal, or the near half is; to its left: likewise
    cases = [(at, at + 2 + right_near, np.zeros_like(at)), (at, at + 2, right_far),
             (before, np.zeros_like(at), size - left_near), (before, left_near, size - before)]
    for case, (place, head, tail) in enumerate(cases):
        good = ((after if case < 2 else before) >= 0) & (head + tail <= own)
        head, tail = np.where(good, head, 0), np.where(good, tail, 0)
        first = span_hashes(joined, 4 * start, 4 * (start + head))
        last = span_hashes(joined, 4 * (start + own - tail), 4 * (start + own))
        geometry = ((place.astype(np.uint64) << np.uint64(34)) ^ (size.astype(np.uint64) << np.uint64(2))) + np.uint64(case)
        key = first * np.uint64(0x9E3779B97F4A7C15) ^ (last + np.uint64(case + 1)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ geometry * np.uint64(0xD6E8FEB86659FD93)
        keys.append((key ^ (key >> np.uint64(31))).view(np.int64))
        can.append(good)
    return np.concatenate(keys), np.concatenate(can)


def gram_keys(counts: np.ndarray, probe: bool):
    """A mapInPandas function from (id, word) to (key, id, last): the pivots' keys if ``probe``, else the prefixes'."""
    rank = np.empty(CLASSES, np.int64)
    rank[np.lexsort((np.arange(CLASSES), counts))] = np.arange(CLASSES)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            letters, joined, start, size = _letters(batch["word"])
            word = np.repeat(np.arange(len(size)), size)
            gram = _classes(letters)
            inner = np.ones(len(letters), bool)
            inner[start + size - 1] = False
            at = np.flatnonzero(inner)
            order = at[np.lexsort((rank[gram[at]], word[at]))]
            third = order[start - np.arange(len(size)) + 2]  # a word of n letters has n - 1 bigrams
            last = rank[gram[third]]
            at = at[rank[gram[at]] <= last[word[at]]]
            if probe:
                ends = np.searchsorted(word[at], np.arange(len(size) + 1))
                cost, places = counts[gram[at]].tolist(), at.tolist()
                at = at[[a + i for a, b in zip(ends, ends[1:]) for i in pivots(places[a:b], cost[a:b])]]
            w = word[at]
            for change in (0,) if probe else (-1, 0, 1):
                key, can = _place_keys(joined, start[w], size[w], at - start[w], size[w] + change)
                whose = np.tile(w, 4)[can]
                yield pd.DataFrame({"key": key[can], "id": batch["id"].to_numpy()[whose], "last": last[whose]})

    return keys


def near_words(words: DataFrame) -> DataFrame:
    """(a, b), both ways: ids of words (id, word) exactly one edit apart."""
    counts = gram_counts(words)
    schema = "key bigint, id bigint, last bigint"
    index = words.select("id", "word").mapInPandas(gram_keys(counts, probe=False), schema)
    probe = words.select("id", "word").mapInPandas(gram_keys(counts, probe=True), schema).select(
        "key", F.col("id").alias("p"), F.col("last").alias("p_last"))
    met = index.join(probe, "key").where((F.col("id") != F.col("p")) & (F.col("p_last") <= F.col("last")))
    met = met.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
    first = words.select(F.col("id").alias("a"), F.col("word").alias("a_word"))
    second = words.select(F.col("id").alias("b"), F.col("word").alias("b_word"))
    pairs = met.join(first, "a").join(second, "b").where(F.levenshtein("a_word", "b_word", 1) == 1).select("a", "b")
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select(F.explode(both).alias("p")).select("p.a", "p.b")


def group_spellings(words: DataFrame, factor: int = 5, least_length: int = 6) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for the words (word, n) of at least ``least_length`` code points."""
    if least_length < 4:
        raise ValueError("pivotal grams need words of four code points or more")
    words = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    words = scratch_table(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")
    other = words.select(F.col("id").alias("b"), F.col("word").alias("b_word"), F.col("n").alias("b_n"))
    near = near_words(words).join(other, "b").groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b_word").alias("form"), F.col("b").alias("form_id"))).alias("best"))
    out = words.join(near.withColumnRenamed("a", "id"), "id", "left")
    formed = (-F.col("best.less") >= factor * F.col("n")) & (-F.col("best.less") > F.col("n"))
    out = scratch_table(out.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(formed, F.col("best.form")).alias("form"),
                                   F.when(formed, F.col("best.form_id")).alias("form_id"), F.when(formed, -F.col("best.less")).alias("form_n")), "spelling-forms")
    steps = scratch_table(out.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("to")), "spelling-steps")
    while True:
        jump = steps.select(F.col("id").alias("to"), F.col("to").alias("next"))
        if jump.join(steps, "to", "left_semi").isEmpty():
            break
        steps = scratch_table(steps.join(jump, "to", "left").select("id", F.coalesce("next", "to").alias("to")), "spelling-steps")
    roots = steps.join(words.select(F.col("id").alias("to"), F.col("word").alias("root")), "to").select("id", "root")
    return out.join(roots, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
