"""Hard negatives by a vertical scan with branch and bound (BOND).

Vectors are quantised (``floor(scale * x)``) and stored as columnar blocks: one row a block, its dimensions one after
the other, with the least and greatest value of each.  An anchor reads a block's dimensions in descending order of its
own magnitudes.  After every few dimensions each candidate's score lies between its partial sum plus the least and
plus the greatest that the dimensions still to come can add; candidates that no result can need leave the bitmap.
What remains after the last dimension has its exact score.

Two scans.  The first finds each anchor's positives: a candidate stays while its upper bound reaches the k-th best
lower bound.  The second finds, for each positive, the best rows of other labels whose score lies in that positive's
window: a candidate stays while some window can hold it and, where a window surely holds k rows already, while it can
reach the k-th of them.  Each block keeps at most k rows for a result, and a window over the blocks' rows ranks them.

Anchors are a stated query set and meet all rows, in blocks: a group is one block of rows with one chunk of anchors, both
of bounded size, dealt by hash; labels play no part in the dealing, so a hot label is as well spread as any.  Rows are
replicated once for each 1024 anchors and anchors once for each 8192 rows.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; missing
components of shorter vectors count as 0; "other rows" are all but the anchor's own row, so that rows repeating its
vec_id count; a null vec_id comes last among ties; ties go to the smaller vec_id, then to either row; an anchor without
rows of its label has no positives and no result, as has a positive with an empty window (a negative positive_score
always); an empty table gives an empty result; further columns are ignored.  Scores are exact 64-bit integers; vectors
so large that one might not fit raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.llm.common import scratch_table

BLOCK, CHUNK = 8192, 1024
#: dimensions read between two looks at the bounds
STRIDE = 8
NO_ID = 2**63 - 1

Rule = Callable[[np.ndarray, np.ndarray], np.ndarray]


def usable_vectors(vectors: DataFrame, anchor: Column, scale: int) -> DataFrame:
    """(row, vec_id, label, anchor, q): rows that take part, with whole-number components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    whole = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))
    return good.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("bigint"), F.lit(NO_ID)).alias("vec_id"),
                       F.col("label").cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("q"))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """One row a vector, filled with 0 to the right."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def columnar_blocks(rows: DataFrame, n_blocks: int, width: int) -> DataFrame:
    """(block, row, vec_id, label, columns, least, greatest): one row for each block."""
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        values = matrix(group["q"], width).T
        return pd.DataFrame([{
            "block": group["block"].iloc[0], "row": group["row"].to_numpy(), "vec_id": group["vec_id"].to_numpy(),
            "label": group["label"].to_list(), "columns": np.ascontiguousarray(values).tobytes(),
            "least": values.min(axis=1), "greatest": values.max(axis=1)}])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)))
    return dealt.groupBy("block").applyInPandas(
        pack, "block bigint, row array<bigint>, vec_id array<bigint>, label array<string>, columns binary, least array<bigint>, greatest array<bigint>")


def bounded_scan(columns: np.ndarray, least: np.ndarray, greatest: np.ndarray, anchor: np.ndarray, alive: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The candidates (row numbers of the block) that ``rule`` leaves, and their exact scores.

    columns holds a dimension in each row; alive is the bitmap of candidates.  rule(low, high) tells from bounds of the
    scores which candidates must stay; in the end both bounds are the score."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    order = order[anchor[order] != 0]
    ends = np.stack([anchor * least, anchor * greatest])[:, order]
    to_come = np.zeros((2, len(order) + 1), np.int64)
    to_come[:, :-1] = np.stack([ends.min(axis=0), ends.max(axis=0)])[:, ::-1].cumsum(axis=1)[:, ::-1]
    left = np.flatnonzero(alive)
    part = np.zeros(len(left), np.int64)
    whole = len(left) == columns.shape[1]
    for at in range(0, len(order), STRIDE):
        for d in order[at : at + STRIDE]:
            part += anchor[d] * (columns[d] if whole else columns[d, left])
        done = min(at + STRIDE, len(order))
        stay = rule(part + to_come[0, done], part + to_come[1, done])
        if not stay.all():
            left, part, whole = left[stay], part[stay], False
        if not len(left):
            break
    if len(order) == 0:
        stay = rule(part, part)
        left, part = left[stay], part[stay]
    return left, part


def best_rule(k: int) -> Rule:
    """Stay while the upper bound reaches the k-th best lower bound."""
    def rule(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if len(low) <= k:
            return np.ones(len(low), bool)
        return high >= np.partition(low, len(low) - k)[len(low) - k]
    return rule


def window_rule(windows: list[tuple[int, int]], k: int) -> Rule:
    """Stay while one of the windows (least, greatest score) may hold the candidate among its k best."""
    def rule(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), bool)
        for first, last in windows:
            surely = low[(low >= first) & (high <= last)]
            floor = first if len(surely) < k else max(first, np.partition(surely, len(surely) - k)[len(surely) - k])
            stay |= (high >= floor) & (low <= last)
        return stay
    return rule


def _first(k: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.lexsort((rows, ids, -scores))[:k]


def _scan(blocks: DataFrame, anchors: DataFrame, n_blocks: int, n_chunks: int, width: int, of_anchor, schema: str) -> DataFrame:
    """of_anchor(anchor row, its vector, block) yields result rows; block is a dict of arrays."""
    names = [f.name for f in T.StructType.fromDDL(schema).fields]

    def meet(key: tuple, block: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(block) and len(chunk):
            b = block.iloc[0]
            held = {"columns": np.frombuffer(b["columns"], np.int64).reshape(width, -1), "row": np.asarray(b["row"]), "vec_id": np.asarray(b["vec_id"]),
                    "label": np.asarray(b["label"], dtype=object), "least": np.asarray(b["least"]), "greatest": np.asarray(b["greatest"])}
            largest = np.maximum(np.abs(held["least"]), np.abs(held["greatest"])).astype(float)
            vectors = matrix(chunk["q"], width)
            if len(vectors) and (np.abs(vectors.astype(float)) @ largest).max() >= 2.0**62:
                raise OverflowError("scores may not fit 64 bits; use a smaller scale")
            for a, v in zip(chunk.itertuples(index=False), vectors):
                out.extend(of_anchor(a, v, held))
        return pd.DataFrame(out, columns=names)

    left = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)).cast("array<bigint>")))
    right = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>")))
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(meet, schema)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, scale: int = 256, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where ``anchor`` holds
    and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose score
    is between window[0] and window[1] hundredths of the positive's.  ``vectors`` has vec_id, label, embedding."""
    rows = scratch_table(usable_vectors(vectors, anchor, scale), "bond-rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("width")).first()
    n_blocks, n_chunks, width = math.ceil(size["n"] / BLOCK) or 1, math.ceil(size["anchors"] / CHUNK) or 1, max(size["width"], 1)
    blocks = scratch_table(columnar_blocks(rows, n_blocks, width), "bond-blocks")
    anchors = rows.where("anchor").select("row", "vec_id", "label", "q", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_chunks)).alias("chunk"))

    def find_positives(a, v: np.ndarray, block: dict) -> Iterator[tuple]:
        alive = (block["label"] == a.label) & (block["row"] != a.row)
        left, score = bounded_scan(block["columns"], block["least"], block["greatest"], v, alive, best_rule(positives))
        for i in _first(positives, score, block["vec_id"][left], block["row"][left]):
            yield a.row, int(block["vec_id"][left[i]]), int(block["row"][left[i]]), int(score[i])

    found = _scan(blocks, anchors, n_blocks, n_chunks, width, find_positives, "anchor bigint, positive_id bigint, positive_row bigint, positive_score bigint")
    nth = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive_row"))
    found = scratch_table(found.withColumn("nth", nth).where(F.col("nth") <= positives), "bond-positives")
    scores = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_score"))).alias("found"))
    asked = anchors.join(scores, anchors["row"] == scores["anchor"]).select(
        "row", "label", "q", "chunk", F.col("found.nth").alias("nth"), F.col("found.positive_score").alias("scores"))
    low, high = window

    def find_negatives(a, v: np.ndarray, block: dict) -> Iterator[tuple]:
        # low * positive <= 100 * negative <= high * positive, as whole numbers
        windows = [(-(-low * int(s) // 100), high * int(s) // 100) for s in a.scores]
        alive = block["label"] != a.label
        left, score = bounded_scan(block["columns"], block["least"], block["greatest"], v, alive, window_rule(windows, negatives))
        ids, own = block["vec_id"][left], block["row"][left]
        for n, (first, last) in zip(a.nth, windows):
            inside = np.flatnonzero((score >= first) & (score <= last))
            for i in inside[_first(negatives, score[inside], ids[inside], own[inside])]:
                yield a.row, int(n), int(ids[i]), int(own[i]), int(score[i])

    mined = _scan(blocks, asked, n_blocks, n_chunks, width, find_negatives, "anchor bigint, nth int, negative_id bigint, negative_row bigint, negative_score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("negative_score"), "negative_id", "negative_row"))
    mined = mined.withColumn("rank", rank).where(F.col("rank") <= negatives)
    names = rows.where("anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = mined.join(found.drop("positive_row"), ["anchor", "nth"]).join(names, "anchor")
    ids = [F.nullif(F.col(c), F.lit(NO_ID)).alias(c) for c in ("anchor_id", "positive_id")]
    return out.select(*ids, "rank", F.nullif("negative_id", F.lit(NO_ID)).alias("negative_id"), "positive_score", "negative_score")
