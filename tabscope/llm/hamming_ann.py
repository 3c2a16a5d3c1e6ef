"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes.  On a bounded sample (``SAMPLE`` vectors with the least hashes) the mean, the principal axes and a
rotation that brings the projections close to their signs (iterative quantisation) are learned in numpy; a code
is the signs of the rotated vector, as many bits as there are components, 64 at most.  The sample also gives the
Hamming radius: the ``QUANTILE`` of the distances between codes of true neighbours in it.  True neighbours among
all vectors are nearer than those in a sample, so the radius errs on the wide side.

Index.  Vectors are dealt by hash into blocks of at most about ``BLOCK`` rows; queries are a table beside them, in
blocks too, and every pair of blocks meets in one task, whatever vectors repeat.  A block keeps its codes in
``m`` inverted lists, one for each 8-bit substring.  Two codes within radius r = m*a + b have a substring among
the first b+1 within a bits or one of the others within a-1, so probing all substring values that near finds
every code within the radius.  What the lists give is checked by the whole code and ranked by the Euclidean
distance in double precision; each block returns its best ``k`` for each query and the best of those are kept.

Queries with fewer than k answers (there may be no k codes within the radius) go round again with all bits as
the radius, which reads all lists in full; so each query gets k rows, or all there are.

Defined cases: vectors that are null, zero, or hold nulls or non-finite components take no part, nor do vectors
of another length than the commonest (the longer of equally common ones); a row never finds itself, but rows
with equal vectors or equal ids find one another; ties go to the smaller id; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscope.llm.common import scratch_table

SAMPLE = 8_000
QUANTILE = 0.96
BLOCK = 65_536
QUERY_BLOCK = 16_384
POPCOUNT8 = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: NEAR[r][v]: the 8-bit values within r bits of v
NEAR = [[np.flatnonzero(POPCOUNT8[np.arange(256) ^ v] <= r) for v in range(256)] for r in range(9)]


@dataclass
class Codes:
    mean: np.ndarray
    rotation: np.ndarray  # dim x bits
    radius: int

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(n, substrings) bytes; bits beyond ``bits`` are zero in every code."""
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return POPCOUNT8[a ^ b].sum(axis=-1, dtype=np.int64)


def learn(sample: np.ndarray, k: int = 10, rounds: int = 40, quantile: float = QUANTILE, seed: int = 1) -> Codes:
    x = sample.astype(float)
    mean = x.mean(axis=0)
    bits = min(64, x.shape[1])
    axes = np.linalg.svd(np.cov(x - mean, rowvar=False, bias=True).reshape(x.shape[1], -1))[0][:, :bits]
    low = (x - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
        turn = (u @ v).T
    codes = Codes(mean, axes @ turn, 0)
    made = codes.encode(x)
    found = []
    for i in range(0, len(x), max(1, len(x) // 300)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[:min(k, len(x) - 1)]
        found.append(hamming(made[near], made[i]))
    codes.radius = int(np.ceil(np.quantile(np.concatenate(found), quantile))) if len(x) > 1 else bits
    return codes


class BlockIndex:
    """The inverted lists of one block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, codes: Codes) -> None:
        self.ids, self.rows, self.vectors = ids, rows, vectors
        self.codes = codes.encode(vectors)
        self.lists = []
        for j in range(self.codes.shape[1]):
            order = np.argsort(self.codes[:, j], kind="stable")
            self.lists.append((order, np.searchsorted(self.codes[order, j], np.arange(257))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within the radius, by pigeonhole probing."""
        m = len(self.lists)
        each, rest = divmod(radius, m)
        seen = np.zeros(len(self.ids), bool)
        for j, (order, start) in enumerate(self.lists):
            r = min(8, each) if j <= rest else each - 1
            if r >= 0:
                for v in NEAR[r][code[j]].tolist():
                    seen[order[start[v]:start[v + 1]]] = True
        found = np.flatnonzero(seen)
        return found[hamming(self.codes[found], code) <= radius]

    def nearest(self, row: int, vector: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the k nearest within the radius, the query's own row left out."""
        found = self.within(code, radius)
        found = found[self.rows[found] != row]
        d = np.sqrt(((self.vectors[found] - vector) ** 2).sum(axis=1))
        if len(found) > k:
            keep = d <= np.partition(d, k - 1)[k - 1]
            found, d = found[keep], d[keep]
        best = np.lexsort((self.ids[found], d))[:k]
        return found[best], d[best]


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """(row, vec_id, v) of the vectors that take part, v as doubles."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = vectors.select("vec_id", v.alias("v")).where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda c: c != 0))
    held = scratch_table(held.withColumn("row", F.monotonically_increasing_id()), "ann-vectors")
    size = held.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return held.where(F.size("v") == (size.n if size else 0))


def _matrix(col: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.asarray(col.combine_chunks().flatten(), float).reshape(n, -1)


def search(held: DataFrame, queries: DataFrame, codes: Codes, radius: int, k: int, rows: int, asked: int) -> DataFrame:
    """(q_row, query_id, vec_id, row, score): the k best of each block for each query, then the k best of all."""
    blocks = max(1, -(-rows // BLOCK), min(rows // 4096, held.sparkSession.sparkContext.defaultParallelism))
    q_blocks = max(1, -(-asked // QUERY_BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    base = held.select(deal(blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"), "row", "vec_id", "v")
    asking = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), deal(q_blocks).alias("q"), "row", "vec_id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in range(5)]
        if left.num_rows and right.num_rows:
            index = BlockIndex(left["vec_id"].to_numpy(), left["row"].to_numpy(), _matrix(left["v"], left.num_rows), codes)
            q_row, q_id, q_v = right["row"].to_numpy(), right["vec_id"].to_numpy(), _matrix(right["v"], right.num_rows)
            for i, code in enumerate(codes.encode(q_v)):
                places, d = index.nearest(q_row[i], q_v[i], code, radius, k)
                for c, x in zip(out, (np.full(len(d), q_row[i]), np.full(len(d), q_id[i]), index.ids[places], index.rows[places], d)):
                    c.append(x)
        kinds = [pa.int64()] * 4 + [pa.float64()]
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds)], names=["q_row", "query_id", "vec_id", "row", "score"])

    met = base.groupBy("b", "q").cogroup(asking.groupBy("b", "q")).applyInArrow(meet, "q_row bigint, query_id bigint, vec_id bigint, row bigint, score double")
    nth = F.row_number().over(Window.partitionBy("q_row").orderBy("score", "vec_id", "row"))
    return met.withColumn("rank", nth).where(F.col("rank") <= k)


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding") -> DataFrame:
    """vectors: (vec_id, <vector>).  query_id, rank, vec_id, score of the k nearest rows to each row for which
    ``is_query``, an expression over the name vec_id, holds."""
    held = usable(vectors, vector)
    rows = held.count()
    queries = scratch_table(held.where(is_query), "ann-queries")
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    asked = queries.count()
    if not asked or rows < 2:
        return held.sparkSession.createDataFrame([], schema)
    mix = 1 << 30
    below = min(mix, -(-2 * SAMPLE * mix // rows))
    sample = held.where(F.pmod(F.xxhash64("row", F.lit(5)), F.lit(mix)) < below).select("v", F.xxhash64("row", F.lit(5)).alias("h")).orderBy("h").limit(SAMPLE)
    drawn = sample.select("v").toArrow()
    codes = learn(_matrix(drawn["v"], drawn.num_rows), k)
    first = scratch_table(search(held, queries, codes, codes.radius, k, rows, asked), "ann-found")
    want = min(k, rows - 1)
    short = queries.join(first.groupBy("q_row").count().where(F.col("count") >= want).select(F.col("q_row").alias("row")), "row", "left_anti")
    short = scratch_table(short, "ann-short")
    left = short.count()
    if left:
        again = scratch_table(search(held, short, codes, codes.bits, k, rows, left), "ann-again")
        first = first.join(short.select(F.col("row").alias("q_row")), "q_row", "left_anti").unionByName(again)
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
