"""Factors of the data itself: tall-skinny QR merged in a tree, and a randomised range finder on top of it.

``moments`` sums X'X, which squares the condition number and needs a k x k matrix for every question.  Here each task
factors its own rows, [1 | X] = QR, and keeps R alone, (k + 1) x (k + 1) however many rows it read; factors of a
segment are stacked and factored again, ``FAN`` at a time, until one is left.  The column of ones centres the rest on
the way: R[0, 1:] / R[0, 0] are the means and R[1:, 1:] is the factor of the centred columns, so one scan gives least
squares (``qr_ols``) and principal components (``qr_pca``).

For very wide inputs ``range_pca`` never forms anything of k x k: it multiplies the rows with k x l matrices (l =
components + oversampling), whose size depends on the width and a parameter only, and factors the n x l projection
by the same tree.

Rows with a null, NaN or infinite component, and vectors of another length, take no part.  Segment keys may be null.
A segment without a complete row gives no row.  Columns are named by a list, or by one array column's name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.columns import as_double, seg_cols
from tabscope.functions.linalg import RCOND

FAN = 8
HELD_BYTES = 64 << 20  # a task passes its matrices on when they reach this
CHUNK = 4096  # rows factored at once
SKETCH_BYTES = 256 << 20  # the widest k x l matrix of the range finder
_V = "__v"


def _vectors(df: DataFrame, columns: Sequence[str] | str, by: Sequence[str]) -> tuple[DataFrame, int]:
    """(by..., __v array<double>) of the rows whose vector has the full length, and that length."""
    if isinstance(columns, str):
        v = F.col(f"`{columns}`").cast("array<double>")
        width = df.agg(F.max(F.size(F.col(f"`{columns}`"))).alias("k")).first()["k"] or 0
    else:
        v = F.array(*[as_double(df, c) for c in columns])
        width = len(columns)
    data = df.select(*[F.col(f"`{b}`") for b in by], v.alias(_V))
    return data.where(F.size(_V) == width), max(width, 0)


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(_V)).flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, float).reshape(-1, k) if k else np.zeros((batch.num_rows, 0))


def _segments(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A code per row for its segment, and each code's first row."""
    if not keys:
        return np.zeros(batch.num_rows, int), np.zeros(1, int)
    codes = [pd.factorize(batch.column(batch.schema.get_field_index(c)).to_pandas(), use_na_sentinel=True)[0] for c in keys]
    _, first, code = np.unique(np.column_stack(codes), axis=0, return_index=True, return_inverse=True)
    return code.reshape(-1), first


def _triangle(stacked: np.ndarray) -> np.ndarray:
    """R of a QR factorisation, square and with a diagonal that isn't negative (so it is unique where X has full rank)."""
    k = stacked.shape[1]
    r = np.linalg.qr(stacked, mode="r") if len(stacked) else np.zeros((0, k))
    r = np.vstack([r, np.zeros((k - len(r), k))]) if len(r) < k else r
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def _stack(a: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    for s in range(0, len(rows), CHUNK):
        part = rows[s:s + CHUNK]
        a = _triangle(part if a is None else np.vstack([a, part]))
    return a


def _parts(data: DataFrame, by: list[str], k: int, fold: Callable[[np.ndarray | None, np.ndarray], np.ndarray]) -> DataFrame:
    """(by..., node, n, m binary): a matrix per task and segment, ``fold`` taking in the segment's rows."""
    fields = [f for f in data.schema.fields if f.name in by]
    schema = T.StructType(fields + [T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("m", T.BinaryType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        held: dict[tuple, list] = {}
        size, turn, types = 0, 0, {}
        task = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            rows = list(held.values())
            cols = [pa.array([r[0][i] for r in rows], types[c]) for i, c in enumerate(by)]
            cols += [pa.array([(task << 20) + turn] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2].tobytes() for r in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, [*by, "node", "n", "m"])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = {c: batch.schema.field(c).type for c in by}
            x = _matrix(batch, k)
            whole = np.isfinite(x).all(axis=1)
            code, first = _segments(batch, by)
            order = np.argsort(code, kind="stable")
            ends = np.searchsorted(code[order], np.arange(len(first)), side="right")
            for g, (s, e) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
                own = order[s:e]
                own = own[whole[own]]
                if not len(own):
                    continue
                value = [batch.column(batch.schema.get_field_index(c))[int(first[g])].as_py() for c in by]
                row = held.setdefault(tuple(repr(v) for v in value), [value, 0, None])
                before = row[2]
                row[1] += len(own)
                row[2] = fold(before, x[own])
                size += row[2].nbytes if before is None else 0
                if size >= HELD_BYTES:
                    yield out()
                    held.clear()
                    size, turn = 0, turn + 1
        if held:
            yield out()

    return data.mapInArrow(local, schema)


def _tree(parts: DataFrame, by: list[str], shape: tuple[int, int], stack: bool) -> DataFrame:
    """(by..., n, m): the matrices of each segment stacked and factored again, or summed, about ``FAN`` at a time."""
    rows, cols = shape
    schema = T.StructType([f for f in parts.schema.fields if f.name in by] + [
        T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("m", T.BinaryType())])

    def merge(group: pa.Table) -> pa.Table:
        total = None
        for b in group["m"]:
            m = np.frombuffer(b.as_buffer(), float).reshape(rows, cols)
            total = m.copy() if total is None else _triangle(np.vstack([total, m])) if stack else total + m
        one = group.slice(0, 1).select([*by, "__bucket"]).rename_columns([*by, "node"])
        return one.append_column("n", pa.array([sum(group["n"].to_pylist())], pa.int64())).append_column("m", pa.array([total.tobytes()], pa.binary())).cast(
            pa.schema([*[group.schema.field(c) for c in by], pa.field("node", pa.int64()), pa.field("n", pa.int64()), pa.field("m", pa.binary())]))

    level = parts.checkpoint(eager=True)
    while True:
        most = level.groupBy(*by).count().agg(F.max("count").alias("c")).first()["c"] or 0
        if most <= 1:
            return level.select(*by, "n", "m")
        buckets = math.ceil(most / FAN)
        spread = level.withColumn("__bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)).cast("long"))
        level = spread.groupBy(*by, "__bucket").applyInArrow(merge, schema).checkpoint(eager=True)


def qr_factor(df: DataFrame, columns: Sequence[str] | str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, width, m): m is the (width + 1) x (width + 1) factor R of [1 | X] as little-endian doubles, row-major."""
    by = seg_cols(by)
    data, k = _vectors(df, columns, by)

    def fold(a: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        return _stack(a, np.column_stack([np.ones(len(x)), x]))

    out = _tree(_parts(data, by, k, fold), by, (k + 1, k + 1), stack=True)
    return out.select(*by, "n", F.lit(k).alias("width"), "m")


def _opened(m: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Means, and the factor of the centred columns."""
    r = np.frombuffer(m, float).reshape(k + 1, k + 1)
    return r[0, 1:] / r[0, 0], r[1:, 1:]


_OLS = T.StructType([T.StructField("coefficients", T.ArrayType(T.DoubleType())), T.StructField("intercept", T.DoubleType()),
                     T.StructField("r2", T.DoubleType()), T.StructField("rank", T.IntegerType())])


def qr_ols(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """REG1 by QR: (by..., n, coefficients, intercept, r2, rank) of least squares with intercept.

    Collinear features get the minimum-norm coefficients of an SVD solver; singular values below 1e-12 of the largest
    count as zero.  r2 of a constant target is null."""
    by = seg_cols(by)
    k = len(features)

    @F.pandas_udf(_OLS)
    def solve(m: pd.Series) -> pd.DataFrame:
        out = []
        for raw in m:
            mean, r = _opened(raw, k + 1)
            x, y = r[:, :k], r[:, k]
            b, _, rank, _ = np.linalg.lstsq(x, y, rcond=RCOND) if k else (np.zeros(0), None, 0, None)
            total, left = float(y @ y), float(((y - x @ b) ** 2).sum())
            tiny = (RCOND * max(1.0, abs(mean[k]))) ** 2
            out.append((b.tolist(), float(mean[k] - b @ mean[:k]), 1 - left / total if total > tiny else None, int(rank)))
        return pd.DataFrame(out, columns=[f.name for f in _OLS.fields])

    return qr_factor(df, [*features, target], by).select(*by, "n", solve("m").alias("s")).select(*by, "n", "s.*")


_PCA = T.StructType([T.StructField("n_components", T.IntegerType()), T.StructField("explained", T.DoubleType()),
                     T.StructField("eigenvalues", T.ArrayType(T.DoubleType())), T.StructField("loadings", T.ArrayType(T.DoubleType())),
                     T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("sd", T.ArrayType(T.DoubleType()))])


def qr_pca(df: DataFrame, columns: Sequence[str] | str, by: Sequence[str] = (), ratio: float = 0.95) -> DataFrame:
    """EXP3 by QR: (by..., n, n_components, explained, eigenvalues, loadings, mean, sd) of the standardised columns.

    Eigenvalues are squared singular values of the standardised factor, so the small ones keep their digits.
    Constant columns count as zero.  Each loading's largest entry is positive."""
    by = seg_cols(by)
    factor = qr_factor(df, columns, by)

    @F.pandas_udf(_PCA)
    def solve(n: pd.Series, width: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = []
        for nn, k, raw in zip(n, width, m):
            mean, r = _opened(raw, int(k))
            sd = np.sqrt((r * r).sum(axis=0) / nn)
            flat = sd <= RCOND * np.maximum(1.0, np.abs(mean))
            z = np.where(flat, 0.0, r / np.where(flat, 1.0, sd)) / math.sqrt(nn)
            _, s, v = np.linalg.svd(z)
            v = v * np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None] if len(v) else v
            w, total = s * s, float((s * s).sum())
            cum = np.cumsum(w / total) if total > 0 else np.ones(max(len(w), 1))
            kept = min(int(np.searchsorted(cum, ratio, side="right")) + 1, len(cum)) if total > 0 else 1
            out.append((kept, float(cum[kept - 1]), w.tolist(), v.reshape(-1).tolist(), mean.tolist(), np.where(flat, 0.0, sd).tolist()))
        return pd.DataFrame(out, columns=[f.name for f in _PCA.fields])

    return factor.select(*by, "n", solve("n", "width", "m").alias("s")).select(*by, "n", "s.*")


def range_pca(df: DataFrame, columns: Sequence[str] | str, components: int, oversample: int = 10, power: int = 2,
              seed: int = 0) -> DataFrame:
    """(component, singular_value, explained, loading): the largest singular values of the centred columns, their share
    of the whole scatter and their right singular vectors, by a randomised range finder with ``power`` rounds.

    2 + power scans and one for the projection's QR.  The driver holds k x l matrices, l = components + oversample at
    most; a width that would take them beyond ``SKETCH_BYTES`` is refused.  Exact where l reaches the width.
    No complete row: no rows."""
    data, k = _vectors(df, columns, [])
    wide = min(k, components + oversample)
    if k * wide * 8 > SKETCH_BYTES:
        raise ValueError(f"{k} columns by {wide} directions exceed {SKETCH_BYTES} bytes")
    spark = df.sparkSession
    schema = "component int, singular_value double, explained double, loading array<double>"

    def summed(fold, shape: tuple[int, int]) -> tuple[int, np.ndarray] | None:
        row = _tree(_parts(data, [], k, fold), [], shape, stack=False).first()
        return None if row is None else (row["n"], np.frombuffer(row["m"], float).reshape(shape))

    def sums(a, x):
        s = x.sum(axis=0, keepdims=True)
        return s if a is None else a + s

    got = summed(sums, (1, k)) if k else None
    if got is None:
        return spark.createDataFrame([], schema)
    mean = got[1][0] / got[0]
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((k, wide)))[0]
    scatter = 0.0
    for _ in range(power + 1):
        def product(a, x, q=basis):
            c = x - mean
            # one row more for the sum of squares, which is the whole scatter
            p = np.vstack([c.T @ (c @ q), np.full((1, q.shape[1]), (c * c).sum())])
            return p if a is None else a + p

        _, got_sum = summed(product, (k + 1, wide))
        scatter = float(got_sum[k, 0])
        basis = np.linalg.qr(got_sum[:k])[0]

    def project(a, x, q=basis):
        return _stack(a, (x - mean) @ q)

    factor = _tree(_parts(data, [], k, project), [], (wide, wide), stack=True).first()
    _, s, v = np.linalg.svd(np.frombuffer(factor["m"], float).reshape(wide, wide))
    loading = basis @ v.T
    loading = loading * np.where(loading[np.abs(loading).argmax(axis=0), np.arange(wide)] < 0, -1.0, 1.0)
    rows = [(i, float(s[i]), float(s[i] ** 2 / scatter) if scatter > 0 else None, loading[:, i].tolist()) for i in range(min(components, wide))]
    return spark.createDataFrame(rows, schema)
