"""Joining per-segment result tables.

Result tables are keyed by the segment columns (possibly none).  Joins are
null-safe on the keys, and a side is broadcast only when its measured size
is at most ``BROADCAST_BYTES`` (``seg_bytes`` sums the lengths of strings and
arrays); otherwise the plan is a shuffle join and AQE's skew-join handling
splits a hot segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 8 << 20
_K = "__seg_k"


def seg_join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner", broadcast_right: bool = False) -> DataFrame:
    """Null-safe join on the segment keys; with no keys, both sides are single-row tables."""
    by = list(by)
    r = F.broadcast(right) if broadcast_right else right
    if not by:
        return left.withColumn(_K, F.lit(0)).join(r.withColumn(_K, F.lit(0)), _K, how).drop(_K)
    renamed = r.select(*[F.col(f"`{c}`").alias(f"{_K}{i}") for i, c in enumerate(by)],
                       *[F.col(f"`{c}`") for c in right.columns if c not in by])
    cond = [left[f"`{c}`"].eqNullSafe(renamed[f"{_K}{i}"]) for i, c in enumerate(by)]
    out = left.join(renamed, cond, how)
    if how in ("right", "right_outer", "full", "outer", "full_outer"):
        for i, c in enumerate(by):
            out = out.withColumn(c, F.coalesce(F.col(f"`{c}`"), F.col(f"{_K}{i}")))
    return out.drop(*[f"{_K}{i}" for i in range(len(by))])


def attach(data: DataFrame, small: DataFrame, by: Sequence[str], small_bytes: int | None = None) -> DataFrame:
    """Attach per-segment constants (fences, means, coefficients) to every data row; a row whose segment has
    none keeps nulls."""
    bc = small_bytes is not None and small_bytes <= BROADCAST_BYTES
    return seg_join(data, small, by, "left", broadcast_right=bc)


def _width(c: Column, dt: T.DataType) -> Column:
    """Bytes of a value: its length for strings and binaries, 8 for each number, the sum over nested values."""
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(dt, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in dt.fields), F.lit(8))
    if isinstance(dt, T.ArrayType):
        if isinstance(dt.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
            return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda s, x: s + _width(x, dt.elementType).cast("long")), F.lit(8))
        return F.coalesce(F.size(c), F.lit(0)) * 8 + 16
    return F.lit(8)


def seg_bytes(small: DataFrame, by: Sequence[str]) -> int:
    """Size in bytes of a (materialised) per-segment table."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in small.schema.fields), F.lit(16).cast("long"))
    return small.agg(F.coalesce(F.sum(row), F.lit(0)).alias("b")).first()["b"]
