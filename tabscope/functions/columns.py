"""Column kinds and null normalisation, all as schema inspection or built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def seg_cols(by: Sequence[str] | str | None) -> list[str]:
    if by is None:
        return []
    if isinstance(by, str):
        return [by]
    return list(by)


def is_stat_numeric(dt: T.DataType) -> bool:
    """Numeric for statistics: integral, fractional and decimal; *not* boolean."""
    return isinstance(dt, _NUMERIC)


def is_overview_numeric(dt: T.DataType) -> bool:
    """Numeric for the overview and target checks: also counts booleans."""
    return isinstance(dt, _NUMERIC) or isinstance(dt, T.BooleanType)


def overview_kind(dt: T.DataType) -> str:
    return "numerical" if is_overview_numeric(dt) else "categorical"


def dtype_name(dt: T.DataType) -> str:
    return dt.simpleString()


def stat_numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_stat_numeric(f.dataType) and f.name not in skip]


def analysed_columns(df: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None) -> list[str]:
    """Columns an operator looks at: the given list, else every non-segment column."""
    if columns is not None:
        return list(columns)
    keys = set(by)
    return [c for c in df.columns if c not in keys]


def nan_to_null(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.nanvl(col, F.lit(None).cast("double"))


def finite_or_null(c: Column | str) -> Column:
    """±inf and NaN become null: x + 0*x is NaN exactly when x is not finite, and nanvl maps NaN to null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.nanvl(col + F.lit(0.0) * col, F.lit(None).cast("double"))


def as_double(df: DataFrame, c: str) -> Column:
    """Column cast to double with NaN normalised to null (Spark keeps NaN apart from null).

    ``nanvl`` references its input once, so stacked cleaning steps keep generated code small."""
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


# Lexical kinds of string cells used by the consistency check.
LEXICAL_KIND_PATTERNS = (
    ("int", r"^[+-]?[0-9]+$"),
    ("float", r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?[0-9]+[eE][+-]?[0-9]+$"),
    ("bool", r"^(?i)(true|false)$"),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$"),
)


def lexical_kind(c: Column | str) -> Column:
    """Kind of a string cell: int, float, bool, date or text (null stays null)."""
    col = F.trim(F.col(c) if isinstance(c, str) else c)
    expr = None
    for name, pat in LEXICAL_KIND_PATTERNS:
        expr = (F.when(col.rlike(pat), F.lit(name)) if expr is None else expr.when(col.rlike(pat), F.lit(name)))
    return F.when(col.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit("text")))


# DuckDB form of the same classification, for oracle SQL.
def lexical_kind_sql(c: str) -> str:
    pats = [
        ("int", r"^[+-]?[0-9]+$"),
        ("float", r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?[0-9]+[eE][+-]?[0-9]+$"),
        ("bool", r"^(true|false)$"),
        ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$"),
    ]
    parts = []
    for name, pat in pats:
        flag = ", 'i'" if name == "bool" else ""
        parts.append(f"WHEN regexp_matches(trim({c}), '{pat}'{flag}) THEN '{name}'")
    return f"CASE WHEN {c} IS NULL THEN NULL {' '.join(parts)} ELSE 'text' END"
