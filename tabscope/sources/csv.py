"""CSV scan with a header row, inferred or declared types and a set of null tokens.

Spark's ``nullValue`` option accepts one token, so the file is read as
strings, every token in ``null_tokens`` becomes null, and each column is
cast to the narrowest type whose spelling all its non-null values have (long,
then double, then boolean, else string): digits only for numbers, true and
false only for booleans, so Y/N, yes/no or ``1d`` stay text.  A column
without any value is double.  Type inference is one aggregation over the
file, not a driver-side scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The default missing-value tokens recognised when reading CSV.
DEFAULT_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

#: Spelling of the values of each inferred type, tried in this order.
_TYPE_PATTERNS = {
    "bigint": r"[+-]?[0-9]+",
    "double": r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity)",
    "boolean": r"(?i:true|false)",
}


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    null_tokens: Sequence[str] = DEFAULT_NULL_TOKENS,
    infer: bool = True,
) -> DataFrame:
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        # Declared schema: tokens are mapped after a string read, then cast.
        raw = reader.option("inferSchema", False).csv(path)
        st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        cleaned = _null_tokens(raw, null_tokens)
        return cleaned.select(
            *[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in st.fields]
        )
    raw = reader.option("inferSchema", False).csv(path)
    cleaned = _null_tokens(raw, null_tokens)
    if not infer:
        return cleaned
    cols = cleaned.columns
    # One pass: for every column and candidate type, does any non-null value fail the cast?
    checks = []
    for c in cols:
        checks.append(F.count(F.col(f"`{c}`")).alias(f"{c}\u0001n"))
        for t, pattern in _TYPE_PATTERNS.items():
            value = F.trim(F.col(f"`{c}`"))
            fails = F.col(f"`{c}`").isNotNull() & (~value.rlike(f"^({pattern})$") | value.try_cast(t).isNull())
            checks.append(F.max(fails.cast("int")).alias(f"{c}\u0001{t}"))
    row = cleaned.agg(*checks).collect()[0].asDict()  # one row of k x 4 figures
    out = []
    for c in cols:
        fitting = [t for t in _TYPE_PATTERNS if not row[f"{c}\u0001{t}"]]
        chosen = "double" if not row[f"{c}\u0001n"] else fitting[0] if fitting else "string"
        if chosen == "boolean":
            out.append(F.expr(f"try_cast(trim(`{c}`) AS boolean)").alias(c))
        elif chosen == "string":
            out.append(F.col(c))
        else:
            out.append(F.expr(f"try_cast(trim(`{c}`) AS {chosen})").alias(c))
    return cleaned.select(*out)


def _null_tokens(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    toks = list(tokens)
    return df.select(
        *[F.when(F.col(f"`{c}`").isin(toks) | F.col(f"`{c}`").isNull(), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
          for c in df.columns]
    )
