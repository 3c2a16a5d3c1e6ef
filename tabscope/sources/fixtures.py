"""Derived views over ``lineitem`` that carry the defects the operators look for.

The driver tables are clean (no nulls, no duplicates, near-zero
correlation), so tests and registered queries run on these four views.
Each is built with the DataFrame API; ``VIEW_SQL`` holds the same
definitions as SQL text for the DuckDB oracle (one CTE per view).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.sources.tables import read_table


def v_defect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls in qty, x50 outliers in price, mixed-kind strings in code, duplicated rows."""
    li = read_table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    code = (
        F.when(F.col("l_linenumber") == 1, F.lit("12"))
        .when(F.col("l_linenumber") == 2, F.lit("3.5"))
        .when(F.col("l_linenumber") == 3, F.lit("true"))
        .when(F.col("l_linenumber") == 4, F.lit("2024-01-01"))
        .otherwise(F.col("l_returnflag"))
    )
    base = li.select(
        "l_orderkey",
        "l_linenumber",
        F.when(key % 17 == 0, F.lit(None).cast("double")).otherwise(F.col("l_quantity")).alias("qty"),
        F.when(key % 97 == 0, F.col("l_extendedprice") * 50).otherwise(F.col("l_extendedprice")).alias("price"),
        F.col("l_discount").alias("discount"),
        code.alias("code"),
        F.col("l_returnflag").alias("flag"),
    )
    return base.unionAll(base.where(key % 50 == 0))


def v_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collinear columns: net and gross are near-linear in l_extendedprice."""
    li = read_table(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        net.alias("net"),
        (net * (1 + F.col("l_tax"))).alias("gross"),
    )


def v_nonlin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak linear fit, strong quadratic signal in l_quantity."""
    li = read_table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    return li.select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice",
        (6 * q + (q - 25.5) * (q - 25.5)).alias("y"),
    )


def v_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong two-feature linear fit."""
    li = read_table(spark, sf_dir, "lineitem")
    y = 3 * F.col("l_quantity") - 40 * F.col("l_discount") + (F.col("l_orderkey") % 13)
    return li.select("l_orderkey", "l_suppkey", "l_quantity", "l_discount", y.alias("y"))


# Same definitions as SQL text (DuckDB oracle CTEs).
VIEW_SQL = {
    "v_defect": """
      v_defect_base AS (
        SELECT l_orderkey, l_linenumber,
          CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS qty,
          CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS price,
          l_discount AS discount,
          CASE l_linenumber WHEN 1 THEN '12' WHEN 2 THEN '3.5' WHEN 3 THEN 'true'
                            WHEN 4 THEN '2024-01-01' ELSE l_returnflag END AS code,
          l_returnflag AS flag
        FROM lineitem),
      v_defect AS (
        SELECT * FROM v_defect_base
        UNION ALL
        SELECT * FROM v_defect_base WHERE l_orderkey % 50 = 0)""",
    "v_sales": """
      v_sales AS (
        SELECT l_orderkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
          l_extendedprice * (1 - l_discount) AS net,
          l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross
        FROM lineitem)""",
    "v_nonlin": """
      v_nonlin AS (
        SELECT l_orderkey, l_suppkey, l_quantity, l_extendedprice,
          6 * l_quantity + (l_quantity - 25.5) * (l_quantity - 25.5) AS y
        FROM lineitem)""",
    "v_linear": """
      v_linear AS (
        SELECT l_orderkey, l_suppkey, l_quantity, l_discount,
          3 * l_quantity - 40 * l_discount + (l_orderkey % 13) AS y
        FROM lineitem)""",
}
