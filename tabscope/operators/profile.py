"""Profiling aggregations: overview, missing values, numeric summary, gates and target choice.

All operators run as one or two grouped aggregations over the table; wide
aggregate rows are turned long with ``stack``/``unpivot`` on the (small)
result, never on the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.columns import (
    analysed_columns, as_double, is_overview_numeric, is_stat_numeric, overview_kind, seg_cols,
)
from tabscope.operators.quantiles import GROUP, quantiles_wide, select_ranks, sketch
from tabscope.operators.segments import seg_join


def _null_expr(df: DataFrame, c: str):
    col = F.col(f"`{c}`")
    dt = df.schema[c].dataType
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def column_kinds(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """PRJ1: (ordinal, column, dtype, kind, stat_numeric) from the schema; no job runs."""
    by = seg_cols(by)
    cols = analysed_columns(df, by, columns)
    rows = [(i, c, df.schema[c].dataType.simpleString(), overview_kind(df.schema[c].dataType),
             is_stat_numeric(df.schema[c].dataType)) for i, c in enumerate(cols)]
    schema = "ordinal int, column string, dtype string, kind string, stat_numeric boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def numeric_projection(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """PRJ2: keep segment keys and the statistics-numeric columns."""
    by = seg_cols(by)
    cols = [c for c in analysed_columns(df, by, columns) if is_stat_numeric(df.schema[c].dataType)]
    return df.select(*[F.col(f"`{c}`") for c in by + cols])


def overview(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """AGG1: (by..., n_rows, n_cols, n_numerical, n_categorical)."""
    by = seg_cols(by)
    cols = analysed_columns(df, by, columns)
    n_num = sum(1 for c in cols if is_overview_numeric(df.schema[c].dataType))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(cols)).alias("n_cols"),
        F.lit(n_num).alias("n_numerical"),
        F.lit(len(cols) - n_num).alias("n_categorical"),
    )


def null_counts(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """(by..., column, n_missing, n_rows): one row per column, from one aggregation."""
    by = seg_cols(by)
    cols = analysed_columns(df, by, columns)
    wide = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(_null_expr(df, c)).alias(c) for c in cols],
    )
    long = wide.unpivot(by + ["__n"], cols, "column", "n_missing")
    return long.withColumnRenamed("__n", "n_rows")


def missing_by_column(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """AGG2: columns with at least one missing value, (by..., column, n_missing)."""
    by = seg_cols(by)
    return null_counts(df, by, columns).where(F.col("n_missing") > 0).select(*by, "column", "n_missing")


def missing_total(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """AGG2/AGG3: (by..., total_missing, n_cells, missing_pct rounded to 2)."""
    by = seg_cols(by)
    cols = analysed_columns(df, by, columns)
    nulls = sum((F.when(_null_expr(df, c), 1).otherwise(0) for c in cols), F.lit(0))
    agg = df.groupBy(*by).agg(F.sum(nulls).cast("long").alias("total_missing"), F.count(F.lit(1)).alias("n_rows"))
    cells = F.greatest(F.col("n_rows") * len(cols), F.lit(1))
    return agg.select(*by, "total_missing", (F.col("n_rows") * len(cols)).alias("n_cells"),
                      F.round(F.col("total_missing") / cells * 100, 2).alias("missing_pct"))


def numeric_summary(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """AGG4: (by..., column, mean, median, std_dev, q1, q3) over non-null values; all-null columns omitted.

    Sample std (0.0 for one value); quartiles by linear interpolation, exact.
    """
    by = seg_cols(by)
    cols = [c for c in analysed_columns(df, by, columns) if is_stat_numeric(df.schema[c].dataType)]
    if not cols:
        return df.sparkSession.createDataFrame([], _summary_schema(df, by))
    probs = [0.25, 0.5, 0.75]
    stats = sketch(df, cols, probs, by)
    selected, moments = [], None
    for g in range(0, len(cols), GROUP):
        part = cols[g : g + GROUP]
        extra = [f"named_struct('mean', avg(__v{i}), 'std_dev', coalesce(stddev_samp(__v{i}), 0D), 'n', count(__v{i})) AS __m{i}" for i in range(len(part))]
        counts, bins = select_ranks(df, part, probs, stats, by, False, first=g, extra=extra)  # moments ride along
        selected.append((counts, bins))
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__m{i}").alias("m")) for i, c in enumerate(part)]))
        m = counts.select(*by, each.alias("s")).select(*by, "s.column", "s.m.mean", "s.m.std_dev", "s.m.n").where(F.col("n") > 0)
        moments = m if moments is None else moments.unionByName(m)
    q = quantiles_wide(df, cols, probs, ["q1", "median", "q3"], by, stats=stats, selected=selected).drop("n")
    out = seg_join(moments, q, by + ["column"])
    return out.select(*by, "column", "mean", "median", "std_dev", "q1", "q3")


def _summary_schema(df: DataFrame, by: Sequence[str]) -> T.StructType:
    fields = [df.schema[b] for b in by] + [T.StructField("column", T.StringType())] + [
        T.StructField(n, T.DoubleType()) for n in ("mean", "median", "std_dev", "q1", "q3")]
    return T.StructType(fields)


# Validity-gate thresholds and messages.
MIN_ROWS = 10
MIN_COLUMNS = 2
GATE_MESSAGES = {
    "empty": "Dataset is empty",
    "rows": f"Dataset has fewer than {MIN_ROWS} rows",
    "cols": f"Dataset has fewer than {MIN_COLUMNS} columns",
    "target": "Target column is not numeric",
    "numeric": "No numerical columns found",
    "ok": "Dataset is valid",
}


def validity_gate(df: DataFrame, target: str | None = None, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """AGG11: (by..., valid, reason); the first failing check wins."""
    by = seg_cols(by)
    cols = analysed_columns(df, by, columns)
    n_num = sum(1 for c in cols if is_stat_numeric(df.schema[c].dataType))
    target_bad = bool(target) and target in cols and not is_stat_numeric(df.schema[target].dataType)
    n = F.count(F.lit(1))
    reason = (
        F.when((n == 0) | F.lit(len(cols) == 0), F.lit(GATE_MESSAGES["empty"]))
        .when(n < MIN_ROWS, F.lit(GATE_MESSAGES["rows"]))
        .when(F.lit(len(cols) < MIN_COLUMNS), F.lit(GATE_MESSAGES["cols"]))
        .when(F.lit(target_bad), F.lit(GATE_MESSAGES["target"]))
        .when(F.lit(n_num < 1), F.lit(GATE_MESSAGES["numeric"]))
        .otherwise(F.lit(GATE_MESSAGES["ok"]))
    )
    out = df.groupBy(*by).agg(reason.alias("reason"))
    return out.select(*by, (F.col("reason") == GATE_MESSAGES["ok"]).alias("valid"), "reason")


# Target-kind thresholds.
MAX_UNIQUE_FOR_CLASSIFICATION = 20
MAX_UNIQUE_RATIO_FOR_CLASSIFICATION = 0.05


def target_kind_expr(n_rows, n_distinct, numeric: bool):
    if not numeric:
        return F.when(n_rows == 0, F.lit("unknown")).otherwise(F.lit("classification"))
    ratio = n_distinct / F.greatest(n_rows, F.lit(1))
    return (
        F.when(n_rows == 0, F.lit("unknown"))
        .when((n_distinct <= MAX_UNIQUE_FOR_CLASSIFICATION) | (ratio <= MAX_UNIQUE_RATIO_FOR_CLASSIFICATION), F.lit("classification"))
        .otherwise(F.lit("regression"))
    )


def target_kind(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG12: (by..., n_rows, n_distinct, target_type)."""
    by = seg_cols(by)
    numeric = is_overview_numeric(df.schema[target].dataType)
    t = as_double(df, target) if isinstance(df.schema[target].dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{target}`")
    agg = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(t).alias("n_distinct"))
    return agg.withColumn("target_type", target_kind_expr(F.col("n_rows"), F.col("n_distinct"), numeric))


#: Distinct values that the bounded sets below hold as they are; beyond, their counts are estimates.
SET_BITS = 12
#: Five standard errors of such an estimate.
SET_ERROR = 5 / 2 ** (SET_BITS / 2)


def bounded_distinct(c):
    """Aggregate: distinct non-null values of a column from a set of hashes that stops growing at 2^SET_BITS entries
    and merges.  Exact below that size; beyond it the estimate lies within SET_ERROR."""
    return F.theta_sketch_estimate(F.theta_sketch_agg(c, SET_BITS))


def target_type(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG12 without a distinct count: (by..., n_rows, target_type), the same types as ``target_kind``.

    One scan with a bounded set for each segment.  Only a segment whose share of distinct values can't be told from
    the threshold within the set's error is counted exactly, in a second scan of those segments alone."""
    by = seg_cols(by)
    dt = df.schema[target].dataType
    numeric = is_overview_numeric(dt)
    n = F.count(F.lit(1)).alias("n_rows")
    if not numeric or isinstance(dt, T.BooleanType):
        return df.groupBy(*by).agg(n).select(*by, "n_rows", target_kind_expr(F.col("n_rows"), F.lit(2), numeric).alias("target_type"))
    floating = isinstance(dt, (T.FloatType, T.DoubleType))
    t = as_double(df, target) if floating else F.col(f"`{target}`")
    # decimals as text: their doubles could coincide
    hashed = t if floating else t.cast("string") if isinstance(dt, T.DecimalType) else t.cast("bigint")
    agg = df.groupBy(*by).agg(n, bounded_distinct(hashed).alias("__nd")).checkpoint(eager=True)
    limit = F.col("n_rows") * MAX_UNIQUE_RATIO_FOR_CLASSIFICATION
    unsure = (F.col("__nd") >= (1 << SET_BITS) * (1 - SET_ERROR)) & F.col("__nd").between(limit * (1 - SET_ERROR), limit * (1 + SET_ERROR))
    open_ = agg.where(unsure).select(*by)
    if open_.take(1):
        exact = seg_join(df, open_, by).groupBy(*by).agg(F.count_distinct(t).alias("__exact"))
        agg = seg_join(agg, exact, by, "left").withColumn("__nd", F.coalesce("__exact", "__nd"))
    return agg.select(*by, "n_rows", target_kind_expr(F.col("n_rows"), F.col("__nd"), numeric).alias("target_type"))


# Names tried, in order, when no target is requested.
TARGET_CANDIDATES = ("price", "target", "label", "y")


def choose_target(df: DataFrame, requested: str | None = None, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """AGG13: (by..., target) -- requested, else a candidate name, else first '*price*' with >10
    distinct values, else the numeric column with the largest sample variance (first on ties)."""
    by = seg_cols(by)
    cols = analysed_columns(df, by, columns)
    if requested and requested in cols:
        return df.groupBy(*by).agg(F.lit(requested).alias("target"))
    numeric = [c for c in cols if is_overview_numeric(df.schema[c].dataType)]
    lower = {c.lower(): c for c in cols}
    for cand in TARGET_CANDIDATES:
        if cand in lower and lower[cand] in numeric:
            return df.groupBy(*by).agg(F.lit(lower[cand]).alias("target"))
    if not numeric:
        return df.groupBy(*by).agg(F.lit(None).cast("string").alias("target"))
    agg = df.groupBy(*by).agg(*[
        F.struct(bounded_distinct(as_double(df, c)).alias("nd"), F.var_samp(as_double(df, c)).alias("var")).alias(c)
        for c in numeric
    ])
    stack = F.explode(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit("price" in c.lower()).alias("is_price"),
                 F.col(f"`{c}`.nd").alias("nd"), F.col(f"`{c}`.var").alias("var"))
        for i, c in enumerate(numeric)
    ]))
    long = agg.select(*by, stack.alias("s")).select(*by, "s.*").where(F.col("nd") > 10)
    w = Window.partitionBy(*[F.col(f"`{b}`") for b in by]) if by else Window.partitionBy(F.lit(0))
    ranked = long.withColumn(
        "rk",
        F.row_number().over(w.orderBy(F.col("is_price").desc(), F.when(F.col("is_price"), F.col("ordinal")).asc_nulls_last(),
                                      F.col("var").desc_nulls_last(), F.col("ordinal"))),
    )
    chosen = ranked.where(F.col("rk") == 1).select(*by, F.col("column").alias("target"))
    segs = df.groupBy(*by).agg(F.lit(1).alias("__one"))
    return seg_join(segs, chosen, by, "left").select(*by, "target")


def feature_quality(df: DataFrame, target: str, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """AGG14: (by..., feature_quality, diversity_score).

    feature_quality = share of numeric columns whose sample variance is not below 0.01 (x100);
    diversity = numeric columns / all columns.  Zero when the target is not numeric.
    """
    by = seg_cols(by)
    cols = analysed_columns(df, by, columns)
    numeric = [c for c in cols if is_stat_numeric(df.schema[c].dataType)]
    if target not in numeric:
        return df.groupBy(*by).agg(F.lit(0.0).alias("feature_quality"), F.lit(0.0).alias("diversity_score"))
    low = sum((F.when(F.var_samp(as_double(df, c)) < 0.01, 1).otherwise(0) for c in numeric), F.lit(0))
    return df.groupBy(*by).agg(
        ((1 - low / max(len(numeric), 1)) * 100).cast("double").alias("feature_quality"),
        F.lit(len(numeric) / max(len(cols), 1)).cast("double").alias("diversity_score"),
    )


def histogram(df: DataFrame, column: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """AGG16: equal-width histogram of the non-null values; the last bin is closed.

    (by..., bin, lo, hi, count), empty bins included.
    """
    by = seg_cols(by)
    v = as_double(df, column)
    base = df.select(*[F.col(f"`{b}`") for b in by], v.alias("v")).where(F.col("v").isNotNull())
    rng = base.groupBy(*by).agg(F.min("v").alias("vmin"), F.max("v").alias("vmax")).checkpoint(eager=True)
    width = (F.col("vmax") - F.col("vmin")) / bins
    b = F.when(F.col("vmax") == F.col("vmin"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - F.col("vmin")) / (F.col("vmax") - F.col("vmin")) * bins), F.lit(bins - 1))).cast("int")
    from tabscope.operators.segments import attach, seg_bytes
    counts = attach(base, rng, by, seg_bytes(rng, by)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(*by, "vmin", "vmax", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = seg_join(grid, counts, by + ["bin"], "left")
    return out.select(
        *by, "bin",
        (F.col("vmin") + F.col("bin") * width).alias("lo"),
        F.when(F.col("bin") == bins - 1, F.col("vmax")).otherwise(F.col("vmin") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
    )


def pair_bins(df: DataFrame, x: str, y: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """AGG17: 2-D equal-width bin counts of rows where both columns are present (non-empty cells only)."""
    by = seg_cols(by)
    base = df.select(*[F.col(f"`{b}`") for b in by], as_double(df, x).alias("x"), as_double(df, y).alias("y")).dropna(subset=["x", "y"])
    rng = base.groupBy(*by).agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"),
                                F.max("y").alias("ymax")).checkpoint(eager=True)

    def _bin(v, lo, hi):
        return F.when(F.col(hi) == F.col(lo), F.lit(0)).otherwise(
            F.least(F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins), F.lit(bins - 1))).cast("int")

    from tabscope.operators.segments import attach, seg_bytes
    j = attach(base, rng, by, seg_bytes(rng, by))
    return j.groupBy(*by, _bin("x", "xmin", "xmax").alias("x_bin"), _bin("y", "ymin", "ymax").alias("y_bin")).agg(
        F.count(F.lit(1)).alias("count"))
