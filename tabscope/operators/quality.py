"""Five-part data-quality score per segment (AGG5-AGG10).

Three scans of the data:
  A. ``quantiles.sketch``: a quantile sketch per numeric column and segment;
  B. one grouping of equal rows (a heavily repeated row collapses map-side),
     whose distinct rows give duplicates, complete rows, lexical kinds, the
     counts around the sketch's brackets and the values certainly outside
     the Tukey fences;
  C. ``quantiles.bracket_bins``: the few values inside the brackets, for the exact
     quartiles, and the few that lie where a fence may be.
The per-segment results are joined on the segment keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.columns import (
    LEXICAL_KIND_PATTERNS, analysed_columns, as_double, finite_or_null, is_stat_numeric, lexical_kind, seg_cols,
)
from tabscope.operators.quantiles import (
    GROUP, bracket_counts, bracket_ends, fence_zone, long_values, quantiles_wide, select_ranks, sketch,
)
from tabscope.operators.segments import BROADCAST_BYTES, seg_bytes, seg_join

# Weights, thresholds and labels of the quality score.
WEIGHTS = {"completeness": 0.25, "uniqueness": 0.20, "consistency": 0.20, "plausibility": 0.20, "feature_richness": 0.15}
TYPE_DIVERSITY_THRESHOLD = 2
CONSISTENCY_PENALTY = 10.0
GRADE_CUTS = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
ASSESSMENT_GOOD = "Good quality data with minor outlier concerns"
ASSESSMENT_MODERATE = "Data quality is moderate and needs improvement before reliable modeling"
IQR_K = 1.5
MIN_VALUES_FOR_FENCES = 4
QUARTILES = (0.25, 0.75)

_KIND_CODES = {name: i for i, name in enumerate([k for k, _ in LEXICAL_KIND_PATTERNS] + ["text"])}


def grade_expr(score):
    e = None
    for cut, g in GRADE_CUTS:
        e = F.when(score >= cut, F.lit(g)) if e is None else e.when(score >= cut, F.lit(g))
    return e.otherwise(F.lit("F"))


def _null(df: DataFrame, c: str):
    col = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def _kind_bit(c: str):
    k = lexical_kind(F.col(f"`{c}`"))
    bit = F.lit(None).cast("int")
    for name, i in _KIND_CODES.items():
        bit = F.when(k == name, F.lit(1 << i)).otherwise(bit)
    return bit


def fences(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None, stats: DataFrame | None = None,
           selected: Sequence[DataFrame] | None = None) -> DataFrame:
    """(by..., column, q1, q3, n, fence_lo, fence_hi, usable) on finite values (+/-inf dropped)."""
    by = seg_cols(by)
    cols = [c for c in analysed_columns(df, by, columns) if is_stat_numeric(df.schema[c].dataType)]
    q = quantiles_wide(df, cols, QUARTILES, ["q1", "q3"], by, drop_inf=True, stats=stats, selected=selected)
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        *by, "column", "q1", "q3", "n",
        (F.col("q1") - IQR_K * iqr).alias("fence_lo"),
        (F.col("q3") + IQR_K * iqr).alias("fence_hi"),
        ((F.col("n") >= MIN_VALUES_FOR_FENCES) & (iqr != 0)).alias("usable"),
    )


def duplicate_counts(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """(by..., n_rows, n_distinct_rows, n_duplicates); null and NaN are one value, as in whole-row dedup.

    One scan: whole rows are grouped (hash-partitioned, a heavily repeated row collapses map-side), so the count is exact
    and nothing is read twice or written.  The empty table is one segment without keys."""
    by = seg_cols(by)
    cols = analysed_columns(df, by, columns)
    row = [_comparable(df, c).alias(f"__d{i}") for i, c in enumerate(cols)] or [F.lit(0).alias("__d0")]
    held = [F.col(f"`{b}`").alias(f"__k{i}") for i, b in enumerate(by)]
    rows = df.select(*held, *row)
    each = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__c"))
    out = each.groupBy(*[f"__k{i}" for i in range(len(by))]).agg(F.coalesce(F.sum("__c"), F.lit(0)).cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct_rows"))
    return out.select(*[F.col(f"__k{i}").alias(b) for i, b in enumerate(by)], "n_rows", "n_distinct_rows", (F.col("n_rows") - F.col("n_distinct_rows")).alias("n_duplicates"))


def _comparable(df: DataFrame, c: str):
    """The column with NaN as null, so that both count as one value."""
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return as_double(df, c)
    return F.col(f"`{c}`")


def outlier_counts(df: DataFrame, numeric: Sequence[str], stats: DataFrame, by: Sequence[str] = (), counts: Sequence[DataFrame] | None = None) -> DataFrame:
    """(by..., outlier_total, value_total): finite values outside the Tukey fences, and all of the columns that have fences.

    ``stats`` is the quartile sketch of ``numeric``.  The counts that lead to the exact quartiles also have the values that
    lie outside whatever the quartiles are within their brackets, and the few between are grouped by value; these
    are compared with the exact fences afterwards."""
    by = seg_cols(by)
    held = [F.col(f"`{b}`") for b in by]
    groups = _groups(numeric)
    counts = counts or [None] * len(groups)
    selected = [select_ranks(df, cols, QUARTILES, stats, by, True, fence_k=IQR_K, first=g, counts=c) for (g, cols), c in zip(groups, counts)]
    place = F.create_map(*[x for i, c in enumerate(numeric) for x in (F.lit(c), F.lit(i))])
    f = fences(df, by, numeric, stats, selected).where("usable").select(*held, "column", place[F.col("column")].alias("__ci"), "n", "fence_lo", "fence_hi")
    f = f.checkpoint(eager=True)
    outside = None
    for (g, cols), (counted, bins) in zip(groups, selected):
        step = 3 * len(QUARTILES) + 1
        each = F.explode(F.array(*[F.struct(
            F.lit(g + i).alias("__ci"), F.get("counts", F.lit(i * step + step - 1)).alias("c"),
            *[F.expr(e).alias(name) for name, e in zip(("l0", "l1", "h0", "h1"), fence_zone(f"s{g + i}", IQR_K))]) for i in range(len(cols))]))
        sure = seg_join(counted.select(*held, "counts"), stats.select(*held, *[f"s{g + i}" for i in range(len(cols))]), by)
        sure = sure.select(*held, each.alias("x")).select(*held, "x.*", F.lit(None).cast("double").alias("z"))
        none = F.lit(None).cast("double")
        unsure = bins.where("z IS NOT NULL").select(*held, (F.col("ci") + g).alias("__ci"), "c", *[none.alias(e) for e in ("l0", "l1", "h0", "h1")], "z")
        both = sure.unionByName(unsure)
        outside = both if outside is None else outside.unionByName(both)
    counted = seg_join(outside, f, by + ["__ci"])
    out = F.col("z").isNull() | (F.col("z") < F.col("fence_lo")) | (F.col("z") > F.col("fence_hi"))
    held_in = F.col("fence_lo").between(F.col("l0"), F.col("l1")) & F.col("fence_hi").between(F.col("h0"), F.col("h1"))
    counted = counted.groupBy(*held, "column").agg(F.sum(F.when(out, F.col("c")).otherwise(0)).alias("c"), F.max("n").alias("n"), F.bool_and(held_in).alias("good"),
                                                   F.max("fence_lo").alias("fence_lo"), F.max("fence_hi").alias("fence_hi")).checkpoint(eager=True)
    bad = sorted(r["column"] for r in counted.where("NOT good").select("column").distinct().collect())  # at most the table's columns
    total = counted.where("good").select(*held, "c", "n")
    if bad:  # the sketch's bracket missed a quartile: these segments' columns are compared value by value
        again = counted.where("NOT good")
        values = seg_join(long_values(df, bad, by, True), again.select(*held, "column", "fence_lo", "fence_hi"), by + ["column"], "inner",
                          broadcast_right=seg_bytes(again, by) <= BROADCAST_BYTES)
        total = total.unionByName(values.groupBy(*held, "column").agg(
            F.count_if((F.col("value") < F.col("fence_lo")) | (F.col("value") > F.col("fence_hi"))).alias("c"), F.count(F.lit(1)).alias("n")).select(*held, "c", "n"))
    return total.groupBy(*held).agg(F.sum("c").alias("outlier_total"), F.sum("n").alias("value_total"))


def _groups(columns: Sequence[str]) -> list[tuple[int, Sequence[str]]]:
    return [(g, columns[g : g + GROUP]) for g in range(0, len(columns), GROUP)]


def _row_profile(df: DataFrame, cols: Sequence[str], numeric: Sequence[str], strings: Sequence[str], any_null, stats: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """One scan: (by..., n_rows, n_duplicates, n_complete, a kind bitmask __k of each string column, __counts of each group of
    numeric columns).  Equal rows are grouped first; what is counted then is counted once a distinct row."""
    held = [F.col(f"`{b}`").alias(f"__g{i}") for i, b in enumerate(by)]
    each = df.select(*held, *[_comparable(df, c).alias(f"__d{i}") for i, c in enumerate(cols)], any_null.alias("__anynull"))
    rows = each.groupBy(*each.columns).agg(F.count(F.lit(1)).alias("__c"))
    keys = [f"__g{i}" for i in range(len(by))]
    place = {c: i for i, c in enumerate(cols)}
    text = [F.bit_or(_kind_bit(f"__d{place[c]}")).alias(f"__k{i}") for i, c in enumerate(strings)]
    aggs = [F.coalesce(F.sum("__c"), F.lit(0)).cast("long").alias("n_rows"), F.count(F.lit(1)).alias("__distinct"),
            F.coalesce(F.sum(F.when(~F.col("__anynull"), F.col("__c"))), F.lit(0)).cast("long").alias("n_complete"), *text]
    out = None
    parts = _groups(numeric) or [(0, [])]
    if stats is None or len(parts) > 1:  # wide tables: counts of each group of columns from a scan of their own
        out = rows.groupBy(*keys).agg(*aggs)
    for g, part in parts:
        if stats is None or not part:
            continue
        small = bracket_ends(stats, len(part), len(QUARTILES), by, IQR_K, g)
        small = small.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)], *[c for c in small.columns if c not in by])
        values = rows.select(*keys, "__anynull", "__c", *[f"__d{place[c]}" for c in strings],
                             *[finite_or_null(F.col(f"__d{place[c]}").cast("double")).alias(f"__v{i}") for i, c in enumerate(part)])
        joined = seg_join(values, small, keys, "left", broadcast_right=seg_bytes(small, keys) <= BROADCAST_BYTES)
        counted = joined.groupBy(*keys).agg(*(aggs if out is None else []), bracket_counts(len(part), len(QUARTILES), IQR_K, "__c").alias(f"__counts{g}"))
        out = counted if out is None else seg_join(out, counted, keys)
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "n_rows", (F.col("n_rows") - F.col("__distinct")).alias("n_duplicates"), "n_complete",
                      *[f"__k{i}" for i in range(len(strings))], *[c for c in out.columns if c.startswith("__counts")])


def quality_parts(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Unrounded parts: (by..., n_rows, completeness, uniqueness, consistency, plausibility, feature_richness)."""
    by = seg_cols(by)
    cols = analysed_columns(df, by, columns)
    n_feat = max(len(cols), 1)
    strings = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    numeric = [c for c in cols if is_stat_numeric(df.schema[c].dataType)]
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | _null(df, c)
    work = df.select(*[F.col(f"`{b}`") for b in by], *[F.col(f"`{c}`") for c in cols])
    stats = sketch(work, numeric, QUARTILES, by, True) if numeric else None
    a = _row_profile(work, cols, numeric, strings, any_null, stats, by).checkpoint(eager=True)
    if numeric:
        counts = [a.select(*by, F.col(f"__counts{g}").alias("counts")) for g, _ in _groups(numeric)]
        a = seg_join(a, outlier_counts(work, numeric, stats, by, counts), by, "left")
    else:
        a = a.withColumns({"outlier_total": F.lit(0), "value_total": F.lit(0)})
    a = a.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("outlier_total", "value_total")})
    issues = sum((F.when(F.bit_count(F.coalesce(F.col(f"__k{i}"), F.lit(0))) > TYPE_DIVERSITY_THRESHOLD, 1).otherwise(0)
                  for i in range(len(strings))), F.lit(0))
    j = a.select(*by, "n_rows", "n_complete", issues.alias("consistency_issues"), "outlier_total", "value_total", "n_duplicates")
    rows = F.greatest(F.col("n_rows"), F.lit(1))  # an empty table: nothing complete, nothing duplicated
    return j.select(
        *by,
        "n_rows",
        (F.col("n_complete") / rows * 100).alias("completeness"),
        ((1 - F.col("n_duplicates") / rows) * 100).alias("uniqueness"),
        F.greatest(F.lit(0.0), 100.0 - F.col("consistency_issues") / n_feat * 100.0 * (CONSISTENCY_PENALTY / 100.0)).alias("consistency"),
        F.when(F.col("value_total") > 0, (1 - F.col("outlier_total") / F.col("value_total")) * 100).otherwise(F.lit(100.0)).alias("plausibility"),
        F.lit(len(numeric) / n_feat * 100).cast("double").alias("feature_richness"),
        "consistency_issues", "outlier_total", "value_total", "n_duplicates",
    )


def quality_score(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """(by..., completeness, uniqueness, consistency, plausibility, feature_richness, overall_score, grade, assessment).

    Parts and the overall score are rounded to one place; the overall score is
    the weighted sum of the unrounded parts; the grade is read off the rounded score.
    """
    by = seg_cols(by)
    p = quality_parts(df, by, columns)
    overall = sum(F.col(k) * w for k, w in WEIGHTS.items())
    p = p.withColumn("overall_score", F.round(overall, 1))
    g = grade_expr(F.col("overall_score"))
    return p.select(
        *by,
        *[F.round(F.col(k), 1).alias(k) for k in WEIGHTS],
        "overall_score",
        g.alias("grade"),
        F.when(g.isin("A", "B"), F.lit(ASSESSMENT_GOOD)).otherwise(F.lit(ASSESSMENT_MODERATE)).alias("assessment"),
    )
