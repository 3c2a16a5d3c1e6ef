"""Exact quantiles (linear interpolation) per segment and column, without sorting a group in one task.

Spark's exact ``percentile`` keeps a value -> count map per group, so one hot
segment with many distinct values lands in a single task.  Here three scans
usually do:

1. ``sketch``: one grouped aggregation with, for each column, n, the finite
   min/max, the +/-inf counts and a mergeable quantile sketch
   (``percentile_approx``, whose ranks are off by at most n / accuracy).  Asked
   a little below and above each probability, it brackets every rank.  Other
   aggregates of the caller ride along, so that a profile costs no extra scan.
2. ``bracket_counts``: one aggregation that counts the values up to the ends of
   each bracket; a caller that groups the rows anyway gets it without a scan.
3. ``bracket_bins``: buckets the values inside into ``buckets`` equal-width bins
   (count, min, max).  Only values inside a bracket become rows, some thousandths
   of all.  A running count over the bins locates each rank, which is resolved
   when its bin holds a single distinct value or the rank is the bin's first or
   last element.

Counts, not the sketch, decide: a rank that a bracket misses, or whose bin
holds several values, goes into rounds of histogram refinement over the
columns that are still open.  Each round joins the values to the open intervals
and shrinks them; the two ends of an open interval fall into different bins, so
every round leaves fewer values and the rounds end.

All aggregations are combined map-side, so skew never reaches one reducer.
Each round's state is a small table that is checkpointed, so lineage stays
short and an executor loss only repeats the current round.  Segment keys may be
null: all joins on them are null-safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.columns import seg_cols
from tabscope.operators.segments import BROADCAST_BYTES, seg_bytes, seg_join
from tabscope.session import ensure_checkpoint_dir

INF = float("inf")
ACCURACY = 2000
#: half widths of the brackets, in shares of n; the first that spans two ranks is used, the whole range below the last
WIDTHS = (2 / ACCURACY, 16 / ACCURACY, 128 / ACCURACY)
BUCKETS = 65536
#: columns bracketed in one scan; more are done in groups, which keeps rows and generated code small
GROUP = 24


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), drop_inf: bool = False) -> DataFrame:
    """(by..., column, value) with nulls (and NaN, optionally +/-inf) removed. An Expand, no shuffle."""
    by = seg_cols(by)
    wide = df.select(*[F.col(f"`{b}`") for b in by], *[F.expr(_value_sql(c, drop_inf)).alias(c) for c in columns])
    long = wide.unpivot(by, list(columns), "column", "value")
    return long.where(F.col("value").isNotNull())


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _value_sql(c: str, drop_inf: bool) -> str:
    """SQL of a column as double, NaN (and with ``drop_inf`` the infinities) null.  SQL text, here and below, because a
    call from Python to the JVM for each node of these expressions costs more than the scans of a small table."""
    v = f"nanvl(CAST({_quoted(c)} AS DOUBLE), CAST(NULL AS DOUBLE))"
    return f"nanvl({v} + 0D * {v}, CAST(NULL AS DOUBLE))" if drop_inf else v


def sketch(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), drop_inf: bool = False,
           extra: Sequence[Column] = ()) -> DataFrame:
    """One scan: (by..., extra..., s0, s1, ...), s being a struct of a column's n, n_neg, n_pos, fmin, fmax, lo and hi
    (arrays: the bracket of each probability).  Checkpointed; one row per segment."""
    by = seg_cols(by)
    ensure_checkpoint_dir(df.sparkSession)
    asked = [min(1.0, max(0.0, p + sign * w)) for w in WIDTHS for p in probs for sign in (-1, 1)]
    data = df.selectExpr("*", *[f"{_value_sql(c, drop_inf)} AS __v{i}" for i, c in enumerate(columns)])
    cuts = ", ".join(f"{p!r}D" for p in asked)
    aggs = []
    for i in range(len(columns)):
        v = f"__v{i}"
        finite = v if drop_inf else f"CASE WHEN abs({v}) < double('Infinity') THEN {v} END"
        neg, pos = ("0L", "0L") if drop_inf else (f"count_if({v} = double('-Infinity'))", f"count_if({v} = double('Infinity'))")
        aggs.append(F.expr(f"named_struct('n', count({v}), 'n_neg', {neg}, 'n_pos', {pos}, 'fmin', min({finite}), 'fmax', max({finite}), "
                           f"'cut', percentile_approx({v}, array({cuts}), {ACCURACY}))").alias(f"__s{i}"))
    raw = data.groupBy(*[F.col(f"`{b}`") for b in by]).agg(*extra, *aggs)
    m = len(probs)

    def bracket(s: str, j: int, side: int) -> str:
        """The narrowest cut that spans two ranks, else the end of the range; finite, whatever the sketch names."""
        cases = " ".join(f"WHEN {s}.n * {w!r}D >= 2 THEN {s}.cut[{2 * (k * m + j) + side}]" for k, w in enumerate(WIDTHS))
        return f"least(greatest(CASE {cases} ELSE {s}.{('fmin', 'fmax')[side]} END, {s}.fmin), {s}.fmax)"

    def told(s: str) -> str:
        kept = ", ".join(f"'{f}', {s}.{f}" for f in ("n", "n_neg", "n_pos", "fmin", "fmax"))
        ends = ", ".join(f"'{name}', array({', '.join(bracket(s, j, side) for j in range(m))})" for side, name in ((0, "lo"), (1, "hi")))
        return f"named_struct({kept}, {ends})"

    keep = [f"`{c}`" for c in raw.columns if not c.startswith("__s")]
    return raw.selectExpr(*keep, *[f"{told(f'__s{i}')} AS s{i}" for i in range(len(columns))]).checkpoint(eager=True)


def fence_zone(s: str, k: float) -> list[str]:
    """SQL of the ends of the two zones in which the fences q1 - k iqr and q3 + k iqr must lie, given the brackets of q1 and
    q3 (the first two probabilities) in the struct column s; a little wider than that, for rounding."""
    a1, b1, a3, b3 = f"{s}.lo[0]", f"{s}.hi[0]", f"{s}.lo[1]", f"{s}.hi[1]"
    slack = f"(abs({a1}) + abs({b1}) + abs({a3}) + abs({b3})) * 1e-9D"
    one, k = f"{1 + k!r}D", f"{k!r}D"
    return [f"{a1} * {one} - {b3} * {k} - {slack}", f"{b1} * {one} - {a3} * {k} + {slack}",
            f"{a3} * {one} - {b1} * {k} - {slack}", f"{b3} * {one} - {a1} * {k} + {slack}"]


def bracket_ends(stats: DataFrame, n_columns: int, n_probs: int, by: Sequence[str], fence_k: float | None = None, first: int = 0) -> DataFrame:
    """(by..., lo, hi and to of each column and probability, four fence ends of each column): what a scan compares values
    with, worked out once a segment.  ``to`` is hi, or null where an earlier probability has the same bracket."""
    ends = []
    for i in range(n_columns):
        s = f"s{first + i}"
        for j in range(n_probs):
            same = " OR ".join(f"({s}.lo[{j}] = {s}.lo[{o}] AND {s}.hi[{j}] = {s}.hi[{o}])" for o in range(j)) or "false"
            ends += [f"{s}.lo[{j}] AS __lo{i}_{j}", f"{s}.hi[{j}] AS __hi{i}_{j}", f"CASE WHEN NOT ({same}) THEN {s}.hi[{j}] END AS __to{i}_{j}"]
        if fence_k is not None:
            ends += [f"{e} AS __f{i}_{k}" for k, e in enumerate(fence_zone(s, fence_k))]
    return stats.selectExpr(*[_quoted(b) for b in by], *ends)


def _unsure(i: int) -> str:
    return f"coalesce(__v{i} BETWEEN __f{i}_0 AND __f{i}_1 OR __v{i} BETWEEN __f{i}_2 AND __f{i}_3, false)"


def bracket_counts(n_columns: int, n_probs: int, fence_k: float | None = None, weight: str = "1L") -> Column:
    """An aggregate over values __v0... joined with ``bracket_ends``: for each column and probability the number of values
    below the bracket's lower end, up to it and up to its upper end, and with ``fence_k`` after each column that of the
    values certainly outside its fences.  ``weight``: rows that each row stands for."""
    counted = []
    for i in range(n_columns):
        for j in range(n_probs):
            counted += [f"__v{i} < __lo{i}_{j}", f"__v{i} <= __lo{i}_{j}", f"__v{i} <= __hi{i}_{j}"]
        if fence_k is not None:
            counted.append(f"(__v{i} < __f{i}_0 OR __v{i} > __f{i}_3) AND NOT {_unsure(i)}")
    return F.expr(f"array({', '.join(f'coalesce(sum(CASE WHEN {c} THEN {weight} END), 0L)' for c in counted)})")


def bracket_bins(joined: DataFrame, n_columns: int, n_probs: int, by: Sequence[str], buckets: int = BUCKETS, fence_k: float | None = None) -> DataFrame:
    """(by..., ci, lo, hi, bucket, z, c, bmin, bmax) from values __v0... joined with ``bracket_ends``: the bins of the values
    strictly inside a bracket of column ci, and (z not null) the count of a value z that lies where a fence may be.
    Values equal to an end are only counted, so a frequent value makes no rows.  Checkpointed."""
    held = [F.col(f"`{b}`") for b in by]
    # one row for each value: the conditions of all columns at once make a method that Java only interprets
    kept = [[("v", f"__v{i}"), *[(f"{e}{j}", f"__{e}{i}_{j}") for j in range(n_probs) for e in ("lo", "hi", "to")],
             *[(f"f{k}", f"__f{i}_{k}") for k in range(4 if fence_k is not None else 0)]] for i in range(n_columns)]
    each = joined.select(*held, *[F.struct(*[F.col(c).alias(name) for name, c in kept[i]]).alias(f"__x{i}") for i in range(n_columns)])
    each = each.unpivot(held, [F.col(f"__x{i}") for i in range(n_columns)], "__of", "__x")
    items, where = [], []
    ci = "CAST(substring(__of, 4) AS INT)"
    for j in range(n_probs):
        lo, hi = f"__x.lo{j}", f"__x.hi{j}"
        where.append(f"coalesce(__x.v > {lo} AND __x.v < __x.to{j}, false)")
        items.append(f"CASE WHEN {where[-1]} THEN named_struct('ci', {ci}, 'lo', {lo}, 'hi', {hi}, 'bucket', {_bucket_sql('__x.v', lo, hi, buckets)}, "
                     f"'z', CAST(NULL AS DOUBLE), 'v', __x.v) END")
    if fence_k is not None:
        where.append("coalesce(__x.v BETWEEN __x.f0 AND __x.f1 OR __x.v BETWEEN __x.f2 AND __x.f3, false)")
        items.append(f"CASE WHEN {where[-1]} THEN named_struct('ci', {ci}, 'lo', CAST(NULL AS DOUBLE), 'hi', CAST(NULL AS DOUBLE), 'bucket', CAST(NULL AS INT), "
                     f"'z', __x.v, 'v', __x.v) END")
    rows = each.where(" OR ".join(where)).select(*held, F.expr(f"explode(array_compact(array({', '.join(items)})))").alias("__i"))
    return rows.groupBy(*held, "__i.ci", "__i.lo", "__i.hi", "__i.bucket", "__i.z").agg(
        F.count(F.lit(1)).alias("c"), F.min("__i.v").alias("bmin"), F.max("__i.v").alias("bmax")).checkpoint(eager=True)


def select_ranks(df: DataFrame, columns: Sequence[str], probs: Sequence[float], stats: DataFrame, by: Sequence[str], drop_inf: bool,
                 buckets: int = BUCKETS, fence_k: float | None = None, first: int = 0, counts: DataFrame | None = None,
                 extra: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``bracket_counts`` (by..., counts) and ``bracket_bins`` of the columns s{first}... of the sketch, each from one scan;
    ``counts`` may come from a scan that the caller makes anyway.  ``extra``: SQL of further aggregates of the columns
    (__v0...) for the counting scan."""
    by = seg_cols(by)
    small = bracket_ends(stats, len(columns), len(probs), by, fence_k, first)
    data = df.selectExpr(*[_quoted(b) for b in by], *[f"{_value_sql(c, drop_inf)} AS __v{i}" for i, c in enumerate(columns)])
    joined = seg_join(data, small, by, broadcast_right=seg_bytes(small, by) <= BROADCAST_BYTES)
    if counts is None:
        counts = joined.groupBy(*[F.col(f"`{b}`") for b in by]).agg(
            bracket_counts(len(columns), len(probs), fence_k).alias("counts"), *[F.expr(e) for e in extra]).checkpoint(eager=True)
    return counts, bracket_bins(joined, len(columns), len(probs), by, buckets, fence_k)


def _bucket_sql(v: str, lo: str, hi: str, buckets: int) -> str:
    """Halves, so that the width of the widest interval is finite."""
    return f"CAST(least(floor(({v} / 2D - {lo} / 2D) / nullif({hi} / 2D - {lo} / 2D, 0D) * {buckets}), {buckets - 1}) AS INT)"


def _open_columns(open_: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that have an open rank, in order; at most all of them."""
    names = {r["column"] for r in open_.select("column").distinct().collect()}
    return [c for c in columns if c in names]


def _located(open_: DataFrame, hist: DataFrame, keys: list[str]) -> DataFrame:
    """Open ranks with the bin they lie in as their new interval, and their value where it is known."""
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys], "lo", "hi").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.select(*keys, "lo", "hi", "bucket", "c", "bmin", "bmax").withColumn("cum", F.sum("c").over(w))
    start = F.col("below") + F.col("cum") - F.col("c")
    out = seg_join(open_, hist, keys + ["lo", "hi"]).where((F.col("fr") >= start) & (F.col("fr") < F.col("below") + F.col("cum")))
    out = out.select(*keys, "rank", "fr", F.col("bmin").alias("lo"), F.col("bmax").alias("hi"), start.alias("below"), "c")
    value = (
        F.when((F.col("lo") == F.col("hi")) | (F.col("fr") == F.col("below")), F.col("lo"))
        .when(F.col("fr") == F.col("below") + F.col("c") - 1, F.col("hi"))
    )
    return out.withColumn("value", value)


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    by: Sequence[str] = (),
    drop_inf: bool = False,
    buckets: int = BUCKETS,
    stats: DataFrame | None = None,
    selected: Sequence[tuple[DataFrame, DataFrame]] | None = None,
) -> DataFrame:
    """Return (by..., column, prob, value, n) with pandas/numpy 'linear' quantiles of the non-null values.

    ``stats`` and ``selected`` (one pair for each ``GROUP`` columns) are results of ``sketch`` and ``select_ranks`` for
    the same columns and probabilities, where the caller has made them already."""
    by = seg_cols(by)
    columns, probs = list(columns), list(probs)
    if not columns:
        types = [df.schema[b] for b in by]
        return df.sparkSession.createDataFrame([], df.select(*[F.col(f"`{t.name}`") for t in types], F.lit("").alias("column"), F.lit(0.0).alias("prob"),
                                                             F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("n")).schema)
    stats = stats if stats is not None else sketch(df, columns, probs, by, drop_inf)
    groups = [(g, columns[g : g + GROUP]) for g in range(0, len(columns), GROUP)]
    if selected is None:
        selected = [select_ranks(df, cols, probs, stats, by, drop_inf, buckets, first=g) for g, cols in groups]
    keys = by + ["column"]
    held = [F.col(f"`{b}`") for b in by]
    targets = hist = None
    for (g, cols), (counts, bins) in zip(groups, selected):
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("__ci"), F.col(f"s{g + i}").alias("s")) for i, c in enumerate(cols)]))
        t = stats.select(*held, each.alias("x")).select(*held, "x.column", "x.__ci", "x.s.*").where("n > 0")
        t = seg_join(t, counts.select(*held, "counts"), by)
        step = (F.size("counts") / len(cols)).cast("int")
        each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.lit(j).alias("j")) for j, p in enumerate(probs)]))
        t = t.select("*", each.alias("p")).withColumn("__at", F.col("__ci") * step + 3 * F.col("p.j"))
        t = t.select(*held, "column", "n", "n_neg", "n_pos", "fmin", "fmax", "p.prob", F.get("lo", F.col("p.j")).alias("lo"), F.get("hi", F.col("p.j")).alias("hi"),
                     *[(F.get("counts", F.col("__at") + k) - F.col("n_neg")).alias(name) for k, name in enumerate(("below", "upto", "within"))])
        names = F.get(F.array(*[F.lit(c) for c in cols]), F.col("ci"))
        h = bins.where("z IS NULL").select(*held, names.alias("column"), "lo", "hi", "bucket", "c", "bmin", "bmax")
        targets = t if targets is None else targets.unionByName(t)
        hist = h if hist is None else hist.unionByName(h)
    # derived from checkpointed tables by projections: cheap to read again
    targets = (
        targets.withColumn("pos", F.col("prob") * (F.col("n") - 1))
        .withColumn("r0", F.floor("pos"))
        .withColumn("frac", F.col("pos") - F.col("r0"))
        .withColumn("r1", F.least(F.col("r0") + 1, F.col("n") - 1))
    )
    known = ["n", "n_neg", "n_pos", "fmin", "fmax", "lo", "hi", "below", "upto", "within"]
    ranks = targets.select(*held, "column", F.struct(*known).alias("x"), F.explode(F.array("r0", "r1")).alias("rank"))
    ranks = ranks.groupBy(*held, "column", "rank").agg(F.min("x").alias("x")).select(*held, "column", "rank", "x.*")
    nf = F.col("n") - F.col("n_neg") - F.col("n_pos")
    fr = F.col("rank") - F.col("n_neg")
    direct = (
        F.when(F.col("rank") < F.col("n_neg"), F.lit(-INF))
        .when(F.col("rank") >= F.col("n") - F.col("n_pos"), F.lit(INF))
        .when((F.col("fmin") == F.col("fmax")) | (fr == 0), F.col("fmin"))
        .when(fr == nf - 1, F.col("fmax"))
        .when((fr >= F.col("below")) & (fr < F.col("upto")), F.col("lo"))
    )
    ranks = ranks.select(*held, "column", "rank", fr.alias("fr"), "fmin", "fmax", "lo", "hi", "upto", "within", direct.alias("value"))
    inside = ranks.where("value IS NULL AND fr >= upto AND fr < within").select(*held, "column", "rank", "fr", "lo", "hi", F.col("upto").alias("below"))
    found = _located(inside, hist, keys).drop("fr", "c").withColumnsRenamed({"lo": "b_lo", "hi": "b_hi", "value": "b_value"})
    state = seg_join(ranks, found.withColumn("binned", F.lit(True)), keys + ["rank"], "left")
    binned, missed = F.col("binned").isNotNull(), ~((F.col("fr") >= F.col("upto")) & (F.col("fr") < F.col("within")))
    # in the bracket but in none of its bins: its upper end; outside the bracket: search the whole range
    state = state.select(*held, "column", "rank", "fr", F.when(binned, F.col("b_lo")).otherwise(F.col("fmin")).alias("lo"),
                         F.when(binned, F.col("b_hi")).otherwise(F.col("fmax")).alias("hi"), F.coalesce("below", F.lit(0).cast("long")).alias("below"),
                         F.coalesce("value", F.when(binned, F.col("b_value")).when(~missed, F.col("hi"))).alias("value")).checkpoint(eager=True)
    resolved = [state.where(F.col("value").isNotNull()).select(*held, "column", "rank", "value")]
    open_ = state.where(F.col("value").isNull()).drop("value")
    open_columns = _open_columns(open_, columns)
    while open_columns:
        # only columns that still have an open rank are read and unpivoted
        values_f = long_values(df, open_columns, by, drop_inf).where(F.abs(F.col("value")) < F.lit(INF))
        intervals = open_.select(*keys, "lo", "hi").distinct()
        bucket = F.expr(_bucket_sql("value", "lo", "hi", buckets))
        hist = (
            seg_join(values_f, intervals, keys, broadcast_right=seg_bytes(open_, keys) <= BROADCAST_BYTES)
            .where(F.col("value").between(F.col("lo"), F.col("hi")))
            .groupBy(*[F.col(f"`{k}`") for k in keys], "lo", "hi", bucket.alias("bucket"))
            .agg(F.count(F.lit(1)).alias("c"), F.min("value").alias("bmin"), F.max("value").alias("bmax"))
        )
        located = _located(open_, hist, keys).checkpoint(eager=True)
        resolved.append(located.where(F.col("value").isNotNull()).select(*keys, "rank", "value"))
        open_ = located.where(F.col("value").isNull()).drop("value", "c")
        open_columns = _open_columns(open_, columns)

    allv = resolved[0]
    for r in resolved[1:]:
        allv = allv.unionByName(r)
    v0 = allv.select(*keys, F.col("rank").alias("r0"), F.col("value").alias("v0"))
    v1 = allv.select(*keys, F.col("rank").alias("r1"), F.col("value").alias("v1"))
    out = seg_join(seg_join(targets, v0, keys + ["r0"]), v1, keys + ["r1"])
    # equal neighbours (including two equal infinities) need no interpolation
    interp = F.when((F.col("frac") == 0) | (F.col("v0") == F.col("v1")), F.col("v0")) \
        .otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("frac"))
    return out.select(*keys, "prob", interp.alias("value"), "n")


def quantiles_wide(df: DataFrame, columns: Sequence[str], probs: Sequence[float], names: Sequence[str], by: Sequence[str] = (), drop_inf: bool = False,
                   stats: DataFrame | None = None, selected: Sequence[tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """(by..., column, <name_1>, ..., n): one row per (segment, column)."""
    by = seg_cols(by)
    q = quantiles(df, columns, probs, by, drop_inf, stats=stats, selected=selected)
    aggs = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(nm) for p, nm in zip(probs, names)]
    return q.groupBy(*[F.col(f"`{b}`") for b in by], "column").agg(*aggs, F.max("n").alias("n"))
