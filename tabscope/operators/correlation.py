"""Pearson correlation, pairwise-complete, as a long table, plus the derived signals (COR1-COR6).

Per pair (a, b), over rows where both are present: covar_pop(a, b) and the
population variances of a and b restricted to those rows; r = cov / (sd_a * sd_b)
through ``try_divide`` so constant columns give null instead of an ANSI error; a
pair with +/-inf in either column has no r (null).
Up to ``BLOCKED_MIN_K - 1`` columns all pairs come from one JVM aggregation; from
there on the number of aggregates would grow with k squared, and a blocked kernel
sums the same quantities per partition and segment.  Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.columns import analysed_columns, as_double, is_stat_numeric, seg_cols

CONST_TOL = 1e-12
BLOCKED_MIN_K = 5
# Correlation thresholds.
WEAK_TARGET_R = 0.15
REDUNDANT_R = 0.85
HIGH_CORR_R = 0.75
REDUNDANT_CAP = 10


def numeric_columns(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> list[str]:
    by = seg_cols(by)
    return [c for c in analysed_columns(df, by, columns) if is_stat_numeric(df.schema[c].dataType)]


def corr_long(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), diagonal: bool = False) -> DataFrame:
    """COR1: (by..., i, j, feature_a, feature_b, n, r) for i < j (and i = j when ``diagonal``)."""
    by = seg_cols(by)
    cols = list(columns) if columns is not None else numeric_columns(df, by)
    k = len(cols)
    base = df.select(*[F.col(f"`{b}`") for b in by], *[as_double(df, c).alias(f"__x{i}") for i, c in enumerate(cols)])
    if k >= BLOCKED_MIN_K:
        return _corr_blocked(base, cols, by, diagonal)
    g = base.groupBy(*by).agg(*(pair_sums(k, diagonal) or [F.count(F.lit(1)).alias("__n")]))
    return pairs_from_sums(g, cols, by, diagonal)


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i + 1, k)]


def pair_sums(k: int, diagonal: bool = False) -> list[Column]:
    """The aggregates over columns __x0..__x{k-1} that ``pairs_from_sums`` reads; all merge, so they also serve as streaming state."""
    aggs = []
    for i, j in _pairs(k):
        a, b = F.col(f"__x{i}"), F.col(f"__x{j}")
        both = a.isNotNull() & b.isNotNull()
        aggs += [
            F.count_if(both).alias(f"n{i}_{j}"),
            F.covar_pop(a, b).alias(f"c{i}_{j}"),
            F.stddev_pop(F.when(both, a)).alias(f"sa{i}_{j}"),
            F.stddev_pop(F.when(both, b)).alias(f"sb{i}_{j}"),
            F.avg(F.when(both, a)).alias(f"ma{i}_{j}"),
            F.avg(F.when(both, b)).alias(f"mb{i}_{j}"),
        ]
    if diagonal:
        aggs += [F.count(f"__x{i}").alias(f"nd{i}") for i in range(k)]
    return aggs


def pairs_from_sums(g: DataFrame, cols: list[str], by: Sequence[str] = (), diagonal: bool = False) -> DataFrame:
    """The rows of ``corr_long`` from a table of ``pair_sums`` by segment."""
    by, k = list(by), len(cols)
    entries = []
    for i, j in _pairs(k):
        sa, sb = F.col(f"sa{i}_{j}"), F.col(f"sb{i}_{j}")
        const = (sa <= F.lit(CONST_TOL) * F.greatest(F.lit(1.0), F.abs(F.col(f"ma{i}_{j}")))) | \
                (sb <= F.lit(CONST_TOL) * F.greatest(F.lit(1.0), F.abs(F.col(f"mb{i}_{j}"))))
        raw = F.try_divide(F.col(f"c{i}_{j}"), sa * sb)
        r = F.when(~const & (F.col(f"n{i}_{j}") > 1), _clamped(raw))
        entries.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(cols[i]).alias("feature_a"),
                                F.lit(cols[j]).alias("feature_b"), F.col(f"n{i}_{j}").alias("n"), r.alias("r")))
    if diagonal:
        for i in range(k):
            entries.append(F.struct(F.lit(i).alias("i"), F.lit(i).alias("j"), F.lit(cols[i]).alias("feature_a"),
                                    F.lit(cols[i]).alias("feature_b"), F.col(f"nd{i}").alias("n"),
                                    F.when(F.col(f"nd{i}") > 1, F.lit(1.0)).alias("r")))
    if not entries:
        schema = "i int, j int, feature_a string, feature_b string, n long, r double"
        empty = g.sparkSession.createDataFrame([], schema)
        return g.select(*by).join(empty, how="left_anti") if by else empty
    return g.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.*")


def _clamped(raw):
    """r within [-1, 1]; null where it is undefined or not finite (a column holds +/-inf).  greatest and least
    skip nulls and put NaN above 1, so only finite values may reach them."""
    return F.when(F.abs(raw) < F.lit(float("inf")), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), raw)))


def target_correlations(corr: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, r) of every other column with the target."""
    by = seg_cols(by)
    a = corr.where(F.col("feature_b") == target).select(*by, F.col("feature_a").alias("feature"), "r")
    b = corr.where(F.col("feature_a") == target).select(*by, F.col("feature_b").alias("feature"), "r")
    return a.unionByName(b)


def target_corr_mean(corr: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """COR2: (by..., avg_correlation) = mean |r| with the target over non-null r, round 3 (0 if none)."""
    by = seg_cols(by)
    t = target_correlations(corr, target, by)
    return t.groupBy(*by).agg(F.round(F.coalesce(F.avg(F.abs("r")), F.lit(0.0)), 3).alias("avg_correlation"))


def max_feature_corr(corr: DataFrame, target: str | None, by: Sequence[str] = ()) -> DataFrame:
    """COR3: (by..., max_correlation) = max |r| between two non-target columns, nulls ignored, round 3."""
    by = seg_cols(by)
    f = corr.where((F.col("i") != F.col("j")))
    if target is not None:
        f = f.where((F.col("feature_a") != target) & (F.col("feature_b") != target))
    segs = corr.groupBy(*by).agg(F.lit(1).alias("__one"))
    m = f.groupBy(*by).agg(F.max(F.abs("r")).alias("__m"))
    from tabscope.operators.segments import seg_join
    return seg_join(segs, m, by, "left").select(*by, F.round(F.coalesce("__m", F.lit(0.0)), 3).alias("max_correlation"))


def weak_features(corr: DataFrame, target: str, by: Sequence[str] = (), threshold: float = WEAK_TARGET_R) -> DataFrame:
    """COR4: (by..., weak_features, predictor_count): |r with target| below threshold, null r counted as 0."""
    by = seg_cols(by)
    t = target_correlations(corr, target, by)
    return t.groupBy(*by).agg(
        F.count_if(F.coalesce(F.abs("r"), F.lit(0.0)) < threshold).alias("weak_features"),
        F.count(F.lit(1)).alias("predictor_count"),
    )


def redundant_pairs(corr: DataFrame, by: Sequence[str] = (), target: str | None = None, include_target: bool = False,
                    threshold: float = REDUNDANT_R, cap: int | None = REDUNDANT_CAP) -> DataFrame:
    """COR5: pairs with |r| > threshold in column order (i, then j); the first ``cap`` per segment, all if None.

    The cap is a rule for a printed listing (first ten pairs); counts and maxima take all pairs.
    """
    by = seg_cols(by)
    f = corr.where((F.col("i") < F.col("j")) & (F.abs("r") > threshold))
    if target is not None and not include_target:
        f = f.where((F.col("feature_a") != target) & (F.col("feature_b") != target))
    f = f.select(*by, "i", "j", "feature_a", "feature_b", F.abs("r").alias("correlation"))
    if cap is None:
        return f
    w = (Window.partitionBy(*[F.col(f"`{b}`") for b in by]) if by else Window.partitionBy(F.lit(0))).orderBy("i", "j")
    return f.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= cap).drop("__rk")


def high_corr_pairs(corr: DataFrame, by: Sequence[str] = (), target: str | None = None, include_target: bool = False,
                    threshold: float = HIGH_CORR_R) -> DataFrame:
    """COR6: pairs with |r| > threshold, signed r kept, no cap."""
    by = seg_cols(by)
    f = corr.where((F.col("i") < F.col("j")) & (F.abs("r") > threshold))
    if target is not None and not include_target:
        f = f.where((F.col("feature_a") != target) & (F.col("feature_b") != target))
    return f.select(*by, "feature_a", "feature_b", F.col("r").alias("correlation"))


def _r_expr(n, sxy, sx_i, sx_j, sxx_i, sxx_j, sh_i, sh_j):
    """r from shifted pairwise sums; null for n < 2 or a (near-)constant side."""
    n = F.when(n > 0, n)  # no common row: everything below is null
    mi, mj = sx_i / n, sx_j / n
    vi = F.greatest(sxx_i / n - mi * mi, F.lit(0.0))
    vj = F.greatest(sxx_j / n - mj * mj, F.lit(0.0))
    cov = sxy / n - mi * mj
    sdi, sdj = F.sqrt(vi), F.sqrt(vj)
    const = (sdi <= F.lit(CONST_TOL) * F.greatest(F.lit(1.0), F.abs(mi + sh_i))) | \
            (sdj <= F.lit(CONST_TOL) * F.greatest(F.lit(1.0), F.abs(mj + sh_j)))
    return F.when(~const & (n > 1), _clamped(F.try_divide(cov, sdi * sdj)))


def _corr_blocked(base: DataFrame, cols: list[str], by: list[str], diagonal: bool) -> DataFrame:
    """Pairwise-complete correlation for wide inputs.

    Pass 1: per-segment column means (shift).  Pass 2: ``mapInPandas`` computes, per Arrow batch and
    segment, with M the presence mask and X0 the shifted values (0 where missing):
    n = M'M, Sx = X0'M, Sxx = (X0^2)'M, Sxy = X0'X0 -- emitted as one row per pair and summed by a
    grouped aggregation (algebraic, so a hot segment is combined map-side).
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    from tabscope.operators.segments import attach, seg_bytes

    k = len(cols)
    # one row per segment, used twice (shift the data, then restore means): materialise it once
    shift = base.groupBy(*by).agg(*[F.coalesce(F.avg(f"__x{i}"), F.lit(0.0)).alias(f"__s{i}") for i in range(k)]).checkpoint(eager=True)
    data = attach(base, shift, by, seg_bytes(shift, by))
    key_fields = [f for f in data.schema.fields if f.name in by]
    names = ["n", "sxy", "sx_i", "sx_j", "sxx_i", "sxx_j"]
    schema = T.StructType(key_fields + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]
                          + [T.StructField(nm, T.DoubleType()) for nm in names])
    ii, jj = np.triu_indices(k, 0 if diagonal else 1)

    def block(it):
        xc = [f"__x{i}" for i in range(k)]
        sc = [f"__s{i}" for i in range(k)]
        p = len(ii)
        for pdf in it:
            if pdf.empty:
                continue
            x_all = pdf[xc].to_numpy(float)
            sh_all = pdf[sc].to_numpy(float)
            # segments of this batch as contiguous slices of one sort (no per-segment DataFrames)
            codes = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(pdf), int)
            order = np.argsort(codes, kind="stable")
            cs = codes[order]
            starts = np.r_[0, np.flatnonzero(np.diff(cs)) + 1]
            ends = np.r_[starts[1:], len(cs)]
            blocks, first = [], []
            for s0, e0 in zip(starts, ends):
                idx = order[s0:e0]
                x = x_all[idx]
                m = ~np.isnan(x)
                x0 = np.where(m, x - sh_all[idx], 0.0)
                mf = m.astype(float)
                n = mf.T @ mf
                sx = x0.T @ mf
                sxx = (x0 * x0).T @ mf
                sxy = x0.T @ x0
                blocks.append(np.column_stack([n[ii, jj], sxy[ii, jj], sx[ii, jj], sx[jj, ii], sxx[ii, jj], sxx[jj, ii]]))
                first.append(idx[0])
            out = pd.DataFrame(np.vstack(blocks), columns=names)
            g = len(blocks)
            out["i"] = np.tile(ii, g).astype("int32")
            out["j"] = np.tile(jj, g).astype("int32")
            for nm in by:
                out[nm] = np.repeat(pdf[nm].to_numpy()[first], p)
            yield out[[f.name for f in schema.fields]]

    sums = data.mapInPandas(block, schema).groupBy(*by, "i", "j").agg(*[F.sum(nm).alias(nm) for nm in names])
    sums = attach(sums, shift, by, seg_bytes(shift, by))
    sh_i = F.element_at(F.array(*[F.col(f"__s{i}") for i in range(k)]), F.col("i") + 1)
    sh_j = F.element_at(F.array(*[F.col(f"__s{i}") for i in range(k)]), F.col("j") + 1)
    name = F.array(*[F.lit(c) for c in cols])
    n = F.col("n")
    r = _r_expr(n, F.col("sxy"), F.col("sx_i"), F.col("sx_j"), F.col("sxx_i"), F.col("sxx_j"), sh_i, sh_j)
    r = F.when(F.col("i") == F.col("j"), F.when(n > 1, F.lit(1.0))).otherwise(r)
    return sums.select(*by, "i", "j", F.element_at(name, F.col("i") + 1).alias("feature_a"),
                       F.element_at(name, F.col("j") + 1).alias("feature_b"), n.cast("long").alias("n"), r.alias("r"))
