"""Moment (Gram) kernel: per group n, means and population covariance of k columns.

One aggregation over complete rows (all k columns present): ``avg`` per
column and ``covar_pop`` per pair (Spark's updates are the numerically
stable streaming/merge form, and they combine map-side, so a hot segment
never reaches one task).  For wide inputs (k > ``WIDE_K``) the pairwise
aggregates are replaced by a blocked kernel: ``mapInPandas`` builds shifted
X'X blocks per partition and segment, emitted as long (i, j, value) rows and
summed by a grouped aggregation.

Output: (by..., [part], n, mean array<double>, cov array<double> (k*k, row-major)).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.columns import as_double, seg_cols
from tabscope.operators.segments import attach, seg_bytes

WIDE_K = 24


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), part: Column | None = None,
            part_name: str = "part", wide: bool | None = None) -> DataFrame:
    by = seg_cols(by)
    cols = list(columns)
    k = len(cols)
    keys = [F.col(f"`{b}`") for b in by]
    if part is not None:
        keys.append(part.alias(part_name))
    base = df.select(*keys, *[as_double(df, c).alias(f"__x{i}") for i, c in enumerate(cols)])
    gkeys = by + ([part_name] if part is not None else [])
    if wide is None:
        wide = k > WIDE_K
    if wide:
        # Incomplete rows are dropped inside the kernel: a k-way not-null filter over k aliases feeding a
        # join makes the optimizer's constraint inference blow up for wide k.
        return _moments_blocked(base, k, gkeys)
    base = base.dropna(subset=[f"__x{i}" for i in range(k)])
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(f"__x{i}").alias(f"__m{i}") for i in range(k)]
    for i in range(k):
        for j in range(i, k):
            aggs.append(F.covar_pop(f"__x{i}", f"__x{j}").alias(f"__c{i}_{j}"))
    g = base.groupBy(*gkeys).agg(*aggs)
    cov = [F.col(f"__c{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)]
    return g.select(*gkeys, "n", F.array(*[F.col(f"__m{i}") for i in range(k)]).alias("mean"), F.array(*cov).alias("cov"))


def sub_moments(m: DataFrame, k: int, keep: Sequence[int]) -> DataFrame:
    """The moments of a choice of columns, by their places, from a table of moments of k columns."""
    cov = [F.col("cov")[i * k + j] for i in keep for j in keep]
    return m.withColumns({"mean": F.array(*[F.col("mean")[i] for i in keep]), "cov": F.array(*cov)})


def _moments_blocked(base: DataFrame, k: int, gkeys: list[str]) -> DataFrame:
    # Shift by per-group means from a cheap first pass so the summed cross products stay well-conditioned
    # (means over all present values; any shift works, a close one keeps the sums small).
    shift = base.groupBy(*gkeys).agg(*[F.coalesce(F.avg(f"__x{i}"), F.lit(0.0)).alias(f"__s{i}") for i in range(k)]).checkpoint(eager=True)
    data = attach(base, shift, gkeys, seg_bytes(shift, gkeys))
    key_fields = [f for f in data.schema.fields if f.name in gkeys]
    out_schema = T.StructType(key_fields + [
        T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def block(it):
        xc = [f"__x{i}" for i in range(k)]
        sc = [f"__s{i}" for i in range(k)]
        ii, jj = np.triu_indices(k)
        ci = np.concatenate([ii, np.arange(k), [-1]]).astype("int32")
        cj = np.concatenate([jj, np.full(k, -1), [-1]]).astype("int32")
        for pdf in it:
            if pdf.empty:
                continue
            x_all = pdf[xc].to_numpy(float) - pdf[sc].to_numpy(float)
            # segments of this batch as contiguous slices of one sort (no per-segment DataFrames)
            codes = pdf.groupby(gkeys, dropna=False, sort=False).ngroup().to_numpy() if gkeys else np.zeros(len(pdf), int)
            order = np.argsort(codes, kind="stable")
            cs = codes[order]
            starts = np.r_[0, np.flatnonzero(np.diff(cs)) + 1]
            ends = np.r_[starts[1:], len(cs)]
            vals, first = [], []
            for s0, e0 in zip(starts, ends):
                idx = order[s0:e0]
                x = x_all[idx]
                x = x[~np.isnan(x).any(axis=1)]  # complete rows only
                if len(x) == 0:
                    continue
                xtx = x.T @ x
                vals.append(np.concatenate([xtx[ii, jj], x.sum(axis=0), [float(len(x))]]))
                first.append(idx[0])
            if not vals:
                continue
            g = len(vals)
            out = pd.DataFrame({"i": np.tile(ci, g), "j": np.tile(cj, g), "v": np.concatenate(vals)})
            for name in gkeys:
                out[name] = np.repeat(pdf[name].to_numpy()[first], len(ci))
            yield out[[f.name for f in out_schema.fields]]

    sums = data.mapInPandas(block, out_schema).groupBy(*gkeys, "i", "j").agg(F.sum("v").alias("v"))
    # Assemble one row per group from its summed cells: at most k(k+1)/2 + k + 1 rows per group, however
    # many data rows the group has, so a hot segment costs the same as any other here.
    shift_arr = shift.select(*gkeys, F.array(*[F.col(f"__s{i}") for i in range(k)]).alias("__shift"))
    cells = attach(sums, shift_arr, gkeys, seg_bytes(shift_arr, gkeys))
    if not gkeys:
        cells = cells.withColumn("__g", F.lit(0))
    keys = gkeys or ["__g"]
    res_schema = T.StructType([f for f in cells.schema.fields if f.name in keys] + [
        T.StructField("n", T.LongType()), T.StructField("mean", T.ArrayType(T.DoubleType())),
        T.StructField("cov", T.ArrayType(T.DoubleType()))])

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        i = pdf["i"].to_numpy()
        j = pdf["j"].to_numpy()
        v = pdf["v"].to_numpy(float)
        shift_v = np.asarray(pdf["__shift"].iloc[0], float)
        n = float(v[(i == -1) & (j == -1)][0])
        sx = np.zeros(k)
        sel = (i >= 0) & (j == -1)
        sx[i[sel]] = v[sel]
        xtx = np.zeros((k, k))
        sel = (i >= 0) & (j >= 0)
        xtx[i[sel], j[sel]] = v[sel]
        xtx = np.triu(xtx) + np.triu(xtx, 1).T
        msh = sx / n
        cov = xtx / n - np.outer(msh, msh)
        row = {c: pdf[c].iloc[0] for c in keys}
        row.update({"n": int(n), "mean": (shift_v + msh).tolist(), "cov": cov.reshape(-1).tolist()})
        return pd.DataFrame([row], columns=[f.name for f in res_schema.fields])

    out = cells.groupBy(*keys).applyInPandas(assemble, res_schema)
    if gkeys:
        return out
    # without keys there is one row, as from an aggregation: n = 0 if no row is complete
    none = F.array_repeat(F.lit(None).cast("double"), F.lit(k))
    one = base.sparkSession.range(1).select(F.lit(0).alias("__g"))
    return one.join(out, "__g", "left").select(
        F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("mean", none).alias("mean"),
        F.coalesce("cov", F.array_repeat(F.lit(None).cast("double"), F.lit(k * k))).alias("cov"))
