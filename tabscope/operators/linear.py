"""Linear models from moments: holdout OLS, importances, VIF, PCA and exact k-fold CV.

One grouped moments pass per question (grouped additionally by the test flag
or the fold id) gives everything; a pandas UDF then solves the k x k systems
for each segment row.  No row-level data leaves the aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions import linalg
from tabscope.functions.columns import as_double, finite_or_null, seg_cols
from tabscope.operators.moments import moments
from tabscope.operators.prepare import drop_null_target, encode_features, impute_median
from tabscope.operators.segments import seg_join

MIN_ROWS = 20
# R^2 bands.
R2_CRITICAL = 0.2
R2_WARNING = 0.5


def prepare_xy(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = (), fill: str = "zero",
               keep: Sequence[str] = ()) -> DataFrame:
    """Rows with a non-null target; features with +/-inf -> null -> 0 (``zero``) or segment median (``median``)."""
    by = seg_cols(by)
    d = drop_null_target(df, target, inf_as_null=(fill == "median"))
    extra = [c for c in keep if c not in by and c not in features and c != target]
    if fill == "median":
        d = d.select(*[F.col(f"`{c}`") for c in by + extra], *[finite_or_null(as_double(d, c)).alias(c) for c in features],
                     as_double(d, target).alias(target))
        return impute_median(d, list(features), by)
    return d.select(*[F.col(f"`{c}`") for c in by + extra],
                    *[F.coalesce(finite_or_null(as_double(d, c)), F.lit(0.0)).alias(c) for c in features],
                    as_double(d, target).alias(target))


def r2_band(r2: Column) -> Column:
    """REG4: critical below 0.2, warning below 0.5, else ok; not_scored without an R^2 (no test rows)."""
    return F.when(r2.isNull() | F.isnan(r2), F.lit("not_scored")).when(r2 < R2_CRITICAL, F.lit("critical")).when(r2 < R2_WARNING, F.lit("warning")).otherwise(F.lit("ok"))


_HOLDOUT_SCHEMA = T.StructType([
    T.StructField("n_train", T.LongType()), T.StructField("n_test", T.LongType()),
    T.StructField("fitted", T.BooleanType()), T.StructField("r2", T.DoubleType()), T.StructField("rmse", T.DoubleType()),
    T.StructField("intercept", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType())),
    T.StructField("std_importance", T.ArrayType(T.DoubleType())),
    T.StructField("perm_importance", T.ArrayType(T.DoubleType())),
    T.StructField("vif_std", T.ArrayType(T.DoubleType())),
])


#: Numbers in the stacked matrices that a task solves at once.
SOLVE_CELLS = 1 << 20


def _holdout_udf(k: int, min_rows: int):
    p = k + 1

    def stacked(n: np.ndarray, mean: pd.Series, cov: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        m, c, some = np.zeros((len(n), p)), np.zeros((len(n), p, p)), np.flatnonzero(n > 0)
        if len(some):
            m[some] = np.stack([np.asarray(x, float) for x in mean.iloc[some]])
            c[some] = np.stack([linalg.as_matrix(x, p) for x in cov.iloc[some]])
        return m, c

    @F.pandas_udf(_HOLDOUT_SCHEMA)
    def solve(n_tr: pd.Series, m_tr: pd.Series, c_tr: pd.Series, n_te: pd.Series, m_te: pd.Series, c_te: pd.Series) -> pd.DataFrame:
        ntr, nte = n_tr.fillna(0).to_numpy("int64"), n_te.fillna(0).to_numpy("int64")
        fitted = (ntr + nte >= min_rows) & (ntr > 0) & (k > 0)
        cols = {f.name: np.full(len(ntr), None, object) for f in _HOLDOUT_SCHEMA.fields}
        cols |= {"n_train": ntr, "n_test": nte, "fitted": fitted}
        cols["r2"][~fitted] = 0.0
        at, step = np.flatnonzero(fitted), max(1, SOLVE_CELLS // (p * p))
        for lo in range(0, len(at), step):  # the segments' systems at once, in blocks of bounded size
            s = at[lo:lo + step]
            b, a, r2, mse, perm, b_all, sd, vif = linalg.holdout_many(
                ntr[s], *stacked(ntr[s], m_tr.iloc[s], c_tr.iloc[s]), nte[s], *stacked(nte[s], m_te.iloc[s], c_te.iloc[s]))
            std_imp, rmse, tested = np.abs(b_all) * sd, np.sqrt(mse), nte[s] > 0
            for j, i in enumerate(s):
                cols["intercept"][i], cols["coef"][i], cols["std_importance"][i], cols["vif_std"][i] = a[j], b[j], std_imp[j], vif[j]
                if tested[j]:
                    cols["r2"][i], cols["rmse"][i], cols["perm_importance"][i] = r2[j], rmse[j], perm[j]
        return pd.DataFrame(cols)
    return solve


def linear_analysis(df: DataFrame, features: Sequence[str], target: str, test_flag: Column, by: Sequence[str] = (),
                    fill: str = "zero", min_rows: int = MIN_ROWS, prepared: bool = False,
                    split_moments: DataFrame | None = None) -> DataFrame:
    """One row per segment: holdout fit (train rows where ``test_flag`` is false), test R^2/RMSE, coefficients,
    standardized importance (all rows), expected permutation importance (test rows), standardized VIF (all rows).

    ``test_flag`` must be computable on ``df`` (typically ``split_flag(key)``); the key column is kept through
    preparation and not used as a feature.  String and boolean features are one-hot encoded.  ``split_moments``: the moments of
    features and target by segment and ``__test``, if they are at hand.
    """
    by = seg_cols(by)
    if not prepared:
        df, features = encode_features(df, features)
    feats = list(features)
    k = len(feats)
    if prepared:
        d = df.withColumn("__test", test_flag)
    else:
        d = df.withColumn("__test", test_flag)
        d = prepare_xy(d, feats, target, by, fill, keep=["__test"])
    # One row per (segment, split): materialise it once for the train/test pairing and the solve.
    m = split_moments if split_moments is not None else moments(d, feats + [target], by, part=F.col("__test"), part_name="__test").checkpoint(eager=True)
    tr = m.where(~F.col("__test")).select(*by, F.col("n").alias("n_tr"), F.col("mean").alias("m_tr"), F.col("cov").alias("c_tr"))
    te = m.where(F.col("__test")).select(*by, F.col("n").alias("n_te"), F.col("mean").alias("m_te"), F.col("cov").alias("c_te"))
    j = seg_join(tr, te, by, "full")
    solve = _holdout_udf(k, min_rows)
    res = j.select(*by, solve("n_tr", "m_tr", "c_tr", "n_te", "m_te", "c_te").alias("s")).select(*by, "s.*")
    return res.withColumn("features", F.array(*[F.lit(f) for f in feats]))


def ols_holdout(analysis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """REG1 + REG4: (by..., n_train, n_test, r2, rmse, severity)."""
    by = seg_cols(by)
    return analysis.select(*by, "n_train", "n_test", "r2", "rmse", r2_band(F.col("r2")).alias("severity"))


def ols_coefficients(analysis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, coef) with an '(intercept)' row, from the training fit."""
    by = seg_cols(by)
    fitted = analysis.where("fitted")
    coefs = fitted.select(*by, F.explode(F.arrays_zip(F.col("features").alias("feature"), F.col("coef").alias("coef"))).alias("z")) \
        .select(*by, F.col("z.feature").alias("feature"), F.col("z.coef").alias("coef"))
    icpt = fitted.select(*by, F.lit("(intercept)").alias("feature"), F.col("intercept").alias("coef"))
    return coefs.unionByName(icpt)


def importance(analysis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """REG2 + REG3: (by..., kind, feature, importance, rank); standardized ranked by value, permutation by |value|,
    ties broken towards the later column."""
    by = seg_cols(by)
    from pyspark.sql import Window
    fitted = analysis.where("fitted")
    parts = []
    for kind, col in (("standardized", "std_importance"), ("permutation", "perm_importance")):
        z = fitted.where(F.col(col).isNotNull()).select(
            *by, F.posexplode(F.arrays_zip(F.col("features").alias("feature"), F.col(col).alias("importance"))).alias("pos", "z"))
        z = z.select(*by, F.lit(kind).alias("kind"), "pos", F.col("z.feature").alias("feature"), F.col("z.importance").alias("importance"))
        parts.append(z)
    allp = parts[0].unionByName(parts[1])
    w = (Window.partitionBy(*[F.col(f"`{b}`") for b in by], "kind") if by else Window.partitionBy("kind")).orderBy(
        F.abs("importance").desc(), F.col("pos").desc())
    return allp.withColumn("rank", F.row_number().over(w)).drop("pos")


def strongest_feature(analysis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., strongest_feature, top_importance): rank 1 of the standardized importance."""
    by = seg_cols(by)
    imp = importance(analysis, by).where((F.col("kind") == "standardized") & (F.col("rank") == 1))
    return imp.select(*by, F.col("feature").alias("strongest_feature"), F.col("importance").alias("top_importance"))


def vif_std_table(analysis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """VIF2: (by..., feature, vif) on standardized features (all rows), sorted descending by consumers."""
    by = seg_cols(by)
    return analysis.where("fitted").select(
        *by, F.explode(F.arrays_zip(F.col("features").alias("feature"), F.col("vif_std").alias("vif"))).alias("z")
    ).select(*by, "z.feature", "z.vif")


_VIF_SCHEMA = T.ArrayType(T.DoubleType())


def _vif_udf(k: int, centered: bool):
    @F.pandas_udf(_VIF_SCHEMA)
    def solve(n: pd.Series, mean: pd.Series, cov: pd.Series) -> pd.Series:
        out = []
        for nn, m, c in zip(n, mean, cov):
            if pd.isna(nn) or nn == 0:
                out.append(None)
                continue
            m = np.asarray(m, float)
            c = linalg.as_matrix(c, k)
            if centered:
                g, _ = linalg.corr_from_cov(c, mean=m)
            else:
                g = c + np.outer(m, m)
            out.append(linalg.vif_from_gram(g, centered).tolist())
        return pd.Series(out)
    return solve


def vif(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), basis: str = "std") -> DataFrame:
    """VIF1 (``raw``: uncentered, no intercept, raw values) or VIF2 (``std``: standardized) on complete rows;
    +/-inf counts as missing.

    (by..., feature, basis, vif); NaN for an all-zero/constant column, inf for a perfect fit.
    """
    by = seg_cols(by)
    cols = list(columns)
    finite = df.select(*[F.col(f"`{b}`") for b in by], *[finite_or_null(as_double(df, c)).alias(c) for c in cols])
    m = moments(finite, cols, by)
    solve = _vif_udf(len(cols), centered=(basis == "std"))
    res = m.select(*by, solve("n", "mean", "cov").alias("v"))
    z = res.select(*by, F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in cols]).alias("feature"), F.col("v").alias("vif"))).alias("z"))
    return z.select(*by, F.col("z.feature").alias("feature"), F.lit(basis).alias("basis"),
                    F.when(~F.isnan("z.vif"), F.col("z.vif")).alias("vif"))


def vif_prune(vif_table: DataFrame, by: Sequence[str] = (), threshold: float = 5.0) -> DataFrame:
    """VIF3: (by..., feature, vif, kept, reason); drop VIF > threshold (undefined VIF is dropped too);
    if nothing would be kept, keep everything."""
    by = seg_cols(by)
    from pyspark.sql import Window
    keep = F.col("vif").isNotNull() & (F.col("vif") <= threshold)
    w = Window.partitionBy(*[F.col(f"`{b}`") for b in by]) if by else Window.partitionBy(F.lit(0))
    t = vif_table.withColumn("__any", F.max(keep.cast("int")).over(w))
    kept = keep | (F.col("__any") == 0)
    reason = F.when(F.col("__any") == 0, F.lit("none_below_threshold")).when(keep, F.lit("kept")) \
        .when(F.col("vif").isNull(), F.lit("undefined")).otherwise(F.lit("above_threshold"))
    return t.select(*by, "feature", "vif", kept.alias("kept"), reason.alias("reason"))


_PCA_SCHEMA = T.StructType([
    T.StructField("n_components", T.IntegerType()), T.StructField("explained", T.DoubleType()),
    T.StructField("eigenvalues", T.ArrayType(T.DoubleType())), T.StructField("loadings", T.ArrayType(T.DoubleType())),
])


def _pca_udf(k: int, ratio: float):
    @F.pandas_udf(_PCA_SCHEMA)
    def solve(n: pd.Series, mean: pd.Series, cov: pd.Series) -> pd.DataFrame:
        out = []
        for nn, m, c in zip(n, mean, cov):
            r, _ = linalg.corr_from_cov(linalg.as_matrix(c, k), mean=np.asarray(m, float))
            mm, expl, w, v = linalg.pca_components(r, ratio)
            out.append({"n_components": mm, "explained": expl, "eigenvalues": w.tolist(), "loadings": v.T.reshape(-1).tolist()})
        return pd.DataFrame(out, columns=[f.name for f in _PCA_SCHEMA.fields])
    return solve


def pca(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), ratio: float = 0.95) -> DataFrame:
    """EXP3: (by..., n_components, explained, eigenvalues, loadings) of the standardized columns;
    the smallest number of components whose cumulative explained ratio exceeds ``ratio``."""
    by = seg_cols(by)
    m = moments(df, list(columns), by)
    return m.select(*by, "n", "mean", "cov", _pca_udf(len(columns), ratio)("n", "mean", "cov").alias("p")).select(*by, "n", "mean", "cov", "p.*")


def pca_project(df: DataFrame, columns: Sequence[str], model: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Append pc_0..pc_{k-1} (null beyond n_components) computed from standardized columns and the segment's loadings."""
    by = seg_cols(by)
    k = len(columns)
    from tabscope.operators.segments import attach, seg_bytes
    small = model.select(*by, "n_components", "mean", "cov", "loadings")
    j = attach(df, small, by, seg_bytes(small, by))
    z = []
    for i, c in enumerate(columns):
        sd = F.sqrt(F.col("cov")[i * k + i])
        scale = F.when(sd > 0, sd).otherwise(F.lit(1.0))
        z.append((as_double(j, c) - F.col("mean")[i]) / scale)
    for p in range(k):
        comp = sum((F.col("loadings")[p * k + i] * z[i] for i in range(k)), F.lit(0.0))
        j = j.withColumn(f"pc_{p}", F.when(F.lit(p) < F.col("n_components"), comp))
    return j.drop("n_components", "mean", "cov", "loadings")


_CV_SCHEMA = T.StructType([
    T.StructField("folds", T.IntegerType()), T.StructField("cv_r2_mean", T.DoubleType()), T.StructField("cv_r2_std", T.DoubleType()),
])


def _cv_udf(k: int):
    @F.pandas_udf(_CV_SCHEMA)
    def solve(fold_ids: pd.Series, ns: pd.Series, means: pd.Series, covs: pd.Series) -> pd.DataFrame:
        out = []
        for fids, n, m, c in zip(fold_ids, ns, means, covs):
            parts = {int(f): (int(nn), np.asarray(mm, float), linalg.as_matrix(cc, k + 1)) for f, nn, mm, cc in zip(fids, n, m, c)}
            scores = []
            for f, te in parts.items():
                tr = linalg.merge([p for g, p in parts.items() if g != f])
                if tr[0] == 0:
                    continue
                b, a = linalg.ols(tr[1], tr[2])
                scores.append(linalg.r2_sse(b, a, te[1], te[2])[0])
            out.append({"folds": len(parts), "cv_r2_mean": float(np.mean(scores)) if scores else None,
                        "cv_r2_std": float(np.std(scores)) if scores else None})
        return pd.DataFrame(out, columns=[f.name for f in _CV_SCHEMA.fields])
    return solve


def ols_cv(df: DataFrame, features: Sequence[str], target: str, fold: Column, by: Sequence[str] = (),
           prepared: bool = True) -> DataFrame:
    """Exact k-fold CV of OLS: moments per fold in one pass; fold f is scored by the fit on the merge of the others.
    (by..., folds, cv_r2_mean, cv_r2_std (population))."""
    by = seg_cols(by)
    feats = list(features)
    d = df.withColumn("__fold", fold)
    if not prepared:
        d = prepare_xy(d, feats, target, by, keep=["__fold"])
    m = moments(d, feats + [target], by, part=F.col("__fold"), part_name="__fold")
    # The per-segment fold list is bounded by the number of folds.
    g = m.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("__fold").alias("f"), "n", F.col("mean").alias("m"), F.col("cov").alias("c")))).alias("p"))
    return g.select(*by, _cv_udf(len(feats))("p.f", "p.n", "p.m", "p.c").alias("s")).select(*by, "s.*")
