"""Row-wise preparation: target filtering, inf/NaN handling, imputation, one-hot,
engineered features, deterministic splits/folds and standardisation.

Everything is a projection, except where a per-segment constant is needed
(medians, means, category lists); those come from one aggregation and are
attached per segment with a size-checked join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.columns import as_double, finite_or_null, seg_cols
from tabscope.operators.quantiles import quantiles_wide
from tabscope.operators.segments import attach, seg_bytes


def drop_null_target(df: DataFrame, target: str, inf_as_null: bool = False) -> DataFrame:
    """FLT1: drop rows whose target is null (NaN counts as null; +/-inf too when asked)."""
    t = as_double(df, target) if not inf_as_null else finite_or_null(as_double(df, target))
    return df.where(t.isNotNull())


def inf_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CLN1: +/-inf (and NaN) become null in the given numeric columns."""
    cols = set(columns)
    return df.select(*[finite_or_null(as_double(df, c)).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CLN2: nulls in the given numeric columns become 0."""
    cols = set(columns)
    return df.select(*[F.coalesce(as_double(df, c), F.lit(0.0)).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def impute_median(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), inf_as_null: bool = True) -> DataFrame:
    """CLN3: null -> the column's median over all rows of the segment, then 0 for all-null columns.

    Medians are exact (linear interpolation), computed once per segment and attached.
    """
    by = seg_cols(by)
    base = inf_to_null(df, columns) if inf_as_null else df
    # Only columns that hold a null anywhere need a median (one cheap count aggregation decides).
    nulls = base.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"__n{i}") for i, c in enumerate(columns)]).collect()[0]
    need = [c for i, c in enumerate(columns) if nulls[f"__n{i}"] > 0]
    if not need:
        return base.select(*[as_double(base, c).alias(c) if c in set(columns) else F.col(f"`{c}`") for c in base.columns])
    if len(need) < len(columns):
        base = base.select(*[as_double(base, c).alias(c) if c in set(columns) and c not in set(need) else F.col(f"`{c}`")
                             for c in base.columns])
        columns = need
    med = quantiles_wide(base, columns, [0.5], ["median"], by).drop("n")
    wide = med.groupBy(*by).agg(*[F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"__m{i}") for i, c in enumerate(columns)])
    if not by:
        row = wide.collect()
        meds = [row[0][f"__m{i}"] if row else None for i in range(len(columns))]  # k numbers
        out = base
        for c, m in zip(columns, meds):
            out = out.withColumn(c, F.coalesce(as_double(base, c), F.lit(m if m is not None else 0.0).cast("double")))
        return out
    wide = wide.checkpoint(eager=True)
    j = attach(base, wide, by, seg_bytes(wide, by))
    for i, c in enumerate(columns):
        j = j.withColumn(c, F.coalesce(as_double(j, c), F.col(f"__m{i}"), F.lit(0.0)))
    return j.drop(*[f"__m{i}" for i in range(len(columns))]).select(*df.columns)


#: Categories of a column that one-hot encoding takes; their names come to the driver, and each is a column.
MAX_CATEGORIES = 1000


def categories(df: DataFrame, columns: Sequence[str], max_categories: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """The sorted non-null values of each column, from one job; an error if a column has more than ``max_categories``."""
    columns = list(columns)
    if not columns:
        return {}
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v"))
                                           for i, c in enumerate(columns)])).alias("x")).select("x.*").where("v is not null")
    found = values.distinct().limit(len(columns) * max_categories + 1).collect()  # bounded by the limit on categories
    cats = {c: sorted(r["v"] for r in found if r["i"] == i) for i, c in enumerate(columns)}
    if len(found) > len(columns) * max_categories or any(len(v) > max_categories for v in cats.values()):
        raise ValueError(f"one of {columns} has more than {max_categories} categories; encode it another way")
    return cats


def indicator_names(cats: dict[str, list[str]], taken: Sequence[str]) -> dict[tuple[str, str], str]:
    """Name of the indicator of each (column, category) but the first: <column>_<category>, with the suffix ``_enc`` as often
    as it takes to differ from the columns ``taken`` and from one another (letter case doesn't tell names apart)."""
    used, names = {t.lower() for t in taken}, {}
    for c, vs in cats.items():
        for v in vs[1:]:
            name = f"{c}_{v}"
            while name.lower() in used:
                name += "_enc"
            used.add(name.lower())
            names[c, v] = name
    return names


def _indicators(names: dict[tuple[str, str], str]) -> list[Column]:
    return [F.when(F.col(f"`{c}`").cast("string") == v, F.lit(1)).otherwise(F.lit(0)).alias(name) for (c, v), name in names.items()]


def one_hot(df: DataFrame, columns: Sequence[str], max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """ENC1: one 0/1 column per category except the first (sorted); null -> all zeros.

    All columns are added in one projection; beyond ``max_categories`` the call fails rather than dropping any.
    """
    cats = categories(df, columns, max_categories)
    left = [c for c in df.columns if c not in cats]
    return df.select(*[F.col(f"`{c}`") for c in left], *_indicators(indicator_names(cats, left)))


def encode_features(df: DataFrame, features: Sequence[str], max_categories: int = MAX_CATEGORIES) -> tuple[DataFrame, list[str]]:
    """df with 0/1 columns added for its string and boolean features, and the numeric feature names to use: each
    such feature's indicators stand where it stood."""
    text = [f for f in features if isinstance(df.schema[f].dataType, (T.StringType, T.BooleanType))]
    if not text:
        return df, list(features)
    cats = categories(df, text, max_categories)
    named = indicator_names(cats, df.columns)
    names = [n for f in features for n in ([named[f, v] for v in cats[f][1:]] if f in cats else [f])]
    return df.select("*", *_indicators(named)), names


def square_interaction(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """FEA1/FEA2: add <f0>_squared and <f0>_x_<f1> (suffix _eng on a name clash)."""
    added = []
    existing = set(df.columns)
    out = df
    if not features:
        return out, added
    f0 = features[0]
    sq = f"{f0}_squared"
    if sq in existing:
        sq = f"{f0}_squared_eng"
    out = out.withColumn(sq, as_double(df, f0) * as_double(df, f0))
    added.append(sq)
    existing.add(sq)
    if len(features) >= 2:
        f1 = features[1]
        ia = f"{f0}_x_{f1}"
        if ia in existing:
            ia = f"{ia}_eng"
        out = out.withColumn(ia, as_double(df, f0) * as_double(df, f1))
        added.append(ia)
    return out, added


def split_flag(key: Column | str, test_pct: int = 20, seed: int = 42, method: str = "hash") -> Column:
    """SPL1: deterministic test-set flag from a row key (order- and partition-independent).

    ``hash``: pmod(xxhash64(key, seed), 100) < test_pct;
    ``mod``: pmod(key, round(100 / test_pct)) = 0 (reproducible in any SQL engine).
    """
    k = F.col(key) if isinstance(key, str) else key
    if method == "mod":
        return F.pmod(k, F.lit(int(round(100 / test_pct)))) == 0
    return F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(100)) < test_pct


def fold_of(key: Column | str, k: int, seed: int = 7, method: str = "hash", stride: int = 1) -> Column:
    """SPL2: fold id in [0, k) from a row key (``mod``: pmod(key div stride, k))."""
    c = F.col(key) if isinstance(key, str) else key
    if method == "mod":
        return F.pmod(F.floor(c / stride), F.lit(k)).cast("int")
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(k)).cast("int")


def n_folds(n_train: int) -> int:
    """Folds used for cross-validation: between 2 and 5, about two rows per fold at least."""
    return max(2, min(5, n_train // 2))


def standardize(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """SCL1: (x - mean) / population std per segment; a constant column is divided by 1."""
    by = seg_cols(by)
    stats = df.groupBy(*by).agg(*[
        F.struct(F.avg(as_double(df, c)).alias("m"), F.stddev_pop(as_double(df, c)).alias("s")).alias(f"__s{i}")
        for i, c in enumerate(columns)]).checkpoint(eager=True)
    j = attach(df, stats, by, seg_bytes(stats, by))
    for i, c in enumerate(columns):
        s = F.col(f"__s{i}.s")
        scale = F.when((s.isNull()) | (s == 0), F.lit(1.0)).otherwise(s)
        j = j.withColumn(c, (as_double(j, c) - F.col(f"__s{i}.m")) / scale)
    return j.drop(*[f"__s{i}" for i in range(len(columns))])
