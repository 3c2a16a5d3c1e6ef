"""Global row numbers, and what needs them: contiguous folds and shuffled permutation importance.

Spark rows have no position.  ``number_rows`` gives them one without a window over the whole table: a range shuffle on
(segment, order) and a sort in each partition put the rows in order, ``monotonically_increasing_id`` numbers them within
their partition, and the partitions' row counts (one small row each) are summed up to the offset of each partition.
A segment that holds a third of all rows is spread over as many partitions as its rows need, as the range bounds cut it
by the order columns.  Rows equal in all order columns share a partition and get their numbers in any order: pass
columns that tell rows apart where that matters.  Spark samples the order columns on the driver to find the bounds, so
they should be narrow (keys, numbers, hashes), not long texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.columns import seg_cols
from tabscope.operators.segments import BROADCAST_BYTES, seg_bytes, seg_join

_ID, _PART, _AT = "__row_id", "__row_part", "__row_offset"
LOCAL_BITS = 33  # monotonically_increasing_id: the partition above, the row in it below


def number_rows(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "row_nr") -> DataFrame:
    """df with ``name``: the row's place (from 0) in its segment, ordered by ``order`` (nulls first).

    The sorted rows are checkpointed once, which fixes their numbers; null segment keys form a segment.  An empty table
    gives an empty table; a column of that name is replaced."""
    by = seg_cols(by)
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in [*by, *order]]
    rows = df.drop(name).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_ID, F.monotonically_increasing_id())
    rows = rows.checkpoint(eager=True).withColumn(_PART, F.shiftright(_ID, LOCAL_BITS))
    # one row for each partition: their number is the shuffle's, not the data's
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col(_PART).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(F.col("p").alias(_PART), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(_AT))
    place = F.col(_ID).bitwiseAND(F.lit((1 << LOCAL_BITS) - 1)) + F.col(_AT)
    out = rows.join(F.broadcast(offsets), _PART).withColumn(name, place).drop(_ID, _PART, _AT)
    if not by:
        return out
    return _joined(out, out.groupBy(*by).agg(F.min(name).alias("__row_first")), by).withColumn(name, F.col(name) - F.col("__row_first")).drop("__row_first")


def _joined(rows: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows with their segment's row of ``small``, which is checkpointed and broadcast if it is small: a shuffle on the
    segment would bring each of few large segments to one task."""
    small = small.checkpoint(eager=True)
    return seg_join(rows, small, by, broadcast_right=seg_bytes(small, by) <= BROADCAST_BYTES)


def contiguous_fold(row_nr: Column, n: Column, k: int) -> Column:
    """SPL2 without shuffling: fold of the row at place ``row_nr`` of ``n`` when the rows are cut into ``k`` blocks, the
    first n % k of them one row longer."""
    q, r = F.floor(n / F.lit(k)), F.pmod(n, F.lit(k))
    longer = r * (q + 1)
    fold = F.when(row_nr < longer, F.floor(row_nr / (q + 1))).otherwise(r + F.floor((row_nr - longer) / F.greatest(q, F.lit(1))))
    return fold.cast("int")


def contiguous_folds(df: DataFrame, order: Sequence[str], k: int, by: Sequence[str] = (), name: str = "fold") -> DataFrame:
    """df with ``name``: the contiguous fold (0 to k - 1) of each row in its segment's order."""
    by = seg_cols(by)
    numbered = number_rows(df, order, by, "__fold_nr")
    sizes = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("__fold_n"))
    out = _joined(numbered, sizes, by)
    return out.withColumn(name, contiguous_fold(F.col("__fold_nr"), F.col("__fold_n"), k)).drop("__fold_nr", "__fold_n")


def shuffled_importance(predict: Callable[[DataFrame], DataFrame], df: DataFrame, features: Sequence[str], target: str,
                        key: Sequence[str], repeats: int = 10, seed: int = 42) -> DataFrame:
    """REG3 for any model: (feature, importance, importance_std, rank), the loss of R^2 over ``df`` when a feature's values
    are shuffled, as mean and population deviation over ``repeats`` shuffles.

    ``predict`` appends ``prediction`` to a table with the feature columns; ``key`` tells the rows apart.  A shuffle is
    the order of md5(seed:repeat:key): the row at place i in key order takes the values of the row at place i in that
    order.  All repeats are numbered and joined at once, and each joined row becomes one row for each feature, so
    the number of jobs depends on neither.  Within a repeat all features follow the same shuffle, one at a time.
    Rows with a null target are left out; without rows, or with a constant target, the importance is null."""
    feats = list(features)
    rows = df.where(F.col(f"`{target}`").isNotNull())
    text = F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in key])
    base = rows.select(*[F.col(f"`{c}`") for c in feats], F.col(f"`{target}`").cast("double").alias("__y"), text.alias("__key"))
    base = number_rows(base, ["__key"], name="__nr").checkpoint(eager=True)
    whole = predict(base).agg(F.sum((F.col("__y") - F.col("prediction")) ** 2).alias("sse"),
                              (F.var_pop("__y") * F.count(F.lit(1))).alias("sst"))

    donors = base.select(F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("__rep"), "__key",
                         F.struct(*[F.col(f"`{c}`") for c in feats]).alias("__given"))
    donors = donors.withColumn("__hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__rep").cast("string"), F.col("__key"))))
    donors = number_rows(donors.drop("__key"), ["__hash"], by=["__rep"], name="__nr").drop("__hash")
    pairs = base.drop("__key").join(donors, "__nr")
    variants = F.explode(F.array(*[
        F.struct(F.lit(i).alias("__pos"), *[(F.col("__given")[c] if c == f else F.col(f"`{c}`")).alias(c) for c in feats])
        for i, f in enumerate(feats)]))
    scored = predict(pairs.select("__rep", "__y", variants.alias("__v")).select("__rep", "__y", "__v.*"))
    losses = scored.groupBy("__rep", "__pos").agg(F.sum((F.col("__y") - F.col("prediction")) ** 2).alias("sse"))
    drop = (F.col("sse") - F.col("base")) / F.when(F.col("sst") > 0, F.col("sst"))
    per_repeat = losses.crossJoin(F.broadcast(whole.select(F.col("sse").alias("base"), "sst"))).withColumn("drop", drop)  # one row on the right
    out = per_repeat.groupBy("__pos").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("importance_std"))
    names = F.array(*[F.lit(f) for f in feats])
    ranked = F.row_number().over(Window.orderBy(F.col("importance").desc_nulls_last(), "__pos"))  # one row a feature
    return out.select(names[F.col("__pos")].alias("feature"), "importance", "importance_std", ranked.alias("rank"))
