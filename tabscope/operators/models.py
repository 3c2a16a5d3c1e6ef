"""Model comparison with MLlib (MOD1) and ranking (MOD2).

Linear Regression, Random Forest and Gradient-Boosted Trees are trained by
MLlib on the executors (distributed tree induction over binned features), trees
beyond 100,000 rows by its method over cells of equal bins (``trees``); the
features are prepared as the comparison requires: +/-inf -> null, rows with a
null target dropped, features median-imputed (exact medians).  Only scalar
metrics return to the driver.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators import trees
from tabscope.operators.linear import prepare_xy
from tabscope.operators.prepare import encode_features

MIN_ROWS = 20

# Model settings of the comparison.  The forest has no depth limit there; 30 is MLlib's deepest.
RF_PARAMS = {"numTrees": 100, "maxDepth": 30, "featureSubsetStrategy": "all", "seed": 42}
GBT_PARAMS = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9", "seed": 42}


#: Rows that are worth a task of their own, and the most that one task should hold.
TASK_ROWS, MOST_ROWS = 100_000, 1_000_000


def spread(df: DataFrame, n_rows: int) -> DataFrame:
    """The rows dealt evenly over the tasks.  A tree fit runs hundreds of jobs over the partitions that the scan made, which
    follow the file's row groups and not its rows: a table of one row group would be fitted by one task."""
    if n_rows <= TASK_ROWS:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(min(-(-n_rows // TASK_ROWS), cores), -(-n_rows // MOST_ROWS)))


def counted(df: DataFrame) -> tuple[int, int, int]:
    """Rows, training rows (``__test`` is false) and the most rows in one task."""
    tasks = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("__test")).alias("t"))
    r = tasks.agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.max("n").alias("most")).first()
    return r["n"] or 0, r["t"] or 0, r["most"] or 0


@contextmanager
def dealt(df: DataFrame, n_rows: int, most: int) -> Iterator[DataFrame]:
    """The rows for a few scans, spread and kept if one task has over twice its share (``most``)."""
    if n_rows <= TASK_ROWS or most <= 2 * -(-n_rows // df.sparkSession.sparkContext.defaultParallelism):
        yield df
        return
    out = spread(df, n_rows).persist()
    try:
        yield out
    finally:
        out.unpersist()


def _assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="keep").transform(df)


def _metrics(pred: DataFrame, target: str) -> tuple[float | None, float | None]:
    """Test R^2 (1 - SSE/SST around the test mean) and RMSE in one aggregation."""
    r = pred.agg(F.sum((F.col(target) - F.col("prediction")) ** 2).alias("sse"), F.var_pop(target).alias("vy"),
                 F.count(F.lit(1)).alias("n")).collect()[0]
    if not r["n"]:
        return None, None
    sst = r["vy"] * r["n"]
    r2 = (1.0 - r["sse"] / sst) if sst > 0 else (1.0 if r["sse"] == 0 else 0.0)
    return r2, (r["sse"] / r["n"]) ** 0.5


def compare_models(df: DataFrame, features: Sequence[str], target: str, test_flag: Column,
                   rf_params: dict | None = None, gbt_params: dict | None = None) -> DataFrame:
    """MOD1: (name, model_order, r2, rmse, training_time, interpretability) for the three models.

    String and boolean features are one-hot encoded.
    Returns an empty table when fewer than 20 rows remain after dropping null targets.
    """
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    spark: SparkSession = df.sparkSession
    df, feats = encode_features(df, features)
    d = prepare_xy(df.withColumn("__test", test_flag), feats, target, fill="median", keep=["__test"])
    schema = "name string, model_order int, r2 double, rmse double, training_time double, interpretability string"
    n_rows, _, most = counted(d)
    if n_rows < MIN_ROWS:
        return spark.createDataFrame([], schema)
    specs = [
        ("Linear Regression", LinearRegression(featuresCol="__features", labelCol=target, regParam=0.0, solver="normal"), "HIGH"),
        ("Random Forest", RandomForestRegressor(featuresCol="__features", labelCol=target, cacheNodeIds=True, **{**RF_PARAMS, **(rf_params or {})}), "MEDIUM"),
        ("Gradient Boosting", GBTRegressor(featuresCol="__features", labelCol=target, **{**GBT_PARAMS, **(gbt_params or {})}), "MEDIUM"),
    ]
    rows = []
    with dealt(d, n_rows, most) as d:
        a = _assemble(d, feats).select("__features", target, "__test")
        train, test = a.where(~F.col("__test")), a.where(F.col("__test"))
        try:
            for order, (name, est, interp) in enumerate(specs):
                t0 = time.perf_counter()
                by_cell = trees.fit_scores(est, d, feats, target) if order and n_rows > TASK_ROWS else None
                if by_cell:
                    (r2, rmse), dt = by_cell[0], time.perf_counter() - t0  # grown and tried in one go
                else:
                    if order or n_rows <= TASK_ROWS:  # trees read the rows for every level, the linear model once
                        a.persist()
                    model = est.fit(train)
                    dt = time.perf_counter() - t0
                    r2, rmse = _metrics(model.transform(test), target)
                rows.append((name, order, r2, rmse, dt, interp))
        finally:
            a.unpersist()
    return spark.createDataFrame(rows, schema)
