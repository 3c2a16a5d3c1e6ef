"""Rows of a forest fit over the tasks."""

from pyspark.sql import functions as F

from tabscope.operators import experiments as X
from tabscope.operators import models as M


def test_rows_of_one_row_group_are_spread(spark, monkeypatch):
    df = spark.range(1000).coalesce(1)
    assert M.spread(df, 1000).rdd.getNumPartitions() == 1
    monkeypatch.setattr(M, "TASK_ROWS", 250)
    monkeypatch.setattr(M, "MOST_ROWS", 100)
    sizes = M.spread(df, 1000).rdd.glom().map(len).collect()
    assert len(sizes) == 10 and sum(sizes) == 1000 and max(sizes) < 200
    monkeypatch.setattr(M, "MOST_ROWS", 10_000)
    assert M.spread(df, 1000).rdd.getNumPartitions() == min(4, spark.sparkContext.defaultParallelism)


def test_forest_fits_use_every_task(spark, monkeypatch):
    monkeypatch.setattr(M, "TASK_ROWS", 100)
    seen, spread = [], M.spread

    def watched(df, n):
        out = spread(df, n)
        seen.append((n, out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(M, "spread", watched)
    df = spark.range(400).coalesce(1).select("id", (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"))
    df = df.withColumn("y", F.col("x") * F.col("x"))
    small = {"numTrees": 2, "maxDepth": 4}
    out = M.compare_models(df, ["x", "z"], "y", F.col("id") % 5 == 0, rf_params=small, gbt_params={"maxIter": 2, "maxDepth": 3}).collect()
    assert [r["name"] for r in out] == ["Linear Regression", "Random Forest", "Gradient Boosting"] and out[1]["r2"] > 0.9
    X.run_experiments(df, ["x", "z"], "y", F.col("id") % 5 == 0, F.col("id"), scorer="forest", rf_params=small, methods=("baseline",))
    assert seen == [(400, 4), (400, 4)]
