import os
import tempfile

from pyspark.sql import functions as F

from tabscope.plans.catalog import column_catalog, infer_context, infer_domain
from tabscope.sources.csv import read_csv


def test_csv_null_tokens_and_inference(spark):
    d = tempfile.mkdtemp(prefix="tabscope-csv-test-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as f:
        f.write("a,b,c,d\n1,2.5,x,true\nNA,,NaN,false\nnull,3,N/A,\n4,n/a,y,TRUE\n")
    df = read_csv(spark, path)
    types = dict(df.dtypes)
    assert types == {"a": "bigint", "b": "double", "c": "string", "d": "boolean"}
    rows = df.orderBy(F.col("a").asc_nulls_last(), "b").collect()
    assert [r["a"] for r in rows].count(None) == 2
    assert sum(r["b"] is None for r in rows) == 2 and sum(r["c"] is None for r in rows) == 2
    assert sum(r["d"] is None for r in rows) == 1


def test_domain_and_context_from_column_names(spark):
    house = spark.createDataFrame([(1.0, 2.0, 3, 1)], "price double, sqft_living double, bedrooms int, zipcode int")
    health = spark.createDataFrame([(1, 2.0, 3.0)], "patient_id int, blood_pressure double, cholesterol double")
    plain = spark.createDataFrame([(1, 2)], "a int, b int")
    cat = column_catalog(spark, {"house": house, "health": health, "plain": plain})
    dom = {r["dataset"]: r for r in infer_domain(cat).collect()}
    assert dom["house"]["domain"] == "real_estate" and dom["house"]["score"] == 4 and dom["house"]["confidence"] == 0.85
    assert dom["health"]["domain"] == "healthcare" and dom["plain"]["domain"] == "generic" and dom["plain"]["confidence"] == 0.35
    ctx = {r["dataset"]: r for r in infer_context(cat).collect()}
    # patient, blood, pressure, cholesterol: four context keywords -> HIGH
    assert ctx["health"]["domain"] == "healthcare" and ctx["health"]["score"] == 4 and ctx["health"]["confidence"] == "HIGH"
    assert ctx["plain"]["context"] == "Generic tabular analytics dataset"


def test_foreach_batch_quality_appends_rows(spark):
    from tabscope.streaming.profile import foreach_batch_quality, parquet_stream, scratch_path
    src = scratch_path(spark, "stream-src")
    spark.createDataFrame([(float(i), "a" if i % 2 else "b") for i in range(40)], "x double, g string").write.parquet(src)
    out = scratch_path(spark, "stream-out")
    stream = parquet_stream(spark, src, spark.read.parquet(src).schema)
    q = foreach_batch_quality(stream, out, scratch_path(spark, "stream-ckpt"), by=["g"])
    q.awaitTermination()
    res = spark.read.parquet(out)
    n_batches = res.select("batch_id").distinct().count()  # one file per trigger
    n_files = len(spark.read.parquet(src).inputFiles())
    assert n_batches == n_files and res.count() == 2 * n_batches  # one row per (micro-batch, segment)
    assert set(res.columns) >= {"g", "overall_score", "batch_id"}
