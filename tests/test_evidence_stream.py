"""Evidence read out of streaming state against the batch evidence of the same rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabscope.operators.prepare import split_flag
from tabscope.plans.evidence import segment_evidence
from tabscope.streaming import evidence as S
from tabscope.streaming.profile import parquet_stream

# quartiles and duplicates aren't additive
BATCH_ONLY = {"data_quality_score", "poor_data_quality"}
START = dt.datetime(2024, 1, 1)


def _rows(n=900, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = rng.choice(["hot", "hot", "hot", "b", None])
        x0, x1 = rng.gauss(5, 2), rng.gauss(0, 1)
        y = (3 if g == "hot" else 0.2) * x0 + x1 * x1 + rng.gauss(0, 1)
        out.append((g, i, x0, x0 + rng.gauss(0, 0.1) if g == "b" else x1, None if i % 37 == 0 else y, START + dt.timedelta(minutes=i // 5)))
    return out


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("evidence") / "t")
    df = spark.createDataFrame(_rows(), "g string, key long, x0 double, x1 double, y double, at timestamp")
    for part in range(4):  # four files in order of time, a micro-batch each
        df.where(F.floor(F.col("key") / 225) == part).coalesce(1).write.mode("append").parquet(path)
    return path


def _compare(got, want, keys):
    fields = [c for c in want.columns if c not in BATCH_ONLY]
    left = {tuple(r[k] for k in keys): r for r in got.collect()}
    right = {tuple(r[k] for k in keys): r for r in want.collect()}
    assert set(left) == set(right) and left
    for k, r in right.items():
        for c in fields:
            v = left[k][c]
            assert v == pytest.approx(r[c], abs=2e-4) if isinstance(r[c], float) else v == r[c], (k, c)
        assert left[k]["data_quality_score"] is None


def test_final_state_equals_the_batch(spark, table):
    schema = spark.read.parquet(table).schema
    flag = split_flag("key", method="mod")
    got = S.run_evidence(parquet_stream(spark, table, schema), spark, "y", ["x0", "x1"], flag, ["g"])
    want = segment_evidence(spark.read.parquet(table), "y", ["x0", "x1"], flag, ["g"], materialize=True)["evidence"]
    _compare(got, want, ["g"])


def test_windows_behind_a_watermark(spark, table):
    schema = spark.read.parquet(table).schema
    flag = split_flag("key", method="mod")
    got = S.run_evidence(parquet_stream(spark, table, schema), spark, "y", ["x0", "x1"], flag, time="at").collect()
    assert sorted((r["window"]["start"], r["n_rows"]) for r in got) == [(START + dt.timedelta(hours=h), 300) for h in range(3)]
    hour = spark.read.parquet(table).where((F.col("key") >= 300) & (F.col("key") < 600))
    want = segment_evidence(hour, "y", ["x0", "x1"], flag, materialize=True)["evidence"].first()
    row = next(r for r in got if r["window"]["start"] == START + dt.timedelta(hours=1))
    assert row["r2_score"] == pytest.approx(want["r2_score"], abs=2e-4)
    assert row["target_correlation"] == pytest.approx(want["target_correlation"], abs=2e-3)


def test_the_last_batch_of_a_segment_holds_its_state(spark):
    t = spark.createDataFrame([("a", 1, 10), ("a", 3, 30), ("a", 2, 20), (None, 1, 5), ("b", 2, None)], "g string, batch int, n_rows long")
    assert {(r.g, r.n_rows) for r in S.latest_state(t, ["g"]).collect()} == {("a", 30), (None, 5), ("b", None)}


def test_nothing_arrived(spark, table, tmp_path):
    empty = str(tmp_path / "none")
    schema = spark.read.parquet(table).schema
    spark.createDataFrame([], schema).write.parquet(empty)
    got = S.run_evidence(parquet_stream(spark, empty, schema), spark, "y", ["x0", "x1"], split_flag("key", method="mod"), ["g"])
    assert got.collect() == []
