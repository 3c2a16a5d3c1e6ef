"""Multi-index hashing: pigeonhole probing is complete, scores are exact, recall against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tabscope.llm import hamming_ann as H

SCHEMA = "vec_id long, embedding array<float>, label int, row string, v string, score int"


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(d[i])) for i in order]
    return out


@pytest.mark.parametrize("dim", [64, 20])
def test_probing_finds_every_code_within_the_radius(dim):
    x = np.random.default_rng(0).normal(size=(3000, dim))
    codes = H.learn(x[:1000])
    index = H.BlockIndex(np.arange(3000), np.arange(3000), x, codes)
    for radius in range(0, codes.bits + 1, 3):
        for q in (0, 7):
            want = np.flatnonzero(H.hamming(index.codes, index.codes[q]) <= radius)
            assert index.within(index.codes[q], radius).tolist() == want.tolist()


def test_recall_and_scores_on_the_given_table(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], np.float32)
    want = brute(ids, x, np.flatnonzero(ids % 100 == 0))
    got = {}
    for r in E.queries()["op5_hamming_ann"](spark, sf).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        rows = [found[i] for i in range(1, 11)]
        assert rows == sorted(rows, key=lambda r: (r[1], r[0]))
        at = {int(i): n for n, i in enumerate(ids)}
        for v, d in rows:
            assert abs(d - np.sqrt(((x[at[v]].astype(float) - x[at[q]].astype(float)) ** 2).sum())) < 1e-12
        hits += len({v for v, _ in rows} & {v for v, _ in want[q]})
    assert hits / (10 * len(want)) >= 0.9


def test_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 16)
    monkeypatch.setattr(H, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(3)
    good = rng.normal(size=(60, 8)).astype(np.float32)
    good[30:50] = good[5]
    rows = [(i, good[i].tolist()) for i in range(60)]
    bad = [(100, None), (101, [0.0] * 8), (102, [1.0] * 7 + [None]), (103, [float("nan")] * 8), (104, [float("inf")] + [1.0] * 7), (105, [1.0, 2.0]), (None, [1.0] * 8), (106, [])]
    twice = [(0, good[0].tolist())]
    df = spark.createDataFrame([(i, v, 0, "clash", "x", 1) for i, v in rows + bad + twice], SCHEMA)
    got = {}
    for r in H.nearest_neighbours(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == {0, 10, 20, 30, 40, 50}
    assert len(got[0]) == 20 and all(len(v) == 10 for q, v in got.items() if q)
    assert [(v, s) for _, v, s in sorted(got[0])[:2]] == [(0, 0.0), (0, 0.0)]
    assert [v for _, v, s in sorted(got[30])] == [5, *range(31, 40)] and all(s == 0 for _, _, s in got[30])
    few = df.where("vec_id in (10, 11, 12)")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in H.nearest_neighbours(few, F.col("vec_id") == 10).collect())[0][:2] == (10, 1)
    assert H.nearest_neighbours(few, F.col("vec_id") == 10).count() == 2
    assert H.nearest_neighbours(df.limit(0), F.col("vec_id") == 1).collect() == []
    assert H.nearest_neighbours(df.where("vec_id = 10"), F.col("vec_id") == 10).collect() == []
