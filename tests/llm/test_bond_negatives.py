"""Hard negatives against brute force, and the bounds of the vertical scan."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.llm import bond_negatives
from tabscope.llm.bond_negatives import best_rule, bounded_scan, hard_negatives, window_rule

SCHEMA = "vec_id bigint, label int, embedding array<float>, anchor_id string"


def slow(rows, anchor, positives=5, negatives=10):
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v, _ in rows
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda s, i: (-s, i is None, i or 0)
    out = []
    for at, (i, lab, v) in enumerate(kept):
        if i is None or not anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m) for n, (j, m, w) in enumerate(kept) if n != at]
        same = sorted(((s, j) for s, j, m in scored if m == lab), key=lambda x: rank(*x))[:positives]
        for p, j in same:
            fit = sorted(((s, n) for s, n, m in scored if m != lab and 30 * p <= 100 * s <= 90 * p), key=lambda x: rank(*x))[:negatives]
            out += [(i, j, r + 1, n, p, s) for r, (s, n) in enumerate(fit)]
    return sorted(out, key=str)


def found(spark, rows, **more):
    out = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, **more).collect()
    return sorted([(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in out], key=str)


def vectors(n, width, rng, labels=3):
    centres = rng.normal(size=(labels, width))
    lab = rng.integers(labels, size=n)
    values = (centres[lab] * 0.6 + rng.normal(size=(n, width))).astype(np.float32)
    return [(i, int(lab[i]), [float(x) for x in values[i]], "x") for i in range(n)]


@pytest.mark.parametrize("block,chunk", [(8192, 1024), (40, 7)])
def test_equals_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(bond_negatives, "BLOCK", block)
    monkeypatch.setattr(bond_negatives, "CHUNK", chunk)
    rows = vectors(300, 24, np.random.default_rng(1))
    rows += [(1000 + i, *rows[i % 5][1:]) for i in range(40)]  # copies: ties of every kind
    want = slow(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    assert found(spark, rows) == want


def test_hard_rows(spark):
    rng = np.random.default_rng(2)
    rows = vectors(60, 6, rng, 2) + [
        (100, None, [1.0] * 6, "x"), (110, 1, None, "x"), (120, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (130, 1, [float("nan")] * 6, "x"),
        (140, 1, [float("inf")] + [0.0] * 5, "x"), (150, 0, [], "x"), (160, 0, [0.0] * 6, "x"), (170, 1, [1.0, 2.0], "x"),
        (None, 0, [0.5] * 6, "x"), (None, 1, [0.5] * 6, "x"), (180, 7, [1.0] * 6, "x"), (20, *rows_of(rng))]
    want = slow([r if r[2] is None else (r[0], r[1], [*r[2], *[0.0] * (6 - len(r[2]))], r[3]) for r in rows], lambda i: i % 10 == 0)
    assert found(spark, rows) == want


def rows_of(rng):
    return 1, [float(x) for x in rng.normal(size=6).astype(np.float32)], "x"


def test_empty_table(spark):
    assert found(spark, []) == []


def test_too_large_scores_raise(spark):
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(0, 0, [1e17, 1.0], "x"), (1, 0, [1e17, 1.0], "x")])


def test_scan_reads_fewer_candidates_and_loses_none():
    rng = np.random.default_rng(3)
    columns = rng.integers(-300, 300, size=(32, 500))
    columns[:4] *= 40  # a few dimensions decide
    anchor = rng.integers(-300, 300, size=32)
    least, greatest = columns.min(axis=1), columns.max(axis=1)
    scores = anchor @ columns
    left, exact = bounded_scan(columns, least, greatest, anchor, np.ones(500, bool), best_rule(5))
    assert len(left) < 500 and set(np.argsort(-scores)[:5]) <= set(left)
    assert (exact == scores[left]).all()
    first, last = int(np.quantile(scores, 0.3)), int(np.quantile(scores, 0.6))
    left, exact = bounded_scan(columns, least, greatest, anchor, np.ones(500, bool), window_rule([(first, last)], 10))
    inside = np.flatnonzero((scores >= first) & (scores <= last))
    assert set(inside[np.argsort(-scores[inside])[:10]]) <= set(left) and (exact == scores[left]).all()


def test_zero_anchor():
    columns = np.arange(12).reshape(3, 4)
    left, score = bounded_scan(columns, columns.min(1), columns.max(1), np.zeros(3, np.int64), np.ones(4, bool), window_rule([(0, 0)], 2))
    assert left.tolist() == [0, 1, 2, 3] and score.tolist() == [0, 0, 0, 0]
