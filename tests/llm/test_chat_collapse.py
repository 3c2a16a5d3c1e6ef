"""Snapshot collapse against a comparison of all logs as lists of turns."""

import random

import pytest

from tabscope.llm import chat_collapse as C

SCHEMA = "conv_id long, turn long, role string, text string, place int, chunk string, h1 double, n long"


def slow(rows):
    logs = {}
    for conv, turn, role, text in rows:
        logs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    logs = {c: [x[2:] for x in sorted(v)] for c, v in logs.items()}
    out = []
    for c, v in logs.items():
        if any(len(w) > len(v) and w[:len(v)] == v for w in logs.values()):
            continue
        equal = [d for d, w in logs.items() if w == v]
        ids = [d for d in equal if d is not None]
        if c == (min(ids) if ids else None):
            out.append((c, len(v), len(equal), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v)))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5, 2) for r in rows], SCHEMA)


def case():
    rng = random.Random(4)
    rows, conv = [], 0
    for _ in range(25):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "no", "", None, "é漢", "x" * 3000])) for _ in range(rng.randrange(1, 9))]
        step = rng.choice([1, 3, 700])
        for n in rng.choices(range(1, len(turns) + 1), k=4):
            rows += [(conv, i * step, *turns[i]) for i in range(n)]
            conv += 1
    rows += [(None, 0, "user", "no id"), (None, None, "system", "first"), (900, 1, "user", "same"), (900, 1, "user", "same"), (901, 1, "user", "same")]
    rows += [(950, i, "user", f"turn {i}") for i in range(3000)] + [(951, i, "user", f"turn {i}") for i in range(1500)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [512, 2])
def test_matches_comparison_of_all_logs(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rows = case()
    got = C.collapse_and_render(table(spark, rows)).collect()
    assert all(r.part == 0 for r in got)
    assert sorted(((r.conv_id, r.n_turns, r.n_equal, r.rendered) for r in got), key=repr) == slow(rows)


@pytest.mark.parametrize("chunk,copies", [(512, 64), (3, 2)])
def test_a_third_of_all_rows_in_one_log_at_one_turn_number(spark, monkeypatch, chunk, copies):
    """Distinct, repeated and alike-beginning texts of one log and turn, with and without conv_id, in bounded parts."""
    monkeypatch.setattr(C, "CHUNK", chunk)
    monkeypatch.setattr(C, "COPIES", copies)
    monkeypatch.setattr(C, "PART_CHARS", 2000)
    rng = random.Random(6)
    hot = [("user", f"text {rng.randrange(900)}") for _ in range(700)] + [("user", "same")] * 300 + [("user", "y" * 70 + str(i)) for i in range(100)]
    rows = [(7, 5, *t) for t in hot] + [(None, None, *t) for t in hot[:500]]
    rows += [(8, 1, "r" * 64 + rng.choice(["", "a", "b"]), rng.choice("xyz") + str(i)) for i in range(60)]
    rows += [(100 + i, j, "user", f"turn {j} of {i % 200}") for i in range(400) for j in range(3)]
    rng.shuffle(rows)
    df = table(spark, rows).repartition(9)
    assert C.ordered_turns(df).groupBy("conv_id", "chunk").count().agg({"count": "max"}).first()[0] <= chunk * copies
    logs = {}
    for r in C.collapse_and_render(df).collect():
        assert len(r.rendered) < 2000 + 200
        logs.setdefault((r.conv_id, r.n_turns, r.n_equal), {})[r.part] = r.rendered
    assert len(logs[7, 1100, 1]) > 20 and len(logs[None, 500, 1]) > 5
    assert sorted(((*k, "".join(v[i] for i in sorted(v))) for k, v in logs.items()), key=repr) == slow(rows)


def test_empty_and_native(spark):
    out = C.collapse_and_render(table(spark, []))
    assert out.collect() == []
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
