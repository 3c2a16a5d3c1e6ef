"""SimHash against brute force: fingerprints bit by bit, links over all pairs, and the covering property."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tabscope.llm import simhash as S
from tabscope.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, fp string, row int, label int"


def slow_fingerprint(text):
    words, word = [], ""
    for c in (text or ""):
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    words += [word] * bool(word)
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows):
    """rows: (doc_id, fingerprint).  Least doc_id reachable, by flooding."""
    out, left = {}, set(range(len(rows)))
    while left:
        group, edge = set(), [left.pop()]
        while edge:
            i = edge.pop()
            group.add(i)
            near = {j for j in left if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2}
            left -= near
            edge += near
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            out[i] = min(ids) if ids else None
    return [out[i] for i in range(len(rows))]


def documents():
    rng = random.Random(3)
    vocabulary = ["Alpha", "béta", "gamma,", "ΔELTA", "eps", "zeta.", "eta", "theta"]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 40, 300]))) for _ in range(25)]
    texts = base + base[:9] + [b.upper() for b in base[:5]] + [b + "\n" for b in base[:4]] + [None, "", " \t\n", "\xa0", "one", "x" * 5000]
    for b in base[10:]:
        words = b.split()
        if len(words) > 30:
            words[rng.randrange(len(words))] = "changed"
            texts.append("\x0b".join(words))
    texts.append(" ".join(rng.choices(vocabulary, k=70_000)))
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, base[0]), (None, "only here"), (1, texts[0]), (1, texts[0])]
    rng.shuffle(rows)
    return rows


def test_fingerprints_and_components_match_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, "en", "clash", 7, 0) for i, t in rows], SCHEMA)
    got = S.simhash_near_duplicates(df).collect()
    expected = [(i, slow_fingerprint(t)) for i, t in rows]
    want = sorted(((i, f, c) for (i, f), c in zip(expected, slow_components(expected))), key=repr)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=repr) == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_every_pair_within_the_radius_meets_under_a_mask(radius):
    rng = random.Random(radius)
    masks = S.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(500):
        change = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(change & m == 0 for m in masks)


@pytest.mark.parametrize("radius", [1, 2])
def test_chains_and_large_near_groups(spark, radius):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = {centre ^ (1 << i) for i in range(64)} | {rng.getrandbits(64) for _ in range(50)}
    chain = [rng.getrandbits(64)]
    for i in range(0, 40, radius):
        chain.append(chain[-1] ^ sum(1 << b for b in range(i, i + radius)))
    values = sorted(values | set(chain))
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    linked = {r.node % (1 << 64): r.label for r in connected_components(S.near_edges(fps, radius)).collect()}
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= radius:
                assert linked[a] == linked[b]
    assert len({linked[c] for c in chain}) == 1
    alone = [v for v in values if not any(v != w and bin(v ^ w).count("1") <= radius for w in values)]
    assert all(v not in linked for v in alone)


def test_pipeline_form_keeps_one_row_of_each_component(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, "en", "clash", 7, 0) for i, t in rows], SCHEMA)
    kept = S.keep_one_of_each(df)
    assert kept.columns == df.columns
    expected = [(i, slow_fingerprint(t)) for i, t in rows]
    groups = {}
    for (i, f), c in zip(expected, slow_components(expected)):
        groups.setdefault(c if c is not None else ("none", f), []).append(i)
    want = sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.simhash_near_duplicates(empty).collect() == []
    assert S.keep_one_of_each(empty).collect() == []


def test_components_of_a_path_a_star_and_a_cycle(spark):
    path = [(i, i + 1) for i in range(50)]
    star = [(100, 101 + i) for i in range(200)]
    cycle = [(500 + i, 500 + (i + 1) % 9) for i in range(9)] + [(700, 700)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(path + star + cycle, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 301)} | {500 + i: 500 for i in range(9)}
