"""Paragraph banding: tuned recall, exact links, and passages against a brute-force search."""

import random
import re

import numpy as np
import pytest
import xxhash

from tabscope.llm import paragraph_dedup as P

SCHEMA = "doc_id long, text string, row string, unit int, key string, n double"
VOCABULARY = [f"w{i}" for i in range(4000)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, "x", 0.5) for i, t in rows], SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choices(VOCABULARY, k=n)).capitalize() + "."


def jaccard(a, b):
    x, y = P.shingle_set(a), P.shingle_set(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("threshold, recall", [(0.8, 0.99), (0.9, 0.99), (0.8, 0.999)])
def test_tuned_bands_reach_the_recall(threshold, recall):
    bands, rows = P.tune_bands(threshold, recall, max_bands=12)
    assert 1 - (1 - threshold ** rows) ** bands >= recall


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    words = rng.choices(VOCABULARY, k=300)
    a, b = " ".join(words), " ".join(words[:260] + rng.choices(VOCABULARY, k=40))
    s = P.signatures([a.encode(), b.encode(), b"x", b"one two"], 400)
    assert abs(np.mean(s[0] == s[1]) - jaccard(a, b)) < 0.08
    assert (s[2] == P.signatures([b"x"], 400)[0]).all() and (s[0] == P.signatures([a.encode()], 400)[0]).all()


def slow_paragraphs(text):
    lines, at, out = [], 0, []
    for line in (text or "").split("\n"):
        sentences = []
        for part in re.split("[.!?]", line):
            words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in part))
            sentences += [(at, words)] if words else []
            at += len(words)
        lines.append(sentences)
    for sentences in lines:
        group, groups = [], []
        for start, words in sentences:
            if len(words) >= P.MIN_WORDS:
                groups, group = groups + [group, [(start, words)]], []
                continue
            if sum(len(w) for _, w in group) >= P.MIN_WORDS and xxhash.xxh32_intdigest(group[-1][1][-1].encode()) % 4 == 0:
                groups, group = groups + [group], []
            group = group + [(start, words)]
        for g in groups + [group]:
            words = [w for _, ws in g for w in ws]
            if g and len(words) >= P.MIN_WORDS and len(set(words)) >= P.MIN_DISTINCT:
                out.append((g[0][0], len(words), " ".join(words)))
    return out


def variants(rng):
    base = rng.choices(VOCABULARY, k=60)
    out = [" ".join(base)]
    for _ in range(90):
        words = list(base)
        words[rng.randrange(60)] = rng.choice(VOCABULARY)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [1024, 20])
def test_clusters_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(2)
    rows = [(i, " ".join(sentence(rng, rng.choice([1, 2, 4, 9, 20, 39])) for _ in range(rng.randrange(1, 8)))) for i in range(30)]
    shared = [sentence(rng, 30) for _ in range(4)]
    rows += [(100 + i, f"{sentence(rng, 9)} {shared[i % 4]} {sentence(rng, 12)}") for i in range(16)]
    rows += [(200 + i, v + ".") for i, v in enumerate(variants(rng))]
    rows += [(None, rows[1][1]), (1, rows[1][1]), (399, f"{shared[0]} other {shared[1]} " + (sentence(rng, 11) + " ") * 2), (398, ("only in this one document but twice in it. ") * 2), (400, None), (401, ""), (402, " .!?\n"), (403, "w1 " * 9), (404, " ".join(VOCABULARY) * 9), (405, " ".join(VOCABULARY) * 9 + " more"), (406, "Aa! b! c? d! e! f! g! h! i! j! k! l! m! " * 3)]
    units = [(i, r, *p) for r, (i, t) in enumerate(rows) for p in slow_paragraphs(t)]
    texts = sorted({u[4] for u in units})
    label = {t: t for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if jaccard(a, b) >= P.THRESHOLD and label[a] != label[b]:
                old, new = label[a], label[b]
                label = {t: new if v == old else v for t, v in label.items()}
    groups = {}
    for u in units:
        groups.setdefault(label[u[4]], []).append(u)
    want = []
    for g in groups.values():
        if len({u[1] for u in g}) > 1:
            ids = [u[0] for u in g if u[0] is not None]
            want += [(u[0], u[2], u[3], min(ids) if ids else None) for u in g]
    got = P.repeated_paragraphs(table(spark, rows), recall=0.99999).collect()
    assert sorted(((r.doc_id, r.start, r.n, r.first_doc_id) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(not r.removed for r in got) == sum(len({u[1] for u in g}) > 1 for g in groups.values())


def test_planted_passages_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(5)
    passages = [" ".join(sentence(rng, rng.randrange(6, 20)) for _ in range(6)) for _ in range(10)]
    rows, planted = [], set()
    for i in range(300):
        body = " ".join(sentence(rng, rng.randrange(4, 20)) for _ in range(12)).split()
        if i % 3 == 0:
            at = rng.randrange(len(body))
            body[at:at] = passages[i % 10].split()
            planted.add(i)
        rows.append((i, "\n".join([" ".join(body), "Licensed under the same nine words as all other texts."])))
    got = P.repeated_passages(table(spark, rows)).collect()
    assert {r.doc_id for r in got} == planted
    assert all(r.n_words >= P.MIN_PASSAGE for r in got)
    assert sum(r.n_removed == 0 for r in got) >= 9


def test_empty_table(spark):
    assert P.repeated_passages(table(spark, [])).collect() == []


HAN = [chr(0x4E00 + i) for i in range(3000)]


@pytest.mark.parametrize("words, blank, size", [(VOCABULARY, " ", 60), (VOCABULARY, ", ", 60), (HAN, "", 60)])
@pytest.mark.parametrize("around", [20, 240])
def test_passages_in_hosts_without_sentence_marks_are_found(spark, words, blank, size, around):
    rng = random.Random(around)
    passages = [rng.choices(words, k=size) for _ in range(20)]
    rows, planted = [], set()
    for i in range(120):
        body = rng.choices(words, k=around)
        if i % 2 == 0:
            at = rng.randrange(around)
            body[at:at] = passages[i // 2 % 20]
            planted.add(i)
        rows.append((i, blank.join(body)))
    got = P.repeated_passages(table(spark, rows)).collect()
    assert {r.doc_id for r in got} <= planted
    assert len({r.doc_id for r in got}) >= 0.95 * len(planted)


def test_sentence_ends_and_words_of_other_scripts():
    text = "这是第一个句子有十二个字。这是第二个句子有十二个字！Ok then".encode()
    assert [(s, len(w)) for _, s, w in P.cut_text(P.spaced(text))] == [(0, 12), (12, 12)]
    assert P.spaced("สวัสดี a".encode()).split() == [*(c.encode() for c in "สวัสดี"), b"a"]
    assert P.spaced("é ü ß".encode()) == "é ü ß".encode()


def test_cuts_do_not_depend_on_the_surroundings():
    rng = random.Random(8)
    passage = [w.encode() for w in rng.choices(VOCABULARY, k=500)]
    host = [w.encode() for w in rng.choices(VOCABULARY, k=300)]
    alone, inside = P.cuts(passage), P.cuts(host + passage + host) - 300
    far = 2 * P.REACH
    assert [c for c in alone if far <= c <= 500 - far] == [c for c in inside if far <= c <= 500 - far]
    assert max(np.diff(P.cuts([b"same"] * 1000))) <= P.LONGEST


def test_salted_keys_are_never_broadcast(spark):
    keys, rows = spark.range(100).withColumnRenamed("id", "key"), spark.range(1000).selectExpr("id % 150 AS key", "id AS value")
    joined = P._rows_of(rows, keys, "key")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(joined.collect()) == sorted(rows.where("key < 100").collect())


def slow_pieces(words):
    places, out = P.cuts(words).tolist(), []
    for start in places:
        end = next((p for p in places if p >= start + P.MIN_WORDS), None)
        if end is not None and len(set(words[start:end])) >= P.MIN_DISTINCT:
            out.append((start, end - start, xxhash.xxh64_intdigest(b" ".join(words[start:end]))))
    return out


def test_texts_cut_together_have_the_pieces_of_each(monkeypatch):
    rng = random.Random(4)
    kinds = [VOCABULARY, VOCABULARY[:3], VOCABULARY[:6], ["ab", "aab", "ac"], [*HAN[:40], "a"]]
    texts = [[w.encode() for w in rng.choices(rng.choice(kinds), k=rng.choice([1, 7, 8, 9, 30, 300]))] for _ in range(200)] + [[b"same"] * 500]
    want = [(i, *p) for i, words in enumerate(texts) for p in slow_pieces(words)]
    for held in (P.HELD, 50):
        monkeypatch.setattr(P, "HELD", held)
        got = P.cut_pieces([b" ".join(words) for words in texts], [len(words) for words in texts])
        assert list(zip(*(c.tolist() for c in got))) == want
