"""Decontamination against a brute-force search for every window at every place."""

import random
import re

import pytest

from tabscope.llm.decontam import contamination, drop_contaminated

DOCS = "doc_id long, text string, lang string, win long, row string, start int"
ITEMS = "item_id long, text string, doc_id long, gram string"


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def slow(docs, items, window, shingle, containment):
    cut = []
    for item, text in items:
        w = words(text)
        cut += [(item, w[s:s + window]) for s in range(max(1, len(w) - window + 1)) if w]
    out = []
    for doc, text in docs:
        w, hit, held = words(text), set(), set()
        for item, win in cut:
            k = min(shingle, len(win))
            m = len(win) - k + 1
            for s in range(len(w) - len(win) + 1):
                same = sum(w[s + j:s + j + k] == win[j:j + k] for j in range(m))
                if same >= containment * m:
                    hit |= set(range(s, s + len(win)))
                    held |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), sorted(held)))
    return sorted(out, key=repr)


def case():
    rng = random.Random(5)
    vocabulary = ["the", "of", "Été", "a1", "b", "c", "dd", "ee", "naïve", "9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(2, 14)]
    items += [(100, items[0][1]), (100, items[3][1]), (None, "null item words are here but it has no name at all"), (7, None), (8, " ,.! "),
              (9, "solo"), (55, "x " * 14), (56, "unseen words that no text at all has in it anywhere today")]
    docs = []
    for i in range(40):
        body = rng.choices(vocabulary, k=rng.choice([0, 1, 5, 30, 200]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = (rng.choice(items)[1] or "").upper().split()
        docs.append((i, rng.choice([" ", ", ", "\n", "-"]).join(body)))
    docs += [(None, docs[3][1]), (3, docs[3][1]), (3, "clean"), (80, None), (81, ""), (82, "X" * 20_000), (83, "x " * 300),
             (84, " ".join(rng.choices(vocabulary, k=3000)))]
    return docs, items


@pytest.mark.parametrize("containment", [1.0, 0.6])
def test_matches_brute_force(spark, containment):
    docs, items = case()
    if containment < 1:
        items = [x for x in items if len(words(x[1])) != 1]
    d = spark.createDataFrame([(i, t, "en", 1, "clash", 2) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 5, "clash") for i, t in items], ITEMS)
    got = contamination(d, b, containment=containment)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=repr) == slow(docs, items, 10, 5, containment)
    want = slow(docs, items, 10, 5, containment)
    kept = drop_contaminated(d, b, containment=containment)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x[0]) for x in want if x[2] == 0)


def test_long_texts_across_chunks(spark, monkeypatch):
    import tabscope.llm.decontam as D

    monkeypatch.setattr(D, "CHUNK", 7)
    rng = random.Random(1)
    body = rng.choices("abcdefgh", k=100)
    table = spark.createDataFrame([(0, " ".join(body[20:45]), 0, "")], ITEMS)
    doc = spark.createDataFrame([(1, " ".join(body), "en", 1, "", 1)], DOCS)
    r = contamination(doc, table).collect()[0]
    assert (r.n_words, r.n_hit, r["items"]) == (100, 25, ["0"])


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "some words", "en", 1, "", 1)], DOCS), spark.createDataFrame([], ITEMS)
    assert [(r.n_words, r.n_hit, r["items"]) for r in contamination(d, b).collect()] == [(2, 0, [])]
    assert contamination(d.limit(0), b).collect() == []
    assert drop_contaminated(d, b).count() == 1
