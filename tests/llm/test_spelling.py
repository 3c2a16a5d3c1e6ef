"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from tabscope.llm import spelling
from tabscope.llm.queries import noisy_words
from tabscope.llm.spelling import group_spellings, letter_runs, pivots


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def slow(words: dict, factor=5):
    close = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(close[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out)


def grouped(spark, rows, **more):
    out = group_spellings(spark.createDataFrame(rows, "word string, n bigint"), **more).collect()
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in out)


def edits(word, rng, letters):
    i = rng.randrange(len(word))
    c = rng.choice(letters)
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :], word[:i] + c + word[i:], word + c, c + word])


def vocabulary(rng, letters, n, most=14):
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, most))) for _ in range(n)}
    for _ in range(3):
        words |= {e for w in list(words) if len(e := edits(w, rng, letters)) >= 6 and rng.random() < 0.5}
    return {w: 5 * rng.choice([1, 1, 1, 2, 6, 30, 400, 9000]) for w in words}


def test_equals_brute_force_on_few_letters(spark):
    """Two letters make every bigram common and repeated, so that ties and repeated bigrams matter."""
    words = vocabulary(random.Random(1), "ab", 120, 9)
    want = slow(words)
    assert sum(r[2] for r in want) > 500 and any(r[5] != r[0] and r[5] != r[3] for r in want)
    assert grouped(spark, list(words.items())) == want


def test_equals_brute_force_on_many_letters(spark):
    words = vocabulary(random.Random(2), "abcdeéßøijklmno", 400)
    want = slow(words)
    assert sum(r[2] for r in want) > 300
    assert grouped(spark, list(words.items())) == want


def test_edits_at_every_place(spark):
    rng = random.Random(3)
    for word in ("abcdef", "aaaaaaaa", "abababababab", "thequickbrown"):
        words = {word: 1000}
        for i in range(len(word) + 1):
            words.setdefault(word[:i] + "z" + word[i:], 5)
            if i < len(word):
                words.setdefault(word[:i] + "y" + word[i + 1 :], 5)
                words.setdefault(word[:i] + word[i + 1 :], 5)
        words = {w: n for w, n in words.items() if len(w) >= 6}
        assert grouped(spark, list(words.items())) == slow(words), word
        del rng
        rng = random.Random(4)


def test_hard_words(spark):
    long = "ab" * 3000
    rows = [(None, 9), ("", 3), ("short", 99), ("abcdef", 5), ("abcdef", 45), ("abcdeg", None), ("漢字漢字漢字仮", 100), ("漢字漢字漢字", 7),
            ("😀😀😀😀😀😀", 10), (long, 100), (long + "x", 5), ("x" + long, 5)]
    words = {"abcdef": 50, "abcdeg": 0, "漢字漢字漢字仮": 100, "漢字漢字漢字": 7, "😀😀😀😀😀😀": 10, long: 100, long + "x": 5, "x" + long: 5}
    assert grouped(spark, rows) == slow(words)
    assert grouped(spark, []) == []


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(5)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 8)))
        cost = [rng.randint(1, 9) for _ in places]
        got = pivots(places, cost)
        assert places[got[1]] - places[got[0]] >= 2
        assert cost[got[0]] + cost[got[1]] == min(cost[i] + cost[j] for i in range(len(places)) for j in range(len(places)) if places[j] - places[i] >= 2)


def test_words_of_documents(spark):
    rng = random.Random(6)
    texts = ["Straße élan ÉLAN Naïve×div " + " ".join(rng.choice(["Wonderful", "wonderful", "spelling", "ÄRGERLICH", "ärgerlich", "longerwords", "abc"]) for _ in range(400)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "12 34")]
    c = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    want = {w: n for w, n in c.items() if len(w) >= 6 and n >= 5}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.word: r.n for r in noisy_words(docs, 199, 6, 5).collect()} == want
    assert letter_runs(docs.where("doc_id = 902")).count() == 0


def test_lists_are_short(spark):
    """Candidates stay near the true pairs even if every word has the same rarest bigrams."""
    rng = random.Random(7)
    words = sorted({"zq" + "".join(rng.choice("ab") for _ in range(10)) + "qz" for _ in range(600)})
    df = spark.createDataFrame(list(enumerate(words)), "id bigint, word string")
    counts = spelling.gram_counts(df)
    index = df.mapInPandas(spelling.gram_keys(counts, False), "key bigint, id bigint, last bigint").toPandas()
    probe = df.mapInPandas(spelling.gram_keys(counts, True), "key bigint, id bigint, last bigint").toPandas()
    met = index.merge(probe, on="key").query("id_x < id_y")[["id_x", "id_y"]].drop_duplicates()
    assert len(met) < len(words) ** 2 / 20
