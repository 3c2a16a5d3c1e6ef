"""The byte network: convolution against loops, gradients by accuracy, held-out accuracy, and defined cases."""

import zlib

import numpy as np

import __spark_entry__ as E
from tabscope.llm import lang_id as G

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int, held_out string"


def toy():
    en, de = "the of and with this that under", "der und die das nicht auf schön"
    texts = [" ".join(w for i, w in enumerate((src * 9).split()) if (i * k) % 7 != 3) for src in (en, de) for k in range(1, 21)]
    return texts, ["en"] * 20 + ["de"] * 20


def test_convolution_and_pooling_match_loops():
    texts, labels = toy()
    net = G.fit(texts, labels, epochs=1)
    x = G.windows("Ab 12 schön " * 14)
    assert x.shape == (2, G.WINDOW) and (x[0, :6] == np.frombuffer(b"ab 00 ", np.uint8)).all()
    got = net.convolved(x)
    wide = max(G.WIDTHS)
    for n in range(len(x)):
        row = np.concatenate([x[n], np.zeros(wide - 1, np.uint8)])
        for p in (0, 5, 77, G.WINDOW - 1):
            for f in (0, G.FILTERS, 2 * G.FILTERS, 3 * G.FILTERS - 1):
                width = G.WIDTHS[f // G.FILTERS]
                want = sum(float(net.bytes_[row[p + j], d] * net.filters[j * G.DIM + d, f]) for j in range(width) for d in range(G.DIM))
                assert abs(want - got[n, p, f]) < 1e-4
    p = net.probabilities(x)
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(net.score("Ab 12 schön " * 14).sum(), 1)


def test_training_learns_and_long_texts_are_read_whole():
    texts, labels = toy()
    net = G.fit(texts, labels, epochs=30)
    assert net.languages == ["de", "en"]
    assert all(net.languages[int(net.score(t).argmax())] == v for t, v in zip(texts, labels))
    long = "the of and with this " * 20_000 + "der und die das nicht auf " * 60_000
    assert net.languages[int(net.score(long).argmax())] == "de"
    alone, together = net.score(long), net.score_many(["x", long, texts[0]])[1]
    assert np.allclose(alone, together, atol=1e-6)


def test_held_out_accuracy_and_purity_of_the_sample(spark):
    rows = E.queries()["op1_lang_id"](spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_defined_cases(spark):
    texts, labels = toy()
    rows = [(i, t, v, "clash", 3, "x") for i, (t, v) in enumerate(zip(texts, labels))]
    rows += [(None, None, None, None, None, None), (90, "", "en", "", 0, ""), (91, "12 !!", "de", "", 0, ""), (92, "漢字", None, "", 0, ""),
             (0, texts[0], "en", "", 0, ""), (0, texts[0], "en", "", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    net = G.train(df)
    assert G.identify(df, net).columns == ["doc_id", "text", "lang", "held_out", "lang_pred", "score"]
    out = G.identify(df, net).collect()
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in out}
    assert len(out) == len(rows)
    assert [got[k] for k in ((None, None), (90, ""), (91, "12 !!"))] == [("und", 0.0)] * 3
    assert got[92, "漢字"][0] in net.languages
    kept = G.keep_identified(df, net)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    unlabelled = df.withColumn("lang", df["lang"].substr(9, 1)).where("lang is null")
    assert G.train(unlabelled) is None
    assert {r.lang_pred for r in G.identify(df.select("doc_id", "text"), None).collect()} == {"und"}
    assert G.identify(df.limit(0).select("text"), net).collect() == []
    one = G.train(df.where("lang = 'en'"))
    assert {r.lang_pred for r in G.identify(df.select("text"), one).collect()} == {"en", "und"}


def test_sample_is_bounded(spark):
    texts, labels = toy()
    df = spark.createDataFrame([(i, f"{t} {i % 500}", v, "", 0, "") for i, (t, v) in enumerate(zip(texts * 60, labels * 60))], SCHEMA)
    got = G.training_rows(df, per_language=30)
    assert sorted({r.lang for r in got}) == ["de", "en"] and len(got) == 60
    assert len(G.training_rows(df, per_language=30, sample_texts=20)) == 20


def test_every_label_is_in_the_sample_however_many_there_are(spark):
    rows = [(f"l{i % 300:03}", f"word {i} of label {i % 300}") for i in range(1500)] + [("rare", "a single text")] + [("l000", f"more {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    for budget, most in ((80_000, 5 * 299 + 8 + 1), (700, 2 * 300 + 1), (10, 301)):
        got = G.training_rows(df, per_language=8, sample_texts=budget)
        assert len({r.lang for r in got}) == 301 and len(got) == most
    net = G.train(df, per_language=1)
    assert len(net.languages) == 301 and "rare" in net.languages


def test_copies_count_once_in_the_sample(spark):
    rows = [("aa", "the same text over and over")] * 2000 + [("aa", f"another text number {i}") for i in range(10)]
    rows += [("bb", "")] * 1000 + [("bb", "12 !!")] * 1000 + [("bb", f"ein Text {i}") for i in range(5)]
    rows += [("cc", f"copied text {i % 40}") for i in range(4000)] + [("cc", f"single text {i}") for i in range(40)]
    got = [(r.lang, r.text) for r in G.training_rows(spark.createDataFrame(rows, "lang string, text string"), per_language=30)]
    assert len(got) == len(set(got))
    assert {v for v in got if v[0] != "cc"} == {(v, f"{t}"[:600]) for v, t in rows if v != "cc" and any(map(str.isalpha, t))}
    assert sum(v == "cc" for v, _ in got) == 30
