"""The pipeline against brute-force versions of its stages on a small table with copies, leaks and secrets."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_decontam import slow as slow_hits
from test_secret_scan import slow as slow_spans
from test_simhash import slow_components, slow_fingerprint
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as C
from tabscope.llm.secret_scan import PLACEHOLDER

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(8)
    base = [r for r in range(60)]
    words = ["the", "of", "and", "alpha", "beta", "gamma", "delta", "Zeta,", "naïve", "with"]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 12, 80, 400]))) for _ in base]
    item = " ".join(rng.choices(["quark", "lepton", "boson", "gluon"], k=14))
    texts += texts[:10] + [texts[11] + "\n"] + [f"{texts[12]} {item} {texts[13]}", item, item[:20]]
    texts += [f"token=abcdef{i:05d} {texts[20 + i]}" for i in range(5)] + [None, "", "12 34 !!", "漢字 " * 6000]
    rows = [(i, t, rng.choice(["en", "fr"]), "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "no id at all here", "en", "s", 17)], [(1, item), (2, None), (3, "unseen words")]


def redacted(text):
    clean, at = "", 0
    for a, _, b in slow_spans(text)[2]:
        clean += (text[at:a] + PLACEHOLDER) if a >= at else ""
        at = max(at, b)
    return clean + text[at:]


def brute_force(rows, items):
    rows = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    prints = [(r[0], slow_fingerprint(r[1])) for r in rows]
    groups = {}
    for r, (i, f), c in zip(rows, prints, slow_components(prints)):
        groups.setdefault(c if c is not None else ("none", f), []).append(r)
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    rows = [r for r in rows if slow_hits([(r[0], r[1])], items, 10, 5, 1.0)[0][2] == 0]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for r in rows:
        ids = whole.encode(redacted(r[1]), add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at:at + 4096], "<u4").tobytes()
            out[r[0], p, at, len(part) // 4, zlib.crc32(part)] += 1
    return out


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, items = fixture()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = E.queries()["pipeline"](spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute_force(rows, items)
    at = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 4096 and len(at) <= -(-sum(at.values()) // 4096) * 1.02 + 1


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    rows, items = fixture()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    full = spark.createDataFrame(rows, COLUMNS).withColumns({"row": F.lit(1), "key": F.lit("x"), "fp": F.lit(2)})
    for docs in (full, full.limit(0)):
        for _, stage in C.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
    assert [n for n, _ in C.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "secret_scan", "best_fit_packing"]
    assert C.STAGES[-1][1](spark, full.limit(0), str(tmp_path)).collect() == []
