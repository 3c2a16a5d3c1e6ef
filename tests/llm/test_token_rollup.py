"""Delta-maintained totals against counting the surviving documents from scratch."""

import random
from collections import Counter

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as E
from tabscope.llm.common import scratch_path
from tabscope.llm.token_rollup import BLANK_WORDS, TokenRollup, inserts

PATH = public_tokenizers.path("word_bpe_49k.json")
VERSIONS = {"bpe": PATH, BLANK_WORDS: None}
SCHEMA = "op string, seq long, doc_id long, source string, lang string, text string, batch string, tokenizer int"
WHOLE = Tokenizer.from_file(PATH)


def replay(batches):
    """The rows that count after all batches, by carrying events out one by one."""
    rows = []
    for events in batches:
        for op, _, doc, source, lang, text in sorted(events, key=lambda e: e[1]):
            if op in ("delete", "revise"):
                rows = [r for r in rows if r[0] != doc]
            if op in ("insert", "revise"):
                rows.append((doc, source, lang, text))
    out = Counter()
    for _, source, lang, text in rows:
        for version, n in (("bpe", len(WHOLE.encode(text or "", add_special_tokens=False).ids)), (BLANK_WORDS, len((text or "").encode().split()))):
            out[source, lang, version, "docs"] += 1
            out[source, lang, version, "tokens"] += n
    return {k: v for k, v in out.items() if v}


def totals(rollup):
    out = {}
    for r in rollup.totals().collect():
        out[r.source, r.lang, r.tokenizer, "docs"], out[r.source, r.lang, r.tokenizer, "tokens"] = r.n_docs, r.n_tokens
    return {k: v for k, v in out.items() if v}


def table(spark, events):
    return spark.createDataFrame([(*e, "clash", 1) for e in events], SCHEMA)


def test_batches_match_replay_and_commits_are_idempotent(spark):
    rng = random.Random(6)
    rollup = TokenRollup(spark, scratch_path(spark, "rollup-test"), VERSIONS)
    texts = ["one two", "Été naïve!", None, "", "x " * 500, "token\ncounts"]
    done = []
    for b in range(4):
        events, seq = [], 0
        for _ in range(40 if b != 2 else 0):
            seq += 1
            op = "insert" if b == 0 else rng.choice(["insert", "delete", "revise"])
            events.append((op, seq, rng.choice([*range(25), None]), rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice(texts)))
        done.append(events)
        assert rollup.commit(f"b{b}", table(spark, events)) is True
        assert totals(rollup) == replay(done)
        assert rollup.commit(f"b{b}", table(spark, events)) is False
        assert totals(rollup) == replay(done)
    assert rollup.batches() == ["b0", "b1", "b2", "b3"]


def test_ties_nulls_and_unknown_events(spark):
    """Equal seq: deletes, revises, inserts; null seq first; of several revises one counts; other ops change nothing."""
    rollup = TokenRollup(spark, scratch_path(spark, "rollup-test"), {BLANK_WORDS: None})
    first = [("insert", 1, d, "a", "en", "w") for d in range(1, 8)]
    rollup.commit("b0", table(spark, first))
    events = [("revise", 5, 1, "b", "en", "x y"), ("revise", 5, 1, "b", "en", "x y"), ("revise", 4, 1, "c", "en", "old"),
              ("insert", 5, 2, "b", "en", "x y"), ("delete", 5, 2, None, None, None), ("delete", 5, 3, None, None, None), ("insert", None, 3, "z", "en", "lost"),
              ("insert", None, 4, "b", "en", "x y"), ("revise", None, 4, "b", "en", "x y"), ("replace", 5, 5, "q", "en", "q"), (None, 5, 6, "q", "en", "q")]
    rollup.commit("b1", table(spark, events))
    got = {(r.source, r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    # 1 revised once; 2 deleted, inserted; 3 gone; 4 revised, then inserted; 5, 6 and 7 as they were
    assert got == {("b", 4, 8), ("a", 3, 3)}
    tied = [("revise", 9, 7, "s", "en", "one"), ("revise", 9, 7, "t", "en", "two words")]
    rollup.commit("b2", table(spark, tied))
    left = {(r.source, r.n_docs) for r in rollup.totals().collect()}
    assert left in ({("b", 4), ("a", 2), ("s", 1)}, {("b", 4), ("a", 2), ("t", 1)})


def test_a_batch_that_broke_off_is_invisible_and_written_anew(spark):
    rollup = TokenRollup(spark, scratch_path(spark, "rollup-test"), VERSIONS)
    first = [("insert", 1, 1, "a", "en", "one two three")]
    rollup.commit("b0", table(spark, first))
    later = [("revise", 1, 1, "a", "en", "one"), ("insert", 2, 2, "b", "en", "four five")]
    rollup.changes().drop("batch").write.parquet(f"{rollup.path}/changes/batch=b1")
    rollup.totals().write.parquet(f"{rollup.path}/totals/batch=b1")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{rollup.path}/totals/batch=b1/_SUCCESS")
    fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(fs, False)
    assert totals(rollup) == replay([first])
    assert rollup.commit("b1", table(spark, later)) is True
    assert totals(rollup) == replay([first, later])


def test_query_matches_sql_counts_and_the_tokenizer(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in E.queries()["op3_token_rollup"](spark, sf).collect()}
    rows = duckdb.sql(f"""SELECT source, lang, count(*), sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))), string_agg(doc_id, ',')
        FROM '{sf}/documents.parquet' GROUP BY ALL""").fetchall()
    assert {k[:2]: v for k, v in got.items() if k[2] == BLANK_WORDS} == {(s, v): (n, int(t)) for s, v, n, t, _ in rows}
    texts = duckdb.sql(f"SELECT source, lang, text FROM '{sf}/documents.parquet'").fetchall()
    want = Counter()
    for (s, v, _), e in zip(texts, WHOLE.encode_batch([t for _, _, t in texts], add_special_tokens=False)):
        want[s, v] += len(e.ids)
    assert {k[:2]: v[1] for k, v in got.items() if k[2] == "word_bpe_49k"} == dict(want)


def test_empty_table(spark):
    rollup = TokenRollup(spark, scratch_path(spark, "rollup-test"), VERSIONS)
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, text string")
    assert rollup.totals().collect() == []
    assert rollup.commit("b0", inserts(docs)) and rollup.totals().collect() == []
