"""Packing: ids equal the tokenizer's, pieces tile documents, sequences are gapless, and the plan is near its bound."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabscope.llm import packing as K
from tabscope.llm.tokens import TextTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, row string, length int, ids string, offset string"
TOKENIZERS = (TextTokenizer(PATH, limit=50), Tokenizer.from_file(PATH))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x2FF), st.sampled_from(" \n'stredvlm.,!?A<|>ΣßİﬁǺ\x1c\x85\xa0²½ª漢🙂"))))
def test_cached_ids_equal_whole_encoding(text):
    cached, whole = TOKENIZERS
    assert np.frombuffer(cached.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|startoftext|> b", "it's WE'LL 'tis x''s", "É é É", "12½ a²b", "ΑΣ ΑΣ.", "", " \n ", "'s't're"])
def test_cached_ids_of_special_texts(text):
    cached, whole = TOKENIZERS
    assert np.frombuffer(cached.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def check_plan(histogram, capacity, entries):
    got = Counter()
    for e in entries:
        assert e.count > 0 and e.room(capacity) >= 0
        for s, a in e.lengths.items():
            got[s] += a * e.count
    assert got == Counter(histogram)
    return sum(e.count for e in entries)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 40), max_size=12))))
def test_plans_cover_the_histogram(case):
    capacity, histogram = case
    n = check_plan(histogram, capacity, K.plan_sequences(histogram, capacity, 20))
    total = sum(s * a for s, a in histogram.items())
    assert -(-total // capacity) <= n <= 2 * total / capacity + 1


def test_plan_is_optimal_where_configurations_repeat():
    for times in (1, 10, 1000):
        histogram = {6: 7 * times, 10: 7 * times, 16: 3 * times, 34: 10 * times, 51: 10 * times}
        assert check_plan(histogram, 101, K.plan_sequences(histogram, 101)) == 10 * times


def documents():
    rng = random.Random(2)
    words = ["alpha", "Beta's", "gamma,", "naïve", "漢字", "x", "1234", "don't", "ﬁne"]
    texts = [" ".join(rng.choices(words, k=int(rng.paretovariate(0.6)) % 3000)) for _ in range(120)]
    texts += ["same words here"] * 60 + [None, "", " \n", "long " * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, texts[5]), (5, "other")]
    return rows


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packed_documents(spark, capacity):
    rows = documents()
    df = spark.createDataFrame([(i, t, "clash", 1, "x", "y") for i, t in rows], SCHEMA)
    out = K.pack(K.token_pieces(df, PATH, capacity, keep_ids=True), capacity)
    got = out.collect()
    whole = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at:at + capacity], "<u4").tobytes()
            want[i, p, at, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= capacity
    bound = -(-sum(at.values()) // capacity)
    assert bound <= len(at) <= bound * 1.02 + 1
    made = K.assemble(out).collect()
    assert {r.sequence_id: r.n_tokens for r in made} == dict(at)
    by_id = {r.sequence_id: r.ids for r in made}
    for r in got:
        assert np.array(by_id[r.sequence_id][r.offset:r.offset + r.length], "<u4").tobytes() == bytes(r.ids)


def test_empty_table(spark):
    assert K.pack_documents(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_program_goes_on_past_lengths_that_cannot_be_filled():
    histogram = {s: 40 for s in range(3900, 3990)} | {1500: 3000, 1298: 6000, 1198: 3000, 900: 2000, 698: 4000, 1700: 2000}
    used = K.fractional_solution(histogram, 4096, K.ROUNDS)
    covered = Counter()
    for often, lengths in used:
        for s, a in lengths.items():
            covered[s] += a * often
    assert all(n * 0.99 <= covered[s] <= n * (1 + 1e-6) for s, n in histogram.items())
    assert check_plan(histogram, 4096, K.plan_sequences(histogram)) <= 9600  # best fit alone: 10025


def test_program_applies_where_no_mix_fills_a_sequence():
    histogram = {s: 30 for s in range(400, 4096, 100)}
    alone = sum(e.count for e in K.best_fit(histogram, [], 4096))
    assert K.fractional_solution(histogram, 4096, K.ROUNDS)
    assert check_plan(histogram, 4096, K.plan_sequences(histogram)) <= alone
    assert K.fullest(np.array([7, 5]), 13).tolist() == [0, 0, 0, 0, 0, 5, 5, 7, 7, 7, 10, 10, 12, 12]
