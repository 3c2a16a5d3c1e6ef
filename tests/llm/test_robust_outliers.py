"""Base counts against plain Python, the estimate against numpy, and hard inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.llm import robust_outliers as R

SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string, carry int, kept string"


def counts(text):
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i, k in enumerate(zip(w, w[1:], w[2:])) if seen[k] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), max(len(lines), 1)


def vector(c):
    n, chars, symbols, dup, rep, lines = c
    return [math.log1p(n), chars / max(n, 1), math.sqrt(symbols / max(chars, 1)), math.sqrt(dup / lines), math.sqrt(rep / max(n, 1))]


def estimate(x, support=R.SUPPORT):
    """The same estimate in numpy, with numpy's inverses and determinants."""
    noise = np.array(list(R.NOISE.values()))
    ridge = np.diag(noise**2)
    q1, centre, q3 = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    scale = np.maximum((q3 - q1) / 1.349, noise)
    z = (x - centre) / scale
    norm = np.sqrt((z * z).sum(1))
    starts = [np.diag(scale**2)]
    for t in (np.tanh(z), np.where(norm[:, None] > 0, z / np.maximum(norm, 1e-300)[:, None], 0)):
        c = np.cov(t.T, bias=True)
        d = np.sqrt(np.diag(c) + 1e-3)
        c = c / np.outer(d, d)
        np.fill_diagonal(c, 1)
        starts.append(c * np.outer(scale, scale))
    best = None
    for k in starts:
        m, before = centre, None
        while True:
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(k), x - m)
            step = np.floor(np.log2(d2 + 1e-9) * R.STEPS)
            rank = np.array([(step < s).sum() for s in step])
            near = x[rank < support * len(x)]
            m, k = near.mean(0), R.consistency(support) * np.cov(near.T, bias=True) + ridge
            now = 0.5 * np.linalg.slogdet(k)[1]
            if before is not None and not now < before - R.SETTLED:
                break
            before = now
        if best is None or now < best[0]:
            best = (now, m, k)
    _, m, k = best
    d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(k), x - m)
    near = x[d2 <= R.chi2_quantile(0.975, 5)]
    m, k = near.mean(0), R.consistency(0.975) * np.cov(near.T, bias=True) + ridge
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(k), x - m)


def prose(rng, n, mean=4):
    words = ["".join(rng.choice("aeinorst") for _ in range(max(1, int(rng.gauss(mean, 2))))) for _ in range(300)]
    return "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(max(5, n // 12)))


def corpus():
    rng = random.Random(1)
    rows = []
    for lang, source, n in (("en", "a", 140), ("en", "b", 30), ("en", None, 30), (None, "a", 20), ("de", "a", 20), ("de", "b", 15)):
        for _ in range(n):
            rows.append((len(rows), prose(rng, int(rng.lognormvariate(5.3, 0.6)) + 60, 4 if lang == "en" else 6), lang, source, "x", 1, "y"))
    for i in range(12):  # odd ones, in a large and in pooled segments
        rows.append((1000 + i, " ".join(w + "&&&" for w in prose(rng, 200).split()), ("en", "de")[i % 2], "a", "x", 1, "y"))
    rows += [(2000, rows[0][1], "en", "a", "x", 1, "y")] * 60
    return rows


def test_base_counts(spark):
    texts = ["", None, " \t\n\r ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "l\nl\n\n \nl \nm\r\nm\r\nm", "#a* $%& |<> é😀é\x0b\x0cz",
             " lead and trail ", "a b\xa0c d e", "aa b c aab c a ab c", "one two three " * 40 + "end", "w " * 3000, "\n".join(["same line here"] * 500)]
    rng = random.Random(2)
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = [(i, t, "en", "s", "x", 1, "y") for i, t in enumerate(texts)]
    got = {r.carry.doc_id: r for r in R.quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        r, c = got[i], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c[:5], repr(t)
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        if r.base_failed:
            assert not r.kept and r.d2 is None


def test_equals_numpy_by_segment(spark):
    rows = corpus()
    got = R.quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    passing = [r for r in rows if not (counts(r[1])[0] < 50 or 100 * counts(r[1])[4] > 50 * counts(r[1])[0])]
    size = Counter((r[2], r[3]) for r in passing)
    langs = Counter(r[2] for r in passing if size[r[2], r[3]] < R.LEAST_ROWS)
    rest = sum(n for lang, n in langs.items() if n < R.LEAST_ROWS)
    assert rest >= R.LEAST_ROWS and any(n >= R.LEAST_ROWS for n in langs.values())

    def segment(r):
        if size[r[2], r[3]] >= R.LEAST_ROWS:
            return 0, r[2], r[3]
        return (1, r[2], None) if langs[r[2]] >= R.LEAST_ROWS else (2, None, None)

    want = {}
    for s in {segment(r) for r in passing}:
        mine = [r for r in passing if segment(r) == s]
        d2 = estimate(np.array([vector(counts(r[1])) for r in mine]))
        want.update({r[0]: d for r, d in zip(mine, d2)})
    limit = R.chi2_quantile(1 - R.CUTOFF, 5)
    for r in got:
        if not r.base_failed:
            assert r.d2 == pytest.approx(want[r.carry.doc_id], rel=1e-6)
            assert r.kept == (r.d2 <= limit)
    odd = [r for r in got if 1000 <= r.carry.doc_id < 1100 and not r.base_failed]
    assert len(odd) == 12 and not any(r.kept for r in odd)
    assert all(r.kept for r in got if not r.base_failed and not 1000 <= r.carry.doc_id < 1100)


def test_few_and_no_rows(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 200), "en", "s", "x", 1, "y") for i in range(5)] + [(None, prose(rng, 200) + " ####" * 100, None, None, "x", 1, "y")]
    got = R.quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and all(r.kept == (not r.base_failed) and r.d2 is None for r in got)
    empty = R.quality_verdicts(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and "kept" in empty.columns


def test_equal_rows_are_no_outliers(spark):
    text = prose(random.Random(4), 100)
    df = spark.createDataFrame([(i, text, "en", "s", "x", 1, "y") for i in range(80)], SCHEMA)
    got = R.quality_verdicts(df).collect()
    assert all(r.kept and r.d2 == pytest.approx(0, abs=1e-9) for r in got)


def test_chi_square():
    assert R.chi2_quantile(0.5, 5) == pytest.approx(4.35146, abs=1e-4)
    assert R.chi2_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-4)
    assert R.chi2_cdf(4.35146, 7) == pytest.approx(0.26093, abs=1e-3)
    assert R.consistency(1.0) == 1.0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", "x", 1, "y")], SCHEMA)
    plan = R.text_statistics(df.select(F.col("doc_id"), "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
