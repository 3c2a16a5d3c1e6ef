"""Language identification by a byte convolutional network trained in numpy.

Bytes (A-Z lowered, digits as 0, white space as blank) get small vectors; filters of ``WIDTHS`` bytes slide over
windows of ``WINDOW`` bytes; each filter keeps its greatest answer in the window; a softmax layer turns these
into probabilities of the languages.  A text is cut into consecutive windows, all of them are scored, and its
languages' probabilities are the means over its windows, weighted by their bytes other than blanks and padding.

The network is fitted on the driver on a bounded sample: at most ``PER_LANGUAGE`` texts of each label, fewer where
the labels together would have more than ``SAMPLE_TEXTS`` but at least one, so that every label is learned (beyond
``SAMPLE_TEXTS`` labels the sample is one text of each), and ``SAMPLE_CHARS`` characters from the start and as many from the middle of
each.  Only those with a letter in these characters are taken.  Copies of a text under a label count once: they are
merged by hash with map-side combining before anything is counted, and the distinct texts are thinned by that hash
(the one with the least hash always stays) before the exact cut, so no task sorts all texts of a language.  Prediction reads
whole texts in Arrow batches; a long text goes through in blocks of windows.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is any text if no row is
labelled; with one label every text with a letter gets it; equal rows get equal answers; an empty table gives an
empty result; other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscope.llm.common import scratch_table

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
DIM = 6
PER_LANGUAGE = 400
SAMPLE_TEXTS = 80_000
SAMPLE_CHARS = 600
BLOCK = 256  # windows scored at once

FOLD = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c <= 32 else c for c in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def windows(text: str) -> np.ndarray:
    """(n, WINDOW) bytes, the last window padded with 0."""
    data = text.encode("utf-8", "replace").translate(FOLD)
    data = data.ljust(-(-max(1, len(data)) // WINDOW) * WINDOW, b"\0")
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW)


@dataclass
class ByteNetwork:
    languages: list[str]
    bytes_: np.ndarray  # 256 x DIM, row 0 (padding) zero
    filters: np.ndarray  # max(WIDTHS) * DIM x filters, zero below each filter's width
    bias: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray

    def convolved(self, x: np.ndarray) -> np.ndarray:
        """(n, positions, filters); windows get padding on the right, so every byte starts a position."""
        n, wide = len(x), max(WIDTHS)
        e = np.zeros((n, WINDOW + wide - 1, DIM), np.float32)
        np.take(self.bytes_, x, axis=0, out=e[:, :WINDOW])
        s = e.strides
        grams = np.lib.stride_tricks.as_strided(e, (n, WINDOW, wide * DIM), (s[0], s[1], s[2]))
        return (grams.reshape(n * WINDOW, wide * DIM) @ self.filters).reshape(n, WINDOW, -1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.convolved(x).max(axis=1) + self.bias, 0)
        return softmax(pooled @ self.top + self.top_bias)

    def score(self, text: str) -> np.ndarray:
        return self.score_many([text])[0]

    def score_many(self, texts: list[str]) -> np.ndarray:
        """One row of mean probabilities for each text.  Windows of many texts share blocks; a long text is
        spread over as many blocks as it needs."""
        out, weight = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        held, owner, size = [], [], 0

        def flush() -> None:
            x, who = np.concatenate(held), np.concatenate(owner)
            for at in range(0, len(x), BLOCK):
                part, whose = x[at:at + BLOCK], who[at:at + BLOCK]
                seen = ((part != 0) & (part != 32)).sum(axis=1).astype(float)
                np.add.at(out, whose, self.probabilities(part) * seen[:, None])
                np.add.at(weight, whose, seen)

        for i, text in enumerate(texts):
            held.append(windows(text))
            owner.append(np.full(len(held[-1]), i))
            size += len(held[-1])
            if size >= 8 * BLOCK:
                flush()
                held, owner, size = [], [], 0
        if held:
            flush()
        return out / np.maximum(weight, 1e-300)[:, None]


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], epochs: int = 6, batch: int = 256, rate: float = 0.01, seed: int = 7) -> ByteNetwork:
    """Adam on the cross entropy of single windows."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    cut = [windows(t) for t in texts]
    x = np.concatenate(cut)
    y = np.repeat([languages.index(v) for v in labels], [len(c) for c in cut])
    wide, n_filters = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.repeat(np.stack([np.repeat(np.arange(wide) < w, DIM) for w in WIDTHS], axis=1), FILTERS, axis=1).astype(np.float32)
    net = ByteNetwork(languages, rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
                      rng.normal(0, 0.3, (wide * DIM, n_filters)).astype(np.float32) * mask, np.zeros(n_filters, np.float32),
                      rng.normal(0, 0.2, (n_filters, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    net.bytes_[0] = 0
    weights = [net.bytes_, net.filters, net.bias, net.top, net.top_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            xb, yb = x[order[at:at + batch]], y[order[at:at + batch]]
            n, conv = len(xb), net.convolved(xb)
            best = conv.argmax(axis=1)
            raw = np.take_along_axis(conv, best[:, None], axis=1)[:, 0] + net.bias
            pooled = np.maximum(raw, 0)
            p = softmax(pooled @ net.top + net.top_bias)
            p[np.arange(n), yb] -= 1
            p /= n
            back = (p @ net.top.T) * (raw > 0)
            padded = np.concatenate([xb, np.zeros((n, wide - 1), np.uint8)], axis=1)
            gram = padded[np.arange(n)[:, None, None], best[:, :, None] + np.arange(wide)]  # n x filters x wide
            inputs = net.bytes_[gram].reshape(n, n_filters, wide * DIM)
            g_filters = np.einsum("nf,nfk->kf", back, inputs) * mask
            g_bytes = np.zeros_like(net.bytes_)
            np.add.at(g_bytes, gram.reshape(-1), (back[:, :, None] * net.filters.T).reshape(-1, DIM))
            g_bytes[0] = 0
            step += 1
            for w, g, m, v in zip(weights, (g_bytes, g_filters, back.sum(0), pooled.T @ p, p.sum(0)), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_texts: int = SAMPLE_TEXTS) -> list:
    """(lang, text) of the bounded sample; docs: (text, lang), all of which may be learned from."""
    middle = F.greatest(F.lit(SAMPLE_CHARS), F.floor(F.length("text") / 2).cast("int")) + 1
    cut = F.concat(F.substring("text", 1, SAMPLE_CHARS), F.substring("text", middle, F.lit(SAMPLE_CHARS)))
    usable = docs.where("lang is not null and lang <> 'und' and text is not null").select("lang", F.xxhash64("text").alias("h"), cut.alias("text")).where(F.col("text").rlike("\\p{L}"))
    mix = 1 << 30
    place = F.pmod("h", F.lit(mix))
    counts = usable.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("count"), F.min(place).alias("least"))
    counts = scratch_table(counts, "lang-counts")  # one row a label, as the network's last layer has
    labels = counts.count()
    per_language = max(1, min(per_language, sample_texts // max(1, labels)))
    rate = F.least(F.lit(mix), F.ceil(F.lit(4.0 * per_language * mix) / F.col("count")))
    keep = counts.select(F.col("lang").alias("l"), F.greatest(rate, F.col("least") + 1).alias("below"))
    thinned = usable.join(F.broadcast(keep) if labels <= SAMPLE_TEXTS else keep, F.col("lang") == F.col("l")).where(place < F.col("below"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = thinned.select("lang", "h", "text").distinct().withColumn("nth", nth)
    return sample.where(F.col("nth") <= per_language).orderBy("lang", "nth").select("lang", "text").collect()


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_texts: int = SAMPLE_TEXTS) -> ByteNetwork | None:
    rows = [r for r in training_rows(docs, per_language, sample_texts) if has_letter(r.text)]
    return fit([r.text for r in rows], [r.lang for r in rows]) if rows else None


def predicted(text: Column, net: ByteNetwork | None) -> Column:
    """struct(lang, score) of a string column."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(col: pa.Array) -> pa.Array:
        texts = col.to_pylist()
        known = [i for i, t in enumerate(texts) if net is not None and has_letter(t)]
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if known:
            p = net.score_many([texts[i] for i in known])
            for i, best in zip(known, p.argmax(axis=1).tolist()):
                langs[i] = net.languages[best]
            scores[known] = np.clip(p.max(axis=1), 0, 1)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], names=["lang", "score"])

    return predict(text)


def identify(docs: DataFrame, net: ByteNetwork | None) -> DataFrame:
    """docs with lang_pred and score; columns of docs that have these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    out = docs.withColumn("__lang", predicted(F.col("text"), net))
    return out.select(*docs.columns, F.col("__lang.lang").alias("lang_pred"), F.col("__lang.score").alias("score"))


def keep_identified(docs: DataFrame, net: ByteNetwork | None, accepted: list[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """The rows of docs whose language is known (and one of ``accepted``, if given) with ``min_score`` or more;
    rejected are ``und`` and the rest."""
    out = docs.withColumn("__lang", predicted(F.col("text"), net)).where((F.col("__lang.lang") != "und") & (F.col("__lang.score") >= min_score))
    return (out.where(F.col("__lang.lang").isin(accepted)) if accepted else out).select(*docs.columns)
