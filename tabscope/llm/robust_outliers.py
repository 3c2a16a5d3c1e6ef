"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Base rules count words, repeated lines and repeated 3-word windows of a text.  Documents that pass them are judged by
five transformed statistics: log of the words, mean word length, and the square roots of the shares of symbols, of
repeated lines and of repeated words.  For each segment (language and source) the minimum-covariance-determinant
estimate finds the half of its documents whose scatter is least, and a document goes if its Mahalanobis distance from
that half is too great for a clean one.

Estimate.  Three deterministic starts (distances scaled by quartiles; scatter of tanh scores; scatter of spatial signs)
are improved by concentration steps: take the rows not beyond the ``support`` quantile of the distances, and their mean
and covariance give the next distances.  Distances count in steps of a 64th of an octave, and rows of the quantile's own
step all belong to it.  Steps go on until no determinant falls any more; the start with the least determinant wins,
and one reweighting step follows.  Each concentration is one grouped aggregation over rows of five numbers, combined
map-side by segment and distance step, so a segment that holds a third of all rows is never gathered.  Covariances are
inverted as Cholesky factors written out in column expressions; nothing but a truth value comes to the driver.

``NOISE`` is a standard deviation that each statistic has of itself; its square is added to the diagonal of every
covariance.  Without it more than half of the documents, having no symbol at all, would make one symbol an outlier.
The ridge being constant, concentration lowers the determinant with it as it does without.

Segments need ``least_rows`` passing documents.  Smaller ones of a language are taken together, and if these are still too
few, those of all languages; if even they are too few, the documents stay without a verdict.

Defined cases: null text has no words; null languages and sources are segments like others; equal rows, ties and null
doc_ids each keep their row; an empty table gives an empty result; texts are read whole; other columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.common import scratch_table
from tabscope.operators.quantiles import quantiles_wide
from tabscope.operators.segments import BROADCAST_BYTES, seg_bytes, seg_join

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: statistic: standard deviation of its own
NOISE = {"log_words": 0.25, "word_length": 0.25, "symbols": 0.08, "repeated_lines": 0.15, "repeated_words": 0.12}
SUPPORT, LEAST_ROWS = 0.5, 50
#: share of clean documents beyond the distance at which a document goes, were they normal
CUTOFF = 1e-7
#: distance steps an octave; fall of half the log determinant below which an estimate is settled
STEPS, SETTLED = 64, 1e-4
SEGMENT = ["seg_level", "seg_lang", "seg_source"]
N = len(NOISE)
_X = [f"x{i}" for i in range(N)]


def chi2_cdf(x: float, df: int) -> float:
    """Of the chi-square distribution, by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = df / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= half / n
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """Makes the covariance of the nearest ``share`` of normal rows that of all."""
    return 1.0 if share >= 1 else share / chi2_cdf(chi2_quantile(share, N), N + 2)


def text_statistics(docs: DataFrame) -> DataFrame:
    """docs with text replaced by n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    inner = F.btrim(text, F.lit(SPACES))
    out = docs.select(
        *rest, F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+")).alias("__w"),
        F.char_length(F.translate(text, SPACES, "")).alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"), lines.alias("__l"))
    n = F.size("__w")
    m = F.greatest(n - 2, F.lit(0))
    windows = F.arrays_zip(*[F.slice("__w", F.lit(i), m).alias(f"w{i}") for i in (1, 2, 3)])
    out = out.select(*rest, n.alias("n_words"), "word_chars", "n_symbols", F.size("__l").alias("n_lines"),
                     (F.size("__l") - F.size(F.array_distinct("__l"))).alias("n_dup_lines"), windows.alias("__z"))
    kept = [*rest, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    # equal windows have equal hashes: a text whose hashes all differ has none, and only others compare words
    hashes = F.transform("__z", lambda z: F.xxhash64(z["w1"], z["w2"], z["w3"]))
    out = out.select(*kept, "__z", F.size(F.array_distinct(hashes)).alias("__d"))
    placed = F.sort_array(F.transform("__z", lambda z, i: F.struct(F.concat_ws(" ", z["w1"], z["w2"], z["w3"]).alias("w"), i.alias("i"))))
    out = out.select(*kept, F.when(F.col("__d") < F.size("__z"), placed).alias("__s"))
    k = F.size("__s") - 1
    twins = F.filter(F.arrays_zip(F.slice("__s", F.lit(1), k).alias("a"), F.slice("__s", F.lit(2), k).alias("b")), lambda p: p["a"]["w"] == p["b"]["w"])
    starts = F.array_distinct(F.flatten(F.transform(twins, lambda p: F.array(p["a"]["i"], p["b"]["i"]))))
    out = out.select(*kept, F.when(F.col("__s").isNotNull(), starts).alias("__p"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("__p", lambda i: F.array(i, i + 1, i + 2)))))
    return out.select(*kept, F.when(F.col("__p").isNotNull(), covered).otherwise(0).alias("n_repeat_words"))


def statistic_vector() -> dict[str, Column]:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {"log_words": F.log1p("n_words"), "word_length": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
            "symbols": share("n_symbols", "word_chars"), "repeated_lines": share("n_dup_lines", "n_lines"),
            "repeated_words": share("n_repeat_words", "n_words")}


def with_segments(rows: DataFrame, least_rows: int) -> DataFrame:
    """rows (lang, source, x0...) with their segment: level 0 a language and source, 1 the small sources of a language, 2 the
    small ones of all languages, 3 too few."""
    own = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("c0"))
    small = F.when(F.col("c0") < least_rows, F.col("c0"))
    own = scratch_table(own.withColumn("c", small), "mcd-sizes")
    langs = own.groupBy("lang").agg(F.sum("c").alias("c1"))
    own = seg_join(own, langs, ["lang"], "left")
    all_small = own.agg(F.coalesce(F.sum(F.when(F.col("c1") < least_rows, F.col("c"))), F.lit(0)).alias("c2"))
    own = seg_join(own, all_small, [])
    level = (F.when(F.col("c0") >= least_rows, 0).when(F.col("c1") >= least_rows, 1).when(F.col("c2") >= least_rows, 2).otherwise(3))
    own = own.select("lang", "source", level.alias("seg_level")).select(
        "lang", "source", "seg_level", F.when(F.col("seg_level") <= 1, F.col("lang")).alias("seg_lang"),
        F.when(F.col("seg_level") == 0, F.col("source")).alias("seg_source"))
    own = scratch_table(own, "mcd-segments")
    return seg_join(rows, own, ["lang", "source"], broadcast_right=seg_bytes(own, ["lang", "source"]) <= BROADCAST_BYTES)


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(N) for j in range(i + 1)]


def inverse_factor(table: DataFrame, keep: list[str]) -> DataFrame:
    """keep, m0..., the entries i_jk of the inverse of the lower Cholesky factor of the matrix k_ij, and half of the log of
    its determinant.  One SELECT, whose entries refer to those named before them."""
    steps: list[str] = []
    for j in range(N):  # column by column, each entry from those before
        steps.append(f"sqrt({' - '.join([f'k{j}{j}'] + [f'l{j}{k} * l{j}{k}' for k in range(j)])}) AS l{j}{j}")
        steps += [f"({' - '.join([f'k{i}{j}'] + [f'l{i}{k} * l{j}{k}' for k in range(j)])}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, N)]
    for i in range(N):  # forward substitution for the columns of the identity
        steps += [f"-({' + '.join(f'l{i}{k} * i{k}{j}' for k in range(j, i))}) / l{i}{i} AS i{i}{j}" for j in range(i)]
        steps.append(f"1 / l{i}{i} AS i{i}{i}")
    half = " + ".join(f"ln(l{i}{i})" for i in range(N))
    made = table.selectExpr(*keep, *[f"m{i}" for i in range(N)], *steps, f"{half} AS half_log_det")
    return made.drop(*[f"l{i}{j}" for i, j in _pairs()])


def distances(rows: DataFrame, table: DataFrame, keys: list[str], small: bool, centred: bool = False) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance from their segment's estimate; null where there is none.
    ``centred``: with the estimate's mean and the differences from it as well."""
    joined = seg_join(rows, table, keys, "left", broadcast_right=small)
    parts = []
    for i in range(N):
        y = sum((F.col(f"i{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        parts.append(F.pow(y, F.lit(2.0)))
    more = [F.col(f"m{i}") for i in range(N)] + [(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"c{i}") for i in range(N)] if centred else []
    return joined.select(*rows.columns, *more, sum(parts[1:], parts[0]).alias("d2"))


def nearest_moments(far: DataFrame, keys: list[str], support: float) -> DataFrame:
    """keys, m0..., k_ij: mean and covariance of the rows within the ``support`` quantile of d2, in one aggregation.

    Rows are summed by keys and step of d2; a running count over the steps tells which belong to the half, and sums of
    whole steps are added up.  Sums are of differences from the former mean, so they stay accurate."""
    step = F.floor(F.log2(F.col("d2") + 1e-9) * STEPS).cast("int")
    sums = far.groupBy(*keys, step.alias("step")).agg(
        F.count(F.lit(1)).alias("n"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(N)], *[F.sum(f"c{i}").alias(f"c{i}") for i in range(N)],
        *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"c{i}{j}") for i, j in _pairs()])
    order = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"nearer": F.coalesce(F.sum("n").over(order), F.lit(0)), "all": F.sum("n").over(Window.partitionBy(*keys))})
    half = sums.where(F.col("nearer") < support * F.col("all")).groupBy(*keys).agg(
        F.sum("n").alias("n"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(N)], *[F.sum(f"c{i}").alias(f"c{i}") for i in range(N)],
        *[F.sum(f"c{i}{j}").alias(f"c{i}{j}") for i, j in _pairs()])
    mean = lambda i: F.col(f"c{i}") / F.col("n")
    factor, noise = consistency(support), list(NOISE.values())
    covariance = lambda i, j: F.col(f"c{i}{j}") / F.col("n") - mean(i) * mean(j)
    return half.select(*keys, *[(F.col(f"m{i}") + mean(i)).alias(f"m{i}") for i in range(N)],
                       *[(factor * (F.greatest(covariance(i, j), F.lit(0.0)) if i == j else covariance(i, j)) + (noise[i] ** 2 if i == j else 0.0)).alias(f"k{i}{j}") for i, j in _pairs()])


def moments(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """keys, m0..., k_ij: mean and covariance (times factor, the noise added) of rows."""
    noise = list(NOISE.values())
    sums = rows.groupBy(*keys).agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(_X)],
                                   *[F.covar_pop(_X[i], _X[j]).alias(f"k{i}{j}") for i, j in _pairs()])
    return sums.select(*keys, *[f"m{i}" for i in range(N)],
                       *[(F.col(f"k{i}{j}") * factor + (noise[i] ** 2 if i == j else 0.0)).alias(f"k{i}{j}") for i, j in _pairs()])


def first_estimates(rows: DataFrame) -> DataFrame:
    """(segment, start, m0..., k_ij): centre and scatter of the three starts."""
    wide = quantiles_wide(rows, _X, [0.25, 0.5, 0.75], ["q1", "q2", "q3"], by=SEGMENT)
    noise = list(NOISE.values())
    scale = lambda i: F.greatest((F.col("q3") - F.col("q1")) / 1.349, F.lit(noise[i]))
    of = lambda i, c: F.max(F.when(F.col("column") == _X[i], c))
    centre = wide.groupBy(*SEGMENT).agg(*[of(i, F.col("q2")).alias(f"m{i}") for i in range(N)], *[of(i, scale(i)).alias(f"s{i}") for i in range(N)])
    centre = scratch_table(centre, "mcd-centres")
    z = seg_join(rows, centre, SEGMENT, broadcast_right=seg_bytes(centre, SEGMENT) <= BROADCAST_BYTES)
    z = z.select(*SEGMENT, *[((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i in range(N)])
    norm = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(N)), F.lit(0.0)))
    z = z.withColumn("norm", norm).select(*SEGMENT, *[F.tanh(f"z{i}").alias(f"t{i}") for i in range(N)],
                                          *[F.when(F.col("norm") > 0, F.col(f"z{i}") / F.col("norm")).otherwise(0.0).alias(f"u{i}") for i in range(N)])
    scatter = z.groupBy(*SEGMENT).agg(*[F.covar_pop(f"{c}{i}", f"{c}{j}").alias(f"{c}{i}{j}") for c in "tu" for i, j in _pairs()])
    both = seg_join(centre, scatter, SEGMENT)

    def start(number: int, c: str | None) -> Column:
        def entry(i: int, j: int) -> Column:
            size = F.col(f"s{i}") * F.col(f"s{j}")
            if i == j:
                return size
            if c is None:
                return F.lit(0.0)
            ridge = 1e-3
            return size * F.col(f"{c}{i}{j}") / F.sqrt((F.col(f"{c}{i}{i}") + ridge) * (F.col(f"{c}{j}{j}") + ridge))
        return F.struct(F.lit(number).alias("start"), *[entry(i, j).alias(f"k{i}{j}") for i, j in _pairs()])

    starts = F.explode(F.array(start(0, None), start(1, "t"), start(2, "u"))).alias("s")
    return both.select(*SEGMENT, *[f"m{i}" for i in range(N)], starts).select(*SEGMENT, *[f"m{i}" for i in range(N)], "s.*")


def covariance_determinant(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(segment, m0..., inverse factor, half_log_det): the reweighted estimate of each segment of rows (segment, x0...)."""
    keys = [*SEGMENT, "start"]
    state = scratch_table(inverse_factor(first_estimates(rows), keys), "mcd-start")
    starts = F.explode(F.array(*[F.lit(s) for s in range(3)])).alias("start")
    each = rows.select(*SEGMENT, *_X, starts)
    settled, first = [], True
    small = seg_bytes(state, keys) <= BROADCAST_BYTES
    while True:
        far = distances(each, state, keys, small, centred=True).where("d2 IS NOT NULL")  # settled segments have no estimate in state
        new = inverse_factor(nearest_moments(far, keys, support), keys)
        before = state.select(*keys, F.col("half_log_det").alias("before"))
        falls = F.lit(True) if first else F.col("half_log_det") < F.col("before") - SETTLED
        new = scratch_table(seg_join(new, before, keys).withColumn("falls", falls).drop("before"), "mcd-step")
        settled.append(new.where("NOT falls").drop("falls"))
        state, first = new.where("falls").drop("falls"), False
        if state.isEmpty():
            break
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    best = done.groupBy(*SEGMENT).agg(F.min(F.struct("half_log_det", "start")).alias("best"))
    best = best.select(*SEGMENT, F.col("best.start").alias("start"))
    raw = scratch_table(seg_join(done, best, keys).drop("start"), "mcd-raw")
    share = 0.975
    near = distances(rows, raw, SEGMENT, seg_bytes(raw, SEGMENT) <= BROADCAST_BYTES).where(F.col("d2") <= chi2_quantile(share, N))
    return scratch_table(inverse_factor(moments(near, SEGMENT, consistency(share)), SEGMENT), "mcd")


def quality_verdicts(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), support: float = SUPPORT, cutoff: float = CUTOFF,
                     least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row for each document: ``carry`` (a struct of those columns), the base counts, base_failed, d2 (squared
    distance; null without a verdict) and kept."""
    told = text_statistics(docs.select(F.struct(*carry).alias("carry"), "lang", "source", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words").cast("long") > 50 * F.col("n_words").cast("long"))
    told = told.select("*", failed.alias("base_failed"))
    vector = [e.cast("double").alias(f"x{i}") for i, e in enumerate(statistic_vector().values())]
    told = scratch_table(told.select("*", *vector), "mcd-statistics")
    rows = with_segments(told.where("NOT base_failed").select("carry", "lang", "source", *_COUNTS, "base_failed", *_X), least_rows)
    judged = rows.where("seg_level < 3").select(*SEGMENT, *_X)
    estimate = covariance_determinant(judged, support)
    far = distances(rows, estimate, SEGMENT, seg_bytes(estimate, SEGMENT) <= BROADCAST_BYTES)
    limit = chi2_quantile(1 - cutoff, N)
    out = far.select("carry", *_COUNTS, "base_failed", "d2", (F.col("d2").isNull() | (F.col("d2") <= limit)).alias("kept"))
    return out.unionByName(told.where("base_failed").select("carry", *_COUNTS, "base_failed", F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept")))


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
