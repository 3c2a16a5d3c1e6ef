"""Forests and boosted trees of tables beyond a fit's small ones, grown from sums over cells of equal bins (MOD1, EXP2).

MLlib cuts each feature into at most ``maxBins`` bins and from then on knows a row by its bins alone: rows of equal bins (a
cell) go the same way in every tree.  What a tree is grown from are sums of weights and targets, so it is enough to know
them by cell.  One scan of all rows draws every row's bootstrap weight for every tree and adds them up; trees grow from
those sums, and the errors on the rows held out follow from the cells' counts, sums and sums of squares.  MLlib instead
reads all rows again for each level of each fit.

The method and its parameters are MLlib's (tested against it where no chance is involved): bins from the values of about
10,000 training rows, variance as impurity, Poisson weights with and Bernoulli weights without replacement, features
drawn at each node, boosting on twice the residuals with a first tree of weight 1.  The fits of a cross-validation share
the scan and nothing else: each has bins from its own training rows, and its own weights.

``fit_scores`` returns None where this does not apply, and the caller fits over the rows: weights, validation columns,
losses other than squares, 62 features or more, more cells than a task should hold, or a fit without training rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums that a task holds (cells of all fits, times trees), numbers in a level's histograms, and rows that are added up at once.
MOST_SUMS, MOST_BINS, CHUNK = 1 << 22, 1 << 20, 1 << 17
#: Rows whose values decide the bins (the square of the bins if that is more), as in MLlib.
BIN_ROWS = 10_000
#: Codes of cells are bigints.
CODE_SPACE = 1 << 62
_HELD, _TOO_MANY = -1, -2


@dataclass(frozen=True)
class Settings:
    """Parameters of an MLlib estimator; ``step`` is None for a forest."""
    n_trees: int
    depth: int
    bins: int
    subset: str
    replace: bool
    rate: float
    seed: int
    min_rows: int
    min_share: float
    min_gain: float
    step: float | None

    @staticmethod
    def of(est) -> Settings | None:
        get = est.getOrDefault
        forest = est.hasParam("numTrees")
        if est.isSet("weightCol") or not forest and (est.isSet("validationIndicatorCol") or get("lossType") != "squared"):
            return None
        return Settings(get("numTrees" if forest else "maxIter"), get("maxDepth"), get("maxBins"), get("featureSubsetStrategy").lower(),
                        forest and get("bootstrap"), get("subsamplingRate"), get("seed") % (1 << 63), get("minInstancesPerNode"),
                        get("minWeightFractionPerNode"), get("minInfoGain"), None if forest else get("stepSize"))

    def features_a_node(self, p: int) -> int:
        how = self.subset
        if how == "auto":
            how = "all" if self.n_trees == 1 or self.step is not None else "onethird"
        named = {"all": p, "sqrt": int(np.ceil(np.sqrt(p))), "log2": max(1, int(np.ceil(np.log2(p)))), "onethird": -(-p // 3)}
        if how in named:
            return named[how]
        return min(int(how), p) if how.isdigit() else int(np.ceil(float(how) * p))


def thresholds(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds between the distinct values: all, or those nearest to equal shares of the values."""
    v, c = np.unique(values, return_counts=True)
    if len(v) - 1 <= most:
        return (v[1:] + v[:-1]) / 2
    stride = len(values) / (most + 1)
    cuts, count, target = [], c[0], stride
    for i in range(1, len(v)):
        before, count = count, count + c[i]
        if abs(before - target) < abs(count - target):
            cuts.append((v[i - 1] + v[i]) / 2)
            target += stride
    return np.array(cuts)


def codes_of(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The cell of each row: its bins (thresholds below the value) as digits of one number."""
    code = np.zeros(len(columns[0]), np.int64)
    for x, c in zip(columns, cuts):
        code = code * (len(c) + 1) + np.searchsorted(c, x)
    return code


def bins_of(codes: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The bins of each cell, a column a feature."""
    out = np.empty((len(codes), len(cuts)), np.int64)
    for j in reversed(range(len(cuts))):
        codes, out[:, j] = np.divmod(codes, len(cuts[j]) + 1)
    return out


def grow(bins: np.ndarray, n_bins: Sequence[int], w: np.ndarray, s: np.ndarray, st: Settings, min_weight: float, rng) -> np.ndarray:
    """One regression tree, level by level, from each cell's weight and sum: its prediction for every cell."""
    p, total = len(n_bins), w.sum()
    per_node = st.features_a_node(p)
    pred, node = np.full(len(w), s.sum() / total if total else 0.0), np.zeros(len(w), np.int64)
    for _ in range(st.depth):
        live = np.flatnonzero(node >= 0)
        if not len(live):
            break
        nd, lw_, ls_ = node[live], w[live], s[live]
        m = int(nd.max()) + 1
        W, S = np.bincount(nd, lw_, m), np.bincount(nd, ls_, m)
        best, feature, cut = np.zeros(m), np.full(m, -1), np.zeros(m, np.int64)
        drawn = rng.random((m, p)).argsort(1).argsort(1) < per_node if per_node < p else np.ones((m, p), bool)
        for f, b in enumerate(n_bins):
            if b < 2:
                continue
            key = nd * b + bins[live, f]
            lw = np.bincount(key, lw_, m * b).reshape(m, b).cumsum(1)[:, :-1]
            ls = np.bincount(key, ls_, m * b).reshape(m, b).cumsum(1)[:, :-1]
            rw, rs = W[:, None] - lw, S[:, None] - ls
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = ls * ls / lw + rs * rs / rw - (S * S / W)[:, None]  # the loss of squared error
            least = max(st.min_rows, min_weight)
            gain[(np.minimum(lw, rw) < least) | ~drawn[:, f, None]] = -np.inf
            i = gain.argmax(1)
            g = gain[np.arange(m), i]
            better = (g > best) & (g >= st.min_gain * W)
            best[better], feature[better], cut[better] = g[better], f, i[better]
        goes = feature[nd] >= 0
        node[live[~goes]] = -1
        live, nd = live[goes], nd[goes]
        if not len(live):
            break
        child = 2 * nd + (bins[live, feature[nd]] > cut[nd])
        _, child = np.unique(child, return_inverse=True)
        node[live] = child
        pred[live] = (np.bincount(child, s[live]) / np.bincount(child, w[live]))[child]
    return pred


def _chunks(batches: Iterator) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        n += b.num_rows
        if n >= CHUNK:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


class _Sums:
    """A task's sums of a fit by cell: ``held`` counts, sums and squares of the rows held out, ``w`` and ``s`` of each tree's draw."""

    def __init__(self, n_trees: int):
        self.codes, self.slots, self.n = np.empty(0, np.int64), np.empty(0, np.int64), 0
        self.held, self.w, self.s = np.zeros((3, 256)), np.zeros((n_trees, 256)), np.zeros((n_trees, 256))

    def slots_of(self, codes: np.ndarray, most: int) -> np.ndarray | None:
        """Place of each cell's sums; None if there were more than ``most`` cells."""
        if self.n:
            at = np.minimum(np.searchsorted(self.codes, codes), self.n - 1)
            new = np.unique(codes[self.codes[at] != codes])
            if not len(new):
                return self.slots[at]
        else:
            new = np.unique(codes)
        if self.n + len(new) > most:
            return None
        codes_now = np.concatenate([self.codes, new])
        slots_now = np.concatenate([self.slots, np.arange(self.n, len(codes_now))])
        order = np.argsort(codes_now)
        self.codes, self.slots, self.n = codes_now[order], slots_now[order], len(order)
        if self.n > self.held.shape[1]:
            wider = ((0, 0), (0, 2 * self.n - self.held.shape[1]))
            self.held, self.w, self.s = np.pad(self.held, wider), np.pad(self.w, wider), np.pad(self.s, wider)
        return self.slots[np.searchsorted(self.codes, codes)]

    def add(self, at: np.ndarray, y: np.ndarray, train: np.ndarray, st: Settings, rng) -> None:
        """Rows at the places ``at``: those of ``train`` are drawn for each tree, the others are held out."""
        size = self.held.shape[1]
        for i, x in enumerate((None, y[~train], y[~train] ** 2)):
            self.held[i] += np.bincount(at[~train], x, size)
        at, y = at[train], y[train]
        m = len(y)
        n_all, s_all = np.bincount(at, None, size), np.bincount(at, y, size)
        for t in range(st.n_trees if m else 0):
            if st.replace:  # so many rows, each any of them: every row's count is a Poisson variable of its own
                i = rng.integers(0, m, rng.poisson(st.rate * m), dtype=np.int32)
                self.w[t] += np.bincount(at[i], None, size)
                self.s[t] += np.bincount(at[i], y[i], size)
            elif st.rate < 1:
                i = np.flatnonzero(rng.random(m) >= st.rate)
                self.w[t] += n_all - np.bincount(at[i], None, size)
                self.s[t] += s_all - np.bincount(at[i], y[i], size)
            else:
                self.w[t] += n_all
                self.s[t] += s_all


def _summed(batches: Iterator, cuts: list[list[np.ndarray]], fits: list[tuple[int, list[int]]], shift: float, st: Settings, most: int) -> Iterator:
    """(fit, tree, code, n, s, ss) of a task's rows, given as part, features and target; ``fits``: parts held out and fitted."""
    import pyarrow as pa
    from pyspark import TaskContext

    rng, sums, batches = np.random.default_rng([st.seed, TaskContext.get().partitionId()]), [_Sums(st.n_trees) for _ in fits], iter(batches)

    def told(fit, tree, codes, n, s, ss):
        columns = zip((np.full(len(codes), fit), np.full(len(codes), tree), codes, n, s, ss), ("int32", "int32", "int64", *["float64"] * 3))
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, kind)) for x, kind in columns], names=["fit", "tree", "code", "n", "s", "ss"])

    for part, *xs, y in _chunks(batches):
        for f, (out, fitted) in enumerate(fits):
            train = np.isin(part, fitted)
            rows = np.flatnonzero(train | (part == out))
            at = sums[f].slots_of(codes_of([x[rows] for x in xs], cuts[f]), most)
            if at is None:
                yield told(f, _TOO_MANY, [0], [0], [0], [0])
                for _ in batches:  # the rest is read over, so that the task ends as any other
                    pass
                return
            sums[f].add(at, y[rows] - shift, train[rows], st, rng)
    for f, x in enumerate(sums):
        yield told(f, _HELD, x.codes, *x.held[:, x.slots])
        for t in range(st.n_trees):
            some = x.w[t, x.slots] > 0
            at = x.slots[some]
            yield told(f, t, x.codes[some], x.w[t, at], x.s[t, at], np.zeros(len(at)))


def _r2(n: float, s: float, ss: float, sse: float) -> float:
    """1 - SSE / SST; what is left of the sums of squares by rounding is no variance."""
    sst, sse = ss - s * s / n, max(sse, 0.0)
    if sst <= 1e-13 * ss:
        return 1.0 if sse == 0 else 0.0
    return 1.0 - sse / sst


def fit_scores(est, rows: DataFrame, features: Sequence[str], target: str, k: int = 0) -> list[tuple[float | None, float | None]] | None:
    """(R^2, RMSE) on the test rows (``__test``) of the fit of all others and, with ``k``, on each fold (``__fold``) of the fit
    of the other folds; None for a table or estimator that is not fitted this way."""
    st, features = Settings.of(est), list(features)
    if st is None or not 0 < len(features) < 62 or (k + 1) * max(st.bins ** 2, BIN_ROWS) * (len(features) + 1) > MOST_SUMS:
        return None
    train_part = F.coalesce(F.col("__fold") + 1, F.lit(k + 1)) if k else F.lit(1)  # a row without fold is in no fold's fit
    part = F.when(F.col("__test"), F.lit(0)).when(~F.col("__test"), train_part)
    data = rows.select(part.cast("int").alias("__part"), *[F.col(f"`{c}`") for c in features], F.col(f"`{target}`"))
    data = data.where(F.col("__part").isNotNull())
    fits = [(0, [*range(1, k + 2)]), *((f, [g for g in range(1, k + 1) if g != f]) for f in range(1, k + 1))]
    sizes = {r["__part"]: r["count"] for r in data.groupBy("__part").count().collect()}  # one row a part
    n_train = [sum(sizes.get(g, 0) for g in fitted) for _, fitted in fits]
    if not all(n_train):
        return None

    # Each fit's bins are from about 10,000 of its training rows, as in MLlib; all fits' are taken in one scan.
    share = [max(st.bins ** 2, BIN_ROWS) / n for n in n_train]
    taken = [F.col("__part").isin(fitted) & (F.rand((st.seed + f) % (1 << 63)) < share[f]) for f, (_, fitted) in enumerate(fits)]
    seen = data.select("*", *[x.alias(f"__in{f}") for f, x in enumerate(taken)]).where(" or ".join(f"__in{f}" for f in range(len(fits)))).toArrow()
    own = [seen.column(f"__in{f}").to_numpy() for f in range(len(fits))]
    if not all(x.any() for x in own):
        return None
    values = [c.to_numpy() for c in seen.columns[1:len(features) + 2]]
    cuts = [[thresholds(x[own[f]], min(st.bins, n_train[f]) - 1) for x in values[:-1]] for f in range(len(fits))]
    n_bins = [[len(c) + 1 for c in x] for x in cuts]
    if max(np.prod([float(b) for b in x]) for x in n_bins) >= CODE_SPACE:
        return None
    shift, most = float(np.median(values[-1])), min(MOST_SUMS // (st.n_trees * len(fits)), MOST_BINS // max(map(max, n_bins)))
    summed = data.mapInArrow(lambda b: _summed(b, cuts, fits, shift, st, most), "fit int, tree int, code long, n double, s double, ss double")
    sums = summed.groupBy("fit", "tree", "code").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).checkpoint(eager=True)

    held = sums.where(F.col("tree") == _HELD)
    if not sums.where(F.col("tree") == _TOO_MANY).isEmpty() or held.groupBy("fit").count().where(F.col("count") > most).count():
        return None
    found = held.select("fit", "code").toArrow()  # at most ``most`` cells a fit
    codes = [np.sort(found["code"].to_numpy()[found["fit"].to_numpy() == f]) for f in range(len(fits))]
    bins = [bins_of(*x) for x in zip(codes, cuts)]

    def grown(f: int, t: int, pdf: pd.DataFrame, less: np.ndarray | float) -> np.ndarray:
        w, s = np.zeros(len(codes[f])), np.zeros(len(codes[f]))
        at = np.searchsorted(codes[f], pdf["code"].to_numpy())
        w[at], s[at] = pdf["n"].to_numpy(), pdf["s"].to_numpy()
        s = 2 * (s - w * less) if st.step is not None and t else s  # MLlib fits twice the residuals
        return grow(bins[f], n_bins[f], w, s, st, st.min_share * n_train[f], np.random.default_rng([st.seed, t, f]))

    def told(f: int, pred: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"fit": np.full(len(pred), f), "code": codes[f], "p": pred})

    def tree(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return told(int(key[0]), grown(int(key[0]), int(key[1]), pdf, 0.0))

    def boosted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f, rounds, pred = int(key[0]), dict([*pdf.groupby("tree")]), 0.0
        for t in range(st.n_trees):
            pred = pred + (st.step if t else 1.0) * grown(f, t, rounds.get(t, pdf[:0]), pred)
        return told(f, pred)

    drawn, schema = sums.where(F.col("tree") >= 0).drop("ss"), "fit int, code long, p double"
    if st.step is None:
        tasks = min(st.n_trees * len(fits), rows.sparkSession.sparkContext.defaultParallelism)
        pred = drawn.repartition(tasks, "fit", "tree").groupBy("fit", "tree").applyInPandas(tree, schema)
    else:  # a round needs the one before: a task holds the sums of a fit's cells, and no rows
        pred = drawn.groupBy("fit").applyInPandas(boosted, schema)
    pred = pred.groupBy("fit", "code").agg(F.avg("p").alias("p"))
    sse = F.sum(F.col("ss") - 2 * F.col("p") * F.col("s") + F.col("p") * F.col("p") * F.col("n"))
    tried = held.where(F.col("n") > 0).join(pred, ["fit", "code"]).groupBy("fit").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), sse.alias("sse")).collect()  # one row a fit
    scores = {r["fit"]: (_r2(r["n"], r["s"], r["ss"], r["sse"]), (max(r["sse"], 0.0) / r["n"]) ** 0.5) for r in tried}
    return [scores.get(f, (None, None)) for f in range(len(fits))]
