"""Packing of token pieces into sequences: a configuration linear program, rounded, finished by best fit.

Pieces.  A document is its token ids and an end id; only what is longer than ``capacity`` is cut.

Program.  All that packing needs is the histogram of piece lengths, at most ``capacity`` numbers, which is all
that comes to the driver.  A configuration is a multiset of lengths with sum at most ``capacity``; the program
minimises the number of configurations so that every length is covered as often as it occurs.  Multiplicative
weights solve it: the price of a length is its share of the capacity times a weight that falls as the length
gets covered, a knapsack dynamic program over the capacity finds the configuration of greatest price, and that
configuration is taken as far as its scarcest length allows, ``rounds`` times.

Rounding.  The solution, scaled so that no length is covered more often than it occurs, is rounded down to whole
sequences; the lengths left over are packed by best fit, longest first, into those sequences with room left and
new ones.  All sequences of equal content are one entry with a count, so this too depends on the number of
different lengths and not on the number of documents.

Assignment.  Pieces of one length are exchangeable: each gets its rank among them (rows are numbered within
``SALT`` buckets of a length and the buckets' counts are summed up, so a length that a third of all pieces
have is never in one task), and the rank picks a place among the places for that length, by binary search in
the table of entries.

Defined cases: null text is empty; an empty text is one piece with the end id alone; equal rows and equal or
null doc_ids are packed as separate documents; an empty table gives no rows; other columns are ignored; long
texts are tokenised whole.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscope.llm.common import scratch_table
from tabscope.llm.tokens import tokenizer

CAPACITY = 4096
END_ID = 1
ROUNDS = 60
COLUMNS = 64
LEAST_FILL = 0.999
SALT = 1024


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32[, ids]) of every document, written once; ``row`` numbers
    the pieces, ids are little-endian uint32 bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        ids_of = tokenizer(tokenizer_path).ids
        for batch in batches:
            source, columns = [], [[] for _ in range(5)]
            for i, text in enumerate(batch.column(1)):
                ids = ids_of(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    source.append(i)
                    for c, v in zip(columns, (piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None)):
                        c.append(v)
            names = ["piece", "start", "length", "ids_crc32", "ids"]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            made = [pa.array(c, k) for c, k in zip(columns, kinds)][:5 if keep_ids else 4]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int32())), *made], names=["doc_id", *names[:len(made)]])

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    return scratch_table(docs.select("doc_id", "text").mapInArrow(cut, schema).withColumn("row", F.monotonically_increasing_id()), "packing-pieces")


@dataclass
class Entry:
    """``count`` sequences that each hold the same multiset of lengths."""

    count: int
    lengths: dict[int, int]

    def room(self, capacity: int) -> int:
        return capacity - sum(s * a for s, a in self.lengths.items())


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack over all capacities: the index of the last size taken at each capacity, -1 where one
    unit stays empty.  sizes descend, so that of equally good choices the longest is taken."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    first = np.searchsorted(-sizes, -np.arange(capacity + 1))  # index of the largest size that fits
    for c in range(int(sizes[-1]), capacity + 1):
        k = first[c]
        total = value[c - sizes[k:]] + prices[k:]
        best = int(total.argmax())
        if total[best] > value[c - 1]:
            value[c], choice[c] = total[best], k + best
        else:
            value[c] = value[c - 1]
    return choice


def configuration(sizes: np.ndarray, choice: np.ndarray, start: int, capacity: int) -> dict[int, int]:
    """The best configuration that holds length ``start``, read from the knapsack's choices."""
    out, c = defaultdict(int, {start: 1}), capacity - start
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            s = int(sizes[choice[c]])
            out[s] += 1
            c -= s
    return dict(out)


def fullest(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """For every room up to the capacity, the most of it that any multiset of the sizes fills."""
    sums, every = 1, (1 << capacity + 1) - 1
    for s in sizes.tolist():
        step = s
        while step <= capacity:
            sums |= sums << step & every
            step *= 2
    reached = np.unpackbits(np.frombuffer(sums.to_bytes(capacity // 8 + 1, "little"), np.uint8), bitorder="little")[:capacity + 1]
    return np.maximum.accumulate(np.where(reached, np.arange(capacity + 1), 0))


def fractional_solution(histogram: dict[int, int], capacity: int, rounds: int, columns: int = COLUMNS,
                        least_fill: float = LEAST_FILL) -> list[tuple[float, dict[int, int]]]:
    """Multiplicative weights; returns (how often, configuration), no length covered more often than it occurs.

    Each round prices once and takes one configuration for each of the ``columns`` least covered lengths, of those
    filled to ``least_fill`` or more of what the open lengths can fill beside that length; if there is none, the
    least covered lengths get their configurations of greatest price."""
    sizes = np.array(sorted(histogram, reverse=True), np.int64)
    need = np.array([histogram[s] for s in sizes.tolist()], float)
    place = {s: i for i, s in enumerate(sizes.tolist())}
    covered, out = np.zeros(len(sizes)), []
    for _ in range(rounds):
        open_ = np.flatnonzero(covered < 1 - 1e-9)
        if not len(open_):
            break
        choice = knapsack(sizes[open_], sizes[open_] / capacity * np.exp(-4.0 * covered[open_]), capacity)
        filled = np.zeros(capacity + 1, np.int64)
        for c in range(1, capacity + 1):
            filled[c] = filled[c - 1] if choice[c] < 0 else filled[c - sizes[open_[choice[c]]]] + sizes[open_[choice[c]]]
        tried = open_[np.argsort(covered[open_], kind="stable")]
        beside = capacity - sizes[tried]
        well = sizes[tried] + filled[beside] >= least_fill * (sizes[tried] + fullest(sizes[open_], capacity)[beside])
        taken = 0
        for i in (tried[well] if well.any() else tried).tolist():
            used = configuration(sizes[open_], choice, int(sizes[i]), capacity)
            often = min((1 - covered[place[s]]) * need[place[s]] / a for s, a in used.items())
            if often * max(a / need[place[s]] for s, a in used.items()) > 1e-9:
                for s, a in used.items():
                    covered[place[s]] += a * often / need[place[s]]
                out.append((often, used))
                taken += 1
                if taken == columns:
                    break
    return out


def best_fit(histogram: dict[int, int], opened: list[Entry], capacity: int) -> list[Entry]:
    """Longest first, each into the fullest sequence with room.  Equal sequences move together."""
    by_room: dict[int, list[Entry]] = defaultdict(list)
    done: list[Entry] = []
    filled = np.zeros(capacity + 1, bool)

    def put(entry: Entry) -> None:
        room = entry.room(capacity)
        if room:
            by_room[room].append(entry)
            filled[room] = True
        else:
            done.append(entry)

    for e in opened:
        put(e)
    for s in sorted(histogram, reverse=True):
        left = histogram[s]
        while left:
            room = s + int(filled[s:].argmax()) if s <= capacity else 0
            if not filled[room]:
                break
            entry = by_room[room].pop()
            if not by_room[room]:
                filled[room] = False
            fit = room // s
            full = min(entry.count, left // fit)
            rest = entry.count - full
            if full:
                put(Entry(full, entry.lengths | {s: entry.lengths.get(s, 0) + fit}))
                left -= full * fit
            if rest and left:  # fewer than ``fit`` are left for one more
                put(Entry(1, entry.lengths | {s: entry.lengths.get(s, 0) + left}))
                rest, left = rest - 1, 0
            if rest:
                put(Entry(rest, entry.lengths))
        fit = capacity // s
        if left >= fit:
            put(Entry(left // fit, {s: fit}))
        if left % fit:
            put(Entry(1, {s: left % fit}))
    return done + [e for room in by_room.values() for e in room]


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[Entry]:
    """Entries whose lengths add up to exactly the histogram: the program's, or best fit alone if that takes fewer
    sequences."""
    left = dict(histogram)
    entries = [Entry(left.pop(capacity), {capacity: 1})] if left.get(capacity) else []
    if not left:
        return entries
    alone = best_fit(left, [], capacity)
    merged: dict[tuple, float] = defaultdict(float)
    for often, used in fractional_solution(left, capacity, rounds):
        merged[tuple(sorted(used.items()))] += often
    whole = []
    for used, often in merged.items():
        count = min([int(often + 1e-9), *(left[s] // a for s, a in used)])
        if count:
            whole.append(Entry(count, dict(used)))
            for s, a in used:
                left[s] -= a * count
    program = best_fit({s: n for s, n in left.items() if n}, whole, capacity)
    return entries + min(program, alone, key=lambda plan: sum(e.count for e in plan))


def place_table(entries: list[Entry]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, copies in a sequence, offset of the first copy), by rank."""
    table, ranks, base = defaultdict(list), defaultdict(int), 0
    for e in entries:
        offset = 0
        for s, a in e.lengths.items():
            table[s].append((ranks[s], base, a, offset))
            ranks[s] += a * e.count
            offset += a * s
        base += e.count
    return {s: np.array(rows, np.int64) for s, rows in table.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """pieces: (row, length, ...).  Adds sequence_id and offset."""
    bucket = F.pmod(F.xxhash64("row"), F.lit(SALT))
    salted = pieces.withColumn("__bucket", bucket)
    counts = scratch_table(salted.groupBy("length", "__bucket").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = pieces.sparkSession.sparkContext.broadcast(place_table(plan_sequences(histogram, capacity, rounds)))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch_table(counts.select("length", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")), "packing-offsets")
    within = Window.partitionBy("length", "__bucket").orderBy("row")
    ranked = (salted.withColumn("__rank", F.row_number().over(within).cast("bigint") - 1).join(offsets, ["length", "__bucket"])
              .withColumn("__rank", F.col("__rank") + F.col("__before")))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        bounds = np.flatnonzero(np.diff(length[order], prepend=-1))
        for rows in np.split(order, bounds[1:]) if len(order) else []:
            s = int(length[rows[0]])
            table = places.value[s]
            at = table[np.searchsorted(table[:, 0], rank[rows], side="right") - 1]
            copy, which = np.divmod(rank[rows] - at[:, 0], at[:, 2])
            sequence[rows], offset[rows] = at[:, 1] + copy, at[:, 3] + which * s
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    out = ranked.withColumn("__place", place("length", "__rank"))
    return out.select(*pieces.columns, "__place.sequence_id", "__place.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id, keep_ids), capacity).drop("row")


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces packed with ``keep_ids``: sequence_id, n_tokens, ids (array of int)."""
    joined = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    @F.arrow_udf("array<int>")
    def ids(parts: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b"".join(p["ids"] for p in row), "<u4").astype(np.int32) for row in parts.to_pylist()], pa.list_(pa.int32()))

    out = joined.select("sequence_id", ids("parts").alias("ids"))
    return out.select("sequence_id", F.size("ids").alias("n_tokens"), "ids")
