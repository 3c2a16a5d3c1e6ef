"""Chat formatting after collapsing cumulative snapshots of conversations; DataFrame functions only.

A service that logs a conversation after every turn leaves many logs that are prefixes of longer ones.  Turns are
put in order of (turn, role, text); the prefix hash of a log after its n-th turn is the exclusive-or of two 64-bit
hashes of (place, role, text) over the first n turns, so it rolls from turn to turn and can be summed in parts.
A log goes if its last prefix hash, with its length, is a prefix hash inside a longer log (an anti-join of the
distinct whole logs against the distinct inner prefixes); of logs that are equal as a whole the one with the least
conv_id stays.  What is left is rendered in ordered parts.

Sizes.  Equal rows are merged first, with map-side combining, into rows that each stand for up to ``COPIES`` turns.  A
range shuffle on (conv_id, turn, starts of role and text) and a sort within the partitions put them in order, whatever
their turn numbers; that sort spills, so distinct texts of one conv_id and turn that begin alike cost time in one task,
not memory.  The sorted rows are cut into chunks of ``CHUNK`` rows BY COUNT, and places, prefix hashes and rendered
lengths come from two levels of running sums, within a chunk and over the chunks of a log; so a log, or the rows
without conv_id, may hold a third of all rows, all at one turn number.  The second level has one row for each
chunk.  Equal logs and prefixes are counted with map-side combining before they are joined, so a first turn or a whole
conversation that very many logs share is one row there.

Rendered text is cut before the turns at which its length passes a multiple of ``PART_CHARS`` characters, so each row of
the result is gathered from at most that much text and one turn; ordinary logs have the one part 0, and the parts of a
log in order make up its text.

Defined cases: null role and null text count as empty, and a null turn comes first; rows that are wholly equal are
turns of their own; rows with null conv_id form one log; an empty table gives no logs; other columns are ignored; a
single turn has to fit a row of Spark (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscope.llm.common import scratch_table

CHUNK = 512
COPIES = 64
KEY_CHARS = 64
PART_CHARS = 1 << 24
START, END = "<|im_start|>", "<|im_end|>"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def rendered_length(role: Column, text: Column) -> Column:
    return (F.length(role) + F.length(text) + F.lit(len(START) + 1 + len(END) + 1)).cast("bigint")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, id, role, text): chunks of a log ascend in its order, and ids within a chunk."""
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    merged = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    blocks = merged.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))).alias("block"))
    blocks = blocks.withColumn("copies", F.least(F.lit(COPIES), F.col("n") - F.col("block") * COPIES)).drop("n", "block")
    # The bounds' sample goes to the driver, so its keys have a bounded width; they follow the order of whole roles and
    # texts, since the text counts only beside a role that is there in full.
    long_role = F.length("role") > KEY_CHARS
    near = [F.substring("role", 1, KEY_CHARS), long_role, F.when(~long_role, F.substring("text", 1, KEY_CHARS))]
    ordered = blocks.repartitionByRange("conv_id", "turn", *near).sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = scratch_table(ordered.withColumn("id", F.monotonically_increasing_id()), "chat-ordered")
    ordered = ordered.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return ordered.select("conv_id", F.floor(F.col("id") / CHUNK).alias("chunk"), (F.col("id") * COPIES + F.col("copy")).alias("id"), "role", "text")


def _beside(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """Rows with what the earlier chunks of their log add up to."""
    carried = carried.withColumnsRenamed({"conv_id": "c_id", "chunk": "c_chunk"})
    return rows.join(carried, F.col("conv_id").eqNullSafe(F.col("c_id")) & (F.col("chunk") == F.col("c_chunk"))).drop("c_id", "c_chunk")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, h1, h2, part): place counts from 1; h1 and h2 cover the turns up to it."""
    rows = ordered_turns(turns)
    within = Window.partitionBy("conv_id", "chunk").orderBy("id")
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("length", rendered_length(F.col("role"), F.col("text"))).withColumns({
        "in_chunk": F.row_number().over(within), "chars": F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    rows = scratch_table(rows.withColumn("chars", F.col("chars") - F.col("length")), "chat-rows")
    sizes = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), F.sum("length").alias("s"))
    sizes = sizes.select("conv_id", "chunk", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name) for c, name in (("n", "skipped"), ("s", "before"))])
    rows = _beside(rows, scratch_table(sizes, "chat-sizes"))
    rows = rows.withColumns({"place": F.col("skipped") + F.col("in_chunk"), "part": F.floor((F.col("before") + F.col("chars")) / PART_CHARS)})
    rows = rows.withColumns({"t1": F.xxhash64("place", "role", "text"), "t2": F.xxhash64(F.lit("second"), "text", "role", "place")})

    so_far = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "chunk", "place", "part", "role", "text", *[F.bit_xor(f"t{i}").over(so_far).alias(f"r{i}") for i in (1, 2)])
    rows = scratch_table(rows, "chat-rolled")
    whole = rows.groupBy("conv_id", "chunk").agg(F.max_by("r1", "place").alias("w1"), F.max_by("r2", "place").alias("w2"))
    carried = whole.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(f"w{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    rows = _beside(rows, scratch_table(carried, "chat-carried"))
    hashes = [F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)]
    return scratch_table(rows.select("conv_id", "place", "part", "role", "text", *hashes), "chat-prefixes")


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal): the logs that stay, and how many logs equal them (themselves included)."""
    last = prefixes.groupBy("conv_id").agg(F.max("place").alias("n_turns"), F.max_by(F.struct("h1", "h2"), "place").alias("h"))
    last = scratch_table(last.select("conv_id", "n_turns", "h.h1", "h.h2"), "chat-last")
    wholes = scratch_table(last.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal")), "chat-wholes")
    lengths = last.select(F.col("conv_id").alias("l_id"), F.col("n_turns").alias("length"))
    inner = (prefixes.join(lengths, F.col("conv_id").eqNullSafe(F.col("l_id"))).where(F.col("place") < F.col("length"))
             .select(F.col("place").alias("n_turns"), "h1", "h2").distinct())
    return wholes.join(scratch_table(inner, "chat-inner"), ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_equal")


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """turns: (conv_id, turn, role, text).  conv_id, part, n_turns, n_equal, rendered of the maximal logs; n_turns and
    n_equal are the log's."""
    prefixes = prefix_hashes(turns)
    kept = scratch_table(maximal(prefixes), "chat-kept").withColumnRenamed("conv_id", "k_id")
    rows = prefixes.join(kept, F.col("conv_id").eqNullSafe(F.col("k_id")))
    parts = F.sort_array(F.collect_list(F.struct("place", rendered(F.col("role"), F.col("text")).alias("t"))))
    texts = rows.groupBy("conv_id", "part", "n_turns", "n_equal").agg(parts.alias("turns"))
    return texts.select("conv_id", "part", "n_turns", "n_equal", F.array_join(F.transform("turns", lambda p: p["t"]), "").alias("rendered"))
