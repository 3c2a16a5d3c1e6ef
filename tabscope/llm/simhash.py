"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprints.  A text's words are its runs of characters other than ASCII white space, A-Z lowered; its shingles
are ``shingle`` words joined by blanks, repeats included (a shorter text is one shingle, a text without words
has fingerprint zero).  Bit b of the fingerprint is set if it is set in over half of the shingles' XXH64.

Linking.  Each bit position i gets a non-zero vector m(i) of radius+1 bits, and each non-zero vector v of
radius+1 bits gives a mask of the positions with odd <m(i), v>.  At most ``radius`` differing positions leave a
non-zero v orthogonal to all of their vectors, so two fingerprints within the radius agree under some mask:
every such pair meets in one of 2^(radius+1)-1 tables.  Only fingerprints that meet another in a table go on.

Inside the tables no pairs are listed.  Two fingerprints differ in at most ``radius`` bits exactly if some
value z lies within floor(radius/2) of one and ceil(radius/2) of the other, so each colliding fingerprint emits
the values in its ball, flipping only positions that a mask under which it collided leaves open.  What meets at
one z is at most one ball of distinct fingerprints, a fixed number, and gets linked to the least of them; bit
distances are checked again.  The number of rows is linear in the number of distinct fingerprints, however
large a group of copies or near copies is.

Defined cases: null text counts as empty; equal rows and equal doc_ids each keep their row; null doc_id takes
part and never names a component unless all ids of it are null; an empty table gives an empty result; other
columns are ignored.  Long texts are read whole, in chunks of shingles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import scratch_table
from tabscope.llm.components import connected_components

BITS = 64
CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint as an unsigned integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest, join, n = xxhash.xxh64_digest, b" ".join, max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at:at + CHUNK + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle))) if len(part) >= shingle else [part]
        raw = np.frombuffer(b"".join([digest(join(g), 42) for g in grams]), np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """Signed 64-bit fingerprint of a string column."""

    @F.arrow_udf("bigint")
    def fold(col: pa.Array) -> pa.Array:
        values = np.array([fingerprint(t, shingle) for t in col.cast(pa.binary()).to_pylist()], np.uint64)
        return pa.array(values.view(np.int64))

    return fold(text)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """One mask for each non-zero vector of radius+1 bits; vectors are dealt to positions in turn."""
    top = 1 << (radius + 1)
    vector = [1 + i % (top - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if bin(vector[i] & v).count("1") % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_edges(fps: DataFrame, radius: int = 2) -> DataFrame:
    """fps: distinct (fp).  Returns (src, dst) star edges whose components are those of the graph that links
    fingerprints within ``radius`` bits."""
    masks = covering_masks(radius)
    fp = F.col("fp")
    members = fps.select(fp, F.posexplode(F.array(*[fp.bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("tbl", "bucket"))
    shared = scratch_table(members.groupBy("tbl", "bucket").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
                           .where("lo <> hi").select("tbl", "bucket"), "simhash-buckets")
    open_bits = F.array(*[F.lit(_signed(~m & (1 << 64) - 1)) for m in masks])
    colliding = scratch_table(
        members.join(shared, ["tbl", "bucket"]).groupBy("fp")
        .agg(F.bit_or(F.element_at(open_bits, F.col("tbl") + 1)).alias("open")), "simhash-colliding")
    near, far = radius // 2, (radius + 1) // 2
    flips = [(sum(1 << i for i in c), size <= near) for size in range(far + 1) for c in combinations(range(BITS), size)]
    table = F.array(*[F.struct(F.lit(_signed(x)).alias("x"), F.lit(inner).alias("inner")) for x, inner in flips])
    balls = (colliding.select("fp", F.explode(F.filter(table, lambda s: s["x"].bitwiseAND(F.bitwise_not(F.col("open"))) == 0)).alias("s"))
             .select("fp", fp.bitwiseXOR(F.col("s.x")).alias("z"), F.col("s.inner").alias("inner")))
    met = balls.groupBy("z").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("dst"), F.collect_set("fp").alias("all"))
    return (met.where("dst is not null and size(all) > 1").select(F.explode("all").alias("src"), "dst")
            .where((F.col("src") != F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius)).distinct())


def simhash_components(ids: DataFrame, radius: int = 2) -> DataFrame:
    """ids: (doc_id, fp, any more).  Adds component_id (least doc_id reachable) and component_key (the least
    fingerprint of the component, never null)."""
    fps = scratch_table(ids.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-fps")
    labels = connected_components(near_edges(fps.select("fp"), radius)).withColumnRenamed("node", "fp")
    of_fp = scratch_table(fps.join(labels, "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("component_key")), "simhash-labels")
    least = scratch_table(of_fp.groupBy("component_key").agg(F.min("first_id").alias("component_id")), "simhash-least")
    named = scratch_table(of_fp.select("fp", "component_key").join(least, "component_key"), "simhash-named")
    return ids.join(named, "fp")


def simhash_near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id, component_key."""
    ids = scratch_table(docs.select("doc_id", fingerprint_column(F.col("text"), shingle).alias("fp")), "simhash-ids")
    return simhash_components(ids, radius).select("doc_id", "fp", "component_id", "component_key")


def keep_one_of_each(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of docs less near-duplicates: of each component, the row with the least doc_id (nulls last; of
    rows that share it, one) stays.  All columns are kept as they are."""
    names = docs.columns
    row, fp = "__row", "__fp"
    held = scratch_table(docs.withColumns({fp: fingerprint_column(F.col("text"), shingle), row: F.monotonically_increasing_id()}), "simhash-docs")
    marked = simhash_components(held.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row")), radius)
    kept = marked.groupBy("component_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    kept = scratch_table(kept.select(F.col("first.row").alias(row)), "simhash-kept")
    # kept grows with the input, so the join is a shuffle at every size
    return held.join(kept.hint("merge"), row, "left_semi").select(*names)
