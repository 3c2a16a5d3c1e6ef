"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import scratch_table


def _star(pairs: DataFrame, keep_larger: bool, name: str) -> DataFrame:
    """One star step.  pairs: (u, v), each row saying that v is a neighbour of u.

    Every u takes m, the least of itself and its neighbours, by a group-by with map-side combining; a join
    brings m back to the neighbours, so that a node with a third of all edges is never gathered anywhere
    (adaptive execution splits its join partition)."""
    least = scratch_table(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"{name}-least")
    joined = pairs.join(least, "u")
    if keep_larger:
        out = joined.where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    else:
        out = joined.select(F.col("v").alias("src"), F.col("m").alias("dst")).unionByName(
            least.select(F.col("u").alias("src"), F.col("m").alias("dst")))
    return out.where("src <> dst").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (src, dst) of one orderable type without nulls.  Returns (node, label), label being the least
    node of the component, for every node that stands in an edge between two different nodes.

    The number of rounds is logarithmic in the longest path in practice; each round writes its edges to the
    checkpoint folder, so lineage stays one round deep.  Nothing but a truth value comes to the driver."""
    e = scratch_table(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
                      .distinct(), "cc-edges")
    while True:
        touched = e.select(F.col("src").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
            e.select(F.col("dst").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        unsettled = touched.groupBy("node").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or (c = 1 and p = 1)")
        if unsettled.isEmpty():
            break
        both = e.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(
            e.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        large = scratch_table(_star(both, True, "cc-large"), "cc-large")
        e = scratch_table(_star(large.select(F.col("src").alias("u"), F.col("dst").alias("v")), False, "cc-small"), "cc-edges")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("label")).unionByName(
        e.select(F.col("dst").alias("node"), F.col("dst").alias("label")).distinct())
