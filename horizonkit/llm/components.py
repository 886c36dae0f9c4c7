"""Connected components by alternating large-star and small-star rounds.

Each round joins an edge with the smallest neighbour of one end. Edges stay in
Spark; a round is written to the shared folder, so a lost executor repeats at
most one round. The minima are pre-aggregated before their shuffle, and the
joins can be split at a hub by adaptive execution. They are merge joins: a
round's files repeat few nodes, so their size says little of the rows that a
broadcast would bring to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonkit.session import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour of ``u`` (larger ones, or smaller ones) to the smallest of them all."""
    near = edges.union(edges.select(F.col("v"), F.col("u"))) if large else edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    both = near.hint("merge").join(least, near.u == least.k)
    if large:
        out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _mark(edges: DataFrame):
    """Count and content of an edge table, to see that nothing moved; no number of edges overflows it."""
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` long pairs -> ``(node, root)``: root is the smallest node reachable.

    Only nodes of an edge to another node appear. Null ends and loops are
    ignored; an empty table gives an empty table.
    """
    edges = written(edges.select(F.col("u").cast("long"), F.col("v").cast("long"))
                    .where("u <> v").distinct(), "edges")
    seen = None
    while (mark := tuple(_mark(edges))) != seen:
        seen = mark
        edges = written(_star(_star(edges, large=True), large=False), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v"), F.col("v")).distinct())
