"""Connected components of an edge table by alternating stars.

Each round hangs the larger neighbours of a node onto its smallest neighbour, then the smaller ones.  Neighbours are never collected: the
minimum is an aggregate with map-side combine, joined back, so a node with a third of all edges splits like any skewed join.  Every round
is written to the shared folder; the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeframe.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node it is connected with."""
    links = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = _mark(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # larger neighbours hang onto the smallest one
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # then smaller neighbours, and the node itself
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        links = stored(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        before, state = state, _mark(links)
        if state == before:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(links: DataFrame) -> tuple:
    """Count and an order-free checksum; equal marks mean that a round changed nothing."""
    r = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "u", "v"))).first()
    return tuple(r)
