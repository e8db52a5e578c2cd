"""Connected components over links of any number, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Workspace


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, component) of every node on an edge of `edges` (a, b); component is the smallest node that it reaches.

    Each round hangs every node on its smallest neighbour, first among larger nodes, then
    among smaller ones, until the links are stars. Rounds grow with the logarithm of the
    longest path. Each is cut by a table in the shared folder; the driver sees a count and
    a checksum. No edges: an empty table. Self-links and repeats don't matter.
    """
    links = work.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    before = _state(links)
    while before[0]:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # A table of its own: the join below then has two shuffled sides, and a node with very many links is split.
        low = work.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        made = small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo"))).distinct()
        made = work.cut(made, "edges")
        work.drop(links, low)
        links, after = made, _state(made)
        if after == before:
            break
        before = after
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
