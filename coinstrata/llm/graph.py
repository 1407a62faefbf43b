"""Connected components of a graph kept as a table of edges.

Large-star and small-star steps in turn (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014):
each step is a grouped minimum and a join, and the number of rounds grows with the logarithm of the graph's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, if_any, join_spread, saved

#: Neighbours from which a node counts as a hub, whose edges are dealt to many tasks.
HUB = 1000


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Link each neighbour b of a to the least node among a and its neighbours."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    linked = join_spread(pairs, least.select("a", "m"), "a", if_any(least.filter(F.col("n") > HUB).select("a")), F.col("b"))
    if larger_only:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, comp (the least node it is connected with) for each node of ``edges`` (a, b); loops are ignored."""
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    with Scratch(edges.sparkSession, "components") as kept:
        now = kept.save(both, "edges")
        before = None
        for _ in range(most_rounds):
            state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
            if state == before or not state[0]:
                break
            before = state
            large = kept.save(_star(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), True), "large")
            now = kept.save(_star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False), "edges")
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        tops = now.select(F.col("b").alias("node")).distinct()
        return saved(now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(tops.select("node", F.col("node").alias("comp"))), "components")
