"""Connected components by alternating stars.

Each round ties every larger neighbour of a node to the smallest node next to it, then every smaller one; the number of rounds
grows with the logarithm of a component's size. A node's neighbours are never gathered: rounds are a map-side combined
minimum and a join whose large partitions adaptive execution splits. Rounds end in the shared folder, so a lost executor
costs one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.llm.common import join_counted
from geopanel.session import materialised


def _state(e: DataFrame) -> tuple:
    """One row that tells two edge sets apart."""
    h = F.xxhash64("hi", "lo")
    return tuple(e.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b): root is the smallest node that can be reached. Loops and null ends
    tie nothing; no edges give no rows."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = materialised(e)
    before, now = None, _state(e)
    while now[0] and now != before:
        around = e.select(F.col("hi").alias("lo"), F.col("lo").alias("v")).unionAll(e.select("lo", F.col("hi").alias("v")))
        least = around.groupBy("lo").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("lo", F.least("lo", "m").alias("m"), "n")
        large = materialised(join_counted(e, least, "lo", now[0]).select("hi", F.col("m").alias("lo")))
        small = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        down = join_counted(large, small, "hi", now[0]).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = materialised(down.unionAll(small.select("hi", F.col("m").alias("lo"))).distinct())
        before, now = now, _state(e)
    nodes = e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
