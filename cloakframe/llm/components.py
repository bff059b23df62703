"""Connected components of a distributed edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.runtime import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) names; component is its smallest reachable node.

    Null ends and self-loops count for nothing. The edges stay distributed: each round joins every edge with
    the smallest neighbour of its end (a mergeable aggregate, never a collected neighbourhood) and is written
    to the shared folder. An edge list without edges gives an empty table.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e = written(e, "edges", few=True)
    state = None
    while True:
        # large star: every larger neighbour of a node moves to the node's smallest neighbour (or itself)
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: every smaller neighbour of a node, and the node, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = e
        e = written(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges", few=True)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(last)
        if now == state:
            break
        state = now
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out.stored = e.stored
    return out
