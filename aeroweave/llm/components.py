"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node reachable.

    Each step is a grouped minimum and a join on the node, so no component is ever gathered in
    one task. A node with many neighbours is a skewed join key, which Spark splits. Steps
    shrink every component's diameter geometrically; each result is written to the shared folder.
    NULL ends and loops are ignored; an empty edge table gives no rows.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"
    )
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour moves to the smallest one
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the node and its smaller neighbours move to the smallest one
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(small_min.select("u", F.col("m").alias("v"))).distinct(), "cc")
        # done when all edges point straight at a node that points nowhere
        moved = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1)
        forked = new.groupBy("u").count().where("count > 1").limit(1)
        now = new
        if moved.isEmpty() and forked.isEmpty():
            break
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return labels.unionByName(roots)
