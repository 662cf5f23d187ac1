"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widemetrics.llm.common import discard, saved, saved_at


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the component's least node.

    Large-star and small-star steps take turns until nothing changes, about as
    many as the logarithm of the longest path. A step finds each node's least
    neighbour by an aggregate that combines before the shuffle, and joins it
    to the node's edges, where a hub's rows can be split. Steps are tables in
    the scratch folder. Edges may repeat, be loops, or none.
    """
    spark = edges.sparkSession
    now, folder = saved_at(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a != b")
        .distinct(),
        "components",
    )
    loops = saved(edges.filter("a = b").select(F.col("a").alias("node")).distinct(), "components-loops")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        # Each larger neighbour is tied to the least one.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        # A node and its smaller neighbours are tied to the least of them.
        down, between = saved_at(large, "components")
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(lowest.select("a", F.col("m").alias("b")))
        after, next_folder = saved_at(small.filter("a != b").distinct(), "components")
        new = _mark(after)
        discard(spark, between)
        discard(spark, folder)
        now, folder = after, next_folder
        if new == mark:
            break
        mark = new
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    alone = loops.join(found.unionByName(roots).select("node"), "node", "left_anti")
    return found.unionByName(roots).unionByName(alone.select("node", F.col("node").alias("root")))
