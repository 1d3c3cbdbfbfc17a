"""Connected components of an undirected graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a, b): root is the smallest
    node of its component.

    Alternates large stars (each node gives its larger neighbours the smallest
    node it knows) and small stars (the same among its smaller ones) until the
    edges stay as they are: a star around each root, in a number of rounds
    logarithmic in the component's size. Hubs are aggregated before the shuffle.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = written(large.filter("a <> b"), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        # (a, b) has a > b here: the smaller neighbours of a, and a itself, go to the smallest.
        hung = large.join(low, "a")
        small = hung.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        old, now = now, written(small.filter("a <> b").distinct(), "edges")
        dropped(old, large)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
