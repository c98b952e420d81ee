"""Connected components of a graph held as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .exchange import dealt_anew, stored


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(dealt_anew(least, "u"), "u").select(
        F.col("v").alias("u"), F.col("m").alias("v")
    ).filter("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    lower = down.join(dealt_anew(least, "u"), "u").filter(F.col("v") != F.col("m")).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v: every node but the least of its component, with that least node. Edges of a node with itself don't matter.
    The number of rounds grows with the logarithm of the nodes.
    """
    now = stored(edges.select("u", "v").filter("u != v").distinct())
    mark = None
    while True:
        now = stored(_small(_large(now)))
        new = now.agg(F.count("*").alias("n"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)").alias("x")).first()
        if mark == tuple(new):
            return now
        mark = tuple(new)
