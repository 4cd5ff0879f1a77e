"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackyard.llm import scratch


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long): root is the smallest node that can be reached.

    Each step replaces links by links to a neighbourhood's minimum, until every component is a star. Minima come from map-side sums and
    are joined back, so a node with very many links is no hot task. Each round is a table in the shared folder, which replaces that of the round before; the driver sees a
    count and a checksum. Self-links are dropped: a node without others isn't in the result. Empty in, empty out.
    """
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    down = scratch.save(down, "links")
    mark = _mark(down)
    for _ in range(rounds):
        since = scratch.mark() - 1  # the table of the round before
        both = down.union(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        # Large star: neighbours above u go to the least of u and its neighbours.
        up = down.select(F.col("v").alias("x"), F.col("u").alias("w"))
        large = up.join(least, "x").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its neighbours below go to the least of those.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        down = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        down = scratch.save(down, "links")
        new = _mark(down)
        scratch.drop_since(down.sparkSession, since, down)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return down.select(F.col("u").alias("node"), F.col("v").alias("root")).union(down.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(down: DataFrame) -> tuple:
    return tuple(down.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
