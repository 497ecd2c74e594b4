"""Distributed union-find: connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Stored


def _large_star(pairs: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the least of its neighbourhood."""
    both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the least of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30)))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node reachable from each node that has a link to another one.

    ``links`` holds pairs of longs; null ends, loops and repeated pairs are ignored. Only pairs
    move: minima are aggregated before the shuffle, and a node with many neighbours meets its
    minimum in a join that Spark may split. Each half round is written to the shared folder and
    the one before is dropped; about log(n) rounds. Without links the result is empty.
    """
    kept = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    pairs = kept.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now = Stored(pairs.distinct(), "links")
    seen = _digest(now.df)
    while seen[0]:
        half = Stored(_large_star(now.df), "large-star")
        after = Stored(_small_star(half.df), "small-star")
        found = _digest(after.df)
        now.drop()
        half.drop()
        now = after
        if found == seen:
            break
        seen = found
    roots = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
