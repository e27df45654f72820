"""Connected components of a graph given as a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Links that a task gets, if there are more tasks than that needs.
LINKS = 200_000


def _few(edges: DataFrame, many: int) -> DataFrame:
    """Few links in few partitions: a round costs a file for each task and table."""
    return edges.coalesce(many // LINKS + 1)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable; nodes without links to others are left out.

    links: two long columns a, b. Alternates large-star and small-star steps
    until the links are stars around the roots. Minima are aggregated before
    the exchange, and a hub's links meet their minimum in a join that can be
    split, so no task has to hold a hub's links.
    """
    edges = common.cut(links.select("a", "b").where("a <> b").distinct())
    many, state = edges.count(), None
    for _ in range(rounds):
        edges = _few(edges, many)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = common.cut(_few(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), many))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        many, state = now[0], now
    raise RuntimeError("the components did not settle")
