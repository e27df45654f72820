"""Fusion of ranked lists: relative scores and reciprocal ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bm25 import ranked

K = 60


def relative_scores(vector: DataFrame, keyword: DataFrame, alpha: float = 0.5, k: int = 5) -> DataFrame:
    """alpha * vector + (1 - alpha) * keyword, each as a share of its query's best; a missing side counts 0.

    Inputs: query_id, id, score. Adds vector_score and bm25_score.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")

    def shares(found: DataFrame, name: str) -> DataFrame:
        best = F.max("score").over(Window.partitionBy("query_id"))
        return found.select("query_id", "id", (F.col("score") / F.when(best > 0, best).otherwise(1.0)).alias(name))

    both = shares(vector, "vector_score").join(shares(keyword, "bm25_score"), ["query_id", "id"], "full_outer").fillna(0.0, ["vector_score", "bm25_score"])
    return ranked(both.withColumn("score", alpha * F.col("vector_score") + (1 - alpha) * F.col("bm25_score")), k)


def reciprocal_ranks(lists: dict[str, DataFrame], k: int = 5, constant: int = K) -> DataFrame:
    """Sum of 1 / (constant + rank) over the lists (query_id, id, rank from 1); adds each list's rank."""
    all_ = reduce(DataFrame.unionByName, [d.select("query_id", "id", F.lit(n).alias("list"), "rank") for n, d in lists.items()])
    places = [F.min(F.when(F.col("list") == n, F.col("rank"))).alias(f"{n}_rank") for n in lists]
    return ranked(all_.groupBy("query_id", "id").agg(F.sum(1 / (constant + F.col("rank"))).alias("score"), *places), k, 8)


def weighted_ranks(lists: dict[str, tuple[float, DataFrame]], k: int = 5, constant: int = K) -> DataFrame:
    """Sum of weight / (constant + rank - 1), as a share of the query's best."""
    all_ = reduce(DataFrame.unionByName, [d.select("query_id", "id", (F.lit(w) / (constant + F.col("rank") - 1)).alias("part")) for w, d in lists.values()])
    found = all_.groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    best = F.max("score").over(Window.partitionBy("query_id"))
    return ranked(found.withColumn("score", F.col("score") / best), k)
