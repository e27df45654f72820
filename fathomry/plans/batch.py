"""Many queries at once, in all five modes, over stored indexes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.functions import entities
from fathomry.functions.ship import ship
from fathomry.operators import bm25, fusion, graph, postings, vector

MODES = ("vector", "bm25", "hybrid", "graph", "multi")


def mentions(queries: DataFrame) -> DataFrame:
    """(query_id, n, entity): the names in each query (query_id, query), numbered from 0; null queries have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(q, i, e) for q, t in zip(b["query_id"], b["query"], strict=True) for i, e in enumerate(entities.query_entities(t or ""))]
            yield pd.DataFrame(rows, columns=["query_id", "n", "entity"])

    ship(queries.sparkSession)
    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "query").mapInPandas(run, f"query_id {kind}, n int, entity string")


def search_batch(
    queries: DataFrame,
    mode: str = "hybrid",
    k: int = 5,
    alpha: float = 0.5,
    depth: int | None = None,
    words: postings.TextIndex | None = None,
    vectors: DataFrame | None = None,
    triples: DataFrame | None = None,
    key: str = "vec_id",
    threshold: float | None = None,
) -> DataFrame:
    """(query_id, id, score, rank and each retriever's own columns) for a table of queries (query_id, query, q).

    depth: the length of the lists that are fused, at least k; k if left out. A query
    without words or without a vector has no list of that retriever; one that finds nothing has no row.
    With mode graph, queries that find no triple are answered by vector if there are vectors. threshold: for the vector list, as in single searches.
    Ids of the three retrievers are those of chunks. Every list is cut before it is exchanged, so what is fused is at most depth rows a query and list.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    depth = max(k, depth or k)

    def by_words() -> DataFrame:
        if words is None:
            raise ValueError(f"mode {mode} needs a text index")
        return words.bm25(queries.select("query_id", "query"), depth)

    def by_vector() -> DataFrame:
        if vectors is None:
            raise ValueError(f"mode {mode} needs vectors")
        found = vector.batch(vectors, queries.select("query_id", "q"), depth, key=key)
        return found if threshold is None else found.where(F.col("score") >= threshold)

    def by_graph() -> DataFrame:
        if triples is None:
            raise ValueError(f"mode {mode} needs triples")
        found = graph.entity_batch(triples, mentions(queries), depth)
        each = found.where("source_chunk_id is not null").groupBy("query_id", F.col("source_chunk_id").alias("id")).agg(F.max("score").alias("score"))
        return bm25.ranked(each, depth)

    if mode == "vector":
        return by_vector().where(F.col("rank") <= k)
    if mode == "bm25":
        return by_words().where(F.col("rank") <= k)
    if mode == "hybrid":
        return fusion.relative_scores(by_vector(), by_words(), alpha, k)
    if mode == "graph":
        own = by_graph().where(F.col("rank") <= k)
        return own if vectors is None else graph.fallback(own, by_vector().where(F.col("rank") <= k))
    lists = {"vector": by_vector(), "bm25": by_words()}
    if triples is not None:
        lists["graph"] = by_graph()
    return fusion.reciprocal_ranks(lists, k)
