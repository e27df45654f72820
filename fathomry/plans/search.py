"""One entry for all five retrieval modes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.functions import entities
from fathomry.operators import bm25, explain, filters, fusion, graph, rerank, vector

from .request import QueryRequest


@dataclass
class Corpus:
    """chunks: chunk_id, text, source, source_type, language; vectors: chunk_id, embedding; triples; index over chunks."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    triples: DataFrame | None = None
    index: bm25.Index | None = None

    def __post_init__(self) -> None:
        self.index = self.index or bm25.Index.build(self.chunks, "chunk_id", "text")

    def count(self) -> DataFrame:
        return self.chunks.agg(F.count("*").alias("n"))


def search(corpus: Corpus, request: QueryRequest) -> DataFrame:
    """Ranked chunks with the scores of each retriever.

    Source types and languages are filtered before the cut of the vector and
    keyword lists; paths after it. With reranking, a first stage of up to ten
    times top_k is reordered.
    """
    spark = corpus.chunks.sparkSession
    k = rerank.first_stage_size(request.top_k) if request.rerank else request.top_k
    asked = spark.range(1).select(F.lit("q").alias("query_id"), F.lit(request.query).alias("query"))
    conditions = {n: v for n, v in (("source_type", request.source_types), ("language", request.languages)) if v}
    # a chunk without a source type is a document
    typed = corpus.chunks.withColumn("source_type", F.coalesce("source_type", F.lit("doc"))) if request.source_types else corpus.chunks
    keep = typed.where(filters.where(conditions)).select(F.col("chunk_id").alias("id")) if conditions else None

    def by_vector(threshold: float | None = request.similarity_threshold) -> DataFrame:
        if corpus.vectors is None or request.vector is None:
            raise ValueError(f"mode {request.mode} needs vectors and a query vector")
        rows = corpus.vectors if keep is None else corpus.vectors.join(keep.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_semi")
        return vector.search(rows, [("q", request.vector)], k, threshold=threshold, key="chunk_id")

    def by_words() -> DataFrame:
        return corpus.index.search(asked, k, keep)

    def by_graph() -> DataFrame:
        if corpus.triples is None:
            raise ValueError("no triples")
        rows = graph.by_type(corpus.triples, request.entity_types, request.relationship_types)
        found = graph.entity_search(rows, entities.query_entities(request.query), k)
        each = found.where("source_chunk_id is not null").groupBy(F.col("source_chunk_id").alias("id")).agg(F.max("score").alias("score"), F.array_sort(F.collect_set("path")).alias("relationship_path"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("subject", "object"))))).alias("related_entities"))
        known = corpus.chunks.select(F.col("chunk_id").alias("id"))
        return bm25.ranked(each.join(known, "id", "left_semi").withColumn("query_id", F.lit("q")), k)

    if request.mode == "vector":
        found = by_vector().withColumn("vector_score", F.col("score"))
    elif request.mode == "bm25":
        found = by_words().withColumn("bm25_score", F.col("score"))
    elif request.mode == "hybrid":
        found = fusion.relative_scores(by_vector(), by_words(), request.alpha, k)
    elif request.mode == "graph":
        own = by_graph().withColumn("graph_score", F.col("score"))
        instead = by_vector().withColumn("vector_score", F.col("score")) if request.vector is not None and corpus.vectors is not None else None
        found = own if instead is None else graph.fallback(own, instead)
    else:
        lists = {"vector": by_vector(), "bm25": by_words()}
        if corpus.triples is not None:
            lists["graph"] = by_graph()
        found = fusion.reciprocal_ranks(lists, k)
    # at most k rows of one query
    rows = F.broadcast(found).join(corpus.chunks.withColumnRenamed("chunk_id", "id"), "id")
    rows = filters.result_filter(rows, paths=request.file_paths).withColumn("query", F.lit(request.query))
    if request.mode == "bm25" or request.explain:
        rows = rows.withColumn("matched_terms", bm25.matched_terms(F.col("query"), F.col("text")))
    if request.rerank:
        rows = rerank.rerank(rows, request.top_k)
    if request.explain:
        rows = explain.explained(rows, request.mode, request.alpha)
    return rows.drop("query_id", "query").withColumnRenamed("id", "chunk_id").orderBy("rank")
