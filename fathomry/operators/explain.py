"""Why a result is where it is: one sentence, and the figures behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _have(found: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) if n in found.columns else F.lit(None) for n in names]


def reason(found: DataFrame, mode: str, alpha: float = 0.5) -> Column:
    """Reranking speaks first, then a graph fallback, then the mode."""
    # The sentences below, which callers read as they are.
    score, vector, bm25, graph, moved, again, place = _have(found, "score", "vector_score", "bm25_score", "graph_score", "rerank_movement", "rerank_score", "original_rank")
    fell = F.col("graph_fallback") if "graph_fallback" in found.columns else F.lit(False)
    way = F.when(moved > 0, "up").otherwise("down")
    steps = F.concat(F.abs(moved).cast("string"), F.when(F.abs(moved) == 1, " place").otherwise(" places"))
    cross = F.format_string("(cross-encoder score %.2f)", again.cast("double"))
    stayed = F.concat(F.lit("Reranker confirmed position #"), place.cast("string"), F.lit(" "), cross)
    shifted = F.concat(F.lit("Reranked "), way, F.lit(" "), steps, F.lit(" from #"), place.cast("string"), F.lit(" "), cross)
    two = lambda c: F.format_string("%.2f", c.cast("double"))
    out = F.when(moved.isNotNull() & again.isNotNull(), F.when(moved == 0, stayed).otherwise(shifted))
    if mode == "graph":
        out = out.when(fell, F.concat(F.lit("Graph returned no hits; fell back to vector search (score "), two(F.coalesce(vector, score)), F.lit(")")))
        out = out.when(graph.isNotNull(), F.concat(F.lit("Graph match (score "), two(graph), F.lit(")")))
    if mode == "hybrid":
        parts = [F.lit(f"Hybrid match (alpha={alpha:.2f}): vector "), two(alpha * vector), F.lit(" + BM25 "), two((1 - alpha) * bm25), F.lit(" -> fused "), two(score)]
        out = out.when(vector.isNotNull() | bm25.isNotNull(), F.concat(*parts))
    if mode == "multi":
        named = [(n, _have(found, f"{c}_rank")[0]) for n, c in (("vector", "vector"), ("BM25", "bm25"), ("graph", "graph"))]
        lists = F.concat_ws(", ", *[F.when(r.isNotNull(), F.concat(F.lit(f"{n} #"), r.cast("string"))) for n, r in named])
        shown = F.when(lists == "", "no retrievers").otherwise(lists)
        out = out.when(F.lit(True), F.concat(F.lit("RRF fusion ("), shown, F.lit("); rrf_score="), F.format_string("%.4f", score.cast("double"))))
    if mode == "bm25":
        terms = F.col("matched_terms") if "matched_terms" in found.columns else F.array().cast("array<string>")
        list_ = F.when(F.size(terms) > 0, F.concat(F.lit(": "), F.array_join(F.slice(terms, 1, 5), ", "))).otherwise("")
        out = out.when(bm25.isNotNull(), F.concat(F.lit("BM25 keyword match (score "), two(bm25), F.lit(")"), list_))
    if mode == "vector":
        out = out.when(vector.isNotNull(), F.concat(F.lit("Vector similarity match (score "), two(vector), F.lit(")")))
    return out.otherwise(F.concat(F.lit(f"Retrieved by {mode} (score "), two(score), F.lit(")")))


def explained(found: DataFrame, mode: str, alpha: float = 0.5) -> DataFrame:
    """Adds ``explanation``: reason, matched_terms, fusion, graph_path, rerank_movement and graph_fallback."""
    have = lambda n, kind: (F.col(n) if n in found.columns else F.lit(None)).cast(kind).alias(n)
    fusion = F.lit(None).cast("map<string,double>")
    if mode == "hybrid":
        fusion = F.create_map(F.lit("vector_score_weighted"), alpha * F.col("vector_score"), F.lit("bm25_score_weighted"), (1 - alpha) * F.col("bm25_score"), F.lit("alpha"), F.lit(float(alpha)), F.lit("fused_score"), F.col("score"))
    elif mode == "multi":
        places = [(c, F.col(c).cast("double")) for c in ("vector_rank", "bm25_rank", "graph_rank") if c in found.columns]
        all_ = F.create_map(F.lit("rrf_score"), F.col("score"), *[x for c, v in places for x in (F.lit(c), v)])
        fusion = F.map_filter(all_, lambda _, v: v.isNotNull())
    fell = have("graph_fallback", "boolean") if mode == "graph" else F.lit(None).cast("boolean").alias("graph_fallback")
    parts = [reason(found, mode, alpha).alias("reason"), have("matched_terms", "array<string>"), fusion.alias("fusion"), have("relationship_path", "array<string>").alias("graph_path"), have("rerank_movement", "int"), fell]
    return found.withColumn("explanation", F.struct(*parts))


def explain_result(found: DataFrame, chunk_id: object, key: str = "chunk_id") -> DataFrame:
    """The one explained result of a chunk, with the fields of its explanation beside it.

    A chunk that is not among the results is an error, as the question was why it is there.
    """
    own = found.where(F.col(key) == F.lit(chunk_id)).limit(1)
    if own.isEmpty():
        raise LookupError(f"{chunk_id!r} is not among the results of this query and mode")
    rest = [c for c in own.columns if c in (key, "text", "source", "score")]
    return own.select(*rest, "explanation.*")
