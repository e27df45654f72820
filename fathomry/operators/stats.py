"""Latencies and the state of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latencies(rows: DataFrame, by: str, ms: str, percentiles: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles (the item at n * p / 100, counted from 0), mean and queries per second of every group.

    Ranks come from a count per distinct value, so a large group meets as a
    histogram and not as its rows.
    """
    hist = rows.where(F.col(ms).isNotNull()).groupBy(by, F.col(ms).alias("v")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy(by))})
    at = lambda p: F.least(F.floor(F.col("n") * p / F.lit(100.0)).cast("long"), F.col("n") - 1)
    picks = [F.min(F.when(F.col("upto") > at(p), F.col("v"))).alias(f"p{p}") for p in percentiles]
    total = F.sum(F.col("v") * F.col("c"))
    return hist.groupBy(by).agg(F.max("n").alias("n"), *picks, F.round(total / F.max("n"), 6).alias("mean"), F.round(F.try_divide(F.max("n") * 1000.0, total), 6).alias("qps"))


def code_stats(chunks: DataFrame) -> DataFrame:
    """Languages and symbol kinds of code chunks."""
    return chunks.agg(F.count("*").alias("total_chunks"), F.array_sort(F.collect_set("language")).alias("languages"), F.array_sort(F.collect_set("symbol_kind")).alias("symbol_kinds"))


def by_language(chunks: DataFrame) -> DataFrame:
    """Code documents of each language."""
    return chunks.where(F.coalesce("source_type", F.lit("doc")) == "code").groupBy("language").agg(F.countDistinct("source").alias("n_documents"), F.count("*").alias("n_chunks"))


def files(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("n_chunks"), F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))


def folders(chunks: DataFrame) -> DataFrame:
    folder = F.regexp_replace("source", "/[^/]*$", "")
    return chunks.groupBy(folder.alias("folder_path")).agg(F.count("*").alias("chunk_count"), F.countDistinct("source").alias("file_count"))


def index_status(chunks: DataFrame, triples: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row over the whole index; each part is one aggregate."""
    from . import graph
    from . import jobs as queue

    own = chunks.agg(
        F.count("*").alias("total_chunks"),
        F.count_if(F.col("source_type") == "code").alias("code_chunks"),
        F.count_if(F.coalesce("source_type", F.lit("doc")) == "doc").alias("doc_chunks"),
        F.countDistinct("source").alias("total_documents"),
        F.array_sort(F.collect_set("language")).alias("languages"),
    )
    return own.crossJoin(graph.counts(triples)).crossJoin(queue.stats(jobs).select(*[F.col(c).alias(f"jobs_{c}") for c in ("pending", "running", "done", "failed", "cancelled")]))
