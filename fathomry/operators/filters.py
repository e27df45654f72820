"""Metadata predicates and the shapes in which results are returned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomry.functions import text as tx


def where(conditions: dict[str, object]) -> Column:
    """All of several equalities; a list stands for any of its values."""
    each = [F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v) for k, v in conditions.items()]
    return reduce(lambda a, b: a & b, each, F.lit(True))


def result_filter(found: DataFrame, source_types: list[str] | None = None, languages: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """Applied to ranked results: a row without a source type is a doc, one without a language fails a language filter."""
    if source_types:
        found = found.where(F.coalesce("source_type", F.lit("doc")).isin(*source_types))
    if languages:
        found = found.where(F.col("language").isNotNull() & F.col("language").isin(*languages))
    if paths:
        found = found.where(tx.matches_any(F.col("source"), paths))
    return found


def chunk_records(chunks: DataFrame) -> DataFrame:
    """Eight fields of each chunk, never its vector."""
    summary = [F.col(c) for c in ("summary", "section_summary") if c in chunks.columns]
    return chunks.select(
        "chunk_id",
        F.col("source").alias("parent_doc_id"),
        "source",
        F.col("text").alias("content"),
        F.coalesce(*[F.nullif(c, F.lit("")) for c in summary], F.lit(None).cast("string")).alias("summary"),
        F.regexp_replace("source", "/[^/]*$", "").alias("folder_id"),
        F.coalesce(F.col("token_count").cast("string").try_cast("int"), F.lit(0)).alias("token_count"),
        "language",
    )


# What a result tells in columns of its own.
OWN = ("source", "file_path", "source_type", "language")


def results(found: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Fills in what a result lacks: its source and its source type. A map of metadata, if there is one, loses the keys that are columns."""
    options = [F.col(c) for c in ("source", "file_path") if c in found.columns]
    found = found.withColumns({"source": F.coalesce(*options, F.lit("unknown")), "source_type": F.coalesce("source_type", F.lit("doc"))})
    return found if metadata not in found.columns else found.withColumn(metadata, F.map_filter(metadata, lambda k, _: ~k.isin(*OWN)))


def inject(chunks: DataFrame, extra: str, folder: dict[str, object], known: set[str]) -> DataFrame:
    """Merges a folder's metadata into the map ``extra``; the folder wins, and only new scalar keys are taken."""
    scalars = {k: str(v) for k, v in folder.items() if k not in known and isinstance(v, (str, int, float, bool))}
    if not scalars:
        return chunks
    new = F.create_map(*[F.lit(x) for kv in scalars.items() for x in kv])
    own = F.map_filter(F.coalesce(extra, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return chunks.withColumn(extra, F.map_concat(own, new))
