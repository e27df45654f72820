"""From a folder to chunks, texts, vectors and triples of a store, by what has changed."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.operators import chunking, hooks, incremental, symbols
from fathomry.sources import files
from fathomry.streaming.watch import watch_changes

from .store import MANIFEST, Store, graph_of


def chunks_of(docs: DataFrame) -> DataFrame:
    """Chunks of loaded documents: code along its symbols, other texts by sentences; each names the symbol that it shows."""
    code = docs.where("source_type = 'code'")
    parts = symbols.overlapping(symbols.code_chunks(code), symbols.symbols(code))
    named = F.map_filter(F.create_map(F.lit("symbol_name"), F.col("symbol_name"), F.lit("symbol_type"), F.col("symbol_kind"), F.lit("start_line"), F.col("start_line").cast("string")), lambda _, v: v.isNotNull())
    lines = parts.select("chunk_id", "text", "source", F.lit("code").alias("source_type"), "language", named.alias("metadata"))
    prose = docs.where("source_type = 'doc'")
    texts = chunking.sentences(prose, source="source").join(prose.select("source", "language"), "source")
    counted = F.create_map(F.lit("token_count"), F.col("token_count").cast("string"))
    return lines.unionByName(texts.select("chunk_id", "text", "source", F.lit("doc").alias("source_type"), "language", counted.alias("metadata")))


def index_folder(
    store: Store,
    root: str,
    embedder: Callable[[list[str]], list[list[float]]] | None = None,
    model: dict | None = None,
    patterns: list[str] | None = None,
    include_code: bool = True,
    excludes: list[str] | None = None,
    force: bool = False,
    batch: str | None = None,
    watch_mode: str = "off",
) -> dict:
    """Brings a folder's part of the store up to date in one commit: counts of files and of chunks that came and went.

    Changed and deleted files lose their chunks and triples, changed and new ones
    are read, chunked, embedded and linked; the rest are not read. ``force`` does so for all files. ``model`` (provider, model,
    dimensions) must be that of the index, unless forced. A ``batch`` that was committed before changes nothing.
    Empty files count as absent, as Spark's listing leaves them out.
    """
    spark = store.spark
    folder = os.path.abspath(root.removeprefix("file://")) if "://" not in root or root.startswith("file://") else root.rstrip("/")
    if model and not force:
        store.validate_embedding_compatibility(**model)
    known = store.manifest(folder)
    known = spark.createDataFrame([], MANIFEST) if known is None else known
    below = F.substring("file_path", len(folder) + 2, 1 << 30)
    found = files.checksums(spark, root, None if force else known).where(files.wanted(F.col("file_path"), below, patterns, include_code, excludes))
    changes = incremental.diff(known, found, force).persist()
    try:
        told = incremental.summary(changes).first().asDict()
        gone = incremental.evicted(changes, force)
        new = changes.where(F.col("change").isin("added", "changed")).select("file_path").join(found.select("file_path", "mtime"), "file_path")
        span = new.agg(F.min("mtime").alias("first"), F.max("mtime").alias("last")).first()
        if not force and folder in store.folders() and not any(told[f"files_{c}"] for c in ("added", "changed", "deleted")):
            return told | {"chunks": 0, "gone": 0}
        rows = None
        if span["first"] is not None:
            docs = files.load(spark, root, patterns=patterns, include_code=include_code, excludes=excludes, within=(span["first"], span["last"]))
            rows = chunks_of(docs.join(new.select(F.col("file_path").alias("source")), "source", "left_semi"))
            rows = hooks.embed(rows, embedder).withColumn("embedding", F.col("embedding").cast("array<double>")) if embedder else rows.withColumn("embedding", F.lit(None).cast("array<double>"))

        def manifest(written: DataFrame | None) -> DataFrame:
            made = spark.createDataFrame([], "source string, chunk_id string") if written is None else written.select("source", "chunk_id")
            return incremental.next_manifest(known.limit(0) if force else known, found, made)

        record = {"folder_path": folder, "last_indexed": dt.datetime.now(dt.UTC).isoformat(), "include_code": include_code, "watch_mode": watch_mode}
        made = store.commit(
            rows,
            gone=lambda live: live.join(gone, "chunk_id", "left_semi"),
            graph=graph_of if rows is not None else None,
            manifest=manifest,
            batch=batch,
            folder=record,
            **({"embedding": model} if model else {}),
        )
        return told | {"chunks": made["rows"], "gone": made["gone"]} if made else told | {"chunks": 0, "gone": 0}
    finally:
        changes.unpersist()


def follow(store: Store, root: str, ledger: str, checkpoint: str, trigger: dict | None = None, **given: object):
    """Keeps a folder's part up to date as files change; a batch that is replayed after a crash is told by its number in the log."""
    stream = watch_changes(store.spark, root, ledger, excludes=given.get("excludes"))
    handle = lambda rows, i: index_folder(store, root, batch=f"{checkpoint}#{i}", watch_mode="auto", **given)  # noqa: E731, ARG005
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()
