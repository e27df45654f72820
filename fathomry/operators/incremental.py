"""What changed since the last run, and what to evict and to index again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(manifest: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """(file_path, change, old_checksum, checksum, chunk_ids): added, changed, deleted or unchanged.

    manifest: file_path, checksum, mtime, chunk_ids; files: file_path, checksum,
    mtime. An equal mtime means unchanged, whatever the checksum; else the
    checksums decide. force: everything known is evicted, everything found added.
    """
    old = manifest.select("file_path", F.col("checksum").alias("old_checksum"), F.col("mtime").alias("old_mtime"), "chunk_ids", F.lit(True).alias("known"))
    new = files.select("file_path", "checksum", "mtime", F.lit(True).alias("found"))
    both = old.join(new, "file_path", "full_outer")
    same = (F.col("old_mtime") == F.col("mtime")) | F.col("old_checksum").eqNullSafe(F.col("checksum"))
    change = F.when(F.col("found").isNull(), "deleted").when(F.lit(force) | F.col("known").isNull(), "added").when(same, "unchanged").otherwise("changed")
    return both.select("file_path", change.alias("change"), "old_checksum", "checksum", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))


def evicted(changes: DataFrame, force: bool = False) -> DataFrame:
    """Ids of the chunks that must go."""
    gone = changes if force else changes.where(F.col("change").isin("changed", "deleted"))
    return gone.select(F.explode("chunk_ids").alias("chunk_id")).distinct()


def summary(changes: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col("change") == c).alias(f"files_{c}")
    evict = F.sum(F.when(F.col("change").isin("changed", "deleted"), F.size("chunk_ids")).otherwise(0))
    return changes.agg(n("added"), n("changed"), n("deleted"), n("unchanged"), F.coalesce(evict, F.lit(0)).alias("chunks_evicted"))


def next_manifest(manifest: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The manifest after a run: unchanged entries stay, deleted ones go, the rest get the ids of their new chunks (source, chunk_id)."""
    changes = diff(manifest, files)
    ids = chunks.groupBy(F.col("source").alias("file_path")).agg(F.sort_array(F.collect_list("chunk_id")).alias("new_ids"))
    kept = changes.where(F.col("change") != "deleted").select("file_path", "change", F.col("chunk_ids").alias("old_ids"))
    rows = kept.join(files, "file_path").join(ids, "file_path", "left")
    listed = F.when(F.col("change") == "unchanged", F.col("old_ids")).otherwise(F.coalesce("new_ids", F.array().cast("array<string>")))
    return rows.select("file_path", "checksum", "mtime", listed.alias("chunk_ids"))


def without(rows: DataFrame, gone: DataFrame, key: str = "chunk_id", by: str = "chunk_id") -> DataFrame:
    """Rows whose chunk is not gone; for triples, key is source_chunk_id."""
    return rows.join(gone.select(F.col(by).alias(key)), key, "left_anti")
