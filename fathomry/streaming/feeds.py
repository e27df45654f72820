"""Change-driven updates with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fathomry.functions.ship import ship

DEBOUNCE = "30 seconds"


def watch(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """A stream of new files below a folder: (file_path, modified, size, checksum)."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return rows.select(F.regexp_replace("path", "^file:/*", "/").alias("file_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("checksum"))


def debounced(changes: DataFrame, key: str, ts: str = "ts", gap: str = DEBOUNCE, late: str = "1 minute") -> DataFrame:
    """One row per burst of changes of a key: a session that ends after a pause of ``gap``. Works on streams and on tables."""
    rows = changes.withWatermark(ts, late) if changes.isStreaming else changes
    out = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(requests: DataFrame, key: str = "dedupe_key", ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """Requests whose key has not been seen within a time."""
    return requests.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def fingerprint(fields: list[str]) -> Column:
    """A hash of what counts; volatile fields are simply not listed."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def changed(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Rows of a table whose fields differ from the key's row before."""
    before = F.lag("h").over(Window.partitionBy(key).orderBy(*order))
    out = rows.withColumn("h", fingerprint(fields))
    return out.withColumn("b", before).where(F.col("b").isNull() | (F.col("b") != F.col("h"))).drop("h", "b")


def change_feed(rows: DataFrame, key: str, fields: list[str], ts: str = "ts") -> DataFrame:
    """The same on a stream: state keeps one hash per key. Emits (key, ts, hash) of every change."""
    ship(rows.sparkSession)
    schema = rows.select(F.col(key).alias("key")).schema
    out = StructType([*schema, *rows.select(F.col(ts).alias("ts")).schema]).add("h", "string")
    hashed = rows.select(F.col(key).alias("key"), F.col(ts).alias("ts"), fingerprint(fields).alias("h"))

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for batch in batches:
            batch = batch.sort_values("ts", kind="stable")
            new = batch[batch["h"] != batch["h"].shift(fill_value=last or "")]
            if len(batch):
                last = batch["h"].iloc[-1]
            if len(new):
                yield new[["key", "ts", "h"]]
        state.update((last or "",))

    return hashed.groupBy("key").applyInPandasWithState(run, out, "h string", "append", "NoTimeout")


def index_new_files(changes: DataFrame, checkpoint: str, handle, trigger: str = "30 seconds"):
    """Runs ``handle(batch, id)`` on each batch of changed files; restarts go on where they stopped."""
    return changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
