"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.functions.ship import ship

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``, or the folder given
    to ``setCheckpointDir``. Only where all tasks run in the driver's own process
    does a folder of this machine stand in; a cluster without either is refused.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    at = named or sc.getCheckpointDir()
    if not at and not sc.isLocal:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it is stored."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


_made: list[tuple[SparkSession, str]] = []


def _remove_made() -> None:
    for spark, path in _made:
        if SparkContext._active_spark_context is spark.sparkContext:
            remove(spark, path)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it goes when the application ends, as results may be read from it until then."""
    if not _made:
        atexit.register(_remove_made)
    _made.append((spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"))
    return _made[-1][1]


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _slot(bits: int, cols: tuple[str, ...]) -> Column:
    return F.xxhash64(*cols).bitwiseAND((1 << bits) - 1)


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))


def marks(keys: DataFrame, *cols: str, bits: int = 24) -> DataFrame:
    """A bitmap of the hashes of some keys, 64 bits a row: 2 ** (bits - 6) rows at most."""
    slot = _slot(bits, cols)
    return keys.groupBy(F.shiftright(slot, 6).alias("__at")).agg(F.bit_or(_bit(slot)).alias("__bits"))


def maybe(df: DataFrame, marked: DataFrame, *cols: str, bits: int = 24) -> DataFrame:
    """Adds ``__maybe``: false only for rows whose key is not among the marked. The bitmap is sent to all tasks."""
    slot = _slot(bits, cols)
    out = df.withColumn("__at", F.shiftright(slot, 6)).join(F.broadcast(marked), "__at", "left")
    return out.withColumn("__maybe", F.coalesce(F.col("__bits").bitwiseAND(_bit(slot)) != 0, F.lit(False))).drop("__at", "__bits")


#: Bytes and rows of an Arrow batch that are worked on at a time, unless one row has more.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 1024


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that what a task makes of them in Python stays small."""
    for batch in batches:
        step = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
