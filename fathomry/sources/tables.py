"""Tables of chunks without a transactional format: each change writes a new version."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def last_wins(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Of rows with one key the one with the highest seq."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id", seq: str | None = None) -> DataFrame:
    """New rows replace old ones of the same key; within the batch the one with the highest ``seq`` wins, or else the one that comes last in its order."""
    new = last_wins(new, key, seq).drop(seq) if seq else last_wins(new.withColumn("__at", F.monotonically_increasing_id()), key, "__at").drop("__at")
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def add(old: DataFrame, new: DataFrame) -> DataFrame:
    """Plain insert: nothing is replaced."""
    return old.unionByName(new)


def update_column(rows: DataFrame, new: DataFrame, column: str, key: str = "chunk_id") -> DataFrame:
    """Sets one column, such as an embedding, for the keys that ``new`` (key, column) has; other rows stay, unknown keys are left out."""
    given = new.groupBy(key).agg(F.max(F.struct(F.lit(1).alias("has"), F.col(column).alias("value"))).alias("__new"))
    value = F.when(F.col("__new.has") == 1, F.col("__new.value")).otherwise(F.col(column))
    return rows.join(given, key, "left").withColumn(column, value).select(*rows.columns)


def delete_ids(rows: DataFrame, ids: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go): only ids that exist count as deleted."""
    return rows.join(ids, key, "left_anti"), rows.join(ids, key, "left_semi")


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.where(~F.coalesce(condition, F.lit(False)))


def by_id(rows: DataFrame, value: object, key: str = "chunk_id") -> DataFrame:
    """One row or none; the predicate reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


class Versions:
    """A folder of versions of one table. A version counts once its files are complete, so a broken write leaves the last one in place."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def list(self) -> list[str]:
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        found = self.list()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{found[-1]}")

    def write(self, rows: DataFrame, keep: int = 3) -> str:
        name = f"v{time.time_ns():020d}"
        rows.write.parquet(f"{self.path}/{name}")
        jvm, fs = self._fs()
        for old in self.list()[:-keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}"), True)
        return name

    def reset(self) -> None:
        self.write(self.spark.createDataFrame([], self.schema), keep=1)


class Snapshots(Versions):
    """JSON versions of a graph, to read with any tool; loading skips versions that do not parse."""

    def read(self) -> DataFrame:
        plan = self.plan_restore()
        if plan is None:
            return self.spark.createDataFrame([], self.schema).drop("_corrupt_record")
        return self._open(plan).drop("_corrupt_record")

    def _open(self, name: str) -> DataFrame:
        fields = [f for f in self.schema.fields if f.name != "_corrupt_record"]
        return self.spark.read.schema(StructType([*fields, StructField("_corrupt_record", StringType())])).json(f"{self.path}/{name}")

    def plan_restore(self) -> str | None:
        """The last version that parses, which ``read`` would take; None if there is none."""
        for name in reversed(self.list()):
            rows = self._open(name).persist()
            try:
                if rows.where(F.col("_corrupt_record").isNotNull()).isEmpty():
                    return name
            finally:
                rows.unpersist()
        return None

    def restore(self, name: str | None = None) -> str | None:
        """Makes a version the newest again: the one named, or the last that parses. Returns the new version."""
        name = name or self.plan_restore()
        if name is None:
            return None
        if name not in self.list():
            raise ValueError(f"no version {name}")
        return self.write(self._open(name))

    def write(self, rows: DataFrame, keep: int = 3) -> str:
        name = f"v{time.time_ns():020d}"
        rows.drop("_corrupt_record").write.json(f"{self.path}/{name}")
        jvm, fs = self._fs()
        for old in self.list()[:-keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}"), True)
        return name
