"""A listing of a large tree of folders, level by level as Spark jobs."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.functions import languages as lang
from fathomry.functions.ship import ship

from . import shared

FOUND = "path string, relative string, size long, modified timestamp, folder boolean"


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri.rstrip("/") or "/"
    system, path = pafs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


def walk(spark: SparkSession, root: str, excludes: list[str] | None = None) -> DataFrame:
    """(path, relative, size, modified) of the files below a root; folders that a pattern ``**/name/**`` excludes, and hidden ones, are never listed.

    Each level is one job: its folders are dealt evenly to the tasks, which list them, and what they find is a table of the shared folder, so
    that a lost executor costs one level's share and the driver holds no names. Links to folders are not followed; a folder that goes meanwhile is empty.
    An absent root has no files. Executors reach the root by themselves.
    """
    ship(spark)
    shut = [e.removeprefix("**/").removesuffix("/**") for e in (lang.EXCLUDES if excludes is None else excludes) if e.endswith("/**")]
    files = [e.removeprefix("**/") for e in (lang.EXCLUDES if excludes is None else excludes) if not e.endswith("/**")]
    top = place(root)[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = place(root)[0]
        for b in batches:
            for path in b["path"]:
                rows = []
                for f in system.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
                    folder = f.type == pafs.FileType.Directory
                    hidden = f.base_name.startswith((".", "_"))
                    if hidden or any(fnmatch.fnmatchcase(f.base_name, s) for s in (shut if folder else files)) or (not folder and f.type != pafs.FileType.File):
                        continue
                    rows.append((f.path, f.path[len(top) :].lstrip("/"), f.size, f.mtime, folder))
                made = pd.DataFrame(rows, columns=["path", "relative", "size", "modified", "folder"])
                yield made.astype({"size": "Int64", "folder": bool}).assign(modified=pd.to_datetime(made["modified"], utc=True).astype("datetime64[us, UTC]"))

    held = shared.fresh(spark, "walk")
    todo = spark.createDataFrame([(top,)], "path string")
    levels: list[DataFrame] = []
    while True:
        at = f"{held}/level={len(levels)}"
        todo.mapInPandas(run, FOUND).write.parquet(at)
        found = spark.read.schema(FOUND).parquet(at)
        levels.append(found)
        todo = found.where("folder").select("path").repartition(spark.sparkContext.defaultParallelism)
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels).where("not folder").drop("folder")
