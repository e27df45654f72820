"""A stream of new, changed and deleted files below a folder.

Spark's own file source tells a path once. Here each look at the folder that finds
a difference writes a listing (path, size, time) to a ledger in a shared folder,
and an offset is the number of a listing; a batch is the difference of two
listings, and its files are read by the tasks. A restart goes on from the
checkpoint's offset, as its listing is still there. The walk does not enter excluded
folders. The driver holds listings, never contents.
"""

from __future__ import annotations

import fnmatch
import hashlib
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from fathomry.functions import languages as lang
from fathomry.functions.ship import ship

SCHEMA = "file_path string, change string, checksum string, mtime double, size long, listing long"
LISTING = pa.schema([("path", pa.string()), ("size", pa.int64()), ("ns", pa.int64())])
#: Files that a task reads, and bytes of a file read at once.
FILES, PIECE = 256, 1 << 20


def watch_changes(spark: SparkSession, root: str, ledger: str, pattern: str = "*", excludes: list[str] | None = None) -> DataFrame:
    """The stream: file_path, change (added, changed or deleted), checksum (null if deleted), mtime, size, listing.

    ledger: a folder of this stream alone that the driver and its restarts reach, such as one below
    ``spark.checkpoint.dir``. An equal size and time mean unchanged. A file that goes while its batch is read
    has no row in it; the next batch tells that it is deleted. The first batch holds all files.
    """
    ship(spark)
    spark.dataSource.register(FolderChanges)
    names = lang.EXCLUDES if excludes is None else excludes
    return spark.readStream.format("folder_changes").options(root=root, ledger=ledger, pattern=pattern, excludes="\n".join(names)).load()


@dataclass
class Part(InputPartition):
    rows: list
    listing: int


class FolderChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:  # noqa: N802, ARG002
        return FolderReader(dict(self.options))


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri.rstrip("/") or "/"
    system, path = pafs.FileSystem.from_uri(uri.replace("file:///", "/") if uri.startswith("file:///") else uri)
    return system, path.rstrip("/")


def walk(system: pafs.FileSystem, top: str, pattern: str, excludes: list[str]) -> Iterator[pafs.FileInfo]:
    """Files whose names match, any case; folders that a pattern ``**/name/**`` excludes are not listed."""
    shut = [e.removeprefix("**/").removesuffix("/**") for e in excludes if e.endswith("/**")]
    files = [e.removeprefix("**/") for e in excludes if not e.endswith("/**")]
    todo = [top]
    while todo:
        for f in system.get_file_info(pafs.FileSelector(todo.pop(), allow_not_found=True)):
            if f.type == pafs.FileType.Directory:
                if not any(fnmatch.fnmatchcase(f.base_name, s) for s in shut):
                    todo.append(f.path)
            elif f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name.lower(), pattern.lower()) and not any(fnmatch.fnmatchcase(f.base_name, s) for s in files):
                yield f


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.ledger = options["root"], options["ledger"]
        self.pattern, self.excludes = options.get("pattern", "*"), [e for e in options.get("excludes", "").split("\n") if e]
        self.last: int | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def _listed(self, n: int) -> dict[str, tuple[int, int]]:
        if n == 0:
            return {}
        system, at = place(self.ledger)
        rows = pq.read_table(f"{at}/listing-{n:08d}.parquet", filesystem=system).to_pydict()
        return dict(zip(rows["path"], zip(rows["size"], rows["ns"], strict=True), strict=True))

    def _newest(self) -> int:
        system, at = place(self.ledger)
        names = [f.base_name for f in system.get_file_info(pafs.FileSelector(at, allow_not_found=True))]
        return max((int(n[8:16]) for n in names if n.startswith("listing-") and n.endswith(".parquet")), default=0)

    def latestOffset(self) -> dict:  # noqa: N802
        if self.last is None:
            self.last = self._newest()
        system, top = place(self.root)
        now = {f.path: (f.size, f.mtime_ns or 0) for f in walk(system, top, self.pattern, self.excludes)}
        if now != self._listed(self.last):
            to, at = place(self.ledger)
            to.create_dir(at, recursive=True)
            self.last += 1
            table = pa.table([list(now), [v[0] for v in now.values()], [v[1] for v in now.values()]], schema=LISTING)
            part = f"{at}/part-{uuid.uuid4().hex}"
            pq.write_table(table, part, filesystem=to)
            to.move(part, f"{at}/listing-{self.last:08d}.parquet")
        return {"listing": self.last}

    def partitions(self, start: dict, end: dict) -> Sequence[Part]:
        old, new = self._listed(start["listing"]), self._listed(end["listing"])
        rows = [(p, "changed" if p in old else "added", *v) for p, v in sorted(new.items()) if old.get(p) != v]
        rows += [(p, "deleted", *old[p]) for p in sorted(old.keys() - new.keys())]
        return [Part(rows[i : i + FILES], end["listing"]) for i in range(0, len(rows), FILES)]

    def read(self, partition: Part) -> Iterator[tuple]:
        system, _ = place(self.root)
        for path, change, size, ns in partition.rows:
            checksum = None
            if change != "deleted":
                digest = hashlib.sha256()
                try:
                    with system.open_input_stream(path) as f:
                        while piece := f.read(PIECE):
                            digest.update(piece)
                except FileNotFoundError:
                    continue
                checksum = digest.hexdigest()
            yield path, change, checksum, ns / 1e9, size, partition.listing

    def commit(self, end: dict) -> None:
        """Listings before the last committed batch's are not asked for again; a replay starts from the one before it."""
        system, at = place(self.ledger)
        for f in system.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith("listing-") and int(f.base_name[8:16]) < end["listing"] - 1:
                system.delete_file(f.path)
