"""Media columns as content-addressed payloads in tar shards.

A payload (here: the bytes of a text) is stored as a greyscale PNG, eight bits
a sample and losslessly, named by the SHA-256 of the PNG in a tar shard below
the shared folder. Rows carry digest, shard, offset and length. The metadata
columns (width, height, bit depth) come from range reads of the PNG header
alone; the payload is read only where it is asked for.

Each task attempt writes a shard of its own, so a retried task never touches
another's file; rows refer only to shards of attempts that succeeded, and ``sweep``
removes the others. A task stores a payload once while it remembers it (SEEN
payloads). Across shards, all rows of one digest refer
to one place, chosen after the light index is written, so equal payloads have
equal values without moving the payloads themselves.

Defined results: a null text is an empty payload; repeated rows share a place;
an empty table gives an empty result; other columns are kept, and columns named
like the outputs are replaced. The shared folder is opened with pyarrow's file
systems, so a local mount and the object stores that pyarrow knows all do.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNIT = 576
PAD = b"\xff"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and IHDR chunk: all that the metadata columns need.
HEADER_BYTES = 33
LEVEL = 6
#: Payloads that a task remembers, to store copies once.
SEEN = 100_000
PLACE = "digest string, shard string, offset long, length long"


def pad(data: bytes) -> bytes:
    n = max(1, -(-len(data) // UNIT)) * UNIT
    return data + PAD * (n - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Rows of UNIT grey samples, without line filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header_of(data: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a PNG's first HEADER_BYTES."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or struct.unpack(">I", data[29:33])[0] != zlib.crc32(data[12:29]):
        raise ValueError("not the header of a PNG")
    width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", data[16:29])
    if colour:
        raise ValueError("not greyscale")
    return width, height, depth


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` made; every chunk's checksum is checked."""
    width, height, _ = header_of(data[:HEADER_BYTES])
    at, parts = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("line filters are not in use here")
    return lines[:, 1:].tobytes()


class TarShard:
    """An append-only tar of objects named by digest; tells where each object's bytes begin."""

    def __init__(self, root: str):
        store, path = fs.FileSystem.from_uri(root)
        self.name = f"shard-{uuid.uuid4().hex}.tar"
        store.create_dir(path, recursive=True)
        self.out = store.open_output_stream(f"{path}/{self.name}")
        self.at = 0

    def add(self, digest: str, data: bytes) -> tuple[int, int]:
        """Offset and length of the object's bytes."""
        info = tarfile.TarInfo(digest)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + b"\0" * (-len(data) % tarfile.BLOCKSIZE))
        begin = self.at + len(head)
        self.at = begin + len(data) + -len(data) % tarfile.BLOCKSIZE
        return begin, len(data)

    def close(self) -> None:
        self.out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
        self.out.close()


class TarReader:
    """Range reads from the shards below a root; keeps the last shard open."""

    def __init__(self, root: str):
        self.store, self.path = fs.FileSystem.from_uri(root)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.close()
            self.name, self.file = shard, self.store.open_input_file(f"{self.path}/{shard}")
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def store(rows: DataFrame, text: str, root: str) -> DataFrame:
    """Stores each row's payload; the rows without ``text``, with n_bytes, digest, shard, offset and length.

    The index is written once, below ``root``, so no payload is stored again
    when the result is used more than once.
    """
    kept = [f for f in rows.columns if f not in (text, "n_bytes", "digest", "shard", "offset", "length")]
    schema = rows.select(*kept).schema.add("n_bytes", "long").add("digest", "string").add("shard", "string").add("offset", "long").add("length", "long")
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen = None, {}
        for batch in common.slices(batches):
            made = []
            for value in batch.column("__text"):
                data = (value.as_py() or "").encode()
                shard = shard or TarShard(root)
                # a repeated payload is neither encoded nor stored again
                if (key := hashlib.sha256(data).digest()) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    png = to_png(pad(data))
                    digest = hashlib.sha256(png).hexdigest()
                    seen[key] = (digest, *shard.add(digest, png))
                digest, offset, length = seen[key]
                made.append((len(data), digest, shard.name, offset, length))
            columns = zip(*made, strict=True) if made else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=names)
        if shard:
            shard.close()

    index = common.map_batches(rows.select(*kept, F.col(text).alias("__text")), run, schema)
    index.write.parquet(f"{root}/index")
    index = rows.sparkSession.read.schema(schema).parquet(f"{root}/index")
    place = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("__at"))
    return index.select(*kept, "n_bytes", "digest").join(place, "digest").select(*kept, "n_bytes", "digest", "__at.shard", "__at.offset", "__at.length")


def places(index: DataFrame) -> DataFrame:
    """One row for each stored object in use, in reading order within partitions."""
    spots = index.select("digest", "shard", "offset", "length").distinct()
    return spots.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")


def headers(index: DataFrame, root: str) -> DataFrame:
    """(digest, width, height, depth) of every object, by range reads of headers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TarReader(root)
        for batch in batches:
            rows = batch.to_pylist()
            made = [header_of(reader.read(r["shard"], r["offset"], min(HEADER_BYTES, r["length"]))) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *[pa.array([m[i] for m in made], pa.int32()) for i in range(3)]], names=["digest", "width", "height", "depth"])
        reader.close()

    return common.map_batches(places(index), run, "digest string, width int, height int, depth int")


def features(index: DataFrame, root: str) -> DataFrame:
    """What the stored bytes say, read back and decoded; one row per object, whose digest is the SHA-256 of the bytes read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TarReader(root)
        for batch in common.slices(batches):
            made = []
            for r in batch.to_pylist():
                data = reader.read(r["shard"], r["offset"], r["length"])
                if (digest := hashlib.sha256(data).hexdigest()) != r["digest"]:
                    raise ValueError(f"{r['shard']} holds {digest} at {r['offset']}, not {r['digest']}")
                payload = from_png(data)
                samples = np.frombuffer(payload, np.uint8)
                low = int(np.count_nonzero(samples < 128))
                feature = f"sum={int(samples.sum(dtype=np.int64))};max={int(samples.max())};ascii={low}"
                made.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            columns = zip(*made, strict=True) if made else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])
        reader.close()

    return common.map_batches(places(index), run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def sweep(index: DataFrame, root: str) -> list[str]:
    """Removes the shards that no row refers to, as failed attempts leave them; returns their names."""
    store, path = fs.FileSystem.from_uri(root)
    # one name for each task that wrote
    used = {r["shard"] for r in index.select("shard").distinct().collect()}
    gone = [f for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".tar") and f.base_name not in used]
    for f in gone:
        store.delete_file(f.path)
    return sorted(f.base_name for f in gone)


def members(data: bytes) -> dict[str, bytes]:
    """The objects of a whole tar shard, for checks with any tar reader."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar.getmembers()}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = common.fresh_dir(spark, "media")
    index = store(common.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", root)
    out = index.join(features(index, root), "digest").join(headers(index, root), "digest")
    size = F.concat(F.lit("png:"), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"), F.col("depth").cast("string")))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), F.col("digest").alias("media_sha256"),
        F.concat_ws(";", size, "feature").alias("feature"), "digest", "shard", "offset", "length",
    )
