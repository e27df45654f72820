"""An approximate vector index: coarse cells, residual codes, exact scores of what they find.

Centres of cells and the codebooks of residuals are trained on a bounded sample
(SAMPLE vectors, fewer if they are long); every vector is indexed. The table is
partitioned by cell, so a search reads the folders of the cells that its queries
probe. A task reads CHUNK_BYTES of vectors at a time, keeps the MORE * k best by code
of each query among these, scores them exactly from their vectors and passes on k.

How many cells a query probes is measured while training: as many as hold WANTED of
the nearest sampled vectors of sampled queries. Scores are cosine similarities. Null,
empty and zero vectors, those with null or non-finite components and those of
another length than most are not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.functions.ship import ship

from .bm25 import ranked

SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
#: Cells at most, as each is a folder; vectors of a cell on average, if there may be so many cells.
CELLS, PER_CELL = 4096, 64
ROUNDS, WORDS = 12, 256
#: Share of the nearest vectors that the probed cells should hold, and sampled queries by which that is measured.
WANTED, MEASURED = 0.97, 400
#: Candidates by code for each result.
MORE = 40
#: Bytes of query vectors that a pass sends to all tasks.
PASS_BYTES = 32 << 20
#: Bytes of the vectors that a task holds at a time; products of queries and vectors, or components, in one array.
CHUNK_BYTES, TILE = 16 << 20, 4 << 20
#: What orders equal codes by id, as a share of a cosine similarity; far above the rounding of products, far below that of codes.
TIE = 1e-9


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def means(x: np.ndarray, many: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of ``many`` groups of the rows, by Lloyd's rounds; empty groups take rows far from their centre."""
    centre = x[rng.choice(len(x), min(many, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near, gap = nearest(x, centre)
        n = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = total / np.maximum(n, 1)[:, None]
        empty = np.flatnonzero(n == 0)
        centre[empty] = x[np.argsort(-gap, kind="stable")[: len(empty)]]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row and its squared distance, in blocks."""
    of, gap = np.empty(len(x), np.int64), np.empty(len(x))
    half = (centre * centre).sum(1) / 2
    step = max(1, (1 << 22) // len(centre))
    for i in range(0, len(x), step):
        part = x[i : i + step] @ centre.T - half
        of[i : i + step] = part.argmax(1)
        gap[i : i + step] = (x[i : i + step] ** 2).sum(1) - 2 * part.max(1)
    return of, gap


@dataclass(frozen=True)
class Trained:
    """centres of the cells; books: for each part of a residual its codewords; probes: cells of a query."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int

    @property
    def length(self) -> int:
        return self.centres.shape[1]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, np.cumsum([b.shape[1] for b in self.books])[:-1], axis=1)

    def codes(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.stack([nearest(p, b)[0] for p, b in zip(self.parts(x - self.centres[of]), self.books, strict=True)], 1).astype(np.uint8)

    def decoded(self, codes: np.ndarray, of: np.ndarray) -> np.ndarray:
        return self.centres[of] + np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        order = -(q @ self.centres.T - (self.centres**2).sum(1) / 2)
        return np.argsort(order, axis=1, kind="stable")[:, :probes]


def train(sample: np.ndarray, cells: int, k: int = 5, seed: int = 7) -> Trained:
    rng = np.random.default_rng(seed)
    centres = means(sample, cells, rng)
    of, _ = nearest(sample, centres)
    rest = sample - centres[of]
    widths = np.full(min(16, sample.shape[1]), sample.shape[1] // min(16, sample.shape[1]))
    widths[: sample.shape[1] - widths.sum()] += 1
    books = [means(p, WORDS, rng) for p in np.split(rest, np.cumsum(widths)[:-1], axis=1)]
    made = Trained(centres, books, len(centres))
    asked = rng.choice(len(sample), min(MEASURED, len(sample)), replace=False)
    near = np.argsort(-(sample[asked] @ sample.T), axis=1, kind="stable")[:, 1 : k + 1]
    place = np.empty((len(asked), len(centres)), np.int64)
    np.put_along_axis(place, made.probed(sample[asked], len(centres)), np.arange(len(centres))[None, :], 1)
    at = np.take_along_axis(place, of[near], 1).ravel()
    return Trained(centres, books, int(np.quantile(at, WANTED, method="higher")) + 1 if len(at) else len(centres))


class CellIndex:
    """The table at ``path``: id, code, v, partitioned by cell."""

    def __init__(self, spark: SparkSession, path: str, trained: Trained):
        self.spark, self.path, self.trained = spark, path, trained

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> CellIndex:
        spark = vectors.sparkSession
        rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull()).where(usable(F.col("v")))
        sizes = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
        if sizes is None:
            raise ValueError("no vectors to index")
        rows = rows.where(F.size("v") == sizes["length"])
        many = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * sizes["length"])))
        share = min(1.0, 2.0 * many / sizes["n"])
        sample = _matrix(rows.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(1_000_000 * share)).orderBy(F.xxhash64("v", F.lit(1)), "id").limit(many).toArrow()["v"])
        made = train(sample, cells or max(1, min(CELLS, sizes["n"] // PER_CELL, int(sizes["n"] ** 0.5) + 1)))
        sent = spark.sparkContext.broadcast(made)
        kind = rows.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("v"))
                    of, _ = nearest(x, sent.value.centres)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32)), pa.array([c.tobytes() for c in sent.value.codes(x, of)], pa.binary())], names=["id", "v", "cell", "code"])

        ship(spark)
        # a cell of very many vectors is dealt to several tasks
        rows.mapInArrow(run, f"id {kind}, v array<double>, cell int, code binary").repartitionByRange("cell", "id").write.partitionBy("cell").parquet(path)
        return cls(spark, path, made)

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank) of a table of queries (query_id, q); a query's own id is not left out."""
        probes = min(probes or self.trained.probes, len(self.trained.centres))
        asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where(F.col("query_id").isNotNull()).where(usable(F.col("q"))).where(F.size("q") == self.trained.length)
        passes = -(-asked.count() * 8 * self.trained.length // PASS_BYTES) or 1
        out = None
        for i in range(passes):
            found = self._pass(asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i), k, probes)
            out = found if out is None else out.unionByName(found)
        return out

    def _pass(self, asked: DataFrame, k: int, probes: int) -> DataFrame:
        got = asked.toArrow().combine_chunks()
        q = _matrix(got["q"]) if got.num_rows else np.zeros((0, self.trained.length))
        n = len(self.trained.centres)
        # a bit for each query and cell; queries with one nearest cell stand side by side
        bits, first, step = np.empty((len(q), -(-n // 8)), np.uint8), np.empty(len(q), np.int64), max(1, TILE // n)
        for i in range(0, len(q), step):
            cells = self.trained.probed(q[i : i + step], probes)
            some = np.zeros((len(cells), n), bool)
            np.put_along_axis(some, cells, True, 1)
            bits[i : i + step], first[i : i + step] = np.packbits(some, axis=1), cells[:, 0]
        order = np.argsort(first, kind="stable")
        probed = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, axis=0), count=n)).tolist()
        ids = got["query_id"].combine_chunks()
        sent = self.spark.sparkContext.broadcast((self.trained, ids.take(pa.array(order)), q[order], bits[order]))
        # small files are read by as many tasks as run at a time; what a task passes on grows with its chunks
        rows = self.table().where(F.col("cell").isin(*probed)).select("cell", "id", "code", "v").coalesce(2 * self.spark.sparkContext.defaultParallelism)
        more, size = MORE * k, max(1, CHUNK_BYTES // (8 * self.trained.length))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made, names, vectors, probes = sent.value
            for chunk in _chunks(batches, size):
                found = chunk["id"].combine_chunks()
                for at, row, score in _nearest_of(chunk, made, vectors, probes, more, k):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), found.take(pa.array(row)), pa.array(score)], names=["query_id", "id", "score"])

        ship(self.spark)
        kinds = asked.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
        return ranked(rows.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double"), k)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of so many rows, each sorted by cell and id."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == size:
                yield pa.Table.from_batches(held).sort_by([("cell", "ascending"), ("id", "ascending")])
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).sort_by([("cell", "ascending"), ("id", "ascending")])


def _nearest_of(chunk: pa.Table, made: Trained, vectors: np.ndarray, probes: np.ndarray, more: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of queries, rows of the chunk, scores): the k best rows of each query, by exact scores of the ``more`` best by code."""
    cell = chunk["cell"].to_numpy()
    of, starts = np.unique(cell, return_index=True)
    starts = np.append(starts, len(cell))
    v = _matrix(chunk["v"])
    codes = np.frombuffer(b"".join(chunk["code"].to_pylist()), np.uint8).reshape(len(cell), -1)
    # equal codes give equal products but for rounding: one more component puts the smaller id first
    near = np.column_stack([made.decoded(codes, cell), np.arange(len(cell)) * (-TIE / len(cell))])
    rank = np.empty(len(cell), np.int64)
    rank[pc.sort_indices(chunk["id"]).to_numpy()] = np.arange(len(cell))
    step = max(1, TILE // len(cell))
    for i in range(0, len(vectors), step):
        some = np.unpackbits(probes[i : i + step], axis=1, count=len(made.centres)).astype(bool)[:, of]
        own = np.flatnonzero(some.any(0))
        if not len(own):
            continue
        at = np.flatnonzero(some[:, own].any(1))
        some, q = some[at], vectors[i + at]
        every = len(own) == len(of)
        rows = None if every else np.concatenate([np.arange(starts[c], starts[c + 1]) for c in own])
        about = np.column_stack([q, np.ones(len(q))]) @ (near if every else near[rows]).T
        begin = 0
        for c in own:
            end = begin + starts[c + 1] - starts[c]
            if not some[:, c].all():
                about[~some[:, c], begin:end] = -np.inf
            begin = end
        if about.shape[1] > more:
            keep = np.argpartition(about, about.shape[1] - more, axis=1)[:, -more:]
        else:
            keep = np.broadcast_to(np.arange(about.shape[1]), about.shape)
        out = np.take_along_axis(about, keep, 1) == -np.inf
        keep = keep if every else rows[keep]
        score = np.empty(keep.shape)
        few = max(1, TILE // (keep.shape[1] * v.shape[1]))
        for j in range(0, len(keep), few):
            score[j : j + few] = np.einsum("ijk,ik->ij", v[keep[j : j + few]], q[j : j + few])
        score = np.round(np.clip(score, 0.0, 1.0), 6)
        score[out] = -np.inf
        top = np.lexsort((rank[keep], -score), axis=1)[:, :k]
        score, keep = np.take_along_axis(score, top, 1), np.take_along_axis(keep, top, 1)
        found = score > -np.inf
        yield i + at[np.nonzero(found)[0]], keep[found], score[found]
