"""Exact vector search for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.functions import scores
from fathomry.functions.ship import ship

from .bm25 import ranked

#: Queries whose vectors travel together; larger batches take several passes.
BLOCK = 512
#: Bytes of query vectors that a pass of ``batch`` sends to all tasks; queries and vectors in one product.
PASS_BYTES, ASKED, TILE = 32 << 20, 1024, 4096


def search(vectors: DataFrame, queries: list[tuple], k: int = 5, metric: str = "cosine", threshold: float | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) for a stated batch of (query id, vector).

    Each block of queries is one literal, so vectors are read once per block
    and never meet each other; ranks are limited before the exchange.
    """
    if metric not in scores.METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(scores.METRICS)}")
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    out = None
    for i in range(0, len(queries), BLOCK):
        asked = F.array(*[F.struct(F.lit(q).alias("query_id"), F.array(*[F.lit(float(x)) for x in v]).alias("q")) for q, v in queries[i : i + BLOCK]])
        each = rows.select("id", "v", F.explode(asked).alias("a")).where(F.size("a.q") == F.size("v"))
        score = scores.similarity(scores.distance(F.col("v"), F.col("a.q"), metric), metric)
        found = ranked(each.select("a.query_id", "id", score.alias("score")).where("score is not null"), k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no queries")
    return out if threshold is None else out.where(F.col("score") >= threshold)


def _best(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Similarities of all queries and vectors, rounded as ``ranked`` rounds."""
    product = q @ v.T
    if metric == "inner_product":
        out = np.maximum(product, 0.0)
    elif metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.clip(product / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]), 0.0, 1.0)
    else:
        square = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * product
        out = 1 / (1 + np.sqrt(np.maximum(square, 0.0)))
    return np.round(out, 6)


def _stacked(ids: pa.Array, column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, matrix) of the vectors of each length; null components are not numbers."""
    sizes = column.value_lengths().fill_null(0).to_numpy()
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = pa.array(np.flatnonzero(sizes == n))
        yield n, ids.take(at).to_numpy(zero_copy_only=False), column.take(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _kept(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query (by number), ties to the smaller id."""
    order = np.lexsort((ids, -score, at))
    at, ids, score = at[order], ids[order], score[order]
    top = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[top], ids[top], score[top]


def batch(vectors: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) for a table of queries (query_id, q) of any number; a query's own id is not left out.

    Queries travel in passes of PASS_BYTES, each of which reads the vectors once.
    A task multiplies ASKED queries by TILE vectors at a time and passes on k rows per query. Ids are
    longs. Queries and vectors of different lengths do not meet; null ones, and those with null or
    NaN components, take no part.
    """
    if metric not in scores.METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(scores.METRICS)}")
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where("query_id is not null and q is not null")
    size = asked.agg(F.sum(8 * F.size("q"))).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    out = None
    for i in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
        found = _pass(rows, part, k, metric)
        out = found if out is None else out.unionByName(found)
    return ranked(out, k)


def _pass(rows: DataFrame, asked: DataFrame, k: int, metric: str) -> DataFrame:
    spark = rows.sparkSession
    got = asked.toArrow().combine_chunks()
    by_length = {n: (ids, q) for n, ids, q in _stacked(got["query_id"].combine_chunks(), got["q"].combine_chunks())} if got.num_rows else {}
    sent = spark.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple] = {}
        for each in batches:
            for n, ids, v in _stacked(each.column("id"), each.column("v")):
                if n not in sent.value:
                    continue
                q = sent.value[n][1]
                for i in range(0, len(v), TILE):
                    for j in range(0, len(q), ASKED):
                        score = _best(q[j : j + ASKED], v[i : i + TILE], metric)
                        score[np.isnan(score)] = -np.inf
                        least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
                        at, col = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                        new = (at, ids[i + col], score[at, col])
                        old = best.get((n, j))
                        best[n, j] = _kept(*(new if old is None else map(np.concatenate, zip(old, new, strict=True))), k)
        for (n, j), (at, ids, score) in best.items():
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(sent.value[n][0][j + at]), pa.array(ids), pa.array(score)], names=["query_id", "id", "score"])

    ship(spark)
    kind = asked.schema["query_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"query_id {kind}, id long, score double")


def compatible(stored: dict, given: dict) -> None:
    """Vectors of different models are never compared."""
    for name in ("dimensions", "provider", "model"):
        if stored.get(name) != given.get(name):
            raise ValueError(f"{name} of the index is {stored.get(name)!r}, of the query {given.get(name)!r}")
