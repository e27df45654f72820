"""Exact top-k search by inner product with a three-phase uniform threshold.

A score is the sum of SEGMENTS partial scores, one for each run of components;
a partial score list belongs to a tile of candidates and a segment.

1. tasks gather the best entries of the local lists of one in SHARE candidates,
   chosen by a hash of the id; the k best per query and tile go on;
2. the k-th best of those is a safe cutoff: no answer scores less. An entry can
   reach it only if one of its partial scores reaches cutoff / SEGMENTS, and if
   the segments seen so far and the longest that the last one can be (by the
   lengths of both its vectors) reach the cutoff. All tiles collect just these
   entries: for all others the last segment is never computed;
3. their scores are resolved exactly, and the k best per query and tile meet in
   a last ranking by query.

Queries lie in a table in the shared folder, with their cutoffs in the second
pass. A task reads it in blocks of BLOCK rows for each tile of its candidates, so
neither the driver nor a broadcast holds them, memory is bounded by a tile and a
block, and the plan is the same for any number of queries. Nothing is
approximated.

Defined results: vectors that are null, hold a null or a component that is not
finite, or have a null id, take no part; only vectors of equal length are
compared; repeated ids count once, with their best score; ties go to the
smaller id; an empty table gives an empty result; other columns are ignored.
Components of any size are multiplied exactly; scores beyond a long are taken as
the largest or smallest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SEGMENTS = 4
#: One in so many candidates takes part in the first phase.
SHARE = 16
#: Queries of a block, candidates of a tile, and scores in one matrix at a time.
BLOCK, ROWS, TILE = 4096, 1 << 16, 1 << 21
FOUND = "query_id long, vec_id long, score long"
LARGEST, SMALLEST = (1 << 63) - 1, -(1 << 63)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where("id is not null and v is not null").where(~bad)


def _matrix(column: pa.ListArray, length: int) -> np.ndarray:
    """floor(256 * x): as doubles, or as integers where doubles would not hold it."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length) if length else np.zeros((len(column), 0))
    if np.abs(x).max(initial=0) < 2.0**44:
        return np.floor(256 * x)
    return np.array([[math.floor(256 * c) if abs(c) < 2.0**44 else 256 * int(c) for c in row] for row in x], object)


def _by_length(ids: np.ndarray, column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield int(n), ids[at], _matrix(column.take(pa.array(at)), int(n))


def _kept(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best ids of every query, each id once."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    if not len(q):
        return q, ids, scores
    # of an id's rows for a query the best comes first
    back = np.lexsort((np.arange(len(q)), ids, q))
    first = np.ones(len(q), bool)
    first[1:] = (q[back][1:] != q[back][:-1]) | (ids[back][1:] != ids[back][:-1])
    keep = np.zeros(len(q), bool)
    keep[back[first]] = True
    q, ids, scores = q[keep], ids[keep], scores[keep]
    start = np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], np.arange(len(q)), 0))
    top = np.arange(len(q)) - start < k
    return q[top], ids[top], scores[top]


def _whole(queries: np.ndarray, rows: np.ndarray) -> np.ndarray | None:
    """Scores of all pairs in integers of any size, where doubles may not be exact; else None."""
    top = max(1, int(np.abs(queries).max(initial=0))) * max(1, int(np.abs(rows).max(initial=0))) * max(1, queries.shape[1])
    if top < 2**53:
        return None
    as_int = np.vectorize(int, otypes=[object])
    scores = as_int(queries) @ as_int(rows).T if queries.shape[1] else np.zeros((len(queries), len(rows)), object)
    return np.clip(scores, SMALLEST, LARGEST).astype(np.int64)


def _edges(n: int) -> list[int]:
    return [round(n * i / SEGMENTS) for i in range(SEGMENTS + 1)]


def _local_best(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: (query, row, score) of the best entries of each segment's list."""
    edges = _edges(queries.shape[1])
    parts = [queries[:, i:j] @ rows[:, i:j].T for i, j in zip(edges, edges[1:], strict=False)]
    m = min(k + 1, len(rows))  # one more, as a query's own row does not count
    to = np.concatenate([np.argpartition(-p, m - 1, axis=1)[:, :m] for p in parts], axis=1)
    at = np.repeat(np.arange(len(queries)), to.shape[1])
    return at, to.ravel(), sum(p[at, to.ravel()] for p in parts)


def _sufficient(queries: np.ndarray, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: (query, row, score) of all entries that reach their query's cutoff."""
    edges = _edges(queries.shape[1])
    last = edges[-2]
    # the longest that the last segment can be, rounded up
    rest = np.outer(np.linalg.norm(queries[:, last:], axis=1), np.linalg.norm(rows[:, last:], axis=1)) * (1 + 1e-9) + 1e-6
    bar = (least / SEGMENTS)[:, None]
    near = rest >= bar
    seen = np.zeros(near.shape)
    for i, j in zip(edges[:-2], edges[1:-1], strict=True):
        part = queries[:, i:j] @ rows[:, i:j].T
        near |= part >= bar
        seen += part
    at, to = np.nonzero(near & (seen + rest >= least[:, None]))
    score = seen[at, to] + np.einsum("ij,ij->i", queries[at, last:], rows[to, last:])
    enough = score >= least[at]
    return at[enough], to[enough], score[enough]


def _blocks(root: str) -> Iterator[pa.RecordBatch]:
    store, path = fs.FileSystem.from_uri(root)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
    for f in files:
        with store.open_input_file(f) as opened:
            yield from pq.ParquetFile(opened).iter_batches(BLOCK)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            if n + part.num_rows > ROWS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _scan(root: str, k: int, first: bool):
    """Makes the function for tasks: phase 1, or phases 2 and 3 with the queries' cutoffs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            all_rows = {n: (ids, rows) for n, ids, rows in _by_length(tile.column("id").to_numpy(zero_copy_only=False), tile.column("v"))}
            for asked in _blocks(root):
                bars = None if first else asked.column("cutoff").to_numpy(zero_copy_only=False)
                places = np.arange(asked.num_rows)
                for n, at_q, queries in _by_length(places, asked.column("v")):
                    if n not in all_rows:
                        continue
                    qids, (ids, rows) = asked.column("id").to_numpy(zero_copy_only=False)[at_q], all_rows[n]
                    least = None if first else bars[at_q]
                    step = max(1, TILE // len(qids))
                    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                    for i in range(0, len(ids), step):
                        part = rows[i : i + step]
                        scores = _whole(queries, part)
                        if scores is not None:
                            at, to = np.divmod(np.arange(scores.size), len(part))
                            score = scores.ravel()
                        elif first:
                            at, to, score = _local_best(queries.astype(float), part.astype(float), k)
                        else:
                            at, to, score = _sufficient(queries.astype(float), part.astype(float), least)
                        own = qids[at] != ids[i + to]
                        more = (qids[at][own], ids[i + to][own], score[own].astype(np.int64))
                        held = _kept(*[np.concatenate(x) for x in zip(held, more, strict=True)], k)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held], names=["query_id", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row for which ``is_query`` holds."""
    root = common.fresh_dir(vectors.sparkSession, "queries")
    rows = usable(vectors, key, vector)
    asked = usable(vectors.where(is_query), key, vector).distinct()
    asked.write.parquet(f"{root}/asked")
    share = rows.where(F.pmod(F.xxhash64("id"), F.lit(SHARE)) == 0)
    first = _ranked(common.map_batches(share, _scan(f"{root}/asked", k, True), FOUND), k)
    # a query's vectors share one cutoff
    cutoffs = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("cutoff"))
    asked = vectors.sparkSession.read.schema("id long, v array<double>").parquet(f"{root}/asked")
    asked.join(cutoffs, "id", "left").select("id", "v", F.coalesce("cutoff", F.lit(float("-inf"))).alias("cutoff")).write.parquet(f"{root}/bars")
    found = _ranked(common.map_batches(rows, _scan(f"{root}/bars", k, False), FOUND), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_inner_product(q.v, c.v) AS BIGINT)) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
