"""The approximate vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry.operators import cells, vector

rng = np.random.default_rng(3)


@pytest.fixture(scope="module")
def vectors(spark):
    centres = rng.normal(0, 1, (30, 12))
    rows = [(i, (centres[i % 30] + rng.normal(0, 0.4, 12)).tolist()) for i in range(3000)]
    odd = [(9001, None), (9002, [0.0] * 12), (9003, [1.0] * 3), (9004, [None, *[1.0] * 11]), (9005, [float("nan")] * 12), (None, [1.0] * 12)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return cells.CellIndex.build(vectors, f"file://{tmp_path_factory.mktemp('cells')}/t")


def asked(vectors):
    return vectors.where("vec_id % 20 = 0 or vec_id > 9000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def test_every_usable_vector_is_indexed(vectors, index):
    assert {r.id for r in index.table().select("id").collect()} == set(range(3000))


@pytest.mark.parametrize("size", [None, 2000])
def test_recall_and_exact_scores(vectors, index, monkeypatch, size):
    if size:
        monkeypatch.setattr(cells, "PASS_BYTES", size)
    found = {(r.query_id, r.id): r.score for r in index.search(asked(vectors), 5).collect()}
    exact = {(r.query_id, r.id): r.score for r in vector.batch(vectors.where("vec_id < 3000"), asked(vectors).where("query_id < 3000"), 5).collect()}
    assert len(exact) == 750 and len(found) == 750
    assert len(found.keys() & exact.keys()) >= 0.9 * 750
    assert all(abs(found[x] - exact[x]) < 1e-6 for x in found.keys() & exact.keys())


def test_only_probed_cells_are_read(vectors, index):
    one = asked(vectors).where("query_id = 40")
    plan = index.search(one, 5, probes=2)._jdf.queryExecution().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line and "cell" in line]
    assert filters and all("cell#" in f.split("PartitionFilters:")[1] and " IN (" in f.split("PartitionFilters:")[1] for f in filters)
    assert index.trained.probes < len(index.trained.centres)


def test_few_vectors(spark, tmp_path):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1])], "vec_id long, embedding array<float>")
    made = cells.CellIndex.build(few, f"file://{tmp_path}/t")
    found = made.search(few.selectExpr("vec_id query_id", "embedding q"), 2).collect()
    assert sorted((r.query_id, r.id) for r in found) == [(1, 1), (1, 3), (2, 2), (2, 3), (3, 1), (3, 3)]
    with pytest.raises(ValueError, match="no vectors"):
        cells.CellIndex.build(few.limit(0), f"file://{tmp_path}/none")


def test_of_many_copies_the_smallest_ids_are_found(spark, tmp_path):
    one, rest = rng.normal(0, 1, 8).tolist(), rng.normal(0, 1, (500, 8)).tolist()
    rows = [(i, one) for i in rng.permutation(4000).tolist()] + [(10_000 + i, v) for i, v in enumerate(rest)]
    copies = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    made = cells.CellIndex.build(copies, f"file://{tmp_path}/t")
    found = made.search(spark.createDataFrame([("a", one)], "query_id string, q array<double>"), 5).collect()
    assert [(r.query_id, r.id, r.score, r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [("a", i, 1.0, i + 1) for i in range(5)]


def test_a_chunk_at_a_time_gives_the_same(vectors, index, monkeypatch):
    whole = {tuple(r) for r in index.search(asked(vectors), 5, probes=len(index.trained.centres)).collect()}
    monkeypatch.setattr(cells, "CHUNK_BYTES", 8 * 12 * 150)
    exact = {tuple(r)[:2] for r in vector.batch(vectors.where("vec_id < 3000"), asked(vectors).where("query_id < 3000"), 5).collect()}
    pieces = {tuple(r) for r in index.search(asked(vectors), 5, probes=len(index.trained.centres)).collect()}
    assert len(whole) == len(pieces) == 750
    # chunks of under MORE * k rows are scored whole
    assert {r[:2] for r in pieces} == exact and len(whole & pieces) >= 0.95 * 750


def test_many_queries_need_little_memory_of_a_task(spark, vectors, index):
    """Before, each task held for every query what each of 256 codewords of 12 components adds: 492 MB here."""

    def peak(_):
        import resource
        import time

        import pandas as pd

        time.sleep(0.5)  # on every worker
        yield pd.DataFrame({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024]})

    most = lambda: max(r.mb for r in spark.range(0, 4, 1, 4).mapInPandas(peak, "mb double").collect())
    many = vectors.where("vec_id < 2000").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"), F.col("embedding").alias("q")).selectExpr("vec_id * 10 + i query_id", "q")
    before = most()
    assert index.search(many, 5, probes=2).groupBy().count().first()[0] == 100_000
    assert most() - before < 300


def test_recall_counts_the_smallest_ids_of_many_copies(spark, tmp_path):
    from fathomry.plans import catalog

    one, rest = rng.normal(0, 1, 8).tolist(), rng.normal(0, 1, (500, 8)).tolist()
    rows = [(i, one) for i in rng.permutation(4000).tolist()] + [(10_000 + i, v) for i, v in enumerate(rest)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert tuple(catalog.vector_cells_recall(spark, str(tmp_path)).first()) == (225, 1125, True)
