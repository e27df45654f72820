"""Files in any case and place, increments, restores, jobs and plans."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomry.operators import bm25, explain, jobs, stats, vector
from fathomry.plans.request import QueryRequest
from fathomry.plans.search import Corpus, search
from fathomry.sources import files, tables


def test_files_in_any_case_and_alone(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("README.MD", "sub/X.PY", "sub/a.md", "sub/skip.bin"):
        (tmp_path / name).write_text(f"# {name}")
    rows = {r["file_name"]: r for r in files.load(spark, str(tmp_path)).collect()}
    assert set(rows) == {"README.MD", "X.PY", "a.md"} and rows["X.PY"]["source_type"] == "code"
    assert {r["relative"] for r in files.list_files(spark, str(tmp_path)).collect()} == {"README.MD", "sub/X.PY", "sub/a.md", "sub/skip.bin"}
    alone = files.load(spark, str(tmp_path / "sub" / "a.md")).collect()
    assert [r["text"] for r in alone] == ["# sub/a.md"]
    assert [r["relative"] for r in files.list_files(spark, str(tmp_path / "sub" / "a.md")).collect()] == ["a.md"]


def test_only_changed_files_are_hashed(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.md").write_text(str(i))
    known = spark.createDataFrame(files.checksums(spark, str(tmp_path)).toPandas())
    # a checksum that is kept although the text differs shows that the file was not read
    marked = known.withColumn("checksum", F.concat(F.lit("old-"), "checksum"))
    assert all(r["checksum"].startswith("old-") for r in files.checksums(spark, str(tmp_path), marked).collect())
    (tmp_path / "1.md").write_text("new")
    os.utime(tmp_path / "1.md", (1, 1))
    found = {os.path.basename(r["file_path"]): r["checksum"] for r in files.checksums(spark, str(tmp_path), marked).collect()}
    assert [found[f"{i}.md"].startswith("old-") for i in range(3)] == [True, False, True]
    # the same law if all but one changed: who kept its time keeps its checksum, though it lies between them
    os.utime(tmp_path / "0.md", (2, 2))
    moved = marked.withColumn("mtime", F.when(F.col("file_path").endswith("0.md"), F.lit(2.0)).otherwise(F.lit(-1.0)))
    os.utime(tmp_path / "2.md", (9, 9))
    found = {os.path.basename(r["file_path"]): r["checksum"] for r in files.checksums(spark, str(tmp_path), moved).collect()}
    assert [found[f"{i}.md"].startswith("old-") for i in range(3)] == [True, False, False]


def test_snapshots_are_restored(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType())])
    kept = tables.Snapshots(spark, str(tmp_path / "s"), schema)
    assert kept.plan_restore() is None and kept.restore() is None and kept.read().count() == 0
    first = kept.write(spark.range(2).select(F.col("id").alias("a")))
    second = kept.write(spark.range(5).select(F.col("id").alias("a")))
    assert kept.plan_restore() == second and schema.names == ["a"]
    kept.restore(first)
    assert kept.read().count() == 2 and schema.names == ["a"]
    bad = kept.list()[-1]
    for part in (tmp_path / "s" / bad).glob("part*"):
        part.write_text("{broken")
    for crc in (tmp_path / "s" / bad).glob(".part*.crc"):
        crc.unlink()
    assert kept.plan_restore() == second and kept.read().count() == 5
    with pytest.raises(ValueError, match="no version"):
        kept.restore("v0")


def test_last_row_of_a_batch_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, n int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 4)], "chunk_id string, n int").coalesce(1)
    assert sorted(tuple(r) for r in tables.upsert(old, new).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    changed = tables.update_column(old, spark.createDataFrame([("b", None), ("z", 9)], "chunk_id string, n int"), "n")
    assert sorted(tuple(r) for r in changed.collect()) == [("a", 1), ("b", None)]


def test_jobs_move_time_out_and_compact(spark, tmp_path):
    rows = [("a", "pending"), ("b", "running"), ("c", "done"), ("d", "running")]
    frame = spark.createDataFrame(rows, "job_id string, status string").withColumns({"started_at": F.timestamp_seconds(F.lit(0)), "error": F.lit(None).cast("string")})
    moves = spark.createDataFrame([("a", "done"), ("b", "done"), ("c", "running"), ("d", "pending"), ("x", "done")], "job_id string, to string")
    out = {r["job_id"]: (r["status"], r["accepted"]) for r in jobs.transition(frame, moves).collect()}
    assert out == {"a": ("pending", False), "b": ("done", True), "c": ("done", False), "d": ("pending", True)}
    late = {r["job_id"]: r["status"] for r in jobs.time_out(frame, F.timestamp_seconds(F.lit(7200))).collect()}
    assert late == {"a": "pending", "b": "failed", "c": "done", "d": "failed"}
    log, schema = str(tmp_path / "log"), "job_id string, seq int, status string"
    for i in range(3):
        jobs.append(spark.createDataFrame([("a", i, f"s{i}")], schema), log)
    assert not jobs.compact(spark, log, schema, str(tmp_path / "none"), every=3)
    assert jobs.compact(spark, log, schema, str(tmp_path / "small"), every=2)
    assert [tuple(r) for r in spark.read.schema(schema).json(str(tmp_path / "small")).collect()] == [("a", 2, "s2")]


def test_ranks_are_limited_before_the_exchange(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} common text") for i in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([("q", "common word3")], "query_id string, query string")
    found = bm25.Index.build(docs).search(asked, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Final" in plan and "Partial" in plan
    assert [r["id"] for r in found.orderBy("rank").collect()] == [3, 10, 17]


def test_saved_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "doc_id long, text string")
    bm25.Index.build(docs).save(str(tmp_path / "i"))
    asked = spark.createDataFrame([("q", "alpha")], "query_id string, query string")
    assert [(r["id"], r["score"]) for r in bm25.Index.load(spark, str(tmp_path / "i")).search(asked).collect()] == [(1, 1.0)]


def test_documents_without_a_type_are_documents(spark):
    chunks = spark.createDataFrame([("a", "alpha text", "s", None, "en"), ("b", "alpha code", "s", "code", "en")], "chunk_id string, text string, source string, source_type string, language string")
    found = search(Corpus(chunks), QueryRequest("alpha", "bm25", source_types=["doc"], explain=True))
    assert [r["chunk_id"] for r in found.collect()] == ["a"]
    assert explain.explain_result(found, "a").columns[:1] == ["chunk_id"]
    with pytest.raises(LookupError):
        explain.explain_result(found, "b")


def test_vector_batches(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)] + [(99, None), (98, [1.0])], "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "query_id long, q array<double>")
    monkeypatch.setattr(vector, "TILE", 7)
    monkeypatch.setattr(vector, "ASKED", 1)
    for metric, size in (("cosine", 1), ("l2", 16), ("inner_product", 1 << 20)):
        monkeypatch.setattr(vector, "PASS_BYTES", size)
        many = sorted(map(tuple, vector.batch(rows, asked, 4, metric).collect()))
        each = sorted(map(tuple, vector.search(rows, [(1, [1.0, 0.0]), (2, [-1.0, 0.0])], 4, metric).collect()))
        assert many == each
    assert vector.batch(rows, asked.limit(0)).count() == 0
    # unequal lengths do not meet, null and NaN components take no part
    odd = spark.createDataFrame([(1, [2.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [])], asked.schema)
    assert sorted((r.query_id, r.id) for r in vector.batch(rows, odd, 1).collect()) == [(1, 98), (2, 0)]
    # ties go to the smaller id, however many there are
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50, 0, -1)], rows.schema).repartition(3)
    assert sorted(r.id for r in vector.batch(same, asked.where("query_id = 1"), 4).collect()) == [1, 2, 3, 4]


def test_code_by_language(spark):
    rows = spark.createDataFrame([("a", "go", "code"), ("a", "go", "code"), ("b", "md", None)], "source string, language string, source_type string")
    assert [tuple(r) for r in stats.by_language(rows).collect()] == [("go", 1, 2)]
