"""Streams with state: files that change, and jobs that move."""

import datetime as dt
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from fathomry.operators import jobs
from fathomry.streaming import job_states, watch


def run(rows, folder, checkpoint):
    query = rows.writeStream.format("parquet").option("path", str(folder)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert query.exception() is None


def test_changed_and_deleted_files_are_seen(spark, tmp_path):
    src = tmp_path / "src"
    (src / "node_modules").mkdir(parents=True)
    (src / "deep").mkdir()
    for name, text in (("a.md", "one"), ("deep/B.MD", "two"), ("c.txt", "no"), ("node_modules/d.md", "no"), ("e.md", "")):
        (src / name).write_text(text)

    def step():
        run(watch.watch_changes(spark, str(src), str(tmp_path / "ledger"), "*.md"), tmp_path / "out", tmp_path / "cp")
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r["listing"], os.path.relpath(r["file_path"], src), r["change"], r["checksum"]) for r in rows)

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = [(1, "a.md", "added", sha("one")), (1, "deep/B.MD", "added", sha("two")), (1, "e.md", "added", sha(""))]
    assert step() == first
    assert step() == first
    (src / "a.md").write_text("one more")
    (src / "e.md").unlink()
    (src / "f.md").write_text("new")
    second = [(2, "a.md", "changed", sha("one more")), (2, "e.md", "deleted", None), (2, "f.md", "added", sha("new"))]
    assert step() == first + second
    (src / "a.md").write_text("one less")
    assert step() == [*first, *second, (3, "a.md", "changed", sha("one less"))]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, old)


def by_hand(moves, seconds, retries):
    out = []
    for job in sorted({m[0] for m in moves}):
        status, tries, began = "pending", 0, None
        for _, ts, to in sorted(m for m in moves if m[0] == job):
            if status == "running" and (ts - began).total_seconds() >= seconds:
                out.append((job, began + dt.timedelta(seconds=seconds), "timeout", "failed", tries, True))
                status = "failed"
            ok = to in jobs.MOVES.get(status, ())
            if ok and status == "running" and to == "pending":
                tries += 1
                status = "failed" if tries > retries else "pending"
            elif ok:
                status = to
            began = ts if ok and status == "running" else began
            out.append((job, ts, to, status, tries, ok))
        last = max(m[1] for m in moves)
        if status == "running" and (last - began).total_seconds() >= seconds:
            out.append((job, began + dt.timedelta(seconds=seconds), "timeout", "failed", tries, True))
    return sorted(out)


def test_jobs_move_and_time_out(spark, rocks, tmp_path):
    draw = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    shape = "job_id long, ts timestamp, to string"
    moves = [(draw.randrange(9), start + dt.timedelta(seconds=60 * i), draw.choice(["running", "running", "pending", "done", "cancelled", "odd"])) for i in range(90)]
    moves += [(70, start, "running")]
    moves += [(80, start + dt.timedelta(seconds=30 * i), ["running", "pending"][i % 2]) for i in range(12)]
    moves = sorted(set(moves), key=lambda m: m[1])
    src, out, cp = (tmp_path / n for n in ("src", "out", "cp"))
    for i in range(0, len(moves), 40):
        spark.createDataFrame(moves[i : i + 40], shape).coalesce(1).write.mode("append").parquet(str(src))
        run(job_states.job_states(spark.readStream.schema(shape).parquet(str(src)), "0 seconds", 600, 2), out, cp)
    spark.createDataFrame([(None, start, "running"), (1, None, "done"), (1, start, None)], shape).write.mode("append").parquet(str(src))
    run(job_states.job_states(spark.readStream.schema(shape).parquet(str(src)), "0 seconds", 600, 2), out, cp)
    got = sorted(tuple(r) for r in spark.read.parquet(str(out)).select("job_id", "ts", "asked", "status", "retry_count", "accepted").collect())
    assert got == by_hand(moves, 600, 2)
    assert {"timeout"} <= {g[2] for g in got} and any(g[3] == "failed" and g[2] == "pending" for g in got)


def test_the_stream_agrees_with_the_batch(spark, rocks, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet") if os.path.isdir("/root/testdata/sf0.001") else pytest.skip("no test tables")
    first = events.groupBy(F.col("user_id").alias("job_id")).agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.min("ts").alias("ts"))
    moves = first.select("job_id", "ts", F.when(F.col("kind") == "view", "running").when(F.col("kind") == "click", "cancelled").otherwise("done").alias("to"))
    moves.write.parquet(str(tmp_path / "src"))
    run(job_states.job_states(spark.readStream.schema(moves.schema).parquet(str(tmp_path / "src")), "1000 days"), tmp_path / "out", tmp_path / "cp")
    got = spark.read.parquet(str(tmp_path / "out")).select("job_id", "status", "accepted")
    want = jobs.transition(first.select("job_id", F.lit("pending").alias("status")), moves.select("job_id", "to")).select("job_id", "status", "accepted")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
