"""The job queue as a log of job states."""

from __future__ import annotations

import base64
import hashlib
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("pending", "running")
DONE = ("done", "failed", "cancelled")
RETRIES, MOST_ACTIVE = 3, 100
#: Seconds that a job may run, and log rows after which a snapshot replaces the log.
TIMEOUT, COMPACT = 7200, 100
MOVES = {"pending": ("running", "cancelled"), "running": ("done", "failed", "cancelled", "pending")}


def dedupe_key(path: str, include_code: bool, operation: str, include: list[str] = (), exclude: list[str] = ()) -> str:
    parts = (os.path.realpath(path), str(include_code), operation, ",".join(sorted(include)), ",".join(sorted(exclude)))
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def dedupe_column(path: Column, include_code: Column, operation: Column, include: Column, exclude: Column) -> Column:
    """The same for rows whose paths are already absolute."""
    flag = F.when(include_code, "True").otherwise("False")
    return F.sha2(F.concat_ws("|", path, flag, operation, F.array_join(F.array_sort(include), ","), F.array_join(F.array_sort(exclude), ",")), 256)


def replay(log: DataFrame, key: str = "job_id", seq: str = "seq") -> DataFrame:
    """The last state of every job; kept per task before the exchange."""
    rest = [c for c in log.columns if c not in (key,)]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("s"))
    return last.select(key, "s.*")


def stats(jobs: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return jobs.agg(n("pending"), n("running"), n("done"), n("failed"), n("cancelled"), F.count("*").alias("total"))


def current(jobs: DataFrame, now: Column) -> DataFrame:
    """One row: the running job that started first (job_id, status, started_at; ties to the smaller id) and its milliseconds up to ``now``; nulls if none runs.

    A job without a start has no running time, and comes after those that have one.
    """
    order = F.struct(F.col("started_at").isNull(), "started_at", "job_id")
    first = jobs.where("status = 'running'").agg(F.min_by(F.struct("job_id", "started_at"), order).alias("j"))
    spent = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("j.started_at").cast("timestamp"))) / 1000
    return first.select(F.col("j.job_id").alias("current_job_id"), F.floor(spent).alias("running_time_ms"))


def enqueue(jobs: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """New jobs (seq, dedupe_key ...) that no active job and no earlier new one equals; all if forced."""
    if force:
        return new
    first = new.withColumn("__n", F.row_number().over(Window.partitionBy("dedupe_key").orderBy("seq"))).where("__n = 1").drop("__n")
    return first.join(jobs.where(F.col("status").isin(*ACTIVE)), "dedupe_key", "left_anti")


def full(jobs: DataFrame) -> bool:
    return jobs.where(F.col("status").isin(*ACTIVE)).limit(MOST_ACTIVE).count() >= MOST_ACTIVE


def recover(jobs: DataFrame) -> DataFrame:
    """After a restart: running jobs are pending again, or failed if that was their last retry."""
    stale = F.col("status") == "running"
    tries = F.col("retry_count") + stale.cast("int")
    status = F.when(stale & (tries > RETRIES), "failed").when(stale, "pending").otherwise(F.col("status"))
    return jobs.withColumns({"status": status, "retry_count": tries})


def pending(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'pending'").orderBy("enqueued_at", "job_id")


def cancel(jobs: DataFrame, job_id: str) -> DataFrame:
    """A pending job is cancelled at once; a running one is asked to stop."""
    own = F.col("job_id") == job_id
    return jobs.withColumns({"cancel_requested": F.coalesce("cancel_requested", F.lit(False)) | (own & (F.col("status") == "running")), "status": F.when(own & (F.col("status") == "pending"), "cancelled").otherwise(F.col("status"))})


def page(jobs: DataFrame, size: int = 20, cursor: str | None = None) -> tuple[DataFrame, str]:
    """Newest first, and the cursor of the next page."""
    at = int(base64.b64decode(cursor)) if cursor else 0
    return jobs.orderBy(F.desc("enqueued_at"), "job_id").offset(at).limit(size), base64.b64encode(str(at + size).encode()).decode()


def durations(jobs: DataFrame) -> DataFrame:
    """Milliseconds from start to finish, and progress in per cent."""
    ms = F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("finished_at"))
    return jobs.withColumns({"execution_time_ms": ms, "percent_complete": F.round(F.coalesce(F.try_divide(100.0 * F.col("files_processed"), F.col("files_total")), F.lit(0.0)), 1)})


def transition(jobs: DataFrame, moves: DataFrame) -> DataFrame:
    """Applies moves (job_id, to) that the state allows; ``accepted`` tells which jobs moved. Moves of unknown jobs are left out."""
    to = moves.groupBy("job_id").agg(F.min("to").alias("__to"))
    allowed = [(F.col("status") == a) & F.col("__to").isin(*b) for a, b in MOVES.items()]
    ok = F.coalesce(allowed[0] | allowed[1], F.lit(False))
    rows = jobs.join(to, "job_id", "left")
    return rows.withColumn("accepted", ok).withColumn("status", F.when(F.col("accepted"), F.col("__to")).otherwise(F.col("status"))).drop("__to")


def time_out(jobs: DataFrame, now: Column, seconds: int = TIMEOUT) -> DataFrame:
    """Running jobs that started too long ago have failed."""
    late = (F.col("status") == "running") & (F.timestamp_diff("SECOND", F.col("started_at"), now) >= seconds)
    return jobs.withColumns({"status": F.when(late, "failed").otherwise(F.col("status")), "error": F.when(late, F.lit(f"timed out after {seconds} s")).otherwise(F.col("error"))})


def checked_delta(jobs: DataFrame) -> DataFrame:
    """A finished job must have left more chunks than there were; as many will do if none had to be made, or if files were read and there are chunks.

    jobs: status, chunks_before, chunks_after, chunks_to_create (null: not known), files_processed.
    """
    more = F.col("chunks_after") - F.col("chunks_before")
    as_many = (more == 0) & ((F.coalesce("chunks_to_create", F.lit(-1)) == 0) | ((F.col("chunks_after") > 0) & (F.coalesce("files_processed", F.lit(0)) > 0)))
    failed = (F.col("status") == "done") & ~((more > 0) | as_many)
    return jobs.withColumn("status", F.when(failed, "failed").otherwise(F.col("status")))


def append(log: DataFrame, path: str) -> None:
    """Adds states to the log, JSON lines."""
    log.write.mode("append").json(path)


def compact(spark, path: str, schema, to: str, key: str = "job_id", seq: str = "seq", every: int = COMPACT) -> bool:
    """Writes the last states to a new folder if the log has ``every`` rows more than jobs; tells whether it did. The log stays until the caller drops it."""
    log = spark.read.schema(schema).json(path)
    counts = log.agg(F.count("*").alias("n"), F.countDistinct(key).alias("jobs")).first()
    if counts["n"] - counts["jobs"] < every:
        return False
    replay(log, key, seq).write.json(to)
    return True
