"""The state machine of jobs on a stream of requested moves: state and a timer a job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fathomry.functions.ship import ship
from fathomry.operators.jobs import DONE, MOVES, RETRIES, TIMEOUT

OUT = "job_id {kind}, ts timestamp, asked string, status string, retry_count int, accepted boolean"


def job_states(moves: DataFrame, late: str = "10 minutes", seconds: int = TIMEOUT, retries: int = RETRIES, forget: int | None = None) -> DataFrame:
    """One row per move (job_id, ts, to) and per timeout: the job's status after it, its retries, and whether the state allowed the move.

    A job is pending when its first move comes. Moves of one job are applied by
    time, then name, within a batch; nulls and moves after ``late`` are left out, and a move that
    the state does not allow changes nothing. A running job that is asked to be
    pending is tried again, up to ``retries`` times, and fails then. A job that has run for
    ``seconds`` when the watermark passes fails, with ``asked`` "timeout". Finished jobs leave the
    state ``forget`` seconds of watermark after their end (null: never). Needs the RocksDB state store.
    """
    ship(moves.sparkSession)
    rows = moves.where("job_id is not null and ts is not null and `to` is not null").select("job_id", F.col("ts").cast("timestamp").alias("ts"), "to").withWatermark("ts", late)
    kind = rows.schema["job_id"].dataType.simpleString()
    return rows.groupBy("job_id").transformWithStateInPandas(_Machine(seconds, retries, forget), OUT.format(kind=kind), "append", "EventTime")


class _Machine(StatefulProcessor):
    def __init__(self, seconds: int, retries: int, forget: int | None):
        self.seconds, self.retries, self.forget = seconds, retries, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, tries int, due long")

    def _timer(self, due: int | None, old: int | None) -> None:
        if old is not None:
            self.handle.deleteTimer(old)
        if due is not None:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        status, tries, due = tuple(self.now.get()) if self.now.exists() else ("pending", 0, None)
        before, out = due, []
        for ts, to in pd.concat(rows).sort_values(["ts", "to"], kind="stable")[["ts", "to"]].itertuples(index=False):
            at = _millis(ts)
            if status == "running" and at >= due:
                # the time ran out before this move, though the watermark has not said so yet
                out.append((_time(due), "timeout", "failed", tries, True))
                status, due = "failed", self._end(due)
            allowed = to in MOVES.get(status, ())
            if allowed:
                again = status == "running" and to == "pending"
                tries += again
                status = "failed" if again and tries > self.retries else to
                due = at + 1000 * self.seconds if status == "running" else self._end(at) if status in DONE else None
            out.append((ts, to, status, tries, allowed))
        if due != before:
            self._timer(due, before)
        self.now.update((status, tries, due))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        status, tries, due = tuple(self.now.get())
        if expiredTimerInfo.getExpiryTimeInMs() != due:
            return
        if status == "running":
            ended = self._end(due)
            self._timer(ended, None)
            self.now.update(("failed", tries, ended))
            yield self._frame(key, [(_time(due), "timeout", "failed", tries, True)])
        else:
            self.now.clear()

    def _end(self, at: int) -> int | None:
        return None if self.forget is None else at + 1000 * self.forget

    def _frame(self, key, rows: list) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["ts", "asked", "status", "retry_count", "accepted"])
        made.insert(0, "job_id", key[0])
        return made

    def close(self) -> None:
        pass


def _millis(ts: pd.Timestamp) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


def _time(millis: int) -> dt.datetime:
    return pd.Timestamp(millis, unit="ms")
