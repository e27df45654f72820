"""Two-stage ranking: a cheap first stage, then a scorer over its best."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomry.functions import text as tx
from fathomry.functions.ship import ship

# Characters of a text that a judge sees, failures in a row after which it is not asked, seconds until it is asked again.
SEEN, FAILURES, PAUSE = 2000, 3, 60.0


def first_stage_size(k: int) -> int:
    return min(10 * k, 100)


def overlap(query: Column, text: Column) -> Column:
    """The share of a query's tokens that a text has: a scorer without a model."""
    asked = F.array_distinct(tx.tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, tx.tokens(text))).cast("double"), F.size(asked)), F.lit(0.0))


def judged(answer: Column) -> Column:
    """The first number of a model's answer, from 0 to 10; 0 without one."""
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(F.regexp_extract(answer, r"(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))))


def judge(found: DataFrame, ask: Callable[[str, str], str], query: str = "query", text: str = "text", failures: int = FAILURES, pause: float = PAUSE) -> DataFrame:
    """Adds rerank_score: what ``judged`` reads from a model's answer to (query, text), the text cut to SEEN characters; null where the call failed.

    After so many failures in a row a task asks no more until the pause is over; its rows have null until then. Null texts and queries are empty ones.
    """
    ship(found.sparkSession)
    rows = found.drop("rerank_score")
    schema = T.StructType([*rows.schema.fields, T.StructField("__answer", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed, until = 0, 0.0
        for b in batches:
            out = []
            for q, t in zip(b[query], b[text], strict=True):
                answer = None
                if failed < failures or time.monotonic() >= until:
                    try:
                        answer, failed = str(ask(q or "", (t or "")[:SEEN])), 0
                    except Exception:
                        failed += 1
                        until = time.monotonic() + pause
                out.append(answer)
            yield b.assign(__answer=out)

    answered = rows.mapInPandas(run, schema)
    return answered.withColumn("rerank_score", F.when(F.col("__answer").isNotNull(), judged(F.col("__answer")))).drop("__answer")


def rerank_scored(found: DataFrame, k: int = 5) -> DataFrame:
    """Reorders each query's first stage (query_id, id, rank, rerank_score) if it has over k rows; keeps k.

    A query of which a row has no score keeps the order of its first stage, cut to k. Adds
    original_rank and rerank_movement (places gained); both it and rerank_score are null where the first stage stays.
    """
    own = Window.partitionBy("query_id")
    moved = (F.count("*").over(own) > k) & (F.count("rerank_score").over(own) == F.count("*").over(own))
    scored = found.withColumns({"__moved": moved, "original_rank": F.col("rank")}).withColumn("rerank_score", F.when(F.col("__moved"), F.round("rerank_score", 6)))
    by = own.orderBy(F.desc_nulls_last("rerank_score"), "original_rank")
    out = scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return out.withColumn("rerank_movement", F.when(F.col("__moved"), F.col("original_rank") - F.col("rank"))).drop("__moved")


def rerank(found: DataFrame, k: int = 5, scorer: Callable[[Column, Column], Column] = overlap, query: str = "query", text: str = "text") -> DataFrame:
    """``rerank_scored`` with a scorer of columns over (query_id, id, score, rank, query, text)."""
    return rerank_scored(found.withColumn("rerank_score", scorer(F.col(query), F.col(text))), k)
