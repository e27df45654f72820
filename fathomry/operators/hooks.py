"""Functions of the user that run over chunks: metadata scripts, embedders and summarisers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomry.functions.ship import ship

BATCH = 100
DRY_ROWS = 10


def load_script(path: str, allowed: set[str]) -> Callable[[dict], dict]:
    """``process_chunk`` of a script whose SHA-256 is on the list of allowed ones."""
    source = Path(path).read_bytes()
    digest = hashlib.sha256(source).hexdigest()
    if digest not in allowed:
        raise PermissionError(f"{path} ({digest}) is not allowed")
    space: dict = {}
    exec(compile(source, path, "exec"), space)
    if not callable(space.get("process_chunk")):
        raise ValueError(f"{path} has no process_chunk")
    return space["process_chunk"]


def process(chunks: DataFrame, function: Callable[[dict], dict], extra: str = "extra") -> DataFrame:
    """Runs a function over each chunk's columns as a dict. New scalar keys go to the map ``extra``; changes of known columns are not taken.

    A chunk whose call fails stays as it is, with the error in ``process_error``.
    """
    ship(chunks.sparkSession)
    known = set(chunks.columns)
    schema = T.StructType([f for f in chunks.schema.fields if f.name not in (extra, "process_error")])
    names = list(schema.names)
    schema = schema.add(extra, T.MapType(T.StringType(), T.StringType())).add("process_error", T.StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            extras, errors = [], []
            for row in batch.to_dict("records"):
                own = dict(row.get(extra) or {})
                error = None
                try:
                    new = function({k: v for k, v in row.items() if k != extra} | own)
                    own |= {k: str(v) for k, v in new.items() if k not in known and isinstance(v, (str, int, float, bool))}
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                extras.append(own)
                errors.append(error)
            yield batch[names].assign(**{extra: extras, "process_error": errors})

    return chunks.mapInPandas(run, schema)


def dry_run(chunks: DataFrame, function: Callable[[dict], dict], rows: int = DRY_ROWS) -> DataFrame:
    """What a function would add to a few chunks: one row with the keys, and how many calls failed."""
    tried = process(chunks.limit(min(rows, DRY_ROWS)), function)
    keys = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_keys("extra")))))
    return tried.agg(F.count("*").alias("chunks"), keys.alias("keys"), F.count("process_error").alias("errors"))


def embed(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "text", size: int = BATCH) -> DataFrame:
    """Adds ``embedding``; the embedder gets at most ``size`` texts a call, in order. Texts that a cache knows are best joined away before."""
    ship(texts.sparkSession)
    schema = T.StructType([f for f in texts.schema.fields if f.name != "embedding"]).add("embedding", T.ArrayType(T.FloatType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch[text].fillna("").tolist()
            made = [v for i in range(0, len(asked), size) for v in embedder(asked[i : i + size])]
            yield batch[[n for n in schema.names if n != "embedding"]].assign(embedding=made)

    return texts.mapInPandas(run, schema)
