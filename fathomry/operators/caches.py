"""Caches of query results and of embeddings."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL, ENTRIES = 300, 256
#: Parts into which a range of times is divided at each step to an edge.
BINS = 4096
CACHED_MODES = ("vector", "bm25", "hybrid")


def query_key(params: dict, generation: int = 0) -> str:
    """The same for any order of keys and of list items."""
    even = {k: sorted(v) if isinstance(v, list) else v for k, v in params.items()}
    return f"{hashlib.sha256(json.dumps(even, sort_keys=True, separators=(',', ':')).encode()).hexdigest()}:{generation}"


class QueryCache:
    """Results by key for a while; a new generation of the index makes all keys new."""

    def __init__(self, ttl: float = TTL, entries: int = ENTRIES, clock=time.monotonic):
        self.ttl, self.entries, self.clock = ttl, entries, clock
        self.kept: OrderedDict[str, tuple[float, object]] = OrderedDict()
        self.generation = self.hits = self.misses = 0

    def get(self, key: str):
        at, value = self.kept.get(key, (0.0, None))
        if value is None or self.clock() - at > self.ttl:
            self.kept.pop(key, None)
            self.misses += 1
            return None
        self.hits += 1
        self.kept.move_to_end(key)
        return value

    def put(self, key: str, value: object) -> None:
        self.kept[key] = (self.clock(), value)
        self.kept.move_to_end(key)
        while len(self.kept) > self.entries:
            self.kept.popitem(last=False)

    def renew(self) -> None:
        self.generation += 1

    def clear(self) -> None:
        self.kept.clear()
        self.hits = self.misses = 0

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "hit_rate": round(self.hits / asked, 4) if asked else 0.0, "entries": len(self.kept), "generation": self.generation}


def embedding_key(text: Column, provider: str, model: str, dimensions: int) -> Column:
    return F.concat(F.sha2(text, 256), F.lit(f":{provider}:{model}:{dimensions}"))


def lookup(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Each text with its cached vector, or null: one left join on the key. texts: cache_key; cache: cache_key, embedding."""
    return texts.join(cache.select("cache_key", "embedding"), "cache_key", "left").withColumn("hit", F.col("embedding").isNotNull())


def evict_oldest(cache: DataFrame, share: float = 0.1) -> DataFrame:
    """The cache without the given share of entries, least recently used first: only a count and a threshold travel."""
    n = cache.count()
    gone = int(n * share)
    if not gone:
        return cache
    oldest = cache.select(F.struct("last_accessed", "cache_key").alias("o")).orderBy("o").limit(gone).agg(F.max("o").alias("o"))
    edge = oldest.first()["o"]
    later = (F.col("last_accessed") > F.lit(edge["last_accessed"])) | ((F.col("last_accessed") == F.lit(edge["last_accessed"])) & (F.col("cache_key") > edge["cache_key"]))
    return cache.where(later)


def evict_to(cache: DataFrame, most: int, size: Column | None = None) -> DataFrame:
    """The most recently used entries that take at most ``most`` bytes together, in whole order of use: no older entry stays once one has gone.

    cache: cache_key, last_accessed (a time or a number; null: oldest), embedding
    (4 bytes a component, besides its key) unless ``size`` gives bytes (null: 0).
    Entries of one time are taken by falling SHA-256 of their keys. Nothing is
    sorted: sums of bytes for ranges of time are refined until one entry is the edge, and
    each step reads its own range alone.
    """
    own = F.octet_length("cache_key") + 4 * F.size("embedding") if size is None else size
    time_ = F.col("last_accessed")
    if cache.schema["last_accessed"].dataType.typeName().startswith("timestamp"):
        time_ = F.unix_micros(time_.cast("timestamp"))
    else:
        time_ = (time_.cast("decimal(30,6)") * 1_000_000).cast("long")
    at = F.coalesce(time_, F.lit(-(1 << 61)))
    tie = F.conv(F.substring(F.sha2(F.col("cache_key").cast("string"), 256), 1, 15), 16, 10).cast("long")
    rows = cache.select(at.alias("at"), tie.alias("tie"), F.greatest(F.coalesce(own, F.lit(0)), F.lit(0)).cast("long").alias("size"))
    if (rows.agg(F.sum("size").alias("n")).first()["n"] or 0) <= most:
        return cache
    edge, left = _edge(rows, "at", max(most, 0))
    last, _ = _edge(rows.where(F.col("at") == edge), "tie", left)
    return cache.where((at > edge) | ((at == edge) & (tie > last)))


def _edge(rows: DataFrame, column: str, left: int) -> tuple[int, int]:
    """(the value at which a sum from the highest value down first exceeds ``left``, what is left for that value). The sum of all must exceed it."""
    ends = rows.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high = ends["low"], ends["high"]
    while low < high:
        width = (high - low) // BINS + 1
        part = F.expr(f"({column} - {low}L) div {width}L") if low >= 0 else F.expr(f"({column} + {-low}L) div {width}L")
        sums = rows.where(F.col(column).between(low, high)).groupBy(part.alias("part")).agg(F.sum("size").alias("n")).collect()
        for part, n in sorted(((r["part"], r["n"]) for r in sums), reverse=True):
            if n > left:
                break
            left -= n
        low, high = low + part * width, min(high, low + (part + 1) * width - 1)
    return low, left


def fitting(cache: DataFrame, provider: str, model: str, dimensions: int) -> DataFrame:
    """The cache for a fingerprint of a model: entries of any other are wiped."""
    return cache.where(F.endswith("cache_key", F.lit(f":{provider}:{model}:{dimensions}")))


def hit_rates(events: DataFrame, by: list[str], hit: Column) -> DataFrame:
    rate = F.round(F.coalesce(F.try_divide(F.count_if(hit).cast("double"), F.count("*")), F.lit(0.0)), 4)
    return events.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), rate.alias("hit_rate"))


def recency_rank(cache: DataFrame) -> DataFrame:
    return cache.withColumn("lru_rank", F.row_number().over(Window.orderBy("last_accessed", "cache_key")))
