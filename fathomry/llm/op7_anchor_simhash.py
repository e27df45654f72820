"""SimHash near-dedup with a covering code's words as anchor points.

Two 64-bit fingerprints within 3 bits differ in at most one bit in one of their
halves. So each half gets its own covering code with threshold 1: the perfect
Hamming code on 31 bits, whose covering radius is 1. A fingerprint is at home at
the one anchor within the radius, and is replicated to all anchors within
radius plus threshold, 2: there are 16 of them (1 if it is an anchor itself).
If x and y differ in at most one bit of the half, y comes to x's home. Per
anchor, fingerprints are compared on all 64 bits, and what links is emitted as
a spanning forest, not as all pairs.

Equal fingerprints are merged first, so groups of copies are one row. An anchor
with over HOT fingerprints is divided once more: its fingerprints' other half
differs in at most 3 bits, so one of its four bytes is equal, and they meet in
a bucket of that byte. Components are found with distributed star steps.

Defined results: null and empty texts have fingerprint 0 and link like any
other; texts of one or two words have one shingle, all their words; repeated
rows each get a row; null ids never are a component's id unless there is no
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common
from .components import components

SEED = 42
WIDTH = 3
BITS = 3
HOT = 4096
#: Buckets up to this size are compared by shifting the sorted rows against themselves.
SMALL = 12
CHUNK = 1 << 16
#: Digits of the bitmap of documents that go: a million numbers at most are sent to the tasks.
MARKS = 26
#: For each of the five check bits, the positions 1 to 31 that it covers, as a mask.
CHECKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1) for j in range(5)]


def simhash(hashes: np.ndarray) -> np.uint64:
    """The 64-bit SimHash of unsigned 64-bit hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*[words[i:] for i in range(WIDTH)], strict=False))) or [b" ".join(words)]
    return int(simhash(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))))


def fingerprints(docs: DataFrame, text: str) -> DataFrame:
    """The rows with ``fp`` (signed long) in place of the text."""
    kept = [c for c in docs.columns if c not in (text, "fp")]
    schema = docs.select(*kept).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            made = np.array([fingerprint(t.as_py()) for t in batch.column("__text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(made, pa.int64())], names=[*kept, "fp"])

    return common.map_batches(docs.select(*kept, F.col(text).alias("__text")), run, schema)


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 32-bit halves: (row, anchor) of all anchors within 2 of their first 31 bits, and which of them is home."""
    x = (half & np.uint64(0x7FFFFFFF)).astype(np.int64)
    syndrome = np.zeros(len(x), np.int64)
    for j, mask in enumerate(CHECKS):
        syndrome |= (np.bitwise_count(x & mask).astype(np.int64) & 1) << j
    home = x ^ np.where(syndrome > 0, np.int64(1) << np.maximum(syndrome - 1, 0), 0)
    first = np.arange(1, 32, dtype=np.int64)[None, :]
    second = first ^ syndrome[:, None]
    ok = (syndrome[:, None] > 0) & (second > first)
    near = x[:, None] ^ (np.int64(1) << (first - 1)) ^ (np.int64(1) << np.maximum(second - 1, 0))
    row, col = np.nonzero(ok)
    return np.r_[np.arange(len(x)), row], np.r_[home, near[row, col]], np.r_[np.ones(len(x), bool), np.zeros(len(row), bool)]


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for i in range(0, len(fp), CHUNK):
            part = fp[i : i + CHUNK]
            for which, half in enumerate((part & np.uint64(0xFFFFFFFF), part >> np.uint64(32))):
                row, anchor, home = anchors_of(half)
                key = anchor | np.int64(which) << np.int64(32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part.view(np.int64)[row]), pa.array(home)], names=["anchor", "fp", "home"])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= BITS


def _forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is connected among these fingerprints, at most one for each."""
    left = np.unique(fp)
    a, b = [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo:
            x = todo.pop()
            near = _near(left, x)
            if near.any():
                found = left[near]
                left = left[~near]
                a.append(np.full(len(found), x, np.uint64))
                b.append(found)
                todo.extend(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64),) * 2


def links_in(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of rows sorted by key."""
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    of = np.repeat(size, size)
    a, b = [], []
    small = of <= SMALL
    for d in range(1, SMALL):
        if d >= len(key):
            break
        pair = (key[d:] == key[:-d]) & small[d:] & (home[d:] | home[:-d])
        at = np.flatnonzero(pair)
        if not len(at):
            break
        at = at[_near(fp[at], fp[at + d])]
        a.append(fp[at])
        b.append(fp[at + d])
    for i in np.flatnonzero(size > SMALL):
        x, y = _forest(fp[edge[i] : edge[i + 1]])
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64),) * 2


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; the last key of a batch waits for the next batch."""
    held: list[tuple] = []

    def out(parts: list[tuple]) -> pa.RecordBatch:
        a, b = links_in(*[np.concatenate(x) for x in zip(*parts, strict=True)])
        a, b = a.view(np.int64), b.view(np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy(zero_copy_only=False)
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        home = batch.column("home").to_numpy(zero_copy_only=False).astype(bool)
        other = np.flatnonzero(key != key[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            held.append((key[:cut], fp[:cut], home[:cut]))
            yield out(held)
            held = []
        elif held and held[-1][0][-1] != key[0]:
            yield out(held)
            held = []
        held.append((key[cut:], fp[cut:], home[cut:]))
    if held:
        yield out(held)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within BITS bits of one another."""
    spread = common.map_batches(fps, _replicate, "anchor long, fp long, home boolean")
    dealt = spread.withColumn("__n", F.count("*").over(Window.partitionBy("anchor")))
    cold = dealt.where((F.col("__n") > 1) & (F.col("__n") <= HOT)).select(F.col("anchor").alias("key"), "fp", "home").sortWithinPartitions("key")
    found = common.map_batches(cold, _compare, "a long, b long")
    # the half that is not the anchor's, by its bytes
    other = F.when(F.col("anchor") >= 1 << 32, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32))
    byte = lambda i: F.shiftrightunsigned(other, 8 * i).bitwiseAND(255)
    split = F.explode(F.array(*[F.xxhash64("anchor", F.lit(i), byte(i)) for i in range(4)]))
    hot = dealt.where(F.col("__n") > HOT).select(split.alias("key"), "fp", "home").repartition("key").sortWithinPartitions("key")
    return found.unionByName(common.map_batches(hot, _compare, "a long, b long"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows without the text, with ``fp``, ``component`` (a number of the group) and ``component_id``: the smallest id among all rows reachable by links."""
    prints = common.cut(fingerprints(docs, text))
    each = prints.groupBy("fp").agg(F.min(key).alias("__first"))
    roots = components(links(each.select("fp")))
    grouped = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("__first").alias("component_id"))
    named = grouped.join(least, "root").select("fp", F.col("root").alias("component"), "component_id")
    return prints.drop("component", "component_id").join(named, "fp")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", find: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """The documents, one of each group of near duplicates: the one with the smallest id, null ids last, then the smallest hash of the text.

    find: what gives the rows their ``component``; called as ``near_duplicates`` is.
    """
    hashed = docs.withColumn("__th", F.xxhash64(text))
    groups = common.cut(find(hashed.select(key, "__th", text), text, key).select("component", key, "__th"))
    first = F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("__th").alias("t"))).alias("f")
    own = F.col(key).eqNullSafe(F.col("f.k")) & (F.col("__th") == F.col("f.t"))
    each = groups.groupBy("component", key, "__th").agg(F.count("*").alias("n")).join(groups.groupBy("component").agg(first), "component")
    # what goes, and what is there more than once: only these rows move
    met = common.cut(each.where(~own | (F.col("n") > 1)).select(F.col(key).alias("__k"), F.col("__th").alias("__t"), own.alias("__own")))
    rows = common.maybe(hashed, common.marks(met, "__k", "__t", bits=MARKS), key, "__th", bits=MARKS)
    known = F.col(key).eqNullSafe(F.col("__k")) & (F.col("__th") == F.col("__t"))
    moved = rows.where("__maybe").join(met, known, "left").where("__own is null or __own")
    once = moved.where("__own").dropDuplicates([key, "__th"])
    columns = docs.columns
    return rows.where("not __maybe").select(*columns).unionByName(moved.where("__own is null").select(*columns)).unionByName(once.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
