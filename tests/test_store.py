"""Caches by bytes and triples of extractions."""

import hashlib
import random

from pyspark.sql import functions as F

from fathomry.operators import caches, triples


def kept_by_hand(entries, most):
    out, total = set(), 0
    order = sorted(entries, key=lambda e: (e[1] is not None, e[1] or 0, hashlib.sha256(e[0].encode()).hexdigest()), reverse=True)
    for key, _, size in order:
        total += size or 0
        if total > most:
            break
        out.add(key)
    return out


def test_bytes_bound(spark):
    draw = random.Random(5)
    entries = [(f"k{i}", draw.choice([None, 1.5, 2.0, 1e9, -3.25, draw.uniform(0, 2e9)]), draw.choice([None, 0, 5, 70])) for i in range(300)]
    rows = spark.createDataFrame(entries, "cache_key string, last_accessed double, n int")
    rows = rows.withColumn("embedding", F.array().cast("array<float>"))
    whole = sum(e[2] or 0 for e in entries)
    for most in (-1, 0, 4, 5, 99, whole // 2, whole - 1, whole):
        got = {r["cache_key"] for r in caches.evict_to(rows, most, F.col("n")).collect()}
        micros = [(k, None if t is None else round(t, 6), n) for k, t, n in entries]
        want = {k for k, _, _ in entries} if most == whole else kept_by_hand(micros, max(most, 0))
        assert got == want, most
    assert caches.evict_to(rows.limit(0), 0, F.col("n")).count() == 0
    # an entry takes its key and four bytes a component
    one = spark.createDataFrame([("ab", 1.0, [1.0, 2.0]), ("cd", 2.0, [1.0])], "cache_key string, last_accessed double, embedding array<float>")
    assert [r["cache_key"] for r in caches.evict_to(one, 10).collect()] == ["cd"]


def test_other_models_are_wiped(spark):
    rows = spark.createDataFrame([("x:p:m:4",), ("x:p:m:14",), ("y:q:m:4",), ("z:p:m:4",)], "cache_key string")
    assert sorted(r[0] for r in caches.fitting(rows, "p", "m", 4).collect()) == ["x:p:m:4", "z:p:m:4"]


def test_extractions(spark):
    many = "[" + ",".join(f'{{"attributes": {{"subject": "s{i}", "predicate": "p", "object": "o"}}}}' for i in range(12)) + "]"
    rows = [
        (1, '[{"attributes": {"head": "A", "subject": "", "relation": " Uses ", "object": "B", "head_type": "class"}}, {"attributes": null}, {"attributes": {"subject": "A", "object": "B"}}, 3, {"attributes": {"subject": 0, "head": 7, "subject_type": false, "head_type": "", "predicate": "p", "tail": true}}]'),
        (2, "no json"),
        (3, None),
        (4, '{"attributes": {}}'),
        (5, many),
        (6, '[{"head": "X", "relation": "R", "predicate": "other", "tail": "Y", "tail_type": "function"}]'),
        (7, "[]"),
        (8, '[{"attributes": {"subject": "0", "predicate": "p", "object": "0.5", "object_type": "class"}}]'),
    ]
    got = triples.from_extractions(spark.createDataFrame(rows, "chunk_id int, extractions string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["source_chunk_id"], []).append((r["subject"], r["subject_type"], r["predicate"], r["object"], r["object_type"]))
    assert set(by) == {1, 5, 6, 8}
    assert by[1] == [("A", "Class", "uses", "B", None), ("7", None, "p", "True", None)]
    assert sorted(s for s, *_ in by[5]) == sorted(f"s{i}" for i in range(10))
    assert by[8] == [("0", None, "p", "0.5", "Class")]
    assert by[6] == [("X", None, "r", "Y", "Function")]
