"""Batches of queries against single ones, and names against brute force."""

import random

from pyspark.sql import functions as F

from fathomry.functions import entities
from fathomry.operators import graph, postings, rerank
from fathomry.plans.batch import mentions, search_batch
from fathomry.sources import shared

EDGES = "subject string, subject_type string, predicate string, object string, object_type string, source_chunk_id long"


def some_triples(spark, n=120):
    rng = random.Random(5)
    words = ["Alpha", "alphabet", "beta", "Be", "gamma_ray", "a", "GammaBeta", "delta", "ß"]
    rows = [(rng.choice(words), "Class", rng.choice(["calls", "contains"]), rng.choice(words), "Module", rng.choice([None, *range(9)])) for _ in range(n)]
    return [*rows, (None, None, "calls", "Alpha", None, 1), *rows[:3]]


def test_names_meet_all_that_contain_them(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(150)] + [None, "", "aaaaaa"]
    parts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(80)] + [None, "", "zzz"]
    got = graph.containing(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in parts], "part string"))
    want = {(p, n) for p in parts if p for n in names if n and p in n}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == want


def test_mentions_of_a_batch_equal_single_searches(spark):
    triples = spark.createDataFrame(some_triples(spark), EDGES)
    asked = {1: ["alpha", "beta"], 2: ["BE", "alpha", "unknown"], 3: ["a"], 4: ["unknown"], 5: ["", None, "ray"]}
    rows = [(q, i, e) for q, es in asked.items() for i, e in enumerate(es)]
    got = graph.entity_batch(triples, spark.createDataFrame(rows, "query_id int, n int, entity string"), 5).orderBy("query_id", "rank").collect()
    for q, es in asked.items():
        single = graph.entity_search(triples, [e for e in es if e], 5).collect()
        assert [(r["path"], r["source_chunk_id"], r["entity"].lower()) for r in got if r["query_id"] == q] == [(r["path"], r["source_chunk_id"], r["entity"]) for r in single]


def test_mentions_of_queries(spark):
    texts = ["How does GraphIndex use MAX_SIZE?", "", None, "what about searching"]
    got = mentions(spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")).orderBy("query_id", "n").collect()
    assert [(r["query_id"], r["entity"]) for r in got] == [(i, e) for i, t in enumerate(texts) for e in entities.query_entities(t or "")]


def test_hops_end_and_cycle(spark):
    rows = [("a", None, "x", "b", None, 1), ("b", None, "x", "c", None, 1), ("c", None, "x", "a", None, 2), ("d", None, "x", "e", None, 2), (None, None, "x", "a", None, 3)]
    triples = spark.createDataFrame(rows, EDGES)
    got = {(r["name"], r["hop"]) for r in graph.hops(triples, ["a", "a"], 9).where("name is not null").collect()}
    assert got == {("a", 0), ("b", 1), ("c", 1)}
    assert [tuple(r) for r in graph.hops(triples, ["d"], 0).collect()] == [("d", 0)]


def test_context_counts(spark):
    triples = spark.createDataFrame(some_triples(spark), EDGES).withColumn("score", F.lit(1.0))
    numbers, whole = graph.context_counts(triples).first(), graph.context(triples).first()
    assert numbers["n_entities"] == len([e for e in whole["entities"] if e is not None])
    assert (numbers["n_triples"], numbers["n_paths"], numbers["score"]) == (whole["n_triples"], len(whole["paths"]), whole["score"])
    assert tuple(graph.context_counts(triples.limit(0)).first()) == (0, 0, 0, 0.0)


def test_modes_of_a_batch(spark):
    docs = [(1, "python web framework", "s"), (2, "rust systems language", "s"), (3, "python data language", "s"), (4, None, "s")]
    index = postings.TextIndex(spark, shared.fresh(spark, "text-index"), fields={"source": "a", "text": "c"})
    index.add(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    vectors = spark.createDataFrame([(i, [float(i == j) for j in range(1, 5)]) for i in range(1, 5)] + [(9, None)], "vec_id long, embedding array<double>")
    triples = spark.createDataFrame([("Python", "Class", "calls", "Rust", "Class", 2)], EDGES)
    queries = spark.createDataFrame([(1, "python language", [0.9, 0.1, 0.0, 0.0]), (2, None, [0.0, 1.0, 0.0, 0.0]), (3, "rust", None), (4, "", None)], "query_id int, query string, q array<double>")
    run = lambda mode, **more: [(r["query_id"], r["id"], r["rank"]) for r in search_batch(queries, mode, 2, words=index, vectors=vectors, depth=3, **more).orderBy("query_id", "rank").collect()]
    assert run("bm25") == [(1, 3, 1), (1, 1, 2), (3, 2, 1)]
    assert run("vector") == [(1, 1, 1), (1, 2, 2), (2, 2, 1), (2, 1, 2)]
    assert run("hybrid")[-1] == (3, 2, 1)
    assert [r[:2] for r in run("hybrid", alpha=1.0)][:2] == [(1, 1), (1, 2)]
    assert run("graph", triples=triples)[:1] == [(1, 2, 1)]
    assert (3, 2, 1) in run("graph", triples=triples)
    assert {q for q, _, _ in run("multi", triples=triples)} == {1, 2, 3}


def test_a_failed_judge_leaves_the_first_stage(spark):
    rows = [(q, i, 1.0 / i, i, "rust", t) for q in ("good", "bad") for i, t in enumerate(["one", "two rust", "boom" if q == "bad" else "three", "four"], 1)]
    found = spark.createDataFrame(rows, "query_id string, id int, score double, rank int, query string, text string")
    seen = spark.sparkContext.accumulator(0)

    def ask(query, text):
        seen.add(1)
        if text == "boom":
            raise RuntimeError("down")
        assert len(text) <= 2000
        return f"Score: {9 if query in text else 2}/10"

    out = rerank.rerank_scored(rerank.judge(found.repartition(1), ask), 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"], r["rerank_movement"]) for r in out] == [("bad", 1, None), ("bad", 2, None), ("good", 2, 1), ("good", 1, -1)]
    assert seen.value == 8


def test_an_open_breaker_asks_no_more(spark):
    found = spark.createDataFrame([("q", i, 1.0, i, "x", "y" * 5000) for i in range(1, 21)], "query_id string, id int, score double, rank int, query string, text string").repartition(1)
    seen = spark.sparkContext.accumulator(0)

    def ask(query, text):
        seen.add(1)
        raise TimeoutError

    out = rerank.rerank_scored(rerank.judge(found, ask, failures=3), 5).collect()
    assert sorted(r["id"] for r in out) == [1, 2, 3, 4, 5]
    assert seen.value == 3
