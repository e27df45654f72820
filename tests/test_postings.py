"""The stored index: the same as the scan forms, through segments, removals and compaction."""

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fathomry.operators import bm25, fulltext, postings

rng = np.random.default_rng(5)
VOCAB = ["spark", "query", "index", "vector", "graph", "the", "in", "of", "rare", "über", "data", "merge"]
WEIGHT = np.array([8, 5, 5, 4, 3, 20, 12, 9, 0.3, 1, 6, 2])


def text():
    return " ".join(rng.choice(VOCAB, rng.integers(0, 60), p=WEIGHT / WEIGHT.sum()))


DOCS = [(i, text(), f"src{i % 4}") for i in range(300)] + [(900, None, "src1"), (901, "", None)]
ASKED = [(1, "spark vector"), (2, "the rare merge"), (3, "query query index graph data"), (4, "missing words"), (5, "über"), (6, "")]
WEB = [(1, 'spark OR rare "in the" -src3'), (2, '"spark query" vector'), (3, '-graph index'), (4, "-graph"), (5, '"of the" OR "merge data" src1'), (6, "nothing")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(ASKED, "query_id long, query string")


def rows(frame):
    return sorted(map(tuple, frame.select("query_id", "id", "score", "rank").collect()))


def index(spark, tmp_path_factory):
    return postings.TextIndex(spark, f"file://{tmp_path_factory.mktemp('text')}", fields={"source": "a", "text": "c"})


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    made = index(spark, tmp_path_factory)
    made.add(docs)
    return made


def scanned(docs, k=10):
    out = []
    for q, text in WEB:
        if any(c.wanted for c in fulltext.parse(text)):
            out += [(q, *r) for r in map(tuple, fulltext.search(docs, text, k, fields={"source": "a", "text": "c"}).select("id", "score", "rank").collect())]
    return sorted(out)


def test_same_as_the_scan(spark, docs, queries, stored):
    assert rows(stored.bm25(queries, 7)) == rows(bm25.Index.build(docs).search(queries, 7))
    keep = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    assert rows(stored.bm25(queries, 4, keep)) == rows(bm25.Index.build(docs).search(queries, 4, keep))
    web = spark.createDataFrame(WEB, "query_id long, query string")
    assert rows(stored.fulltext(web, 10)) == scanned(docs)


def test_many_passes_and_unnamed_terms(spark, queries, stored, monkeypatch):
    want = rows(stored.bm25(queries, 7))
    monkeypatch.setattr(postings, "PAIRS", 2)
    monkeypatch.setattr(postings, "NAMED", 1)
    assert rows(stored.bm25(queries, 7)) == want


def test_terms_reach_the_scan(spark, queries, stored):
    plan = stored._blocks(queries.where("query_id = 5").select(F.lit("über").alias("term")), ["ids"], True)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term)" in plan and "EqualTo(term,über)" in plan
    assert "pos:array" not in plan.split("ReadSchema")[-1]
    # files are sorted by term: few of their row groups can hold one
    files = [f for f in glob.glob(f"{stored.path.removeprefix('file://')}/seg-*/postings/*.parquet")]
    for f in files:
        terms = pq.read_table(f, columns=["term"])["term"].to_pylist()
        assert terms == sorted(terms)


def test_increments_equal_a_rebuild(spark, docs, queries, tmp_path_factory):
    made = index(spark, tmp_path_factory)
    made.add(docs.where("doc_id < 200"))
    made.add(docs.where("doc_id >= 150"))  # replaces 50
    made.remove(spark.createDataFrame([(3,), (151,), (7777,)], "doc_id long"))
    changed = spark.createDataFrame([(10, "rare rare spark", "src9"), (3, "graph in the data", "src0")], docs.schema)
    before = sorted(glob.glob(f"{made.path.removeprefix('file://')}/seg-*/*/*.parquet"))
    stamps = [pq.read_metadata(f).serialized_size for f in before]
    made.add(changed)
    assert [pq.read_metadata(f).serialized_size for f in before] == stamps
    now = docs.where("doc_id not in (3, 10, 151)").unionByName(changed)
    want = bm25.Index.build(now)
    total = want.totals.first()
    about = made.totals()
    assert about["n"] == total["n"] and about["avgdl"] == pytest.approx(total["avgdl"])
    web = spark.createDataFrame(WEB, "query_id long, query string")
    for _ in range(2):
        assert rows(made.bm25(queries, 7)) == rows(want.search(queries, 7))
        assert rows(made.fulltext(web, 10)) == scanned(now)
        made.compact(now)
    assert len(made.segments()) == 1


def test_empty_and_string_ids(spark, queries, tmp_path_factory):
    made = index(spark, tmp_path_factory)
    assert made.bm25(queries).count() == 0 and made.segments() == []
    named = spark.createDataFrame([("b", "spark", None), ("a", "spark", "x")], "doc_id string, text string, source string")
    made.add(named)
    assert [(r.query_id, r.id, r.rank) for r in made.bm25(queries).orderBy("rank").collect()] == [(1, "a", 1), (1, "b", 2)]


def test_levels_are_passed_over():
    """A common term of low weight can't lift documents over the k-th score of a rare one."""
    n = 1000
    block = lambda term, ids, tf, top: {"kind": 2, "term": term, "top": top, "ids": ids, "tf": tf, "dl": [10] * len(ids)}
    gain = lambda tf: tf / (tf + 1.5)
    table = pa.Table.from_pylist([block("rare", list(range(5)), [5] * 5, gain(5)), block("the", [0, 1], [3, 3], gain(3)), block("the", list(range(2, n)), [1] * (n - 2), gain(1))])
    idf = {"rare": 6.0, "the": 0.01}
    skipped = []
    fast = list(postings.score_shard(table, {"q": ["rare", "the"]}, idf, 1.0, 10.0, 2, skipped=skipped))
    assert skipped == [n - 2]
    best = sorted(zip(fast[0][1].tolist(), fast[0][2].tolist()), key=lambda x: (-x[1], x[0]))[:2]
    assert best == [(i, pytest.approx(6 * gain(5) + 0.01 * gain(3))) for i in (0, 1)]
