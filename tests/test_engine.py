"""Operators on small literal tables."""

import math
import os

import pytest
from pyspark.sql import functions as F

from fathomry.functions import entities, languages
from fathomry.functions import text as tx
from fathomry.operators import bm25, caches, chunking, explain, filters, fulltext, fusion, graph, incremental, jobs, rerank, triples, vector
from fathomry.plans.request import QueryRequest
from fathomry.plans.search import Corpus, search
from fathomry.sources import files, tables
from fathomry.streaming import feeds

DOCS = [("doc-1", "Python is a programming language", "/a/py.md", "doc", "python"), ("doc-2", "FastAPI is a web framework for Python", "/a/web.md", "doc", "python"), ("doc-3", "Rust keeps memory safe", "/b/rust.rs", "code", "rust")]


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = spark.createDataFrame(DOCS, "chunk_id string, text string, source string, source_type string, language string")
    vectors = spark.createDataFrame([(f"doc-{i + 1}", [float(i == j) for j in range(8)]) for i in range(3)], "chunk_id string, embedding array<float>")
    edges = [("Python", "Module", "imports", "FastAPI", "Module", "doc-2"), ("Rust", "Module", "contains", "memory", "Function", "doc-3")]
    return Corpus(chunks, vectors, spark.createDataFrame(edges, "subject string, subject_type string, predicate string, object string, object_type string, source_chunk_id string"))


QUERY_VECTOR = [0.9, 0.1] + [0.0] * 6


def test_vector_scores(corpus):
    rows = search(corpus, QueryRequest("python", "vector", 3, 0.0, vector=QUERY_VECTOR)).collect()
    assert [r["chunk_id"] for r in rows] == ["doc-1", "doc-2", "doc-3"]
    assert rows[0]["score"] == pytest.approx(0.9 / math.sqrt(0.82), abs=1e-6)


def test_bm25_and_filters(corpus):
    rows = search(corpus, QueryRequest("python framework", "bm25", 3)).collect()
    assert [r["chunk_id"] for r in rows] == ["doc-2", "doc-1"] and rows[0]["score"] == 1.0
    assert rows[0]["matched_terms"] == ["python", "framework"]
    only = search(corpus, QueryRequest("python rust", "bm25", 3, languages=["rust"])).collect()
    assert [r["chunk_id"] for r in only] == ["doc-3"]


@pytest.mark.parametrize("mode", ["hybrid", "graph", "multi"])
def test_other_modes_explain_themselves(corpus, mode):
    rows = search(corpus, QueryRequest("Python FastAPI", mode, 3, 0.0, vector=QUERY_VECTOR, explain=True)).collect()
    assert rows and all(r["explanation"]["reason"] for r in rows)


def test_graph_falls_back(corpus):
    rows = search(corpus, QueryRequest("zzz nothing", "graph", 2, 0.0, vector=QUERY_VECTOR, explain=True)).collect()
    assert rows[0]["explanation"]["reason"].startswith("Graph returned no hits; fell back to vector search")


def test_rerank_moves(corpus):
    rows = search(corpus, QueryRequest("web framework", "hybrid", 1, 0.0, alpha=1.0, vector=QUERY_VECTOR, rerank=True, explain=True)).collect()
    assert rows[0]["chunk_id"] == "doc-2" and rows[0]["rerank_movement"] == 1
    assert rows[0]["explanation"]["reason"] == "Reranked up 1 place from #2 (cross-encoder score 1.00)"


@pytest.mark.parametrize("bad", [{"query": " "}, {"query": "x", "alpha": 1.1}, {"query": "x", "alpha": -0.1}, {"query": "x", "top_k": 0}, {"query": "x", "mode": "none"}, {"query": "x", "languages": ["klingon"]}])
def test_request_bounds(bad):
    with pytest.raises(ValueError):
        QueryRequest(**bad)


def ranks(spark, rows):
    return spark.createDataFrame([("q", i, s, r) for i, s, r in rows], "query_id string, id string, score double, rank int")


def test_fusion(spark):
    a, b = ranks(spark, [("x", 0.8, 1), ("y", 0.4, 3)]), ranks(spark, [("z", 0.9, 1), ("x", 0.3, 2)])
    rows = {r["id"]: r for r in fusion.reciprocal_ranks({"vector": a, "bm25": b}).collect()}
    assert rows["x"]["score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-8) and rows["y"]["score"] == pytest.approx(1 / 63, abs=1e-8)
    both = {r["id"]: r["score"] for r in fusion.relative_scores(a, b, 0.5).collect()}
    assert both["x"] == pytest.approx(0.5 + 0.5 / 3, abs=1e-6) and both["z"] == 0.5
    assert {r["id"] for r in fusion.weighted_ranks({"v": (1.0, a), "b": (1.0, b)}).collect()} == {"x", "y", "z"}


def test_scores_are_checked(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        vector.search(rows, [("q", [1.0, 0.0])], metric="other")
    assert vector.search(rows, [("q", [1.0, 0.0])]).count() == 1
    with pytest.raises(ValueError):
        vector.compatible({"dimensions": 3}, {"dimensions": 4})


def test_fulltext(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "green red"), (3, "blue sky red"), (4, None)], "doc_id int, text string")
    ids = lambda q: {r["id"] for r in fulltext.search(docs, q).collect()}
    assert ids("red") == {1, 2, 3} and ids("red -blue") == {2} and ids('"red green"') == {1} and ids("sky OR green") == {1, 2, 3}
    out = spark.sql("select 'a <<<Red>>> b <<<red>>> <<<Sky>>>' as h").select(fulltext.headline_terms(F.col("h"))).first()[0]
    assert out == ["red", "sky"]


def test_names(spark):
    assert entities.query_entities("How does UserService call load_file in MAX_SIZE") == ["How", "UserService", "load_file", "MAX_SIZE", "call"]
    assert entities.normalize_type("readme") == "README" and entities.normalize_type("Other") == "Other" and entities.normalize_type(None) is None
    paths = spark.createDataFrame([("src/main.py",), ("lib/utils.ts",), ("my-module.js",), (None,), ("",)], "p string")
    assert [r[0] for r in paths.select(entities.module_name(F.col("p"))).collect()] == ["main", "utils", "my_module", None, None]
    assert tx.query_tokens("The Python of python") == ["python"]


def test_metadata_triples(spark):
    schema = "chunk_id string, symbol_name string, symbol_type string, parent_symbol string, class_name string, source string, imports array<string>"
    rows = spark.createDataFrame([("c1", "main", "function", None, None, "src/main.py", ["os", "sys", "typing"]), ("c2", "get_user", "method", None, "UserService", None, None), ("c3", "run", None, "Pool", None, "a/b.py", [])], schema)
    made = {(r["subject"], r["predicate"], r["object"]) for r in triples.from_metadata(rows).collect()}
    assert {("main", "imports", m) for m in ("os", "sys", "typing")} < made
    assert ("UserService", "contains", "get_user") in made and ("Pool", "contains", "run") in made and ("main", "defined_in", "main") in made


def test_import_triples(spark):
    rows = [("1", "import os\nfrom a.b import c\n", "python", "x.py"), ("2", "import X from 'react'\nconst y = require('fs')", "javascript", "y.js"), ("3", "import java.util.List;", "java", "Z.java"), ("4", 'import (\n"fmt"\n"net/http"\n)', "go", "m.go"), ("5", None, None, None)]
    made = {r["object"] for r in triples.from_imports(spark.createDataFrame(rows, "chunk_id string, text string, language string, source string")).collect()}
    assert made == {"os", "a.b", "react", "fs", "java.util.List", "fmt", "net/http"}


def test_answer_triples(spark):
    rows = spark.createDataFrame([("1", "FastAPI | Framework | USES | Pydantic | Library\nA | calls | B\nbroken | line\n| | x")], "chunk_id string, answer string")
    made = [(r["subject"], r["predicate"], r["object"]) for r in triples.from_answers(rows).collect()]
    assert made == [("FastAPI", "uses", "Pydantic"), ("A", "calls", "B")]


def test_languages(spark):
    assert languages.preset_patterns(["python", "docs"]) == ["*.py", "*.pyi", "*.pyw", "*.md", "*.txt", "*.rst", "*.pdf"]
    with pytest.raises(ValueError):
        languages.preset_patterns(["nope"])
    rows = spark.createDataFrame([("a.PY", ""), ("a.txt", "import os\n\ndef f(x):\n  pass\nclass A:\n" * 5), ("b", None)], "p string, t string")
    assert [r[0] for r in rows.select(languages.detect(F.col("p"), F.col("t"))).collect()] == ["python", "python", None]


def test_files(spark, tmp_path):
    for name, body in {"doc.md": "# Title", "sub/code.py": "import os", "node_modules/x.js": "x", ".git/y.md": "y", "data.bin": "z"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    rows = {r["file_name"]: r for r in files.load(spark, str(tmp_path)).collect()}
    assert set(rows) == {"doc.md", "code.py"} and rows["code.py"]["language"] == "python" and rows["doc.md"]["source_type"] == "doc"
    assert files.list_files(spark, str(tmp_path)).count() == 4  # hidden folders are not listed
    assert set(r["file_path"] for r in files.checksums(spark, str(tmp_path)).collect()) >= {str(tmp_path / "doc.md")}
    assert files.sandbox(str(tmp_path / "doc.md"), [str(tmp_path)]).allowed
    assert files.sandbox(str(tmp_path / ".git/y.md"), [str(tmp_path)]).reason == "hidden_file"
    assert files.sandbox("/etc/passwd", [str(tmp_path)]).reason == "outside_indexed_roots"
    os.symlink("/etc/passwd", tmp_path / "link")
    assert files.sandbox(str(tmp_path / "link"), [str(tmp_path)]).reason == "symlink_escape"
    assert files.sandbox(str(tmp_path / "doc.md"), [str(tmp_path)], 1).reason == "size_limit"


def test_manifest(spark):
    old = spark.createDataFrame([("same", "a", 1.0, ["c1"]), ("touched", "b", 1.0, ["c2"]), ("new", "c", 1.0, ["c3"]), ("gone", "d", 1.0, ["c4"])], "file_path string, checksum string, mtime double, chunk_ids array<string>")
    now = spark.createDataFrame([("same", "x", 1.0), ("touched", "b", 2.0), ("new", "y", 2.0), ("more", "z", 2.0)], "file_path string, checksum string, mtime double")
    got = incremental.diff(old, now)
    assert {r["file_path"]: r["change"] for r in got.collect()} == {"same": "unchanged", "touched": "unchanged", "new": "changed", "gone": "deleted", "more": "added"}
    assert {r[0] for r in incremental.evicted(got).collect()} == {"c3", "c4"}
    assert {r["change"] for r in incremental.diff(old, now, force=True).collect()} == {"added", "deleted"}
    chunks = spark.createDataFrame([("new", "n1"), ("more", "n2")], "source string, chunk_id string")
    assert {r["file_path"]: r["chunk_ids"] for r in incremental.next_manifest(old, now, chunks).collect()} == {"same": ["c1"], "touched": ["c2"], "new": ["n1"], "more": ["n2"]}


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "chunk_id string, v int, seq int")
    made = tables.upsert(old, new, seq="seq")
    assert {(r[0], r[1]) for r in made.collect()} == {("a", 1), ("b", 4), ("c", 5)}
    store = tables.Versions(spark, f"file://{tmp_path}/t", old.schema)
    assert store.read().count() == 0
    store.write(old)
    store.write(made)
    assert store.read().count() == 3 and len(store.list()) == 2
    stay, go = tables.delete_ids(old, spark.createDataFrame([("a",), ("zz",)], "chunk_id string"))
    assert stay.count() == 1 and go.count() == 1
    snaps = tables.Snapshots(spark, f"file://{tmp_path}/s", old.schema)
    for _ in range(5):
        snaps.write(old, keep=2)
    assert len(snaps.list()) == 2 and snaps.read().count() == 2


def test_jobs(spark):
    log = spark.createDataFrame([("j1", 1, "pending", 0), ("j1", 2, "running", 3), ("j2", 1, "pending", 0), ("j3", 5, "running", 0)], "job_id string, seq int, status string, retry_count int")
    now = jobs.replay(log)
    assert jobs.stats(now).first()["running"] == 2
    assert {r["job_id"]: r["status"] for r in jobs.recover(now).collect()} == {"j1": "failed", "j2": "pending", "j3": "pending"}
    assert jobs.dedupe_key("/a", True, "index", ["b", "a"]) == jobs.dedupe_key("/a", True, "index", ["a", "b"])
    assert not jobs.full(now)
    flagged = jobs.cancel(now.withColumn("cancel_requested", F.lit(None).cast("boolean")), "j2")
    assert {r["job_id"]: r["status"] for r in flagged.collect()}["j2"] == "cancelled"


def test_caches(spark):
    assert caches.query_key({"a": [2, 1], "b": 1}) == caches.query_key({"b": 1, "a": [1, 2]}) != caches.query_key({"b": 1, "a": [1, 2]}, 1)
    now = [0.0]
    c = caches.QueryCache(ttl=10, entries=2, clock=lambda: now[0])
    for k in "xyz":
        c.put(k, k)
    assert c.get("x") is None and c.get("z") == "z"
    now[0] = 11
    assert c.get("z") is None and c.stats()["hit_rate"] == round(1 / 3, 4)


def test_chunks(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(25))), (2, "  "), (3, None)], "doc_id int, text string")
    rows = chunking.windows(docs, 10, 2).orderBy("chunk_index").collect()
    assert [r["token_count"] for r in rows] == [10, 10, 9] and rows[1]["text"].split()[0] == "w8" and rows[0]["total_chunks"] == 3
    parts = chunking.split_sentences("One two three. Four five six. Seven eight nine.", 6, 3)
    assert parts == ["One two three. Four five six.", "Four five six. Seven eight nine."]
    assert chunking.split_sentences("", 6, 3) == [] and chunking.split_sentences("a " * 13, 6, 3)[0] == "a a a a a a"
    code = spark.createDataFrame([("m.py", "import os\n\nclass A:\n    def f(self):\n        pass\n", "python"), ("e.py", "", "python")], "source string, text string, language string")
    found = {(r["name"], r["kind"], r["start_line"]) for r in chunking.symbols(code).collect()}
    assert found == {("A", "class", 3), ("f", "function", 4)}
    best = chunking.with_symbols(chunking.code_lines(code), chunking.symbols(code)).first()
    assert best["symbol_name"] == "f"
    doc = spark.sql("""select 'x = 1\n\"\"\"A long enough docstring\"\"\"' as t union all select '# about function f' union all select '// first\nx' union all select 'x'""")
    assert [r[0] for r in doc.select(chunking.fallback_summary(F.col("t"))).collect()] == ["A long enough docstring", "about function", "first", ""]


def test_result_shapes(spark):
    rows = spark.createDataFrame([("c", "/a/b.md", "t", None, "x", "en")], "chunk_id string, source string, text string, section_summary string, token_count string, language string")
    r = filters.chunk_records(rows).first()
    assert r["folder_id"] == "/a" and r["token_count"] == 0 and len(r) == 8
    merged = filters.inject(spark.createDataFrame([({"a": "1"},)], "extra map<string,string>"), "extra", {"a": 2, "b": 3, "c": [1], "source": "s"}, {"source"})
    assert merged.first()[0] == {"a": "2", "b": "3"}


def test_streams(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "x")]
    frame = spark.createDataFrame(rows, "k string, t int, v string").selectExpr("k", "timestamp_seconds(t) as ts", "v")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    q = feeds.change_feed(stream, "k", ["v"]).writeStream.format("memory").queryName("changes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("changes").count() == feeds.changed(frame, "k", ["ts"], ["v"]).count() == 3
    assert feeds.debounced(frame, "k", gap="5 seconds").count() == 2


def test_judged_and_context(spark, corpus):
    row = spark.sql("select 'Score: 12 of 10' as a, 'none' as b")
    assert tuple(row.select(rerank.judged(F.col("a")), rerank.judged(F.col("b"))).first()) == (10.0, 0.0)
    found = graph.entity_search(corpus.triples, ["python"], 5)
    assert graph.context(found).first()["entities"] == ["FastAPI", "Python"]
    assert graph.entity_record(corpus.triples, "module", "Nobody").count() == 0
    assert bm25.Index.build(corpus.chunks, "chunk_id").totals.first()["n"] == 3
    assert explain.reason(found, "graph") is not None
