"""The store of chunks, its folders, and the loop that builds it."""

import os

import pytest
from pyspark.sql import functions as F

from fathomry.operators import graph
from fathomry.plans import build
from fathomry.plans.store import ConflictError, NotFoundError, Store

BASE = [1.0, 0.0, 0.0]


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, f"file://{tmp_path}/store")
    made.initialize()
    return made


def put(store, ids, texts=None, vectors=None, **extra):
    texts = texts or [f"text {i}" for i in ids]
    return store.upsert_documents(store.rows(ids, vectors or [BASE] * len(ids), texts, [{"source": f"/s/{i}.md", "source_type": "doc", "n": k} | extra for k, i in enumerate(ids)]))


def ids(rows):
    return [r["chunk_id"] for r in rows.collect()]


def test_backend_calls(store):
    assert store.is_initialized and store.get_count() == 0
    assert ids(store.keyword_search("python")) == [] and ids(store.vector_search(BASE)) == []
    assert put(store, ["a", "b", "c"], ["python language", "java language", "a python web framework in python"], [BASE, [0.0, 1.0, 0.0], [0.8, 0.6, 0.0]]) == 3
    assert put(store, ["a"], ["python tool"]) == 1
    assert store.get_count() == 3 and store.get_count({"n": 0}) == 1 and store.get_count({"source": ["/s/a.md", "/s/b.md"]}) == 2
    assert store.get_by_id("a").first()["text"] == "python tool" and store.get_by_id("zzz").count() == 0
    assert store.get_chunk_by_id("b").first().asDict()["folder_id"] == "/s"
    near = store.vector_search(BASE, 2).collect()
    assert [r["chunk_id"] for r in near] == ["a", "c"] and all(0 <= r["score"] <= 1 for r in near)
    assert ids(store.vector_search(BASE, 3, 0.0, {"n": 1})) == ["b"]
    words = store.keyword_search("Python framework", 5, explain=True).collect()
    assert [r["chunk_id"] for r in words] == ["c", "a"] and words[0]["matched_terms"] == ["python", "framework"]
    assert ids(store.keyword_search("language")) == ["b"]
    assert ids(store.keyword_search("language", source_types=["code"])) == []
    assert store.delete_by_metadata({}) == 0 and store.delete_by_metadata({"n": 99}) == 0
    assert store.delete_by_metadata({"n": 1}) == 1
    gone = store.spark.createDataFrame([("c",), ("zzz",)], "chunk_id string")
    assert store.delete_by_ids(gone) == 1 and store.delete_by_ids(gone.limit(0)) == 0
    assert ids(store.keyword_search("python language framework")) == ["a"]
    assert store.get_embedding_metadata() is None
    store.set_embedding_metadata("p", "m", 3)
    store.validate_embedding_compatibility("p", "m", 3)
    with pytest.raises(ValueError, match="dimensions"):
        store.validate_embedding_compatibility("p", "m", 4)
    put(store, ["c"], ["python again"])
    store.compact()
    assert len(store.log()) == 1 and store.vacuum() > 0
    assert sorted(ids(store.chunks())) == ["a", "c"] and sorted(ids(store.keyword_search("python"))) == ["a", "c"]
    assert store.get_embedding_metadata()["model"] == "m"
    with pytest.raises(ValueError, match="length"):
        store.rows(["a"], [], ["x"], [{}])
    store.reset()
    assert store.is_initialized and store.get_count() == 0


def test_two_writers_lose_nothing(spark, store):
    other = Store(spark, store.path)
    put(store, ["a", "b"])
    claim, told = store._claim, []

    def late(n, entry):
        if not told:
            told.append(n)
            put(other, ["c", "a"])
        return claim(n, entry)

    store._claim = late
    assert store.delete_by_metadata({"source": ["/s/a.md", "/s/c.md"]}) == 2
    assert ids(store.chunks()) == ["b"]
    told.clear()
    with pytest.raises(ConflictError):
        store.compact()
    assert sorted(ids(other.chunks())) == ["a", "b", "c"]
    store._claim = claim
    twice = store.rows(["x", "x", None], [BASE] * 3, ["one", "two", "no"], [{}] * 3).coalesce(1).withColumn("other", F.lit(1))
    assert store.upsert_documents(twice) == 1 and store.get_by_id("x").first()["text"] == "two"
    assert store.upsert_documents(twice.limit(0)) == 0


CODE = "import os\nfrom pkg.util import thing\n\n\nclass Shop:\n    def sell(self):\n        return os.name\n"


def test_folder_build(spark, store, tmp_path):
    src = tmp_path / "src"
    (src / "node_modules").mkdir(parents=True)
    for name, text in (("a.md", "Alpha words here. More of them."), ("shop.py", CODE), ("node_modules/x.md", "no"), ("b.md", "")):
        (src / name).write_text(text)
    lengths = lambda texts: [[float(len(t)), 1.0] for t in texts]
    root, model = str(src), {"provider": "p", "model": "m", "dimensions": 2}
    first = build.index_folder(store, root, lengths, model)
    assert first["files_added"] == 2 and first["chunks"] == 2
    assert build.index_folder(store, root, lengths, model)["chunks"] == 0 and len(store.log()) == 1
    names = {r["source"]: r for r in store.chunks().collect()}
    assert set(map(os.path.basename, names)) == {"a.md", "shop.py"}
    assert names[f"{root}/shop.py"]["metadata"]["symbol_name"] == "sell"
    assert names[f"{root}/a.md"]["embedding"] == [31.0, 1.0]
    edges = {(r["subject"], r["predicate"], r["object"]) for r in store.triples().collect()}
    assert {("shop", "imports", "os"), ("shop", "imports", "pkg.util"), ("sell", "defined_in", "shop")} <= edges
    assert {r["name"]: r["entity_type"] for r in graph.first_types(store.triples()).collect()}["sell"] == "Function"
    (src / "shop.py").unlink()
    (src / "a.md").write_text("Beta words.")
    (src / "c.md").write_text("Gamma.")
    told = build.index_folder(store, root, lengths, model, batch="x#1")
    assert (told["files_added"], told["files_changed"], told["files_deleted"], told["files_unchanged"], told["gone"], told["chunks"]) == (1, 1, 1, 0, 2, 2)
    assert sorted(r["text"] for r in store.chunks().collect()) == ["Beta words.", "Gamma."] and store.triples().count() == 0
    assert build.index_folder(store, root, lengths, model, force=True, batch="x#1")["chunks"] == 0
    forced = build.index_folder(store, root, lengths, model | {"model": "n"}, force=True)
    assert forced["chunks"] == 2 and store.get_embedding_metadata()["model"] == "n"
    with pytest.raises(ValueError, match="model"):
        build.index_folder(store, root, lengths, model)
    store.compact()
    assert [tuple(r) for r in store.folder_counts().collect()] == [(root, 2, 2)]
    assert build.index_folder(store, root)["files_unchanged"] == 2
    busy = spark.createDataFrame([("running", root)], "status string, folder_path string")
    with pytest.raises(ConflictError):
        store.remove_folder(root, busy)
    with pytest.raises(NotFoundError):
        store.remove_folder(root + "/no")
    assert store.remove_folder(root, busy.where("status = 'done'")) == 2
    assert store.get_count() == 0 and store.folders() == {} and ids(store.keyword_search("Beta Gamma")) == []


def test_a_watched_folder_is_followed(spark, store, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.md").write_text("One.")

    def step():
        query = build.follow(store, str(src), str(tmp_path / "ledger"), str(tmp_path / "cp"), {"availableNow": True})
        assert query.awaitTermination(120) and query.exception() is None
        return sorted(r["text"] for r in store.chunks().collect())

    assert step() == ["One."]
    (src / "a.md").write_text("Two.")
    (src / "b.md").write_text("Three.")
    assert step() == ["Three.", "Two."]
    assert [b.rsplit("#", 1)[1] for e in store.log() for b in e["batches"]] == ["0", "1"]
