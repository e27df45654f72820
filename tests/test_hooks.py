import hashlib

import pytest

from fathomry.operators import hooks


def test_process_keeps_failing_chunks(spark):
    chunks = spark.createDataFrame([("c1", "one two", {"a": "1"}), ("c2", None, None)], "chunk_id string, text string, extra map<string,string>")

    def count(chunk):
        return {**chunk, "words": len(chunk["text"].split()), "text": "changed", "list": [1]}

    rows = {r["chunk_id"]: r for r in hooks.process(chunks, count).collect()}
    assert rows["c1"]["extra"] == {"a": "1", "words": "2"} and rows["c1"]["text"] == "one two" and rows["c1"]["process_error"] is None
    assert rows["c2"]["extra"] == {} and rows["c2"]["process_error"].startswith("AttributeError")
    report = hooks.dry_run(chunks, count).first()
    assert report["keys"] == ["a", "words"] and report["errors"] == 1


def test_scripts_are_allowed_by_hash(tmp_path):
    script = tmp_path / "s.py"
    script.write_text("def process_chunk(chunk):\n    return {'x': 1}\n")
    digest = hashlib.sha256(script.read_bytes()).hexdigest()
    assert hooks.load_script(str(script), {digest})({}) == {"x": 1}
    with pytest.raises(PermissionError):
        hooks.load_script(str(script), set())


def test_embedding_batches(spark):
    texts = spark.createDataFrame([(i, "x" * i) for i in range(25)], "id int, text string").coalesce(1)

    def lengths(batch):
        assert len(batch) <= 10
        return [[float(len(t))] for t in batch]

    assert {r["id"]: r["embedding"] for r in hooks.embed(texts, lengths, size=10).collect()} == {i: [float(i)] for i in range(25)}
