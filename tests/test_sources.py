"""DOCX files, pruned walks, token counts and smaller shapes of results and queues."""

import base64
import datetime as dt
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from fathomry.operators import chunking, filters, graph, jobs
from fathomry.sources import docx, files
from fathomry.sources.walk import walk

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def packed(body, part="word/document.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(part, f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def line(*runs):
    return "<w:p>" + "".join(f"<w:r>{r}</w:r>" for r in runs) + "</w:p>"


BODY = line("<w:t>One </w:t>", "<w:t>line &amp; é</w:t>") + "<w:tbl><w:tr><w:tc>" + line("<w:t>cell</w:t><w:tab/><w:t>b</w:t>") + "</w:tc></w:tr></w:tbl>" + line("<w:delText>gone</w:delText><w:t>kept</w:t><w:br/><w:t>next</w:t>") + line()


def test_docx_text():
    assert docx.text_of(packed(BODY)) == "One line & é\ncell\tb\nkept\nnext\n"
    assert docx.text_of(packed("")) == ""
    for bad in (None, b"", b"no zip", packed(BODY, "other.xml"), packed("<w:p>")):
        assert docx.text_of(bad) is None
    long = packed(line("<w:t>" + "word " * 300_000 + "</w:t>") * 2)
    assert len(docx.text_of(long)) == 2 * 1_500_000 + 1


def test_load_reads_docx_beside_others(spark, tmp_path):
    (tmp_path / "a.DOCX").write_bytes(packed(BODY))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "b.md").write_text("# b")
    rows = {r["file_name"]: r for r in files.load(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.DOCX", "bad.docx", "b.md"}
    assert rows["a.DOCX"]["text"].startswith("One line") and rows["bad.docx"]["text"] is None and rows["b.md"]["text"] == "# b"
    assert (rows["a.DOCX"]["source_type"], rows["a.DOCX"]["language"]) == ("doc", "markdown")
    assert [r["file_name"] for r in files.load(spark, str(tmp_path), patterns=["*.md"]).collect()] == ["b.md"]


def test_walk_enters_no_excluded_folder(spark, tmp_path):
    made = ["a.md", "src/b.py", "src/deep/er/c.py", "node_modules/x/y.js", "src/node_modules/z.js", ".git/config", "src/deep/d.txt"]
    for m in made:
        (tmp_path / m).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / m).write_text(m)
    os.symlink(tmp_path / "gone", tmp_path / "broken")
    shut = tmp_path / "node_modules"
    shut.chmod(0)  # who lists it fails, unless run by root
    try:
        rows = {r["relative"]: r for r in walk(spark, str(tmp_path)).collect()}
    finally:
        shut.chmod(0o755)
    assert set(rows) == {"a.md", "src/b.py", "src/deep/er/c.py", "src/deep/d.txt"}
    assert rows["src/b.py"]["size"] == 8 and rows["src/b.py"]["path"] == str(tmp_path / "src/b.py")
    assert {r["relative"] for r in walk(spark, str(tmp_path), []).collect()} >= {"node_modules/x/y.js", "src/node_modules/z.js"}
    assert {r["relative"] for r in walk(spark, str(tmp_path), ["**/deep/**", "**/*.py"]).collect()} == {"a.md", "node_modules/x/y.js", "src/node_modules/z.js"}
    assert walk(spark, str(tmp_path / "nowhere")).count() == 0


def test_token_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    at = public.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(at, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world", "", None, "a <|endoftext|> b", "é😀 \n\n x", "word " * 250_000]
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id int, text string, token_count int")
    got = {r["id"]: r["token_count"] for r in chunking.token_counts(rows, at, public.PATTERN).collect()}
    assert got == {i: len(coder.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert chunking.token_counts(rows.limit(0), at, public.PATTERN).count() == 0


def test_results_lose_keys_that_are_columns(spark):
    rows = spark.createDataFrame([("s", None, {"source": "x", "file_path": "y", "source_type": "z", "language": "l", "page": "3"}), (None, "code", None)], "source string, source_type string, metadata map<string,string>")
    got = [tuple(r) for r in filters.results(rows).collect()]
    assert got == [("s", "doc", {"page": "3"}), ("unknown", "code", None)]


def test_the_running_job(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    kind = "job_id string, status string, started_at timestamp"
    rows = [("b", "running", at(5)), ("a", "running", at(5)), ("c", "done", at(1)), ("d", "running", None)]
    now = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:07")))
    assert tuple(jobs.current(spark.createDataFrame(rows, kind), now).first()) == ("a", 2000)
    assert tuple(jobs.current(spark.createDataFrame(rows[3:], kind), now).first()) == ("d", None)
    assert tuple(jobs.current(spark.createDataFrame(rows[2:3], kind), now).first()) == (None, None)


def test_search_by_type_cuts_after_its_search(spark):
    rows = [("App", "Class" if i % 2 else "Module", "calls" if i % 3 else "contains", f"f{i}", "Function", i) for i in range(12)]
    triples = spark.createDataFrame(rows, "subject string, subject_type string, predicate string, object string, object_type string, source_chunk_id long")
    got = [r["source_chunk_id"] for r in graph.search_by_type(triples, ["app"], ["class"], ["CALLS"], 3).collect()]
    assert got == [i for i in range(9) if i % 2 and i % 3][:3]
    assert graph.search_by_type(triples, ["app"], ["schema"], k=2).count() == 0
