"""The pipeline's stages on a small table: each judged on its own input."""

import os
import re

import pytest
import sentencepiece

import corpus_pipeline
from fathomry.llm import op7_anchor_simhash, op8_blob_ledger, op10_piece_codec

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    root = tmp_path_factory.mktemp("stages")
    made = {"documents": docs}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{root}/{i}")
        docs = made[name] = spark.read.parquet(f"{root}/{i}")
    return {k: v.toPandas() for k, v in made.items()}


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "encoding"]


def test_toxicity_drops_only_toxic(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    gone = set(stages["documents"]["doc_id"]) - set(stages["toxicity"]["doc_id"])
    assert not [i for i in gone if labels.get(i, 1) == 0]


def shingles(text):
    """Sets of five words, by plain strings."""
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_one_of_each_group(stages):
    before, after = stages["toxicity"], stages["near_dedup"]
    sets = {r.doc_id: shingles(r.text) for r in before.itertuples()}
    assert len(sets) == len(before) and set(after["doc_id"]) <= set(sets)
    kept = list(after["doc_id"])
    assert len(set(kept)) == len(kept) < len(sets)
    assert not [(a, b) for i, a in enumerate(kept) for b in kept[i + 1 :] if alike(sets[a], sets[b])]
    # who went is connected, by documents alike to 0.8, to one that stayed with a smaller id
    reached = {k: k for k in kept}
    todo = list(kept)
    while todo:
        i = todo.pop()
        for j in sets:
            if j not in reached and alike(sets[i], sets[j]):
                reached[j] = reached[i]
                todo.append(j)
    assert set(reached) == set(sets) and all(k <= j for j, k in reached.items())


def test_secrets_are_gone(spark, stages):
    assert len(stages["secrets"]) == len(stages["near_dedup"])
    left = op8_blob_ledger.scan(spark.createDataFrame(stages["secrets"][["doc_id", "text"]])).toPandas()
    assert left["findings"].map(len).sum() == 0
    assert (stages["secrets"]["n_chars"] == stages["secrets"]["text"].str.len()).all()


def test_mix_repeats_documents(stages):
    size = stages["secrets"]["text"].map(lambda t: len(t.encode().split())).sum()
    taken = stages["mixing"]["text"].map(lambda t: len(t.encode().split())).sum()
    assert abs(taken / size - 1.5) < 0.1 and stages["mixing"]["doc_id"].value_counts().max() <= 2


def test_tokens(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=op10_piece_codec.model_path())
    texts = stages["mixing"].drop_duplicates("doc_id").set_index("doc_id")["text"]
    assert len(stages["encoding"]) == len(stages["mixing"])
    for r in stages["encoding"].itertuples():
        assert list(r.ids) == library.encode(texts[r.doc_id])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_awkward_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one two three four five six " * 30, "en", "s", 840), (1, "one two three four five six " * 30, "en", "s", 840), (2, None, None, None, None), (None, "", "en", None, 0), (None, None, None, "s", None), (5, "x", "de", "s", 1)]
    out = stage(spark, spark.createDataFrame(rows, columns), SF)
    assert out.count() >= 3
    assert stage(spark, spark.createDataFrame([], columns), SF).count() == 0


def test_keep_one_drops_and_keeps_single_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (3, "b"), (None, "a"), (None, "c"), (None, "c"), (4, None), (5, None), (3, "d")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string")

    def same_text(d, text, key):
        return d.withColumn("component", op7_anchor_simhash.F.xxhash64(op7_anchor_simhash.F.coalesce(text, op7_anchor_simhash.F.lit("")))).drop(text)

    out = op7_anchor_simhash.keep_one(docs, find=same_text)
    assert out.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(1, "a"), (3, "b"), (None, "c"), (4, None), (3, "d")]))
