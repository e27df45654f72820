"""Near duplicates by five-word shingles and similarity 0.8, against brute force."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from fathomry.llm import op7_anchor_simhash, similar_sets

VOCAB = [f"w{i}" for i in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    rng = np.random.default_rng(11)
    texts = [None, "", " \t", "one", "One", "one two", "a b c d", "a b c d e"]
    for n in (6, 9, 10, 14, 40, 90, 200, 700):
        base = [str(w) for w in rng.choice(VOCAB, n)]
        texts += [" ".join(base), " ".join(base), " ".join(base).upper()]
        for edits in (1, 1, 2, 3, 5, 9, 14):
            w = list(base)
            for at in rng.integers(0, n, edits):
                w[at] = "changed"
            texts += [" ".join(w), " ".join(w[1:]), " ".join(base[: n * 4 // 5])]
    # a passage that most texts hold
    passage = " ".join(str(w) for w in rng.choice(VOCAB, 60))
    texts += [passage + " " + " ".join(str(w) for w in rng.choice(VOCAB, n)) for n in (3, 5, 10, 15, 20, 40, 60, 90) for _ in range(6)]
    return [(i, t) for i, t in enumerate(texts)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def groups(rows):
    sets, top = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for a, b in combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            old, new = top[b], top[a]
            top = {k: new if v == old else v for k, v in top.items()}
    out = {}
    for i, g in top.items():
        out.setdefault(g, set()).add(i)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("sample", [20_000, 1])
def test_groups_by_definition(spark, monkeypatch, sample):
    monkeypatch.setattr(similar_sets, "SAMPLE", sample)
    monkeypatch.setattr(similar_sets, "PAIRS", 50)
    rows = made()
    out = similar_sets.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).toPandas()
    found = sorted(sorted(int(i) for i in g) for g in out.groupby("component")["doc_id"].apply(list))
    assert found == groups(rows) and 20 < len(found) < len(rows) - 20


def test_no_rows(spark):
    assert similar_sets.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_keeps_one_of_edited_copies(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, None).toPandas()
    assert sorted(kept["doc_id"]) == [g[0] for g in groups(rows)]


def test_family_of_edited_copies(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in (60, 140):
        base = [f"b{n}_{i}" for i in range(n)]
        sites = rng.integers(0, n, 6)
        for i in range(70):
            w = list(base)
            # some places are edited in many copies, some edits are the same
            for at in np.r_[rng.choice(sites, 2), rng.integers(0, n, rng.integers(0, 3))]:
                w[at] = f"x{rng.integers(0, 3)}" if at in sites else f"y{i}"
            rows.append((len(rows), " ".join(w)))
    out = similar_sets.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).toPandas()
    found = sorted(sorted(int(i) for i in g) for g in out.groupby("component")["doc_id"].apply(list))
    assert found == groups(rows) and 4 < len(found) < 100


def test_forest_links_what_is_alike():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(2, 12))
        shared = [np.unique(rng.integers(0, 9, rng.integers(1, 7))) for _ in range(n)]
        h, free = rng.integers(-5, 40, n), rng.random(n) < 0.7
        links = similar_sets.forest_in(np.arange(n), h, free, shared)
        ok = lambda a, b: h[a] + h[b] <= 18 * len(np.intersect1d(shared[a], shared[b]))
        assert all(ok(a, b) for a, b in links)
        tied = [(a, b) for a, b in combinations(range(n), 2) if not (free[a] or free[b])]
        sure = [(a, b) for a, b in combinations(range(n), 2) if (free[a] or free[b]) and ok(a, b)]
        assert parts(n, tied + sure) == parts(n, tied + links)


def parts(n, links):
    top = list(range(n))
    for a, b in links:
        old, new = top[b], top[a]
        top = [new if t == old else t for t in top]
    return [top.index(t) for t in top]


def test_fingerprint_anchors_name_candidates(spark):
    rows = made()
    texts = spark.createDataFrame([(t,) for _, t in rows], "__text string").repartition(3)
    each = similar_sets.prints(texts).toPandas()
    node, fp = each["node"].tolist(), each["fp"].to_numpy().view(np.uint64)
    assert len(node) == len({shingles(t) for _, t in rows})
    at = {n: i for i, n in enumerate(node)}
    got = [(at[r.a], at[r.b]) for r in similar_sets.anchored(texts).collect()]
    want = [(a, b) for a, b in combinations(range(len(node)), 2) if np.bitwise_count(fp[a] ^ fp[b]) <= op7_anchor_simhash.BITS]
    assert set(map(frozenset, got)) <= set(map(frozenset, want)) and parts(len(node), got) == parts(len(node), want)
    assert len(want) > 20


def test_stage_links_by_anchors_alone(spark, monkeypatch):
    """Where the join by prefixes finds nothing, the candidates of fingerprints are still compared, and only alike sets linked."""
    rows, prefixes = made(), similar_sets.prefixes
    monkeypatch.setattr(similar_sets, "prefixes", lambda texts: prefixes(texts).where("false"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    kept = set(corpus_pipeline.near_dedup(spark, docs, None).toPandas()["doc_id"])
    assert {g[0] for g in groups(rows)} <= kept and len(kept) < len({shingles(t) for _, t in rows})


def test_tasks_work_on_parts_of_batches():
    n = 3 * similar_sets.common.SLICE_ROWS
    texts = pa.RecordBatch.from_arrays([pa.array([f"a b c d e f {i}" for i in range(n)])], names=["__text"])
    parts = [len(node) for _, _, node, _ in similar_sets._each_set(iter([texts]))]
    assert sum(parts) == n and max(parts) <= similar_sets.common.SLICE_ROWS
    members = pa.array([[1, 2, 3, i + 4] for i in range(n)], pa.list_(pa.int64()))
    ids = pa.array(range(n), pa.int64())
    pairs = pa.RecordBatch.from_arrays([ids, ids, members, members], names=["a", "b", "x", "y"])
    out = list(similar_sets._compare(iter([pairs])))
    assert sum(b.num_rows for b in out) == n and max(b.num_rows for b in out) <= similar_sets.common.SLICE_ROWS


def test_candidates_of_a_large_bucket_are_passed_on_in_parts():
    n = 600
    token, size, place = np.zeros(n, np.int64), np.full(n, 100), np.zeros(n, np.int64)
    held = [len(x[0]) for x in similar_sets.pairs_in(token, size, place, np.arange(n), np.arange(n), np.arange(n))]
    assert sum(held) == n * (n - 1) // 2 and max(held) < 140_000
