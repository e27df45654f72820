"""op12 against a brute force over all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fathomry.llm import op12_spelling_variants as op

rng = np.random.default_rng(12)


def one_edit(x, y):
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute(n, ratio=10):
    out, form = {}, {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        top = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= ratio * n[w] else None
        out[w] = len(near)
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] is not None else None))
    return sorted(rows)


def got(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect())


def vocabulary(size, alphabet, shortest, longest):
    words = {"".join(rng.choice(list(alphabet), rng.integers(shortest, longest + 1))) for _ in range(size)}
    return {w: int(10 ** rng.uniform(0, 4)) for w in words}


def test_tree_reports_every_point():
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        a, b = np.sort(rng.integers(0, n + 1, (2, 40)), axis=0)
        lo, hi = np.sort(rng.integers(0, n + 1, (2, 40)), axis=0)
        of, value = op.WaveletTree(values).report(a, b, lo, hi)
        want = sorted((i, v) for i in range(40) for v in values[a[i] : b[i]].tolist() if lo[i] <= v < hi[i])
        assert sorted(zip(of.tolist(), value.tolist(), strict=True)) == want


@pytest.mark.parametrize("bounds", [None, (8, 16)])
def test_variants_against_brute_force(spark, monkeypatch, bounds):
    if bounds:
        monkeypatch.setattr(op, "HOT", bounds[0])
    n = vocabulary(300, "ab", 0, 7) | vocabulary(200, "aéz", 3, 6) | vocabulary(100, "abcdefgh", 7, 12)
    n |= {"q" * 9: 4000, "q" * 8: 30, "q" * 10: 300, "q" * 8 + "p": 3, "日本語日本語日": 50, "日本語日本語": 2, "😀abcdefg": 90, "abcdefg": 9}
    frame = spark.createDataFrame([(w, c, 1) for w, c in n.items()] + [(None, 5, 1)], "word string, n long, root int")
    assert got(op.variants(frame)) == brute(n)


def test_small_groups_of_a_task(spark, monkeypatch):
    n = vocabulary(400, "abc", 7, 8)
    words = sorted(n)
    rows = [(w, n[w]) for w in words]
    frame = spark.createDataFrame(rows, "word string, n long")
    whole = got(op.near_words(frame).selectExpr("word", "near form", "near root", "near_n n", "n_near", "near_n form_n"))
    batches = op._dealt(frame).sort("m", "lo", "hi", "bucket").toArrow().to_batches(max_chunksize=50)
    monkeypatch.setattr(op, "GROUP", 20)
    total = Counter()
    for b in op._ask(batches):
        for w, k in zip(b["word"].to_pylist(), b["near"].to_pylist(), strict=True):
            total[w] += k
    assert dict(total) == {r[0]: r[4] for r in whole}


def expected(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return brute({w: c for w, c in n.items() if c >= 2})


def test_query_against_brute_force(spark, tmp_path):
    words = ["Training", "trainings", "Über÷groß", "tokenizer", "corpora-building", "ÀÉÎõüñß", "datasets", "datasest", "shingle", "shingles", "x" * 30]
    rows = [(int(i), " ".join(rng.choice(words, 40)) + "1") for i in range(400)] + [(7, None), (8, ""), (None, "training tokenizer"), (3, "Training " * 50), (4, "y" * 20_000 + " " + "y" * 20_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op.query(spark, str(tmp_path))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    made = expected(rows)
    assert got(out) == made and sum(r[1] is not None for r in made) > 20


def test_empty(spark):
    assert op.variants(spark.createDataFrame([], "word string, n long")).count() == 0
