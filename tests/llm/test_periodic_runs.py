"""op11 against a brute force over all periods."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry.llm import op11_periodic_runs as op

rng = np.random.default_rng(11)


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[: len(w) - q])


def brute(w, least=24, power=3):
    """Every maximal stretch of every period, kept if the period is its smallest."""
    out = []
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, power * q) and smallest_period(w[i : i + n]) == q:
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        return w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    return w


def expected(doc_id, text):
    w = planted(doc_id, (text or "").encode().split())
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    tail = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *tail, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def periodic(q, n, sigma=4):
    block = rng.integers(0, sigma, q).tolist()
    return (block * (n // q + 2))[rng.integers(0, q) :][:n]


def samples():
    yield [0] * 200
    yield [0, 1] * 50
    yield list(range(100)) * 3
    for _ in range(250):
        w = []
        for _ in range(rng.integers(1, 6)):
            if rng.random() < 0.6:
                w += periodic(int(rng.integers(1, 14)), int(rng.integers(5, 90)), int(rng.integers(2, 6)))
            else:
                w += rng.integers(0, rng.integers(1, 30) + 1, rng.integers(0, 60)).tolist()
        # the same passage again, now and then
        yield w + w[: rng.integers(0, len(w) + 1)] if rng.random() < 0.4 else w


def test_runs_against_brute_force():
    seen = 0
    for w in samples():
        assert op.find_runs(w) == brute(w)
        seen += len(brute(w))
    assert seen > 200


def test_other_bounds():
    for w in list(samples())[:80]:
        assert op.find_runs(w, 9, 4) == brute(w, 9, 4)
        assert op.find_runs(w, 13, 3) == brute(w, 13, 3)


def test_nested_runs():
    inner = [1, 2] * 14
    w = (inner + [3]) * 4
    assert op.find_runs(w) == brute(w) and len(brute(w)) == 5


def test_end_positions_keep_order():
    xs = rng.permutation(3000).tolist()
    got = op.EndPositions(xs[0])
    known = [xs[0]]
    for x in xs[1:]:
        below, above = got.add(x)
        assert below == max((k for k in known if k < x), default=None) and above == min((k for k in known if k > x), default=None)
        known.append(x)
    assert list(got) == sorted(xs) and got.size == len(xs)


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", " \t", "a " * 23, "a " * 24, "x y\tz\n" * 9, "lorem ipsum " * 40 + "end", "a b c " * 30 + "d e " * 20, "é ü\x0bß\x0c" * 11]
    prose = [" ".join(rng.choice(["the", "of", "data", "spark", "Über", "eau"], 120)) for _ in range(60)]
    return [(i, t) for i, t in enumerate(texts + prose)] + [(6, texts[6]), (None, texts[5])]


def test_query_against_brute_force(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op.query(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)


def test_interface_keeps_columns(spark, rows):
    docs = spark.createDataFrame([(*r, "mine", 7) for r in rows], "doc_id long, text string, runs string, n_words int")
    out = op.periodic_runs(docs, outputs=("runs", "collapsed"))
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[6].collapsed == "lorem ipsum end" and got[6].n_words == 7 and got[0].runs == [] and got[0].collapsed == ""
    assert op.periodic_runs(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    text = "one two three four five six seven " * 40_000 + " ".join(map(str, range(50_000))) + " z" * 100_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").select("doc_id", F.col("text"))
    r = op.periodic_runs(docs).first()
    assert [tuple(x) for x in r.runs] == [(0, 280_000, 7), (330_000, 100_000, 1)] and len(r.collapsed.split()) == 7 + 50_000 + 1
