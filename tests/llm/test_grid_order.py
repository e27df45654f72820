"""op13 against all pairs."""

import numpy as np
import pytest

from fathomry.llm import op13_grid_order as op

rng = np.random.default_rng(13)


def near(x, scale):
    return (np.array(x) + rng.normal(0, scale, len(x))).tolist()


def vectors(kind):
    out = []
    if kind == "flat":  # leading axes tell groups apart
        centres = rng.normal(0, 1, (40, 3)) @ rng.normal(0, 1, (3, 8))
        out = [near(c, 0.15) for c in centres for _ in range(15)]
    elif kind == "even":
        base = rng.normal(0, 1, (250, 12))
        out = [x.tolist() for x in base] + [near(x, 0.15) for x in base[:60]] + [near(base[0], 0.2) for _ in range(80)]
    elif kind == "chain":
        turn = np.linspace(0, 5, 200)
        out = [[float(np.cos(t)), float(np.sin(t)), 0.0] for t in turn]
    out += [out[3]] * 30 + [[2 * x for x in out[3]], [-x for x in out[3]]]
    return out


ODD = [None, [], [0.0] * 4, [1.0, None, 2.0], [1.0, float("nan")], [float("inf"), 1.0], [1.0, 2.0], [2.0, 4.0], [1e200, 2e200], [5e-324, 1e-323], [3.0], [7.0], [-1.0]]


def brute(rows, least=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = [0] * len(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(rows):
        for j, (_, y) in enumerate(rows[:i]):
            if ok[i] and ok[j] and len(x) == len(y):
                a, b = np.array(x) / np.abs(x).max(), np.array(y) / np.abs(y).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    n[i] += 1
                    n[j] += 1
                    root[find(i)] = find(j)
    least_id = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        known = [x for x in (least_id.get(r), k) if x is not None]
        least_id[r] = min(known, default=None)
    return sorted(((k, n[i], least_id[find(i)], k == least_id[find(i)]) for i, (k, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("kind", ["flat", "even", "chain"])
def test_against_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(op, "BLOCK", 32)
    monkeypatch.setattr(op, "FAN", 3)
    monkeypatch.setattr(op, "LEFT", 2)
    monkeypatch.setattr(op, "RIGHT", 3)
    rows = [(int(i), v) for i, v in zip(rng.permutation(2000), vectors(kind) + ODD, strict=False)]
    rows += [rows[5], (None, rows[5][1]), (None, [9.0, -9.0, 9.0]), (None, None)]
    frame = spark.createDataFrame([(k, v, True, "x") for k, v in rows], "vec_id long, embedding array<double>, kept boolean, cls string").repartition(3)
    out = op.near_duplicates(frame)
    assert out.columns == ["vec_id", "cls", "n_links", "component_id", "kept"]
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()), key=str) == brute(rows)


def test_distant_blocks_are_skipped(spark):
    rows = [(int(i), near(c, 0.01)) for i, c in enumerate(np.repeat(np.eye(16), 100, 0))]
    frame = spark.createDataFrame(rows, "cls long, v array<double>").selectExpr("cls", "1L n", "v", "xxhash64(v) h")
    order = op.placed(frame, op.axes(frame), 0.447).repartitionByRange(16, "length", "cells", "cls")
    boxes = order.withColumn("node", op.F.spark_partition_id()).groupBy("length", "node").agg(*[f(p).alias(f"{e}{p[1:]}") for p in op._PLACES for e, f in (("lo", op.F.min), ("hi", op.F.max))])
    n = boxes.count()
    assert n > 8 and n <= op.interval_pairs(boxes, 0.447).count() < n * (n + 1) / 2 / 2


def test_close_products_are_summed_exactly(spark):
    x, y = [3.0, 4.0], [4.0, 3.0]  # cosine 24 / 25
    frame = spark.createDataFrame([(1, x), (2, y)], "vec_id long, embedding array<double>")
    assert [r.n_links for r in op.near_duplicates(frame, least=24 / 25).collect()] == [1, 1]
    assert [r.n_links for r in op.near_duplicates(frame, least=24 / 25 + 1e-12).collect()] == [0, 0]


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op.near_duplicates(frame).count() == 0
    frame = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in op.near_duplicates(frame).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
