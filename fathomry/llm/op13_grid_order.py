"""Embedding near-dedup with an epsilon grid order join.

Unit vectors of cosine c lie sqrt(2 - 2c) apart, so one threshold is a distance, epsilon.

1. Equal vectors are one class, with their number. All later work is on classes.
2. Classes are turned to the leading principal axes, and put in the order of their cells of
   side epsilon there, so a stretch of the order is a region of space. The order is
   cut into blocks of about BLOCK classes, each with its bounds along the axes and
   of what is left of a vector beyond them.
3. Blocks are joined as intervals, from the whole order downwards: a pair of intervals is
   followed into the pairs of its FAN parts only if their bounds come as near as epsilon. What is
   provably farther apart is never looked into. This is a join of tables of bounds.
4. Pairs of blocks that remain are dealt in units of LEFT by RIGHT blocks, so a vector travels to
   as many tasks as there are such units in its row and column. A task multiplies
   blocks as matrices in double precision; products close to the threshold are summed exactly.
   What leaves it is, for each class, how many vectors it links to, and one
   link to its group among the unit's left blocks: never the pairs of a group.
5. Groups are connected by distributed star steps.

The axes are fitted on at most SAMPLE_BYTES of vectors of each length: the sample moves work, not
results, as distances along any axes at right angles are lower bounds. Where vectors are spread
evenly in many dimensions nothing is provably far, and all blocks meet.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, and so do vectors of different lengths; repeated rows
are vectors of their own; a null id is a component's id only if there is no
other; an empty table gives an empty result; other columns are kept, and columns
named like the outputs are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

LEAST = 0.9
#: Principal axes, and classes of a block.
AXES, BLOCK = 16, 1024
#: Parts of an interval, and blocks of a unit on either side.
FAN, LEFT, RIGHT = 16, 8, 32
SAMPLE_BYTES = 16 << 20
#: Products this close to the threshold are computed again; distances are compared with as much to spare.
CLOSE = 1e-9
OUTPUTS = ("n_links", "component_id", "kept")


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def scaled(column: pa.ListArray | pa.ChunkedArray, length: int) -> np.ndarray:
    """The vectors as doubles, brought near to one by powers of two, which changes no digit."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length).astype(float)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    dot = lambda a, b: math.fsum((a * b).tolist())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the leading principal axes of a sample, as columns."""
    made = {}
    for length in [r[0] for r in classes.select(F.size("v").alias("n")).distinct().collect()]:
        many = max(2, min(1 << 14, SAMPLE_BYTES // (8 * length)))
        rows = classes.where(F.size("v") == length).select("h", "v").orderBy("h").limit(many).toArrow()
        sample = units(scaled(rows["v"].combine_chunks(), length))
        spread = sample - sample.mean(0)
        _, vectors = np.linalg.eigh(spread.T @ spread)
        made[length] = np.ascontiguousarray(vectors[:, ::-1][:, :AXES])
    return made


def placed(classes: DataFrame, turn: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """The classes (cls, n, v) with ``length``, their cells and their places p0 to pAXES; the last is what the axes leave."""
    sent = classes.sparkSession.sparkContext.broadcast(turn)
    kind = classes.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == length))
                x = units(scaled(part.column("v"), length))
                on = x @ sent.value[length]
                rest = np.sqrt(np.maximum(0, (x * x).sum(1) - (on * on).sum(1)))
                on = np.pad(on, ((0, 0), (0, AXES - on.shape[1])))
                cells = np.floor(on / epsilon).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, AXES, dtype=np.int32)), pa.array(cells.ravel()))
                cols = [part.column("cls"), part.column("n"), part.column("v"), pa.array(np.full(len(x), length, np.int32)), lists, *map(pa.array, on.T), pa.array(rest)]
                yield pa.RecordBatch.from_arrays(cols, names=["cls", "n", "v", "length", "cells", *_PLACES])

    return common.map_batches(classes.select("cls", "n", "v"), run, f"cls long, n long, v {kind}, length int, cells array<int>, " + ", ".join(f"{p} double" for p in _PLACES))


_PLACES = [f"p{i}" for i in range(AXES + 1)]


def interval_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(length, a, b), a <= b: pairs of blocks not provably farther apart than epsilon.

    blocks: (length, node, lo0, hi0, ...), numbered in grid order.
    """
    bounds = [f"{e}{i}" for i in range(AXES + 1) for e in ("lo", "hi")]
    levels = [common.cut(blocks)]
    last = levels[0].agg(F.max("node")).first()[0] or 0
    while last:
        last //= FAN
        wider = [(F.min if c[:2] == "lo" else F.max)(c).alias(c) for c in bounds]
        levels.append(common.cut(levels[-1].groupBy("length", F.expr(f"node div {FAN}").cast("int").alias("node")).agg(*wider)))
    pairs = levels[-1].select("length", F.col("node").alias("a"), F.col("node").alias("b"))
    gap = lambda i: F.greatest(F.lit(0.0), F.col(f"xlo{i}") - F.col(f"yhi{i}"), F.col(f"ylo{i}") - F.col(f"xhi{i}"))
    far = sum((gap(i) * gap(i) for i in range(1, AXES + 1)), gap(0) * gap(0))
    for nodes in levels[-2::-1]:
        x = nodes.select("length", F.expr(f"node div {FAN}").cast("int").alias("a"), F.col("node").alias("x"), *[F.col(c).alias(f"x{c}") for c in bounds])
        y = nodes.select("length", F.expr(f"node div {FAN}").cast("int").alias("b"), F.col("node").alias("y"), *[F.col(c).alias(f"y{c}") for c in bounds])
        both = pairs.join(x, ["length", "a"]).join(y, ["length", "b"]).where("x <= y").where(far <= epsilon * epsilon + CLOSE)
        pairs = common.cut(both.select("length", F.col("x").alias("a"), F.col("y").alias("b")))
    return pairs


class Unit:
    """The left blocks of a unit, and what the right blocks that stream by have linked them to."""

    def __init__(self, least: float) -> None:
        self.least, self.at = least, {}
        self.raw, self.cls, self.n = [], [], []

    def add(self, block: int, raw: np.ndarray, cls: np.ndarray, n: np.ndarray) -> None:
        first = sum(map(len, self.raw))
        self.at[block] = slice(first, first + len(raw))
        for held, new in ((self.raw, raw), (self.cls, cls), (self.n, n)):
            held.append(new)

    def close(self) -> None:
        self.raw, self.cls, self.n = map(np.concatenate, (self.raw, self.cls, self.n))
        self.x = units(self.raw)
        self.links = np.zeros(len(self.x))
        self.label = np.arange(len(self.x))

    def meet(self, block: int, partners: list[int], raw: np.ndarray, cls: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a right block: how many vectors each of its classes links to, and the left class that stands for its group, or -1."""
        x, links, one, two = units(raw), np.zeros(len(raw)), [], []
        for p in partners:
            own = self.at[p]
            product = self.x[own] @ x.T
            i, j = np.nonzero(product >= self.least - CLOSE)
            close = np.flatnonzero(product[i, j] < self.least + CLOSE)
            if len(close):
                ok = np.ones(len(i), bool)
                ok[close] = [cosine(self.raw[own.start + i[k]], raw[j[k]]) >= self.least for k in close]
                i, j = i[ok], j[ok]
            i = i + own.start
            other = self.cls[i] != cls[j]
            i, j = i[other], j[other]
            self.links += np.bincount(i, n[j], len(self.x))
            if p != block:
                links += np.bincount(j, self.n[i], len(x))
            one.append(i)
            two.append(j)
        i, j = np.concatenate(one), np.concatenate(two)
        group = np.full(len(x), -1)
        if len(i):
            self._join(i, j, len(x))
            group[j] = self.label[i]
        return links, np.where(group >= 0, self.cls[group], -1)

    def _join(self, i: np.ndarray, j: np.ndarray, many: int) -> None:
        """Left classes that meet in a right class get one label."""
        while True:
            least = np.full(many, len(self.label))
            np.minimum.at(least, j, self.label[i])
            to = np.arange(len(self.label))
            np.minimum.at(to, self.label[i], least[j])
            if (to == np.arange(len(to))).all():
                return
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]


def _meet(least: float):
    names = ["cls", "other", "n"]
    types = [pa.int64()] * 3

    def out(cls: np.ndarray, n: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = (n > 0) | ((group >= 0) & (group != cls))
        cols = [cls[some], group[some], n[some].astype(np.int64)]
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Rows come sorted by unit, side and block; those of one block together."""
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("length", "ua", "ub", "side", "block")], 1)
            edge = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                own = tuple(key[a].tolist())
                if held and own != last:
                    yield last, pa.Table.from_batches(held)
                    held = []
                last = own
                held.append(batch.slice(a, b - a))
        if held:
            yield last, pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, of = None, None
        for (length, ua, ub, side, block), rows in blocks(batches):
            if (length, ua, ub) != of:
                if unit:
                    yield from out(unit.cls, unit.links, unit.cls[unit.label])
                unit, of, open_ = Unit(least), (length, ua, ub), True
            raw, cls, n = scaled(rows["v"].combine_chunks(), length), rows["cls"].to_numpy(), rows["n"].to_numpy()
            if not side:
                unit.add(block, raw, cls, n)
                continue
            if open_:
                unit.close()
                open_ = False
            partners = rows["partners"][0].as_py()
            yield from out(cls, *unit.meet(block, partners, raw, cls, n))
        if unit:
            yield from out(unit.cls, unit.links, unit.cls[unit.label])

    return run


def linked(classes: DataFrame, least: float) -> DataFrame:
    """(cls, other, n): parts of the number of vectors that a class links to, and a class of its group or -1."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * least)) + CLOSE
    many = classes.count()
    turn = axes(classes)
    order = placed(classes, turn, epsilon).repartitionByRange(max(1, -(-many // BLOCK)), "length", "cells", "cls").sortWithinPartitions("length", "cells", "cls")
    order = common.cut(order.drop("cells").withColumn("block", F.spark_partition_id()))
    boxes = order.groupBy("length", F.col("block").alias("node")).agg(*[f(p).alias(f"{e}{p[1:]}") for p in _PLACES for e, f in (("lo", F.min), ("hi", F.max))])
    pairs = interval_pairs(boxes, epsilon)
    pairs = pairs.withColumns({"ua": F.expr(f"a div {LEFT}"), "ub": F.expr(f"b div {RIGHT}")})
    left = pairs.select("length", "ua", "ub", F.lit(0).alias("side"), F.col("a").alias("block")).distinct().withColumn("partners", F.lit(None).cast("array<int>"))
    right = pairs.groupBy("length", "ua", "ub", F.lit(1).alias("side"), F.col("b").alias("block")).agg(F.collect_list("a").alias("partners"))
    rows = order.select("length", "block", "cls", "n", "v").join(left.unionByName(right), ["length", "block"])
    unit = ["length", "ua", "ub"]
    dealt = rows.repartition(*unit).sortWithinPartitions(*unit, "side", "block", "cls")
    return common.map_batches(dealt, _meet(least), "cls long, other long, n long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """The rows without the vector, with ``n_links`` (other vectors of cosine ``least`` or more), ``component_id`` (the smallest id reachable) and ``kept``."""
    if not 0 < least <= 1:
        raise ValueError("the least cosine lies above 0 and is at most 1")
    kept = [c for c in vectors.columns if c not in (vector, *OUTPUTS)]
    rows = vectors.select(*kept, F.col(vector).alias("__v")).withColumn("__ok", _usable(F.col("__v")))
    # two hashes of 64 bits tell vectors apart
    rows = rows.withColumn("__h", F.when(F.col("__ok"), F.struct(F.xxhash64("__v").alias("a"), F.xxhash64(F.lit(1), "__v").alias("b"))))
    same = rows.where("__ok").groupBy(F.col("__h").alias("h")).agg(F.first("__v").alias("v"), F.count("*").alias("n"), F.min(key).alias("first"))
    classes = common.cut(same.withColumn("cls", F.monotonically_increasing_id()))
    found = common.cut(linked(classes, least))
    n_links = found.groupBy("cls").agg(F.sum("n").alias("more"))
    roots = components(found.where("other >= 0").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    named = classes.select("h", "cls", "n", "first").join(n_links, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.withColumn("root", F.coalesce("root", "cls"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select(F.col("h").alias("__h"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("__in"))
    out = rows.select(*kept, "__h").join(named, "__h", "left")
    own = F.when(F.col("__in"), F.col("component_id")).otherwise(F.col(key))
    return out.select(*kept, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE_SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
many AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(many.n, 0) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN many ON many.a = e.vec_id
"""
