"""Sharding by histogram sort, with DataFrame functions only.

Rows have a total order by (group hash, row hash), so rows of one group
(equal texts) lie side by side. Exact byte counts below candidate boundaries
are taken across all partitions, first for 65,536 leading-bit cells, then
by eight more key bits around each splitter that is not yet within tolerance.
When all splitters are fixed, the rows are exchanged once, by cell.

A group with more than 1/1024 of all rows is hot. It gets cells of its own that
divide it by row hash, so no task ever gets a whole hot group. A splitter moves
to the edge of a group if that costs at most ``group_tolerance`` of a shard;
otherwise the group is divided at that splitter, as it is too large to keep.

Defined results: null and empty groups hash alike; an empty table gives an
empty result; rows that agree in group and tie columns stay side by side;
columns named like the outputs are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOP_BITS = 16
STEP_BITS = 8
HOT_SHARE = 1024


def _at_least(bound: tuple) -> Column:
    """Whether a row's key (cell, hot index, hash 1, hash 2) is at or above a bound."""
    cols = [F.col(c) for c in ("__d1", "__hot", "__h1", "__h2")]
    out = cols[-1] >= F.lit(bound[-1])
    for c, v in reversed(list(zip(cols[:-1], bound[:-1]))):
        out = (c > F.lit(v)) | ((c == F.lit(v)) & out)
    return out


def _keyed(df: DataFrame, group: Column, tie: list[Column]) -> DataFrame:
    return df.withColumns({"__h1": F.xxhash64(F.coalesce(group, F.lit(""))), "__h2": F.xxhash64(*tie)})


def _in_cells(df: DataFrame, hot: list[tuple[int, int]]) -> DataFrame:
    """Adds the cell of each row: leading bits, hot index (-1: none), leading bits within a hot group."""
    df = df.withColumn("__d1", F.shiftright("__h1", 64 - TOP_BITS).cast("int"))
    if not hot:
        return df.withColumns({"__hot": F.lit(-1), "__d2": F.lit(0).cast("long")})
    keys = F.array(*[F.lit(h).cast("long") for h, _ in hot])
    bits = F.array(*[F.lit(64 - b) for _, b in hot])
    df = df.withColumn("__hot", F.array_position(keys, F.col("__h1")).cast("int") - 1)
    df = df.withColumn("__shift", F.when(F.col("__hot") >= 0, F.try_element_at(bits, F.col("__hot") + 1)).otherwise(0))
    return df.withColumn("__d2", F.when(F.col("__hot") >= 0, F.expr("shiftright(__h2, __shift)")).otherwise(0)).drop("__shift")


class _Probe:
    """A range of keys with one splitter in it: all rows whose leading ``bits`` of the 128-bit key are ``prefix``."""

    def __init__(self, hot: int, d1: int, bits: int, h1: int, h2: int, end: tuple, before: int, rows_before: int):
        self.hot, self.d1, self.bits, self.h1, self.h2 = hot, d1, bits, h1, h2
        self.end, self.before, self.rows_before = end, before, rows_before

    def holds(self) -> Column:
        out = (F.col("__d1") == self.d1) & (F.col("__hot") == self.hot)
        if self.bits <= 64:
            return out & (F.shiftright("__h1", 64 - self.bits) == F.lit(self.h1 >> (64 - self.bits)))
        out = out & (F.col("__h1") == F.lit(self.h1))
        return out & (F.shiftright("__h2", 128 - self.bits) == F.lit(self.h2 >> (128 - self.bits))) if self.bits < 128 else out

    def step(self) -> int:
        """How many more bits to look at: never across the border between both hashes."""
        return min(STEP_BITS, (64 if self.bits < 64 else 128) - self.bits)

    def digit(self) -> Column:
        n = self.step()
        name, shift = ("__h1", 64 - self.bits - n) if self.bits < 64 else ("__h2", 128 - self.bits - n)
        return F.shiftright(name, shift).bitwiseAND((1 << n) - 1)

    def child(self, digit: int) -> tuple[int, int]:
        n = self.step()
        if self.bits < 64:
            return (self.h1 >> (64 - self.bits) << n | digit) << (64 - self.bits - n), self.h2
        if self.bits == 64:  # the first bits of a signed hash carry its sign
            signed = digit - (1 << n) if digit >> (n - 1) else digit
            return self.h1, signed << (64 - n)
        return self.h1, (self.h2 >> (128 - self.bits) << n | digit) << (128 - self.bits - n)

    def order(self, digits: list[int]) -> list[int]:
        n = self.step()
        return sorted(digits, key=lambda d: d - (1 << n) if self.bits == 64 and d >> (n - 1) else d)


LOW = -(1 << 63)


def splitters(light: DataFrame, hot: list[tuple[int, int]], n_shards: int, tolerance: float, group_tolerance: float) -> list[tuple[tuple, int]]:
    """For each splitter its bound and the exact number of rows below it. ``light``: keys, cells and sizes."""
    cells = light.groupBy("__d1", "__hot", "__d2").agg(F.sum("__size").alias("b"), F.count("*").alias("n")).collect()
    cells.sort(key=lambda r: (r["__d1"], r["__hot"], r["__d2"]))
    total = sum(r["b"] for r in cells)
    allowed, group_allowed = tolerance * total / n_shards, group_tolerance * total / n_shards

    def start(r) -> tuple:
        if r["__hot"] < 0:
            return (r["__d1"], -1, r["__d1"] << (64 - TOP_BITS), LOW)
        h, b = hot[r["__hot"]]
        return (r["__d1"], r["__hot"], h, r["__d2"] << (64 - b))

    found: dict[int, tuple[tuple, int]] = {}
    open_: dict[int, _Probe] = {}
    starts = [start(r) for r in cells] + [(1 << 30, 0, 0, 0)]
    at, below, rows_below = 0, 0, 0
    for k in range(1, n_shards):
        want = k * total / n_shards
        while at < len(cells) - 1 and below + cells[at]["b"] <= want:
            below, rows_below, at = below + cells[at]["b"], rows_below + cells[at]["n"], at + 1
        r = cells[at]
        edges = [(abs(below - want), starts[at], rows_below), (abs(below + r["b"] - want), starts[at + 1], rows_below + r["n"])]
        near = min(edges, key=lambda e: e[0])
        if near[0] <= allowed or r["n"] == 1:
            found[k] = near[1:]
        elif r["__hot"] < 0:
            open_[k] = _Probe(-1, r["__d1"], TOP_BITS, starts[at][2], LOW, starts[at + 1], below, rows_below)
        else:
            open_[k] = _Probe(r["__hot"], r["__d1"], 64 + hot[r["__hot"]][1], starts[at][2], starts[at][3], starts[at + 1], below, rows_below)
    while open_:
        probes = list({(p.d1, p.hot, p.bits, p.h1, p.h2): p for p in open_.values()}.values())
        which = F.coalesce(*[F.when(p.holds(), F.lit(i)) for i, p in enumerate(probes)])
        digit = reduce(lambda out, ip: F.when(F.col("__p") == ip[0], ip[1].digit()).otherwise(out), enumerate(probes), F.lit(0).cast("long"))
        counted = light.withColumn("__p", which).where("__p is not null").withColumn("__g", digit)
        bins: dict[tuple, dict[int, tuple[int, int]]] = {}
        for r in counted.groupBy("__p", "__g").agg(F.sum("__size").alias("b"), F.count("*").alias("n")).collect():
            p = probes[r["__p"]]
            bins.setdefault((p.d1, p.hot, p.bits, p.h1, p.h2), {})[r["__g"]] = (r["b"], r["n"])
        for k, p in list(open_.items()):
            own = bins[(p.d1, p.hot, p.bits, p.h1, p.h2)]
            want, below, rows_below, order = k * total / n_shards, p.before, p.rows_before, p.order(list(own))
            bounds = [(p.d1, p.hot, *p.child(d)) for d in order] + [p.end]
            i = 0
            while i < len(order) - 1 and below + own[order[i]][0] <= want:
                below, rows_below, i = below + own[order[i]][0], rows_below + own[order[i]][1], i + 1
            b, n = own[order[i]]
            bits = p.bits + p.step()
            edges = [(abs(below - want), bounds[i], rows_below), (abs(below + b - want), bounds[i + 1], rows_below + n)]
            near = min(edges, key=lambda e: e[0])
            if near[0] <= (group_allowed if bits >= 64 and p.hot < 0 and bits == 64 else allowed) or n == 1 or bits == 128:
                found[k] = near[1:]
                del open_[k]
            else:
                open_[k] = _Probe(p.hot, p.d1, bits, *p.child(order[i]), bounds[i + 1], below, rows_below)
    return [found[k] for k in sorted(found)]


def histogram_shards(df: DataFrame, size: str, group: str, tie: list[str], n_shards: int = 16, tolerance: float = 0.001, group_tolerance: float = 0.01) -> DataFrame:
    """Adds ``shard`` (0 to n_shards - 1, byte sums near equal) and ``slot`` (gapless from 0 in each shard).

    size: long column of positive weights; group: string column whose equal
    values stay together; tie: columns that order rows within a group.
    tolerance, group_tolerance: how far a splitter may lie from its exact
    place, as shares of a shard's bytes.
    """
    keyed = _keyed(df, F.col(group), [F.col(c) for c in tie])
    light = common.cut(keyed.select("__h1", "__h2", F.col(size).cast("long").alias("__size")))
    n = light.count()
    most = max(1, n // HOT_SHARE)
    # a hot group makes its cell heavy, and fewer than HOT_SHARE cells are: only their rows are grouped
    cell = F.shiftright("__h1", 64 - TOP_BITS).cast("int")
    heavy = [r["c"] for r in light.groupBy(cell.alias("c")).agg(F.count("*").alias("n")).where(F.col("n") > most).collect()]
    counted = light.where(cell.isin(heavy)).groupBy("__h1").agg(F.count("*").alias("n")).where(F.col("n") > most).collect() if heavy else []
    hot = [(r["__h1"], min(TOP_BITS, max(1, (r["n"] // most).bit_length() + 1))) for r in counted]
    hot.sort()
    light = _in_cells(light, hot)
    cut_at = splitters(light, hot, n_shards, tolerance, group_tolerance) if n else []
    shard = reduce(lambda a, b: a + b, [_at_least(bound).cast("int") for bound, _ in cut_at], F.lit(0))
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in [0, *[rows for _, rows in cut_at]]]), F.col("shard") + 1)
    cell = ["__d1", "__hot", "__d2"]
    # at most 65,536 leading-bit cells and about 3 * 1,024 cells of hot groups
    offsets = light.groupBy(*cell).agg(F.count("*").alias("__n"))
    offsets = offsets.select(*cell, (F.sum("__n").over(Window.orderBy(*cell)) - F.col("__n")).alias("__offset"))
    rows = _in_cells(keyed, hot).withColumn("__rank", F.row_number().over(Window.partitionBy(*cell).orderBy("__h1", "__h2")))
    rows = rows.join(F.broadcast(offsets), cell).withColumn("shard", shard)
    rows = rows.withColumn("slot", F.col("__offset") + F.col("__rank") - 1 - first)
    return rows.drop("__h1", "__h2", "__rank", "__offset", *cell)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    raw = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumns({"size": F.octet_length(raw).cast("long") + 1, "text_crc32": F.crc32(raw.cast("binary"))})
    out = histogram_shards(docs, "size", "text", ["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
