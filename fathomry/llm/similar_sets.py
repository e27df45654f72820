"""Near duplicates by the general rule: five-word shingles, Jaccard similarity 0.8 or more.

SimHash fingerprints that meet at op7's anchors name the first candidates; sets are always
compared whole, and an exact set similarity join by prefixes adds what 3 of 64 bits miss:

1. a text becomes the set of its shingles' 64-bit hashes; texts with equal sets are one node.
   A set's fingerprint is the SimHash of its hashes. Fingerprints that
   ``op7_anchor_simhash.links`` connects, and sets of equal fingerprints, are candidates;
2. shingles get one order for all, common ones last. Two sets of similarity 0.8 share
   SHARED shingles among the first fifth (and SHARED more) of each, so these travel,
   with their place, to the shingle's bucket;
3. each bucket has LEADERS, and each set is compared with the leader that it meets in
   most buckets, so that a group of copies is connected without its pairs, and with
   the sets that fingerprints name;
4. sets that these comparisons find half alike are connected to a family. A set of a
   family is told by its differences from what most of the family has. Two sets are
   alike to 0.8 if their differences, less those that they share, are a ninth of their
   sizes. So the one with the fewest differences links all that are near it without
   sharing any; the others of a family link only where they share differences, and are
   looked for by these, again by prefixes, without a pair leaving its task;
5. of the sets of different families that are not connected by then, pairs stay
   candidates if they meet in SHARED buckets (or in as many as sets of their size must
   share), and if their sizes and what is left after the places of one shingle can
   still reach 0.8. Of two alike sets the first SHARED common shingles lie at places
   after which, with those before, enough is left; only such meetings count;
6. the whole sets of these candidates are compared.

Which shingles are common is counted on a sample; that moves work, not results, as
any order that all texts share is right. So do families: who is in none, or differs by
more than WIDE, is compared by steps 5 and 6. A bucket (of a shingle, or of a family's
difference) is compared in one task, in quadratic time for sets of like size.

Defined results: words are split and ASCII letters folded as in ``op7_anchor_simhash``;
texts of fewer than five words have one shingle, all their words; null and empty texts
equal one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, op7_anchor_simhash
from .components import components
from .op5_phrase_automata import _groups, _mixed, word_hashes

WIDTH = 5
#: Least similarity, as a fraction.
NUM, DEN = 4, 5
#: Shingles that two sets must share among the first ones of each, if they need to share so many at all.
SHARED = 6
#: Sets of a bucket that all others are first held against.
LEADERS = 2
#: Bits of a shingle's hash that name its bucket; more candidates if two shingles meet, not fewer.
BUCKET = np.uint64(0xFFFFFFFFFFFF0000)
#: Documents, and least share of them, whose shingles are counted to tell common ones.
SAMPLE, SHARE = 20_000, 0.01
#: A shingle of so many sampled sets is common; at most COMMON shingles are.
OFTEN, COMMON = 3, 200_000
#: Candidates that a task holds before it passes them on.
PAIRS = 1 << 17
#: Sets that a task remembers, to pass copies on once.
SEEN = 1 << 18
#: Digits of a node's number that are marked: the bits are sent to the tasks, 8 MB.
MARKS = 26
#: Most differences of a set in a family.
WIDE = 256
#: Sets are half alike if so many times their differences are at most their sizes together.
LOOSE = 3
#: Alike to NUM / DEN.
ALIKE = f"{NUM + DEN} * size(diff) <= {DEN - NUM} * (size_a + size_b)"
_PLACE = np.random.default_rng(20_261_128).integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)
_SALT = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes], common_ones: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, each text's in the common order, and the bounds of each text's part."""
    words, n_words = word_hashes([t.lower() for t in texts])
    of = np.repeat(np.arange(len(texts)), n_words)
    m = max(len(words) - WIDTH + 1, 0)
    run = np.zeros(m, np.uint64)
    for j in range(WIDTH):
        run += words[j : j + m] * _PLACE[j]
    inside = np.flatnonzero(of[:m] == of[WIDTH - 1 :][:m])
    short = np.flatnonzero(n_words < WIDTH)
    first = np.cumsum(n_words) - n_words
    alone = np.array([(words[first[i] : first[i] + n_words[i]] * _PLACE[: n_words[i]]).sum(dtype=np.uint64) + np.uint64(n_words[i]) for i in short], np.uint64)
    token = _mixed(np.concatenate([run[inside], alone]))
    of = np.concatenate([of[:m][inside], short])
    if common_ones is None or not len(common_ones[0]):
        at = np.lexsort((token, of))
    else:
        known, often = common_ones
        where = np.minimum(np.searchsorted(known, token), len(known) - 1)
        at = np.lexsort((token, np.where(known[where] == token, often[where], 0), of))
    token, of = token[at], of[at]
    new = np.r_[True, (token[1:] != token[:-1]) | (of[1:] != of[:-1])] if len(token) else np.zeros(0, bool)
    token, of = token[new], of[new]
    return token, np.searchsorted(of, np.arange(len(texts) + 1))


def names(token: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A number for each set, whatever the order of its members."""
    return _mixed(np.add.reduceat(_mixed(token ^ _SALT), edge[:-1])).view(np.int64) if len(edge) > 1 else np.zeros(0, np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("__text").to_pylist()]


def _named(docs: DataFrame, text: str) -> DataFrame:
    """The rows with ``node`` in place of the text."""
    kept = [c for c in docs.columns if c not in (text, "node")]
    schema = docs.select(*kept).schema.add("node", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            made = [names(*shingles(texts)) for _, texts in _groups(_texts(batch))]
            node = np.concatenate(made) if made else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(node, pa.int64())], names=[*kept, "node"])

    return common.map_batches(docs.select(*kept, F.col(text).alias("__text")), run, schema)


def _each_set(batches: Iterator[pa.RecordBatch], common_ones=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, bounds, nodes, which sets were not met before in this task)."""
    seen: set[int] = set()
    for batch in common.slices(batches):
        for _, texts in _groups(_texts(batch)):
            token, edge = shingles(texts, common_ones)
            node = names(token, edge)
            fresh = np.zeros(len(node), bool)
            for i, x in enumerate(node.tolist()):
                if x not in seen:
                    fresh[i] = True
                    seen.add(x)
            if len(seen) > SEEN:
                seen.clear()
            yield token, edge, node, fresh


def prints(texts: DataFrame) -> DataFrame:
    """(node, fp): the fingerprint of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, edge, node, fresh in _each_set(batches):
            new = np.flatnonzero(fresh)
            fp = np.array([op7_anchor_simhash.simhash(token[edge[i] : edge[i + 1]]) for i in new], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(node[new]), pa.array(fp.view(np.int64))], names=["node", "fp"])

    return common.map_batches(texts, run, "node long, fp long").dropDuplicates(["node"])


def anchored(texts: DataFrame) -> DataFrame:
    """(a, b): candidates that connect all sets whose fingerprints lie within op7's few bits of one another."""
    each = common.cut(prints(texts))
    first = each.groupBy("fp").agg(F.min("node").alias("first"))
    same = each.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = op7_anchor_simhash.links(first.select("fp")).distinct().toDF("fp", "other")
    named = near.join(first.withColumnRenamed("first", "a"), "fp").drop("fp").withColumnRenamed("other", "fp").join(first.withColumnRenamed("first", "b"), "fp")
    return same.unionByName(named.select("a", "b"))


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sampled sets have, sorted, and in how many."""
    total = texts.count()
    share = max(SAMPLE / max(total, 1), SHARE)
    part = texts.sample(share, 20_261_128) if share < 1 else texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, edge, _, fresh in _each_set(batches):
            yield pa.RecordBatch.from_arrays([pa.array(token[np.repeat(fresh, np.diff(edge))].view(np.int64))], names=["token"])

    counted = common.map_batches(part, run, "token long").groupBy("token").count().where(F.col("count") >= OFTEN)
    top = counted.orderBy(F.desc("count"), "token").limit(COMMON).toArrow()
    token = top["token"].to_numpy().astype(np.int64).view(np.uint64)
    at = np.argsort(token)
    return token[at], top["count"].to_numpy().astype(np.int64)[at]


def prefixes(texts: DataFrame) -> DataFrame:
    """(token, size, place, node): the first shingles of every set."""
    common_ones = texts.sparkSession.sparkContext.broadcast(common_shingles(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, edge, node, fresh in _each_set(batches, common_ones.value):
            size = np.diff(edge)
            place = np.arange(len(token)) - np.repeat(edge[:-1], size)
            first = np.where(fresh, np.minimum(size, size - (NUM * size + DEN - 1) // DEN + SHARED), 0)
            take = place < np.repeat(first, size)
            cols = [(token & BUCKET).view(np.int64), np.repeat(size, size).astype(np.int32), place.astype(np.int32), np.repeat(node, size)]
            yield pa.RecordBatch.from_arrays([pa.array(c[take]) for c in cols], names=["token", "size", "place", "node"])

    return common.map_batches(texts, run, "token long, size int, place int, node long")


def pairs_in(token: np.ndarray, size: np.ndarray, place: np.ndarray, node: np.ndarray, root: np.ndarray, family: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, how many they must share, whether one place lets them reach 0.8) for pairs of different roots and families in the buckets of rows sorted by token and size."""
    size, left = size.astype(np.int64), size.astype(np.int64) - place
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    at, d = np.arange(len(token)), 0
    while True:
        d += 1
        at = at[at + d < len(token)]
        # sizes grow within a bucket: who is too small for one is too small for the next
        at = at[(token[at] == token[at + d]) & (DEN * size[at] >= NUM * size[at + d])]
        if not len(at):
            break
        good = at[(root[at] != root[at + d]) & (family[at] != family[at + d])]
        # what is left after the place must reach 0.8; for one of the first SHARED places, up to SHARED - 1 were shared before it
        short = NUM * (size[good] + size[good + d]) - (NUM + DEN) * np.minimum(left[good], left[good + d])
        good, short = good[(fits := short <= (NUM + DEN) * (SHARED - 1))], short[fits]
        enough = short <= 0
        x, y = node[good], node[good + d]
        held.append((np.minimum(x, y), np.maximum(x, y), np.minimum(SHARED, (NUM * size[good + d] + DEN - 1) // DEN), enough.astype(np.int64)))
        n += len(good)
        if n >= PAIRS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by token and size; the last token of a batch waits for the next batch."""
    held: list[tuple] = []

    def out() -> Iterator[pa.RecordBatch]:
        for a, b, need, enough in pairs_in(*[np.concatenate(x) for x in zip(*held, strict=True)]):
            order = np.lexsort((b, a))
            a, b, need, enough = a[order], b[order], need[order], enough[order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            met = np.diff(first, append=len(a))
            cols = [a[first], b[first], met, need[first], np.maximum.reduceat(enough, first)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "met", "need", "enough"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "size", "place", "node", "root", "family"))
        other = np.flatnonzero(cols[0] != cols[0][-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut or (held and held[-1][0][-1] != cols[0][0]):
            held.append(tuple(c[:cut] for c in cols))
            yield from out()
            held = []
        held.append(tuple(c[cut:] for c in cols))
    if held:
        yield from out()


def _marks(nodes: DataFrame) -> np.ndarray:
    """Bits of the nodes' last digits, to pass over most of the others."""
    digits = F.col("node").bitwiseAND((1 << MARKS) - 1)
    bit = F.expr("shiftleft(1L, cast(node & 63 as int))")
    rows = nodes.groupBy(F.shiftright(digits, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    marks = np.zeros(1 << MARKS - 6, np.int64)
    marks[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return marks


def sets_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, members) of the nodes asked for, and of a few others."""
    marks = texts.sparkSession.sparkContext.broadcast(_marks(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, edge, node, fresh in _each_set(batches):
            wanted = marks.value[(node & (1 << MARKS) - 1) >> 6] >> (node & 63) & 1
            whole = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(token.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(node), whole], names=["node", "members"]).filter(pa.array(fresh & (wanted > 0)))

    return common.map_batches(texts, run, "node long, members array<long>")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        x, y = batch.column("x"), batch.column("y")
        rows = []
        for i in range(batch.num_rows):
            one, two = (s[i].values.to_numpy(zero_copy_only=False) for s in (x, y))
            rows.append((len(one), len(two), np.setxor1d(one, two, assume_unique=True)))
        near = [i for i, (m, n, d) in enumerate(rows) if LOOSE * len(d) <= m + n]
        out = [pa.array([rows[i][k] for i in near], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.int64())))]
        ids = batch.select(["a", "b"]).take(pa.array(near, pa.int32()))
        yield pa.RecordBatch.from_arrays([*ids.columns, *out], names=["a", "b", "size_a", "size_b", "diff"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, size_a, size_b, diff) of the pairs (a, b) whose sets are alike to a half or more; diff is what only one of them has."""
    x = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return common.map_batches(both, _compare, "a long, b long, size_a int, size_b int, diff array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike to 0.8 or more."""
    return compared(pairs, sets).where(ALIKE).select("a", "b")


def families(near: DataFrame, sets: DataFrame) -> DataFrame:
    """(family, node, diff, h, best, centre, free) of the sets that pairs half alike connect.

    diff: what a set has more or less than most of its family; h: how far that is
    over the set's share of the differences that two alike sets may have, times
    NUM + DEN. Two sets are alike if the sum of their h is at most that of the
    differences that they share, each counted 2 * (NUM + DEN) times. centre has
    the least h, best; free sets are not alike to it unless they share differences.
    """
    root = components(near.select("a", "b"))
    pairs = root.select(F.col("root").alias("a"), F.col("node").alias("b"))
    pairs = pairs.union(root.select("root", "root").distinct().toDF("a", "b"))
    own = compared(pairs, sets).select(F.col("a").alias("family"), F.col("b").alias("node"), F.col("size_b").alias("size"), "diff")
    own = common.cut(own)
    many = own.groupBy("family").agg(F.count("*").alias("n"))
    often = own.select("family", F.explode("diff").alias("token")).groupBy("family", "token").agg(F.count("*").alias("has"))
    # at most twice as many as a set of the family has on average; families have two sets or more, so what one set has stays where it is
    flip = often.where("has > 1").join(many, "family").where("2 * has > n").groupBy("family").agg(F.collect_list("token").alias("flip"))
    turned = F.array_union(F.array_except("diff", "flip"), F.array_except("flip", "diff"))
    based = own.join(flip, "family", "left").withColumn("diff", F.when(F.col("flip").isNull(), F.col("diff")).otherwise(turned))
    based = based.where(F.size("diff") <= WIDE).withColumn("h", (NUM + DEN) * F.size("diff") - (DEN - NUM) * F.col("size"))
    centre = based.groupBy("family").agg(F.min(F.struct("h", "node")).alias("__c"))
    placed = based.join(centre, "family").select("family", "node", "diff", "h", F.col("__c.h").alias("best"), F.col("__c.node").alias("centre"))
    return common.cut(placed.withColumn("free", F.col("h") + F.col("best") > 0))


def forest_in(node: np.ndarray, h: np.ndarray, free: np.ndarray, shared: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join what is alike among sets of a family, if those that are not free are one group."""
    found: list[tuple[int, int]] = []
    if not free.any():
        return found
    n = len(node)
    edge = np.cumsum([0, *map(len, shared)])
    token = np.unique(np.concatenate(shared), return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    owner = np.repeat(np.arange(n), np.diff(edge))[order]
    start = np.searchsorted(token[order], np.arange(token.max() + 2))
    left = free.copy()
    for seed in np.flatnonzero(free):
        if not left[seed]:
            continue
        left[seed] = False
        todo, joined = [seed], False
        while todo:
            x = todo.pop()
            hits = np.concatenate([owner[start[t] : start[t + 1]] for t in token[edge[x] : edge[x + 1]]])
            alike = h[x] + h <= 2 * (NUM + DEN) * np.bincount(hits, minlength=n)
            near = np.flatnonzero(alike & left)
            left[near] = False
            todo.extend(near)
            found.extend((node[x], node[y]) for y in near)
            if not joined and (others := np.flatnonzero(alike & ~free)).size:
                joined = True
                found.append((node[x], node[others[0]]))
    return found


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by family and token; the last bucket of a batch waits for the next batch."""
    rows = (r for batch in batches for part in common.slices([batch]) for r in zip(*_columns(part), strict=True))
    for _, bucket in groupby(rows, key=lambda r: r[:2]):
        _, _, node, h, free, shared = zip(*bucket, strict=True)
        found = forest_in(np.array(node), np.array(h), np.array(free), list(shared))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])


def _columns(part: pa.RecordBatch) -> list:
    plain = [part.column(c).to_pylist() for c in ("family", "token", "node", "h", "free")]
    return [*plain, [x.values.to_numpy(zero_copy_only=False) for x in part.column("shared")]]


def within(placed: DataFrame) -> DataFrame:
    """(a, b): links that connect all alike sets of each family."""
    stars = placed.where(~F.col("free") & (F.col("node") != F.col("centre"))).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    apart = placed.join(placed.where("free").select("family").distinct(), "family", "left_semi")
    # a pair has a free set: how many differences must a set share with any other at least
    over = F.col("h") + F.when(F.col("free"), F.col("best")).otherwise(1 - F.col("best"))
    apart = apart.withColumn("need", F.ceil(over / (2 * (NUM + DEN))).cast("int"))
    each = apart.select("family", "node", F.explode("diff").alias("token"))
    often = each.groupBy("family", "token").agg(F.count("*").alias("has")).where("has > 1")
    shared = each.join(often, ["family", "token"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("has", "token"))).alias("__t"))
    rows = apart.select("family", "node", "h", "free", "need").join(shared, "node").where(F.size("__t") >= F.col("need"))
    first = F.expr("slice(__t.token, 1, size(__t) - need + 1)")
    rows = rows.select("family", F.explode(first).alias("token"), "node", "h", "free", F.col("__t.token").alias("shared"))
    dealt = rows.repartition("family", "token").sortWithinPartitions("family", "token")
    return stars.unionByName(common.map_batches(dealt, _within, "a long, b long").distinct())


def _led(members: DataFrame) -> DataFrame:
    """(a, b): each set b with the leader a that it meets in most buckets; one row for each set and kind of leader."""
    each = [F.struct(F.lit(i).alias("kind"), F.col(f"node{i}").alias("a"), F.col(f"size{i}").alias("other")) for i in range(LEADERS)]
    rows = members.select(F.col("node").alias("b"), "size", F.inline(F.array(*each)))
    fits = (F.col("a") != F.col("b")) & (DEN * F.least("size", "other") >= NUM * F.greatest("size", "other"))
    # who meets less often can't be alike to 0.8
    need = F.least(F.lit(SHARED), F.ceil(NUM * F.greatest("size", "other") / DEN))
    met = rows.where(fits).groupBy("b", "kind", "a").agg(F.count("*").alias("met"), F.first(need).alias("need")).where("met >= need")
    return met.groupBy("b", "kind").agg(F.max(F.struct("met", "a")).alias("best")).select(F.col("best.a").alias("a"), "b").distinct()


def _with_roots(rows: DataFrame, root: DataFrame, key: str, name: str) -> DataFrame:
    """Adds what a node is connected to: the smallest node of its group."""
    named = root.select(F.col("node").alias(key), F.col("root").alias(name))
    return rows.join(named, key, "left").withColumn(name, F.coalesce(name, key))


def links(docs: DataFrame, text: str) -> DataFrame:
    """(a, b): links that connect all nodes of similarity 0.8 or more.

    First each node is compared with those that its fingerprint names and with the
    leader that it meets most often, then within its family; pairs that are connected by then say nothing new, all other
    candidates are compared.
    """
    texts = docs.select(F.col(text).alias("__text"))
    bucket = Window.partitionBy("token")
    leaders = {f"lead{i}": F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node", "size")).over(bucket) for i in range(LEADERS)}
    each = prefixes(texts).repartition("token").dropDuplicates(["token", "node"])
    led = [F.col(f"lead{i}.{c}").alias(f"{c}{i}") for i in range(LEADERS) for c in ("node", "size")]
    members = common.cut(each.withColumns({"__n": F.count("*").over(bucket)} | leaders).where("__n > 1").select("token", "size", "place", "node", *led))
    named = anchored(texts).unionByName(_led(members)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = common.cut(named.distinct())
    sets = common.cut(sets_of(texts, first.select(F.col("a").alias("node")).union(first.select("b")).distinct()).dropDuplicates(["node"]))
    near = common.cut(compared(first, sets))
    placed = families(near, sets)
    found = common.cut(near.where(ALIKE).select("a", "b").unionByName(within(placed)))
    root = components(found)
    # what is left of a bucket if all of it is one group or family says nothing new
    known = root.join(placed.select("node", "family"), "node", "full")
    rest = members.select("token", "size", "place", "node").join(known, "node", "left")
    rest = rest.withColumns({c: F.coalesce(c, "node") for c in ("root", "family")})
    ends = {f"__{f.__name__}_{c}": f(c).over(bucket) for c in ("root", "family") for f in (F.min, F.max)}
    rest = rest.withColumns(ends).where("__min_root < __max_root and __min_family < __max_family").drop(*ends)
    met = common.map_batches(rest.sortWithinPartitions("token", "size"), _pair, "a long, b long, met long, need long, enough long")
    met = met.groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("need").alias("need"), F.max("enough").alias("enough"))
    pairs = common.cut(met.where("met >= need and enough = 1").select("a", "b").join(first, ["a", "b"], "left_anti"))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = common.cut(sets_of(texts, nodes).dropDuplicates(["node"]))
    return root.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(confirmed(pairs, sets))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows without the text, with ``component``: one number for all rows reachable by links."""
    named = _named(docs, text)
    roots = components(links(docs, text)).withColumnRenamed("root", "component")
    return named.drop("component").join(roots, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")
