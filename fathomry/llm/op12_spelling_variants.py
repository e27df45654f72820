"""Spelling variants: words one edit apart, by two-dimensional range reporting on wavelet trees.

y is near x if y is x with one code point inserted, deleted or replaced. With
the edit at place i of y, y begins with x's first i code points, an interval of
the words in forward order, and ends with the rest of x, an interval of the
words in reverse order. Both at once are a rectangle over (forward rank, reverse
rank), and a wavelet tree over the permutation from one rank to the other
reports the points in it.

Nothing holds all words in one place:

1. the words of one length m in which the edit lies between lo and hi share
   their first lo and last m - hi code points with x. That is their bucket. A
   word goes to two buckets as a target (edit in its first or second half) and
   to two more as a shorter word into which one code point is inserted;
2. a bucket of more than HOT words is dealt again, by halves of its places, until
   it has fewer or one place, at which only single code points differ;
3. a task takes buckets of one (m, lo, hi) together, up to GROUP words: sorts
   them in both orders, builds the tree, and asks it for every word and place.
   Intervals of all places come from the common prefixes of neighbours in order.
   A place counts for an inserted code point only if the one before it differs,
   so each pair is met once. Pairs stay in the task, what leaves it is each
   word's number of near words and the best of them;
4. chains of forms are followed by doubling; forms grow at least ratio-fold, so a
   few rounds do.

Defined results: null words take no part, repeated words count together, and an
empty table gives an empty result. The empty word is near all of one code point.
A word of any length is taken whole; its place costs time in proportion to its
length and the words it shares a bucket with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows of a bucket that are not dealt again, and rows that a task works on together unless one bucket has more.
HOT, GROUP = 20_000, 200_000
#: Points that are reported together, about.
POINTS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RATIO = 10


class WaveletTree:
    """A permutation of 0 to n - 1 by its bits from the top: at each level zeros move before ones."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = max(int(len(values) - 1).bit_length(), 1)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)].astype(np.int32))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value): every value in [low, high) at a place in [left, right)."""
        of, value = np.arange(len(left)), np.zeros(len(left), np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            a, b = self.ones[k][left], self.ones[k][right]
            parts = []
            for bit, x, y in ((0, left - a, right - b), (1, self.zeros[k] + a, self.zeros[k] + b)):
                first = value | bit << level
                go = (x < y) & (first < high[of]) & (first + (1 << level) > low[of])
                parts.append((of[go], first[go], x[go], y[go]))
            of, value, left, right = (np.concatenate(c) for c in zip(*parts, strict=True))
        return of, value


def _chars(words: list[str], width: int) -> np.ndarray:
    """Code points of the words, a row each, with zeros behind."""
    return np.array(words, f"<U{max(width, 1)}").view(np.uint32).reshape(len(words), max(width, 1))


class _Order:
    """Words in the order of their code points, and each word's interval of targets for every length of prefix."""

    def __init__(self, chars: np.ndarray, target: np.ndarray) -> None:
        order = np.argsort(chars.view(f"<U{chars.shape[1]}").ravel(), kind="stable")
        differs = chars[order[1:]] != chars[order[:-1]]
        self.shared = np.where(differs.any(1), differs.argmax(1), chars.shape[1])
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.before = np.r_[0, np.cumsum(target[order])]
        self.ranks = self.before[self.place]

    def intervals(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For every word the targets, by rank, that have its first n code points."""
        new = np.r_[True, self.shared < n]
        of = (np.cumsum(new) - 1)[self.place]
        starts = np.flatnonzero(new)
        stops = np.r_[starts[1:], len(self.place)]
        return self.before[starts[of]], self.before[stops[of]]


def near_in(words: list[str], counts: np.ndarray, m: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, near words, best of them) by number, for words of m or m - 1 code points and edits at places lo to hi - 1 of those of m."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    target = size == m
    n_targets = int(target.sum())
    near = np.zeros(len(words), np.int64)
    # the largest count first, then the smallest word
    chars = _chars(words, m)
    by_rank = np.lexsort((np.argsort(np.argsort(np.array(words, f"<U{max(m, 1)}"), kind="stable")), -counts))
    rank = np.empty(len(words), np.int64)
    rank[by_rank] = np.arange(len(words))
    best = np.full(len(words), len(words))
    none = np.zeros(0, np.int64)
    if not n_targets or len(words) < 2:
        return none, none, none
    backward = np.zeros_like(chars)
    for n, own in ((m, target), (m - 1, ~target)):
        if n > 0:
            backward[own, :n] = chars[own, :n][:, ::-1]
    forward, reverse = _Order(chars, target), _Order(backward, target)
    targets = np.flatnonzero(target)
    through = np.empty(n_targets, np.int64)
    through[forward.ranks[targets]] = reverse.ranks[targets]
    at_reverse = np.empty(n_targets, np.int64)
    at_reverse[reverse.ranks[targets]] = targets
    tree = WaveletTree(through)
    # a word of m code points is in its own rectangles
    least = target.astype(np.int64)
    for i in range(lo, hi):
        left, right = forward.intervals(i)
        low, high = reverse.intervals(m - 1 - i)
        most = np.minimum(right - left, high - low)
        asked = np.flatnonzero(most > least)
        for part in np.split(asked, np.flatnonzero(np.diff(np.cumsum(most[asked]) // POINTS)) + 1):
            if not len(part):
                continue
            of, value = tree.report(left[part], right[part], low[part], high[part])
            x, y = part[of], at_reverse[value]
            good = x != y
            if i:
                good &= target[x] | (chars[y, i] != chars[x, i - 1])
            x, y = x[good], y[good]
            longer = ~target[x]
            # a target also asks for itself; a shorter word's partner does not
            a, b = np.r_[x, y[longer]], np.r_[y, x[longer]]
            near += np.bincount(a, minlength=len(words))
            np.minimum.at(best, a, rank[b])
    found = np.flatnonzero(near)
    return found, near[found], by_rank[best[found]]


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (m, lo, hi) and bucket."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        words, counts = table["word"].to_pylist(), table["n"].to_numpy()
        m, lo, hi = (table[c][0].as_py() for c in ("m", "lo", "hi"))
        of, near, best = near_in(words, counts, m, lo, hi)
        cols = [pa.array([words[i] for i in of], pa.string()), pa.array(near), pa.array(-counts[best]), pa.array([words[i] for i in best], pa.string())]
        for i in range(0, len(of), 10_000):
            yield pa.RecordBatch.from_arrays([c.slice(i, 10_000) for c in cols], names=["word", "near", "less", "best"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(c).to_numpy() for c in ("m", "lo", "hi", "bucket")], 1)
        start, rows = 0, sum(p.num_rows for p in held)
        for e in [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist()]:
            own = tuple(group[e].tolist())
            if last is not None and own != last and (own[:3] != last[:3] or rows + e - start >= GROUP):
                held.append(batch.slice(start, e - start))
                yield from out()
                held.clear()
                start, rows = e, 0
            last = own
        held.append(batch.slice(start))
    if held:
        yield from out()


def _bucket() -> Column:
    """Of a row (word, m, lo, hi): what the word shares with its near words outside of [lo, hi)."""
    rest = F.expr("substring(word, hi + 1 - int(length(word) < m))")
    return F.xxhash64("m", "lo", "hi", F.expr("substring(word, 1, lo)"), rest)


def _dealt(words: DataFrame) -> DataFrame:
    """(word, n, m, lo, hi, bucket): each word as target of an edit in either half, and as a shorter word of such targets."""
    sized = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m")).where("m > 0")
    halves = F.array(F.struct(F.lit(0).alias("lo"), F.expr("m div 2").cast("int").alias("hi")), F.struct(F.expr("m div 2").cast("int").alias("lo"), F.col("m").alias("hi")))
    return sized.select("word", "n", "m", F.inline(halves)).where("lo < hi").withColumn("bucket", _bucket())


def _split(rows: DataFrame) -> DataFrame:
    """Buckets of more than HOT words dealt by halves of their places."""
    while True:
        hot = common.cut(rows.groupBy("bucket", F.expr("hi - lo").alias("width")).agg(F.count("*").alias("many")).where((F.col("many") > HOT) & (F.col("width") > 1)).select("bucket"))
        if hot.isEmpty():
            return rows
        middle = F.expr("(lo + hi) div 2").cast("int")
        halves = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
        again = rows.join(hot, "bucket", "left_semi").select("word", "n", "m", F.inline(halves)).withColumn("bucket", _bucket())
        rows = common.cut(rows.join(hot, "bucket", "left_anti").unionByName(again))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): for words (word, n) with near words, how many, and the largest count with its word."""
    rows = _split(_dealt(words)).repartition("bucket").sortWithinPartitions("m", "lo", "hi", "bucket")
    found = common.map_batches(rows, _ask, "word string, near long, less long, best string")
    each = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "best")).alias("b"))
    return each.select("word", "n_near", (-F.col("b.less")).alias("near_n"), F.col("b.best").alias("near"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): where a chain of (word, form) ends."""
    roots = common.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(onward, "root", "left_semi").isEmpty():
            return roots
        roots = common.cut(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every distinct word of (word, n).

    form: the near word of largest count (ties: the smallest), if that is ratio
    times the word's own or more; root: the end of the chain of forms.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    words = common.cut(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    named = words.join(near_words(words), "word", "left")
    has = F.col("near_n") >= ratio * F.col("n")
    named = common.cut(named.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")))
    roots = followed(named.where("form is not null"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def runs_of(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 7) -> DataFrame:
    """(key, run): every maximal run of Latin letters of so many code points, with A to Z lower-cased."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))
    return docs.select(F.col(key), F.explode(found).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))


def damaged(run: Column, key: Column, every: int = 31) -> Column:
    """The run without one code point where the CRC-32 of key and run is divisible by ``every``, as the query's contract fixes."""
    h = F.crc32(F.concat(key.cast("string"), F.lit(":"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(every)) == 0, less).otherwise(run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = runs_of(common.table(spark, sf_dir, "documents"))
    made = runs.select(damaged(F.col("run"), F.col("doc_id")).alias("word")).where(F.length("word") >= 7)
    return variants(made.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2"))
