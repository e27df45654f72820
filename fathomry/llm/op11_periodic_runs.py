"""Periodic runs of words, found with a suffix automaton per repetitive stretch.

A run is a maximal stretch of words with smallest period q (words q apart are
equal) that holds it at least POWER times and has at least LEAST words.

1. Only stretches in which some SEED consecutive words occur twice can hold a
   run: words of a run recur q further on. Hashes of SEED words pick these
   stretches; what they pick wrongly costs time and changes nothing.
2. A stretch gets a suffix automaton. Its states are taken from the longest to
   the shortest; each has the ordered set of positions at which its words end,
   and the smaller of two sets moves into the larger.
3. When a position enters a set, its distances d to the two new neighbours are
   looked at. If d is not greater than half of the state's length, the words of
   that length before both ends are equal and overlap: a repetition of period d
   starts where they start. Such seeds are squares, kept only where they can
   belong to a run of POWER periods, and are extended to the right; to the left
   they can't be, as the state's words are the longest common ones.
4. Of several periods of one stretch the smallest counts.

A document is one row and never leaves its task: nothing is shuffled.

Defined results: null and empty texts have no words and no runs; repeated rows
each get theirs; an empty table gives an empty result; other columns are kept,
and columns named like the outputs asked for are replaced. A very long text
takes some 100 bytes a word in its task, and about 300 a word of its repetitive
stretches, one stretch at a time.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Least words of a run, and least periods.
LEAST, POWER = 24, 3
#: A run of LEAST words and POWER periods repeats so many words in a row.
SEED = LEAST - LEAST // POWER
#: Positions of a bucket of an ordered set, at most.
BUCKET = 512

_RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
OUTPUTS = {
    "n_words": T.LongType(),
    "runs": T.ArrayType(_RUN, False),
    "collapsed": T.StringType(),
    "collapsed_sha256": T.StringType(),
}
_ARROW = {
    "n_words": pa.int64(),
    "runs": pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")])),
    "collapsed": pa.string(),
    "collapsed_sha256": pa.string(),
}


class EndPositions:
    """An ordered set of distinct numbers in sorted buckets."""

    __slots__ = ("buckets", "firsts", "size")

    def __init__(self, first: int) -> None:
        self.buckets, self.firsts, self.size = [[first]], [first], 1

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Adds a number; gives its neighbours below and above."""
        i = max(bisect_right(self.firsts, x) - 1, 0)
        own = self.buckets[i]
        at = bisect_left(own, x)
        below = own[at - 1] if at else None
        above = own[at] if at < len(own) else self.firsts[i + 1] if i + 1 < len(self.firsts) else None
        own.insert(at, x)
        if not at:
            self.firsts[i] = x
        if len(own) > BUCKET:
            half = len(own) // 2
            self.buckets[i : i + 1] = own[:half], own[half:]
            self.firsts.insert(i + 1, own[half])
        self.size += 1
        return below, above

    def __iter__(self) -> Iterator[int]:
        for b in self.buckets:
            yield from b


class Automaton:
    """The suffix automaton of a sequence of numbers.

    A state's first transition is in two arrays, others are in one dictionary:
    most states have one.
    """

    def __init__(self, words: list[int]) -> None:
        length, link = array("i", [0]), array("i", [-1])
        word, to = array("i", [-1]), array("i", [0])
        more: dict[tuple[int, int], int] = {}
        several: dict[int, list[int]] = {}
        end = array("i", [-1])

        def put(state: int, w: int, target: int) -> None:
            if word[state] == w or word[state] < 0:
                word[state], to[state] = w, target
            else:
                if (state, w) not in more:
                    several.setdefault(state, []).append(w)
                more[state, w] = target

        def state_of(n: int, at: int) -> int:
            for a, v in ((length, n), (link, 0), (word, -1), (to, 0), (end, at)):
                a.append(v)
            return len(length) - 1

        last = 0
        for i, w in enumerate(words):
            new = state_of(length[last] + 1, i)
            p = last
            while p >= 0:
                q = to[p] if word[p] == w else more.get((p, w))
                if q is not None:
                    break
                put(p, w, new)
                p = link[p]
            if p >= 0:
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = state_of(length[p] + 1, -1)
                    word[twin], to[twin], link[twin] = word[q], to[q], link[q]
                    for x in several.get(q, ()):
                        put(twin, x, more[q, x])
                    link[q] = link[new] = twin
                    while p >= 0 and (to[p] if word[p] == w else more.get((p, w))) == q:
                        put(p, w, twin)
                        p = link[p]
            last = new
        self.length, self.link, self.end = length, link, end


def seeds(words: list[int], least: int = LEAST, power: int = POWER) -> dict[tuple[int, int], int]:
    """(start, period) -> last word known: repetitions whose equal parts can belong to a run."""
    made = Automaton(words)
    length, link, end = made.length, made.link, made.end
    sets: dict[int, EndPositions] = {}
    found: dict[tuple[int, int], int] = {}
    # shorter states have no seeds, and neither have those that they link to
    shortest = least - least // power
    for state in np.argsort(np.frombuffer(length, np.int32), kind="stable")[::-1].tolist():
        into = link[state]
        if into <= 0 or length[into] < shortest:
            sets.pop(state, None)
            continue
        own = sets.pop(state, None) or EndPositions(end[state])
        known = sets.get(into)
        if known is None:
            if end[into] < 0:
                sets[into] = own
                continue
            known = EndPositions(end[into])
        if own.size > known.size:
            own, known = known, own
        sets[into] = known
        n = length[into]
        widest = n // (power - 1)
        before = None
        for x in own:
            below, above = known.add(x)
            if below == before:
                below = None  # these two had met in a longer state
            before = x
            for a, b in ((below, x), (x, above)):
                if a is not None and b is not None and b - a <= widest and n + b - a >= least:
                    key = (a - n + 1, b - a)
                    if found.get(key, -1) < b:
                        found[key] = b
    return found


def runs_in(words: list[int], least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    smallest: dict[tuple[int, int], int] = {}
    for (start, period), last in seeds(words, least, power).items():
        stop = last + 1
        while stop < len(words) and words[stop] == words[stop - period]:
            stop += 1
        key = (start, stop)
        smallest[key] = min(smallest.get(key, period), period)
    return sorted((a, b - a, q) for (a, b), q in smallest.items() if b - a >= max(least, power * q))


def stretches(words: np.ndarray, seed: int) -> list[tuple[int, int]]:
    """Bounds of the maximal stretches covered by runs of ``seed`` words that occur more than once."""
    n = len(words) - seed + 1
    if n < 2:
        return []
    h, width, factor = _spread(words), 1, np.uint64(0x9E3779B97F4A7C15)
    whole, done = np.zeros(n, np.uint64), 0
    while width <= seed:
        if seed & width:
            whole = whole * factor + h[done : done + n]
            done += width
        h = h[:-width] * factor + h[width:]
        width, factor = 2 * width, np.uint64(int(factor) ** 2 % (1 << 64))
    order = np.argsort(whole, kind="stable")
    ranked = whole[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(n + 1, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again[:n])
    marks[at] += 1
    marks[at + seed] -= 1
    covered = np.r_[False, np.cumsum(marks[:-1]) > 0, False]
    edge = np.flatnonzero(covered[1:] != covered[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _spread(numbers: np.ndarray) -> np.ndarray:
    x = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def find_runs(words: list, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document's words, by start and period."""
    seed = least - least // power
    if len(words) < least:
        return []
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
    out = []
    for a, b in stretches(ids, seed):
        if b - a >= least:
            out += [(a + s, n, q) for s, n, q in runs_in(ids[a:b].tolist(), least, power)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without what repeats the first period of a run."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, (np.cumsum(gone[:-1]) > 0).tolist(), strict=True) if not g]


def periodic_runs(docs: DataFrame, text: str = "text", outputs: tuple[str, ...] = ("n_words", "runs", "collapsed"), least: int = LEAST, power: int = POWER) -> DataFrame:
    """The rows without the text, with the outputs asked for: n_words, runs, collapsed, collapsed_sha256.

    runs: array of (start, length, period), counted in words from 0, by start and
    period. collapsed: the words without repeats, joined by one space.
    """
    if power < 3 or least < 2 * power:
        raise ValueError("runs have three periods or more, and two words for each at least")
    kept = [c for c in docs.columns if c not in (text, *outputs)]
    schema = docs.select(*kept).schema
    for o in outputs:
        schema = schema.add(o, OUTPUTS[o])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            made: dict[str, list] = {o: [] for o in outputs}
            for t in batch.column("__text"):
                words = (t.as_py() or "").encode().split()
                runs = find_runs(words, least, power)
                if "n_words" in made:
                    made["n_words"].append(len(words))
                if "runs" in made:
                    made["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                if "collapsed" in made or "collapsed_sha256" in made:
                    left = b" ".join(collapse(words, runs))
                    if "collapsed" in made:
                        made["collapsed"].append(left.decode())
                    if "collapsed_sha256" in made:
                        made["collapsed_sha256"].append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(made[o], _ARROW[o]) for o in outputs]], names=[*kept, *outputs])

    return common.map_batches(docs.select(*kept, F.col(text).alias("__text")), run, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period; ties: smallest start, then period. Null if there is none."""
    # runs come by start and period, so the first of equal ones stays
    more = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), more)


def with_tails(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The text of each document whose id's CRC-32 is divisible by 10 gets a periodic tail, as the query's contract fixes."""
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("__w")
    a = F.pmod("__g", n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod("__g", F.lit(8))))).cast("int")
    tailed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("__w", F.when(i < F.col("__a"), i).otherwise(F.col("__a") + F.pmod(i - F.col("__a"), F.col("__p")))))
    rows = docs.withColumns({"__g": g, "__w": F.when(F.pmod(h, F.lit(10)) == 0, words)})
    rows = rows.withColumn("__a", F.when(n > 0, a))
    rows = rows.withColumn("__p", F.when(n > 0, p).cast("int"))
    return rows.withColumn(text, F.when(n > 0, F.array_join(tailed, " ")).otherwise(F.col(text))).drop("__g", "__w", "__a", "__p")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_tails(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = periodic_runs(docs, outputs=("runs", "collapsed_sha256")).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return made.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
