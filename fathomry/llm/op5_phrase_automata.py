"""Substring dedup with repeated-phrase automata.

A phrase is a window of WINDOW words. Every window has an anchor: of the
hashes of its runs of RUN words the smallest, which depends on the window's
words alone. The steps, all keyed by a document's id or by an anchor:

1. texts that another document with a smaller id equals are set aside: all
   their windows are repeats. Texts are equal if their SHA-256 agree in 128 bits;
2. all other texts are streamed for their anchors; anchors that occur in two
   documents mark passages that may recur. These rows of an id and an anchor move
   once; those of one anchor, however common, are sorted in one task, which may
   spill;
3. the texts are streamed again, and the words around each such anchor (a
   region: all windows with that anchor) go to the anchor's shard; equal
   regions of a batch travel as one row with a list of places. What is left of
   a text has no window that recurs and meets no automaton;
4. a shard compiles the windows that two documents seem to share into an
   Aho-Corasick automaton over word numbers, each with the smallest id of the
   documents that hold it, and streams all of its regions through the automaton.
   The automaton decides: it finds every occurrence by its words, and hashes
   only choose what is compiled. An automaton is built over about SHARD
   regions; if an anchor has more, they come in order of their smallest id, and
   only regions that were the first with a window are carried on to the next;
5. each document's occurrences whose window starts in a document with a smaller
   id cover the words to remove.

Defined results: a null text has no words; a document of fewer than WINDOW
words keeps all; documents with equal ids are not smaller than one another; a
null id counts as larger than any other; repeated rows each get a row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 13
RUN = 5
SHARD = 12_000
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20
LAST = (1 << 63) - 1
_RNG = np.random.default_rng(20_240_501)
_BYTE = _RNG.integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, RUN, dtype=np.uint64) | np.uint64(1)
_WORD = _RNG.integers(1, 1 << 63, (2, WINDOW), dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
PLACE = struct.Struct("<q16si")
#: Parts into which rows without an id are dealt.
PARTS = 1024


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and how many words each text has."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = _SPACE[buf]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    n_words = np.diff(np.searchsorted(starts, ends), prepend=0)
    span = np.diff(starts, append=len(buf))
    at = np.arange(starts[0], len(buf)) - np.repeat(starts, span)
    body = buf[starts[0] :].astype(np.uint64)
    long = at >> 12
    value = (body + np.uint64(1)) * _BYTE[at & 4095]
    if long.any():
        value *= (2 * long + 1).astype(np.uint64)
    value[space[starts[0] :]] = 0
    return _mixed(np.add.reduceat(value, starts - starts[0])), n_words


def anchors(words: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window: where it starts among all words, the anchor's hash and the anchor's place."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    m = len(words) - RUN + 1
    run = np.zeros(m, np.uint64)
    for j in range(RUN):
        run += words[j : j + m] * _PLACE[j]
    run = _mixed(run).view(np.int64)
    best, place = run[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, WINDOW - RUN + 1):
        here = run[j : j + n]
        less = here < best
        best[less] = here[less]
        place[less] = j
    of = np.repeat(np.arange(len(n_words)), n_words)
    start = np.flatnonzero(of[:n] == of[WINDOW - 1 :])
    return start, best[start], start + place[start]


def _groups(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, did, part), consecutive repeats once."""
    for batch in common.slices(batches):
        dids, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "part"))
        for at, texts in _groups(_texts(batch)):
            words, n_words = word_hashes(texts)
            start, anchor, place = anchors(words, n_words)
            if not len(start):
                continue
            new = np.r_[True, place[1:] != place[:-1]]
            of = np.repeat(np.arange(len(n_words)), n_words)[start[new]]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[new]), pa.array(dids[at + of]), pa.array(parts[at + of])], names=["anchor", "did", "part"])


def _find_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, low, region, places): the words of all windows at a recurring anchor, where in which documents they stand, and the smallest of these."""
    for batch in batches:
        dids, ths = batch.column("did").to_pylist(), batch.column("th").to_pylist()
        marked = batch.column("anchors")
        places: dict[tuple[int, bytes], list[bytes]] = {}
        for at, texts in _groups(_texts(batch)):
            hashed, n_words = word_hashes(texts)
            start, anchor, place = anchors(hashed, n_words)
            firsts = np.cumsum(n_words) - n_words
            edges = np.searchsorted(start, np.append(firsts, len(hashed)))
            for k, text in enumerate(texts):
                lo, hi = edges[k], edges[k + 1]
                if lo == hi:
                    continue
                keep = np.isin(anchor[lo:hi], marked[at + k].values.to_numpy(zero_copy_only=False))
                found = np.flatnonzero(keep)
                if not len(found):
                    continue
                # cut where the anchor's place changes or windows are left out
                cuts = np.flatnonzero((np.diff(found) != 1) | (np.diff(place[lo:hi][found]) != 0)) + 1
                words = text.split()
                for part in np.split(found, cuts):
                    first = int(start[lo + part[0]] - firsts[k])
                    key = (int(anchor[lo + part[0]]), b" ".join(words[first : first + len(part) + WINDOW - 1]))
                    places.setdefault(key, []).append(PLACE.pack(dids[at + k], ths[at + k], first))
        if places:
            low = [min(PLACE.unpack(p)[0] for p in each) for each in places.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in places], pa.int64()), pa.array(low, pa.int64()), pa.array([r for _, r in places], pa.binary()), pa.array([b"".join(p) for p in places.values()], pa.binary())],
                names=["anchor", "low", "region", "places"],
            )


def _recurring(ids: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where it starts, its region) of the first of all windows with equal hashes, if two documents may hold it.

    ids: the word numbers of all regions; size: words of each; low, high: smallest and largest document of each, low ascending.
    """
    n = len(ids) - WINDOW + 1
    of = np.repeat(np.arange(len(size)), size)
    start = np.flatnonzero(of[:n] == of[WINDOW - 1 :])
    first = np.zeros(len(ids), bool)
    if not len(start):
        return start, start
    word = ids.astype(np.uint64) + np.uint64(1)
    one, two = (_mixed(sum(word[j : j + n] * m[j] for j in range(WINDOW)))[start] for m in _WORD)
    order = np.lexsort((start, two, one))
    one, two, start = one[order], two[order], start[order]
    edge = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    region = of[start]
    firsts, most = start[edge], np.maximum.reduceat(high[region], edge)
    shared = low[of[firsts]] < most
    first[firsts] = True
    return firsts[shared], np.unique(of[np.flatnonzero(first)])


def _locate(rows: list[tuple[int, bytes, bytes]]) -> tuple[list[tuple[int, bytes, int, int]], list[int]]:
    """(did, th, start, mask) for places whose windows occur in a document with a smaller id, bit i of the mask being
    the window at start + i; and the rows that are the first with a window. Rows come in order of their smallest id."""
    number: dict[bytes, int] = {}
    read = [[number.setdefault(w, len(number)) for w in region.split(b" ")] for _, region, _ in rows]
    where = [list(PLACE.iter_unpack(packed)) for _, _, packed in rows]
    size = np.array([len(r) for r in read])
    ids = np.array([i for r in read for i in r])
    low = np.array([r[0] for r in rows])
    high = np.array([max((p[0] for p in places), default=least) for (least, _, _), places in zip(rows, where, strict=True)])
    start, firsts = _recurring(ids, size, low, high)
    out: list[tuple[int, bytes, int, int]] = []
    if not len(start):
        return out, firsts.tolist()
    region = np.searchsorted(np.cumsum(size), start, side="right")
    at = start - (np.cumsum(size) - size)[region]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for r, i in zip(region.tolist(), at.tolist(), strict=True):
        automaton.add_word(tuple(read[r][i : i + WINDOW]), rows[r][0])
    automaton.make_automaton()
    for words, places in zip(read, where, strict=True):
        if not places:
            continue
        hits = [(1 << end - WINDOW + 1, least) for end, least in automaton.iter(tuple(words))]
        if not hits:
            continue
        most, every = max(h[1] for h in hits), sum(h[0] for h in hits)
        for did, th, begin in places:
            mask = every if did > most else sum(bit for bit, least in hits if least < did)
            if mask:
                out.append((did, th, begin, mask))
    return out, firsts.tolist()


def _run_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and smallest id."""
    rows: list[tuple[int, bytes, bytes]] = []
    anchors: list[int] = []

    def out(following: int | None) -> pa.RecordBatch:
        order = sorted(range(len(rows)), key=lambda i: rows[i][0])
        made, firsts = _locate([rows[i] for i in order])
        # an anchor that goes on keeps what was the first with a window
        kept = [(rows[order[i]][0], rows[order[i]][1], b"") for i in firsts if anchors[order[i]] == following]
        rows[:], anchors[:] = kept, [following] * len(kept)
        columns = list(zip(*made, strict=True)) if made else [()] * 4
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["did", "th", "start", "mask"])

    full = SHARD
    for batch in batches:
        for anchor, low, region, places in zip(*[batch.column(c).to_pylist() for c in ("anchor", "low", "region", "places")], strict=True):
            if len(rows) >= full and (anchor != anchors[-1] or len(rows) >= 2 * full):
                yield out(anchor)
                full = max(SHARD, 2 * len(rows))
            rows.append((low, region, places))
            anchors.append(anchor)
    if rows:
        yield out(None)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        made = []
        ths, copies, hits = (batch.column(c).to_pylist() for c in ("th", "copies", "hits"))
        for text, th, copy, hit in zip(_texts(batch), ths, copies, hits, strict=True):
            words = text.split()
            n = len(words)
            if copy and th in copy:
                gone = n if n >= WINDOW else 0
                kept = [] if gone else words
            elif hit:
                keep = bytearray(b"\1") * n
                for h in hit:
                    if h["th"] == th:
                        mask, at = h["mask"], h["start"]
                        while mask:
                            if mask & 1:
                                keep[at : at + WINDOW] = bytes(WINDOW)
                            mask >>= 1
                            at += 1
                kept = list(compress(words, keep))
                gone = n - len(kept)
            else:
                kept, gone = words, 0
            made.append((n, gone, b" ".join(kept).decode()))
        columns = list(zip(*made, strict=True)) if made else [()] * 3
        kinds = (pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("did"), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=["did", "n_words", "n_removed", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut_out(batches):
        made = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in batch.column("kept").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], made], names=["did", "n_words", "n_removed", "kept_sha256"])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Per document: its id, n_words, n_removed and ``kept``, the kept words joined by spaces (digest: their SHA-256)."""
    sha = F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))
    # a row is found again by its id and part; rows without an id would else be one group
    part = F.coalesce(F.when(F.col("did") == LAST, F.pmod(F.xxhash64("th"), F.lit(PARTS)).cast("int")), F.lit(0)).alias("part")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("did"), sha.alias("th"), F.col(text).alias("text")).select("did", part, "th", "text")
    row = ["did", "part"]
    # the texts move once: all three streams below read this exchange
    dealt = rows.repartition(*row)
    light = rows.select("did", "th").distinct()
    firsts = light.groupBy("th").agg(F.min("did").alias("first"))
    copies = light.join(firsts, "th").where("did > first").select("did", part, "th").groupBy(*row).agg(F.collect_set("th").alias("copies"))
    flagged = dealt.join(copies, row, "left")
    own = flagged.where(F.col("copies").isNull() | ~F.array_contains("copies", F.col("th")))
    spots = common.map_batches(own.select(*row, "text"), _find_anchors, "anchor long, did long, part int")
    # one exchange: an aggregate and a join back would move these rows twice
    same = Window.partitionBy("anchor")
    spots = spots.withColumns({"lo": F.min("did").over(same), "hi": F.max("did").over(same)}).where("lo < hi")
    marked = spots.groupBy(*row).agg(F.collect_set("anchor").alias("anchors"))
    regions = common.map_batches(own.join(marked, row).select("did", "th", "text", "anchors"), _find_regions, "anchor long, low long, region binary, places binary")
    shards = regions.repartition("anchor").sortWithinPartitions("anchor", "low")
    hits = common.map_batches(shards, _run_shards, "did long, th binary, start long, mask long")
    hits = hits.select("did", part, "th", "start", "mask").groupBy(*row).agg(F.collect_list(F.struct("th", "start", "mask")).alias("hits"))
    last = flagged.join(hits, row, "left").select("did", "th", "text", "copies", "hits")
    kind = "did long, n_words long, n_removed long, "
    out = common.map_batches(last, _digest, kind + "kept_sha256 string") if digest else common.map_batches(last, _cut_out, kind + "kept string")
    return out.select(F.nullif(F.col("did"), F.lit(LAST)).alias(key), *out.columns[1:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
