"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies, in Arrow batches.

A text starts as single characters. An agenda holds every adjacent pair whose
concatenation is a piece, ordered by score and then by place; the best pair is
merged and its new neighbours enter the agenda, until it is empty. Characters
that are no piece fall back to bytes.

A merge can only join two characters that stand side by side within some piece.
Texts are cut into segments where that can't be: before a word's space mark and
around characters that no longer piece holds. A task keeps the segments that it
has encoded in a cache of bounded size, which goes when the task ends. The
sentencepiece library checks all segments that an Arrow batch adds to the cache,
all decoded texts, and one whole text of every CHECKED; a difference ends the job.

Defined results: a null text is empty and has no ids; repeated rows each get
their ids; an empty table gives an empty result; other columns are kept, and
columns named like the outputs are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from operator import add, itemgetter

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Bytes, about, of one of the two generations of a task's cache.
CACHE = 40 << 20
#: Bytes of a cached segment besides its characters and ids (eight each, about).
OVERHEAD = 200
#: Of so many texts one is compared whole with the library's encoding.
CHECKED = 16
#: Characters up to which the agenda is a list rather than a heap.
SHORT = 40
NEVER = float("inf")
#: Texts that are cut into segments at a time.
TEXTS = 64
OUTPUTS = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}
TYPES = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        normal = [i for i in range(n) if not (lib.is_unknown(i) or lib.is_control(i) or lib.is_byte(i))]
        if any(lib.is_unused(i) for i in normal):
            raise ValueError("unused pieces are not supported")
        self.ids = {lib.id_to_piece(i): i for i in normal}
        self.rank = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.bytes_ = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(n) if lib.is_byte(i)}
        if len(self.bytes_) != 256:
            raise ValueError("a model with byte fallback is needed")
        surface = {i: lib.id_to_piece(i).replace(MARK, " ").encode() for i in normal} | {i: bytes([b]) for b, i in self.bytes_.items()}
        self.surface = [surface.get(i, b" \xe2\x81\x87 " if lib.is_unknown(i) else b"") for i in range(n)]
        # what merges can join
        pieces = [p for p in self.ids if len(p) > 1]
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        inner = {c for p in pieces for c in p}
        alone = "".join(c for c in "\n\t\r\f\v" if c not in inner)
        if any(MARK in p.lstrip(MARK) for p in pieces) or "\n" not in alone:
            raise ValueError("a vocabulary whose pieces hold marks or line feeds inside is not supported")
        sep = re.escape(alone)
        # segments have spaces for marks: most are ASCII then, which takes the least memory in the cache
        self.segments = re.compile(f" *[^ {sep}]+| +|[{sep}]").findall
        self.decimal = [str(i) for i in range(n)]
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def forget(self) -> None:
        """Empties the cache."""
        self.young, self.old, self.held = {}, {}, 0

    def _keep(self, segment: str, ids: tuple[int, ...]) -> None:
        self.held += OVERHEAD + len(segment) + 8 * len(ids)
        self.young[segment] = ids

    def merge(self, text: str) -> list[int]:
        """Ids of one stretch of text by the agenda."""
        scores = self.rank
        n = len(text)
        sym = list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            if (score := scores.get(text[i : i + 2])) is not None:
                agenda.append((score, i, i + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            a, b = sym[i], sym[j]
            if not a or not b or len(a) + len(b) != size:
                continue  # one of them has been merged meanwhile
            sym[i], sym[j] = a + b, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (score := scores.get(sym[i] + sym[k])) is not None:
                    heapq.heappush(agenda, (score, i, k, size + len(sym[k])))
            if (h := before[i]) >= 0 and (score := scores.get(sym[h] + sym[i])) is not None:
                heapq.heappush(agenda, (score, h, i, size + len(sym[h])))
        return self._ids([s for s in sym if s])

    def merge_short(self, text: str) -> list[int]:
        """The same for a few characters: the agenda is the list of the pairs' scores in order of place."""
        rank = self.rank.get
        sym = list(text)
        agenda = list(map(rank, map(add, text, text[1:]), repeat(NEVER)))
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)
            joined = sym[i] = sym[i] + sym.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(joined + sym[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(sym[i - 1] + joined, NEVER)
        return self._ids(sym)

    def _ids(self, sym: list[str]) -> list[int]:
        ids, out = self.ids, []
        for s in sym:
            if s in ids:
                out.append(ids[s])
            else:
                out += [self.bytes_[b] for b in s.encode()]
        return out

    def encode_segment(self, segment: str) -> list[int]:
        if len(segment) <= SHORT:
            return self.merge_short(segment)
        out: list[int] = []
        at = 0
        for i in range(1, len(segment) + 1):
            if i == len(segment) or segment[i - 1 : i + 1] not in self.joined:
                part = segment[at:i]
                out += self.merge_short(part) if len(part) <= SHORT else self.merge(part)
                at = i
        return out

    def learn(self, segments: set[str]) -> None:
        """Encode new segments, and check them against the library."""
        if self.held > CACHE:
            self.old, self.young, self.held = self.young, {}, 0
        new = list(segments)
        lead = len(self.library.encode("\n"))
        theirs = self.library.encode(["\n" + s for s in new], num_threads=1)
        for s, ids in zip(new, theirs, strict=True):
            own = self.encode_segment(s.replace(" ", MARK))
            if own != ids[lead:]:
                raise RuntimeError(f"the library encodes {s!r} as {ids[lead:]}, not {own}")
            self._keep(s, tuple(own))

    def find(self, segment: str) -> tuple[int, ...] | None:
        found = self.young.get(segment)
        if found is None and (found := self.old.get(segment)) is not None:
            self._keep(segment, found)
        return found

    def split(self, text: str) -> list[str]:
        return self.segments(" " + text.replace(MARK, " ")) if text else []

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        for i in range(0, len(texts), TEXTS):
            yield from self._encode_some([self.split(t) for t in texts[i : i + TEXTS]])

    def _encode_some(self, cut: list[list[str]]) -> Iterator[list[int]]:
        young, find = self.young, self.find
        missing = {s for segments in cut for s in segments if s not in young and find(s) is None}
        if missing:
            self.learn(missing)
            young = self.young
        for segments in cut:
            ids: list[int] = []
            for s in segments:
                ids += young.get(s) or find(s)
            yield ids

    def shown(self, ids: list[int]) -> str:
        """Ids in decimal, joined by commas."""
        return ",".join(itemgetter(*ids)(self.decimal)) if len(ids) > 1 else "".join(map(str, ids))

    def decode(self, ids: list[int]) -> str:
        if not ids:
            return ""
        data = b"".join(itemgetter(*ids)(self.surface)) if len(ids) > 1 else self.surface[ids[0]]
        if data[:1] == b" " and self.library.id_to_piece(self._first(ids)).startswith(MARK):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:  # ids that no text encodes to
            return re.sub("[\udc80-\udcff]", "\ufffd", data.decode("utf-8", "surrogateescape"))

    def decode_batch(self, many: list[list[int]]) -> list[str]:
        """The text of each list of ids, checked against the library."""
        out = [self.decode(ids) for ids in many]
        for ids, own, theirs in zip(many, out, self.library.decode(many, num_threads=1) if many else [], strict=True):
            if ids and own != theirs:
                raise RuntimeError(f"the library decodes {ids} to {theirs!r}, not {own!r}")
        return out

    def check(self, texts: list[str], many: list[list[int]]) -> None:
        """Compares whole texts' ids with the library's."""
        for text, own, theirs in zip(texts, many, self.library.encode(texts, num_threads=1) if texts else [], strict=True):
            if own != theirs:
                raise RuntimeError(f"the library encodes {text!r} as {theirs}, not {own}")

    def _first(self, ids: list[int]) -> int:
        return next((i for i in ids if self.surface[i]), ids[0])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per worker process and model."""
    return Codec(path)


def transcode(docs: DataFrame, text: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens", "decoded"), model: str = MODEL) -> DataFrame:
    """The rows without the text, with the outputs asked for: ids, n_tokens, ids_sha256, decoded, decoded_sha256.

    model: a name that the installed tokenizer files know; every executor opens its own copy.
    """
    kept = [c for c in docs.columns if c not in (text, *OUTPUTS)]
    schema = docs.select(*kept).schema
    for o in outputs:
        schema = schema.add(o, OUTPUTS[o])

    back = "decoded" in outputs or "decoded_sha256" in outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path(model))
        try:
            for batch in common.slices(batches):
                texts = [t or "" for t in batch.column("__text").to_pylist()]
                ids = list(own.encode_batch(texts))
                decoded = own.decode_batch(ids) if back else []
                own.check(texts[::CHECKED], ids[::CHECKED])
                made = {
                    "ids": lambda: ids,
                    "n_tokens": lambda: map(len, ids),
                    "ids_sha256": lambda: (hashlib.sha256(own.shown(i).encode()).hexdigest() for i in ids),
                    "decoded": lambda: decoded,
                    "decoded_sha256": lambda: (hashlib.sha256(d.encode()).hexdigest() for d in decoded),
                }
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(list(made[o]()), TYPES[o]) for o in outputs]], names=[*kept, *outputs])
        finally:
            own.forget()

    return common.map_batches(docs.select(*kept, F.col(text).alias("__text")), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return transcode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
