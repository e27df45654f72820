"""A stored text index: segments of positional, weighted postings.

A segment is a folder with four tables, and counts once the last of them is complete:

* postings: one row per shard, term, field and level, sorted by term; ids, frequencies,
  lengths and positions of the documents that have the term, and ``top``, the most
  that the term can give any of them. Levels part the documents by that gain. A shard is
  a share of the segment's documents, of SHARD at most on average, so no row or task holds all of a common term;
* forward: the terms of each document, to take its counts back when it goes;
* gone, gone_terms: documents of earlier segments that this one removes or replaces, with
  the segment and shard where they lie, and their terms' counts;
* totals: documents and tokens that came and went.

Adding, replacing and removing write a new segment and touch no other. Counts of a
term are summed over segments, less what is gone; ``compact`` writes all as one segment.

A search reads the rows of its terms only (``term`` is a pushed filter). They are exchanged
as rows of arrays by shard; a task scores a shard's documents for the whole batch, highest levels first, and
passes over levels that can't reach the k-th score that a query has by then.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomry.functions import text as tx
from fathomry.functions.ship import ship

from . import fulltext
from .bm25 import K1, B, ranked

#: Documents of a shard, about; levels of gain.
SHARD, LEVELS = 100_000, 8
#: Words that a task turns into postings at once.
TOKENS = 2_000_000
#: Pairs of query and term that a pass sends to all tasks.
PAIRS = 200_000
#: Terms of a query up to which levels are passed over.
FEW = 8
#: Terms up to which they are named in the scan's filter.
NAMED = 10_000
#: Scores that differ by less, as a share of what the query can reach, may tie once rounded.
TIE = 2e-6


class TextIndex:
    """The index at ``path`` of documents with ids in ``key``; fields: column -> weight of ``fulltext.WEIGHTS``; body: the field that BM25 reads."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", fields: dict[str, str] | None = None, body: str = "text"):
        self.spark, self.path, self.key, self.body = spark, path.rstrip("/"), key, body
        self.fields = fields or {body: "c"}
        self._known: dict[tuple, object] = {}

    # ---- segments

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def segments(self) -> list[int]:
        """Numbers of the complete segments, from the last compacted one on."""
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        done = sorted(int(n[4:]) for n in names if re.fullmatch(r"seg-\d+", n) and fs.exists(path(f"{self.path}/{n}/totals/_SUCCESS")))
        whole = [n for n in done if fs.exists(path(f"{self.path}/seg-{n:08d}/whole/_SUCCESS"))]
        return [n for n in done if not whole or n >= whole[-1]]

    def _next(self) -> int:
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return 1 + max([int(n[4:]) for n in names if re.fullmatch(r"seg-\d+", n)], default=0)

    def _read(self, table: str) -> DataFrame | None:
        """A table of all segments, with ``seg``."""
        parts = []
        for n in self.segments():
            # a complete segment never changes: its schema is asked for once
            at = f"{self.path}/seg-{n:08d}/{table}"
            if at not in self._known:
                self._known[at] = self.spark.read.parquet(at).withColumn("seg", F.lit(n))
            parts.append(self._known[at])
        return reduce(DataFrame.unionByName, parts) if parts else None

    def totals(self) -> dict:
        """n, avgdl, and for each segment its own mean length and number of shards."""
        now = tuple(self.segments())
        if now not in self._known:
            self._known[now] = self._read("totals").collect() if now else []
        rows = self._known[now]
        n = sum(r["n"] - r["n_gone"] for r in rows)
        dl = sum(r["dl"] - r["dl_gone"] for r in rows)
        return {"n": n, "avgdl": dl / n if n else 0.0, "segments": {r["seg"]: (r["dl"] / r["n"] if r["n"] else 0.0, r["shards"]) for r in rows}}

    def _shard(self, shards: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")

    def _write(self, docs: DataFrame | None, ids: DataFrame | None, whole: bool = False) -> int:
        seg = self._next()
        at = f"{self.path}/seg-{seg:08d}"
        gone = self._gone(ids)
        gone.select("id", "in_seg", "shard").write.parquet(f"{at}/gone")
        terms = gone.select(F.explode("terms").alias("term"))
        terms.groupBy("term").agg(F.count("*").alias("n")).write.parquet(f"{at}/gone_terms")
        lost = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        n = dl = 0
        shards = 1
        if docs is not None:
            names = {f: f"__w{i}" for i, f in enumerate(self.fields)}
            rows = docs.select(F.col(self.key).alias("id"), *[tx.raw_tokens(F.col(f)).alias(w) for f, w in names.items()]).where("id is not null")
            own = F.col(names[self.body])
            rows = rows.withColumn("dl", F.size(F.filter(own, lambda t: ~t.isin(*tx.STOPWORDS))))
            rows.select("id", "dl", F.array_distinct(own).alias("terms")).write.parquet(f"{at}/forward")
            made = self.spark.read.parquet(f"{at}/forward").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
            n, dl = made["n"], made["dl"]
            shards = max(self.spark.sparkContext.defaultParallelism, -(-n // SHARD))
            self._postings(docs, dl / n if n else 1.0, shards).write.parquet(f"{at}/postings")
        else:
            kind = ids.schema[self.key].dataType.simpleString() if ids is not None else "long"
            none = self.spark.range(0)
            none.selectExpr(f"cast(id as {kind}) id", "0 dl", "cast(array() as array<string>) terms").write.parquet(f"{at}/forward")
            arrays = ", ".join(f"cast(array() as array<{t}>) {c}" for c, t in (("ids", kind), ("tf", "int"), ("dl", "int"), ("len", "int"), ("pos", "array<int>")))
            none.selectExpr("0 shard", "'' term", "'' field", "0 level", "0D top", "0 n", *re.split(r", (?=cast)", arrays)).write.parquet(f"{at}/postings")
        if whole:
            self.spark.range(1).write.parquet(f"{at}/whole")
        self.spark.range(1).selectExpr(f"{n}L n", f"{dl}L dl", f"{lost['n']}L n_gone", f"{lost['dl']}L dl_gone", f"{shards} shards").write.parquet(f"{at}/totals")
        return seg

    def _postings(self, docs: DataFrame, avgdl: float, shards: int) -> DataFrame:
        """Texts are exchanged once, by shard; a task turns TOKENS of them at a time into blocks, so a shard may have several of one term and level."""
        names = {f: f"__w{i}" for i, f in enumerate(self.fields)}
        texts = docs.select(F.col(self.key).alias("id"), *[F.col(f).alias(w) for f, w in names.items()]).where("id is not null").withColumn("shard", self._shard(shards))
        rows = texts.repartitionById(shards, "shard").select("id", "shard", *[tx.raw_tokens(F.col(w)).alias(w) for w in names.values()])
        body, stop = names[self.body], pa.array(tx.STOPWORDS)
        kind = rows.schema["id"].dataType.simpleString()
        schema = f"shard int, term string, field string, level int, top double, n int, ids array<{kind}>, tf array<int>, dl array<int>, len array<int>, pos array<array<int>>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                lens = sum(batch.column(w).value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for w in names.values())
                group = (size + np.cumsum(lens)) // TOKENS
                edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(lens)]
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    if held and size and group[x] > 0:
                        yield from blocks_of(pa.Table.from_batches(held), names, body, stop, avgdl)
                        held, size = [], 0
                    held.append(batch.slice(x, y - x))
                    size = int(lens[x:y].sum()) if len(held) == 1 else size + int(lens[x:y].sum())
            if held:
                yield from blocks_of(pa.Table.from_batches(held), names, body, stop, avgdl)

        ship(self.spark)
        return rows.mapInArrow(run, schema).repartitionByRange("term", "shard").sortWithinPartitions("term", "shard")

    def _gone(self, ids: DataFrame | None) -> DataFrame:
        """(id, in_seg, shard, dl, terms) of the given documents that are in the index."""
        forward = self._read("forward")
        if forward is None or ids is None:
            kind = ids.schema[self.key].dataType.simpleString() if ids is not None else "long"
            return self.spark.range(0).selectExpr(f"cast(id as {kind}) id", "0 in_seg", "0 shard", "0 dl", "cast(array() as array<string>) terms")
        rows = forward.join(ids.select(F.col(self.key).alias("id")).distinct(), "id", "left_semi")
        rows = rows.join(self._read("gone").select("id", F.col("in_seg").alias("seg")), ["id", "seg"], "left_anti")
        count = F.create_map(*[F.lit(x) for s, (_, k) in self.totals()["segments"].items() for x in (s, k)])
        return rows.select("id", F.col("seg").alias("in_seg"), F.pmod(F.xxhash64("id"), count[F.col("seg")]).cast("int").alias("shard"), "dl", "terms")

    def add(self, docs: DataFrame) -> int:
        """Documents come in, in place of those with their ids; rows of one id within ``docs`` count as one document each, so there should be one."""
        return self._write(docs, docs.select(self.key))

    def remove(self, ids: DataFrame) -> int:
        return self._write(None, ids)

    def replace(self, docs: DataFrame, ids: DataFrame) -> int:
        """Documents come in and others go, in one segment."""
        return self._write(docs, ids.select(self.key).unionByName(docs.select(self.key)))

    def compact(self, docs: DataFrame) -> int:
        """Writes one segment of ``docs``, the documents as they are now, in place of all others; earlier ones stay until removed by hand."""
        return self._write(docs, None, whole=True)

    # ---- searches

    def _blocks(self, terms: DataFrame, columns: list[str], body: bool) -> DataFrame | None:
        """Rows of the postings of some terms (term), with ``seg``."""
        rows = self._read("postings")
        if rows is None:
            return None
        named = [r[0] for r in terms.select("term").distinct().limit(NAMED + 1).collect()]
        # tokens hold no quotes; one text is read far faster than a literal for each of them
        listed = "term in ('" + "', '".join(sorted(named)) + "')"
        rows = rows.where(listed if named else "false") if len(named) <= NAMED else rows.join(terms.select("term").distinct(), "term", "left_semi")
        return (rows.where(F.col("field") == self.body) if body else rows).select("seg", "shard", "term", *columns)

    def _counts(self, terms: DataFrame) -> dict[str, int]:
        """In how many documents that are still there each term is."""
        found = self._blocks(terms, ["n"], True).select("term", "n").unionByName(self._read("gone_terms").join(terms.select("term").distinct(), "term", "left_semi").select("term", (-F.col("n")).cast("int").alias("n")))
        return {r["term"]: r["n"] for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect() if r["n"] > 0}

    def bm25(self, queries: DataFrame, k: int = 5, keep: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score, rank) as ``bm25.Index.search`` gives them. queries: query_id, query; keep: ids that may be found."""
        asked = queries.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("query")))).alias("term"))
        about = self.totals()
        if not about["n"]:
            return asked.selectExpr("query_id", "cast(null as long) id", "0D score", "1 rank").where("false")
        passes = -(-asked.count() // PAIRS) or 1
        parts = [self._scored(asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i), about, k, keep) for i in range(passes)]
        found = reduce(DataFrame.unionByName, parts)
        best = F.max("raw").over(Window.partitionBy("query_id"))
        scored = found.withColumn("score", F.when(best > 0, F.col("raw") / best).otherwise(0.0)).drop("raw")
        return ranked(scored, k)

    def _scored(self, asked: DataFrame, about: dict, k: int, keep: DataFrame | None) -> DataFrame:
        """(query_id, id, raw): for each shard the k best of every query, and what may tie with them."""
        pairs = asked.collect()
        counts = self._counts(asked)
        idf = {t: float(np.log(1 + (about["n"] - n + 0.5) / (n + 0.5))) for t, n in counts.items()}
        wanted: dict = {}
        for r in pairs:
            if r["term"] in idf:
                wanted.setdefault(r["query_id"], []).append(r["term"])
        # a segment's bounds were taken at its own mean length
        stretch = {s: max(1.0, about["avgdl"] / own) if own else 1.0 for s, (own, _) in about["segments"].items()}
        sent = self.spark.sparkContext.broadcast((wanted, idf, stretch, about["avgdl"]))
        blocks = self._blocks(asked, ["top", "ids", "tf", "dl"], True).withColumn("kind", F.lit(2))
        kind = blocks.schema["ids"].dataType
        empty = {"term": F.lit(None).cast("string"), "top": F.lit(0.0), "tf": F.lit(None).cast("array<int>"), "dl": F.lit(None).cast("array<int>")}
        gone = self._read("gone").groupBy(F.col("in_seg").alias("seg"), "shard").agg(F.collect_list("id").cast(kind).alias("ids")).withColumns(empty | {"kind": F.lit(0)})
        rows = blocks.unionByName(gone)
        if keep is not None:
            per = F.array(*[F.struct(F.lit(s).alias("seg"), self._shard(n).alias("shard")) for s, (_, n) in about["segments"].items()])
            kept = keep.select("id", F.inline(per)).groupBy("seg", "shard").agg(F.collect_list("id").cast(kind).alias("ids"))
            rows = rows.unionByName(kept.withColumns(empty | {"kind": F.lit(1)}))
        restricted = keep is not None
        schema = asked.select("query_id").schema.add("id", kind.elementType).add("raw", "double")
        types = [pa.field(f.name, t) for f, t in zip(schema.fields, _arrow(schema), strict=True)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, weights, stretches, avgdl = sent.value
            for (seg, _), shard in _shards(batches):
                for q, ids, raw in score_shard(shard, queries, weights, stretches.get(seg, 1.0), avgdl, k, restricted):
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(ids), types[0].type), pa.array(ids, types[1].type), pa.array(raw, pa.float64())], names=["query_id", "id", "raw"])

        ship(self.spark)
        return rows.repartition("seg", "shard").sortWithinPartitions("seg", "shard", "kind", "term").mapInArrow(run, schema)

    def fulltext(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, id, score, rank) of web-style queries (query_id, query), scored as ``fulltext.search`` does."""
        ship(self.spark)
        kind = queries.schema["query_id"].dataType.simpleString()
        words = queries.select("query_id", "query").mapInPandas(_parsed, f"query_id {kind}, clause int, wanted boolean, run int, place int, words int, term string")
        words = words.persist()
        rows = self._blocks(words, ["field", "ids", "tf", "len", "pos"], False)
        if rows is None:
            return words.selectExpr("query_id", "cast(null as long) id", "0D score", "1 rank").where("false")
        each = rows.select("seg", "shard", "term", "field", F.inline(F.arrays_zip(F.col("ids").alias("id"), "tf", "len", "pos")))
        each = each.join(self._read("gone").select("id", F.col("in_seg").alias("seg")), ["id", "seg"], "left_anti")
        hits = words.join(each, "term")
        # who has all words of an alternative, whatever their order
        here = hits.groupBy("query_id", "clause", "wanted", "run", "words", "id").agg(F.count_distinct("place").alias("has")).where("has = words")
        phrases = hits.where("words > 1").join(here.where("words > 1").select("query_id", "clause", "run", "id"), ["query_id", "clause", "run", "id"], "left_semi")
        starts = phrases.select("query_id", "clause", "wanted", "run", "words", "id", "place", F.explode(F.transform("pos", lambda p: p - F.col("place"))).alias("start"))
        phrases = starts.groupBy("query_id", "clause", "wanted", "run", "words", "id", "start").agg(F.count_distinct("place").alias("has")).where("has = words")
        holds = here.where("words = 1").select("query_id", "clause", "wanted", "id").unionByName(phrases.select("query_id", "clause", "wanted", "id")).distinct()
        needed = words.where("wanted").groupBy("query_id").agg(F.count_distinct("clause").alias("needed"))
        good = holds.where("wanted").groupBy("query_id", "id").agg(F.count("*").alias("n")).join(needed, "query_id").where("n = needed")
        good = good.join(holds.where("not wanted"), ["query_id", "id"], "left_anti").select("query_id", "id")
        weight = F.create_map(*[F.lit(x) for f, w in self.fields.items() for x in (f, fulltext.WEIGHTS[w])])
        once = words.where("wanted").select("query_id", "term").distinct().join(each, "term").join(good, ["query_id", "id"], "left_semi")
        field = once.groupBy("query_id", "id", "field").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))
        part = weight[F.col("field")] * F.col("tf") / (1 + F.log1p(F.col("len").cast("double")))
        found = field.groupBy("query_id", "id").agg(F.sum(part).alias("raw"))
        best = F.max("raw").over(Window.partitionBy("query_id"))
        by = Window.partitionBy("query_id").orderBy(F.desc("raw"), "id")
        top = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        return top.withColumn("score", F.round(F.when(best > 0, F.col("raw") / best).otherwise(0.0), 6)).select("query_id", "id", "score", "rank")


def blocks_of(rows: pa.Table, names: dict[str, str], body: str, stop: pa.Array, avgdl: float) -> Iterator[pa.RecordBatch]:
    """The postings of some documents (id, shard and their fields' tokens) as blocks of one shard, term, field and level."""
    lens = {w: rows[w].combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for w in names.values()}
    words = {w: rows[w].combine_chunks().flatten() for w in names.values()}
    places = np.arange(rows.num_rows)
    counted = ~pc.is_in(words[body], value_set=stop).to_numpy(zero_copy_only=False)
    dl = np.bincount(np.repeat(places, lens[body])[counted], minlength=rows.num_rows)
    ids, shard = rows["id"].combine_chunks(), rows["shard"].to_numpy()
    before = np.zeros(rows.num_rows, np.int64)
    listed = lambda edge, values: pa.ListArray.from_arrays(pa.array(edge, pa.int32()), values)
    for field, w in names.items():
        n = lens[w]
        total = int(n.sum())
        if total:
            coded = words[w].dictionary_encode()
            term, doc = coded.indices.to_numpy(), np.repeat(places, n)
            pos = before[doc] + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            # words come by document and position, which a stable order by term keeps
            order = np.argsort(term, kind="stable")
            term, doc, pos = term[order], doc[order], pos[order]
            first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])
            tf = np.diff(np.r_[first, total])
            term, doc = term[first], doc[first]
            gain = tf / (tf + K1 * (1 - B + B * dl[doc] / (avgdl or 1.0)))
            level = np.floor(LEVELS * gain).astype(np.int64)
            at = np.lexsort((doc, level, term, shard[doc]))
            term, doc, tf, gain, level, first = term[at], doc[at], tf[at], gain[at], level[at], first[at]
            own = shard[doc]
            start = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (term[1:] != term[:-1]) | (level[1:] != level[:-1])])
            edge, inner = np.r_[start, len(doc)], np.r_[0, np.cumsum(tf)]
            spots = pos[np.repeat(first - inner[:-1], tf) + np.arange(total)]
            numbers = lambda x, edge=edge: listed(edge, pa.array(x, pa.int32()))
            columns = {
                "shard": pa.array(own[start], pa.int32()),
                "term": coded.dictionary.take(pa.array(term[start])),
                "field": pa.array([field] * len(start)),
                "level": pa.array(level[start], pa.int32()),
                "top": pa.array(np.maximum.reduceat(gain, start)),
                "n": pa.array(np.diff(edge), pa.int32()),
                "ids": listed(edge, ids.take(pa.array(doc))),
                "tf": numbers(tf),
                "dl": numbers(dl[doc]),
                "len": numbers(n[doc]),
                "pos": listed(edge, listed(inner, pa.array(spots, pa.int32()))),
            }
            yield pa.RecordBatch.from_pydict(columns)
        before = before + n


def _arrow(schema) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for q, text in zip(b["query_id"], b["query"], strict=True):
            clauses = fulltext.parse(text or "")
            rows += [(q, c, cl.wanted, r, i, len(run), w) for c, cl in enumerate(clauses) for r, run in enumerate(cl.alternatives) for i, w in enumerate(run)]
        yield pd.DataFrame(rows, columns=["query_id", "clause", "wanted", "run", "place", "words", "term"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Table]]:
    """The rows of one shard together; they come sorted."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("seg", "shard")], 1)
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


def score_shard(shard: pa.Table, queries: dict, idf: dict[str, float], stretch: float, avgdl: float, k: int, restricted: bool = False, skipped: list | None = None):
    """(query, ids, scores) of a shard's best documents. ``skipped`` gets the number of documents of each level passed over."""
    kind = shard["kind"].to_numpy()
    flat = lambda part, c: part[c].combine_chunks().flatten()
    gone, kept, rows = (shard.filter(pa.array(kind == i)) for i in range(3))
    if not rows.num_rows:
        return
    ids = flat(rows, "ids").to_numpy(zero_copy_only=False)
    docs, at = np.unique(ids, return_inverse=True)
    open_ = np.ones(len(docs), bool)
    if gone.num_rows:
        open_ &= ~np.isin(docs, flat(gone, "ids").to_numpy(zero_copy_only=False))
    if restricted:
        open_ &= np.isin(docs, flat(kept, "ids").to_numpy(zero_copy_only=False)) if kept.num_rows else False
    tf, dl = (flat(rows, c).to_numpy().astype(float) for c in ("tf", "dl"))
    gain = tf / (tf + K1 * (1 - B + B * dl / avgdl))
    edge = np.r_[0, np.cumsum(rows["ids"].combine_chunks().value_lengths().to_numpy())]
    levels: dict[str, list[tuple[float, int]]] = {}
    for i, (t, top) in enumerate(zip(rows["term"].to_pylist(), rows["top"].to_pylist(), strict=True)):
        levels.setdefault(t, []).append((min(1.0, top * stretch) * idf.get(t, 0.0), i))
    whole = {t: (edge[own[0][1]], edge[own[-1][1] + 1]) for t, own in levels.items()}
    for own in levels.values():
        own.sort(reverse=True)
    for q, terms in queries.items():
        own = [levels[t] for t in terms if t in levels]
        if not own:
            continue
        reach = sum(lv[0][0] for lv in own)
        score, least = np.zeros(len(docs)), -np.inf
        weight = {i: idf[t] for t in terms if t in levels for _, i in levels[t]}

        def add(blocks: list[int], score=score, weight=weight) -> None:
            for i in blocks:
                a, b = edge[i], edge[i + 1]
                score[at[a:b]] += weight[i] * gain[a:b]

        if len(own) > FEW:
            # so many terms reach any score: whole terms, whose levels lie side by side, at once
            for t in terms:
                if t in levels:
                    a, b = whole[t]
                    score[at[a:b]] += idf[t] * gain[a:b]
        else:
            add([lv[0][1] for lv in own])
        rest = [] if len(own) > FEW else [(bound, i, lv[0][0]) for lv in own for bound, i in lv[1:]]
        if rest:
            seen = score[open_ & (score > 0)]
            if len(seen) >= k:
                least = np.partition(seen, -k)[-k] - TIE * reach
            # a document of this level has at most its bound and the most of the other terms
            go = [i for bound, i, most in rest if bound + reach - most >= least]
            if skipped is not None:
                skipped += [int(edge[i + 1] - edge[i]) for _, i, _ in rest if i not in go]
            add(go)
        found = np.flatnonzero(open_ & (score > 0))
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], -k)[-k] - TIE * reach]
        if len(found):
            yield q, docs[found], score[found]
