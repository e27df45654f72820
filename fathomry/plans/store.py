"""A store of chunks for one index: a log of commits over Parquet folders, and the calls of a retrieval backend on it.

A change writes its rows, the ids that go, its triples and a folder's manifest to a new
folder, and counts once a file in ``log`` names that folder. The file's number is claimed by creating it, which fails if
another writer was first; the ids that go are worked out anew then, so no change is lost. A row lives
until a later commit lists its id in ``gone``; nothing written is changed, and ``compact`` writes what lives as
one commit. The text index follows the log, a segment a commit, and catches up before a search after a crash.
Claims need a file system whose create without overwriting is atomic.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.operators import bm25, filters, jobs, postings, triples, vector

CHUNK = "chunk_id string, text string, embedding array<double>, source string, source_type string, language string, metadata map<string,string>"
TRIPLE = "subject string, subject_type string, predicate string, object string, object_type string, source_chunk_id string"
MANIFEST = "file_path string, checksum string, mtime double, chunk_ids array<string>"
COLUMNS = [c.split()[0] for c in CHUNK.split(", ")]
#: Times that a commit is tried against other writers.
TRIES = 10


class NotFoundError(LookupError):
    """No such folder (404)."""


class ConflictError(RuntimeError):
    """A job is at work on the folder, or other writers were always first (409)."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: dict[int, dict] = {}

    # ---- the log

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def log(self) -> list[dict]:
        """Commits from the last whole one on."""
        path, fs = self._fs()
        at = path(f"{self.path}/log")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        numbers = [int(n[:8]) for n in names if n.endswith(".json") and n[:8].isdigit()]
        for n in numbers:
            if n not in self._known:
                # a claim is a file that exists; its content may come a moment later
                for _ in range(100):
                    text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/log/{n:08d}.json", wholetext=True).collect())
                    if text.endswith("}"):
                        break
                    time.sleep(0.05)
                else:
                    raise RuntimeError(f"commit {n} of {self.path} has no content; remove its file in log if its writer is gone")
                self._known[n] = json.loads(text) | {"n": n}
        whole = max((n for n in numbers if self._known[n]["whole"]), default=0)
        return [self._known[n] for n in numbers if n >= whole]

    def _claim(self, n: int, entry: dict) -> bool:
        path, fs = self._fs()
        try:
            out = fs.create(path(f"{self.path}/log/{n:08d}.json"), False)
        except Exception as e:
            if fs.exists(path(f"{self.path}/log/{n:08d}.json")):
                return False
            raise e
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return True

    def commit(
        self,
        rows: DataFrame | None = None,
        gone: Callable[[DataFrame], DataFrame] | None = None,
        graph: Callable[[DataFrame], DataFrame] | None = None,
        manifest: Callable[[DataFrame], DataFrame] | None = None,
        batch: str | None = None,
        whole: list[dict] | None = None,
        **entry: object,
    ) -> dict | None:
        """Writes a change and returns its entry; None if nothing would change or ``batch`` is in the log already.

        gone: from the living chunks, those that go (chunk_id); chunks with the ids of ``rows`` go besides.
        graph, manifest: from the rows as written. whole: the log that this commit stands for.
        """
        data = f"{self.path}/data/{uuid.uuid4().hex}"
        if rows is not None:
            rows.write.parquet(f"{data}/rows")
            rows = self.spark.read.schema(CHUNK).parquet(f"{data}/rows")
        if graph is not None:
            graph(rows).write.parquet(f"{data}/triples")
        if manifest is not None:
            manifest(rows).write.parquet(f"{data}/manifest")
        n_rows = rows.count() if rows is not None else 0
        for attempt in range(TRIES):
            before = self.log()
            if whole is not None and before != whole:
                break  # what was read is no longer all that lives
            if batch is not None and any(batch in e["batches"] for e in before):
                return None
            ids = self.spark.createDataFrame([], "chunk_id string")
            if whole is None and before:
                live = self.chunks(before)
                parts = ([live.join(rows.select("chunk_id"), "chunk_id", "left_semi")] if n_rows else []) + ([gone(live)] if gone else [])
                ids = reduce(DataFrame.unionByName, [p.select("chunk_id") for p in parts], ids).distinct()
            at = f"{data}/gone-{attempt}"
            ids.write.parquet(at)
            n_gone = self.spark.read.parquet(at).count()
            if not (n_rows or n_gone or entry or whole is not None or manifest is not None):
                return None
            # a whole commit carries on what the log said: batches seen, folders and the model
            state = {"folders": self.folders(before), "embedding": self.embedding(before)} if whole is not None else {}
            batches = sorted({b for e in before for b in e["batches"]}) if whole is not None else []
            made = {"data": data, "rows": n_rows, "gone": n_gone, "gone_at": at, "graph": graph is not None, "manifest": manifest is not None, "whole": whole is not None, "batches": [*batches, *([batch] if batch else [])], **state, **entry}
            n = (before[-1]["n"] if before else 0) + 1
            if self._claim(n, made):
                return made | {"n": n}
        raise ConflictError("other writers were first")

    # ---- what lives

    def _living(self, log: list[dict], table: str, schema: str, key: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{e['data']}/{table}").withColumn("commit", F.lit(e["n"])) for e in log if (e["rows"] if table == "rows" else e["graph"])]
        if not parts:
            return self.spark.createDataFrame([], f"{schema}, commit int")
        gone = [self.spark.read.schema("chunk_id string").parquet(e["gone_at"]).withColumn("until", F.lit(e["n"])) for e in log if e["gone"]]
        rows = reduce(DataFrame.unionByName, parts)
        if not gone:
            return rows
        last = reduce(DataFrame.unionByName, gone).groupBy(F.col("chunk_id").alias(key)).agg(F.max("until").alias("until"))
        return rows.join(last, key, "left").where("until is null or commit >= until").select(*rows.columns)

    def chunks(self, log: list[dict] | None = None) -> DataFrame:
        return self._living(self.log() if log is None else log, "rows", CHUNK, "chunk_id").select(*COLUMNS)

    def triples(self, log: list[dict] | None = None) -> DataFrame:
        """Triples of living chunks, with the commit that brought them."""
        return self._living(self.log() if log is None else log, "triples", TRIPLE, "source_chunk_id")

    def compact(self) -> dict:
        """Everything that lives, as one commit; fails if another writer commits meanwhile. Folders of earlier commits stay until ``vacuum``."""
        log = self.log()
        known = [m.withColumn("folder_path", F.lit(f)) for f in self.folders(log) if (m := self.manifest(f, log)) is not None]
        listed = reduce(DataFrame.unionByName, known) if known else None
        return self.commit(self.chunks(log), graph=lambda _: self.triples(log).drop("commit"), manifest=(lambda _: listed) if known else None, whole=log)

    def vacuum(self) -> int:
        """Removes folders that no commit from the last whole one on names; not while others write. Returns how many."""
        path, fs = self._fs()
        kept = {e["data"].rsplit("/", 1)[1] for e in self.log()}
        at = path(f"{self.path}/data")
        old = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in kept] if fs.exists(at) else []
        for p in old:
            fs.delete(p, True)
        return len(old)

    # ---- the calls of a backend

    @property
    def is_initialized(self) -> bool:
        path, fs = self._fs()
        return fs.exists(path(f"{self.path}/log"))

    def initialize(self) -> None:
        path, fs = self._fs()
        fs.mkdirs(path(f"{self.path}/log"))

    def rows(self, ids: list[str], embeddings: list, documents: list[str], metadatas: list[dict]) -> DataFrame:
        """Lists of a client as rows; source, source_type and language are taken from the metadata."""
        if len({len(x) for x in (ids, embeddings, documents, metadatas)}) > 1:
            raise ValueError("ids, embeddings, documents and metadatas must be of one length")
        own = [{k: None if v is None else str(v) for k, v in m.items()} for m in metadatas]
        data = [(i, d, [float(x) for x in e], m.get("source"), m.get("source_type"), m.get("language"), m) for i, e, d, m in zip(ids, embeddings, documents, own, strict=True)]
        return self.spark.createDataFrame(data, CHUNK)

    def upsert_documents(self, rows: DataFrame) -> int:
        """New chunks replace those with their ids; of several rows of an id one counts, the last in their order; rows without an id are left out. Other columns are not kept."""
        given = rows.where("chunk_id is not null").select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in CHUNK.split(", "))])
        last = given.withColumn("__at", F.monotonically_increasing_id()).groupBy("chunk_id").agg(F.max_by(F.struct(*COLUMNS[1:]), "__at").alias("s")).select("chunk_id", "s.*")
        made = self.commit(last)
        return made["rows"] if made else 0

    def where(self, conditions: dict[str, object]) -> Column:
        """Equalities on columns, or else on entries of the metadata; a list stands for any of its values."""
        plain = {k: v for k, v in conditions.items() if k in COLUMNS}
        parts = [filters.where(plain)]
        for k, v in conditions.items():
            if k not in COLUMNS:
                value = F.try_element_at("metadata", F.lit(k))
                parts.append(value.isin(*map(str, v)) if isinstance(v, (list, tuple, set)) else value == str(v))
        return reduce(lambda a, b: a & b, parts)

    def delete_by_metadata(self, conditions: dict[str, object]) -> int:
        """The number of chunks that went; without conditions none go."""
        if not conditions:
            return 0
        made = self.commit(gone=lambda live: live.where(F.coalesce(self.where(conditions), F.lit(False))))
        return made["gone"] if made else 0

    def delete_by_ids(self, ids: DataFrame) -> int:
        """ids: chunk_id. Unknown ones do not count."""
        made = self.commit(gone=lambda live: live.join(ids, "chunk_id", "left_semi"))
        return made["gone"] if made else 0

    def reset(self) -> None:
        path, fs = self._fs()
        fs.delete(path(self.path), True)
        self._known.clear()
        self.initialize()

    def get_count(self, conditions: dict[str, object] | None = None) -> int:
        rows = self.chunks()
        return (rows.where(self.where(conditions)) if conditions else rows).count()

    def get_by_id(self, chunk_id: str) -> DataFrame:
        """One row or none; the id is a pushed filter of every scan."""
        return self.chunks().where(F.col("chunk_id") == chunk_id).select("text", "metadata")

    def get_chunk_by_id(self, chunk_id: str) -> DataFrame:
        own = self.chunks().where(F.col("chunk_id") == chunk_id).drop("embedding")
        extra = {k: F.try_element_at("metadata", F.lit(k)) for k in ("summary", "section_summary", "token_count")}
        return filters.chunk_records(own.withColumns(extra))

    def get_embedding_metadata(self) -> dict | None:
        return self.embedding(self.log())

    def embedding(self, log: list[dict]) -> dict | None:
        return next((e["embedding"] for e in reversed(log) if e.get("embedding")), None)

    def set_embedding_metadata(self, provider: str, model: str, dimensions: int) -> None:
        self.commit(embedding={"provider": provider, "model": model, "dimensions": dimensions})

    def validate_embedding_compatibility(self, provider: str, model: str, dimensions: int) -> None:
        """Raises ValueError if the index was made by another model; an index of no model takes any."""
        stored = self.get_embedding_metadata()
        if stored:
            vector.compatible(stored, {"provider": provider, "model": model, "dimensions": dimensions})

    def vector_search(self, embedding: list[float], top_k: int = 5, threshold: float = 0.0, conditions: dict[str, object] | None = None) -> DataFrame:
        """chunk_id, score (0 to 1, cosine), rank, text, source, source_type, language, metadata."""
        rows = self.chunks()
        rows = rows.where(self.where(conditions)) if conditions else rows
        found = vector.search(rows.where("embedding is not null").select("chunk_id", "embedding"), [("q", embedding)], top_k, threshold=threshold, key="chunk_id")
        return self._told(found, top_k)

    def text_index(self) -> postings.TextIndex:
        """The index of living texts, caught up with the log; one process at a time brings it on."""
        log = self.log()
        made = postings.TextIndex(self.spark, f"{self.path}/text-{log[0]['n'] if log else 0:08d}", key="chunk_id")
        changes = [e for e in log if e["rows"] or e["gone"]]
        for e in changes[len(made.segments()) :]:
            gone = self.spark.read.schema("chunk_id string").parquet(e["gone_at"])
            if e["rows"]:
                made.replace(self.spark.read.schema(CHUNK).parquet(f"{e['data']}/rows").select("chunk_id", "text"), gone)
            else:
                made.remove(gone)
        return made

    def keyword_search(self, query: str, top_k: int = 5, source_types: list[str] | None = None, languages: list[str] | None = None, explain: bool = False) -> DataFrame:
        """The same columns by BM25, and the query's terms that each text has if ``explain``."""
        keep = filters.result_filter(self.chunks(), source_types, languages).select(F.col("chunk_id").alias("id")) if source_types or languages else None
        asked = self.spark.range(1).select(F.lit("q").alias("query_id"), F.lit(query).alias("query"))
        found = self._told(self.text_index().bm25(asked, top_k, keep), top_k)
        return found.withColumn("matched_terms", bm25.matched_terms(F.lit(query), F.col("text"))) if explain else found

    def _told(self, found: DataFrame, top_k: int) -> DataFrame:
        # at most top_k rows are sent to all tasks
        few = found.select(F.col("id").cast("string").alias("chunk_id"), "score", "rank").limit(top_k)
        return self.chunks().drop("embedding").join(F.broadcast(few), "chunk_id").orderBy("rank")

    # ---- folders

    def folders(self, log: list[dict] | None = None) -> dict[str, dict]:
        """Records by path: folder_path, last_indexed, include_code, watch_mode."""
        out: dict[str, dict] = {}
        for e in self.log() if log is None else log:
            out |= e.get("folders") or {}
            if e.get("folder"):
                out[e["folder"]["folder_path"]] = e["folder"]
            out.pop(e.get("removed"), None)
        return dict(sorted(out.items()))

    def manifest(self, folder: str, log: list[dict] | None = None) -> DataFrame | None:
        """What is known of a folder's files; None if it was never indexed."""
        for e in reversed(self.log() if log is None else log):
            if e.get("removed") == folder:
                return None
            if e["manifest"] and (e["whole"] or (e.get("folder") or {}).get("folder_path") == folder):
                rows = self.spark.read.schema(f"{MANIFEST}, folder_path string").parquet(f"{e['data']}/manifest")
                return (rows.where(F.col("folder_path") == folder) if e["whole"] else rows).drop("folder_path")
        return None

    def folder_counts(self) -> DataFrame:
        """(folder_path, file_count, chunk_count) of all folders."""
        parts = [m.withColumn("folder_path", F.lit(f)) for f in self.folders() if (m := self.manifest(f)) is not None]
        rows = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{MANIFEST}, folder_path string")
        return rows.groupBy("folder_path").agg(F.count("*").alias("file_count"), F.sum(F.size("chunk_ids")).alias("chunk_count"))

    def remove_folder(self, folder: str, queue: DataFrame | None = None) -> int:
        """A folder's record and chunks go in one commit; returns the number of chunks. queue: jobs (status, folder_path)."""
        if queue is not None and not queue.where(F.col("status").isin(jobs.ACTIVE[1]) & (F.col("folder_path") == folder)).isEmpty():
            raise ConflictError(f"a job is at work on {folder}")
        if folder not in self.folders():
            raise NotFoundError(folder)
        manifest = self.manifest(folder)
        ids = manifest.select(F.explode("chunk_ids").alias("chunk_id")) if manifest is not None else None
        made = self.commit(gone=(lambda live: live.join(ids, "chunk_id", "left_semi")) if ids is not None else None, removed=folder)
        return made["gone"]


def graph_of(chunks: DataFrame) -> DataFrame:
    """Triples of chunks by their metadata and import statements, each once."""
    entry = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    told = chunks.select("chunk_id", "source", *[entry(k) for k in ("symbol_name", "symbol_type", "parent_symbol", "class_name")], F.array().cast("array<string>").alias("imports"))
    stated = triples.from_imports(chunks.select("chunk_id", "text", "language", "source"))
    return triples.from_metadata(told.where("symbol_name is not null")).unionByName(stated).distinct()
