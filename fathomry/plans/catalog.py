"""All registered queries of the retrieval engine with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomry.functions import entities, languages
from fathomry.functions import text as tx
from fathomry.operators import bm25, caches, cells, chunking, explain, filters, fulltext, fusion, graph, incremental, jobs, postings, rerank, stats, symbols, triples, vector
from fathomry.sources import shared, tables
from fathomry.streaming import feeds

from .batch import search_batch
from .store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Adds a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- pieces that several queries share, in both languages

ASKED = {"q1": "pathetic worthless loser", "q2": "la eau dans elle pour", "q3": "heing with that shatha", "q4": "der die enheit mit lichen"}
VECTORS = {"v1": [float(i % 7 - 3) / 10 for i in range(64)], "v2": [float(i % 5 - 2) / 10 for i in range(64)], "v3": [float(i == 0) for i in range(64)]}

_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"


def _raw(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def _tok(text: str) -> str:
    return f"list_filter({_raw(text)}, lambda t: NOT list_contains({_STOP}, t))"


_ASKED_SQL = "asked(query_id, query) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ASKED.items()) + ")"
_VECTORS_SQL = (
    "vq AS (SELECT 'v1' AS query_id, list_transform(range(64), lambda i: CAST(i % 7 - 3 AS DOUBLE) / 10) AS q UNION ALL "
    "SELECT 'v2', list_transform(range(64), lambda i: CAST(i % 5 - 2 AS DOUBLE) / 10) UNION ALL "
    "SELECT 'v3', list_transform(range(64), lambda i: CAST(i = 0 AS DOUBLE)))"
)


def _bm25_sql(k: int, asked: str = _ASKED_SQL, docs: str = "documents", suffix: str = "") -> str:
    """CTEs up to ranked{suffix}(query_id, id, score, rank)."""
    s = suffix
    return f"""{asked},
w{s} AS (SELECT doc_id AS id, {_tok("text")} AS w FROM documents),
tot{s} AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w{s}),
post{s} AS (SELECT id, t AS term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS t FROM w{s}) GROUP BY id, t),
qt{s} AS (SELECT query_id, unnest(list_distinct({_tok("query")})) AS term FROM asked),
df{s} AS (SELECT term, count(*) AS df FROM post{s} GROUP BY term),
sc{s} AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM post{s} JOIN qt{s} USING (term) JOIN df{s} USING (term) CROSS JOIN tot{s} WHERE id IN (SELECT doc_id FROM {docs}) GROUP BY query_id, id),
nm{s} AS (SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM sc{s}),
ranked{s} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM nm{s} QUALIFY rank <= {k})"""


def _vector_sql(k: int, metric: str = "cosine", suffix: str = "", rows: str = "embeddings", asked: str = _VECTORS_SQL) -> str:
    s = suffix
    score = {
        "cosine": "greatest(0.0, least(1.0, 1 - (1 - list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))))))",
        "l2": "1 / (1 + list_distance(v, q))",
        "inner_product": "greatest(0.0, list_inner_product(v, q))",
    }[metric]
    return f"""{asked},
vv{s} AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM {rows}),
vs{s} AS (SELECT query_id, id, round({score}, 6) AS score FROM vv{s} CROSS JOIN vq),
vranked{s} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM vs{s} QUALIFY rank <= {k})"""


def _asked(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("query_id"), F.lit(v).alias("query")) for k, v in ASKED.items()])
    return spark.range(1).select(F.inline(rows))


_INDEXES: dict[tuple[str, str], bm25.Index] = {}


def _index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """Built once per application and folder, and kept, as a stored index would be."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        docs = _table(spark, sf_dir, "documents")
        tasks = spark.sparkContext.defaultParallelism
        spread = tasks if len(docs.inputFiles()) < tasks else None
        _INDEXES[key] = bm25.Index.build(docs, spread=spread).persist()
    return _INDEXES[key]


_STORED: dict[tuple[str, str], postings.TextIndex] = {}


def _stored(spark: SparkSession, sf_dir: str) -> postings.TextIndex:
    """The stored index of the documents' sources and texts: written once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        docs = _table(spark, sf_dir, "documents")
        tasks = spark.sparkContext.defaultParallelism
        if len(docs.inputFiles()) < tasks:
            docs = docs.repartition(tasks)
        made = postings.TextIndex(spark, shared.fresh(spark, "text-index"), fields={"source": "a", "text": "c"})
        made.add(docs.select("doc_id", "source", "text"))
        _STORED[key] = made
    return _STORED[key]


def _nearest(spark: SparkSession, sf_dir: str, k: int, metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    return vector.search(_table(spark, sf_dir, "embeddings"), list(VECTORS.items()), k, metric, threshold)


# ---- retrieval


@register(f"WITH {_bm25_sql(5)} SELECT query_id, id AS doc_id, score, rank FROM ranked")
def bm25_topk(spark, sf_dir):
    return _index(spark, sf_dir).search(_asked(spark), 5).withColumnRenamed("id", "doc_id")


@register(f"WITH {_bm25_sql(5, docs='''(SELECT doc_id FROM documents WHERE lang IN ('en', 'fr'))''')} SELECT query_id, id AS doc_id, score, rank FROM ranked")
def bm25_filtered(spark, sf_dir):
    keep = _table(spark, sf_dir, "documents").where(filters.where({"lang": ["en", "fr"]})).select(F.col("doc_id").alias("id"))
    return _index(spark, sf_dir).search(_asked(spark), 5, keep).withColumnRenamed("id", "doc_id")


@register(f"WITH {_bm25_sql(3, 'asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)')} SELECT query_id, id AS doc_id, score, rank FROM ranked")
def bm25_batch(spark, sf_dir):
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _stored(spark, sf_dir).bm25(asked, 3).withColumnRenamed("id", "doc_id")


@register(f"""WITH w AS (SELECT unnest({_tok("text")}) AS term, doc_id, lang FROM documents)
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM w GROUP BY term""")
def postings_stats(spark, sf_dir):
    return _index(spark, sf_dir).postings.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


@register(f"""WITH {_bm25_sql(5)},
m AS (SELECT query_id, id AS doc_id, rank, list_filter(list_distinct({_tok("query")}), lambda x: true) AS dummy, query, text FROM ranked JOIN asked USING (query_id) JOIN documents ON doc_id = id)
SELECT query_id, doc_id, rank, array_to_string(list_filter({_tok("query")}, lambda x: list_contains({_tok("text")}, x)), ',') AS terms FROM m""")
def matched_terms(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.broadcast(_index(spark, sf_dir).search(_asked(spark), 5).withColumnRenamed("id", "doc_id")).join(docs, "doc_id").join(F.broadcast(_asked(spark)), "query_id")
    return found.select("query_id", "doc_id", "rank", F.array_join(bm25.matched_terms(F.col("query"), F.col("text")), ",").alias("terms"))


for _metric in ("cosine", "l2", "inner_product"):

    def _make(metric):
        def query(spark, sf_dir):
            return _nearest(spark, sf_dir, 10, metric).withColumnRenamed("id", "vec_id")

        query.__name__ = f"vector_{metric}"
        return query

    register(f"WITH {_vector_sql(10, _metric)} SELECT query_id, id AS vec_id, score, rank FROM vranked")(_make(_metric))


@register(f"WITH {_vector_sql(20)} SELECT query_id, id AS vec_id, score, rank FROM vranked WHERE score >= 0.3")
def vector_threshold(spark, sf_dir):
    return _nearest(spark, sf_dir, 20, threshold=0.3).withColumnRenamed("id", "vec_id")


@register(f"WITH {_vector_sql(5, rows='''(SELECT * FROM embeddings WHERE label IN (1, 2))''')} SELECT query_id, id AS vec_id, score, rank FROM vranked")
def vector_filtered(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").where(filters.where({"label": [1, 2]}))
    return vector.search(rows, list(VECTORS.items()), 5).withColumnRenamed("id", "vec_id")


_PAIRS = {"v1": "q1", "v2": "q2", "v3": "q3"}
_PAIRED = "CASE query_id " + " ".join(f"WHEN '{v}' THEN '{q}'" for v, q in _PAIRS.items()) + " END"


def _both(spark, sf_dir, k=20):
    """Keyword and vector lists of the same queries; vectors without a document are left out."""
    names = F.create_map(*[F.lit(x) for kv in _PAIRS.items() for x in kv])
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    rows = _table(spark, sf_dir, "embeddings").join(docs, "vec_id", "left_semi")
    near = vector.search(rows, list(VECTORS.items()), k).withColumn("query_id", F.element_at(names, F.col("query_id")))
    words = _index(spark, sf_dir).search(_asked(spark).where(F.col("query_id").isin(*_PAIRS.values())), k)
    return near, words


_BOTH_SQL = f"""{_bm25_sql(20)}, {_vector_sql(20, rows='(SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))')},
a AS (SELECT {_PAIRED} AS query_id, id, score, rank FROM vranked), b AS (SELECT * FROM ranked WHERE query_id IN ('q1', 'q2', 'q3'))"""


def _rsf_sql(alpha: float, k: int) -> str:
    return f"""WITH {_BOTH_SQL},
x AS (SELECT query_id, id, score / CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN max(score) OVER (PARTITION BY query_id) ELSE 1.0 END AS s FROM a),
y AS (SELECT query_id, id, score / CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN max(score) OVER (PARTITION BY query_id) ELSE 1.0 END AS s FROM b),
f AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.id, y.id) AS id, coalesce(x.s, 0.0) AS v, coalesce(y.s, 0.0) AS w FROM x FULL JOIN y ON x.query_id = y.query_id AND x.id = y.id),
g AS (SELECT query_id, id, v, w, round({alpha} * v + {1 - alpha} * w, 6) AS score FROM f)
SELECT query_id, id AS doc_id, round(v, 6) AS vector_score, round(w, 6) AS bm25_score, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM g QUALIFY rank <= {k}"""


@register(_rsf_sql(0.5, 10))
def hybrid_rsf(spark, sf_dir):
    out = fusion.relative_scores(*_both(spark, sf_dir), 0.5, 10)
    return out.select("query_id", F.col("id").alias("doc_id"), F.round("vector_score", 6).alias("vector_score"), F.round("bm25_score", 6).alias("bm25_score"), "score", "rank")


@register(" UNION ALL ".join(f"SELECT {a} AS alpha, * FROM ({_rsf_sql(a, 5)})" for a in (0.0, 0.25, 0.75, 1.0)))
def hybrid_alpha_sweep(spark, sf_dir):
    near, words = _both(spark, sf_dir)
    parts = [fusion.relative_scores(near, words, a, 5).select(F.lit(a).alias("alpha"), "query_id", F.col("id").alias("doc_id"), F.round("vector_score", 6).alias("vector_score"), F.round("bm25_score", 6).alias("bm25_score"), "score", "rank") for a in (0.0, 0.25, 0.75, 1.0)]
    return graph.union_all(parts)


@register(f"""WITH {_BOTH_SQL}, u AS (SELECT *, 'v' AS l FROM a UNION ALL SELECT *, 'b' AS l FROM b),
g AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, CAST(coalesce(min(rank) FILTER (l = 'v'), 0) AS INTEGER) AS vector_rank, CAST(coalesce(min(rank) FILTER (l = 'b'), 0) AS INTEGER) AS bm25_rank FROM u GROUP BY ALL)
SELECT query_id, id AS doc_id, score, vector_rank, bm25_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM g QUALIFY rank <= 10""")
def multi_rrf(spark, sf_dir):
    near, words = _both(spark, sf_dir)
    # 0 stands for a list without the document
    return fusion.reciprocal_ranks({"vector": near, "bm25": words}, 10).fillna(0, ["vector_rank", "bm25_rank"]).withColumnRenamed("id", "doc_id")


@register(f"""WITH {_BOTH_SQL}, u AS (SELECT query_id, id, 0.7::DOUBLE / (59 + rank) AS p FROM a UNION ALL SELECT query_id, id, 0.3::DOUBLE / (59 + rank) FROM b),
g AS (SELECT query_id, id, sum(p) AS s FROM u GROUP BY ALL), n AS (SELECT query_id, id, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score FROM g)
SELECT query_id, id AS doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM n QUALIFY rank <= 10""")
def weighted_rrf(spark, sf_dir):
    near, words = _both(spark, sf_dir)
    return fusion.weighted_ranks({"vector": (0.7, near), "bm25": (0.3, words)}, 10).withColumnRenamed("id", "doc_id")


def _fulltext_sql(condition: str, terms: list[str], k: int = 10) -> str:
    asked = "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    return f"""WITH w AS (SELECT doc_id AS id, {_raw("text")} AS w, {_raw("source")} AS a FROM documents),
s AS (SELECT *, ' ' || array_to_string(list_concat(a, w), ' ') || ' ' AS line, list_concat(a, w) AS e FROM w),
f AS (SELECT id, 1.0::DOUBLE * len(list_filter(a, lambda t: list_contains({asked}, t))) / (1 + ln(1 + len(a))) + 0.2::DOUBLE * len(list_filter(w, lambda t: list_contains({asked}, t))) / (1 + ln(1 + len(w))) AS score FROM s WHERE {condition}),
t AS (SELECT * FROM f ORDER BY score DESC, id LIMIT {k})
SELECT id, round(CASE WHEN max(score) OVER () > 0 THEN score / max(score) OVER () ELSE 0.0 END, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM t"""


@register(_fulltext_sql("(list_contains(e, 'pathetic') OR list_contains(e, 'loser')) AND contains(line, ' in the ') AND NOT list_contains(e, 'src3')", ["in", "loser", "pathetic", "the"]))
def fulltext_websearch(spark, sf_dir):
    asked = spark.range(1).select(F.lit(1).alias("query_id"), F.lit('pathetic OR loser "in the" -src3').alias("query"))
    return _stored(spark, sf_dir).fulltext(asked, 10).drop("query_id")


def _phrases(text: str) -> str:
    """The first three words of a text as a phrase, in SQL."""
    return f"array_to_string({_raw(text)}[1:3], ' ')"


@register(f"""WITH q AS (SELECT item_id AS query_id, {_raw("text")}[1:3] AS p, ' ' || {_phrases("text")} || ' ' AS line FROM benchmark WHERE len({_raw("text")}) >= 3),
w AS (SELECT doc_id AS id, {_raw("text")} AS w, {_raw("source")} AS a FROM documents), s AS (SELECT *, ' ' || array_to_string(list_concat(a, w), ' ') || ' ' AS line FROM w),
f AS (SELECT query_id, id, 1.0::DOUBLE * len(list_filter(a, lambda t: list_contains(p, t))) / (1 + ln(1 + len(a))) + 0.2::DOUBLE * len(list_filter(w, lambda t: list_contains(p, t))) / (1 + ln(1 + len(w))) AS score FROM s JOIN q ON contains(s.line, q.line)),
t AS (SELECT query_id, id, score / max(score) OVER (PARTITION BY query_id) AS s, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f)
SELECT query_id, id AS doc_id, round(s, 6) AS score, rank FROM t WHERE rank <= 3""")
def fulltext_phrases(spark, sf_dir):
    """Which documents hold the first three words of each benchmark passage, side by side."""
    words = F.slice(tx.raw_tokens(F.col("text")), 1, 3)
    asked = _table(spark, sf_dir, "benchmark").where(F.size(tx.raw_tokens(F.col("text"))) >= 3)
    asked = asked.select(F.col("item_id").alias("query_id"), F.concat(F.lit('"'), F.array_join(words, " "), F.lit('"')).alias("query"))
    return _stored(spark, sf_dir).fulltext(asked, 3).withColumnRenamed("id", "doc_id")


@register(f"WITH {_bm25_sql(3, 'asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)')} SELECT query_id, id AS doc_id, score, rank FROM ranked")
def bm25_increments(spark, sf_dir):
    """The same answers from an index that came in three steps: a part, a replacement of some of it with the rest, and a removal with what came back."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    made = postings.TextIndex(spark, shared.fresh(spark, "text-index"), fields={"source": "a", "text": "c"})
    made.add(docs.where("doc_id % 3 > 0").withColumn("text", F.when(F.col("doc_id") % 3 == 1, F.lit("an older text")).otherwise(F.col("text"))))
    made.add(docs.where("doc_id % 3 < 2"))
    made.remove(docs.where("doc_id % 50 = 0").select("doc_id"))
    made.add(docs.where("doc_id % 50 = 0"))
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return made.bm25(asked, 3).withColumnRenamed("id", "doc_id")


@register(f"""WITH {_bm25_sql(50)}, c AS (SELECT r.query_id, r.id, r.rank AS original_rank, len(list_filter({_tok("query")}, lambda x: list_contains({_tok("text")}, x))) / len({_tok("query")}) AS s,
  count(*) OVER (PARTITION BY r.query_id) AS n FROM ranked r JOIN asked USING (query_id) JOIN documents ON doc_id = id),
g AS (SELECT query_id, id, original_rank, n, CASE WHEN n > 5 THEN round(CAST(s AS DOUBLE), 6) END AS rerank_score FROM c)
SELECT query_id, id AS doc_id, original_rank, rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, original_rank) AS INTEGER) AS rank,
  CAST(CASE WHEN n > 5 THEN original_rank - rank ELSE 0 END AS INTEGER) AS rerank_movement FROM g QUALIFY rank <= 5""")
def rerank_two_stage(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    first = _index(spark, sf_dir).search(_asked(spark), rerank.first_stage_size(5))
    rows = F.broadcast(first).join(docs, "id").join(F.broadcast(_asked(spark)), "query_id")
    return rerank.rerank(rows, 5).select("query_id", F.col("id").alias("doc_id"), "original_rank", "rerank_score", "rank", F.coalesce("rerank_movement", F.lit(0)).alias("rerank_movement"))


@register(f"""WITH r AS ({_rsf_sql(0.5, 10)}) SELECT query_id, doc_id, rank, printf('Hybrid match (alpha=0.50): vector %.2f + BM25 %.2f -> fused %.2f', 0.5 * vector_score, 0.5 * bm25_score, score) AS reason FROM r""")
def explain_hybrid(spark, sf_dir):
    found = hybrid_rsf(spark, sf_dir)
    return explain.explained(found, "hybrid", 0.5).select("query_id", "doc_id", "rank", "explanation.reason")


# ---- filters and projections


@register("""SELECT doc_id FROM documents WHERE lang IS NOT NULL AND lang IN ('en', 'de') AND regexp_matches('/corpus/' || source || '/' || doc_id || '.md', '^.*/src1[0-9]?/.*\\.md$')""")
def result_filter(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), F.lit(None).cast("string").alias("source_type"), F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"))
    return filters.result_filter(rows, ["doc"], ["en", "de"], ["*/src1/*.md", "*/src1[0-9]/*.md"]).select("doc_id")


@register("""SELECT 'c' || doc_id AS chunk_id, '/corpus/' || source || '/' || doc_id || '.md' AS parent_doc_id, '/corpus/' || source AS folder_id, md5(text) AS content_md5, CAST(n_chars AS INTEGER) AS token_count, lang AS language FROM documents""")
def chunk_records(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), "text", F.col("n_chars").cast("string").alias("token_count"), F.col("lang").alias("language"))
    return filters.chunk_records(rows).select("chunk_id", "parent_doc_id", "folder_id", F.md5(F.col("content").cast("binary")).alias("content_md5"), "token_count", "language")


@register("SELECT doc_id, text FROM documents WHERE doc_id = 7")
def point_lookup(spark, sf_dir):
    return tables.by_id(_table(spark, sf_dir, "documents"), 7, "doc_id").select("doc_id", "text")


@register("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def counts_by_metadata(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


# ---- chunks

_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"
_CHUNKS = f"""w AS (SELECT doc_id AS source, {_WORDS} AS w FROM documents),
l AS (SELECT source, w, CAST(greatest(0, ceil((len(w) - 512) / 462.0)) AS INTEGER) AS last FROM w WHERE len(w) > 0),
c AS (SELECT source, last + 1 AS total_chunks, CAST(unnest(range(last + 1)) AS INTEGER) AS i, w FROM l),
chunks AS (SELECT 'chunk_' || substr(md5(source || '_' || i), 1, 16) AS chunk_id, source, i AS chunk_index, total_chunks, w[i * 462 + 1:i * 462 + 512] AS p FROM c)"""


@register(f"WITH {_CHUNKS} SELECT chunk_id, source, chunk_index, total_chunks, CAST(len(p) AS INTEGER) AS token_count, md5(array_to_string(p, ' ')) AS text_md5 FROM chunks")
def window_chunks(spark, sf_dir):
    out = chunking.windows(_table(spark, sf_dir, "documents"))
    return out.select("chunk_id", "source", "chunk_index", "total_chunks", "token_count", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register(f"WITH {_CHUNKS} SELECT count(*) AS total_chunks, round(avg(len(p)), 6) AS avg_tokens, CAST(min(len(p)) AS INTEGER) AS min_tokens, CAST(max(len(p)) AS INTEGER) AS max_tokens, CAST(sum(len(p)) AS BIGINT) AS total_tokens, count(DISTINCT source) AS unique_sources FROM chunks")
def chunk_stats(spark, sf_dir):
    return chunking.stats(chunking.windows(_table(spark, sf_dir, "documents")))


_SENTENCES = """RECURSIVE p AS (SELECT doc_id AS source, i, unnest(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS j
  FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM documents)),
w AS (SELECT source, i, j, list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '') AS w FROM p),
v AS (SELECT source, i, j, c, w[c * 512 + 1:c * 512 + 512] AS u FROM (SELECT source, i, j, w, unnest(range(CAST(ceil(len(w) / 512.0) AS BIGINT))) AS c FROM w)),
d AS (SELECT source, list(u ORDER BY i, j, c) AS u, list(len(u) ORDER BY i, j, c) AS n FROM v GROUP BY source),
t AS (SELECT source, u, n, list_prepend(0, list_transform(range(1, len(n) + 1), lambda x: list_sum(n[1:x]))) AS cum FROM d),
r AS (SELECT source, 0 AS chunk_index, CAST(1 AS BIGINT) AS a, CAST(1 + len(list_filter(range(2, len(n) + 1), lambda x: cum[x + 1] - cum[1] <= 512)) AS BIGINT) AS e FROM t
  UNION ALL SELECT source, chunk_index, a, CAST(f + len(list_filter(range(f + 1, len(n) + 1), lambda x: cum[x + 1] - cum[a] <= 512)) AS BIGINT) FROM
  (SELECT r.source, r.chunk_index + 1 AS chunk_index, r.e + 1 AS f, t.n, t.cum, CAST(r.e + 1 - len(list_filter(range(r.a, r.e + 1), lambda x: t.cum[r.e + 1] - t.cum[x] <= least(50, 512 - t.n[r.e + 1]))) AS BIGINT) AS a
   FROM r JOIN t USING (source) WHERE r.e < len(t.n))),
c AS (SELECT source, chunk_index, flatten(u[a:e]) AS w FROM r JOIN t USING (source))"""


@register(f"""WITH {_SENTENCES} SELECT 'chunk_' || substr(md5(source || '_' || chunk_index), 1, 16) AS chunk_id, source, CAST(chunk_index AS INTEGER) AS chunk_index,
CAST(count(*) OVER (PARTITION BY source) AS INTEGER) AS total_chunks, CAST(len(w) AS INTEGER) AS token_count, array_to_string(w, ' ') AS text FROM c""")
def sentence_chunks(spark, sf_dir):
    return chunking.sentences(_table(spark, sf_dir, "documents"))


@register("""SELECT conv_id AS source, count(*) AS n_chunks, array_to_string(list_sort(list('chunk_' || substr(md5(conv_id || '_' || turn), 1, 16))), ',') AS chunk_ids FROM conversations GROUP BY conv_id""")
def conversation_chunks(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), chunking.chunk_id(F.col("conv_id").cast("string"), F.col("turn")).alias("chunk_id"))
    return stats.files(rows).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


# ---- languages and file types


@register("""SELECT page_id, lower(regexp_extract(url, '(\\.[^./\\\\]+)$', 1)) AS suffix FROM pages""")
def path_suffix(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", languages.suffix(F.col("url")).alias("suffix"))


@register("""WITH r AS (SELECT doc_id, least(len(regexp_extract_all(text, '(?m)^\\s*import\\s+\\w+')) / 10.0, 1) + least(len(regexp_extract_all(text, '(?m)^\\s*from\\s+\\w+\\s+import')) / 10.0, 1)
  + least(len(regexp_extract_all(text, '(?m)^\\s*def\\s+\\w+\\s*\\(')) / 10.0, 1) + least(len(regexp_extract_all(text, '(?m)^\\s*class\\s+\\w+')) / 10.0, 1) AS s FROM documents)
SELECT doc_id, round(CAST(s AS DOUBLE) / 4, 6) AS python FROM r""")
def content_language(spark, sf_dir):
    found = F.filter(languages.by_content(F.col("text"), len(languages.CONTENT_HINTS)), lambda s: s["language"] == "python")
    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.round(F.try_element_at(found, F.lit(1))["confidence"], 6), F.lit(0.0)).alias("python"))


@register("SELECT unnest(['*.py', '*.pyi', '*.pyw', '*.md', '*.txt', '*.rst', '*.pdf']) AS pattern")
def file_type_presets(spark, sf_dir):
    return spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in languages.preset_patterns(["python", "docs", "text"])])).alias("pattern"))


# ---- triples and graph lookups

_TRIPLES = """t AS (SELECT url AS subject, 'APIDoc' AS subject_type, 'references' AS predicate, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS object, 'Endpoint' AS object_type, page_id AS source_chunk_id FROM pages)"""


def _links(spark, sf_dir):
    return triples.from_links(_table(spark, sf_dir, "pages"))


@register(f"WITH {_TRIPLES} SELECT * FROM t")
def link_triples(spark, sf_dir):
    return _links(spark, sf_dir)


@register(f"WITH {_TRIPLES} SELECT (SELECT count(DISTINCT e) FROM (SELECT subject AS e FROM t UNION ALL SELECT object FROM t)) AS entities, count(*) AS relationships, count(DISTINCT predicate) AS predicates FROM t")
def graph_counts(spark, sf_dir):
    return graph.counts(_links(spark, sf_dir))


@register(f"WITH {_TRIPLES}, e AS (SELECT subject AS name, subject_type AS type, source_chunk_id FROM t UNION ALL SELECT object, object_type, source_chunk_id FROM t) SELECT name, min(type) AS entity_type, count(DISTINCT source_chunk_id) AS n_chunks, count(*) AS degree FROM e GROUP BY name")
def graph_entities(spark, sf_dir):
    return graph.entity_summary(_links(spark, sf_dir))


_NAMES = entities.query_entities("What does the Threesea page say about blog shops")
_ENTITY_SQL = " UNION ALL ".join(f"SELECT {i} AS n, '{e.lower()}' AS entity" for i, e in enumerate(_NAMES))


@register(f"""WITH {_TRIPLES}, e AS ({_ENTITY_SQL}),
h AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY source_chunk_id, subject, predicate, object) AS nth FROM t JOIN e ON contains(lower(subject), entity) OR contains(lower(object), entity) QUALIFY nth <= 10),
o AS (SELECT *, row_number() OVER (PARTITION BY source_chunk_id ORDER BY n, nth) AS one FROM h QUALIFY one = 1),
l AS (SELECT * FROM o ORDER BY n, nth LIMIT 10)
SELECT source_chunk_id, entity, subject || ' -> ' || predicate || ' -> ' || object AS path, 1.0::DOUBLE AS score FROM l""")
def graph_search(spark, sf_dir):
    return graph.entity_search(_links(spark, sf_dir), _NAMES, 10).select("source_chunk_id", "entity", "path", "score")


@register(f"WITH {_TRIPLES} SELECT source_chunk_id, count(*) AS n FROM t WHERE (subject_type = 'APIDoc' OR object_type = 'APIDoc') AND lower(predicate) = 'references' GROUP BY source_chunk_id")
def graph_by_type(spark, sf_dir):
    return graph.by_type(_links(spark, sf_dir), ["apidoc"], ["References"]).groupBy("source_chunk_id").agg(F.count("*").alias("n"))


@register(f"""WITH {_TRIPLES}, n AS (SELECT DISTINCT subject, predicate FROM t WHERE object = '/the')
SELECT 'Endpoint' AS type, '/the' AS id, count(*) AS n_incoming, md5(string_agg(subject, ',' ORDER BY subject)) AS incoming_md5, 0::BIGINT AS n_outgoing FROM n HAVING count(*) > 0""")
def entity_record(spark, sf_dir):
    out = graph.entity_record(_links(spark, sf_dir), "endpoint", "/the")
    ids = F.array_join(F.transform("incoming", lambda x: x["id"]), ",")
    return out.select("type", "id", F.size("incoming").cast("long").alias("n_incoming"), F.md5(ids.cast("binary")).alias("incoming_md5"), F.size("outgoing").cast("long").alias("n_outgoing"))


@register(f"""WITH RECURSIVE {_TRIPLES}, b AS (SELECT DISTINCT subject AS a, object AS b FROM t UNION SELECT DISTINCT object, subject FROM t),
h1 AS (SELECT DISTINCT b AS name FROM b WHERE a = '/the'), h2 AS (SELECT DISTINCT b.b AS name FROM b JOIN h1 ON b.a = h1.name)
SELECT '/the' AS name, 0 AS hop UNION ALL SELECT name, 1 FROM h1 WHERE name <> '/the' UNION ALL SELECT name, 2 FROM h2 WHERE name <> '/the' AND name NOT IN (SELECT name FROM h1)""")
def graph_hops(spark, sf_dir):
    return graph.hops(_links(spark, sf_dir), ["/the"], 2)


@register("""WITH a AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS n FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(n, '\\.[^.]*$', ''), '[^a-zA-Z0-9_]', '_', 'g') AS m FROM a)
SELECT page_id, CASE WHEN m <> '' THEN m END AS module FROM b""")
def module_names(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", entities.module_name(F.col("url")).alias("module"))


@register("""SELECT p_name AS subject, 'Class' AS subject_type, 'contains' AS predicate, p_type AS object, 'Method' AS object_type, p_partkey AS source_chunk_id FROM part
UNION ALL SELECT p_type, 'Method', 'defined_in', p_brand_m, 'Module', p_partkey FROM (SELECT *, regexp_replace(p_brand, '[^a-zA-Z0-9_]', '_', 'g') AS p_brand_m FROM part)""")
def metadata_triples(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_type").alias("symbol_name"), F.lit("method").alias("symbol_type"), F.lit("").alias("parent_symbol"), F.col("p_name").alias("class_name"), F.concat(F.lit("/src/"), "p_brand", F.lit(".py")).alias("source"), F.lit(None).cast("array<string>").alias("imports"))
    return triples.from_metadata(rows)


# ---- incremental indexing

_VERSIONS = """old AS (SELECT '/c/' || doc_id AS file_path, md5(text) AS checksum, 1.0::DOUBLE AS mtime, 'chunk-' || doc_id AS chunk_id FROM documents WHERE source <> 'src5' OR source IS NULL),
new AS (SELECT '/c/' || doc_id AS file_path, md5(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS checksum, CASE WHEN lang = 'fr' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS mtime FROM documents WHERE source <> 'src1' OR source IS NULL)"""
_DIFF = f"""WITH {_VERSIONS}, d AS (SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN n.file_path IS NULL THEN 'deleted' WHEN o.file_path IS NULL THEN 'added' WHEN o.mtime = n.mtime OR o.checksum = n.checksum THEN 'unchanged' ELSE 'changed' END AS change, chunk_id
FROM old o FULL JOIN new n ON o.file_path = n.file_path)"""


def _versions(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("file_path", F.concat(F.lit("/c/"), F.col("doc_id").cast("string")))
    md5 = lambda c: F.md5(c.cast("binary")).alias("checksum")
    old = docs.where("source <> 'src5' or source is null").select("file_path", md5(F.col("text")), F.lit(1.0).alias("mtime"), F.array(F.concat(F.lit("chunk-"), F.col("doc_id").cast("string"))).alias("chunk_ids"))
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.where("source <> 'src1' or source is null").select("file_path", md5(text), F.when(F.col("lang") == "fr", 1.0).otherwise(2.0).alias("mtime"))
    return old, new


@register(f"{_DIFF} SELECT file_path, change FROM d")
def manifest_diff(spark, sf_dir):
    return incremental.diff(*_versions(spark, sf_dir)).select("file_path", "change")


@register(f"{_DIFF} SELECT count(*) FILTER (WHERE change = 'added') AS files_added, count(*) FILTER (WHERE change = 'changed') AS files_changed, count(*) FILTER (WHERE change = 'deleted') AS files_deleted, count(*) FILTER (WHERE change = 'unchanged') AS files_unchanged, count(*) FILTER (WHERE change IN ('changed', 'deleted')) AS chunks_evicted FROM d")
def eviction_summary(spark, sf_dir):
    return incremental.summary(incremental.diff(*_versions(spark, sf_dir)))


@register(f"{_DIFF} SELECT doc_id FROM documents WHERE 'chunk-' || doc_id NOT IN (SELECT chunk_id FROM d WHERE change IN ('changed', 'deleted'))")
def evict_chunks(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("chunk-"), F.col("doc_id").cast("string")).alias("chunk_id"))
    return incremental.without(rows, incremental.evicted(incremental.diff(*_versions(spark, sf_dir)))).select("doc_id")


@register("""WITH n AS (SELECT item_id AS doc_id, text, 1 AS seq FROM benchmark UNION ALL SELECT item_id, text || '!', 2 FROM benchmark WHERE item_id > 10),
l AS (SELECT doc_id, text FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1)
SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT doc_id, md5(text) FROM l""")
def upsert_last_wins(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    new = items.withColumn("seq", F.lit(1)).unionByName(items.where("doc_id > 10").select("doc_id", F.concat("text", F.lit("!")).alias("text"), F.lit(2).alias("seq")))
    out = tables.upsert(_table(spark, sf_dir, "documents").select("doc_id", "text"), new, "doc_id", "seq")
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def delete_by_ids(spark, sf_dir):
    ids = _table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return tables.delete_ids(_table(spark, sf_dir, "documents").select("doc_id"), ids, "doc_id")[0]


@register("SELECT doc_id FROM documents WHERE NOT coalesce(lang = 'en' AND source IN ('src1', 'src2'), false)")
def delete_by_metadata(spark, sf_dir):
    return tables.delete_where(_table(spark, sf_dir, "documents"), filters.where({"lang": "en", "source": ["src1", "src2"]})).select("doc_id")


# ---- jobs, feeds and caches, with events as the log

_STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'cancelled' END"
_LAST = f"j AS (SELECT user_id AS job_id, event_id AS seq, {_STATUS} AS status, ts AS enqueued_at, CAST(event_id % 5 AS INTEGER) AS retry_count FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)"


def _log(spark, sf_dir):
    status = F.expr(_STATUS)
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"), F.col("ts").alias("enqueued_at"), (F.col("event_id") % 5).cast("int").alias("retry_count"))


@register(f"WITH {_LAST} SELECT job_id, seq, status, retry_count FROM j")
def job_replay(spark, sf_dir):
    return jobs.replay(_log(spark, sf_dir)).select("job_id", "seq", "status", "retry_count")


@register(f"WITH {_LAST} SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'cancelled') AS cancelled, count(*) AS total FROM j")
def queue_stats(spark, sf_dir):
    return jobs.stats(jobs.replay(_log(spark, sf_dir)))


@register(f"""WITH {_LAST}, r AS (SELECT job_id, enqueued_at FROM j WHERE status = 'running' ORDER BY enqueued_at, job_id LIMIT 1)
SELECT job_id AS current_job_id, CAST(epoch_ms((SELECT max(ts) FROM events)) - epoch_ms(enqueued_at) AS BIGINT) AS running_time_ms FROM r""")
def queue_current(spark, sf_dir):
    """The running job that started first, and for how long it has run at the log's last event."""
    log = _log(spark, sf_dir).withColumnRenamed("enqueued_at", "started_at")
    last = log.agg(F.max("started_at")).first()[0]
    return jobs.current(jobs.replay(log), F.lit(last))


@register(f"""WITH {_LAST} SELECT job_id, CASE WHEN status = 'running' AND retry_count + 1 > 3 THEN 'failed' WHEN status = 'running' THEN 'pending' ELSE status END AS status, CAST(retry_count + CASE WHEN status = 'running' THEN 1 ELSE 0 END AS INTEGER) AS retry_count FROM j""")
def job_recovery(spark, sf_dir):
    return jobs.recover(jobs.replay(_log(spark, sf_dir))).select("job_id", "status", "retry_count")


@register(f"WITH {_LAST} SELECT job_id, status FROM j ORDER BY enqueued_at DESC, job_id LIMIT 20 OFFSET 20")
def job_page(spark, sf_dir):
    rows, cursor = jobs.page(jobs.replay(_log(spark, sf_dir)), 20)
    return jobs.page(jobs.replay(_log(spark, sf_dir)), 20, cursor)[0].select("job_id", "status")


@register(f"""WITH {_LAST}, n AS (SELECT event_id AS seq, user_id AS dedupe_key FROM events WHERE event_type = 'click')
SELECT dedupe_key, min(seq) AS seq FROM n WHERE dedupe_key NOT IN (SELECT job_id FROM j WHERE status IN ('pending', 'running')) GROUP BY dedupe_key""")
def job_dedupe(spark, sf_dir):
    active = jobs.replay(_log(spark, sf_dir)).withColumnRenamed("job_id", "dedupe_key")
    new = _table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("event_id").alias("seq"), F.col("user_id").alias("dedupe_key"))
    return jobs.enqueue(active, new)


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, sf_dir):
    return feeds.debounced(_table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", gap="6 hours")


@register("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 OR b IS DISTINCT FROM event_type""")
def change_feed(spark, sf_dir):
    return feeds.changed(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@register("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, sum(value) OVER (PARTITION BY event_type) AS t FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, max(value) FILTER (i = least(CAST(floor(n * 0.5) AS BIGINT), n - 1)) AS p50, max(value) FILTER (i = least(CAST(floor(n * 95 / 100.0) AS BIGINT), n - 1)) AS p95, max(value) FILTER (i = least(CAST(floor(n * 99 / 100.0) AS BIGINT), n - 1)) AS p99,
round(max(t) / max(n), 6) AS mean, round(max(n) * 1000.0 / max(t), 6) AS qps FROM s GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return stats.latencies(_table(spark, sf_dir, "events"), "event_type", "value")


@register("""SELECT user_id, count(*) FILTER (WHERE CAST(props->>'k' AS INTEGER) < 50) AS hits, count(*) FILTER (WHERE NOT CAST(props->>'k' AS INTEGER) < 50) AS misses, round(count(*) FILTER (WHERE CAST(props->>'k' AS INTEGER) < 50)::DOUBLE / count(*), 4) AS hit_rate FROM events GROUP BY user_id""")
def cache_hit_rate(spark, sf_dir):
    return caches.hit_rates(_table(spark, sf_dir, "events"), ["user_id"], F.get_json_object("props", "$.k").cast("int") < 50)


@register("""WITH c AS (SELECT DISTINCT sha256(text) || ':none:given:64' AS k FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))
SELECT doc_id, (sha256(text) || ':none:given:64') IN (SELECT k FROM c) AS hit FROM documents""")
def embedding_cache(spark, sf_dir):
    keyed = _table(spark, sf_dir, "documents").withColumn("cache_key", caches.embedding_key(F.col("text"), "none", "given", 64))
    vectors = _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    stored = keyed.join(vectors, "doc_id").groupBy("cache_key").agg(F.min("embedding").alias("embedding"))
    return caches.lookup(keyed.select("doc_id", "cache_key"), stored).select("doc_id", "hit")


@register("WITH u AS (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY t, user_id) AS n, count(*) OVER () AS c FROM u) SELECT user_id FROM r WHERE n > floor(c * 0.1)")
def cache_eviction(spark, sf_dir):
    used = _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cache_key")).agg(F.max("ts").alias("last_accessed"))
    return caches.evict_oldest(used).select(F.col("cache_key").alias("user_id"))


@register("""WITH u AS (SELECT user_id, max(ts) AS t, sum(octet_length(encode(props))) AS size FROM events GROUP BY user_id), b AS (SELECT floor(sum(size) / 2) AS most FROM u),
r AS (SELECT *, sum(size) OVER (ORDER BY t DESC, sha256(CAST(user_id AS VARCHAR)) DESC ROWS UNBOUNDED PRECEDING) AS upto FROM u) SELECT user_id, CAST(size AS BIGINT) AS size FROM r, b WHERE upto <= most""")
def cache_byte_bound(spark, sf_dir):
    used = _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cache_key")).agg(F.max("ts").alias("last_accessed"), F.sum(F.octet_length("props")).alias("size"))
    most = used.agg(F.floor(F.sum("size") / 2).alias("n")).first()["n"]
    return caches.evict_to(used, most or 0, F.col("size")).select(F.col("cache_key").alias("user_id"), "size")


@register(f"""WITH {_LAST}, {_TRIPLES}
SELECT (SELECT count(*) FROM documents) AS total_chunks, (SELECT count(*) FROM documents) AS doc_chunks, (SELECT count(DISTINCT source) FROM documents) AS total_documents, (SELECT array_to_string(list_sort(list(DISTINCT lang)), ',') FROM documents) AS languages,
(SELECT count(DISTINCT e) FROM (SELECT subject AS e FROM t UNION ALL SELECT object FROM t)) AS entities, (SELECT count(*) FROM t) AS relationships, (SELECT count(*) FILTER (WHERE status = 'done') FROM j) AS jobs_done""")
def index_status(spark, sf_dir):
    chunks = _table(spark, sf_dir, "documents").select("source", F.col("lang").alias("language"), F.lit("doc").alias("source_type"))
    out = stats.index_status(chunks, _links(spark, sf_dir), jobs.replay(_log(spark, sf_dir)))
    return out.select("total_chunks", "doc_chunks", "total_documents", F.array_join("languages", ",").alias("languages"), "entities", "relationships", "jobs_done")


# ---- explanations, contexts and shapes


@register(f"""WITH {_bm25_sql(5)}, m AS (SELECT query_id, id AS doc_id, rank, score, list_filter(list_distinct({_tok("query")}), lambda x: true) AS q, query, text FROM ranked JOIN asked USING (query_id) JOIN documents ON doc_id = id),
t AS (SELECT *, list_filter({_tok("query")}, lambda x: list_contains({_tok("text")}, x)) AS terms FROM m)
SELECT query_id, doc_id, rank, printf('BM25 keyword match (score %.2f)', score) || CASE WHEN len(terms) > 0 THEN ': ' || array_to_string(terms[1:5], ', ') ELSE '' END AS reason FROM t""")
def explain_bm25(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = F.broadcast(_index(spark, sf_dir).search(_asked(spark), 5)).join(docs, "id").join(F.broadcast(_asked(spark)), "query_id")
    found = found.withColumns({"bm25_score": F.col("score"), "matched_terms": bm25.matched_terms(F.col("query"), F.col("text"))})
    return explain.explained(found, "bm25").select("query_id", F.col("id").alias("doc_id"), "rank", "explanation.reason")


@register(f"""WITH {_BOTH_SQL}, u AS (SELECT *, 'v' AS l FROM a UNION ALL SELECT *, 'b' AS l FROM b),
g AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, min(rank) FILTER (l = 'v') AS v, min(rank) FILTER (l = 'b') AS b FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM g QUALIFY rank <= 10)
SELECT query_id, id AS doc_id, 'RRF fusion (' || concat_ws(', ', 'vector #' || v, 'BM25 #' || b) || '); rrf_score=' || printf('%.4f', score) AS reason FROM r""")
def explain_multi(spark, sf_dir):
    near, words = _both(spark, sf_dir)
    found = fusion.reciprocal_ranks({"vector": near, "bm25": words}, 10)
    return explain.explained(found, "multi").select("query_id", F.col("id").alias("doc_id"), "explanation.reason")


@register(f"WITH {_TRIPLES}, f AS (SELECT * FROM t WHERE lower(predicate) = 'references') SELECT count(*) AS n_triples, (SELECT count(DISTINCT e) FROM (SELECT subject AS e FROM f UNION ALL SELECT object FROM f)) AS n_entities, count(DISTINCT subject || ' -> ' || predicate || ' -> ' || object) AS n_paths, 1.0::DOUBLE AS score FROM f")
def graph_context(spark, sf_dir):
    return graph.context_counts(graph.by_type(_links(spark, sf_dir), relationships=["references"]).withColumn("score", F.lit(1.0)))


@register(f"""WITH {_TRIPLES}, {_vector_sql(3)}, own AS (SELECT 'v1' AS query_id, source_chunk_id AS id FROM t WHERE object = '/the')
SELECT query_id, id, false AS graph_fallback FROM own UNION ALL SELECT query_id, id, true FROM vranked WHERE query_id <> 'v1' OR NOT EXISTS (SELECT 1 FROM own)""")
def graph_fallback(spark, sf_dir):
    own = _links(spark, sf_dir).where("object = '/the'").select(F.lit("v1").alias("query_id"), F.col("source_chunk_id").alias("id"))
    return graph.fallback(own, _nearest(spark, sf_dir, 3).select("query_id", "id"))


@register("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE trim(text) <> ''),
c AS (SELECT doc_id, l, CAST(greatest(0, ceil((len(l) - 40) / 25.0)) AS INTEGER) AS last FROM l), e AS (SELECT doc_id, l, last, CAST(unnest(range(last + 1)) AS INTEGER) AS i FROM c)
SELECT doc_id, i AS chunk_index, last + 1 AS total_chunks, i * 25 + 1 AS start_line, CAST(least(len(l), i * 25 + 40) AS INTEGER) AS end_line, md5(array_to_string(l[i * 25 + 1:i * 25 + 40], chr(10))) AS text_md5 FROM e""")
def line_chunks(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "text", F.col("lang").alias("language"))
    out = chunking.code_lines(rows)
    return out.select(F.col("source").cast("long").alias("doc_id"), "chunk_index", "total_chunks", "start_line", "end_line", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_METHODS = {"symbols": "p_size % 5 + 1", "chunks": "p_size"}


def _classes(spark, sf_dir, methods: str) -> DataFrame:
    """A class file for each part, with so many methods of three lines."""
    many = F.expr(methods).cast("int")
    body = F.transform(F.sequence(F.lit(1), many), lambda i: F.format_string("    public int m%d(int a) {\n        return a + %d; // }\n    }\n", i, i))
    text = F.concat(F.lit("public class P"), F.col("p_partkey").cast("string"), F.lit(" {\n"), F.array_join(body, ""), F.lit("}"))
    parts, tasks = _table(spark, sf_dir, "part").select("p_partkey", "p_size"), 4 * spark.sparkContext.defaultParallelism
    # a few MB of numbers are read by a task or two and become GB of code: they are dealt out before
    if len(parts.inputFiles()) < tasks:
        parts = parts.repartition(tasks, "p_partkey")
    return parts.select(F.col("p_partkey").alias("source"), text.alias("text"), F.lit("java").alias("language"))


@register(f"""WITH p AS (SELECT p_partkey, CAST({_METHODS["symbols"]} AS INTEGER) AS m FROM part), i AS (SELECT p_partkey, CAST(unnest(range(1, m + 1)) AS INTEGER) AS i FROM p)
SELECT p_partkey AS source, 'P' || p_partkey AS name, 'class_declaration' AS declaration, 1 AS start_line, 3 * m + 2 AS end_line, '' AS parent FROM p
UNION ALL SELECT p_partkey, 'm' || i, 'method_declaration', 3 * i - 1, 3 * i + 1, 'P' || p_partkey FROM i""")
def code_symbols(spark, sf_dir):
    found = symbols.symbols(_classes(spark, sf_dir, _METHODS["symbols"]))
    return found.select("source", "name", "declaration", "start_line", "end_line", F.coalesce("parent", F.lit("")).alias("parent"))


@register(f"""SELECT p_partkey AS source, CAST(3 * ({_METHODS["chunks"]}) + 2 AS BIGINT) AS lines, true AS within, 0::BIGINT AS cut FROM part""")
def code_chunks(spark, sf_dir):
    """Chunks of whole methods: every line once, none over 40 lines or 1,500 characters, no method cut."""
    made = symbols.code_chunks(_classes(spark, sf_dir, _METHODS["chunks"]))
    size = F.col("end_line") - F.col("start_line") + 1
    starts_within = (F.col("start_line") > 1) & ((F.col("start_line") - 2) % 3 != 0)
    return made.groupBy("source").agg(F.sum(size).alias("lines"), F.bool_and((size <= 40) & (F.length("text") <= 1500)).alias("within"), F.count_if(starts_within).alias("cut"))


@register("""WITH c AS (SELECT l_orderkey AS source, l_orderkey * 10 + l_linenumber AS chunk_id, l_linenumber * 40 AS a, l_linenumber * 40 + CAST(l_quantity AS INTEGER) AS b FROM lineitem),
s AS (SELECT l_orderkey AS source, 's' || l_linenumber AS name, l_linenumber * 50 - CAST(l_suppkey % 60 AS INTEGER) AS a, l_linenumber * 50 + CAST(l_partkey % 90 AS INTEGER) AS b FROM lineitem),
j AS (SELECT chunk_id, name, row_number() OVER (PARTITION BY chunk_id ORDER BY CASE WHEN s.a < c.a THEN 1 ELSE 0 END, s.a DESC, s.b, name) AS n FROM c JOIN s ON s.source = c.source AND s.a <= c.b AND s.b >= c.a)
SELECT c.chunk_id, coalesce(j.name, '') AS symbol FROM c LEFT JOIN j ON j.chunk_id = c.chunk_id AND j.n = 1""")
def symbol_overlap(spark, sf_dir):
    """Which symbol a chunk is told by, where both are ranges of lines."""
    lines = _table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber").cast("int")
    chunks = lines.select((F.col("l_orderkey") * 10 + n).alias("chunk_id"), F.col("l_orderkey").alias("source"), (n * 40).alias("start_line"), (n * 40 + F.col("l_quantity").cast("int")).alias("end_line"))
    found = lines.select(F.col("l_orderkey").alias("source"), F.concat(F.lit("s"), n.cast("string")).alias("name"), F.lit("method").alias("kind"), (n * 50 - (F.col("l_suppkey") % 60).cast("int")).alias("start_line"), (n * 50 + (F.col("l_partkey") % 90).cast("int")).alias("end_line"))
    return symbols.overlapping(chunks, found).select("chunk_id", F.coalesce("symbol_name", F.lit("")).alias("symbol"))


@register("""WITH r AS (SELECT page_id, CASE WHEN url LIKE '%example.com%' THEN url END AS source FROM pages)
SELECT page_id, coalesce(source, 'unknown') AS source, 'doc' AS source_type FROM r""")
def result_defaults(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", F.when(F.col("url").like("%example.com%"), F.col("url")).alias("source"), F.lit(None).cast("string").alias("source_type"))
    return filters.results(rows).select("page_id", "source", "source_type")


@register("""SELECT doc_id, lang AS own, 'corpus' AS team, '3' AS level, coalesce(source, '') AS kept FROM documents""")
def metadata_inject(spark, sf_dir):
    extra = F.create_map(F.lit("own"), F.col("lang"), F.lit("team"), F.col("source"), F.lit("kept"), F.coalesce("source", F.lit("")))
    rows = filters.inject(_table(spark, sf_dir, "documents").select("doc_id", extra.alias("extra")), "extra", {"team": "corpus", "level": 3, "tags": ["x"], "source": "no"}, {"source"})
    return rows.select("doc_id", *[F.try_element_at("extra", F.lit(k)).alias(k) for k in ("own", "team", "level", "kept")])


@register("""SELECT 'src/' || source AS folder_path, count(*) AS chunk_count, count(DISTINCT lang) AS file_count FROM documents WHERE source IS NOT NULL GROUP BY source""")
def folder_registry(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").where("source is not null").select(F.concat(F.lit("src/"), "source", F.lit("/"), "lang").alias("source"))
    return stats.folders(rows)


@register("""SELECT event_type, count(DISTINCT sha256('/data/' || user_id || '|' || CASE WHEN value > 50 THEN 'True' ELSE 'False' END || '|' || event_type || '|*.md,*.py|')) AS keys FROM events GROUP BY event_type""")
def dedupe_keys(spark, sf_dir):
    path = F.concat(F.lit("/data/"), F.col("user_id").cast("string"))
    key = jobs.dedupe_column(path, F.col("value") > 50, F.col("event_type"), F.array(F.lit("*.py"), F.lit("*.md")), F.array().cast("array<string>"))
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct(key).alias("keys"))


@register("""WITH m AS (SELECT '/c/' || doc_id AS file_path, 'n-' || doc_id AS new_id FROM documents)
SELECT n.file_path, CASE WHEN o.file_path IS NOT NULL AND (o.mtime = n.mtime OR o.checksum = n.checksum) THEN o.chunk_id ELSE new_id END AS chunk_ids FROM new n LEFT JOIN old o ON o.file_path = n.file_path JOIN m ON m.file_path = n.file_path""".replace("WITH m", f"WITH {_VERSIONS}, m"))
def next_manifest(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    fresh = _table(spark, sf_dir, "documents").select(F.concat(F.lit("/c/"), F.col("doc_id").cast("string")).alias("source"), F.concat(F.lit("n-"), F.col("doc_id").cast("string")).alias("chunk_id"))
    return incremental.next_manifest(old, new, fresh).select("file_path", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@register("""SELECT o_orderkey, 'Ordered by ' || o_custkey AS label FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def where_builder(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").where(filters.where({"o_orderstatus": ["F", "O"]}))
    return rows.select("o_orderkey", F.concat(F.lit("Ordered by "), F.col("o_custkey").cast("string")).alias("label"))


# ---- imports, answers, single steps of jobs and tables


_WRITTEN = "lower(replace(p_brand, '#', '_'))"


@register(f"""WITH p AS (SELECT p_partkey, {_WRITTEN} AS b, p_size FROM part)
SELECT 'mod_' || p_partkey AS subject, 'Module' AS subject_type, 'imports' AS predicate, b AS object, 'Module' AS object_type, p_partkey AS source_chunk_id FROM p
UNION ALL SELECT 'mod_' || p_partkey, 'Module', 'imports', 'pkg.' || b, 'Module', p_partkey FROM p WHERE p_size > 25""")
def import_triples(spark, sf_dir):
    name = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")))
    text = F.concat(F.lit("import "), name, F.lit("\nx = 1\n"), F.when(F.col("p_size") > 25, F.concat(F.lit("from pkg."), name, F.lit(" import y\n"))).otherwise(F.lit(" import no\n")))
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), text.alias("text"), F.lit("python").alias("language"), F.concat(F.lit("/s/mod-"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("source"))
    return triples.from_imports(rows)


@register("""SELECT n_name AS subject, 'lies_in' AS predicate, 'Region ' || n_regionkey AS object, n_nationkey AS source_chunk_id FROM nation
UNION ALL SELECT n_name, 'sells', 'Goods', n_nationkey FROM nation WHERE n_regionkey > 1""")
def answer_triples(spark, sf_dir):
    second = F.when(F.col("n_regionkey") > 1, F.concat(F.col("n_name"), F.lit(" | class | SELLS | Goods | module"))).otherwise(F.lit("no | triple"))
    answer = F.concat_ws("\n", F.concat(F.col("n_name"), F.lit(" | Lies_In |  Region "), F.col("n_regionkey").cast("string")), F.lit("a || b"), second)
    out = triples.from_answers(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("chunk_id"), answer.alias("answer")))
    return out.select("subject", "predicate", "object", "source_chunk_id")


@register("""SELECT 'customer ' || o_custkey AS subject, 'Class' AS subject_type, 'placed' AS predicate, CAST(o_orderkey AS VARCHAR) AS object, NULL AS object_type, o_orderkey AS source_chunk_id FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, 'has', o_orderpriority, 'Module', o_orderkey FROM orders WHERE o_totalprice > 100000""")
def extraction_triples(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    order = F.col("o_orderkey").cast("string")
    first = F.struct(F.concat(F.lit("customer "), "o_custkey").alias("subject"), F.lit("class").alias("head_type"), F.lit(" PLACED ").alias("predicate"), order.alias("tail"))
    second = F.struct(F.lit("").alias("subject"), order.alias("head"), F.lit("has").alias("relation"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).otherwise("").alias("object"), F.lit("module").alias("object_type"))
    wrapped = [F.concat(F.lit('{"attributes": '), F.to_json(x), F.lit("}")) for x in (first, second)]
    given = F.concat(F.lit('[{"attributes": "none"}, '), F.concat_ws(", ", *wrapped), F.lit("]"))
    return triples.from_extractions(orders.select(F.col("o_orderkey").alias("chunk_id"), given.alias("extractions")))


@register(f"{_DIFF.replace('WITH', 'WITH', 1)} SELECT file_path, CASE WHEN change = 'deleted' THEN 'deleted' ELSE 'added' END AS change FROM d")
def forced_diff(spark, sf_dir):
    return incremental.diff(*_versions(spark, sf_dir), force=True).select("file_path", "change")


@register(f"WITH {_VERSIONS} SELECT chunk_id FROM old")
def forced_eviction(spark, sf_dir):
    return incremental.evicted(incremental.diff(*_versions(spark, sf_dir), force=True), force=True)


@register(f"WITH {_LAST} SELECT job_id, CASE WHEN job_id = 7 AND status = 'pending' THEN 'cancelled' ELSE status END AS status, job_id = 7 AND status = 'running' AS cancel_requested FROM j")
def job_cancel(spark, sf_dir):
    rows = jobs.replay(_log(spark, sf_dir)).withColumn("cancel_requested", F.lit(None).cast("boolean"))
    return jobs.cancel(rows, 7).select("job_id", "status", "cancel_requested")


@register(f"WITH {_LAST} SELECT job_id, CAST(row_number() OVER (ORDER BY enqueued_at, job_id) AS INTEGER) AS place FROM j WHERE status = 'pending'")
def job_fifo(spark, sf_dir):
    ordered = jobs.pending(jobs.replay(_log(spark, sf_dir)))
    return ordered.select("job_id", F.row_number().over(Window.orderBy("enqueued_at", "job_id")).alias("place"))


@register("""WITH j AS (SELECT user_id AS job_id, min(ts) AS a, max(ts) AS b, count(*) AS total, count(*) FILTER (WHERE event_type = 'view') AS done FROM events GROUP BY user_id)
SELECT job_id, CAST(floor((epoch_us(b) - epoch_us(a)) / 1000) AS BIGINT) AS execution_time_ms, round(100.0::DOUBLE * done / total, 1) AS percent_complete FROM j""")
def job_durations(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.count("*").alias("files_total"), F.count_if(F.col("event_type") == "view").alias("files_processed"))
    return jobs.durations(rows).select("job_id", "execution_time_ms", "percent_complete")


@register(f"""WITH {_LAST}, m AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 'running' ELSE 'done' END AS t FROM j),
a AS (SELECT *, (status = 'pending' AND t = 'running') OR (status = 'running' AND t = 'done') AS accepted FROM m)
SELECT job_id, CASE WHEN accepted THEN t ELSE status END AS status, accepted FROM a""")
def job_transitions(spark, sf_dir):
    now = jobs.replay(_log(spark, sf_dir))
    moves = now.select("job_id", F.when(F.col("seq") % 2 == 0, "running").otherwise("done").alias("to"))
    return jobs.transition(now, moves).select("job_id", "status", "accepted")


@register("""SELECT user_id AS job_id, CASE WHEN count(*) FILTER (WHERE event_type = 'view') > count(*) FILTER (WHERE event_type = 'click') THEN 'done'
WHEN count(*) FILTER (WHERE event_type = 'view') = count(*) FILTER (WHERE event_type = 'click') AND count(*) FILTER (WHERE event_type = 'view') > 0 AND count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'done' ELSE 'failed' END AS status FROM events GROUP BY user_id""")
def job_delta_check(spark, sf_dir):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    rows = _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg(n("click").alias("chunks_before"), n("view").alias("chunks_after"), n("error").alias("files_processed"))
    rows = rows.withColumns({"status": F.lit("done"), "chunks_to_create": F.lit(None).cast("long")})
    return jobs.checked_delta(rows).select("job_id", "status")


@register("SELECT count(*) AS total_chunks, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages, array_to_string(list_sort(list(DISTINCT source)), ',') AS symbol_kinds FROM documents")
def code_stats(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), F.col("source").alias("symbol_kind"))
    return stats.code_stats(rows).select("total_chunks", F.array_join("languages", ",").alias("languages"), F.array_join("symbol_kinds", ",").alias("symbol_kinds"))


@register("SELECT lang AS language, count(DISTINCT doc_id) AS n_documents, count(*) AS n_chunks FROM documents WHERE source IN ('src1', 'src2', 'src3') GROUP BY lang")
def code_by_language(spark, sf_dir):
    kind = F.when(F.col("source").isin("src1", "src2", "src3"), "code")
    return stats.by_language(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.col("lang").alias("language"), kind.alias("source_type")))


@register("""SELECT p_partkey, CASE WHEN p_size > 25 THEN lower(p_brand) || ',' || lower(p_type) ELSE 'none' END AS terms FROM part""")
def headline_terms(spark, sf_dir):
    marked = F.concat(F.lit("<<<"), "p_brand", F.lit(">>> and <<< "), "p_type", F.lit(" >>> <<<"), "p_brand", F.lit(">>>"))
    found = fulltext.headline_terms(F.when(F.col("p_size") > 25, marked).otherwise(F.col("p_type")))
    return _table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.array_join(found, ","), F.lit("none")).alias("terms"))


@register("SELECT doc_id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def add_documents(spark, sf_dir):
    return tables.add(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))


@register("SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 1.5::DOUBLE ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS first FROM embeddings")
def embedding_update(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    new = rows.where("vec_id % 10 = 0").select("vec_id", F.array(F.lit(1.5)).alias("embedding")).unionByName(rows.limit(1).select(F.lit(-1).cast("long").alias("vec_id"), "embedding"))
    return tables.update_column(rows, new, "embedding", "vec_id").select("vec_id", F.round(F.col("embedding")[0], 6).alias("first"))


@register(f"WITH {_bm25_sql(5)} SELECT query_id, id AS doc_id, score, rank FROM ranked")
def bm25_saved(spark, sf_dir):
    """The index written and read again, as a restart does."""
    path = shared.fresh(spark, "bm25")
    _index(spark, sf_dir).save(path)
    return bm25.Index.load(spark, path).search(_asked(spark), 5).withColumnRenamed("id", "doc_id")


@register("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, round(greatest(0.0, least(1.0, list_inner_product(c.v, q.v) / (sqrt(list_inner_product(c.v, c.v)) * sqrt(list_inner_product(q.v, q.v))))), 6) AS score FROM v q CROSS JOIN v c WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def vector_batch(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    return vector.batch(rows, asked, 5).withColumnRenamed("id", "vec_id")


@register("SELECT count(*) AS queries, 5 * count(*) AS wanted, true AS enough FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 20 = 0")
def vector_cells_recall(spark, sf_dir):
    """How many of the five nearest vectors the cells find, against all vectors; enough: nine in ten."""
    exact = vector_batch(spark, sf_dir).select("query_id", "vec_id")
    found = vector_cells(spark, sf_dir).select("query_id", "vec_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@register()
def vector_cells(spark, sf_dir):
    """The nearest vectors of every vector whose id is divisible by 20, from the cells that each probes."""
    rows = _table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    made = cells.CellIndex.build(rows, shared.fresh(spark, "cells"))
    return made.search(asked, 5).withColumnRenamed("id", "vec_id")


_GRAPH_LIST = f"""{_TRIPLES}, gl AS (SELECT 'q1' AS query_id, source_chunk_id AS id FROM t WHERE object = '/the' GROUP BY source_chunk_id),
gr AS (SELECT query_id, id, 1.0::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY id) AS INTEGER) AS rank FROM gl QUALIFY rank <= 20)"""


@register(f"""WITH {_BOTH_SQL}, {_GRAPH_LIST}, u AS (SELECT *, 'v' AS l FROM a UNION ALL SELECT *, 'b' AS l FROM b UNION ALL SELECT *, 'g' AS l FROM gr),
g AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, CAST(coalesce(min(rank) FILTER (l = 'v'), 0) AS INTEGER) AS vector_rank, CAST(coalesce(min(rank) FILTER (l = 'b'), 0) AS INTEGER) AS bm25_rank, CAST(coalesce(min(rank) FILTER (l = 'g'), 0) AS INTEGER) AS graph_rank FROM u GROUP BY ALL)
SELECT query_id, id AS doc_id, score, vector_rank, bm25_rank, graph_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM g QUALIFY rank <= 10""")
def multi_three_lists(spark, sf_dir):
    near, words = _both(spark, sf_dir)
    own = _links(spark, sf_dir).where("object = '/the'").select(F.lit("q1").alias("query_id"), F.col("source_chunk_id").alias("id")).distinct().withColumn("score", F.lit(1.0))
    lists = {"vector": near, "bm25": words, "graph": bm25.ranked(own, 20)}
    return fusion.reciprocal_ranks(lists, 10).fillna(0, ["vector_rank", "bm25_rank", "graph_rank"]).withColumnRenamed("id", "doc_id")


@register(f"""WITH r AS ({_rsf_sql(0.5, 10)}) SELECT doc_id, printf('Hybrid match (alpha=0.50): vector %.2f + BM25 %.2f -> fused %.2f', 0.5 * vector_score, 0.5 * bm25_score, score) AS reason FROM r WHERE query_id = 'q1' AND rank = 1""")
def explain_result(spark, sf_dir):
    found = explain.explained(hybrid_rsf(spark, sf_dir).where("query_id = 'q1'"), "hybrid", 0.5)
    return explain.explain_result(found, found.where("rank = 1").first()["doc_id"], "doc_id").select("doc_id", "reason")


@register("""WITH u AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'again ' || coalesce(text, '') ELSE text END AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS chunk_id, sha256(text) AS text_sha256, lang AS language, source FROM u WHERE NOT (lang = 'fr' AND doc_id % 3 <> 0) AND doc_id % 7 <> 0""")
def store_commits(spark, sf_dir):
    """All documents come in; the French go, a third comes in again with other texts, and a seventh goes by id."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "text", F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("source", F.lit("")).alias("source"))
    kept = Store(spark, shared.fresh(spark, "store"))
    kept.initialize()
    kept.upsert_documents(docs)
    kept.delete_by_metadata({"language": "fr"})
    kept.upsert_documents(docs.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("again "), F.coalesce("text", F.lit("")))))
    kept.delete_by_ids(docs.where("doc_id % 7 = 0").select("chunk_id"))
    return kept.chunks().select("chunk_id", F.sha2("text", 256).alias("text_sha256"), "language", "source")


# ---- batches of queries in the fused modes: each benchmark passage with the vector of its number

_BATCH_SQL = f"""{_bm25_sql(20, 'asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)')},
{_vector_sql(20, rows='(SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))', asked='vq AS (SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM benchmark JOIN embeddings ON vec_id = item_id)')},
a AS (SELECT * FROM vranked), b AS (SELECT * FROM ranked)"""


def _batch(spark, sf_dir, mode, **more):
    vectors = _table(spark, sf_dir, "embeddings")
    own = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(own, "query_id", "left")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    return search_batch(asked, mode, 10, depth=20, words=_stored(spark, sf_dir), vectors=vectors.join(docs, "vec_id", "left_semi"), **more)


# with 0.6 and 0.4 no score of one retriever alone ends in half a last digit, which engines round differently
@register(_rsf_sql(0.6, 10).replace(_BOTH_SQL, _BATCH_SQL).replace(repr(1 - 0.6), "0.4"))
def hybrid_batch(spark, sf_dir):
    out = _batch(spark, sf_dir, "hybrid", alpha=0.6)
    return out.select("query_id", F.col("id").alias("doc_id"), F.round("vector_score", 6).alias("vector_score"), F.round("bm25_score", 6).alias("bm25_score"), "score", "rank")


@register(f"""WITH {_BATCH_SQL}, u AS (SELECT *, 'v' AS l FROM a UNION ALL SELECT *, 'b' AS l FROM b),
g AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, CAST(coalesce(min(rank) FILTER (l = 'v'), 0) AS INTEGER) AS vector_rank, CAST(coalesce(min(rank) FILTER (l = 'b'), 0) AS INTEGER) AS bm25_rank FROM u GROUP BY query_id, id)
SELECT query_id, id AS doc_id, score, vector_rank, bm25_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM g QUALIFY rank <= 10""")
def multi_batch(spark, sf_dir):
    return _batch(spark, sf_dir, "multi").fillna(0, ["vector_rank", "bm25_rank"]).withColumnRenamed("id", "doc_id")


_NAMED_SQL = f"""{_TRIPLES}, m AS (SELECT page_id AS query_id, CAST(i AS INTEGER) AS n, lower(e) AS part FROM (SELECT page_id, unnest(range(len(w))) AS i, unnest(w) AS e
  FROM (SELECT page_id, regexp_extract_all(url, '[A-Za-z0-9]+') AS w FROM pages)) WHERE e <> ''),
h AS (SELECT DISTINCT part FROM m), f AS (SELECT part, t.*, row_number() OVER (PARTITION BY part ORDER BY source_chunk_id, subject, predicate, object) AS nth
  FROM h JOIN t ON contains(lower(subject), part) OR contains(lower(object), part) QUALIFY nth <= 5),
o AS (SELECT query_id, n, f.*, row_number() OVER (PARTITION BY query_id, source_chunk_id ORDER BY n, nth) AS one FROM m JOIN f USING (part) QUALIFY one = 1)
SELECT query_id, part AS entity, source_chunk_id, subject || ' -> ' || predicate || ' -> ' || object AS path, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n, nth) AS INTEGER) AS rank FROM o QUALIFY rank <= 5"""


@register(f"WITH {_NAMED_SQL}")
def graph_batch(spark, sf_dir):
    """For every page, the first links whose ends contain one of the words of its own address."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), F.posexplode(F.regexp_extract_all("url", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("n", "entity"))
    out = graph.entity_batch(_links(spark, sf_dir), pages, 5)
    return out.select("query_id", F.lower("entity").alias("entity"), "source_chunk_id", "path", "rank")


@register()
def token_counts(spark, sf_dir):
    """Tokens of every document in a public byte-level vocabulary."""
    import public_tokenizers as public

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.token_counts(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN).drop("text")
