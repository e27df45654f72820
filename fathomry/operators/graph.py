"""Lookups in a table of triples: subject, subject_type, predicate, object, object_type, source_chunk_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomry.functions import entities
from fathomry.sources import shared

EDGE = ("subject", "predicate", "object")
#: Length of the pieces of names by which names that contain another meet it.
GRAM = 3


def path(row: str = "") -> Column:
    return F.concat_ws(" -> ", *[F.col(row + c) for c in EDGE])


def entity_search(triples: DataFrame, names: list[str], k: int = 5) -> DataFrame:
    """Triples whose subject or object contains one of at most ten names, any case: the first k of each name, one per chunk (or per path), k in all.

    The names are a stated list, so they are literals and triples are read once.
    """
    each = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(e.lower()).alias("entity")) for i, e in enumerate(names[:10])])
    hits = triples.withColumn("e", F.explode(each)).where(F.contains(F.lower("subject"), F.col("e.entity")) | F.contains(F.lower("object"), F.col("e.entity")))
    order = [F.col("source_chunk_id"), *[F.col(c) for c in EDGE]]
    first = F.row_number().over(Window.partitionBy("e.n").orderBy(*order))
    hits = hits.withColumn("nth", first).where(F.col("nth") <= k).withColumn("n", F.col("e.n"))
    one = F.row_number().over(Window.partitionBy(F.coalesce(F.col("source_chunk_id").cast("string"), path())).orderBy("n", "nth"))
    hits = hits.withColumn("one", one).where("one = 1")
    return hits.orderBy("n", "nth").limit(k).select(*triples.columns, F.col("e.entity").alias("entity"), path().alias("path"), F.lit(1.0).alias("score"))


def _pieces(names: DataFrame, name: str, size: int, piece: str) -> DataFrame:
    """Adds each distinct piece of ``size`` characters of a name; shorter names have none."""
    places = F.sequence(F.lit(1), F.length(name) - size + 1)
    return names.where(F.length(name) >= size).withColumn(piece, F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(name, i, F.lit(size))))))


def containing(names: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, name): which names (name) contain which parts (part), each pair once; both by exact characters, empty and null ones never.

    A join on pieces of three characters: a part meets the names that have its rarest piece, and only these are compared. Parts of
    one or two characters meet names by pieces of their own length.
    """
    names, parts = names.select("name").distinct(), parts.select("part").distinct()
    long, out = parts.where(F.length("part") >= GRAM), []
    asked = _pieces(long, "part", GRAM, "gram")
    held = _pieces(names, "name", GRAM, "gram").join(asked.select("gram").distinct(), "gram", "left_semi")
    often = held.groupBy("gram").agg(F.count("*").alias("often"))
    rarest = asked.join(often, "gram", "left").groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("often", F.lit(0)), "gram")).alias("gram"))
    out.append(held.join(rarest, "gram").where(F.contains("name", "part")).select("part", "name"))
    for size in range(1, GRAM):
        out.append(_pieces(names, "name", size, "part").join(parts.where(F.length("part") == size), "part").select("part", "name"))
    return union_all(out)


def entity_batch(triples: DataFrame, mentions: DataFrame, k: int = 5) -> DataFrame:
    """``entity_search`` for a table of mentions (query_id, n, entity): the first k triples of each name, one per chunk (or path), k a query.

    Names are found once however many queries mention them, and each name's triples are cut to k before they meet the queries.
    n orders a query's names; null and empty names find nothing.
    """
    asked = mentions.select("query_id", "n", "entity", F.lower("entity").alias("part")).where("part <> ''")
    edges = triples.withColumns({"__s": F.lower("subject"), "__o": F.lower("object")})
    names = edges.select(F.explode(F.array("__s", "__o")).alias("name"))
    pairs = containing(names, asked)
    by_subject = edges.join(pairs, edges["__s"] == pairs["name"])
    # a triple that has the name at both ends counts once
    by_object = edges.join(pairs, edges["__o"] == pairs["name"]).where(~F.coalesce(F.contains("__s", "part"), F.lit(False)))
    hits = by_subject.unionByName(by_object).drop("__s", "__o", "name")
    order = [F.col("source_chunk_id"), *[F.col(c) for c in EDGE]]
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order))).where(F.col("nth") <= k)
    hits = asked.join(hits, "part").drop("part")
    place = F.coalesce(F.col("source_chunk_id").cast("string"), path())
    hits = hits.withColumn("one", F.row_number().over(Window.partitionBy("query_id", place).orderBy("n", "nth"))).where("one = 1")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("n", "nth"))).where(F.col("rank") <= k)
    return hits.select("query_id", *triples.columns, "entity", path().alias("path"), F.lit(1.0).alias("score"), "rank")


def by_type(triples: DataFrame, entity_types: list[str] | None = None, relationships: list[str] | None = None) -> DataFrame:
    out = triples
    if entity_types:
        wanted = [entities.normalize_type(t) for t in entity_types]
        out = out.where(entities.normalized_type(F.col("subject_type")).isin(*wanted) | entities.normalized_type(F.col("object_type")).isin(*wanted))
    if relationships:
        out = out.where(F.lower("predicate").isin(*[r.lower() for r in relationships]))
    return out


def search_by_type(triples: DataFrame, names: list[str], entity_types: list[str] | None = None, relationships: list[str] | None = None, k: int = 5) -> DataFrame:
    """``entity_search`` for three times as many rows, of which those of the wanted types and relationships stay, cut to k in their order.

    Types are compared after the cut of the search, so fewer than k rows may stay; ``by_type`` before a search has no such loss.
    """
    found = entity_search(triples, names, 3 * k).withColumn("__at", F.monotonically_increasing_id())
    return by_type(found, entity_types, relationships).orderBy("__at").limit(k).drop("__at")


def entity_record(triples: DataFrame, kind: str, name: str) -> DataFrame:
    """One row: the entity, and its incoming and outgoing neighbours, each edge once; no row if it is unknown."""
    wanted = entities.normalize_type(kind)
    if wanted not in entities.ENTITY_TYPES:
        raise ValueError(f"unknown entity type {kind!r}")
    out = (F.col("subject") == name) & (entities.normalized_type(F.col("subject_type")) == wanted)
    in_ = (F.col("object") == name) & (entities.normalized_type(F.col("object_type")) == wanted)
    near = triples.where(out | in_).select(*EDGE, "subject_type", "object_type", out.alias("out"), in_.alias("in_"))
    # of edges that differ in types alone one counts, so the lists hold distinct neighbours only
    once = near.groupBy(*EDGE).agg(F.min("subject_type").alias("subject_type"), F.min("object_type").alias("object_type"), F.max("out").alias("out"), F.max("in_").alias("in_"))
    outgoing = F.struct(F.col("predicate"), F.col("object").alias("id"), F.col("object_type").alias("type"))
    incoming = F.struct(F.col("predicate"), F.col("subject").alias("id"), F.col("subject_type").alias("type"))
    found = once.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("in_"), incoming))).alias("incoming"), F.sort_array(F.collect_list(F.when(F.col("out"), outgoing))).alias("outgoing"))
    return found.where("n > 0").select(F.lit(wanted).alias("type"), F.lit(name).alias("id"), "incoming", "outgoing")


def counts(triples: DataFrame) -> DataFrame:
    """Distinct entities and relationships, in one pass over both ends of each triple."""
    ends = triples.select(F.explode(F.array("subject", "object")).alias("e")).distinct().agg(F.count("e").alias("entities"))
    return ends.crossJoin(triples.agg(F.count("*").alias("relationships"), F.countDistinct("predicate").alias("predicates")))


def entity_summary(triples: DataFrame) -> DataFrame:
    """Each entity with its first type by name, its number of chunks and its degree."""
    ends = triples.select(F.inline(F.array(F.struct(F.col("subject").alias("name"), F.col("subject_type").alias("type")), F.struct(F.col("object").alias("name"), F.col("object_type").alias("type")))), "source_chunk_id")
    return ends.groupBy("name").agg(F.min("type").alias("entity_type"), F.countDistinct("source_chunk_id").alias("n_chunks"), F.count("*").alias("degree"))


def first_types(triples: DataFrame, order: str = "commit") -> DataFrame:
    """(name, entity_type): the type that an entity had first by ``order``; null types do not count unless there is no other. Ties go to the smaller chunk, then type."""
    ends = triples.select(F.inline(F.array(F.struct(F.col("subject").alias("name"), F.col("subject_type").alias("type")), F.struct(F.col("object").alias("name"), F.col("object_type").alias("type")))), order, "source_chunk_id")
    return ends.groupBy("name").agg(F.min_by("type", F.when(F.col("type").isNotNull(), F.struct(order, "source_chunk_id", "type"))).alias("entity_type"))


def _cut(rows: DataFrame) -> DataFrame:
    """The rows as a table of the shared folder, so that what comes after does not repeat what came before."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared.folder(rows.sparkSession))
    return rows.checkpoint()


def hops(triples: DataFrame, start: list[str], depth: int = 1) -> DataFrame:
    """(name, hop): entities within a number of steps from stated ones, in either direction.

    Each step reads the links once and joins only what the step before found; it ends when a step finds nothing.
    """
    links = triples.select(F.col("subject").alias("a"), F.col("object").alias("b")).distinct()
    both = _cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()) if depth > 0 else None
    seen = triples.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in dict.fromkeys(start)])).alias("name"), F.lit(0).alias("hop"))
    new = seen
    for d in range(1, depth + 1):
        new = _cut(new.select(F.col("name").alias("a")).join(both, "a").select(F.col("b").alias("name")).distinct().join(seen, "name", "left_anti").withColumn("hop", F.lit(d)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def fallback(found: DataFrame, instead: DataFrame) -> DataFrame:
    """The rows of ``found``, or those of ``instead`` for queries that found nothing."""
    missed = instead.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.withColumn("graph_fallback", F.lit(False)).unionByName(missed.withColumn("graph_fallback", F.lit(True)), allowMissingColumns=True)


def context_counts(found: DataFrame) -> DataFrame:
    """One row of numbers about found triples of any number: n_triples, n_entities, n_paths and the mean score, at most 1 (0 without triples)."""
    ends = found.select(F.explode(F.array("subject", "object")).alias("e")).agg(F.countDistinct("e").alias("n_entities"))
    paths = found.agg(F.count("*").alias("n_triples"), F.countDistinct(path()).alias("n_paths"), F.least(F.lit(1.0), F.coalesce(F.avg("score"), F.lit(0.0))).alias("score"))
    return paths.crossJoin(ends).select("n_triples", "n_entities", "n_paths", "score")


def context(found: DataFrame) -> DataFrame:
    """One row about the triples that a search returned (it holds them all): distinct entities, paths and the mean score, at most 1."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("subject", "object")))))
    return found.agg(names.alias("entities"), F.array_sort(F.collect_set(path())).alias("paths"), F.count("*").alias("n_triples"), F.least(F.lit(1.0), F.coalesce(F.avg("score"), F.lit(0.0))).alias("score"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
