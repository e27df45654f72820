"""BM25 keyword search over a postings table, for batches of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomry.functions import text as tx

K1, B = 1.5, 0.75
#: Queries of a batch up to which one number for each is broadcast.
SENT = 100_000


@dataclass
class Index:
    """postings (term, id, tf, dl, df): one row per term and document, with the document's length and the term's documents; totals: one row (n, avgdl)."""

    postings: DataFrame
    totals: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, key: str = "doc_id", text: str = "text", spread: int | None = None) -> Index:
        """Counts are taken before any exchange; documents without tokens count towards the mean length.

        spread: deals the texts to so many tasks first, for a table in one piece
        that a single task would read; leave it out for tables in many files.
        """
        rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
        words = (rows.repartition(spread) if spread else rows).select("id", tx.tokens(F.col("text")).alias("w"))
        sized = words.withColumn("dl", F.size("w"))
        totals = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        postings = sized.select("id", "dl", F.explode("w").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
        # counted before the exchange; the join back can be split where a term is common
        df = postings.groupBy("term").agg(F.count("*").alias("df"))
        return cls(postings.join(df, "term"), totals)

    def persist(self) -> Index:
        """Keeps the postings with the executors, for several searches of one session."""
        return Index(self.postings.persist(StorageLevel.MEMORY_AND_DISK), self.totals.persist(StorageLevel.MEMORY_AND_DISK))

    def save(self, path: str) -> None:
        """Sorted by term, so a search reads only the row groups of its terms."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def load(cls, spark, path: str) -> Index:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals"))

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, score) of all documents that share a term with a query. ``queries``: query_id, query.

        Whether the batch's terms are sent to every task is left to their size.
        """
        asked = queries.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("query")))).alias("term"))
        # one row
        rows = self.postings.join(asked, "term").crossJoin(F.broadcast(self.totals))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        gain = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        return rows.groupBy("query_id", "id").agg(F.sum(idf * gain).alias("score"))

    def search(self, queries: DataFrame, k: int = 5, keep: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score, rank): scores as shares of each query's best. ``keep``: ids that may be found."""
        few = queries.limit(SENT + 1).count() <= SENT
        found = self.scores(queries)
        if keep is not None:
            found = found.join(keep, "id", "left_semi")
        return ranked(normalized(found, few), k)


def normalized(found: DataFrame, few: bool = False) -> DataFrame:
    """Scores divided by the query's best; queries whose best is not above 0 score 0.

    The best is aggregated before its exchange and joined back. few: there are
    at most SENT queries; their bests are sent to every task, and a query's hits
    stay where they are until their ranks are limited.
    """
    best = found.groupBy("query_id").agg(F.max("score").alias("best"))
    best = F.broadcast(best) if few else best
    return found.join(best, "query_id").withColumn("score", F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0)).drop("best")


def ranked(found: DataFrame, k: int | Column, digits: int = 6) -> DataFrame:
    """The k best of every query by rounded score, ties to the smaller id; limited per task before the exchange."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rounded = found.withColumn("score", F.round("score", digits))
    return rounded.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def matched_terms(query: Column, text: Column) -> Column:
    """Query tokens that the text has, in the query's order, each once."""
    return F.array_intersect(F.array_distinct(tx.tokens(query)), tx.tokens(text))
