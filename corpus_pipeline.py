"""A training corpus from ``documents``: clean, distinct, free of secrets, mixed and tokenised.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes every stage's rows to the
shared folder and reads them again, as each stage reads its input several times.

The result has one row for each time the mix takes a document, with its token
ids. No stage is limited to a part of its input. Stages of statistical fits and
tilts are not expressible in SQL; tests/llm hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.llm import common, op1_entropy_mix, op7_anchor_simhash, op8_blob_ledger, op9_weak_toxicity, op10_piece_codec, similar_sets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier calls toxic."""
    model = op9_weak_toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return op9_weak_toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word shingles are alike to 0.8 or more.

    Candidates come from op7's anchors over SimHash fingerprints; whole sets of shingles
    decide, and an exact join adds the pairs whose fingerprints lie further apart.
    """
    return op7_anchor_simhash.keep_one(docs, find=similar_sets.near_duplicates).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; all documents stay."""
    clean = op8_blob_ledger.redact(docs.withColumn("__old", F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col("__old"))
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mix of its source asks for."""
    mixed = op1_entropy_mix.mix(docs, op1_entropy_mix.word_count(F.col("text")))
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    return op10_piece_codec.transcode(docs.select("doc_id", "lang", "source", "text"), outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("encoding", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    root = common.fresh_dir(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{i}-{name}")
            docs = spark.read.schema(docs.schema).parquet(f"{root}/{i}-{name}")
            if i:  # the stage's own input is needed no more
                common.remove(spark, f"{root}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
