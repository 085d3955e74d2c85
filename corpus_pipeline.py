"""Corpus pipeline: five stages, each written and read again as the next one's documents.

``run(spark, sf_dir)`` applies STAGES to the documents table. The last stage adds ``copy`` (1, 2), a row
per copy that the mixture takes; the others return the columns of documents. SQL cannot express the
learned and random stages, so ORACLE_SQL is None and tests hold each stage against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outage_spark.llm import decontamination, jaccard_join, mixture, personal_data, toxicity
from outage_spark.llm.text import store, table, word_count
from outage_spark.operators.spread import checkpoint_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REJECT_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on these documents' labels, scores below REJECT_FROM."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rest = [c for c in COLUMNS if c != "text"]
    scored = toxicity.with_evidence(docs.select(*COLUMNS, F.col("text").alias("_body")), model.lexicon, "_body", "_evidence")
    return scored.where(model.score("_evidence") < REJECT_FROM).select("doc_id", "text", *rest[1:])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts: shingles of five words, similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs.select(*COLUMNS), percent=80, shingle=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = personal_data.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mixture takes of a document, numbered by ``copy``."""
    rows = docs.select(*COLUMNS, word_count("text").alias("_words"), F.xxhash64("text").alias("_key"))
    targets = mixture.source_targets(store(rows.select("source", "_words")), "_words", "source")
    mixed = mixture.mix(rows, targets, "_words", "source", ["doc_id", "_key"])
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return mixed.where(F.col("copies") > 0).select(*COLUMNS, copies.alias("copy"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("mixture", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
