"""A training corpus out of raw documents, in five stages, each on all that its predecessor kept."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession

from epochlens.llm import exact_dedup, near_dedup, packing, pii, toxicity
from epochlens.llm.common import shared_folder, table
from epochlens.llm.queries import PSEUDONYM_KEY, held_out, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Texts make wide rows: batches of Spark's default length are tens of megabytes each, in the executor and in its workers.
BATCH_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": 1024, "spark.sql.execution.arrow.maxRecordsPerBatch": 1024}


def narrow_batches(spark: SparkSession) -> None:
    """Lower the session's batch lengths; what is lower already stays."""
    for name, rows in BATCH_ROWS.items():
        if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
            spark.conf.set(name, rows)


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out())
    return toxicity.reject(docs, model).select(*COLUMNS)


def exact_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.keep_one(docs).select(*COLUMNS)


def near_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near duplicates the document with the largest id."""
    return near_dedup.keep_one(docs).select(*COLUMNS)


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced. Values keep their format; only an address or a date may change its length."""
    from pyspark.sql import functions as F

    return pii.pseudonymise(docs, PSEUDONYM_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as can be."""
    return packing.pack(docs, vocabulary())


def staged(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        narrow_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, staged(stage)) for name, stage in (
    ("toxicity", clean_of_toxicity), ("exact_dedup", exact_once), ("near_dedup", near_once), ("pii", pseudonymous), ("packing", packed))]

ORACLE_SQL = None  # learned scores, signatures and a packing search are not SQL; tests hold brute-force versions

_runs = itertools.count()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{spark.sparkContext.applicationId}-{next(_runs)}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
