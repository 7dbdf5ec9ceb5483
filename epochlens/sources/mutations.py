"""Mutation tables: per-epoch files or an epoch-partitioned layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens import schemas

EPOCH_IN_NAME = r"(?:mutation|bitmap)_(\d+)\.(?:parquet|bin)"


def bytes_of(block: Column) -> Column:
    """BINARY from an array of byte values."""
    return F.unhex(F.array_join(F.transform(block, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def epoch_files(spark: SparkSession, root: str, end_epoch: int) -> list[str]:
    """``mutation_<e>.parquet`` files or directories up to ``end_epoch``, from the listing alone:
    one short row per epoch."""
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
        .load(root).select(F.regexp_extract("path", rf"^(.*/{EPOCH_IN_NAME})(?:/|$)", 1).alias("path"))
        .select("path", F.regexp_extract("path", EPOCH_IN_NAME, 1).try_cast("int").alias("epoch"))
        .filter(F.col("epoch") <= end_epoch).distinct()
    )
    return [r["path"] for r in listed.orderBy("epoch").collect()]


def read_mutation_files(spark: SparkSession, root: str, end_epoch: int) -> DataFrame:
    """``mutation_<e>.parquet`` files; epochs after ``end_epoch`` are not opened."""
    found = epoch_files(spark, root, end_epoch)
    if not found:
        return spark.createDataFrame([], schemas.MUTATION)
    df = spark.read.schema(schemas.MUTATION_FILE).parquet(*found)
    return df.select(
        "id", bytes_of(F.col("block")).alias("block"),
        F.regexp_extract("_metadata.file_path", EPOCH_IN_NAME, 1).try_cast("int").alias("epoch"),
    )


def read_mutation_table(spark: SparkSession, root: str, end_epoch: int) -> DataFrame:
    """The ``epoch=<e>/`` layout with BINARY blocks; the filter prunes partitions."""
    return spark.read.parquet(root).filter(F.col("epoch") <= end_epoch).select("id", "block", "epoch")


def assert_epochs(mutations: DataFrame) -> DataFrame:
    if not mutations.filter(F.col("epoch").isNull()).isEmpty():
        raise ValueError("mutation rows without an epoch")
    return mutations


def latest_epoch(mutations: DataFrame) -> int:
    """Highest epoch, or -1 when there is none."""
    top = mutations.agg(F.max("epoch")).first()[0]
    return -1 if top is None else top
