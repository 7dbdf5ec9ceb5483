"""Audit log, trusted manifest and result tables."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens import schemas
from epochlens.operators.evaluate import truthy
from epochlens.operators.islands import block_range
from epochlens.operators.trust import lower_columns

# Column names, in order of preference.
BLOCK_COLUMNS = ["block_id", "blockid", "block", "id"]
PATH_COLUMNS = ["file_path", "filepath", "path"]
OFFSET_COLUMNS = ["byte_offsets", "byteoffsets", "offsets", "byte_ranges", "byteranges"]


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON audit rows; malformed lines keep their text in ``_corrupt_record``."""
    return (
        spark.read.schema(schemas.AUDIT).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    )


def audit_offsets(audit: DataFrame, block_size: int = 512) -> DataFrame:
    """Distinct block-aligned (file_path, offset_bytes) touched by file chunks. Chunks are
    half-open; empty ones touch nothing."""
    chunks = audit.filter(
        (F.col("type") == "file_chunk") & F.col("actual.start").isNotNull() & F.col("actual.end").isNotNull()
    )
    ids = chunks.select(
        F.coalesce("out_target", "path").alias("file_path"),
        F.explode(block_range(F.col("actual.start"), F.col("actual.end"), block_size)).alias("i"),
    )
    return ids.select("file_path", (F.col("i") * block_size).alias("offset_bytes")).distinct()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Trusted manifest from CSV with a header, or JSON."""
    df = spark.read.option("header", True).csv(path) if path.lower().endswith(".csv") else spark.read.json(path)
    return lower_columns(df)


def read_csv(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    return (
        spark.read.option("header", True).option("ignoreCorruptFiles", True)
        .option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.csv").csv(path)
    )


def pick_column(df: DataFrame, names: list[str]) -> str | None:
    """First column whose lower-case name is in ``names``."""
    return next((c for c in df.columns if c.lower() in names), None)


def block_ids(df: DataFrame, column: str | None = None) -> DataFrame:
    """(block_id) from a result table. Without a known column name the first column holding a
    whole number is used; values that are not numbers are dropped."""
    name = column or pick_column(df, BLOCK_COLUMNS)
    if name is None:
        numeric = df.agg(*[
            F.bool_and(F.col(c).cast("string").rlike(r"^\s*[+-]?\d+\s*$")).alias(c) for c in df.columns
        ]).first()
        name = next((c for c in df.columns if numeric is not None and numeric[c]), None)
    if name is None:
        raise ValueError(f"no block id column among {df.columns}")
    text = F.trim(F.col(name).cast("string"))
    number = F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
    return df.select(number.alias("block_id")).filter("block_id IS NOT NULL").distinct()


def decisions_and_mapping(df: DataFrame, column: str | None = None) -> DataFrame:
    """(block_id, file_path, byte_offsets, ord): flagged blocks with their optional mapping and a
    stable order for rows that repeat a block."""
    ids = column or pick_column(df, BLOCK_COLUMNS)
    path, offsets = pick_column(df, PATH_COLUMNS), pick_column(df, OFFSET_COLUMNS)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    return df.select(
        F.trim(F.col(ids).cast("string")).try_cast("bigint").alias("block_id"),
        text(path).alias("file_path"), text(offsets).alias("byte_offsets"),
        F.struct(text(path).alias("p"), text(offsets).alias("o")).alias("ord"),
    ).filter("block_id IS NOT NULL")


def read_file_decisions(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, keep_file, fileaware_reason); repeated header rows are dropped."""
    df = lower_columns(read_csv(spark, path))
    reason = "fileaware_reason" if "fileaware_reason" in df.columns else "reason"
    return df.filter(F.col("file_path") != "file_path").select(
        F.trim("file_path").alias("file_path"), truthy(F.col("keep_file")).alias("keep_file"),
        F.trim(reason).alias("fileaware_reason"),
    )


def read_inventory(spark: SparkSession, path: str) -> DataFrame | None:
    """The file inventory of an earlier run. One that is missing, empty, not readable or of another shape is none, with a
    warning: a run starts fresh rather than fail on it. Rows are counted once, so that damage behind the footer shows here."""
    try:
        held = spark.read.parquet(path)
        kept = held.select(*schemas.INVENTORY.names)
        for field in schemas.INVENTORY.fields:
            if kept.schema[field.name].dataType != field.dataType:
                raise ValueError(f"{field.name} is {kept.schema[field.name].dataType.simpleString()}")
        kept.write.format("noop").mode("overwrite").save()
        return kept
    except Exception as error:
        warnings.warn(f"inventory {path} is not usable ({type(error).__name__}); starting without one", stacklevel=2)
        return None


def decisions_path(mappings_dir: str) -> str:
    """Directory of file decisions that belongs to a directory of block mappings."""
    root, _, name = mappings_dir.rstrip("/").rpartition("/")
    prefix = "suspicious_block_mappings_"
    if not (name.startswith(prefix) and name.endswith("_csv")):
        raise ValueError(f"not a block mapping directory: {mappings_dir}")
    return f"{root}/fileaware_files_{name[len(prefix):]}"
