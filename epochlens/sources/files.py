"""Files as rows."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.functions.paths import nt_path

_BATCH_BYTES = 32 * 1024 * 1024


def local_name(path):
    """Plain path of a ``file:`` URI; other schemes stay as they are."""
    return F.regexp_replace(path, "^file:(//)?", "")


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(file_path, content, file_size) of a file or a directory."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select(
        local_name(F.col("path")).alias("file_path"), "content", F.col("length").alias("file_size")
    )


def mounted_files(paths: DataFrame, mount_root: str) -> DataFrame:
    """(file_path, content) of the given device paths under a mount that every executor sees. Only
    the listed files are opened; unreadable ones are left out."""
    wanted = paths.select("file_path").distinct().select(
        "file_path", F.concat(F.lit(mount_root.rstrip("/")), nt_path(F.col("file_path"))).alias("real")
    )

    def load(batches):
        schema = pa.schema([("file_path", pa.string()), ("content", pa.binary())])
        for batch in batches:
            names, data, size = [], [], 0
            for name, real in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with open(real, "rb") as fh:
                        body = fh.read()
                except OSError:
                    continue
                names.append(name)
                data.append(body)
                size += len(body)
                if size > _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(data, pa.binary())], schema=schema)
                    names, data, size = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(data, pa.binary())], schema=schema)

    return wanted.mapInArrow(load, "file_path string, content binary")


def require_path(path: str) -> str:
    if "://" not in path and not os.path.exists(path):
        raise ValueError(f"no such file or directory: {path}")
    return path
