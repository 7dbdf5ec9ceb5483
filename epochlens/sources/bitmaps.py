"""Packed dirty bitmaps: bit i, most significant first, marks block i."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.sources.mutations import EPOCH_IN_NAME

CHUNK = 8192


def expand_bits(bitmaps: DataFrame) -> DataFrame:
    """(epoch, id) of every set bit of (epoch, content) rows. Bitmaps are cut into chunks that are
    spread over the cluster before they are expanded; empty chunks end there."""
    n = F.length("content")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(CHUNK)))
    chunks = bitmaps.select("epoch", "content", F.explode(starts).alias("at")).select(
        "epoch", F.col("at").cast("bigint").alias("at"),
        F.col("content").substr(F.col("at") + 1, F.lit(CHUNK)).alias("part"),
    )
    busy = chunks.filter(F.hex("part").rlike("[1-9A-F]")).repartition("epoch", "at")

    def bits(batches):
        for b in batches:
            epoch, ids = [], []
            for e, at, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                hit = np.flatnonzero(np.unpackbits(np.frombuffer(part, np.uint8))) + at * 8
                ids.append(hit)
                epoch.append(np.full(hit.size, e, np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(epoch)), pa.array(np.concatenate(ids), pa.int64())], ["epoch", "id"]
                )

    return busy.mapInArrow(bits, "epoch int, id bigint")


def read_bitmaps(spark: SparkSession, root: str, start_epoch: int, end_epoch: int) -> DataFrame:
    """Set bits of ``bitmap_<e>.bin`` files in an inclusive epoch window; missing epochs are skipped."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "bitmap_*.bin").load(root)
        .select(F.regexp_extract("path", EPOCH_IN_NAME, 1).try_cast("int").alias("epoch"), "content")
        .filter(F.col("epoch").between(start_epoch, end_epoch))
    )
    return expand_bits(files)
