"""Per-epoch tables, packed bitmaps and raw device images on a file system all executors share."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlens.functions.ints import floor_div

BITMAP_CHUNK = 65536


def _blank(path: str, size: int) -> None:
    with open(path, "wb") as fh:
        fh.truncate(size)


def write_mutation_table(mutations: DataFrame, root: str) -> None:
    """``epoch=<e>/`` layout; only the epochs present are replaced. Rows are clustered by epoch and
    block range, so one busy epoch still spreads over many files."""
    spread = mutations.repartition("epoch", floor_div(F.col("id"), 1 << 20))
    (spread.sortWithinPartitions("epoch", "id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(root))


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, blocks_per_extent: int = 8) -> None:
    """Catalog table of mutations or dirty bits, bucketed and sorted by extent."""
    keyed = df.withColumn("extent_id", floor_div(F.col("id"), blocks_per_extent))
    (keyed.repartition(buckets, "extent_id").write.mode("overwrite").option("path", path)
     .bucketBy(buckets, "extent_id").sortBy("extent_id", "id").saveAsTable(name))


def write_mutation_file(mutations: DataFrame, root: str, epoch: int) -> str:
    """``mutation_<epoch>.parquet`` (a directory of part files), written even when empty."""
    out = os.path.join(root, f"mutation_{epoch}.parquet")
    as_list = F.transform(
        F.regexp_extract_all(F.hex("block"), F.lit("(..)"), F.lit(1)),
        lambda h: F.conv(h, 16, 10).cast("bigint"),
    )
    mutations.filter(F.col("epoch") == epoch).select(
        "id", as_list.alias("block"), F.lit(epoch).cast("bigint").alias("epoch")
    ).write.mode("overwrite").parquet(out)
    return out


def write_bitmap(bits: DataFrame, root: str, epoch: int, n_blocks: int) -> str:
    """``bitmap_<epoch>.bin``: tasks write disjoint byte ranges of one file that was sized first.
    A chunk covers a fixed number of blocks, which bounds every group."""
    path = os.path.join(root, f"bitmap_{epoch}.bin")
    _blank(path, (n_blocks + 7) // 8)
    chunks = bits.filter(F.col("epoch") == epoch).groupBy(
        floor_div(F.col("id"), BITMAP_CHUNK).alias("chunk")
    ).agg(F.collect_set(F.pmod("id", F.lit(BITMAP_CHUNK)).cast("int")).alias("ids"))

    def put(rows):
        with open(path, "r+b") as fh:
            for row in rows:
                flags = np.zeros(min(BITMAP_CHUNK, n_blocks - row["chunk"] * BITMAP_CHUNK), np.uint8)
                flags[row["ids"]] = 1
                fh.seek(row["chunk"] * BITMAP_CHUNK // 8)
                fh.write(np.packbits(flags).tobytes())

    chunks.foreachPartition(put)
    return path


def write_image(blocks: DataFrame, path: str, size: int, block_size: int = 512, overwrite: bool = True) -> str:
    """Raw image of (id, block) rows. Tasks hold contiguous block ranges and join neighbouring
    blocks into single writes; repeating a task writes the same bytes again."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    _blank(path, size)

    def put(rows):
        with open(path, "r+b") as fh:
            after = -1
            for row in rows:
                at = row["id"] * block_size
                if at != after:
                    fh.seek(at)
                fh.write(row["block"])
                after = at + len(row["block"])

    blocks.select("id", "block").repartitionByRange("id").sortWithinPartitions("id").foreachPartition(put)
    return path
