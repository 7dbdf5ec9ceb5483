"""Materialise epochs from a store, and rebuild device images."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from epochlens.operators.versions import restorable_blocks
from epochlens.sinks.device import write_bitmap, write_image, write_mutation_file
from epochlens.sources.bitmaps import read_bitmaps
from epochlens.sources.epochstore import read_store
from epochlens.sources.mutations import read_mutation_files


def missing_epochs(root: str, end_epoch: int, force: bool = False) -> list[int]:
    """Epochs lacking either of their two outputs; all of them when forced."""
    have = lambda e: os.path.exists(os.path.join(root, f"mutation_{e}.parquet")) and os.path.exists(
        os.path.join(root, f"bitmap_{e}.bin"))
    return [e for e in range(1, end_epoch + 1) if force or not have(e)]


def materialize(
    spark: SparkSession, client: str, root: str, end_epoch: int, n_blocks: int, force: bool = False, **options,
) -> list[int]:
    """Write the missing epochs; one job per output, each epoch read by its own task."""
    todo = missing_epochs(root, end_epoch, force)
    for epoch in todo:
        rows = read_store(spark, client, epoch, epoch, **options)
        # A flagged block whose item is missing keeps its bit but has no mutation row.
        write_mutation_file(rows.filter(F.col("block").isNotNull()), root, epoch)
        write_bitmap(rows.select("epoch", "id"), root, epoch, n_blocks)
    return todo


def restore(
    spark: SparkSession, root: str, end_epoch: int, size: int, *, block_size: int = 512,
    overwrite: bool = True, timestamped: bool = False,
) -> str:
    """Image as of ``end_epoch``. The timestamped form never replaces a file."""
    lost = missing_epochs(root, end_epoch)
    if lost:
        raise FileNotFoundError(f"epochs without both outputs: {lost}")
    name = f"device_{end_epoch}.img"
    if timestamped:
        name, overwrite = f"device_{end_epoch}_{datetime.now():%Y%m%dT%H%M%S}.img", False
    blocks = restorable_blocks(
        read_mutation_files(spark, root, end_epoch), read_bitmaps(spark, root, 1, end_epoch), end_epoch
    )
    return write_image(blocks, os.path.join(root, name), size, block_size, overwrite)


def preprocess(
    spark: SparkSession, client: str, root: str, end_epoch: int, size: int, *, block_size: int = 512,
    skip_restore: bool = False, force: bool = False, **options,
) -> dict:
    os.makedirs(root, exist_ok=True)
    done = materialize(spark, client, root, end_epoch, size // block_size, force, **options)
    image = None if skip_restore else restore(spark, root, end_epoch, size, block_size=block_size)
    return {"created": done, "skipped": end_epoch - len(done), "image": image}


