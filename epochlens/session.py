"""Spark session defaults and lineage helpers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Byte scans are CPU-heavy: keep small shuffles spread over the cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Tables bucketed by extent join on (extent, block) in place.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    # Keyed state with several parts needs a store with column families.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batches are bounded by bytes so that multi-megabyte files cannot build a huge Arrow batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    BATCH_BYTES: str(4 * 1024 * 1024),
}


def build_session(app: str = "epochlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def bound_batches(spark: SparkSession) -> SparkSession:
    """Hold the Arrow batches of a session that sets no size of its own to ours: several Python steps run side by side in
    each core, and each holds a batch of input and of output. Rows and order stay the same."""
    if not spark.sparkContext.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, DEFAULTS[BATCH_BYTES])
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application, so that column functions
    import there wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        base = Path(tempfile.mkdtemp(prefix="epochlens-code-")) / "epochlens"
        sc.addPyFile(shutil.make_archive(str(base), "zip", root.parent, root.name))
        _shipped.add(sc.applicationId)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably. The cluster's ``spark.checkpoint.dir`` is used as configured;
    a folder of our own is set only where none is configured at all (tests, laptops)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="epochlens-ckpt-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores when the scan yields fewer partitions than there are. Inputs
    with enough splits, which is every large one, pass through without a shuffle."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
