"""Block versions as a stream: every block's versions are keyed state, epochs may arrive in any order.

Each arriving version is compared with the version before it and gives one row of a change log. A late version
also changes what its successor is compared with, so that row is sent again as revised. The log is append-only:
a micro-batch writes its own partition (and overwrites only that one when it is replayed), and of several rows of
one (id, epoch) the newest batch counts. State of a block is its list of epochs and one entry per version, of which
a late arrival reads only its two neighbours.

The state store has to be one with column families: ``build_session`` sets Spark's RocksDB provider.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from epochlens.functions.bytestats import zero_block
from epochlens.operators.versions import extent_id, fetch

CHANGE = "id bigint, epoch int, before int, old binary, new binary, revised boolean"


class VersionState(StatefulProcessor):
    def init(self, handle) -> None:
        self.epochs = handle.getValueState("epochs", "epochs array<int>")
        self.blocks = handle.getMapState("blocks", "epoch int", "block binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = list(self.epochs.get()[0]) if self.epochs.exists() else []
        newest = known[-1] if known else None
        arrived: dict[int, bytes] = {}
        for row in rows:  # of two contents for one epoch in one batch the larger counts, whatever their order
            arrived[row.epoch] = max(bytes(row.block), arrived.get(row.epoch, b""))
        touched: set[int] = set()
        for epoch, block in arrived.items():
            if self.blocks.containsKey((epoch,)):
                if bytes(self.blocks.getValue((epoch,))[0]) == block:
                    continue
            else:
                bisect.insort(known, epoch)
            self.blocks.updateValue((epoch,), (block,))
            touched.add(epoch)
        if not touched:
            return
        self.epochs.update((known,))
        for epoch in list(touched):
            touched.update(known[bisect.bisect_right(known, epoch):][:1])
        for epoch in sorted(touched):
            at = bisect.bisect_left(known, epoch)
            before = known[at - 1] if at else None
            yield Row(id=key[0], epoch=epoch, before=before,
                      old=None if before is None else bytes(self.blocks.getValue((before,))[0]),
                      new=bytes(self.blocks.getValue((epoch,))[0]), revised=newest is not None and epoch <= newest)

    def close(self) -> None:
        pass


def version_changes(arrivals: DataFrame) -> DataFrame:
    """Change log rows of a stream of (id, block, epoch)."""
    return arrivals.groupBy("id").transformWithState(
        VersionState(), outputStructType=CHANGE, outputMode="Update", timeMode="None")


def append_batch(rows: DataFrame, log: str, batch: int) -> None:
    """Write one micro-batch beside the others. Rows are clustered by epoch, so epochs prune files."""
    (rows.withColumn("batch", F.lit(batch)).sortWithinPartitions("epoch", "id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(log))


def follow(arrivals: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Bring the change log up to date with everything that has arrived, and stop."""
    return (version_changes(arrivals).writeStream.outputMode("update")
            .foreachBatch(lambda rows, batch: append_batch(rows, log, batch))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current(log: DataFrame) -> DataFrame:
    """The newest row of each (id, epoch), found on the slim columns first."""
    newest = log.groupBy("id", "epoch").agg(F.max("batch").alias("batch"))
    return log.join(newest, ["id", "epoch", "batch"], "left_semi")


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """All change log rows, with their batch; none where nothing was written yet."""
    try:
        return spark.read.parquet(log)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CHANGE + ", batch int")


def window_changes(
    log: DataFrame, start_epoch: int, end_epoch: int, *, block_size: int = 512, blocks_per_extent: int = 8,
) -> DataFrame:
    """Blocks whose content differs between the state before ``start_epoch`` and at ``end_epoch``, as
    ``changed_blocks`` gives them, out of the window's own rows of the log: the first one holds the state
    before the window, the last one the state at its end."""
    rows = current(log.filter(F.col("epoch").between(start_epoch, end_epoch))).select("id", "epoch", "old", "new")
    edges = rows.groupBy("id").agg(F.min("epoch").alias("first"), F.max("epoch").alias("epoch"))
    last = fetch(rows, edges, "new").select("id", "first", "new")
    pairs = fetch(rows, last.select("id", F.col("first").alias("epoch"), "new"), "old")
    pairs = pairs.withColumn("old", F.coalesce("old", zero_block(block_size)))
    return pairs.filter(F.col("old") != F.col("new")).select(
        extent_id(F.col("id"), blocks_per_extent).alias("extent_id"), F.col("id").alias("block_id"), "old", "new")


def affected_windows(changes: DataFrame, windows: DataFrame) -> DataFrame:
    """The (start_epoch, end_epoch) whose answer a batch of change log rows may alter: the batch's epochs are few."""
    epochs = changes.select("epoch").distinct()
    hit = F.col("epoch").between(F.col("start_epoch"), F.col("end_epoch"))
    return windows.join(epochs, hit, "left_semi")
