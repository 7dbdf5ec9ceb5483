"""Epoch arrival as a file stream: new mutation files are added to a table as they show up. The stream's own checkpoint
takes the place of the skip-if-present test. Every micro-batch is a partition of its own, so no epoch is rewritten and a
replayed batch replaces only itself; ``read_arrived`` lets the newest batch win where a block came twice."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from epochlens import schemas
from epochlens.session import cut_lineage
from epochlens.sinks.device import write_mutation_table
from epochlens.sources.mutations import EPOCH_IN_NAME, bytes_of
from epochlens.streaming.versions import append_batch, current


def arriving_mutations(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.readStream.schema(schemas.MUTATION_FILE).option("pathGlobFilter", "*.parquet").option(
        "recursiveFileLookup", True).parquet(root)
    return rows.select(
        "id", bytes_of(F.col("block")).alias("block"),
        F.regexp_extract("_metadata.file_path", EPOCH_IN_NAME, 1).try_cast("int").alias("epoch"),
    )


def merge_epochs(arrived: DataFrame, table: str) -> None:
    """Merge a batch into an ``epoch=<e>/`` table. Parts of one epoch may arrive in several runs, a replayed batch
    adds nothing new, and a block that is sent again replaces the one that was held. The merged rows are written out
    first, as Spark does not overwrite what it still reads."""
    spark = arrived.sparkSession
    try:
        held = spark.read.parquet(table)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        write_mutation_table(arrived.dropDuplicates(["id", "epoch"]), table)
        return
    epochs = arrived.select("epoch").distinct()
    before = held.join(epochs, "epoch", "left_semi").join(arrived.select("id", "epoch"), ["id", "epoch"], "left_anti")
    merged = before.select(*arrived.columns).unionByName(arrived.dropDuplicates(["id", "epoch"]))
    write_mutation_table(cut_lineage(merged), table)


def read_arrived(spark: SparkSession, table: str) -> DataFrame:
    """(id, block, epoch) of a table written by :func:`ingest`, one row for each (id, epoch)."""
    return current(spark.read.parquet(table)).select("id", "block", "epoch")


def ingest(spark: SparkSession, root: str, table: str, checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived and stop."""
    return (
        arriving_mutations(spark, root).writeStream
        .foreachBatch(lambda df, batch: append_batch(df.dropDuplicates(["id", "epoch"]), table, batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
