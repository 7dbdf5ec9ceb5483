"""Block versions: dirty sets, as-of lookups and the changed-block filter.

Input tables: mutations ``(id, block BINARY, epoch)`` with one row per (id, epoch), and dirty bits
``(epoch, id)``. Versions are resolved in two phases. The first aggregates (id, epoch) alone, by hash and with map-side
combine, so one block rewritten in every epoch does not concentrate its versions in a task. The second fetches
the payload of the versions that won by an equi-join on (id, epoch): no payload is sorted or moved to find out
that it is out of date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochlens.functions.bytestats import zero_block
from epochlens.functions.ints import floor_div
from epochlens.session import cut_lineage

# Versions of sixteen bytes: about 100 MB as a hashed relation.
FETCH_BROADCAST = 2_000_000


def extent_id(block_id: Column, blocks_per_extent: int = 8) -> Column:
    return floor_div(block_id, blocks_per_extent)


def dirty_ids(bits: DataFrame, start_epoch: int, end_epoch: int) -> DataFrame:
    """Union of the dirty bitmaps of an inclusive epoch window."""
    return bits.filter(F.col("epoch").between(start_epoch, end_epoch)).select("id").distinct()


def only_dirty(mutations: DataFrame, dirty: DataFrame) -> DataFrame:
    return mutations.join(dirty, "id", "left_semi")


def fetch(mutations: DataFrame, wanted: DataFrame, value: str = "block") -> DataFrame:
    """The rows (id, ``value``, epoch, ...) of the stated versions (id, epoch, ...). ``wanted`` is slim; it is
    materialised and counted, broadcast where it is small, and otherwise the hashed side of a shuffle join, so that
    the payload is not sorted."""
    wanted = cut_lineage(wanted)
    small = wanted.limit(FETCH_BROADCAST + 1).count() <= FETCH_BROADCAST
    side = F.broadcast(wanted) if small else wanted.hint("shuffle_hash")
    return mutations.select("id", value, "epoch").join(side, ["id", "epoch"])


def _hashed(mutations: DataFrame, value: str) -> bool:
    """Whether the value fits into the buffer of a hash aggregation."""
    return not isinstance(mutations.schema[value].dataType, (T.BinaryType, T.StringType, T.ArrayType, T.MapType, T.StructType))


def _latest(versions: DataFrame, value: str) -> DataFrame:
    if _hashed(versions, value):
        return versions.groupBy("id").agg(F.max_by(value, "epoch").alias(value), F.max("epoch").alias("epoch"))
    newest = versions.groupBy("id").agg(F.max("epoch").alias("epoch"))
    return fetch(versions, newest, value).select("id", value, "epoch")


def latest_before(mutations: DataFrame, epoch: int, value: str = "block") -> DataFrame:
    """Last version strictly before ``epoch``."""
    return _latest(mutations.filter(F.col("epoch") < epoch), value)


def latest_at(mutations: DataFrame, epoch: int, value: str = "block") -> DataFrame:
    """Last version at or before ``epoch``."""
    return _latest(mutations.filter(F.col("epoch") <= epoch), value)


def version_pairs(
    mutations: DataFrame, start_epoch: int, end_epoch: int, value: str = "block",
    missing: Column | None = None, dirty: DataFrame | None = None,
) -> DataFrame:
    """(id, old, new) for every block known at ``end_epoch`` (and in ``dirty``, if given): the state before
    ``start_epoch`` and the state at ``end_epoch``."""
    earlier = F.col("epoch") < start_epoch
    known = mutations.filter(F.col("epoch") <= end_epoch)
    if _hashed(mutations, value):
        scoped = known if dirty is None else only_dirty(known, dirty)
        old = F.max_by(F.when(earlier, F.col(value)), F.when(earlier, F.col("epoch")))
        pairs = scoped.groupBy("id").agg(old.alias("old"), F.max_by(value, "epoch").alias("new"))
    else:
        slim = known.select("id", "epoch")
        slim = slim if dirty is None else only_dirty(slim, dirty)
        states = slim.groupBy("id").agg(F.max(F.when(earlier, F.col("epoch"))).alias("before"), F.max("epoch").alias("last"))
        # One row for each version that is a state of its block: one, where nothing came in between.
        both = states.select("id", "last", F.explode(F.array_distinct(F.array("before", "last"))).alias("epoch")).filter(
            F.col("epoch").isNotNull())
        rows = fetch(known, both, value)
        older = F.lag(value).over(Window.partitionBy("id").orderBy("epoch"))  # at most two rows a block
        rows = rows.select("id", F.col(value).alias("new"), "epoch", "last", older.alias("_o"))
        unchanged = F.col("epoch") < start_epoch  # the newest version is the state before, too
        pairs = rows.filter(F.col("epoch") == F.col("last")).select(
            "id", F.when(unchanged, F.col("new")).otherwise(F.col("_o")).alias("old"), "new")
    return pairs if missing is None else pairs.withColumn("old", F.coalesce("old", missing))


def changed_blocks(
    mutations: DataFrame, dirty: DataFrame, start_epoch: int, end_epoch: int, *,
    block_size: int = 512, blocks_per_extent: int = 8,
) -> DataFrame:
    """Blocks whose content differs between the two states: (extent_id, block_id, old, new).
    Comparing before the hand-over to Python keeps unchanged blocks inside the JVM."""
    pairs = version_pairs(mutations, start_epoch, end_epoch, "block", zero_block(block_size), dirty)
    return pairs.filter(F.col("old") != F.col("new")).select(
        extent_id(F.col("id"), blocks_per_extent).alias("extent_id"),
        F.col("id").alias("block_id"), "old", "new",
    )


def changed_in_place(
    mutations: DataFrame, bits: DataFrame, start_epoch: int, end_epoch: int, *, block_size: int = 512,
) -> DataFrame:
    """:func:`changed_blocks` on tables that are bucketed by ``extent_id`` (and carry it): join,
    aggregation and the later grouping by extent all happen inside a bucket, without a shuffle."""
    dirty = bits.filter(F.col("epoch").between(start_epoch, end_epoch)).select("extent_id", "id")
    scoped = mutations.filter(F.col("epoch") <= end_epoch).join(dirty, ["extent_id", "id"], "left_semi")
    earlier = F.col("epoch") < start_epoch
    old = F.max_by(F.when(earlier, F.col("block")), F.when(earlier, F.col("epoch")))
    pairs = scoped.groupBy("extent_id", "id").agg(
        F.coalesce(old, zero_block(block_size)).alias("old"), F.max_by("block", "epoch").alias("new")
    )
    return pairs.filter(F.col("old") != F.col("new")).select(
        "extent_id", F.col("id").alias("block_id"), "old", "new"
    )


def restorable_blocks(mutations: DataFrame, bits: DataFrame, end_epoch: int) -> DataFrame:
    """Image content as of ``end_epoch``: the newest version that is both flagged dirty in its
    epoch's bitmap and present in the table."""
    flagged = bits.filter(F.col("epoch") <= end_epoch).select("id", "epoch").distinct()
    present = mutations.select("id", "epoch").join(flagged, ["id", "epoch"], "left_semi")
    newest = present.groupBy("id").agg(F.max("epoch").alias("epoch"))
    return fetch(mutations, newest).select("id", "block", "epoch")


def block_history(mutations: DataFrame, block_id: int) -> DataFrame:
    """All versions of one block in epoch order."""
    return mutations.filter(F.col("id") == block_id).orderBy("epoch")


def epoch_fetch(bits: DataFrame, store: DataFrame, epoch: int) -> tuple[DataFrame, DataFrame]:
    """(found, missing) blocks of one epoch: bitmap bits looked up in the block store."""
    wanted = bits.filter(F.col("epoch") == epoch).select("epoch", "id").distinct()
    have = store.filter(F.col("epoch") == epoch)
    found = wanted.join(have, ["epoch", "id"])
    missing = wanted.join(have, ["epoch", "id"], "left_anti")
    return found, missing
