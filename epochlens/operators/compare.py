"""Set comparison of keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlens.functions.ints import floor_div
from epochlens.functions.paths import path_key


def membership(sets: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row per key of any set, with a boolean column per set. A tagged union and one
    aggregation: one shuffle for any number of sets, duplicates folded before it."""
    names = list(sets)
    tagged = [
        df.select(*keys, *[F.lit(n == name).alias(n) for n in names])
        for name, df in sets.items()
    ]
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy(*keys)
        .agg(*[F.bool_or(n).alias(n) for n in names])
    )


def compare_sets(left: DataFrame, right: DataFrame, keys: list[str],
                 labels: tuple[str, str, str] = ("match", "left_only", "right_only")) -> DataFrame:
    """(keys, side): which side holds each key."""
    m = membership({"_l": left, "_r": right}, keys)
    side = (
        F.when(F.col("_l") & F.col("_r"), labels[0])
        .when(F.col("_l"), labels[1])
        .otherwise(labels[2])
    )
    return m.select(*keys, side.alias("side"))


def region_blocks(regions: DataFrame) -> DataFrame:
    return regions.select("extent_id", F.explode("block_ids").alias("block_id"))


def audit_device_blocks(
    audit_offsets: DataFrame, block_map: DataFrame, match: str = "basename",
) -> DataFrame:
    """Device blocks named by audit entries: (extent_id, block_id). Both sides are reduced to
    distinct (path key, offset) pairs first."""
    wanted = audit_offsets.select(
        path_key(F.col("file_path"), match).alias("key_path"), "offset_bytes"
    ).distinct()
    keyed = block_map.select(
        path_key(F.col("file_path"), match).alias("key_path"), "offset_bytes", "extent_id", "block_id"
    )
    return (
        keyed.join(wanted, ["key_path", "offset_bytes"], "left_semi")
        .select("extent_id", "block_id").distinct()
    )


def compare_file_offsets(
    audit_offsets: DataFrame, mappings: DataFrame, match: str = "basename",
) -> DataFrame:
    """(key_path, offset_bytes, side) between audit entries and mapped blocks."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(path_key(F.col("file_path"), match).alias("key_path"), "offset_bytes")

    return compare_sets(
        keyed(audit_offsets), keyed(mappings), ["key_path", "offset_bytes"],
        ("match", "audit_only", "maps_only"),
    )


def device_comparisons(
    audit_blocks: DataFrame, latest_at_end: DataFrame, latest_diff: DataFrame, regions: DataFrame,
) -> dict[str, DataFrame]:
    """The three device-level comparisons, each labelled by side."""
    keys = ["extent_id", "block_id"]
    return {
        "latest_at_end": compare_sets(audit_blocks, latest_at_end, keys,
                                      ("match", "audit_only", "latest_only")),
        "latest_diff": compare_sets(audit_blocks, latest_diff, keys,
                                    ("match", "audit_only", "latest_only")),
        "regions": compare_sets(audit_blocks, region_blocks(regions), keys,
                                ("match", "audit_only", "regions_only")),
    }


def with_extent(blocks: DataFrame, block_id: str = "block_id", per_extent: int = 8) -> DataFrame:
    return blocks.withColumn("extent_id", floor_div(F.col(block_id), per_extent))
