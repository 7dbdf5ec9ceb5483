"""Interval (stabbing) join as a bucketed equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlens.functions.ints import floor_div


def stab_join(
    points: DataFrame, runs: DataFrame, point: str, start: str, end: str, *,
    keys: list[str] | None = None, bucket: int = 4096, salts: int = 1,
) -> DataFrame:
    """Pairs with ``start <= point <= end``.

    A run is repeated once per bucket it covers and a point falls in exactly one bucket, so each
    pair appears once. For disjoint runs the repeated side has at most
    ``runs + covered length / bucket`` rows, and a bucket holds at most ``bucket`` distinct points.
    ``salts`` spreads the points of overfull buckets (many equal points) over several tasks.
    """
    keys = keys or []
    p = points.withColumn("_b", floor_div(F.col(point), bucket))
    r = runs.filter(F.col(end) >= F.col(start)).withColumn(
        "_b",
        F.explode(F.sequence(floor_div(F.col(start), bucket), floor_div(F.col(end), bucket))),
    )
    on = [*keys, "_b"]
    if salts > 1:
        p = p.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int"))
        r = r.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
        on.append("_salt")
    joined = p.join(r, on)
    joined = joined.filter((F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end)))
    return joined.drop("_b", *(["_salt"] if salts > 1 else []))


def overlap_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str],
    right_span: tuple[str, str], *, bucket: int = 65536,
) -> DataFrame:
    """Pairs of inclusive spans that intersect, within equal keys.

    Both sides are repeated per bucket; a pair is kept only in the bucket where the later of the
    two starts lies, so it is emitted once.
    """
    ls, le = left_span
    rs, re_ = right_span

    def cut(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.filter(F.col(e) >= F.col(s)).withColumn(
            "_b", F.explode(F.sequence(floor_div(F.col(s), bucket), floor_div(F.col(e), bucket)))
        )

    joined = cut(left, ls, le).join(cut(right, rs, re_), [*keys, "_b"])
    first = floor_div(F.greatest(F.col(ls), F.col(rs)), bucket)
    return joined.filter(
        (F.col(ls) <= F.col(re_)) & (F.col(rs) <= F.col(le)) & (F.col("_b") == first)
    ).drop("_b")


def longest_overlap(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str],
    carry: list[str], first: str | None = None, *, bucket: int = 65536,
) -> DataFrame:
    """Each left span with the right span that covers most of it (of equal cover the one that starts first, then the
    smallest ``carry``): (keys, left span, overlap, spans, carry); ``spans`` counts all that it meets. A column
    ``first`` of the right side, smallest value first, goes before the cover. The choice is an aggregate, so spans that
    meet many others fold before they are moved."""
    (ls, le), (rs, re_) = left_span, right_span
    pairs = overlap_join(left.select(*keys, ls, le), right.select(*keys, rs, re_, *carry), keys, left_span, right_span, bucket=bucket)
    cover = F.least(le, re_) - F.greatest(ls, rs) + 1
    ranked = F.struct(*([F.col(first).alias("_f")] if first else []), (-cover).alias("_c"), F.col(rs).alias("_s"), *carry)
    return pairs.groupBy(*keys, ls, le).agg(F.min(ranked).alias("_b"), F.count("*").alias("spans")).select(
        *keys, ls, le, (-F.col("_b._c")).alias("overlap"), "spans", *(F.col("_b")[c].alias(c) for c in carry))


def map_blocks(
    blocks: DataFrame, extents: DataFrame, *, cluster_size: int, block_size: int = 512,
    blocks_per_extent: int = 8, partition_offset_blocks: int = 0, bucket: int = 4096,
    salts: int = 1,
) -> DataFrame:
    """Device blocks to (file, offset). ``blocks`` has ``block_id``; ``extents`` lists inclusive
    cluster runs. A block owned by several files yields one row per file."""
    if cluster_size % block_size:
        raise ValueError("cluster size must be a multiple of the block size")
    spc = cluster_size // block_size
    local = F.col("block_id") - partition_offset_blocks
    points = blocks.select("block_id").distinct().filter(local >= 0).withColumn(
        "_cluster", floor_div(local, spc)
    )
    hit = stab_join(points, extents, "_cluster", "start_block", "end_block",
                    bucket=bucket, salts=salts)
    offset = (
        F.col("file_offset_bytes")
        + (F.col("_cluster") - F.col("start_block")) * cluster_size
        + F.pmod(local, F.lit(spc)) * block_size
    )
    return hit.select(
        floor_div(F.col("block_id"), blocks_per_extent).alias("extent_id"),
        "block_id",
        F.col("file_id").cast("int").alias("file_id"),
        "file_path",
        offset.cast("bigint").alias("offset_bytes"),
        F.col("start_block").cast("bigint").alias("extent_start_block"),
        F.col("end_block").cast("bigint").alias("extent_end_block"),
    ).dropDuplicates(["block_id", "file_id", "offset_bytes", "file_path"])
