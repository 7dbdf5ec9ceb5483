"""Gaps and islands that stay parallel under a hot key.

A plain ``Window.partitionBy(key)`` would sort all rows of a key in one task. Here rows are first
cut into value buckets. Distinct integers (or distinct span starts) bound a bucket to ``bucket``
rows; what crosses bucket edges is carried by a table with one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochlens.functions.ints import ceil_div, floor_div

BUCKET = 65536


def _bucket(col: str, bucket: int):
    return floor_div(F.col(col), bucket)


def prefix_max(df: DataFrame, keys: list[str], bucket_col: str, value: str, out: str) -> DataFrame:
    """Per (key, bucket): the maximum of ``value`` over all earlier buckets of the key."""
    per = df.groupBy(*keys, bucket_col).agg(F.max(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, bucket_col, F.max("_v").over(w).alias(out))


def contiguous_runs(
    df: DataFrame, keys: list[str], id_col: str, bucket: int = BUCKET, distinct_input: bool = False,
) -> DataFrame:
    """Maximal runs of consecutive ids per key: (keys, run_start, run_end, run_len)."""
    ids = df.select(*keys, F.col(id_col).cast("bigint").alias("_id"))
    if not distinct_input:
        ids = ids.distinct()
    ids = ids.withColumn("_b", _bucket("_id", bucket))
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_id")
    local = (
        ids.withColumn("_g", F.col("_id") - F.row_number().over(in_bucket))
        .groupBy(*keys, "_b", "_g")
        .agg(F.min("_id").alias("run_start"), F.max("_id").alias("run_end"))
    )
    at_edge = (
        (F.pmod(F.col("run_start"), F.lit(bucket)) == 0)
        | (F.pmod(F.col("run_end"), F.lit(bucket)) == bucket - 1)
    )
    inner = local.filter(~at_edge).select(*keys, "run_start", "run_end")
    # At most two edge runs per bucket reach this window.
    per_key = Window.partitionBy(*keys).orderBy("run_start")
    joined = (
        local.filter(at_edge)
        .withColumn("_new", (F.lag("run_end").over(per_key) + 1 == F.col("run_start")))
        .withColumn("_new", F.when(F.col("_new"), 0).otherwise(1))
        .withColumn("_island", F.sum("_new").over(per_key))
        .groupBy(*keys, "_island")
        .agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"))
        .select(*keys, "run_start", "run_end")
    )
    return inner.unionByName(joined).withColumn(
        "run_len", F.col("run_end") - F.col("run_start") + 1
    )


def _with_reach(
    df: DataFrame, keys: list[str], start: str, end: str, bucket: int | None,
) -> tuple[DataFrame, list[str]]:
    """Non-empty spans, one per (keys, start), with ``_prev``: the furthest end of all spans that
    start earlier. Also returns the columns its windows are partitioned by."""
    spans = (
        df.select(*keys, F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"))
        .filter(F.col("_e") > F.col("_s"))
        .groupBy(*keys, "_s").agg(F.max("_e").alias("_e"))
    )
    part = list(keys)
    if bucket is not None:
        spans = spans.withColumn("_b", _bucket("_s", bucket))
        part.append("_b")
    before = Window.partitionBy(*part).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.max("_e").over(before)
    if bucket is None:
        return spans.withColumn("_prev", prev), part
    reach = prefix_max(spans, keys, "_b", "_e", "_reach")
    joined = spans.join(reach, part).withColumn("_prev", F.greatest(F.col("_reach"), prev))
    return joined, part


def merge_spans(
    df: DataFrame, keys: list[str], start: str, end: str, bucket: int | None = BUCKET,
) -> DataFrame:
    """Union of half-open spans per key; touching spans merge: (keys, span_start, span_end).
    ``bucket=None`` sorts a whole key in one task: only for keys with a proven row bound."""
    spans, part = _with_reach(df, keys, start, end, bucket)
    upto = Window.partitionBy(*part).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("_prev").isNull() | (F.col("_s") > F.col("_prev")), F.col("_s"))
    local = (
        spans.withColumn("_head", head).withColumn("_local", F.max("_head").over(upto))
        .groupBy(*part, "_local").agg(F.max("_e").alias("_e"))
    )
    if bucket is None:
        return local.select(*keys, F.col("_local").alias("span_start"), F.col("_e").alias("span_end"))
    heads = prefix_max(local, keys, "_b", "_local", "_carried")
    return (
        local.join(heads, part)
        .groupBy(*keys, F.coalesce("_local", "_carried").alias("span_start"))
        .agg(F.max("_e").alias("span_end"))
    )


def gap_spans(
    df: DataFrame, keys: list[str], start: str, end: str, bucket: int | None = BUCKET,
    origin: int | None = None,
) -> DataFrame:
    """Stretches between spans that no span covers: (keys, gap_start, gap_end). With ``origin``
    the stretch from it to the first span counts too. Spans need not be merged first."""
    spans, _ = _with_reach(df, keys, start, end, bucket)
    since = F.col("_prev")
    if origin is not None:
        since = F.coalesce(since, F.lit(origin).cast("bigint"))
    return (
        spans.withColumn("gap_start", since).filter(F.col("gap_start") < F.col("_s"))
        .select(*keys, "gap_start", F.col("_s").alias("gap_end"))
    )


def offset_lists(
    df: DataFrame, keys: list[str], offset: str, chunk_bytes: int = 1 << 20,
) -> DataFrame:
    """Sorted distinct offsets per key in chunks of the offset space, so that no list grows with
    the size of a file: (keys, chunk, offsets)."""
    return (
        df.select(*keys, F.col(offset).cast("bigint").alias("_o"))
        .withColumn("chunk", floor_div(F.col("_o"), chunk_bytes))
        .groupBy(*keys, "chunk")
        .agg(F.array_sort(F.collect_set("_o")).alias("offsets"))
    )


def expand_range(start, end_exclusive):
    """Every integer of a half-open range as an array; empty when the range is empty (a bare
    ``sequence`` would count downwards there)."""
    return F.when(end_exclusive > start, F.sequence(start, end_exclusive - 1)).otherwise(
        F.array().cast("array<bigint>")
    )


def block_range(start, end_exclusive, block_size: int):
    """Block ids touched by a half-open byte range."""
    lo = floor_div(start, block_size)
    hi = ceil_div(end_exclusive, block_size)
    return F.when(end_exclusive > start, expand_range(lo, hi)).otherwise(
        F.array().cast("array<bigint>")
    )
