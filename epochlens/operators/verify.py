"""Detection results against a manifest of expected regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.functions.paths import basename, posix_norm
from epochlens.operators.compare import membership

# Alternative field names, in order of preference.
PATH_FIELDS = ["out_target", "file_path", "path", "dst_path", "dst"]
PREFIX_FIELDS = ["encrypted_prefix_bytes", "prefix_bytes", "header_bytes", "first_n_bytes"]
RANGE_FIELDS = ["encrypted_ranges", "ranges", "attack_ranges", "encrypted_regions"]

SPANS = "array<struct<offset:bigint,length:bigint>>"
PAIR = ["extent_id", "block_id"]


def _whole(value: Column) -> Column:
    """Integer from an integer or decimal text; null when it is neither."""
    text = F.trim(value.cast("string"))
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def _positive(spans: Column) -> Column:
    kept = F.filter(spans.cast(SPANS), lambda s: F.coalesce(s["length"], F.lit(0)) > 0)
    return F.when(F.size(kept) > 0, kept)


def _from_pairs(pairs: Column) -> Column:
    """[[offset, length], ...] of texts."""
    long_enough = F.filter(pairs, lambda p: F.size(p) >= 2)
    return _positive(F.transform(long_enough, lambda p: F.struct(
        F.coalesce(_whole(p[0]), F.lit(0)).alias("offset"),
        F.coalesce(_whole(p[1]), F.lit(0)).alias("length"),
    )))


def _from_objects(objs: Column) -> Column:
    return _positive(F.transform(objs, lambda o: F.struct(
        F.coalesce(_whole(o["offset"]), F.lit(0)).alias("offset"),
        F.coalesce(_whole(o["length"]), F.lit(0)).alias("length"),
    )))


def _from_text(text: Column) -> Column:
    """JSON lists of pairs or objects, else ``a:b,c:d``."""
    pairs = _from_pairs(F.from_json(text, "array<array<string>>"))
    objects = _from_objects(F.from_json(text, "array<struct<offset:string,length:string>>"))
    items = F.filter(F.transform(F.split(text, ","), F.trim), lambda p: p != "")
    ok = (F.size(items) > 0) & F.forall(items, lambda p: p.contains(":"))
    colon = F.when(ok, F.transform(items, lambda p: F.array(
        F.substring_index(p, ":", 1), F.regexp_replace(p, "^[^:]*:", "")
    )))
    return F.coalesce(pairs, objects, F.when(~text.startswith("["), _from_pairs(colon)))


def _region_spans(df: DataFrame) -> Column | None:
    """Spans from a ``regions`` array, each region's ``actual`` before its ``requested`` bounds."""
    if "regions" not in df.columns:
        return None
    fields = df.schema["regions"].dataType.elementType.names

    def span(r: Column) -> Column:
        seg = [r[n] for n in ("actual", "requested") if n in fields]
        start = F.coalesce(*[_whole(s["start"]) for s in seg])
        end = F.coalesce(*[_whole(s["end"]) for s in seg])
        return F.struct(start.alias("offset"), (end - start).alias("length"))

    return _positive(F.transform("regions", span))


def expected_spans(df: DataFrame, default_prefix: int = 4096) -> Column:
    """Expected (offset, length) spans of a manifest record, whichever way it states them."""
    options = []
    regions = _region_spans(df)
    if regions is not None:
        options.append(regions)
    for name in PREFIX_FIELDS:
        if name in df.columns:
            n = _whole(F.col(name))
            options.append(F.when(n > 0, F.array(F.struct(
                F.lit(0).cast("bigint").alias("offset"), n.alias("length")
            ))))
    for name in RANGE_FIELDS:
        if name in df.columns:
            kind = df.schema[name].dataType.simpleString()
            if kind == "string":
                options.append(_from_text(F.col(name)))
            elif kind.startswith("array<array"):
                options.append(_from_pairs(F.col(name)))
            else:
                options.append(_from_objects(F.col(name)))
    fallback = F.array(F.struct(
        F.lit(0).cast("bigint").alias("offset"), F.lit(default_prefix).cast("bigint").alias("length")
    ))
    return F.coalesce(*options, fallback)


def manifest_records(df: DataFrame) -> DataFrame:
    """Flatten a ``files`` array of records, if there is one."""
    return df.select(F.inline("files")) if "files" in df.columns else df


def manifest_targets(df: DataFrame, default_prefix: int = 4096) -> DataFrame:
    """(man_path, spans) of every record that names a file."""
    names = [F.when(F.col(c).cast("string") != "", F.col(c)) for c in PATH_FIELDS if c in df.columns]
    if not names:
        raise ValueError("manifest has no path column")
    return df.select(
        posix_norm(F.coalesce(*names)).alias("man_path"),
        expected_spans(df, default_prefix).alias("spans"),
    ).filter(F.col("man_path").isNotNull())


def suspicious_pairs(regions: DataFrame, epoch: int | None = None) -> DataFrame:
    """Distinct (extent_id, block_id) of the LBA ranges; reversed bounds are swapped."""
    if epoch is not None:
        regions = regions.filter((F.col("start_epoch") == epoch) & (F.col("end_epoch") == epoch))
    lo = F.least("lba_start_block", "lba_end_block")
    hi = F.greatest("lba_start_block", "lba_end_block")
    both = F.col("lba_start_block").isNotNull() & F.col("lba_end_block").isNotNull()
    return regions.filter(both).select(
        "extent_id", F.explode(F.sequence(lo, hi)).alias("block_id")
    ).distinct()


def keyed_blockmap(blockmap: DataFrame, match: str) -> DataFrame:
    norm = posix_norm(F.col("file_path"))
    key = basename(norm) if match == "basename" else norm
    return blockmap.select(key.alias("file_key"), *PAIR, "offset_bytes")


def target_keys(targets: DataFrame, match: str) -> DataFrame:
    """(_key, target_key, spans): the block-map key each manifest record applies to. ``suffix``
    lists every suffix of the manifest path, which keeps the later join an equi-join."""
    path = F.col("man_path")
    if match == "basename":
        return targets.select(basename(path).alias("_key"), basename(path).alias("target_key"), "spans")
    if match == "exact":
        return targets.select(path.alias("_key"), path.alias("target_key"), "spans")
    if match != "suffix":
        raise ValueError(f"unknown path match {match!r}")
    at = F.explode(F.sequence(F.lit(1), F.length("man_path")))
    return targets.select("man_path", "spans", at.alias("_at")).select(
        path.substr(F.col("_at"), F.length("man_path")).alias("_key"), path.alias("target_key"), "spans"
    )


def verify(
    regions: DataFrame, blockmap: DataFrame, manifest: DataFrame, *, match: str = "basename",
    epoch: int | None = None, file_prefix: str | None = None, default_prefix: int = 4096,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, misses, extras) of a detection run.

    Every file of the block map is evaluated; those outside the manifest are expected to be
    touched in their first ``default_prefix`` bytes.
    """
    if epoch is not None and {"start_epoch", "end_epoch"} <= set(blockmap.columns):
        blockmap = blockmap.filter((F.col("start_epoch") == epoch) & (F.col("end_epoch") == epoch))
    if file_prefix:
        blockmap = blockmap.filter(F.col("file_path").startswith(file_prefix))
    flagged = suspicious_pairs(regions, epoch)
    targets = target_keys(manifest_targets(manifest_records(manifest), default_prefix), match)
    offset = F.col("offset_bytes")
    stated = F.exists("spans", lambda s: (offset >= s["offset"]) & (offset < s["offset"] + s["length"]))
    # One left join serves files in and outside the manifest; several records of a file meet again
    # in the aggregation.
    blocks = (
        keyed_blockmap(blockmap, match).withColumnRenamed("file_key", "_key").join(targets, "_key", "left")
        .select(
            F.coalesce("target_key", "_key").alias("file_key"), *PAIR,
            F.when(F.col("spans").isNotNull(), stated)
            .otherwise((offset >= 0) & (offset < default_prefix)).alias("expected"),
        )
        .groupBy("file_key", *PAIR).agg(F.bool_or("expected").alias("expected"))
        .join(flagged.withColumn("_f", F.lit(True)), PAIR, "left")
        .withColumn("flagged", F.coalesce("_f", F.lit(False)))
    )
    exp, fl = F.col("expected"), F.col("flagged")
    counts = blocks.groupBy("file_key").agg(
        F.count_if(exp).alias("expected_blocks"),
        F.count_if(exp & fl).alias("flagged_in_expected"),
        F.count_if(fl).alias("flagged_total_for_file"),
        F.count_if(fl & ~exp).alias("extras_flagged_outside_expected"),
        F.count_if(exp & ~fl).alias("misses_expected_not_flagged"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    summary = counts.select(
        "file_key", "expected_blocks", "flagged_in_expected",
        rate("flagged_in_expected", "expected_blocks").alias("recall_on_expected"),
        "flagged_total_for_file",
        rate("flagged_in_expected", "flagged_total_for_file").alias("precision_like"),
        "extras_flagged_outside_expected", "misses_expected_not_flagged",
    )
    pair = blocks.select("file_key", *PAIR, "expected", "flagged")
    return (
        summary,
        pair.filter(exp & ~fl).select("file_key", *PAIR),
        pair.filter(fl & ~exp).select("file_key", *PAIR),
    )


def macro_recall(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count("*").alias("files"), F.avg("recall_on_expected").alias("macro_recall")
    )


def key_set_ops(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of union, intersection and both differences of two key sets."""
    m = membership({"_l": left, "_r": right}, keys)
    return m.agg(
        F.count("*").alias("n_union"),
        F.count_if(F.col("_l") & F.col("_r")).alias("n_intersect"),
        F.count_if(F.col("_l") & ~F.col("_r")).alias("n_left_only"),
        F.count_if(~F.col("_l") & F.col("_r")).alias("n_right_only"),
    )
