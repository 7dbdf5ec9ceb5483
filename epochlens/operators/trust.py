"""Trust lists, the file inventory and the removal of trusted files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGION_KEY = ["extent_id", "delta_block_id", "byte_start"]


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def split_manifest(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(component hashes, file hashes): all hashes, and those of stand-alone files. A manifest
    with neither a ``source`` nor an ``entry`` column counts as both."""
    df = lower_columns(manifest)
    if "sha256" not in df.columns:
        raise ValueError("a trusted manifest needs a sha256 column")
    df = df.withColumn("sha256", F.lower("sha256")).filter(F.trim("sha256") != "")
    if "source" in df.columns:
        is_file = F.lower("source") == "file"
    elif "entry" in df.columns:
        is_file = F.coalesce(F.trim("entry"), F.lit("")) == ""
    else:
        is_file = F.lit(True)
    return df.select("sha256").distinct(), df.filter(is_file).select("sha256").distinct()


def hash_files(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    return files.select(
        F.col(path).alias("file_path"),
        F.sha2(F.col(content), 256).alias("sha256"),
        F.length(content).cast("bigint").alias("size_bytes"),
    )


def flag_trusted(hashed: DataFrame, trusted: DataFrame) -> DataFrame:
    """Adds ``trusted``. The list is reduced to distinct hashes, so no file is repeated."""
    known = trusted.select("sha256").distinct().withColumn("_known", F.lit(True))
    return hashed.join(known, "sha256", "left").select(
        "file_path", "sha256", "size_bytes", F.coalesce("_known", F.lit(False)).alias("trusted")
    )


def update_inventory(previous: DataFrame, seen: DataFrame, end_epoch: int) -> DataFrame:
    """Files seen in this run get their current state and the epoch; others keep theirs. A tagged
    union and one aggregation instead of a full join."""
    fields = ["sha256", "size_bytes", "trusted"]
    old = previous.select(
        "file_path", *fields, "first_seen_epoch", "last_seen_epoch", F.lit(0).alias("_run")
    )
    new = seen.select(
        "file_path", *fields, F.lit(end_epoch).alias("first_seen_epoch"),
        F.lit(end_epoch).alias("last_seen_epoch"), F.lit(1).alias("_run"),
    )
    merged = old.unionByName(new).groupBy("file_path").agg(
        F.max_by(F.struct(*fields), "_run").alias("s"),
        F.min("first_seen_epoch").alias("first_seen_epoch"),
        F.max_by("last_seen_epoch", "_run").alias("last_seen_epoch"),
    )
    return merged.select("file_path", "s.*", "first_seen_epoch", "last_seen_epoch")


def region_keep_flags(region_blocks: DataFrame, key: list[str], block_flags: DataFrame) -> DataFrame:
    """Per region: block count, mapped blocks, trusted mapped blocks and the keep rule: some block
    is unmapped or some mapped block is untrusted. ``block_flags`` is (block_id, is_trusted) with
    one row per mapped block."""
    return (
        region_blocks.join(block_flags, "block_id", "left")
        .groupBy(*key)
        .agg(
            F.count("*").alias("total"),
            F.count("is_trusted").alias("mapped"),
            F.count_if(F.coalesce("is_trusted", F.lit(False))).alias("trusted_mapped"),
        )
        .withColumn(
            "keep_region",
            (F.col("mapped") < F.col("total")) | (F.col("trusted_mapped") < F.col("mapped")),
        )
    )


def drop_trusted(
    mappings: DataFrame, regions: DataFrame, trusted_paths: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Mappings of untrusted files, and regions not fully explained by trusted files."""
    paths = trusted_paths.select("file_path").distinct()
    flags = (
        mappings.select("block_id", "file_path")
        .join(paths.withColumn("_t", F.lit(True)), "file_path", "left")
        .groupBy("block_id").agg(F.bool_or(F.coalesce("_t", F.lit(False))).alias("is_trusted"))
    )
    blocks = regions.select(*REGION_KEY, F.explode("block_ids").alias("block_id"))
    keep = region_keep_flags(blocks, REGION_KEY, flags).filter("keep_region").select(*REGION_KEY)
    return (
        mappings.join(paths, "file_path", "left_anti"),
        regions.join(keep, REGION_KEY, "left_semi"),
    )


TRUST_MODES = ("sha_only", "sha_then_path", "path_only")


def _posix(name: Column) -> Column:
    return F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/"))


def manifest_index(manifest: DataFrame, order: str | None = None, source: str = "ooxml") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three lookups of one manifest: by hash, by container and hash, by container and entry, each with one row per
    key. Rows without a hash, container or entry are no evidence. Of repeated keys the first row names the entry, and
    the last row states the hash of a path; ``order`` is the column that says which row is first (else the smallest)."""
    df = lower_columns(manifest)
    rows = df.filter(F.lower(F.trim("source")) == source).select(
        F.lower(F.trim("sha256")).alias("sha256"), F.col("container"), _posix(F.col("entry")).alias("entry"),
        (F.col(order) if order else F.lit(0)).alias("_o"),
    ).filter("sha256 <> '' AND container <> '' AND entry <> ''")
    place = F.struct("_o", "container", "entry")
    by_hash = rows.groupBy("sha256").agg(F.min(place).alias("x")).select(
        "sha256", F.col("x.container").alias("hash_container"), F.col("x.entry").alias("hash_entry"))
    by_both = rows.groupBy("container", "sha256").agg(F.min(F.struct("_o", "entry")).alias("x")).select(
        "container", "sha256", F.col("x.entry").alias("both_entry"))
    by_path = rows.groupBy("container", "entry").agg(F.max(F.struct("_o", "sha256")).alias("x")).select(
        "container", "entry", F.col("x.sha256").alias("path_sha256"))
    return by_hash, by_both, by_path


def media_trust(media: DataFrame, manifest: DataFrame, mode: str = "sha_only", order: str | None = None) -> DataFrame:
    """``media`` (file_path, entry, sha256, ...) with ``known`` and ``why``. The first tier that has an answer gives it:
    the hash anywhere, the hash in the same container, the path in the same container."""
    if mode not in TRUST_MODES:
        raise ValueError(f"unknown trust mode {mode!r}")
    by_hash, by_both, by_path = manifest_index(manifest, order)
    sha, entry = F.lower("sha256"), _posix(F.col("entry"))
    rows = media.withColumns({"_sha": sha, "_entry": entry})
    tiers: list[tuple[Column, Column, str | Column]] = []  # (has an answer, the answer, its words)
    short = F.concat(F.lit(" ("), "_entry", F.lit("); sha="), F.substring("_sha", 1, 12))
    if mode != "path_only":
        rows = rows.join(by_hash.withColumnRenamed("sha256", "_sha"), "_sha", "left")
        other = F.when(F.col("hash_container") == F.col("file_path"), "").otherwise("; manifest container differs")
        tiers.append((F.col("hash_entry").isNotNull(), F.lit(True),
                      F.concat(F.lit("ooxml: media trusted by sha"), short, F.lit(" ↔ "), "hash_entry", other)))
    if mode != "sha_only":
        rows = rows.join(by_both.select(F.col("container").alias("file_path"), F.col("sha256").alias("_sha"), "both_entry"), ["file_path", "_sha"], "left")
        rows = rows.join(by_path.select(F.col("container").alias("file_path"), F.col("entry").alias("_entry"), "path_sha256"), ["file_path", "_entry"], "left")
        seen = F.concat(F.lit("ooxml: media matches trusted manifest by sha ("), F.when(
            F.col("both_entry") == F.col("_entry"), F.col("_entry")).otherwise(F.concat(
                F.lit("entry differs: saw "), "_entry", F.lit(", manifest "), "both_entry")), F.lit(")"))
        tiers += [
            (F.col("both_entry").isNotNull(), F.lit(True), seen),
            (F.col("path_sha256").isNull(), F.lit(False), F.concat(F.lit("ooxml: media not in trusted manifest by path"), short)),
            (F.col("path_sha256") != F.col("_sha"), F.lit(False), F.concat(
                F.lit("ooxml: media hash mismatch vs manifest ("), "_entry", F.lit("); got="), F.substring("_sha", 1, 12),
                F.lit(" expected="), F.substring("path_sha256", 1, 12))),
            (F.lit(True), F.lit(True), F.concat(F.lit("ooxml: media matches trusted manifest by path ("), "_entry", F.lit(")"))),
        ]
    tiers.append((F.lit(True), F.lit(False), F.concat(F.lit("ooxml: media sha not in trusted manifest"), short)))
    known = reduce(lambda acc, t: acc.when(t[0], t[1]), tiers[1:], F.when(tiers[0][0], tiers[0][1]))
    why = reduce(lambda acc, t: acc.when(t[0], t[2]), tiers[1:], F.when(tiers[0][0], tiers[0][2]))
    return rows.select(*media.columns, known.alias("known"), why.alias("why"))
