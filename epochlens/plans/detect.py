"""Detection: which byte regions of a device turned ciphertext-like between two epochs, and which
files own them."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens import schemas
from epochlens.config import DetectConfig
from epochlens.formats.ooxml_ranges import ooxml_decisions
from epochlens.formats.pdf_ranges import pdf_decisions
from epochlens.formats.zip import zip_decisions
from epochlens.operators import compare, fileaware, trust
from epochlens.operators.chunked import LOOKAHEAD, text_range_decisions
from epochlens.operators.delta import extent_groups
from epochlens.operators.intervals import map_blocks
from epochlens.operators.scan import extent_metrics, suspicious_regions
from epochlens.operators.versions import changed_blocks, dirty_ids, extent_id, latest_at, only_dirty
from epochlens.plans.observe import Totals, described
from epochlens.session import cut_lineage
from epochlens.sinks.tables import write_json, write_table
from epochlens.sources.audit import audit_offsets, read_audit
from epochlens.sources.chunks import CHUNK, mounted_chunks, mounted_facts
from epochlens.sources.files import mounted_files

@dataclass
class Detection:
    changed: DataFrame
    scanned: DataFrame          # regions and mappings before trust and format filters
    scanned_mappings: DataFrame
    regions: DataFrame
    mappings: DataFrame
    trusted_files: DataFrame | None = None
    inventory: DataFrame | None = None
    decisions: DataFrame | None = None
    files: DataFrame | None = None


def find_regions(
    mutations: DataFrame, bits: DataFrame, cfg: DetectConfig, totals: Totals | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(changed blocks, suspicious regions). Changed blocks are a small part of the device; regions
    are read by every later stage and are materialised once."""
    dirty = dirty_ids(bits, cfg.start_epoch, cfg.end_epoch)
    changed = changed_blocks(
        mutations, dirty, cfg.start_epoch, cfg.end_epoch,
        block_size=cfg.block_size, blocks_per_extent=cfg.blocks_per_extent,
    )
    regions = suspicious_regions(extent_groups(changed), cfg.scan)
    if totals is not None:
        regions = totals.watch("regions", regions, bytes=F.sum(F.col("byte_end_inclusive") - F.col("byte_start") + 1),
                               blocks=F.sum("num_blocks"))
    return changed, cut_lineage(regions)


def map_regions(regions: DataFrame, extents: DataFrame, cfg: DetectConfig) -> DataFrame:
    blocks = regions.select(F.explode("block_ids").alias("block_id")).distinct()
    return map_blocks(
        blocks, extents, cluster_size=cfg.cluster_size, block_size=cfg.block_size,
        blocks_per_extent=cfg.blocks_per_extent, partition_offset_blocks=cfg.partition_offset_blocks,
    )


CONTAINERS = {"zip": zip_decisions, "ooxml": ooxml_decisions, "pdf": pdf_decisions}
Loader = Callable[[DataFrame], DataFrame]  # (file_path) -> (file_path, content)


def loader(files: DataFrame | None, mount_root: str | None) -> Loader | None:
    """How contents of named files are read: from a table, or from a mount where only the named
    files are opened."""
    if files is not None:
        return lambda paths: files.join(paths.select("file_path").distinct(), "file_path", "left_semi")
    return (lambda paths: mounted_files(paths, mount_root)) if mount_root else None


def file_facts(suspects: DataFrame, load: Loader, mount_root: str | None = None) -> DataFrame:
    """(file_path, sha256, size_bytes, magic, handler): the one full read of every suspect file. Under a mount files are
    read in pieces, so they may be of any size."""
    if mount_root:
        facts = mounted_facts(suspects, mount_root)
    else:
        facts = load(suspects).select(
            "file_path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("size_bytes"),
            F.substring("content", 1, 8).alias("magic"))
    return cut_lineage(facts.withColumn("handler", fileaware.handler_name(F.col("file_path"), F.col("magic"))))


def text_ranges(ranges: DataFrame, text: DataFrame, load: Loader, trusted: DataFrame, mount_root: str | None) -> DataFrame:
    """Decisions on the ranges of text files; under a mount only the chunks that hold ranges are read."""
    if not mount_root:
        return fileaware.text_decisions(ranges, load(text).withColumn("handler", F.lit("text")), trusted)
    known = text.join(trusted.select("sha256").distinct(), "sha256", "left_semi")
    own = ranges.join(text.select("file_path"), "file_path", "left_semi")
    return text_range_decisions(
        own, lambda wanted: mounted_chunks(wanted, mount_root, chunk=CHUNK, halo=LOOKAHEAD), known, CHUNK)


def decide_ranges(
    ranges: DataFrame, routes: DataFrame, load: Loader, trusted: DataFrame, mount_root: str | None = None,
    manifest: DataFrame | None = None, trust_mode: str = "sha_only",
) -> DataFrame:
    """Range decisions of all handlers. ``routes`` has the facts and the handler of every readable file; other
    files are kept. Only handlers that some file needs are planned, and each reads its own files."""
    present = {r["handler"] for r in routes.select("handler").distinct().collect()}
    mine = lambda names: routes.filter(F.col("handler").isin(names))
    parts = [ranges.join(routes, "file_path", "left_anti").select(
        "file_path", "start", "end", F.lit("generic").alias("handler"), F.lit(True).alias("keep_region"),
        F.lit("unreadable; escalate").alias("reason"), F.lit("unreadable; escalate").alias("file_reason"),
    )]
    if present & set(fileaware.MEDIA):
        parts.append(fileaware.media_decisions(ranges, mine(fileaware.MEDIA), trusted))
    if "text" in present:
        parts.append(text_ranges(ranges, mine(["text"]), load, trusted, mount_root))
    if "generic" in present:
        parts.append(fileaware.generic_decisions(ranges, routes))
    for name, decide in CONTAINERS.items():
        if name in present:
            paths = mine([name])
            more = {"manifest": manifest, "trust_mode": trust_mode} if name == "ooxml" and manifest is not None else {}
            parts.append(decide(ranges.join(paths.select("file_path"), "file_path", "left_semi"), load(paths), trusted, **more))
    return reduce(DataFrame.unionByName, parts)


def detect(
    mutations: DataFrame, bits: DataFrame, extents: DataFrame, cfg: DetectConfig, *,
    mount_root: str | None = None, files: DataFrame | None = None, manifest: DataFrame | None = None,
    inventory: DataFrame | None = None, totals: Totals | None = None,
) -> Detection:
    """The whole detection. File contents come from ``files`` or from a mount; trust needs contents
    and known hashes. ``totals`` collects counts of what is materialised on the way."""
    cfg.validate()
    spark = mutations.sparkSession
    watch = (lambda name, df, **sums: df) if totals is None else totals.watch
    with described(spark, "scan changed blocks"):
        changed, scanned = find_regions(mutations, bits, cfg, totals)
    with described(spark, "map regions to files"):
        regions, mappings = scanned, cut_lineage(watch("mappings", map_regions(scanned, extents, cfg)))
    scanned_mappings = mappings
    load = loader(files, mount_root)
    hashes = spark.createDataFrame([], "sha256 string")
    components, listed = trust.split_manifest(manifest) if manifest is not None else (hashes, hashes)
    seen = new_inventory = None
    if load is None:
        ranges = fileaware.file_ranges(mappings, cfg.block_size)
        decisions = fileaware.without_mount(ranges, fileaware.handler_name(F.col("file_path"), F.lit(b"")))
    else:
        if inventory is not None:
            listed = listed.unionByName(inventory.filter("trusted").select("sha256")).distinct()
        under = mount_root if files is None else None
        facts = file_facts(mappings.select("file_path").distinct(), load, under)
        seen = cut_lineage(trust.flag_trusted(facts, listed))
        previous = inventory if inventory is not None else spark.createDataFrame([], schemas.INVENTORY)
        new_inventory = trust.update_inventory(previous, seen, cfg.end_epoch)
        good = seen.filter("trusted").select("file_path")
        if not good.isEmpty():
            mappings, regions = trust.drop_trusted(mappings, regions, good)
            mappings = cut_lineage(mappings)
        routes = facts.join(good, "file_path", "left_anti")
        by_path = manifest if cfg.media_trust != "sha_only" else None
        decisions = decide_ranges(
            fileaware.file_ranges(mappings, cfg.block_size), routes, load, components, under, by_path, cfg.media_trust)
    with described(spark, "decide file ranges"):
        decisions = cut_lineage(watch("decisions", decisions, kept=F.count_if("keep_region")))
        kept = cut_lineage(watch("kept_mappings", fileaware.apply_region_decisions(
            mappings, decisions, cfg.block_size, cfg.undecided_kept)))
    window = {"start_epoch": F.lit(cfg.start_epoch), "end_epoch": F.lit(cfg.end_epoch)}
    return Detection(
        changed=changed, scanned=scanned, scanned_mappings=scanned_mappings,
        regions=fileaware.update_regions(regions, kept).withColumns(window),
        mappings=kept.withColumns(window),
        trusted_files=seen, inventory=new_inventory, decisions=decisions,
        files=fileaware.file_decisions(decisions),
    )


def write_detection(found: Detection, out: str, cfg: DetectConfig, formats=("parquet",), audit_formats=()) -> None:
    tag = f"{cfg.start_epoch}_{cfg.end_epoch}"
    path = lambda name: os.path.join(out, f"{name}_{tag}")
    write_table(found.regions, path("suspicious_regions"), formats)
    write_table(found.mappings, path("suspicious_block_mappings"), formats)
    write_table(found.files, path("fileaware_files"), audit_formats)
    write_table(found.decisions.select("file_path", "start", "end", "keep_region", "reason"),
                path("fileaware_regions"), audit_formats)
    if found.trusted_files is not None:
        write_table(found.trusted_files, path("trusted_new_files"), audit_formats)
        # Parquet keeps the inventory; a new file set is written beside the one being read.
        found.inventory.write.mode("overwrite").parquet(os.path.join(out, f"file_inventory_{tag}.parquet"))


def write_profile(found: Detection, totals: Totals, out: str, cfg: DetectConfig) -> None:
    """Totals that were observed on the way, and one row of scan metrics per extent with the ten slowest beside them."""
    tag = f"{cfg.start_epoch}_{cfg.end_epoch}"
    metrics = cut_lineage(extent_metrics(extent_groups(found.changed), cfg.scan))
    write_table(metrics, os.path.join(out, f"extent_metrics_{tag}"), ("parquet",))
    slowest = metrics.orderBy(F.desc(F.col("delta_seconds") + F.col("scan_seconds")), "extent_id").limit(10)
    write_json(os.path.join(out, f"run_metrics_{tag}.json"), totals.read() | {"slowest_extents": [r.asDict() for r in slowest.collect()]})


def compare_with_audit(
    spark: SparkSession, mutations: DataFrame, bits: DataFrame, extents: DataFrame, found: Detection,
    cfg: DetectConfig, out: str, audit_path: str | None, match: str = "basename",
) -> dict:
    """Block-level comparison of an audit log with each stage, written as CSV. Without a log
    nothing counts as attacked and every block is ``latest_only``."""
    dirty = dirty_ids(bits, cfg.start_epoch, cfg.end_epoch)
    every = map_blocks(
        dirty.withColumnRenamed("id", "block_id"), extents, cluster_size=cfg.cluster_size,
        block_size=cfg.block_size, blocks_per_extent=cfg.blocks_per_extent,
        partition_offset_blocks=cfg.partition_offset_blocks,
    )
    every = cut_lineage(every)
    offsets = (
        audit_offsets(read_audit(spark, audit_path), cfg.block_size) if audit_path
        else spark.createDataFrame([], "file_path string, offset_bytes bigint")
    )
    audited = cut_lineage(compare.audit_device_blocks(offsets, every, match))
    at_end = latest_at(only_dirty(mutations, dirty).select("id", "epoch"), cfg.end_epoch, "epoch").select(
        extent_id(F.col("id"), cfg.blocks_per_extent).alias("extent_id"), F.col("id").alias("block_id")
    )
    sides = compare.device_comparisons(audited, at_end, found.changed, found.scanned)
    sides["maps"] = compare.compare_file_offsets(offsets, found.scanned_mappings, match)
    put = lambda df, name: write_table(df, os.path.join(out, name), ("csv",))
    put(every, "mutated_block_mappings")
    put(offsets, "audit_file_offsets")
    put(audited, "audit_device_blocks")
    put(fileaware.untrusted_mappings(found.mappings, found.decisions, cfg.block_size),
        "audit_untrusted_immutable_block_mappings")
    summary = {"mode": "audit" if audit_path else "no-audit-fallback",
               "mutated_block_mappings": every.count(), "audit_device_blocks": audited.count()}
    for name, df in sides.items():
        df = cut_lineage(df)
        other = {"latest_at_end": "latest", "latest_diff": "latest", "regions": "regions", "maps": "maps"}[name]
        for side in ("match", "audit_only", f"{other}_only"):
            part = df.filter(F.col("side") == side).drop("side")
            put(part, f"cmp_audit_vs_{name}_{side}")
            summary[f"{name}_{side}"] = part.count()
    write_json(os.path.join(out, "block_debug_summary.json"), summary)
    return summary
