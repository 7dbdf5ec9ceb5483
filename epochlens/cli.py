"""Command line: ``python -m epochlens.cli <command>``."""

from __future__ import annotations

import argparse
import os

from epochlens.config import DetectConfig, check_inputs, parse_formats
from epochlens.operators.scan import ScanConfig
from epochlens.operators.trust import TRUST_MODES
from epochlens.plans.observe import Totals
from epochlens.session import build_session


def _arg(p, name, **kw):
    p.add_argument(f"--{name}", **kw)


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="epochlens")
    sub = root.add_subparsers(dest="command", required=True)

    p = sub.add_parser("preprocess", help="materialise epochs from a store and rebuild the image")
    p.add_argument("--end-epoch", "--epoch", dest="end_epoch", type=int, required=True)
    _arg(p, "output", required=True)
    _arg(p, "device-size", type=int, required=True)
    _arg(p, "client", required=True, help="store client factory as module:function")
    _arg(p, "skip-restore", action="store_true")
    _arg(p, "force-overwrite", action="store_true")

    p = sub.add_parser("restore", help="rebuild the image as of an epoch")
    _arg(p, "end-epoch", type=int, required=True)
    _arg(p, "snapshot-path", required=True)
    _arg(p, "device-size", type=int, required=True)
    _arg(p, "timestamped", action="store_true")

    p = sub.add_parser("detect", help="find and map ciphertext-like regions")
    for name in ("start-epoch", "end-epoch"):
        _arg(p, name, type=int, required=True)
    for name in ("snapshot-path", "output-path", "extents"):
        _arg(p, name, required=True)
    for name, default in (("extent-size", 4096), ("block-size", 512), ("cluster-size", 4096), ("min-gap-length", 16),
                          ("width", 16), ("stride", 4), ("min-expansions", 2)):
        _arg(p, name, type=int, default=default)
    _arg(p, "chi2-threshold", type=float, default=350.0)
    _arg(p, "max-chi2-var", type=float, default=75.0)
    for name in ("trusted-manifest", "end-mount-root", "inventory", "block-debug-audit", "block-debug-outdir"):
        _arg(p, name)
    _arg(p, "out-formats", default="parquet")
    _arg(p, "audit-formats", default="csv")
    _arg(p, "block-debug", action="store_true")
    _arg(p, "block-debug-path-match", choices=["basename", "full"], default="basename")
    _arg(p, "no-expand", action="store_true")
    _arg(p, "media-trust", choices=TRUST_MODES, default="sha_only", help="how media parts are looked up in the manifest")
    _arg(p, "profile", action="store_true", help="write run totals and extent metrics beside the results")

    p = sub.add_parser("evaluate", help="score a run against its audit comparisons")
    for name in ("gt-base", "mappings-dir", "out-dir"):
        _arg(p, name, required=True)
    _arg(p, "block-id-col")
    _arg(p, "extents")
    _arg(p, "block-size", type=int, default=512)
    _arg(p, "cluster-size", type=int, default=4096)

    p = sub.add_parser("content", help="verdicts for a file or directory")
    p.add_argument("mode", choices=["entropy", "chi2", "text", "zip", "ooxml", "pdf"])
    for name in ("input-path", "output-path"):
        _arg(p, name, required=True)
    _arg(p, "window-size", type=int, default=4096)
    _arg(p, "stride", type=int)
    _arg(p, "tail-mode", choices=["ignore", "overlap"], default="ignore")
    _arg(p, "entropy-threshold", type=float, default=7.5)
    _arg(p, "chi2-threshold", type=float, default=10000.0)
    _arg(p, "whitelist")

    p = sub.add_parser("pdf-whitelist", help="hashes of image and font streams")
    for name in ("input-path", "output-path"):
        _arg(p, name, required=True)

    p = sub.add_parser("verify", help="compare regions with a manifest of expected ones")
    for name in ("suspicious", "blockmap", "manifest", "out-dir"):
        _arg(p, name, required=True)
    _arg(p, "epoch", type=int)
    _arg(p, "file-prefix")
    _arg(p, "default-prefix-bytes", type=int, default=4096)
    _arg(p, "path-match", choices=["basename", "exact", "suffix"], default="basename")

    p = sub.add_parser("manifest", help="trusted hashes of media")
    p.add_argument("inputs", nargs="+")
    _arg(p, "out", required=True)
    _arg(p, "include-ooxml-embedded", action="store_true")

    p = sub.add_parser("stats", help="score distribution of a results table")
    for name in ("results", "out-dir"):
        _arg(p, name, required=True)
    _arg(p, "bins", type=int, default=20)
    return root


def _detect(spark, a) -> None:
    from epochlens.plans import detect as plan
    from epochlens.sources import audit, bitmaps, extents, mutations

    check_inputs(a.snapshot_path, a.start_epoch, a.end_epoch, a.trusted_manifest, a.end_mount_root)
    scan = ScanConfig(a.width, a.stride, a.chi2_threshold, a.min_expansions, a.max_chi2_var,
                      expand=not a.no_expand, min_gap=a.min_gap_length, block_size=a.block_size)
    cfg = DetectConfig(a.start_epoch, a.end_epoch, a.block_size, a.extent_size, a.cluster_size, scan=scan,
                       media_trust=a.media_trust).validate()
    formats, audit_formats = parse_formats(a.out_formats), parse_formats(a.audit_formats)
    muts = mutations.assert_epochs(mutations.read_mutation_files(spark, a.snapshot_path, a.end_epoch))
    bits = bitmaps.read_bitmaps(spark, a.snapshot_path, a.start_epoch, a.end_epoch)
    ext = extents.read_extents(spark, a.extents)
    manifest = audit.read_manifest(spark, a.trusted_manifest) if a.trusted_manifest else None
    inventory = audit.read_inventory(spark, a.inventory) if a.inventory else None
    totals = Totals() if a.profile else None
    found = plan.detect(muts, bits, ext, cfg, mount_root=a.end_mount_root, manifest=manifest, inventory=inventory, totals=totals)
    plan.write_detection(found, a.output_path, cfg, formats, audit_formats)
    if totals is not None:
        plan.write_profile(found, totals, a.output_path, cfg)
    if a.block_debug:
        out = a.block_debug_outdir or os.path.join(a.output_path, "block_debug")
        plan.compare_with_audit(spark, muts, bits, ext, found, cfg, out,
                                a.block_debug_audit, a.block_debug_path_match)


def _verify(spark, a) -> None:
    from epochlens.operators.verify import verify
    from epochlens.sinks.tables import write_table

    flex = lambda path: spark.read.option("header", True).option("inferSchema", True).csv(path)
    if a.manifest.lower().endswith((".json", ".ndjson", ".jsonl")):
        manifest = spark.read.option("multiLine", a.manifest.lower().endswith(".json")).json(a.manifest)
    else:
        manifest = flex(a.manifest)
    tables = verify(flex(a.suspicious), flex(a.blockmap), manifest, match=a.path_match, epoch=a.epoch,
                    file_prefix=a.file_prefix, default_prefix=a.default_prefix_bytes)
    for df, name in zip(tables, ("summary", "misses", "extras")):
        write_table(df.orderBy(*df.columns[:1]), os.path.join(a.out_dir, name), ("csv",))


def _content(spark, a) -> None:
    from epochlens.plans import content

    windows = {"window": a.window_size, "stride": a.stride, "tail_mode": a.tail_mode}
    options = {
        "entropy": {**windows, "entropy_threshold": a.entropy_threshold},
        "chi2": {**windows, "chi2_threshold": a.chi2_threshold}, "text": windows,
    }.get(a.mode, {})
    if a.mode == "pdf" and a.whitelist:
        options["whitelist"] = content.load_whitelist(spark, a.whitelist)
    print(content.run(spark, a.input_path, a.output_path, a.mode, **options))


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = build_session()
    if a.command == "preprocess":
        from epochlens.plans.preprocess import preprocess
        print(preprocess(spark, a.client, a.output, a.end_epoch, a.device_size,
                         skip_restore=a.skip_restore, force=a.force_overwrite))
    elif a.command == "restore":
        from epochlens.plans.preprocess import restore
        print(restore(spark, a.snapshot_path, a.end_epoch, a.device_size, timestamped=a.timestamped))
    elif a.command == "detect":
        _detect(spark, a)
    elif a.command == "evaluate":
        from epochlens.plans.evaluate import evaluate
        from epochlens.sources.extents import read_extents
        ext = read_extents(spark, a.extents) if a.extents else None
        print(evaluate(spark, a.gt_base, a.mappings_dir, a.out_dir, extents=ext, cluster_size=a.cluster_size,
                       block_size=a.block_size, block_id_col=a.block_id_col))
    elif a.command == "content":
        _content(spark, a)
    elif a.command == "pdf-whitelist":
        from epochlens.plans.content import build_whitelist
        print(build_whitelist(spark, a.input_path, a.output_path))
    elif a.command == "verify":
        _verify(spark, a)
    elif a.command == "manifest":
        from functools import reduce

        from epochlens.operators.manifest import build_manifest
        from epochlens.sources.files import read_files
        files = reduce(lambda x, y: x.unionByName(y), [read_files(spark, p, recursive=True) for p in a.inputs])
        build_manifest(files, a.include_ooxml_embedded).write.mode("overwrite").option("header", True).csv(a.out)
    elif a.command == "stats":
        from pyspark.sql import functions as F

        from epochlens.operators import stats
        from epochlens.sinks.tables import write_table
        rows = spark.read.option("header", True).csv(a.results).withColumn("verdict", F.lower(F.trim("verdict")))
        scored = rows.filter(F.col("verdict").isin("encrypted", "benign", "not_evaluated")).select(
            "verdict", stats.score_of(F.col("mode"), F.col("min_score"), F.col("max_score")).alias("score")
        ).filter("score IS NOT NULL")
        write_table(stats.basic_stats(scored, ["verdict"], "score"), os.path.join(a.out_dir, "stats"), ("csv",))
        write_table(stats.histogram(scored, ["verdict"], "score", a.bins), os.path.join(a.out_dir, "histogram"), ("csv",))


if __name__ == "__main__":
    main()
