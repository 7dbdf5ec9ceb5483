"""Evaluation of a detection run against the block comparisons it wrote."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.operators import evaluate as ev
from epochlens.operators.intervals import map_blocks
from epochlens.session import cut_lineage
from epochlens.sinks.tables import write_json, write_table
from epochlens.sources import audit

UNIVERSE = ["match", "audit_only", "latest_only"]


def _ids(spark: SparkSession, path: str, column: str | None) -> DataFrame:
    empty = spark.createDataFrame([], "block_id bigint")
    if not os.path.isdir(path) or not any(n.endswith(".csv") for n in os.listdir(path)):
        return empty
    df = audit.read_csv(spark, path)
    return audit.block_ids(df, column) if df.columns else empty


def _row(df: DataFrame) -> dict:
    return df.first().asDict()


def evaluate(
    spark: SparkSession, gt_base: str, mappings_dir: str, out: str, *, extents: DataFrame | None = None,
    cluster_size: int = 4096, block_size: int = 512, block_id_col: str | None = None,
) -> dict:
    """Writes summary, metrics, buckets, relabelling and file-level tables; returns the metrics."""
    os.makedirs(out, exist_ok=True)
    parts = [_ids(spark, os.path.join(gt_base, f"cmp_audit_vs_latest_at_end_{s}_csv"), block_id_col) for s in UNIVERSE]
    universe = parts[0].unionByName(parts[1]).unionByName(parts[2])
    if universe.isEmpty():
        raise ValueError(f"no blocks to evaluate under {gt_base}")
    device = _ids(spark, os.path.join(gt_base, "audit_device_blocks_csv"), block_id_col)
    untrusted = _ids(spark, os.path.join(gt_base, "audit_untrusted_immutable_block_mappings_csv"), block_id_col)
    flagged = cut_lineage(audit.decisions_and_mapping(audit.read_csv(spark, mappings_dir, recursive=True), block_id_col))
    mapping = cut_lineage(ev.last_mapping(flagged, "ord"))
    files = cut_lineage(audit.read_file_decisions(spark, audit.decisions_path(mappings_dir)))
    keep_all = ev.keep_all_files(files)
    relabelled = mapping.join(keep_all, "file_path", "left_semi").select("block_id")
    summary = cut_lineage(ev.block_summary(universe, device, untrusted, flagged, relabelled))
    put = lambda df, name: write_table(df, os.path.join(out, name), ("csv",))
    put(summary, "summary_table")

    positives = summary.filter("flagged").select("block_id", "gt_primary").join(mapping, "block_id", "left")
    reasons = files.groupBy("file_path").agg(
        F.max("keep_file").alias("keep_file"), F.max("fileaware_reason").alias("fileaware_reason"))
    buckets = cut_lineage(ev.bucket_flags(positives.join(reasons, "file_path", "left")))
    put(buckets, "positives_buckets")

    measure = lambda gt: _row(ev.confusion_metrics(summary, F.col(gt), F.col("flagged")))
    metrics = {"primary": measure("gt_primary"), "combined": measure("gt_combined_aug"),
               "buckets": _row(ev.bucket_counts(buckets))}
    metrics["fp_reduced_by_relabelling"] = metrics["primary"]["fp"] - metrics["combined"]["fp"]

    for gt, name in (("gt_primary", "primary"), ("gt_combined_aug", "combined")):
        detail = summary.join(mapping, "block_id", "left").withColumn(
            "class", ev.confusion_class(F.col(gt), F.col("flagged")))
        put(detail, f"confusion_details_{name}")

    moved, still = ev.relabel_sets(summary)
    moved = moved.join(mapping, "block_id", "left").join(reasons, "file_path", "left")
    put(moved, "relabel_fp_to_tp_blocks")
    put(ev.count_by(moved, "file_path", "n_blocks"), "relabel_fp_to_tp_by_file")
    why = cut_lineage(ev.diagnose_remaining(still, mapping, files, keep_all))
    put(why, "relabel_fp_still_fp_blocks")
    put(ev.count_by(why, "file_path", "n_blocks"), "relabel_fp_still_fp_by_file")
    put(ev.count_by(why, "diagnosis", "count"), "relabel_fp_still_fp_by_diagnosis")

    if extents is not None:
        own = lambda ids: map_blocks(ids, extents, cluster_size=cluster_size, block_size=block_size)
        classes = cut_lineage(ev.file_confusion(own(universe), own(device), mapping))
        put(classes, "file_level_confusion")
        metrics["file_level"] = _row(ev.confusion_metrics(classes, F.col("gt_encrypted"), F.col("alarm")))
    write_json(os.path.join(out, "metrics.json"), metrics)
    return metrics
