"""Evaluation against ground truth: confusion matrices, relabelling and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.functions.paths import nt_path_key
from epochlens.operators.compare import membership

# Patterns that sort reasons into buckets.
BUCKETS = {
    "bkt_metadata_encrypted": "metadata encrypted",
    "bkt_decode_failed": "decode|decompress|unsupported|password|crc|xref|trailer|central dir|directory",
    "bkt_pdf_suspicious": "suspicious regions kept",
    "bkt_media_uniform_valid": "media.*uniform|payload.*uniform.*valid",
}


def confusion_class(truth: Column, flagged: Column) -> Column:
    return (
        F.when(truth & flagged, "TP").when(~truth & ~flagged, "TN")
        .when(~truth & flagged, "FP").otherwise("FN")
    )


def confusion_metrics(df: DataFrame, truth: Column, flagged: Column) -> DataFrame:
    """One row: TP, TN, FP, FN, accuracy, precision, recall, f1 (null where undefined), support."""
    counts = df.agg(
        F.count_if(truth & flagged).alias("tp"), F.count_if(~truth & ~flagged).alias("tn"),
        F.count_if(~truth & flagged).alias("fp"), F.count_if(truth & ~flagged).alias("fn"),
        F.count("*").alias("support"),
    )
    rate = lambda a, b: F.when(b > 0, a / b)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    rated = counts.select(
        "*", rate(tp + tn, F.col("support")).alias("accuracy"),
        rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.select("*", F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1"))


def block_summary(
    universe: DataFrame, device: DataFrame, untrusted: DataFrame, flagged: DataFrame,
    relabelled: DataFrame | None = None,
) -> DataFrame:
    """Ground truth and decision flags per block of the universe. All inputs carry ``block_id``;
    one tagged aggregation replaces a chain of membership joins."""
    sets = {"_u": universe, "gt_device": device, "gt_untrusted": untrusted, "flagged": flagged}
    if relabelled is not None:
        sets["_aug"] = relabelled
    m = membership(sets, ["block_id"]).filter("_u")
    combined = F.col("gt_device") | F.col("gt_untrusted")
    augmented = combined | F.col("_aug") if relabelled is not None else combined
    return m.select(
        "block_id", "gt_device", "gt_untrusted", F.col("gt_device").alias("gt_primary"),
        combined.alias("gt_combined"), augmented.alias("gt_combined_aug"), "flagged",
    )


def last_mapping(rows: DataFrame, order: str) -> DataFrame:
    """(block_id, file_path, byte_offsets): per block the last row in ``order`` that names a path
    or offsets; blank when none does."""
    filled = (F.coalesce("file_path", F.lit("")) != "") | (F.coalesce("byte_offsets", F.lit("")) != "")
    pick = F.max_by(
        F.struct(F.coalesce("file_path", F.lit("")).alias("file_path"),
                 F.coalesce("byte_offsets", F.lit("")).alias("byte_offsets")),
        F.when(filled, F.col(order)),
    )
    return rows.groupBy("block_id").agg(pick.alias("m")).select(
        "block_id", F.coalesce("m.file_path", F.lit("")).alias("file_path"),
        F.coalesce("m.byte_offsets", F.lit("")).alias("byte_offsets"),
    )


def keep_all_files(files: DataFrame) -> DataFrame:
    """Files that were kept whole because their metadata is encrypted."""
    return files.filter(
        F.col("keep_file") & F.lower("fileaware_reason").contains("metadata encrypted")
    ).select("file_path").distinct()


def truthy(text: Column) -> Column:
    return F.lower(F.trim(text.cast("string"))).isin("true", "t", "1", "yes", "y")


def bucket_flags(df: DataFrame, reason: str = "fileaware_reason") -> DataFrame:
    low = F.lower(F.coalesce(reason, F.lit("")))
    return df.withColumns({name: low.rlike(pattern) for name, pattern in BUCKETS.items()})


def bucket_counts(positives: DataFrame, truth: str = "gt_primary") -> DataFrame:
    fp = ~F.col(truth)
    return positives.agg(
        F.count("*").alias("total_positives"),
        F.count_if(F.col(truth)).alias("primary_tp"), F.count_if(fp).alias("primary_fp"),
        *[F.count_if(fp & F.col(b)).alias("primary_fp__" + b[4:]) for b in BUCKETS],
    )


def diagnosis(file_path: Column, in_keep_all: Column, reason: Column) -> Column:
    """Why a false positive survived relabelling."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    return (
        F.when(F.coalesce(file_path, F.lit("")) == "", "no_mapping_for_block")
        .when(in_keep_all, "mapped_to_keep_all_but_not_relabelled")
        .when(low.contains("metadata encrypted"), "reason_says_metadata_encrypted_but_not_in_keep_all")
        .when(low.contains("suspicious regions kept"), "pdf_suspicious_regions_not_whitelisted")
        .otherwise("mapped_non_keep_all_file")
    )


def relabel_sets(summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks that stopped being false positives, blocks that stayed so)."""
    fp = summary.filter(F.col("flagged") & ~F.col("gt_primary")).select("block_id", "gt_combined_aug")
    return (
        fp.filter("gt_combined_aug").select("block_id"),
        fp.filter(~F.col("gt_combined_aug")).select("block_id"),
    )


def diagnose_remaining(
    still_fp: DataFrame, mapping: DataFrame, files: DataFrame, keep_all: DataFrame,
) -> DataFrame:
    normal = keep_all.select(nt_path_key(F.col("file_path")).alias("file_path_norm")).distinct()
    # Repeated decisions of one path would repeat its blocks.
    reasons = files.groupBy("file_path").agg(
        F.max("keep_file").alias("keep_file"), F.max("fileaware_reason").alias("fileaware_reason")
    )
    return (
        still_fp.join(mapping, "block_id", "left")
        .withColumn("file_path_norm", nt_path_key(F.col("file_path")))
        .join(normal.withColumn("_k", F.lit(True)), "file_path_norm", "left")
        .join(reasons, "file_path", "left")
        .select(
            "block_id", "file_path", "file_path_norm", "byte_offsets",
            (F.coalesce("file_path", F.lit("")) != "").alias("has_mapping"),
            F.coalesce("_k", F.lit(False)).alias("in_keep_all_files"),
            "keep_file", "fileaware_reason",
            diagnosis(F.col("file_path"), F.coalesce("_k", F.lit(False)), F.col("fileaware_reason"))
            .alias("diagnosis"),
        )
    )


def count_by(df: DataFrame, column: str, name: str) -> DataFrame:
    """Counts per value in falling order; a null group is kept."""
    return df.groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column)


def file_confusion(universe: DataFrame, truth: DataFrame, alarms: DataFrame) -> DataFrame:
    """(file_path, gt_encrypted, alarm, class) over the universe, on normalised paths."""
    norm = lambda df: df.select(nt_path_key(F.col("file_path")).alias("file_path")).filter("file_path <> ''")
    m = membership(
        {"_u": norm(universe), "gt_encrypted": norm(truth), "alarm": norm(alarms)}, ["file_path"]
    ).filter("_u").drop("_u")
    return m.withColumn("class", confusion_class(F.col("gt_encrypted"), F.col("alarm")))
