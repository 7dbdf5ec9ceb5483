"""Table contracts. Ranges named ``*_inclusive`` include their end; audit ranges are half-open."""

from pyspark.sql import types as T

MUTATION = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("block", T.BinaryType()),
    T.StructField("epoch", T.IntegerType()),
])

MUTATION_FILE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("block", T.ArrayType(T.LongType())),
])

REGION = T.StructType([
    T.StructField("extent_id", T.LongType(), False),
    T.StructField("delta_block_id", T.IntegerType(), False),
    T.StructField("lba_start_block", T.LongType()),
    T.StructField("lba_end_block", T.LongType()),
    T.StructField("byte_start", T.LongType()),
    T.StructField("byte_end_inclusive", T.LongType()),
    T.StructField("block_idx_start", T.IntegerType()),
    T.StructField("block_idx_end", T.IntegerType()),
    T.StructField("block_ids", T.ArrayType(T.LongType())),
    T.StructField("first_block_offset", T.IntegerType()),
    T.StructField("last_block_offset", T.IntegerType()),
    T.StructField("num_blocks", T.IntegerType()),
    T.StructField("chi2_min", T.DoubleType()),
    T.StructField("chi2_max", T.DoubleType()),
    T.StructField("chi2_var", T.DoubleType()),
    T.StructField("chi2_final", T.DoubleType()),
])

MAPPING = T.StructType([
    T.StructField("extent_id", T.LongType(), False),
    T.StructField("block_id", T.LongType(), False),
    T.StructField("file_id", T.IntegerType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("offset_bytes", T.LongType(), False),
    T.StructField("extent_start_block", T.LongType(), False),
    T.StructField("extent_end_block", T.LongType(), False),
])

EPOCH_WINDOW = [
    T.StructField("start_epoch", T.IntegerType()),
    T.StructField("end_epoch", T.IntegerType()),
]

FILE_EXTENT = T.StructType([
    T.StructField("start_block", T.LongType()),
    T.StructField("end_block", T.LongType()),
    T.StructField("file_id", T.IntegerType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_offset_bytes", T.LongType()),
])

AUDIT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("out_target", T.StringType()),
    T.StructField("cipher", T.StringType()),
    T.StructField("ciphertext_sha256", T.StringType()),
    T.StructField("iv_or_nonce_hex", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("actual", T.StructType([
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
    ])),
    T.StructField("_corrupt_record", T.StringType()),
])

MANIFEST_COLUMNS = ["sha256", "source", "container", "entry", "media_ext"]

INVENTORY = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("sha256", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("trusted", T.BooleanType()),
    T.StructField("first_seen_epoch", T.IntegerType()),
    T.StructField("last_seen_epoch", T.IntegerType()),
])

FILE_DECISION = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("keep_file", T.BooleanType()),
    T.StructField("fileaware_reason", T.StringType()),
])

REGION_DECISION = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("keep_region", T.BooleanType()),
    T.StructField("reason", T.StringType()),
])

FILE_VERDICT_COLUMNS = [
    "file_path", "mode", "window_size", "stride", "tail_mode", "file_size", "num_windows",
    "num_suspicious_windows", "ignored_tail_bytes", "score_threshold", "min_score", "max_score",
    "verdict", "note", "error",
]
