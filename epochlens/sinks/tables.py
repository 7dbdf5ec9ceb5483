"""Result tables and JSON summaries."""

from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_view(df: DataFrame) -> DataFrame:
    """CSV cannot hold nested values: arrays and structs become JSON text."""
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def write_table(df: DataFrame, base: str, formats=("parquet",)) -> None:
    """``<base>.parquet`` and/or ``<base>_csv``. Partitioning is left to the plan that made the
    rows; AQE has sized it."""
    if "parquet" in formats:
        df.write.mode("overwrite").parquet(f"{base}.parquet")
    if "csv" in formats:
        (csv_view(df).write.mode("overwrite").option("header", True)
         .option("maxRecordsPerFile", 200_000).csv(f"{base}_csv"))


def write_deltas_csv(deltas: DataFrame, path: str) -> None:
    """Semicolon-separated deltas with base64 bytes and JSON block ids."""
    deltas.select(
        "extent_id", "delta_block_id", "delta_block_size", "aggreg_block_id",
        F.base64("f_diff").alias("f_diff"), F.to_json("block_ids").alias("block_ids"),
        "start_offset", "end_offset",
    ).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def score_text(df: DataFrame, columns=("min_score", "max_score", "score_threshold")) -> DataFrame:
    """Scores as text with four decimals, blank where absent."""
    return df.withColumns({
        c: F.coalesce(F.format_string("%.4f", F.col(c).cast("double")), F.lit("")) for c in columns
        if c in df.columns
    }).withColumns({
        c: F.when(F.col(c) == "null", "").otherwise(F.col(c)) for c in columns if c in df.columns
    })


def write_json(path: str, value) -> None:
    """Small driver-side summary, replaced atomically."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    draft = f"{path}.tmp"
    with open(draft, "w", encoding="utf-8") as fh:
        json.dump(value, fh, indent=2, sort_keys=True)
        fh.flush()
        os.fsync(fh.fileno())
    os.replace(draft, path)


def new_run_dir(root: str, mode: str, config: dict) -> str:
    """``run_<time>_mode-<mode>`` with its configuration."""
    run = os.path.join(root, f"run_{datetime.now():%Y%m%d-%H%M%S}_mode-{mode}")
    os.makedirs(run, exist_ok=True)
    write_json(os.path.join(run, "config.json"), config)
    return run
