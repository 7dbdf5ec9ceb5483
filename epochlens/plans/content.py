"""Stand-alone verdicts for directories of files."""

from __future__ import annotations

import os
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens import schemas
from epochlens.formats.ooxml import OoxmlConfig, ooxml_verdicts
from epochlens.formats.pdf import PdfConfig, flatten_whitelist, pdf_verdicts, stream_whitelist, whitelist_json
from epochlens.formats.zip import ZipConfig, zip_verdicts
from epochlens.operators import chunked
from epochlens.operators.windows import content_verdicts, text_verdicts
from epochlens.sinks.tables import new_run_dir, score_text
from epochlens.sources.chunks import read_chunks
from epochlens.sources.files import read_files, require_path


def unified(df: DataFrame, mode: str) -> DataFrame:
    """The common result columns for validators that have no windows."""
    extra = {"mode": F.lit(mode), "window_size": F.lit(4096), "stride": F.lit(4096), "tail_mode": F.lit("ignore"),
             "score_threshold": F.lit(0), "error": F.lit(""), "ignored_tail_bytes": F.lit(None).cast("bigint")}
    full = df.withColumns({k: v for k, v in extra.items() if k not in df.columns})
    return full.select(*schemas.FILE_VERDICT_COLUMNS)


def verdicts(files: DataFrame, mode: str, **options) -> DataFrame:
    if mode in ("entropy", "chi2"):
        return content_verdicts(files, mode=mode, **options)
    if mode == "text":
        return text_verdicts(files, **options)
    if mode == "zip":
        return unified(zip_verdicts(files, ZipConfig(**options)), "zip_fav")
    if mode == "ooxml":
        return unified(ooxml_verdicts(files, OoxmlConfig(**options)), "ooxml_fav")
    if mode == "pdf":
        whitelist = options.pop("whitelist", None)
        return unified(pdf_verdicts(files, PdfConfig(**options), whitelist), "pdf_fav")
    raise ValueError(f"unknown mode {mode!r}")


def chunk_verdicts(spark: SparkSession, path: str, mode: str, **options) -> DataFrame:
    """Window verdicts of files of any size: they are read in chunks with the rest of the last window behind each."""
    chunks = read_chunks(spark, path, halo=options.get("window", 4096) - 1)
    return chunked.text_verdicts(chunks, **options) if mode == "text" else chunked.content_verdicts(chunks, mode=mode, **options)


def run(spark: SparkSession, path: str, out: str, mode: str, **options) -> str:
    """Verdicts of a file or flat directory, written into a new run directory."""
    require_path(path)
    told = {k: asdict(v) if is_dataclass(v) else v for k, v in options.items() if not isinstance(v, DataFrame)}
    folder = new_run_dir(out, mode, {"input": path, "mode": mode, **told})
    windowed = mode in ("entropy", "chi2", "text")
    result = chunk_verdicts(spark, path, mode, **options) if windowed else verdicts(read_files(spark, path), mode, **options)
    if mode in ("entropy", "chi2"):
        result = score_text(result)
    result.write.mode("overwrite").option("header", True).csv(os.path.join(folder, "results.csv"))
    return folder


def build_whitelist(spark: SparkSession, path: str, out: str) -> str:
    """Stream whitelist of a file or directory as JSON lines, one per PDF."""
    flat = stream_whitelist(read_files(spark, require_path(path)).filter(F.lower("file_path").endswith(".pdf")))
    target = os.path.join(new_run_dir(out, "pdf-whitelist", {"input": path, "hash": "sha256"}), "pdf_stream_whitelist.json")
    whitelist_json(flat).write.mode("overwrite").json(target)
    return target


def load_whitelist(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.json(path)
    entries = df.select(F.inline("entries")) if "entries" in df.columns else df
    return flatten_whitelist(entries)
