"""Byte windows over file content, and the per-file verdict rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.functions.bytestats import byte_chi2, byte_entropy
from epochlens.functions.ints import floor_div
from epochlens.functions.text import text_score


def window_starts(length: Column, window: int, stride: int, tail_mode: str) -> Column:
    """Start offsets 0, S, 2S, ... of the full windows; ``overlap`` adds one ending at EOF.
    Null when the content is shorter than one window."""
    if tail_mode not in ("ignore", "overlap"):
        raise ValueError(f"unknown tail mode {tail_mode!r}")
    if window <= 0 or stride <= 0:
        raise ValueError("window and stride must be positive")
    last = (length - F.lit(window)).cast("bigint")
    regular = F.sequence(F.lit(0).cast("bigint"), last, F.lit(stride).cast("bigint"))
    if tail_mode == "overlap":
        # The extra window is appended only when the last regular one stops before EOF.
        regular = F.when(last % stride == 0, regular).otherwise(
            F.concat(regular, F.array(last))
        )
    return F.when(length >= window, regular)


def byte_windows(
    df: DataFrame, content: str, window: int, stride: int, tail_mode: str = "ignore",
) -> DataFrame:
    """One row per (file, window): adds ``file_size``, ``window_start`` and ``window_bytes``.
    Files without a full window keep a single row with null window columns. The bytes are cut by a generator of their
    own: as a plain expression they would be cut in the Python step, whose row queue then keeps the file for every window."""
    others = [c for c in df.columns if c != content]
    size = F.length(F.col(content)).cast("bigint")
    cut = F.when(
        F.col("window_start").isNotNull(),
        F.col(content).substr((F.col("window_start") + 1).cast("int"), F.lit(window)),
    )
    return (
        df.select(*others, F.col(content), size.alias("file_size"))
        .select(
            *others, content, "file_size",
            F.explode_outer(window_starts(F.col("file_size"), window, stride, tail_mode))
            .alias("window_start"),
        )
        .select(*others, "file_size", "window_start", F.explode(F.array(cut)).alias("window_bytes"))
    )


def ignored_tail(size: Column, window: int, stride: int, tail_mode: str) -> Column:
    """Bytes after the last full window; the whole file when there is none."""
    if tail_mode == "overlap":
        covered = size
    else:
        covered = floor_div(size - window, stride) * stride + window
    return F.when(size < window, size).otherwise(F.greatest(F.lit(0), size - covered)).cast("bigint")


def rollup_verdicts(
    scored: DataFrame, key: str, *, mode: str, window: int, stride: int, tail_mode: str,
    threshold: float, suspicious: Column, extra_note: Column | None = None,
) -> DataFrame:
    """Any-window rule per file. ``scored`` carries ``file_size``, ``window_start`` and ``score``.
    Windows of one file are produced by one task, so the partial aggregate shrinks the shuffle to
    about one row per file."""
    agg = scored.groupBy(key).agg(
        F.max("file_size").alias("file_size"),
        F.count("window_start").alias("num_windows"),
        F.count_if(F.coalesce(suspicious, F.lit(False))).alias("num_suspicious_windows"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )
    none = F.col("num_windows") == 0
    note = F.when(none, F.lit("file_smaller_than_window"))
    if extra_note is not None:
        note = F.coalesce(extra_note, note)
    return agg.select(
        F.col(key).alias("file_path") if key == "file_path" else F.col(key),
        F.lit(mode).alias("mode"),
        F.lit(window).alias("window_size"),
        F.lit(stride).alias("stride"),
        F.lit(tail_mode).alias("tail_mode"),
        "file_size", "num_windows", "num_suspicious_windows",
        ignored_tail(F.col("file_size"), window, stride, tail_mode).alias("ignored_tail_bytes"),
        F.lit(float(threshold)).alias("score_threshold"),
        "min_score", "max_score",
        F.when(none, "not_evaluated")
        .when(F.col("num_suspicious_windows") > 0, "encrypted")
        .otherwise("benign").alias("verdict"),
        F.coalesce(note, F.lit("")).alias("note"),
        F.lit("").alias("error"),
    )


def judge_content(
    scored: DataFrame, key: str, *, mode: str, window: int, stride: int, tail_mode: str,
    entropy_threshold: float = 7.5, chi2_threshold: float = 10000.0,
) -> DataFrame:
    """Entropy or chi-square verdict for every file out of its scored windows (key, file_size, window_start, score)."""
    threshold = entropy_threshold if mode == "entropy" else chi2_threshold
    hit = F.col("score") >= threshold if mode == "entropy" else F.col("score") <= threshold
    return rollup_verdicts(
        scored, key, mode=mode, window=window, stride=stride, tail_mode=tail_mode,
        threshold=threshold, suspicious=hit,
    )


def content_verdicts(
    df: DataFrame, key: str = "file_path", content: str = "content", *, mode: str = "entropy",
    window: int = 4096, stride: int | None = None, tail_mode: str = "ignore", **thresholds: float,
) -> DataFrame:
    """Windowed entropy or chi-square verdict for every file."""
    stride = stride or window
    if mode not in ("entropy", "chi2"):
        raise ValueError(f"unknown mode {mode!r}")
    windows = byte_windows(df.select(key, content), content, window, stride, tail_mode)
    score = byte_entropy if mode == "entropy" else byte_chi2
    scored = windows.select(key, "file_size", "window_start", score(F.col("window_bytes")).alias("score"))
    return judge_content(scored, key, mode=mode, window=window, stride=stride, tail_mode=tail_mode, **thresholds)


def judge_text(
    scored: DataFrame, key: str, *, window: int, stride: int, tail_mode: str, score_threshold: int = 0,
) -> DataFrame:
    """Text validity verdict for every file out of its scored windows: a window is suspicious when no supported encoding
    reads it as text and it has more UTF-8 errors than the threshold."""
    verdict = rollup_verdicts(
        scored, key, mode="txt_fav", window=window, stride=stride, tail_mode=tail_mode,
        threshold=score_threshold, suspicious=F.col("score") > score_threshold,
        extra_note=F.when(F.col("file_size") == 0, F.lit("empty_file"))
        .when(F.col("num_suspicious_windows") > 0, F.lit("has_suspicious_windows")),
    )
    clean_tail = (F.col("verdict") == "benign") & (F.col("ignored_tail_bytes") > 0)
    return verdict.withColumn(
        "note",
        F.when(clean_tail, F.lit("tail_ignored_but_windows_all_valid")).otherwise(F.col("note")),
    )


def text_verdicts(
    df: DataFrame, key: str = "file_path", content: str = "content", *, window: int = 4096,
    stride: int | None = None, tail_mode: str = "ignore", score_threshold: int = 0,
) -> DataFrame:
    """Windowed text validity verdict of whole contents."""
    stride = stride or window
    windows = byte_windows(df.select(key, content), content, window, stride, tail_mode)
    scored = windows.select(key, "file_size", "window_start", text_score(F.col("window_bytes")).alias("score"))
    return judge_text(scored, key, window=window, stride=stride, tail_mode=tail_mode, score_threshold=score_threshold)
