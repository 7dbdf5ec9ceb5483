"""Verdicts over chunk rows (file_path, chunk, start, size, bytes, file_size), for files of any size.

Every window and every character belongs to the chunk in which it starts; the halo behind a chunk holds the bytes it
needs from the next one. So a chunk is judged alone, no content is moved, and only counts are rolled up per file.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.functions.bytestats import chi2_of, entropies, histograms
from epochlens.functions.ints import ceil_div, floor_div
from epochlens.functions.text import text_scores, utf8_covered
from epochlens.operators import windows as whole

SLICE_BYTES = 2 << 20
LOOKAHEAD = 3  # bytes of a UTF-8 sequence behind its first


def cut_chunks(files: DataFrame, chunk: int, halo: int = 0, content: str = "content") -> DataFrame:
    """Chunk rows of a table of contents."""
    size = F.length(content).cast("bigint")
    last = F.greatest(ceil_div(size, chunk) - 1, F.lit(0).cast("bigint"))
    rows = files.select("file_path", content, size.alias("file_size"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk"))
    start = F.col("chunk") * chunk
    return rows.select(
        "file_path", "chunk", start.alias("start"), F.least(F.lit(chunk), F.col("file_size") - start).cast("bigint").alias("size"),
        F.col(content).substr((start + 1).cast("int"), F.lit(chunk + halo)).alias("bytes"), "file_size")


def _window_starts(start: int, size: int, file_size: int, window: int, stride: int, tail_mode: str) -> np.ndarray:
    """Offsets of the windows that start in a chunk; ``overlap`` adds one that ends with the file."""
    last = file_size - window
    starts = np.arange(-(-start // stride) * stride, min(start + size - 1, last) + 1, stride, dtype=np.int64)
    if tail_mode == "overlap" and last >= 0 and last % stride and start <= last < start + size:
        starts = np.append(starts, last)
    return starts


SCORES = {
    "entropy": lambda data, off: np.concatenate([entropies(counts, counts.sum(axis=1)) for _, _, counts in histograms(data, off)]),
    "chi2": lambda data, off: np.concatenate([chi2_of((counts * counts).sum(axis=1), counts.sum(axis=1)) for _, _, counts in histograms(data, off)]),
    "text": lambda data, off: text_scores(data, off).astype(np.float64),
}


def window_scores(chunks: DataFrame, kind: str, window: int, stride: int, tail_mode: str = "ignore") -> DataFrame:
    """(file_path, file_size, window_start, score) of every window, in the chunk where it starts; a chunk in which none
    starts keeps one row with nulls. The halo must hold ``window - 1`` bytes. Windows are cut in slices of bounded size."""
    if tail_mode not in ("ignore", "overlap"):
        raise ValueError(f"unknown tail mode {tail_mode!r}")
    if window <= 0 or stride <= 0:
        raise ValueError("window and stride must be positive")
    score, per_slice = SCORES[kind], max(1, SLICE_BYTES // window)

    def judge(batches):
        for batch in batches:
            names, sizes = batch.column("file_path"), batch.column("file_size").to_numpy()
            for i, (at, size, body) in enumerate(zip(batch.column("start").to_pylist(), batch.column("size").to_pylist(), batch.column("bytes"))):
                data = np.frombuffer(body.as_buffer() or b"", np.uint8)
                starts = _window_starts(at, size, int(sizes[i]), window, stride, tail_mode)
                if len(starts) and starts[-1] - at + window > len(data):
                    raise ValueError(f"the chunks' halo is too short for windows of {window} bytes")
                values = [np.empty(0)]
                for low in range(0, len(starts), per_slice):
                    own = starts[low:low + per_slice] - at
                    cut = np.lib.stride_tricks.sliding_window_view(data, window)[own].ravel()
                    values.append(score(cut, np.arange(len(own) + 1) * window))
                n = max(1, len(starts))
                yield pa.RecordBatch.from_arrays([
                    names.take(pa.array(np.full(n, i))), pa.array(np.full(n, sizes[i])), pa.array(starts) if len(starts) else pa.nulls(1, pa.int64()),
                    pa.array(np.concatenate(values)) if len(starts) else pa.nulls(1, pa.float64()),
                ], names=["file_path", "file_size", "window_start", "score"])

    key = chunks.schema["file_path"].dataType.simpleString()
    return chunks.select("file_path", "start", "size", "bytes", "file_size").mapInArrow(
        judge, f"file_path {key}, file_size bigint, window_start bigint, score double")


def content_verdicts(chunks: DataFrame, *, mode: str = "entropy", window: int = 4096, stride: int | None = None,
                     tail_mode: str = "ignore", **thresholds: float) -> DataFrame:
    stride = stride or window
    if mode not in ("entropy", "chi2"):
        raise ValueError(f"unknown mode {mode!r}")
    scored = window_scores(chunks, mode, window, stride, tail_mode)
    return whole.judge_content(scored, "file_path", mode=mode, window=window, stride=stride, tail_mode=tail_mode, **thresholds)


def text_verdicts(chunks: DataFrame, *, window: int = 4096, stride: int | None = None, tail_mode: str = "ignore",
                  score_threshold: int = 0) -> DataFrame:
    stride = stride or window
    scored = window_scores(chunks, "text", window, stride, tail_mode).withColumn("score", F.col("score").cast("bigint"))
    return whole.judge_text(scored, "file_path", window=window, stride=stride, tail_mode=tail_mode, score_threshold=score_threshold)


def range_pieces(ranges: DataFrame, chunk: int) -> DataFrame:
    """(file_path, start, end, chunk): inclusive ranges, once for each chunk they touch."""
    low = floor_div(F.greatest("start", F.lit(0)), chunk)
    pieces = F.when(F.col("end") >= F.col("start"), F.sequence(low, floor_div(F.col("end"), chunk)))
    return ranges.select("file_path", "start", "end", F.explode(pieces).alias("chunk"))


def text_range_decisions(ranges: DataFrame, load: Callable[[DataFrame], DataFrame], trusted_files: DataFrame, chunk: int) -> DataFrame:
    """Range decisions for text files of any size, over whole ranges. ``load`` gives the chunks (with a halo of
    ``LOOKAHEAD`` bytes) of the (file_path, chunk) it is handed; ``trusted_files`` has (file_path). Well-formed
    characters never overlap, so what no character covers is an error, and both add up over the chunks of a range."""
    pieces = range_pieces(ranges, chunk)
    chunks = load(pieces.select("file_path", "chunk").distinct()).withColumnRenamed("start", "at")
    joined = pieces.join(chunks, ["file_path", "chunk"])
    low = F.greatest("start", "at")
    high = F.least("end", F.col("at") + F.col("size") - 1)
    ahead = F.least("end", F.col("file_size") - 1, high + LOOKAHEAD)
    own = F.greatest(high - low + 1, F.lit(0).cast("bigint"))
    body = F.col("bytes").substr((low - F.col("at") + 1).cast("int"), F.greatest(ahead - low + 1, F.lit(0)).cast("int"))
    counted = joined.select("file_path", "start", "end", own.alias("own"), utf8_covered(body, own).alias("covered"))
    sums = counted.groupBy("file_path", "start", "end").agg(F.sum("own").alias("n"), F.sum("covered").alias("covered"))
    known = trusted_files.select("file_path").distinct().withColumn("_known", F.lit(True))
    j = ranges.join(sums, ["file_path", "start", "end"], "left").join(known, "file_path", "left")
    trusted, blank = F.col("_known").isNotNull(), F.coalesce("n", F.lit(0)) == 0
    errors = F.coalesce(F.col("n") - F.col("covered"), F.lit(0))
    return j.select(
        "file_path", "start", "end", F.lit("text").alias("handler"), (~trusted & (blank | (errors > 0))).alias("keep_region"),
        text_reason(trusted, blank, errors).alias("reason"), F.when(trusted, "text: trusted (sha256)").alias("file_reason"))


def text_reason(trusted: Column, blank: Column, errors: Column) -> Column:
    return (
        F.when(trusted, F.lit("text: trusted (sha256)")).when(blank, F.lit("text: unreadable; escalate"))
        .when(errors > 0, F.concat(F.lit("text: invalid UTF-8 in region ("), errors.cast("string"), F.lit(" errors)")))
        .otherwise("text: UTF-8 plaintext-like")
    )
