"""Byte statistics as Arrow column functions.

Each function sees whole Arrow batches and works on the flat value buffer, so there is no per-row
Python call: one ``bincount`` yields the histograms of every row of a slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

_SLICE_BYTES = 2 * 1024 * 1024
_SLICE_ROWS = 4096

_TAB_LF_CR = [9, 10, 13]
PRINTABLE_STRICT = np.zeros(256, dtype=bool)  # 32..126 and tab, line feed, carriage return
PRINTABLE_STRICT[32:127] = True
PRINTABLE_STRICT[_TAB_LF_CR] = True
PRINTABLE_LOOSE = np.zeros(256, dtype=bool)  # 32..126 and 9..13
PRINTABLE_LOOSE[32:127] = True
PRINTABLE_LOOSE[9:14] = True
TOKENS = np.zeros(256, dtype=bool)  # structure bytes of markup, code and tables
TOKENS[list(b"{}[]()<>=/,:;\"' \t\r\n")] = True
ANGLES = np.zeros(256, dtype=bool)
ANGLES[list(b"<>")] = True
CONTROLS = np.zeros(256, dtype=bool)  # below 32 without tab, line feed, carriage return; and 127
CONTROLS[:32] = True
CONTROLS[_TAB_LF_CR] = False
CONTROLS[127] = True
CLASSES = {
    "printable": PRINTABLE_STRICT, "printable_loose": PRINTABLE_LOOSE, "tokens": TOKENS,
    "angles": ANGLES, "controls": CONTROLS,
}

COUNTERS = ["n", "sum_sq", *CLASSES, "distinct", "peak"]
STATS_TYPE = T.StructType(
    [T.StructField(c, T.LongType()) for c in COUNTERS]
    + [T.StructField("chi2", T.DoubleType()), T.StructField("entropy", T.DoubleType())]
)


def flat_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Value buffer and row offsets of a binary array, without copying."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type)
    buffers = arr.buffers()
    off = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)
    off = off[arr.offset: arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data, off


def _slices(off: np.ndarray):
    """Row ranges holding at most a few megabytes each (or one single larger row)."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + _SLICE_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + _SLICE_ROWS, n)
        yield lo, hi
        lo = hi


def histograms(data: np.ndarray, off: np.ndarray):
    """Yield (lo, hi, counts[rows, 256]) per slice."""
    for lo, hi in _slices(off):
        lens = np.diff(off[lo: hi + 1])
        part = data[off[lo]: off[hi]]
        if hi - lo == 1:
            yield lo, hi, np.bincount(part, minlength=256).reshape(1, 256)
            continue
        row = np.repeat(np.arange(hi - lo, dtype=np.int64) * 256, lens)
        yield lo, hi, np.bincount(row + part, minlength=256 * (hi - lo)).reshape(-1, 256)


def chi2_of(sum_sq: np.ndarray, n: np.ndarray) -> np.ndarray:
    safe = np.maximum(n, 1)
    return np.where(n > 0, 256.0 * (sum_sq / safe) - n, 0.0)


def entropies(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    p = counts / np.maximum(n, 1)[:, None]
    logs = np.zeros_like(p)
    np.log2(p, out=logs, where=p > 0)
    return np.abs((p * logs).sum(axis=1))


def stats_of_counts(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of histograms, one row of 256 counts each."""
    n = counts.sum(axis=1)
    out = {"n": n, "sum_sq": (counts * counts).sum(axis=1), "entropy": entropies(counts, n),
           "distinct": (counts > 0).sum(axis=1), "peak": counts.max(axis=1, initial=0)}
    out |= {name: counts[:, table].sum(axis=1) for name, table in CLASSES.items()}
    return out | {"chi2": chi2_of(out["sum_sq"], n)}


def stats_of(arr: pa.Array) -> dict[str, np.ndarray]:
    data, off = flat_bytes(arr)
    rows = len(off) - 1
    n = np.diff(off)
    out = {c: np.zeros(rows, np.int64) for c in COUNTERS} | {"n": n, "entropy": np.zeros(rows), "chi2": np.zeros(rows)}
    for lo, hi, counts in histograms(data, off):
        for name, values in stats_of_counts(counts).items():
            out[name][lo:hi] = values
    return out


def _null_mask(arr: pa.Array) -> np.ndarray:
    return arr.is_null().to_numpy(zero_copy_only=False)


@arrow_udf(returnType=T.DoubleType())
def _chi2_udf(arr: pa.Array) -> pa.Array:
    data, off = flat_bytes(arr)
    sum_sq = np.zeros(len(off) - 1, np.int64)
    for lo, hi, counts in histograms(data, off):
        sum_sq[lo:hi] = (counts * counts).sum(axis=1)
    return pa.array(chi2_of(sum_sq, np.diff(off)), mask=_null_mask(arr))


@arrow_udf(returnType=T.DoubleType())
def _entropy_udf(arr: pa.Array) -> pa.Array:
    data, off = flat_bytes(arr)
    n = np.diff(off)
    ent = np.zeros(len(n))
    for lo, hi, counts in histograms(data, off):
        ent[lo:hi] = entropies(counts, n[lo:hi])
    return pa.array(ent, mask=_null_mask(arr))


@arrow_udf(returnType=STATS_TYPE)
def _stats_udf(arr: pa.Array) -> pa.Array:
    s = stats_of(arr)
    names = [*COUNTERS, "chi2", "entropy"]
    return pa.StructArray.from_arrays([pa.array(s[k]) for k in names], names, mask=arr.is_null())


def byte_chi2(content: Column) -> Column:
    """Raw Pearson statistic against uniform bytes; 0 for empty input."""
    return _chi2_udf(content)


def byte_chi2_open(content: Column) -> Column:
    """The same statistic with +infinity for empty input (format-aware rules)."""
    return F.when(F.length(content) == 0, F.lit(float("inf"))).otherwise(_chi2_udf(content))


def byte_entropy(content: Column) -> Column:
    """Shannon entropy in bits per byte."""
    return _entropy_udf(content)


def byte_stats(content: Column) -> Column:
    """All histogram statistics in one pass over the batch."""
    return _stats_udf(content)


def printable_ratio(stats: Column, empty: float = 0.0, loose: bool = False) -> Column:
    good = stats["printable_loose"] if loose else stats["printable"]
    return F.when(stats["n"] == 0, F.lit(empty)).otherwise(good / stats["n"])


def zero_block(size: int) -> Column:
    return F.unhex(F.repeat(F.lit("00"), size))


def utf8_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def register(spark) -> None:
    """SQL names for the kernels."""
    spark.udf.register("byte_chi2", _chi2_udf)
    spark.udf.register("byte_entropy", _entropy_udf)
    spark.udf.register("byte_stats", _stats_udf)
