"""Text validity as Arrow column functions over whole batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from epochlens.functions.batches import row_slices
from epochlens.functions.bytestats import flat_bytes, histograms

# Punctuation that counts as text next to letters, digits and white space.
TEXT_PUNCTUATION = ".,;:!?-_/\\'\"()[]{}<>@#$%^&*+=|"
# Share of text-like characters an encoding must exceed.
UNICODE_SHARE = 0.80
CP1252_SHARE = 0.85
# UTF-16 sniffing looks at this prefix and needs this share of zero bytes in one
# parity, and that many times the share of the other parity.
UTF16_PREFIX = 512
UTF16_ZERO_SHARE = 0.3
UTF16_DOMINANCE = 1.5

_good_codepoint: np.ndarray | None = None


def _textlike() -> np.ndarray:
    """Lookup by code point, built once per worker."""
    global _good_codepoint
    if _good_codepoint is None:
        table = np.zeros(0x110000, dtype=bool)
        for cp in range(0x110000):
            ch = chr(cp)
            table[cp] = ch.isalnum() or ch.isspace()
        table[[ord(c) for c in TEXT_PUNCTUATION]] = True
        _good_codepoint = table
    return _good_codepoint


def utf8_lead_lengths(data: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Length of the well-formed UTF-8 sequence starting at each byte, 0 where none starts.
    ``room`` is the number of bytes left in the row."""
    pad = np.concatenate([data, np.zeros(3, np.uint8)])
    b0, b1, b2, b3 = pad[:-3], pad[1:-2], pad[2:-1], pad[3:]
    tail1 = (b1 & 0xC0) == 0x80
    tail2 = (b2 & 0xC0) == 0x80
    tail3 = (b3 & 0xC0) == 0x80
    length = (b0 < 0x80).astype(np.int8)
    length[(b0 >= 0xC2) & (b0 <= 0xDF) & tail1 & (room >= 2)] = 2
    # The second byte excludes overlong forms (E0, F0), surrogates (ED) and values past U+10FFFF.
    second3 = tail1 & ~((b0 == 0xE0) & (b1 < 0xA0)) & ~((b0 == 0xED) & (b1 > 0x9F))
    length[(b0 >= 0xE0) & (b0 <= 0xEF) & second3 & tail2 & (room >= 3)] = 3
    second4 = tail1 & ~((b0 == 0xF0) & (b1 < 0x90)) & ~((b0 == 0xF4) & (b1 > 0x8F))
    length[(b0 >= 0xF0) & (b0 <= 0xF4) & second4 & tail2 & tail3 & (room >= 4)] = 4
    return length


def _utf8_scan(data: np.ndarray, off: np.ndarray):
    lens = np.diff(off)
    row = np.repeat(np.arange(lens.size), lens)
    room = off[1:][row] - np.arange(off[0], off[-1])
    return row, utf8_lead_lengths(data[off[0]: off[-1]], room)


def utf8_errors(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Errors per row when a strict decoder resumes one byte after each error. Well-formed
    sequences never overlap, so every byte outside them is one error. Rows are taken in slices, as a scan holds many
    times their bytes."""
    errors = np.diff(off)
    for lo, hi in row_slices(errors):
        row, length = _utf8_scan(data, off[lo: hi + 1])
        errors[lo:hi] -= np.bincount(row, weights=length, minlength=hi - lo).astype(np.int64)
    return errors


def _codepoints(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    pad = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    b0, b1, b2, b3 = pad[at], pad[at + 1] & 63, pad[at + 2] & 63, pad[at + 3] & 63
    return np.choose(
        length - 1,
        [
            b0,
            ((b0 & 31) << 6) | b1,
            ((b0 & 15) << 12) | (b1 << 6) | b2,
            ((b0 & 7) << 18) | (b1 << 12) | (b2 << 6) | b3,
        ],
    )


def utf16_guess(raw: bytes) -> str:
    """``utf-16-le``, ``utf-16-be`` or an empty string, from a byte order mark or zero bytes."""
    if len(raw) < 4:
        return ""
    if raw[:2] == b"\xff\xfe":
        return "utf-16-le"
    if raw[:2] == b"\xfe\xff":
        return "utf-16-be"
    head = np.frombuffer(raw[:UTF16_PREFIX], np.uint8)
    even = float((head[0::2] == 0).mean())
    odd = float((head[1::2] == 0).mean())
    if odd > UTF16_ZERO_SHARE and odd > even * UTF16_DOMINANCE:
        return "utf-16-le"
    if even > UTF16_ZERO_SHARE and even > odd * UTF16_DOMINANCE:
        return "utf-16-be"
    return ""


def _utf16_is_text(raw: bytes) -> bool:
    name = utf16_guess(raw)
    if not name:
        return False
    try:
        wide = raw.decode(name).encode("utf-32-le")
    except UnicodeDecodeError:
        return False
    good = _textlike()[np.frombuffer(wide, np.uint32)]
    return bool(good.size and good.mean() > UNICODE_SHARE)


def _cp1252_tables():
    good = np.zeros(256, bool)
    undefined = np.zeros(256, bool)
    for b in range(256):
        try:
            good[b] = _textlike()[ord(bytes([b]).decode("cp1252"))]
        except UnicodeDecodeError:
            undefined[b] = True
    return good, undefined


def text_scores(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """0 for rows that read as text in UTF-8, UTF-16 or CP1252, else their UTF-8 error count."""
    parts = [_slice_scores(data, off[lo: hi + 1]) for lo, hi in row_slices(np.diff(off))]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _slice_scores(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = np.diff(off)
    errors = utf8_errors(data, off)
    row, length = _utf8_scan(data, off)
    at = np.flatnonzero(length)
    cps = _codepoints(data[off[0]: off[-1]], at, length[at].astype(np.int64))
    chars = np.bincount(row[at], minlength=n.size)
    good = np.bincount(row[at], weights=_textlike()[cps], minlength=n.size)
    plain = (errors == 0) & (n > 0) & (good > UNICODE_SHARE * chars)
    good1252, undefined = _cp1252_tables()
    for lo, hi, counts in histograms(data, off):
        share = counts[:, good1252].sum(axis=1)
        whole = counts[:, undefined].sum(axis=1) == 0
        plain[lo:hi] |= whole & (n[lo:hi] > 0) & (share > CP1252_SHARE * n[lo:hi])
    for i in np.flatnonzero(~plain & (n >= 4)):
        plain[i] = _utf16_is_text(data[off[i]: off[i + 1]].tobytes())
    return np.where(plain, 0, errors)


def _masked(arr: pa.Array, values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=arr.is_null().to_numpy(zero_copy_only=False))


@arrow_udf(returnType=T.LongType())
def _utf8_errors_udf(arr: pa.Array) -> pa.Array:
    return _masked(arr, utf8_errors(*flat_bytes(arr)))


@arrow_udf(returnType=T.LongType())
def _text_score_udf(arr: pa.Array) -> pa.Array:
    return _masked(arr, text_scores(*flat_bytes(arr)))


@arrow_udf(returnType=T.LongType())
def _utf8_covered_udf(arr: pa.Array, own: pa.Array) -> pa.Array:
    data, off = flat_bytes(arr)
    limit = own.to_numpy(zero_copy_only=False).astype(np.int64)
    covered = np.zeros(len(arr), np.int64)
    for lo, hi in row_slices(np.diff(off)):
        part = off[lo: hi + 1]
        row, length = _utf8_scan(data, part)
        mine = np.arange(part[0], part[-1]) - part[:-1][row] < limit[lo:hi][row]
        covered[lo:hi] = np.bincount(row[mine], weights=length[mine], minlength=hi - lo)
    return _masked(arr, covered)


def utf8_covered(content: Column, own: Column) -> Column:
    """Bytes that well-formed UTF-8 sequences cover which start in the first ``own`` bytes; they may reach further."""
    return _utf8_covered_udf(content, own)


def utf8_error_count(content: Column) -> Column:
    return _utf8_errors_udf(content)


def text_score(content: Column) -> Column:
    return _text_score_udf(content)


def register(spark) -> None:
    spark.udf.register("utf8_error_count", _utf8_errors_udf)
    spark.udf.register("text_score", _text_score_udf)
