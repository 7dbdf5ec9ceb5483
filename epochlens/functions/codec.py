"""Decompression as Arrow column functions. Each call is one library call per value."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from epochlens.functions.bytestats import STATS_TYPE, stats_of_counts

CHUNK = 1 << 20

INFLATED = T.StructType([
    T.StructField("size", T.LongType()),
    T.StructField("crc", T.LongType()),
    T.StructField("why", T.StringType()),
])


CONTENT = T.StructType([
    T.StructField("size", T.LongType()),
    T.StructField("head", T.BinaryType()),
    T.StructField("sha256", T.StringType()),
    T.StructField("s", STATS_TYPE),
])


GZIP = 31
GZIP_MAGIC = b"\x1f\x8b"


def inflated(data: bytes, bits: int, complete: bool = False) -> Iterator[bytes]:
    """Decompressed output in pieces of at most ``CHUNK`` bytes. A value that ends early gives what it holds, or an
    error if it has to be ``complete``. Gzip members that follow one another are one value; zero bytes may pad them."""
    engine, view, at = zlib.decompressobj(bits), memoryview(data), 0
    while at < len(view):
        rest = view[at: at + CHUNK]
        at += len(rest)
        while not engine.eof:
            out = engine.decompress(rest, CHUNK)
            if out:
                yield out
            rest = engine.unconsumed_tail
            if not rest and len(out) < CHUNK:
                break
        if engine.eof:
            at -= len(engine.unused_data)
            while bits == GZIP and at < len(view) and not view[at]:
                at += 1
            if bits != GZIP or view[at: at + 2] != GZIP_MAGIC:
                return
            engine = zlib.decompressobj(bits)
    if complete and not engine.eof:
        raise zlib.error("incomplete stream")


@arrow_udf(returnType=INFLATED)
def _measure(data: pa.Array) -> pa.Array:
    size, crc, why = [], [], []
    for value in data:
        raw = value.as_py()
        n, total, reason = (None, None, None) if raw is None else (0, 0, "")
        try:
            for out in inflated(raw or b"", -15):
                n, total = n + len(out), zlib.crc32(out, total)
        except zlib.error:
            n, total, reason = None, None, "inflate_error"
        size.append(n)
        crc.append(total)
        why.append(reason)
    return pa.StructArray.from_arrays(
        [pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(why, pa.string())],
        ["size", "crc", "why"],
    )


@arrow_udf(returnType=T.BinaryType())
def _unpack(data: pa.Array, window: pa.Array) -> pa.Array:
    out = []
    for value, bits in zip(data, window):
        raw = value.as_py()
        try:
            out.append(None if raw is None else b"".join(inflated(raw, bits.as_py())))
        except zlib.error:
            out.append(None)
    return pa.array(out, pa.binary())


@arrow_udf(returnType=CONTENT)
def _content(data: pa.Array, deflated: pa.Array) -> pa.Array:
    rows, counts = [], np.zeros((len(data), 256), np.int64)
    for i, (value, packed) in enumerate(zip(data, deflated)):
        raw, digest, head, size = value.as_py() or b"", hashlib.sha256(), b"", 0
        try:
            for out in inflated(raw, -15) if packed.as_py() else (raw[a: a + CHUNK] for a in range(0, len(raw), CHUNK)):
                digest.update(out)
                head, size = (head + out[:8])[:8], size + len(out)
                counts[i] += np.bincount(np.frombuffer(out, np.uint8), minlength=256)
        except zlib.error:
            digest, head, size, counts[i] = hashlib.sha256(), b"", 0, 0
        rows.append((size, head, digest.hexdigest()))
    stats = stats_of_counts(counts)
    s = pa.StructArray.from_arrays([pa.array(stats[k]) for k in STATS_TYPE.names], STATS_TYPE.names)
    size, head, sha = zip(*rows) if rows else ((), (), ())
    return pa.StructArray.from_arrays(
        [pa.array(size, pa.int64()), pa.array(head, pa.binary()), pa.array(sha, pa.string()), s], CONTENT.names)


@arrow_udf(returnType=T.LongType())
def _packed(data: pa.Array, level: pa.Array) -> pa.Array:
    return pa.array(
        [None if v.as_py() is None else len(zlib.compress(v.as_py(), k.as_py())) for v, k in zip(data, level)],
        pa.int64(),
    )


def packed_size(data: Column, level: int = 6) -> Column:
    """Size after zlib compression."""
    return _packed(data, F.lit(level))


def inflate_facts(data: Column) -> Column:
    """struct(size, crc, why) of a raw DEFLATE value, measured piece by piece; the output itself is never held."""
    return _measure(data)


def content_facts(data: Column, deflated: Column) -> Column:
    """struct(size, head, sha256, s) of a stored or raw DEFLATE value, whole, piece by piece: its size, first eight
    bytes, hash and byte statistics. Broken DEFLATE data count as empty."""
    return _content(data, deflated)


def inflate(data: Column) -> Column:
    """Raw DEFLATE output, null on error."""
    return _unpack(data, F.lit(-15))


def zlib_inflate(data: Column) -> Column:
    return _unpack(data, F.lit(15))


def gunzip(data: Column) -> Column:
    return _unpack(data, F.lit(GZIP))
