"""Lexical helpers for PDF bytes: string operands, zones outside streams, embedded zlib data."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

TOKEN = re.compile(rb"%[^\r\n]*|<<|<[^>]*>|\(")
PAREN = re.compile(rb"\\.|[()]", re.DOTALL)
INLINE_IMAGE = re.compile(rb"\bBI\b.*?\bID\b.*?\bEI\b", re.DOTALL)
HIGH = re.compile(rb"[\x80-\xff]+")
# The usual two-byte zlib headers, and text operators of content streams.
ZLIB_HEADS = re.compile(rb"\x78[\x01\x5e\x9c\xda]")
OPERATORS = re.compile(rb"(?<![A-Za-z])(?:BT|ET|Tj|TJ|Tf|Td|Tm|Tw|Tc|cm|re|Do)(?![A-Za-z])")
# Shortest operand worth judging, islands tried, and what counts as readable.
MIN_OPERAND = 48
ISLANDS = 6
ISLAND_ASCII = 0.60
ISLAND_ASCII_OPS = 0.45


def _close(buf: bytes, at: int, hi: int) -> int:
    """Position after the literal string opened just before ``at``; ``hi`` when it stays open."""
    depth = 1
    for m in PAREN.finditer(buf, at, hi):
        if m[0] == b"(":
            depth += 1
        elif m[0] == b")":
            depth -= 1
            if depth == 0:
                return m.end()
    return hi


def zones(buf: bytes, lo: int, hi: int):
    """(kind, start, stop) of comments, literal strings, hex strings and the syntax between them."""
    at = lo
    while at < hi:
        m = TOKEN.search(buf, at, hi)
        stop = m.start() if m else hi
        if stop > at:
            yield "syntax", at, stop
        if not m:
            return
        at = m.end()
        if m[0] == b"(":
            at = _close(buf, m.end(), hi)
            yield "literal", m.start(), at
        elif m[0].startswith(b"%"):
            yield "comment", m.start(), at
        elif m[0] != b"<<":
            yield "hex", m.start(), at


def hex_body(body: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", body)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def operands(buf: bytes) -> list[bytes]:
    """Long string operands of a content stream; inline images do not count."""
    text = INLINE_IMAGE.sub(b" ", buf)
    found = []
    for kind, a, b in zones(text, 0, len(text)):
        body = text[a + 1: b - 1] if kind == "literal" else hex_body(text[a:b]) if kind == "hex" else b""
        if len(body) >= MIN_OPERAND:
            found.append(body)
    return found


def has_readable_island(data: bytes) -> bool:
    """Whether some embedded zlib stream inflates to text or content operators; all of them are tried, and their first MiB
    is what is read."""
    for m in ZLIB_HEADS.finditer(data):
        try:
            out = zlib.decompressobj().decompress(memoryview(data)[m.start():], 1 << 20)
        except zlib.error:
            continue
        if not out:
            continue
        share = sum(c in b"\t\n\r" or 32 <= c <= 126 for c in out) / len(out)
        try:
            out.decode("utf-8")
            readable = share >= ISLAND_ASCII
        except UnicodeDecodeError:
            readable = False
        balanced = out.count(b"(") == out.count(b")")
        if readable or (len(OPERATORS.findall(out)) >= 4 and balanced and share >= ISLAND_ASCII_OPS):
            return True
    return False


def has_broken_zlib(data: bytes) -> bool:
    """Whether an embedded zlib header starts data that does not inflate."""
    for m in list(ZLIB_HEADS.finditer(data))[:ISLANDS]:
        try:
            zlib.decompressobj().decompress(data[m.start():], 1 << 16)
        except zlib.error:
            return True
    return False


def _map(arr: pa.Array, fn, kind) -> pa.Array:
    return pa.array([None if v.as_py() is None else fn(v.as_py()) for v in arr], kind)


@arrow_udf(returnType=T.ArrayType(T.BinaryType()))
def _operands(arr: pa.Array) -> pa.Array:
    return _map(arr, operands, pa.list_(pa.binary()))


@arrow_udf(returnType=T.BooleanType())
def _island(arr: pa.Array) -> pa.Array:
    return _map(arr, has_readable_island, pa.bool_())


@arrow_udf(returnType=T.BooleanType())
def _broken(arr: pa.Array) -> pa.Array:
    return _map(arr, has_broken_zlib, pa.bool_())


def string_operands(data: Column) -> Column:
    return _operands(data)


def readable_island(data: Column) -> Column:
    return _island(data)


def broken_zlib(data: Column) -> Column:
    return _broken(data)
