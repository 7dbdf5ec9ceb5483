"""Diagnostic tables over PDF files: streams with embedded zlib data, lexical zones, and a text or
ciphertext label per string. Offsets are looked up in the zone table with an interval join."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from epochlens.formats import pdf
from epochlens.formats.pdf_ranges import zlib_head_ok
from epochlens.functions.batches import slices_of
from epochlens.functions.bytestats import byte_stats
from epochlens.functions.codec import inflated, packed_size
from epochlens.functions.islands import compressed_islands
from epochlens.functions.pdffilters import decode_filters, decode_parms, filter_names
from epochlens.functions.pdftext import ZLIB_HEADS, hex_body, zones
from epochlens.operators.intervals import overlap_join

HITS = T.ArrayType(T.StructType([
    T.StructField("rel", T.LongType()), T.StructField("ok", T.BooleanType()), T.StructField("size", T.LongType()),
]))


def zlib_hits(raw: bytes) -> list[dict]:
    """Places that look like a zlib header, whether data inflates from there and to how many bytes."""
    found = []
    for m in ZLIB_HEADS.finditer(raw):
        try:
            size = sum(map(len, inflated(memoryview(raw)[m.start():], 15)))
            found.append({"rel": m.start(), "ok": True, "size": size})
        except zlib.error:
            found.append({"rel": m.start(), "ok": False, "size": 0})
    return found


@arrow_udf(returnType=HITS)
def _hits(arr: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("rel", pa.int64()), ("ok", pa.bool_()), ("size", pa.int64())]))
    return pa.array([None if v.as_py() is None else zlib_hits(v.as_py()) for v in arr], kind)


def stream_report(files: DataFrame) -> DataFrame:
    """One row per stream: span, filters, whether it inflates as declared, embedded zlib headers."""
    raw = pdf.stream_bytes(pdf.stream_lengths(pdf.pieces(files)), files)
    named = raw.withColumn("filters", filter_names(F.col("dict")))
    dec = named.withColumn("d", decode_filters(F.col("raw"), F.col("filters"), decode_parms(F.col("dict")), sized=True))
    flate = F.array_contains("filters", "FlateDecode")
    return dec.select(
        "file_path", "idx", "start", "stop", "filters", flate.alias("declared_flate"),
        F.when(flate, zlib_head_ok(F.col("raw"))).alias("zlib_head_ok"), F.col("d.ok").alias("decodes"),
        F.col("d.size").alias("decoded_size"), _hits(F.col("raw")).alias("embedded_zlib"),
    )


def island_report(files: DataFrame) -> DataFrame:
    """(file_path, idx, island_start, island_end, kind, size, texty, operators): zlib and raw DEFLATE data at any offset of
    streams that no filter explains; ends inclusive."""
    raw = pdf.stream_bytes(pdf.stream_lengths(pdf.pieces(files)), files)
    bare = raw.filter(F.size(filter_names(F.col("dict"))) == 0)
    found = bare.select("file_path", "idx", "start", F.explode(compressed_islands(F.col("raw"))).alias("i"))
    return found.select("file_path", "idx", (F.col("start") + F.col("i.rel")).alias("island_start"),
                        (F.col("start") + F.col("i.stop") - 1).alias("island_end"), "i.kind", "i.size", "i.texty", "i.operators")


ZONE_SCHEMA = "file_path string, kind string, zone_start bigint, zone_end bigint, body binary"


def zone_report(files: DataFrame) -> DataFrame:
    """(file_path, kind, zone_start, zone_end, body): streams and the zones outside them, ends
    inclusive; ``body`` holds string bytes."""

    def scan(batches):
        for batch in slices_of(batches):
            rows = []
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                streams, _ = pdf.stream_rows(value)
                rows += [(path, "stream", s["start"], s["stop"] - 1, None) for s in streams if s["stop"] > s["start"]]
                edges = [0, *[x for s in streams for x in (s["start"], s["stop"])], len(value)]
                for lo, hi in zip(edges[::2], edges[1::2]):
                    for kind, a, b in zones(value, lo, hi):
                        body = value[a + 1: b - 1] if kind == "literal" else hex_body(value[a:b]) if kind == "hex" else None
                        rows.append((path, kind, a, b - 1, body))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], ["file_path", "kind", "zone_start", "zone_end", "body"]
            )

    return files.select("file_path", "content").mapInArrow(scan, ZONE_SCHEMA)


def label_string(body: Column, text_expected: bool = False) -> Column:
    """``TEXT`` or ``CIPHERTEXT`` for string bytes: readable UTF-8 is text; long bodies that do not
    compress or are rich in high bytes are not."""
    s, n = byte_stats(body), F.length(body)
    readable = F.is_valid_utf8(body.cast("string")) & (s["printable"] >= 0.60 * n)
    high = (n - F.length(F.regexp_replace(F.decode(body, "ISO-8859-1"), "[\\x80-\\xff]", ""))) / n
    dense = packed_size(F.substring(body, 1, 2048)) >= 0.97 * F.least(n, F.lit(2048))
    cipher = F.lit(True) if text_expected else (n >= 96) & (dense | (high >= 0.25))
    return F.when((n == 0) | readable, "TEXT").when(cipher, "CIPHERTEXT").otherwise("TEXT")


def string_report(files: DataFrame, text_expected: bool = False) -> DataFrame:
    found = zone_report(files).filter(F.col("kind").isin("literal", "hex"))
    return found.select(
        "file_path", "kind", "zone_start", "zone_end", F.length("body").alias("size"),
        label_string(F.col("body"), text_expected).alias("label"),
    )


def locate_offsets(offsets: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, offset, kind, zone_start, zone_end): the zone or stream that holds each offset."""
    points = offsets.select("file_path", F.col("offset").cast("bigint").alias("offset"), F.col("offset").cast("bigint").alias("_o2"))
    return overlap_join(
        points, zone_report(files).drop("body"), ["file_path"], ("offset", "_o2"), ("zone_start", "zone_end")
    ).drop("_o2")
