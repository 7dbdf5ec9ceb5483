"""Range decisions for PDF files.

Verdicts are reached per stream and per lexical anomaly, once each; ranges inherit them through an
overlap join, so a file with many suspicious blocks is not parsed per block.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.formats import pdf
from epochlens.functions.batches import slices_of
from epochlens.functions.bytestats import byte_chi2_open, byte_entropy, byte_stats
from epochlens.functions.codec import packed_size
from epochlens.functions.pdffilters import DECODED, decode_filters, decode_parms, filter_names
from epochlens.functions.pdftext import (
    HIGH, MIN_OPERAND, broken_zlib, hex_body, readable_island, string_operands, zones,
)
from epochlens.operators.intervals import longest_overlap
from epochlens.session import cut_lineage

UNDECODABLE = "pdf: nested metadata encrypted (stream undecodable)"


@dataclass(frozen=True)
class PdfRules:
    ascii_max: float = 0.18
    chi2_max: float = 240.0
    entropy_min: float = 7.5
    ratio_min: float = 0.97


def looks_encrypted(buf: Column, rules: PdfRules, least: int = MIN_OPERAND) -> Column:
    """Long enough, hardly any ASCII, flat, and either high entropy or incompressible."""
    n = F.length(buf)
    head = F.substring(buf, 1, 2048)
    dense = (byte_entropy(F.substring(buf, 1, 4096)) >= rules.entropy_min) | (
        packed_size(head) >= rules.ratio_min * F.length(head)
    )
    return (
        (n >= least) & (byte_stats(buf)["printable"] < rules.ascii_max * n)
        & (byte_chi2_open(buf) <= rules.chi2_max) & dense
    )


def stream_kind(d: Column) -> Column:
    """Kind of a stream from the names in its dictionary."""
    has = lambda *names: F.greatest(*[d.contains(n) for n in names], F.lit(False))
    sub = lambda name: d.rlike(rf"/Subtype\s*/{name}\b")
    kind = lambda name: d.rlike(rf"/Type\s*/{name}\b")
    image = (has("/XObject") & sub("Image")) | has("/DCTDecode", "/JPXDecode", "/CCITTFaxDecode", "/JBIG2Decode")
    content = d.contains("/Length") & ~d.contains("/Subtype") & ~kind("Metadata") & ~kind("XRef") & ~kind("ObjStm")
    xmp = kind("Metadata") | sub("XML") | has("/XMP")
    return (
        F.when(content | xmp | sub("Text"), "text")
        .when(sub("EmbeddedFile") | kind("EmbeddedFile") | d.contains("/EF"), "embedded")
        .when(image, "image").when(has("/ICCBased"), "icc")
        .when(has("/Type1C", "/OpenType", "/CIDFontType0C", "/FontFile"), "font")
        .when(has("/XRef", "/ObjStm"), "structure").otherwise("untyped")
    )


def font_shape(buf: Column) -> Column:
    """Header of an sfnt or CFF font program."""
    h = F.hex(F.substring(buf, 1, 6))
    tables = F.conv(F.substring(h, 9, 4), 16, 10).cast("int")
    sfnt = h.rlike("^(00010000|4F54544F|74727565|74797031)") & tables.between(1, 200) & (
        F.length(buf) >= 12 + tables * 16
    )
    return sfnt | h.rlike("^0[12]..0[4-8]0[1-4]")


def zlib_head_ok(buf: Column) -> Column:
    word = F.conv(F.hex(F.substring(buf, 1, 2)), 16, 10).cast("int")
    return (F.hex(F.substring(buf, 1, 1)).rlike("8$")) & (word % 31 == 0)


def stream_verdicts(streams: DataFrame, trusted: DataFrame, rules: PdfRules = PdfRules()) -> DataFrame:
    """(file_path, span_start, span_end, bad, reason). ``streams`` has raw bytes and dictionaries."""
    known = trusted.select("sha256").distinct().withColumn("_known", F.lit(True))
    named = streams.withColumn("filters", filter_names(F.col("dict"))).withColumn(
        "supported", F.forall("filters", lambda f: f.isin(DECODED))
    ).withColumn("kind", stream_kind(F.col("dict")))
    flate = F.col("dict").contains("/FlateDecode")
    dec = named.withColumn(
        "d", decode_filters(F.when(F.col("supported"), F.col("raw")), F.col("filters"), decode_parms(F.col("dict")))
    )
    undecodable = (flate & (F.length("raw") >= 2) & ~zlib_head_ok(F.col("raw"))) | (F.col("supported") & ~F.col("d.ok"))
    ready = dec.select(
        "file_path", "idx", "start", "stop", "kind", undecodable.alias("undecodable"),
        F.coalesce("d.data", "raw").alias("data"), (F.size("filters") == 0).alias("bare"),
    )
    sid = ["file_path", "idx"]
    ok = ready.filter(~F.coalesce("undecodable", F.lit(False)))
    texty = ok.filter((F.col("kind") == "text") | ((F.col("kind") == "untyped") & F.col("bare")))
    bodies = texty.select(*sid, F.explode(string_operands(F.col("data"))).alias("body"))
    spoilt = bodies.select(
        *sid, looks_encrypted(F.col("body"), rules).alias("enc"), readable_island(F.col("body")).alias("island")
    ).filter("enc AND NOT island").select(*sid).distinct().withColumn("operand_bad", F.lit(True))
    images = ok.filter("kind = 'image'").select(*sid, F.sha2("data", 256).alias("sha256")).join(
        known, "sha256", "left").select(*sid, F.col("_known").isNotNull().alias("image_ok"))
    fonts = ok.filter("kind = 'font'").select(
        *sid, font_shape(F.col("data")).alias("shaped"), readable_island(F.col("data")).alias("island"),
        looks_encrypted(F.col("data"), rules).alias("enc"),
    ).select(*sid, (~F.col("shaped") & ~F.col("island") & F.col("enc")).alias("font_bad"))
    bare = ok.filter("kind = 'untyped' AND bare").select(*sid, broken_zlib(F.col("data")).alias("zlib_bad"))
    facts = ready.drop("data")
    for extra in (spoilt, images, fonts, bare):
        facts = facts.join(extra, sid, "left")
    reason = (
        F.when(F.col("undecodable"), UNDECODABLE)
        .when(F.col("operand_bad"), "pdf: content string looks encrypted")
        .when(F.col("kind") == "text", "pdf: text stream operands benign")
        .when(F.col("kind") == "embedded", "pdf: embedded file present; delegate to inner format")
        .when(F.col("image_ok"), "pdf: image stream (trusted)").when(F.col("kind") == "image", "pdf: image stream (untrusted)")
        .when(F.col("kind") == "icc", "pdf: icc stream (benign)").when(F.col("font_bad"), "pdf: font payload looks encrypted")
        .when(F.col("kind") == "font", "pdf: font stream (benign)")
        .when(F.col("zlib_bad"), "pdf: member has broken zlib (inherit to region)")
        .otherwise("pdf: non-textish stream (benign)")
    )
    bad = (
        F.col("undecodable") | F.col("operand_bad") | (F.col("kind") == "embedded")
        | ((F.col("kind") == "image") & ~F.col("image_ok")) | F.col("font_bad") | F.col("zlib_bad")
    )
    return facts.select(
        "file_path", F.col("start").alias("span_start"), (F.col("stop") - 1).alias("span_end"),
        F.coalesce(bad, F.lit(False)).alias("bad"), reason.alias("reason"),
    )


ANOMALY_SCHEMA = "file_path string, span_start bigint, span_end bigint, reason string, body binary"


# Where the binary marker may lie and how much of it is tolerated.
MARKER_ZONE, MARKER_BYTES, MARKER_HIGH = 4096, 512, 4
FIRST_LINE = re.compile(rb"%PDF-[0-9]\.[0-9][^\r\n]*[\r\n]")
XREF = re.compile(rb"\bxref\b.*?\btrailer\b(?:.{0,65536}?>>)?", re.DOTALL)
XREF_HEAD = re.compile(rb"\bxref\s+\d+\s+\d+")
XREF_ROW = re.compile(rb"\n\d{10}\s\d{5}\s[fn]\b")
TRAILER_SIZE = re.compile(rb"trailer\s*<<.*?/Size\s+\d+", re.DOTALL)
START_XREF = re.compile(rb"\bstartxref\b(\s*(\d+))?")
PLAIN_OBJECT = re.compile(rb"\b\d+\s+\d+\s+obj\b(.*?)\bendobj\b", re.DOTALL)


def marker_end(buf: bytes) -> int:
    """End of the comment lines with high bytes that directly follow the header line."""
    m = FIRST_LINE.search(buf, 0, MARKER_ZONE)
    at = first = m.end() if m else 0
    while at < MARKER_ZONE and at - first < MARKER_BYTES and buf[at: at + 1] == b"%":
        stop = min(x for x in (buf.find(b"\n", at), buf.find(b"\r", at), len(buf)) if x >= 0)
        if sum(c >= 128 for c in buf[at:stop]) < MARKER_HIGH:
            break
        at = stop + 1
    return at


def structure_anomalies(buf: bytes, lo: int, hi: int):
    """(start, end, reason) of malformed cross-reference tables, ``startxref`` values and plain
    objects in a stretch without streams; ends inclusive."""
    for m in XREF.finditer(buf, lo, hi):
        part = m[0]
        why = (
            "missing xref section header" if not XREF_HEAD.search(part) else
            "no xref rows" if not XREF_ROW.search(part) else
            "missing trailer/Size" if not TRAILER_SIZE.search(part) else ""
        )
        if why:
            yield m.start(), m.end() - 1, f"pdf: prelude xref/trailer anomaly ({why})"
    for m in START_XREF.finditer(buf, lo, hi):
        if m[2] is None:
            yield m.start(), m.end() - 1, "pdf: prelude startxref anomaly (missing integer after startxref)"
        elif int(m[2]) >= len(buf):
            yield m.start(), m.end() - 1, "pdf: prelude startxref anomaly (startxref offset out of bounds)"
    for m in PLAIN_OBJECT.finditer(buf, lo, hi):
        if m[1].count(b"<<") != m[1].count(b">>") or m[1].count(b"[") - m[1].count(b"]") >= 16:
            yield m.start(), m.end() - 1, "pdf: prelude object anomaly (dict/array delimiter imbalance)"


def outside_anomalies(files: DataFrame, rules: PdfRules = PdfRules()) -> DataFrame:
    """(file_path, span_start, span_end, reason) outside streams: malformed structure, high-bit
    bytes in syntax or in a comment past the binary marker, long strings that look encrypted."""

    def scan(batches):
        for batch in slices_of(batches):
            rows = []
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                streams, _ = pdf.stream_rows(value)
                edges = [0, *[x for s in streams for x in (s["start"], s["stop"])], len(value)]
                marked = marker_end(value)
                for lo, hi in zip(edges[::2], edges[1::2]):
                    rows += [(path, *x, None) for x in structure_anomalies(value, lo, hi)]
                    for kind, a, b in zones(value, lo, hi):
                        if kind in ("literal", "hex"):
                            body = value[a + 1: b - 1] if kind == "literal" else hex_body(value[a:b])
                            if len(body) >= MIN_OPERAND:
                                rows.append((path, a, b - 1, "pdf: prelude data encrypted", body))
                            continue
                        for m in () if kind == "comment" and b <= marked else HIGH.finditer(value, a, b):
                            why = "pdf: comment high-bit anomaly" if kind == "comment" else "pdf: prelude non-ASCII syntax bytes"
                            rows.append((path, m.start(), m.end() - 1, why, None))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())],
                ["file_path", "span_start", "span_end", "reason", "body"],
            )

    found = files.select("file_path", "content").mapInArrow(scan, ANOMALY_SCHEMA)
    judged = found.withColumn("enc", looks_encrypted(F.col("body"), rules)).withColumn(
        "island", readable_island(F.col("body"))
    )
    return judged.filter(F.col("body").isNull() | (F.col("enc") & ~F.col("island"))).select(
        "file_path", "span_start", "span_end", "reason"
    )


def pdf_decisions(
    ranges: DataFrame, files: DataFrame, trusted: DataFrame, rules: PdfRules = PdfRules(),
) -> DataFrame:
    """Range decisions for PDF files; files whose structure cannot be followed are kept whole."""
    parts = cut_lineage(pdf.pieces(files))
    whole_tail = F.decode("content", "ISO-8859-1")
    facts = files.select(
        "file_path", F.length("content").cast("bigint").alias("size"),
        F.decode(F.substring("content", 1, 16), "ISO-8859-1").rlike("^" + pdf.HEADER).alias("header_ok"),
        whole_tail.rlike(r"%%EOF\s*$").alias("eof_ok"),
    ).join(parts.filter("kind = 'map'").select("file_path", "note"), "file_path")
    err = (
        F.when(~F.col("header_ok"), "pdf: metadata encrypted (bad or missing header)")
        .when(~F.col("eof_ok"), "pdf: metadata encrypted (missing EOF)")
        .when(F.col("note") == "missing_endstream", "pdf: structural truncation (missing 'endstream')")
        .when(F.col("note") != "", F.concat(F.lit("pdf: metadata encrypted (parse error); "), "note"))
    )
    key = ["file_path", "start", "end"]
    r = ranges.join(cut_lineage(facts.select("file_path", "size", err.alias("err"))), "file_path")
    broken = r.filter("err IS NOT NULL").select(*key, F.lit(True).alias("keep_region"), F.col("err").alias("reason"))
    good = r.filter("err IS NULL").select(*key, F.least("end", F.col("size") - 1).alias("e"))
    # Lengths come from the dictionaries: cutting at ``endstream`` may drop a last data byte that
    # looks like a line end.
    raw = pdf.stream_bytes(pdf.stream_lengths(parts), files)
    spans = stream_verdicts(raw, trusted, rules).unionByName(
        outside_anomalies(files, rules).withColumn("bad", F.lit(True))
    )
    # Of several spans in a range a bad one decides, and the one that covers most of the range speaks for it.
    hit = longest_overlap(good.distinct(), cut_lineage(spans).withColumn("fine", ~F.col("bad")), ["file_path"], ("start", "e"),
                          ("span_start", "span_end"), ["fine", "reason"], first="fine")
    decided = good.join(hit, ["file_path", "start", "e"], "left").select(
        *key, (~F.coalesce("fine", F.lit(True))).alias("keep_region"),
        F.coalesce("reason", F.lit("pdf: prelude syntactically valid")).alias("reason"),
    )
    return broken.unionByName(decided).select(
        *key, F.lit("pdf").alias("handler"), "keep_region", "reason",
        F.when(F.col("keep_region") & F.col("reason").startswith("pdf: nested metadata encrypted"),
               F.lit("pdf: nested metadata encrypted"))
        .when(F.col("keep_region") & F.col("reason").rlike("^pdf: (metadata encrypted|structural)"), F.col("reason"))
        .alias("file_reason"),
    )
