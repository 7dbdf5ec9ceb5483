"""Archives, packages and PDF files derived from the documents table, some of them damaged."""

from __future__ import annotations

import io
import re
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from epochlens.catalog.registry import table
from epochlens.functions.bytestats import utf8_bytes
from epochlens.session import spread

PDF_IMAGE_HEAD = bytes(range(1, 256)) + b"!"
_STAMP = (2024, 1, 1, 0, 0, 0)


def build_zip(entries: list[tuple[str, bytes, int]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, method in entries:
            info = zipfile.ZipInfo(name, _STAMP)
            info.compress_type = method
            z.writestr(info, data)
    return out.getvalue()


def build_docx(text: str) -> bytes:
    from xml.sax.saxutils import escape

    safe = "".join(c for c in text if c >= " " or c in "\n\t")
    ns = "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    types = (
        f'<Types xmlns="{ns}/content-types"><Default Extension="rels" '
        'ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="bin" ContentType="application/octet-stream"/>'
        f'<Override PartName="/word/document.xml" ContentType="{main}"/></Types>'
    )
    root = (
        f'<Relationships xmlns="{ns}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" '
        'Target="word/document.xml"/></Relationships>'
    )
    links = (
        f'<Relationships xmlns="{ns}/relationships"><Relationship Id="r1" Type="{office}/image" '
        'Target="media/a.bin"/><Relationship Id="r2" Type="{office}/hyperlink" '
        'Target="https://example.com/" TargetMode="External"/></Relationships>'
    )
    runs = "".join(f"<w:p>{escape(part)}</w:p>" for part in re.findall(r"(?s).{1,60}", safe))
    body = f'<w:document xmlns:w="urn:w">{runs}</w:document>'
    return build_zip([
        ("[Content_Types].xml", types.encode(), zipfile.ZIP_DEFLATED),
        ("_rels/.rels", root.encode(), zipfile.ZIP_DEFLATED),
        ("word/document.xml", body.encode(), zipfile.ZIP_DEFLATED),
        ("word/_rels/document.xml.rels", links.encode(), zipfile.ZIP_DEFLATED),
        ("word/media/a.bin", text.encode()[:64] or b"-", zipfile.ZIP_STORED),
    ])


def build_pdf(text: str) -> bytes:
    body = zlib.compress(b"BT /F1 12 Tf 72 712 Td (" + text.encode("ascii", "ignore").translate(None, b"()\\") + b") Tj ET")
    image = PDF_IMAGE_HEAD + text.encode()[:256]
    objs = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>",
        b"<< /Length " + str(len(body)).encode() + b" /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream",
        b"<< /Type /XObject /Subtype /Image /Length 6 0 R >>\nstream\n" + image + b"\nendstream",
        str(len(image)).encode(),
    ]
    out = b"%PDF-1.4\n"
    at = []
    for i, o in enumerate(objs, 1):
        at.append(len(out))
        out += str(i).encode() + b" 0 obj\n" + o + b"\nendobj\n"
    xref = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objs) + 1)
    out += b"".join(b"%010d 00000 n \n" % a for a in at)
    out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objs) + 1, xref)
    return out


def _builder(fn):
    @arrow_udf(returnType=T.BinaryType())
    def make(texts: pa.Array) -> pa.Array:
        return pa.array([fn(t.as_py() or "") for t in texts], pa.binary())

    return make


_zip = _builder(lambda t: build_zip([
    ("a.txt", t.encode(), zipfile.ZIP_DEFLATED), ("b/raw.dat", t.encode()[::-1], zipfile.ZIP_STORED),
]))
_docx = _builder(build_docx)
_pdf = _builder(build_pdf)


def at(content: Column, marker: str) -> Column:
    """One-based position of the first occurrence of an ASCII marker."""
    return F.instr(F.decode(content, "ISO-8859-1"), marker)


def stamp(content: Column, pos: Column, size: int) -> Column:
    """Overwrite ``size`` bytes with FF."""
    return F.overlay(content, F.unhex(F.repeat(F.lit("FF"), size)), pos.cast("int"), F.lit(size))


def image_bytes() -> Column:
    """The media part of a derived package."""
    head = F.substring(utf8_bytes(F.col("text")), 1, 64)
    return F.when(F.length(head) > 0, head).otherwise(F.lit(b"-"))


def pdf_image_bytes() -> Column:
    """The image stream of a derived PDF file as read back: one line end before its keyword goes."""
    body = F.concat(F.lit(PDF_IMAGE_HEAD), F.substring(utf8_bytes(F.col("text")), 1, 256))
    return body


DECOY = b"\x78\x9c" + b"\xff" * 6


def build_island_pdf(text: str) -> bytes:
    """One stream without a filter: seventy zlib heads with nothing behind them, raw DEFLATE data, a zlib value."""
    packer = zlib.compressobj(wbits=-15)
    raw = packer.compress(text.encode()) + packer.flush()
    body = DECOY * 70 + raw + b"|" + zlib.compress(text.encode()[:100] or b"-")
    return (b"%PDF-1.4\n1 0 obj\n<< /Length " + str(len(body)).encode() + b" >>\nstream\n" + body
            + b"\nendstream\nendobj\ntrailer\n<< /Size 2 >>\nstartxref\n0\n%%EOF\n")


_island_pdf = _builder(build_island_pdf)


def island_files(spark, d):
    return _files(spark, d, _island_pdf, ".pdf")


def _files(spark, d, build, ext: str):
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "text"))
    return docs.select(
        "doc_id", "lang", F.concat(F.lit("/s/"), F.col("doc_id").cast("string"), F.lit(ext)).alias("file_path"),
        build(F.col("text")).alias("content"),
    )


def zip_files(spark, d):
    """German archives lose the start of their first member's data, French ones gain a byte."""
    c = F.col("content")
    return _files(spark, d, _zip, ".zip").withColumn(
        "content",
        F.when(F.col("lang") == "de", stamp(c, F.lit(30 + len("a.txt") + 1), 4))
        .when(F.col("lang") == "fr", F.concat(c, F.lit(b"\x00"))).otherwise(c),
    )


def docx_files(spark, d):
    """German packages have broken document bytes."""
    c = F.col("content")
    return _files(spark, d, _docx, ".docx").withColumn(
        "content",
        F.when(F.col("lang") == "de", stamp(c, at(c, "word/document.xml") + len("word/document.xml"), 4)).otherwise(c),
    )


def pdf_files(spark, d):
    """German files have damaged stream data, French ones a cut-off tail."""
    c = F.col("content")
    return _files(spark, d, _pdf, ".pdf").withColumn(
        "content",
        F.when(F.col("lang") == "de", stamp(c, at(c, "stream\n") + len("stream\n"), 16))
        .when(F.col("lang") == "fr", F.substring(c, F.lit(1), F.length(c) - 8)).otherwise(c),
    )
