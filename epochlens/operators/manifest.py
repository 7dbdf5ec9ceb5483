"""Trusted-manifest rows for media in files, archives, OOXML packages and PDF files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlens.formats import pdf
from epochlens.formats import zip as ziparchive
from epochlens.functions.paths import extension
from epochlens.functions.pdffilters import DECODED, decode_filters, decode_parms, filter_names

# Extensions that count as media, and the containers searched.
MEDIA = ["jpg", "jpeg", "png", "webp", "gif", "bmp", "tif", "tiff", "j2k", "jp2", "mp3", "wav", "ogg",
         "m4a", "flac", "aac", "mp4", "m4v", "mov", "webm", "avi", "mkv", "emf", "wmf", "svg", "ico"]
OOXML = ["docx", "pptx", "xlsx"]
ARCHIVES = ["zip", "jar", "apk"]

COLUMNS = ["sha256", "source", "container", "entry", "media_ext"]


def _entries(files: DataFrame) -> DataFrame:
    rows = ziparchive.members(files, lenient=True)
    return ziparchive.payloads(rows).select(
        "file_path", F.col("name").cast("string").alias("entry"), "payload"
    ).filter(F.length("payload") > 0)


def archive_media(files: DataFrame) -> DataFrame:
    """Media members of archives; of OOXML packages only media folders and thumbnails."""
    kind = extension(F.col("file_path"))
    low = F.lower("entry")
    in_media = low.rlike(r"^(word|ppt|xl)/") & low.contains("/media/")
    thumb = low.rlike(r"^docprops/thumbnail\.(?:.*\.)?(jpg|jpeg|png|jfif)$")
    found = _entries(files.filter(kind.isin(OOXML + ARCHIVES))).filter(extension(F.col("entry")).isin(MEDIA))
    return found.filter(~kind.isin(OOXML) | in_media | thumb).select(
        F.sha2("payload", 256).alias("sha256"),
        F.when(kind.isin(OOXML), "ooxml").otherwise("zip").alias("source"),
        F.col("file_path").alias("container"), "entry", extension(F.col("entry")).alias("media_ext"),
    )


def embedded_media(files: DataFrame) -> DataFrame:
    """Media of archives that are embedded in OOXML packages."""
    outer = _entries(files.filter(extension(F.col("file_path")).isin(OOXML))).filter(
        F.lower("entry").rlike(r"^(word|ppt|xl)/(embeddings|activex)/") & F.hex("payload").startswith("504B")
    )
    key = F.to_json(F.struct("file_path", "entry"))
    inner = _entries(outer.select(key.alias("file_path"), F.col("payload").alias("content")))
    k = F.from_json("file_path", "struct<file_path:string,entry:string>")
    return inner.filter(extension(F.col("entry")).isin(MEDIA)).select(
        F.sha2("payload", 256).alias("sha256"), F.lit("ooxml-embedded").alias("source"),
        k["file_path"].alias("container"), F.concat(k["entry"], F.lit("!"), "entry").alias("entry"),
        extension(F.col("entry")).alias("media_ext"),
    )


def pdf_media(files: DataFrame) -> DataFrame:
    """Image streams of PDF files, hashed after decoding where the filters allow it, else raw."""
    body = files.filter(extension(F.col("file_path")) == "pdf")
    streams = pdf.pieces(body).filter("kind = 'stream'").withColumn("stated", F.lit(None).cast("bigint"))
    shown = F.col("dict").rlike(pdf.IMAGE) | F.col("dict").rlike(r"/(DCTDecode|JPXDecode|CCITTFaxDecode|JBIG2Decode)\b")
    raw = pdf.stream_bytes(streams.filter(shown), body).filter(F.length("raw") > 0).withColumn("names", filter_names(F.col("dict")))
    plain = F.forall("names", lambda n: n.isin(DECODED))
    decoded = raw.withColumn(
        "d", decode_filters(F.when(plain, F.col("raw")), F.col("names"), decode_parms(F.col("dict")))
    )
    payload = F.when(F.col("d.ok"), F.col("d.data")).otherwise(F.col("raw"))
    ext = (
        F.when(F.array_contains("names", "DCTDecode"), "jpg")
        .when(F.array_contains("names", "JPXDecode"), "jp2").otherwise("")
    )
    return decoded.select(
        F.sha2(payload, 256).alias("sha256"), F.lit("pdf").alias("source"),
        F.col("file_path").alias("container"),
        F.concat(F.lit("stream@"), F.col("start").cast("string"), F.lit("-"), (F.col("stop") - 1).cast("string")).alias("entry"),
        ext.alias("media_ext"),
    )


def file_media(files: DataFrame) -> DataFrame:
    ext = extension(F.col("file_path"))
    return files.filter(ext.isin(MEDIA)).select(
        F.sha2("content", 256).alias("sha256"), F.lit("file").alias("source"),
        F.col("file_path").alias("container"), F.lit("").alias("entry"), ext.alias("media_ext"),
    )


def build_manifest(files: DataFrame, embedded: bool = False) -> DataFrame:
    """One row per (source, container, entry); of repeated entries the smallest hash is kept."""
    rows = archive_media(files).unionByName(pdf_media(files)).unionByName(file_media(files))
    if embedded:
        rows = rows.unionByName(embedded_media(files))
    return rows.groupBy("source", "container", "entry").agg(
        F.min(F.struct("sha256", "media_ext")).alias("x")
    ).select("x.sha256", "source", "container", "entry", "x.media_ext")
