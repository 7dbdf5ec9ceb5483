"""Format-aware decisions on suspicious file ranges, and their effect on mappings and regions.

A decision table has one row per (file, range); ranges are single device blocks of a file. Nothing
is gathered per file except bounded aggregates, so a file that owns most blocks stays spread out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.functions.ints import floor_div
from epochlens.functions.paths import extension
from epochlens.functions.text import utf8_error_count
from epochlens.operators.chunked import text_reason
from epochlens.operators.trust import REGION_KEY

# Extensions and leading bytes per handler, in dispatch order.
EXTENSIONS = {
    "ooxml": ["docx", "xlsx", "pptx"],
    "zip": ["zip", "jar", "apk"],
    "jpeg": ["jpg", "jpeg", "jpe"],
    "png": ["png"],
    "pdf": ["pdf"],
    "mp3": ["mp3"],
    "mp4": ["mp4", "m4v", "m4a", "mov"],
    "text": ["txt", "log", "csv", "tsv", "md", "json", "xml", "yaml", "yml", "ini", "cfg", "conf",
             "properties"],
}
MEDIA = ["jpeg", "png", "mp3", "mp4"]
PNG_SIGNATURE = "89504E470D0A1A0A"

def _starts(magic: Column, hex_prefix: str) -> Column:
    return F.hex(magic).startswith(hex_prefix)


def media_signature(kind: str, magic: Column) -> Column:
    """Whether the leading bytes carry the signature of a media kind."""
    return {
        "jpeg": _starts(magic, "FFD8"),
        "png": _starts(magic, PNG_SIGNATURE),
        # An ID3 tag or an eleven-bit frame sync.
        "mp3": _starts(magic, "494433") | F.hex(magic).rlike("^FF[EF]"),
        "mp4": F.hex(F.substring(magic, 5, 4)) == "66747970",
    }[kind]


def printable_prefix(magic: Column) -> Column:
    """Mostly printable leading bytes: 80 % of eight, 90 % of fewer."""
    pairs = F.regexp_extract_all(F.hex(magic), F.lit("(..)"), F.lit(1))
    good = F.size(F.filter(pairs, lambda h: h.between("20", "7E") | h.isin("09", "0A", "0D")))
    n = F.size(pairs)
    need = F.when(n >= 8, 0.80).otherwise(0.90)
    return (n > 0) & (good / F.when(n > 0, n) >= need)


def handler_name(path: Column, magic: Column) -> Column:
    """First handler that claims a file by extension or by its first eight bytes."""
    ext = extension(path)
    mg = F.coalesce(magic, F.lit(b""))
    claims = {
        "ooxml": ext.isin(EXTENSIONS["ooxml"]),
        "zip": ext.isin(EXTENSIONS["zip"]) | _starts(mg, "504B0304") | _starts(mg, "504B0506")
        | _starts(mg, "504B0102"),
        "pdf": ext.isin(EXTENSIONS["pdf"]) | _starts(mg, "255044462D"),
        "text": ext.isin(EXTENSIONS["text"]) | printable_prefix(mg),
    }
    for kind in MEDIA:
        claims[kind] = ext.isin(EXTENSIONS[kind]) | media_signature(kind, mg)
    order = ["ooxml", "zip", "jpeg", "png", "pdf", "mp3", "mp4", "text"]
    pick = reduce(
        lambda acc, kind: acc.when(F.coalesce(claims[kind], F.lit(False)), kind),
        order[1:], F.when(F.coalesce(claims[order[0]], F.lit(False)), order[0]),
    )
    return pick.otherwise("generic")


def file_ranges(mappings: DataFrame, block_size: int = 512) -> DataFrame:
    """(file_path, start, end): one inclusive range per distinct mapped offset, never merged."""
    return mappings.select(
        "file_path", F.col("offset_bytes").alias("start"),
        (F.col("offset_bytes") + (block_size - 1)).alias("end"),
    ).distinct()


def without_mount(ranges: DataFrame, handler: Column) -> DataFrame:
    """Decisions when file contents cannot be read: everything is kept."""
    return ranges.select(
        "file_path", "start", "end", handler.alias("handler"), F.lit(True).alias("keep_region"),
        F.concat(handler, F.lit(": no fs_root; escalate")).alias("reason"),
        F.concat(handler, F.lit(": no fs_root; escalate")).alias("file_reason"),
    )


def media_decisions(ranges: DataFrame, files: DataFrame, trusted: DataFrame) -> DataFrame:
    """JPEG, PNG, MP3, MP4: trusted content is dropped, everything else escalates. ``files`` has
    (file_path, handler) with either the content, of which only its hash and first bytes reach the join, or these two as
    ``sha256`` and ``magic``."""
    facts = files.filter(F.col("handler").isin(MEDIA))
    if "content" in files.columns:
        facts = facts.withColumns({"sha256": F.sha2("content", 256), "magic": F.substring("content", 1, 8)})
    facts = facts.select("file_path", "handler", "sha256", "magic")
    known = trusted.select("sha256").distinct().withColumn("_known", F.lit(True))
    signed = reduce(
        lambda acc, k: acc.when(F.col("handler") == k, media_signature(k, F.col("magic"))),
        MEDIA[1:], F.when(F.col("handler") == MEDIA[0], media_signature(MEDIA[0], F.col("magic"))),
    )
    judged = facts.join(known, "sha256", "left").select(
        "file_path", "handler", F.col("_known").isNotNull().alias("trusted"), signed.alias("signed")
    )
    joined = ranges.join(judged, "file_path")
    label = F.when(F.col("trusted"), ": trusted (sha256)").otherwise(": untrusted")
    file_label = F.when(~F.col("trusted") & ~F.col("signed"), F.lit(": untrusted; metadata encrypted")).otherwise(label)
    return joined.select(
        "file_path", "start", "end", "handler", (~F.col("trusted")).alias("keep_region"),
        F.concat("handler", label).alias("reason"),
        F.concat("handler", file_label).alias("file_reason"),
    )


def centred_sample(content: Column, start: Column, end: Column, limit: int | None = None) -> Column:
    """The bytes of an inclusive range, cut at the end of file; with a ``limit`` at most so many from its middle."""
    size = F.length(content).cast("bigint")
    s = F.greatest(start, F.lit(0).cast("bigint"))
    e = F.least(end, size - 1)
    span = e - s + 1
    if limit is None:
        return F.when(span > 0, content.substr((s + 1).cast("int"), span.cast("int"))).otherwise(F.lit(b""))
    centred = F.greatest(s, s + floor_div(span, 2) - limit // 2)
    at = F.when(span <= limit, s).otherwise(F.least(centred, F.greatest(e - limit + 1, F.lit(0).cast("bigint"))))
    take = F.least(span, F.lit(limit).cast("bigint"))
    return F.when(span > 0, content.substr((at + 1).cast("int"), take.cast("int"))).otherwise(F.lit(b""))


def text_decisions(
    ranges: DataFrame, files: DataFrame, trusted: DataFrame, sample_bytes: int | None = None,
) -> DataFrame:
    """Text: trusted files are dropped; a range is kept when it is not valid UTF-8. With ``sample_bytes`` only so many
    bytes from the middle of a range are looked at."""
    known = trusted.select("sha256").distinct().withColumn("_known", F.lit(True))
    facts = files.filter(F.col("handler") == "text").select(
        "file_path", "content", F.sha2("content", 256).alias("sha256")
    ).join(known, "sha256", "left")
    sampled = ranges.join(facts, "file_path").select(
        "file_path", "start", "end", F.col("_known").isNotNull().alias("trusted"),
        centred_sample(F.col("content"), F.col("start"), F.col("end"), sample_bytes).alias("sample"),
    )
    scored = sampled.select(
        "file_path", "start", "end", "trusted",
        (F.length("sample") == 0).alias("blank"),
        utf8_error_count(F.col("sample")).alias("errors"),
    )
    bad = F.col("blank") | (F.col("errors") > 0)
    reason = text_reason(F.col("trusted"), F.col("blank"), F.col("errors"))
    return scored.select(
        "file_path", "start", "end", F.lit("text").alias("handler"),
        (~F.col("trusted") & bad).alias("keep_region"), reason.alias("reason"),
        F.when(F.col("trusted"), "text: trusted (sha256)").alias("file_reason"),
    )


def generic_decisions(ranges: DataFrame, files: DataFrame) -> DataFrame:
    only = files.filter(F.col("handler") == "generic").select("file_path")
    return ranges.join(only, "file_path", "left_semi").select(
        "file_path", "start", "end", F.lit("generic").alias("handler"),
        F.lit(True).alias("keep_region"), F.lit("generic: keep").alias("reason"),
        F.lit("generic: keep").alias("file_reason"),
    )


def file_decisions(decisions: DataFrame) -> DataFrame:
    """(file_path, keep_file, fileaware_reason) from range decisions."""
    rolled = decisions.groupBy("file_path", "handler").agg(
        F.bool_or("keep_region").alias("keep_file"), F.max("file_reason").alias("_r")
    )
    text = F.when(
        F.col("keep_file"), "text: suspicious (invalid UTF-8) regions kept"
    ).otherwise("text: all suspicious regions were valid UTF-8 (benign)")
    generic = F.concat(
        F.col("handler"),
        F.when(F.col("keep_file"), ": suspicious regions kept").otherwise(": all regions benign"),
    )
    return rolled.select(
        "file_path", "keep_file",
        F.coalesce("_r", F.when(F.col("handler") == "text", text).otherwise(generic))
        .alias("fileaware_reason"),
    )


def kept_offsets(decisions: DataFrame, block_size: int = 512) -> DataFrame:
    """(file_path, offset_bytes) covered by kept ranges."""
    first = floor_div(F.col("start"), block_size)
    last = floor_div(F.col("end"), block_size)
    blocks = decisions.filter("keep_region").select(
        "file_path", F.explode(F.sequence(first, last)).alias("_i")
    )
    return blocks.select("file_path", (F.col("_i") * block_size).alias("offset_bytes")).distinct()


def apply_region_decisions(
    mappings: DataFrame, decisions: DataFrame, block_size: int = 512, undecided_kept: bool = True,
) -> DataFrame:
    """Mappings inside kept ranges. Files without any decision stay unless ``undecided_kept`` is
    off (a strict inner join on kept ranges)."""
    kept = mappings.join(kept_offsets(decisions, block_size), ["file_path", "offset_bytes"], "left_semi")
    if not undecided_kept:
        return kept
    rest = mappings.join(decisions.select("file_path").distinct(), "file_path", "left_anti")
    return kept.unionByName(rest)


def apply_file_decisions(mappings: DataFrame, file_decisions: DataFrame) -> DataFrame:
    """File-level keep or drop; files without a decision stay."""
    dropped = file_decisions.filter(~F.coalesce("keep_file", F.lit(True))).select("file_path")
    return mappings.join(dropped.distinct(), "file_path", "left_anti")


def untrusted_mappings(mappings: DataFrame, decisions: DataFrame, block_size: int = 512) -> DataFrame:
    """Kept mappings whose reason mentions untrusted content."""
    named = decisions.filter(F.lower("reason").contains("untrusted"))
    return mappings.join(
        kept_offsets(named, block_size), ["file_path", "offset_bytes"], "left_semi"
    ).select("file_path", "block_id", "offset_bytes").distinct()


def update_regions(regions: DataFrame, mappings: DataFrame) -> DataFrame:
    """Regions with at least one block that is still mapped."""
    alive = (
        regions.select(*REGION_KEY, F.explode("block_ids").alias("block_id"))
        .join(mappings.select("block_id").distinct(), "block_id", "left_semi")
        .select(*REGION_KEY).distinct()
    )
    return regions.join(alive, REGION_KEY, "left_semi")
