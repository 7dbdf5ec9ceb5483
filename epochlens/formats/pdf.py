"""PDF files as tables of streams and objects.

Python marks where streams and objects lie in a file; dictionaries, lengths, filters, whitelists and
verdicts are column expressions, joins and aggregates.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.formats.zip import roll_components
from epochlens.functions.batches import slices_of
from epochlens.functions.paths import extension
from epochlens.functions.pdffilters import DECODED, OPAQUE, decode_filters, decode_parms, filter_names
from epochlens.session import cut_lineage

# Fixed values of the format scan.
HEADER = r"%PDF-[0-9]\.[0-9]"
HEAD_BYTES = 64 * 1024
TAIL_BYTES = 256 * 1024
OBJECT = re.compile(rb"(?m)^[ \t]*([0-9]+)[ \t]+([0-9]+)[ \t]+obj\b")
FONT_REF = re.compile(rb"/FontFile(?:2|3)?[ \t\r\n]+([0-9]+)[ \t]+[0-9]+[ \t]+R\b")
NUMBER = re.compile(rb"[-+]?[0-9]+")
COMMENT = re.compile(rb"(?m)%.*?$")
IMAGE = r"/Subtype[ \t\r\n]+/Image\b"
DICT_WINDOW = 64 * 1024
LENGTH_WINDOW = 256 * 1024


@dataclass(frozen=True)
class PdfConfig:
    whitelist: bool = False


PIECE_SCHEMA = (
    "file_path string, kind string, idx int, obj bigint, gen bigint, start bigint, stop bigint, "
    "dict string, number bigint, sha256 string, note string"
)
_ARROW = pa.schema([
    ("file_path", pa.string()), ("kind", pa.string()), ("idx", pa.int32()), ("obj", pa.int64()),
    ("gen", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("dict", pa.string()),
    ("number", pa.int64()), ("sha256", pa.string()), ("note", pa.string()),
])


def _object_number(digits: bytes) -> int:
    """A number of at most 18 digits; a longer one makes the file unreadable."""
    if len(digits.lstrip(b"0")) > 18:
        raise ValueError("object number out of range")
    return int(digits)


def _trim_eol(buf: bytes, start: int, stop: int) -> int:
    """Without one line end before ``stop``."""
    if buf[stop - 2: stop] == b"\r\n" and stop - 2 >= start:
        return stop - 2
    return stop - 1 if stop - 1 >= start and buf[stop - 1: stop] in (b"\n", b"\r") else stop


def stream_rows(buf: bytes):
    """Streams by keyword search: span of the data and the dictionary text before it."""
    found, at = [], 0
    while True:
        key = buf.find(b"stream", at)
        if key < 0 or key + 6 >= len(buf):
            return found, ""
        eol = 2 if buf[key + 6: key + 8] == b"\r\n" else 1 if buf[key + 6: key + 7] == b"\n" else 0
        at = key + 6 + eol
        if not eol:
            continue
        opened = buf.rfind(b"<<", max(0, key - DICT_WINDOW), key)
        closed = buf.rfind(b">>", opened, key) if opened >= 0 else -1
        if closed < 0:
            continue
        end = buf.find(b"endstream", at)
        if end < 0:
            return found, "missing_endstream"
        found.append({
            "kind": "stream", "idx": len(found), "start": at, "stop": _trim_eol(buf, at, end),
            "dict": buf[opened: closed + 2].decode("latin-1"),
        })
        at = end + len(b"endstream")


def object_rows(buf: bytes):
    """Indirect objects: first integer of the body, and span, dictionary and hash of the stream an
    object holds."""
    heads = list(OBJECT.finditer(buf))
    for i, m in enumerate(heads):
        limit = heads[i + 1].start() if i + 1 < len(heads) else len(buf)
        row = {"kind": "object", "idx": i, "obj": _object_number(m[1]), "gen": _object_number(m[2])}
        stop = buf.find(b"endobj", m.end(), min(limit, m.end() + LENGTH_WINDOW))
        if stop >= 0:
            first = NUMBER.search(COMMENT.sub(b"", buf[m.end(): stop]))
            if first and len(first[0]) < 18:
                row["number"] = int(first[0])
        key = buf.find(b"stream", m.end(), limit)
        if key >= 0:
            at = key + 6
            while at < limit and buf[at: at + 1] in (b" ", b"\t"):
                at += 1
            eol = 2 if buf[at: at + 2] == b"\r\n" else 1 if buf[at: at + 1] in (b"\n", b"\r") else 0
            end = buf.find(b"endstream", at + eol, limit)
            opened = buf.rfind(b"<<", max(m.start(), key - DICT_WINDOW), key)
            closed = buf.find(b">>", opened, key) if opened >= 0 else -1
            if eol and end >= 0:
                row["start"], row["stop"] = at + eol, _trim_eol(buf, at + eol, end)
                row["dict"] = buf[opened: closed + 2].decode("latin-1") if closed >= 0 else ""
                row["sha256"] = hashlib.sha256(buf[row["start"]: row["stop"]]).hexdigest()
        yield row


def file_rows(buf: bytes) -> list[dict]:
    streams, why = stream_rows(buf)
    fonts = [{"kind": "font", "obj": n} for n in {_object_number(m[1]) for m in FONT_REF.finditer(buf)}]
    return [{"kind": "map", "number": len(streams), "note": why}, *streams, *object_rows(buf), *fonts]


def pieces(files: DataFrame, cfg: PdfConfig = PdfConfig()) -> DataFrame:
    """One ``map`` row per file, then its ``stream``, ``object`` and ``font`` rows. A file whose reading fails has the
    ``map`` row only, with the exception as its note."""

    def cut(batches):
        for batch in slices_of(batches):
            rows = []
            for path, value in zip(batch.column(0), batch.column(1)):
                try:
                    own = file_rows(value.as_py() or b"")
                except Exception as error:  # one bad file must not end the job: it is kept, with the reason
                    own = [{"kind": "map", "number": 0, "note": f"exception: {type(error).__name__}: {error}"}]
                rows += [{"file_path": path.as_py(), **row} for row in own]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select("file_path", "content").mapInArrow(cut, PIECE_SCHEMA)


def prelude(files: DataFrame) -> DataFrame:
    """File-wide invariants, from the two ends of each file only."""
    size = F.length("content")
    head = F.decode(F.substring("content", 1, HEAD_BYTES), "ISO-8859-1")
    take = F.least(size, F.lit(TAIL_BYTES))
    tail = F.decode(F.col("content").substr(size - take + 1, take), "ISO-8859-1")
    return files.select(
        "file_path", size.cast("bigint").alias("file_size"), F.sha2("content", 256).alias("pdf_sha256"),
        head.rlike(HEADER).alias("header_ok"), tail.rlike(r"\bstartxref\b").alias("startxref_ok"),
        tail.rlike(r"%%EOF\s*$").alias("eof_ok"),
    )


def stream_lengths(parts: DataFrame) -> DataFrame:
    """Streams with the length their dictionary states: directly, or through a numeric object
    found by number (the first one in the file counts). Null where neither gives one."""
    ref = r"/Length\s+([0-9]+)\s+([0-9]+)\s+R\b"
    s = parts.filter("kind = 'stream'").select(
        "file_path", "idx", "start", "stop", "dict",
        F.regexp_extract("dict", ref, 1).try_cast("bigint").alias("r_obj"),
        F.regexp_extract("dict", ref, 2).try_cast("bigint").alias("r_gen"),
        F.regexp_extract("dict", r"/Length\s+([0-9]+)\b", 1).try_cast("bigint").alias("direct"),
    )
    numbers = parts.filter("kind = 'object'").groupBy(
        "file_path", F.col("obj").alias("r_obj"), F.col("gen").alias("r_gen")
    ).agg(F.min_by("number", "idx").alias("pointed"))
    j = s.join(numbers, ["file_path", "r_obj", "r_gen"], "left")
    stated = F.when(F.col("r_obj").isNotNull(), F.col("pointed")).otherwise(F.col("direct"))
    return j.select("file_path", "idx", "start", "stop", "dict", stated.alias("stated"))


def stream_bytes(lengths: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``raw``: the stated length when it is positive and inside the file, else the bytes up
    to ``endstream``."""
    size = F.length("content").cast("bigint")
    usable = (F.col("stated") > 0) & (F.col("start") + F.col("stated") <= size)
    n = F.when(usable, F.col("stated")).otherwise(F.greatest(F.col("stop") - F.col("start"), F.lit(0)))
    raw = F.col("content").substr((F.col("start") + 1).cast("int"), n.cast("int"))
    return lengths.join(files.select("file_path", "content"), "file_path").select(
        "file_path", "idx", "start", "stop", "dict", raw.alias("raw")
    )


def stream_checks(raw_streams: DataFrame, cfg: PdfConfig = PdfConfig()) -> DataFrame:
    """(file_path, idx, reason): null reason for streams that decode. Only sizes leave the worker."""
    named = raw_streams.withColumn("filters", filter_names(F.col("dict"))).withColumn(
        "unknown", F.exists("filters", lambda f: ~f.isin(DECODED + OPAQUE))
    )
    raw = F.when(~F.col("unknown"), F.col("raw"))
    dec = named.select(
        "file_path", "idx", "filters", "unknown",
        decode_filters(raw, F.col("filters"), decode_parms(F.col("dict")), sized=True).alias("d"),
    ).select(
        "file_path", "idx", "filters", "unknown", F.col("d.ok").alias("ok")
    )
    return dec.select(
        "file_path", "idx",
        F.when(F.col("unknown"), F.concat(F.lit("unsupported_filter_chain:"), F.to_json("filters")))
        .when(~F.col("ok"), F.concat(F.lit("filter_decode_exception:"), F.coalesce(F.get("filters", F.lit(0)), F.lit(""))))
        .alias("reason"),
    )


def media_streams(parts: DataFrame) -> DataFrame:
    """(file_path, obj, gen, kind, sha256, length): image streams and streams that fonts refer to."""
    fonts = parts.filter("kind = 'font'").select("file_path", "obj").distinct().withColumn("_font", F.lit(True))
    objs = parts.filter("kind = 'object' AND sha256 IS NOT NULL").join(fonts, ["file_path", "obj"], "left")
    image = F.col("dict").rlike(IMAGE)
    return objs.filter(image | F.col("_font").isNotNull()).select(
        "file_path", "obj", "gen", F.when(image, "image").otherwise("font").alias("kind"), "sha256",
        (F.col("stop") - F.col("start")).alias("length"),
    )


def stream_whitelist(files: DataFrame, cfg: PdfConfig = PdfConfig()) -> DataFrame:
    """Whitelist rows (pdf_path, pdf_sha256, file_size, obj, gen, kind, sha256, length), flat so
    that a file with very many streams stays spread out; files without streams keep one row with
    null stream columns."""
    ids = prelude(files).select("file_path", "pdf_sha256", "file_size")
    return ids.join(media_streams(pieces(files, cfg)), "file_path", "left").withColumnRenamed("file_path", "pdf_path")


def whitelist_json(flat: DataFrame) -> DataFrame:
    """One nested entry per file, for the JSON form."""
    item = F.struct("obj", "gen", "kind", "sha256", "length")
    return flat.groupBy("pdf_path", "pdf_sha256", "file_size").agg(
        F.array_sort(F.collect_list(F.when(F.col("sha256").isNotNull(), item))).alias("streams")
    )


def flatten_whitelist(entries: DataFrame) -> DataFrame:
    """(pdf_sha256, sha256) of nested entries; a file with no streams keeps a null hash."""
    return entries.select(
        F.lower("pdf_sha256").alias("pdf_sha256"), F.explode_outer("streams").alias("s")
    ).select("pdf_sha256", F.lower("s.sha256").alias("sha256")).distinct()


def _row(order, bad: Column, reason, good="ok") -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        lit(order).cast("bigint").alias("o"), F.when(bad, 1).otherwise(0).alias("score"),
        F.when(bad, lit(reason)).otherwise(lit(good)).alias("reason"),
    )


def whitelist_components(facts: DataFrame, parts: DataFrame, whitelist: DataFrame | None) -> DataFrame:
    if whitelist is None:
        return facts.select("file_path", _row(5, F.lit(False), "", "whitelist_disabled").alias("c"))
    listed = whitelist.select("pdf_sha256").distinct().withColumn("_in", F.lit(True))
    keyed = facts.select("file_path", "pdf_sha256").join(listed, "pdf_sha256", "left")
    bad = media_streams(parts).join(keyed.filter("_in"), "file_path").join(
        whitelist.select("pdf_sha256", "sha256").filter("sha256 IS NOT NULL").distinct(),
        ["pdf_sha256", "sha256"], "left_anti",
    )
    per_stream = bad.select("file_path", _row(F.lit(100) + F.col("obj"), F.lit(True), "stream_hash_not_whitelisted").alias("c"))
    spoilt = bad.select("file_path").distinct().withColumn("_bad", F.lit(True))
    whole = keyed.join(spoilt, "file_path", "left").filter("_bad IS NULL").select(
        "file_path", _row(5, F.col("_in").isNull(), "pdf_not_in_whitelist",
                          "all_image_font_stream_hashes_whitelisted").alias("c"),
    )
    return whole.unionByName(per_stream)


def pdf_verdicts(
    files: DataFrame, cfg: PdfConfig = PdfConfig(), whitelist: DataFrame | None = None,
) -> DataFrame:
    """Validator verdict per file."""
    wanted = (extension(F.col("file_path")) == "pdf") & (F.length("content") > 0)
    body = files.filter(wanted)
    parts = cut_lineage(pieces(body, cfg))
    facts = cut_lineage(prelude(files))
    scanned = parts.filter("kind = 'map'").select("file_path", "note", "number")
    heads = facts.join(scanned, "file_path")
    base = heads.select("file_path", F.explode(F.array(
        _row(1, ~F.col("header_ok"), "missing_pdf_header"),
        _row(2, ~F.col("startxref_ok"), "missing_startxref_in_tail"),
        _row(3, ~F.col("eof_ok"), "missing_%%EOF_in_tail"),
        _row(4, F.col("note") != "", F.col("note"), F.concat(F.lit("ok streams="), F.col("number").cast("string"))),
    )).alias("c"))
    whole = heads.filter("note = ''").select("file_path", "pdf_sha256")
    listed = whitelist_components(whole, parts, whitelist)
    checks = stream_checks(stream_bytes(
        stream_lengths(parts).join(whole.select("file_path"), "file_path", "left_semi"), body), cfg)
    streams = checks.select("file_path", _row(
        F.lit(1 << 40) + F.col("idx"), F.col("reason").isNotNull(), F.col("reason")).alias("c"))
    rolled = roll_components(base.unionByName(listed).unionByName(streams).select("file_path", "c.*"))
    skip = F.when(F.col("file_size") == 0, "empty_file").otherwise("not_pdf_intent")
    j = facts.select("file_path", "file_size").join(rolled, "file_path", "left")
    return j.select(
        "file_path", "file_size", F.coalesce("num_windows", F.lit(0)).alias("num_windows"),
        F.coalesce("num_suspicious_windows", F.lit(0)).alias("num_suspicious_windows"),
        "min_score", "max_score", F.coalesce("verdict", F.lit("not_evaluated")).alias("verdict"),
        F.coalesce("note", skip).alias("note"),
    )
