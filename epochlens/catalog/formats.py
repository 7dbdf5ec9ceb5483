"""Format validators on archives, packages and PDF files made from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlens.catalog import samples
from epochlens.catalog.registry import query, table
from epochlens.formats import ooxml, ooxml_ranges, pdf, pdf_ranges, pdf_report
from epochlens.formats import zip as ziparchive
from epochlens.operators.fileaware import file_decisions
from epochlens.operators.manifest import build_manifest
from epochlens.session import cut_lineage


def _with_doc(df):
    return df.withColumn("doc_id", F.regexp_extract("file_path", r"(\d+)", 1).cast("bigint"))


@query("zip_verdict", """
    SELECT doc_id, CASE WHEN lang IN ('de', 'fr') THEN 'encrypted' ELSE 'benign' END AS verdict,
           CAST(4 AS BIGINT) AS num_windows,
           CASE lang WHEN 'de' THEN 'inflate_error' WHEN 'fr' THEN 'gap_present count=1'
                     ELSE 'all_components_ok' END AS note
    FROM documents""")
def _(spark, d):
    v = ziparchive.zip_verdicts(samples.zip_files(spark, d))
    return _with_doc(v).select("doc_id", "verdict", "num_windows", "note")


@query("zip_members", """
    SELECT doc_id, unnest([0, 1]) AS idx, unnest(['a.txt', 'b/raw.dat']) AS entry,
           octet_length(encode(text)) AS usz FROM documents""")
def _(spark, d):
    m = ziparchive.members(samples.zip_files(spark, d), lenient=True)
    return _with_doc(m).select("doc_id", "idx", F.col("name").cast("string").alias("entry"), "usz")


@query("zip_decisions", """
    SELECT '/s/' || doc_id || '.zip' AS file_path, lang = 'de' AS keep_file FROM documents""")
def _(spark, d):
    files = samples.zip_files(spark, d)
    trusted = table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"))
    dec = ziparchive.zip_decisions(_all_blocks(files), files, trusted)
    return file_decisions(dec).select("file_path", "keep_file")


@query("ooxml_verdict", """
    SELECT doc_id, CASE WHEN lang = 'de' THEN 'encrypted' ELSE 'benign' END AS verdict,
           CASE WHEN lang = 'de' THEN 'ooxml_precondition_failed:zip_inflate_error'
                ELSE 'all_components_ok' END AS note
    FROM documents""")
def _(spark, d):
    v = ooxml.ooxml_verdicts(samples.docx_files(spark, d))
    return _with_doc(v).select("doc_id", "verdict", "note")


@query("pdf_verdict", """
    SELECT doc_id, CASE WHEN lang IN ('de', 'fr') THEN 'encrypted' ELSE 'benign' END AS verdict,
           CAST(7 AS BIGINT) AS num_windows,
           CASE lang WHEN 'de' THEN 'filter_decode_exception:FlateDecode'
                     WHEN 'fr' THEN 'missing_%%EOF_in_tail' ELSE 'all_components_ok' END AS note
    FROM documents""")
def _(spark, d):
    v = pdf.pdf_verdicts(samples.pdf_files(spark, d))
    return _with_doc(v).select("doc_id", "verdict", "num_windows", "note")


@query("pdf_whitelist", """
    SELECT doc_id, CAST(5 AS BIGINT) AS obj, 'image' AS kind,
           256 + least(256, octet_length(encode(text))) AS length FROM documents""")
def _(spark, d):
    w = pdf.stream_whitelist(samples.pdf_files(spark, d)).withColumnRenamed("pdf_path", "file_path")
    return _with_doc(w).select("doc_id", "obj", "kind", "length")


def _all_blocks(files):
    n = F.floor((F.length("content") + 511) / 512)
    return files.select("file_path", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("i")).select(
        "file_path", (F.col("i") * 512).alias("start"), (F.col("i") * 512 + 511).alias("end")
    )


# The image part of every package is listed as trusted; the document part is damaged in German ones.
@query("ooxml_decisions", """
    SELECT '/s/' || doc_id || '.docx' AS file_path, lang = 'de' AS keep_file FROM documents""")
def _(spark, d):
    files = samples.docx_files(spark, d)
    media = table(spark, d, "documents").select(F.sha2(samples.image_bytes(), 256).alias("sha256"))
    return file_decisions(ooxml_ranges.ooxml_decisions(_all_blocks(files), files, media)).select(
        "file_path", "keep_file"
    )


@query("pdf_decisions", """
    SELECT '/s/' || doc_id || '.pdf' AS file_path, lang IN ('de', 'fr') AS keep_file,
           CASE lang WHEN 'de' THEN 'pdf: nested metadata encrypted'
                     WHEN 'fr' THEN 'pdf: metadata encrypted (missing EOF)'
                     ELSE 'pdf: all regions benign' END AS fileaware_reason
    FROM documents""")
def _(spark, d):
    files = samples.pdf_files(spark, d)
    images = table(spark, d, "documents").select(F.sha2(samples.pdf_image_bytes(), 256).alias("sha256"))
    return file_decisions(pdf_ranges.pdf_decisions(_all_blocks(files), files, images))


@query("trusted_manifest", """
    SELECT '/s/' || doc_id || '.pdf' AS container, 'pdf' AS source FROM documents
    UNION ALL SELECT '/m/' || page_id || '.svg', 'file' FROM pages""")
def _(spark, d):
    pages = table(spark, d, "pages").select(
        F.concat(F.lit("/m/"), F.col("page_id").cast("string"), F.lit(".svg")).alias("file_path"),
        F.encode("html", "UTF-8").alias("content"),
    )
    files = samples.pdf_files(spark, d).select("file_path", "content").unionByName(pages)
    return build_manifest(files).select("container", "source")


@query("pdf_stream_report", """
    SELECT doc_id, unnest([0, 1]) AS idx, unnest([TRUE, FALSE]) AS declared_flate,
           unnest([lang <> 'de', TRUE]) AS decodes FROM documents""")
def _(spark, d):
    r = pdf_report.stream_report(samples.pdf_files(spark, d))
    return _with_doc(r).select("doc_id", "idx", "declared_flate", "decodes")


@query("pdf_zone_kinds", """
    SELECT 'stream' AS kind, 2 * count(*) AS n FROM documents""")
def _(spark, d):
    z = pdf_report.zone_report(samples.pdf_files(spark, d)).filter("kind = 'stream'")
    return z.groupBy("kind").agg(F.count("*").alias("n"))


# Half a file of each kind: nothing of it can be followed, and nothing of it is let go.
@query("hostile_files", """
    SELECT '/s/' || doc_id || ext AS file_path, TRUE AS keep_file
    FROM documents, (SELECT unnest(['.zip', '.docx', '.pdf']) AS ext)""")
def _(spark, d):
    cut = lambda files: files.select("file_path", F.substring("content", F.lit(1), F.length("content") / 2).alias("content"))
    none = spark.createDataFrame([], "sha256 string")
    parts = []
    for files, decide in ((samples.zip_files, ziparchive.zip_decisions), (samples.docx_files, ooxml_ranges.ooxml_decisions),
                          (samples.pdf_files, pdf_ranges.pdf_decisions)):
        half = cut_lineage(cut(files(spark, d)))  # written once: building the files takes longer than reading them
        # Every range is kept, not only one.
        parts.append(decide(_all_blocks(half), half, none).groupBy("file_path").agg(F.bool_and("keep_region").alias("keep_file")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# The raw data lie behind seventy heads that lead nowhere; raw output of less than 1,024 bytes is taken for chance.
@query("pdf_islands", """
    SELECT doc_id, 'raw' AS kind, octet_length(encode(text)) AS size FROM documents WHERE octet_length(encode(text)) >= 1024
    UNION ALL SELECT doc_id, 'zlib', greatest(1, least(100, octet_length(encode(text)))) FROM documents""")
def _(spark, d):
    return _with_doc(pdf_report.island_report(samples.island_files(spark, d))).select("doc_id", "kind", "size")
