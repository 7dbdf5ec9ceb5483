"""Byte statistics and per-file verdicts over document and page contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlens.catalog.registry import query, table
from epochlens.catalog.scansql import adaptive_sql
from epochlens.functions import tables
from epochlens.functions.bytestats import byte_chi2, byte_entropy, byte_stats, printable_ratio, utf8_bytes
from epochlens.functions.text import TEXT_PUNCTUATION, utf8_error_count
from epochlens.operators import chunked
from epochlens.operators.scan import ScanConfig, scan_content
from epochlens.operators.windows import content_verdicts, text_verdicts
from epochlens.session import spread

HIST = """
    b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents),
    h AS (SELECT doc_id, x, count(*) AS c FROM b GROUP BY 1, 2)"""


def _files(spark, d):
    docs = table(spark, d, "documents").select("doc_id", utf8_bytes(F.col("text")).alias("content"))
    return spread(docs)


@query("byte_chi2", f"""
    WITH {HIST}
    SELECT doc_id, CAST(sum(c) AS BIGINT) AS n, round(256.0::DOUBLE * (sum(c * c)::DOUBLE / sum(c)) - sum(c), 4) AS chi2
    FROM h GROUP BY doc_id""")
def _(spark, d):
    return _files(spark, d).select(
        "doc_id", F.length("content").cast("bigint").alias("n"),
        F.round(byte_chi2(F.col("content")), 4).alias("chi2"),
    )


@query("byte_entropy", f"""
    WITH {HIST}, t AS (SELECT doc_id, sum(c) AS n FROM h GROUP BY 1)
    SELECT doc_id, round(-sum(c / n * log2(c / n)), 6) AS entropy
    FROM h JOIN t USING (doc_id) GROUP BY doc_id""")
def _(spark, d):
    return _files(spark, d).select("doc_id", F.round(byte_entropy(F.col("content")), 6).alias("entropy"))


@query("printable_ratio", f"""
    WITH {HIST}
    SELECT doc_id,
           round(sum(CASE WHEN x BETWEEN '20' AND '7E' OR x IN ('09', '0A', '0D') THEN c ELSE 0 END) / sum(c), 6) AS strict_ratio,
           round(sum(CASE WHEN x BETWEEN '20' AND '7E' OR x BETWEEN '09' AND '0D' THEN c ELSE 0 END) / sum(c), 6) AS loose_ratio
    FROM h GROUP BY doc_id""")
def _(spark, d):
    s = _files(spark, d).select("doc_id", byte_stats(F.col("content")).alias("s"))
    return s.select(
        "doc_id", F.round(printable_ratio(F.col("s")), 6).alias("strict_ratio"),
        F.round(printable_ratio(F.col("s"), loose=True), 6).alias("loose_ratio"),
    )


def _verdict_sql(window: int, stride: int, tail: str, mode: str, threshold: float) -> str:
    extra = (
        f"UNION SELECT doc_id, n, hx, n - {window} FROM f WHERE n >= {window}"
        if tail == "overlap" else ""
    )
    ignored = (
        f"CASE WHEN n < {window} THEN n ELSE 0 END" if tail == "overlap"
        else f"CASE WHEN n < {window} THEN n ELSE n - {window} - ((n - {window}) // {stride}) * {stride} END"
    )
    score = (
        "-sum(c / w * log2(c / w))" if mode == "entropy"
        else "256.0::DOUBLE * (sum(c * c)::DOUBLE / max(w)) - max(w)"
    )
    hit = f"score >= {threshold}" if mode == "entropy" else f"score <= {threshold}"
    return f"""
    WITH f AS (SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS hx FROM documents),
    w AS (SELECT doc_id, n, hx, unnest(range(0, n - {window} + 1, {stride})) AS s FROM f
          WHERE n >= {window} {extra}),
    b AS (SELECT doc_id, s, unnest(regexp_extract_all(substr(hx, 2 * s + 1, {2 * window}), '..')) AS x FROM w),
    h AS (SELECT doc_id, s, x, count(*) AS c, {window} AS w FROM b GROUP BY 1, 2, 3),
    sc AS (SELECT doc_id, s, {score} AS score FROM h GROUP BY 1, 2),
    a AS (SELECT doc_id, count(*) AS k, count(*) FILTER (WHERE {hit}) AS bad,
                 min(score) AS lo, max(score) AS hi FROM sc GROUP BY 1)
    SELECT f.doc_id, n AS file_size, coalesce(k, 0) AS num_windows,
           coalesce(bad, 0) AS num_suspicious_windows, {ignored} AS ignored_tail_bytes,
           round(lo, 4) AS min_score, round(hi, 4) AS max_score,
           CASE WHEN k IS NULL THEN 'not_evaluated' WHEN bad > 0 THEN 'encrypted' ELSE 'benign' END AS verdict,
           CASE WHEN k IS NULL THEN 'file_smaller_than_window' ELSE '' END AS note
    FROM f LEFT JOIN a ON f.doc_id = a.doc_id"""


VERDICT = ["doc_id", "file_size", "num_windows", "num_suspicious_windows", "ignored_tail_bytes",
           "min_score", "max_score", "verdict", "note"]


def _verdict(spark, d, **options):
    v = content_verdicts(_files(spark, d), "doc_id", "content", **options)
    return v.select(
        *[F.round(c, 4).alias(c) if c in ("min_score", "max_score") else F.col(c) for c in VERDICT]
    )


@query("window_verdict_entropy", _verdict_sql(4096, 4096, "ignore", "entropy", 4.3))
def _(spark, d):
    return _verdict(spark, d, mode="entropy", entropy_threshold=4.3)


@query("window_verdict_chi2", _verdict_sql(4096, 4096, "ignore", "chi2", 60000))
def _(spark, d):
    return _verdict(spark, d, mode="chi2", chi2_threshold=60000.0)


@query("window_verdict_overlap", _verdict_sql(512, 256, "overlap", "chi2", 6000))
def _(spark, d):
    return _verdict(spark, d, mode="chi2", window=512, stride=256, tail_mode="overlap",
                    chi2_threshold=6000.0)


def _cp1252_hex(keep) -> str:
    """Quoted hex codes of the CP1252 bytes whose character satisfies ``keep``."""
    chars = {b: bytes([b]).decode("cp1252", errors="ignore") for b in range(256)}
    return ", ".join(f"'{b:02X}'" for b, ch in chars.items() if keep(ch))


_TEXTLIKE = _cp1252_hex(lambda ch: ch != "" and (ch.isalnum() or ch.isspace() or ch in TEXT_PUNCTUATION))
_UNDEFINED = _cp1252_hex(lambda ch: ch == "")


# Documents are valid UTF-8, so only a sequence cut at a window edge can be invalid.
@query("text_verdict", f"""
    WITH f AS (SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS hx FROM documents),
    w AS (SELECT doc_id, substr(hx, 2 * unnest(range(0, n - 511, 512)) + 1, 1024) AS hx FROM f WHERE n >= 512),
    l AS (SELECT doc_id, hx, regexp_extract_all(hx, '..') AS b FROM w),
    c AS (SELECT doc_id, length(regexp_extract(hx, '^((?:[89AB][0-9A-F])*)', 1)) // 2
              + CASE WHEN b[512] BETWEEN 'C2' AND 'F4' THEN 1
                     WHEN b[511] BETWEEN 'E0' AND 'F4' AND b[512] BETWEEN '80' AND 'BF' THEN 2
                     WHEN b[510] BETWEEN 'F0' AND 'F4' AND b[511] BETWEEN '80' AND 'BF'
                          AND b[512] BETWEEN '80' AND 'BF' THEN 3 ELSE 0 END
              AS cut,
              len(list_filter(b, lambda x: x IN ({_UNDEFINED}))) = 0
              AND len(list_filter(b, lambda x: x IN ({_TEXTLIKE}))) > 0.85 * 512 AS ansi FROM l),
    s AS (SELECT doc_id, CASE WHEN ansi THEN 0 ELSE cut END AS score FROM c),
    a AS (SELECT doc_id, count(*) AS k, max(score) AS worst, count(*) FILTER (WHERE score > 0) AS bad
          FROM s GROUP BY doc_id)
    SELECT f.doc_id, n AS file_size, coalesce(k, 0) AS num_windows,
           coalesce(bad, 0) AS num_suspicious_windows, CAST(worst AS DOUBLE) AS max_score,
           CASE WHEN k IS NULL THEN 'not_evaluated' WHEN bad > 0 THEN 'encrypted' ELSE 'benign' END AS verdict
    FROM f LEFT JOIN a ON f.doc_id = a.doc_id""")
def _(spark, d):
    v = text_verdicts(_files(spark, d), "doc_id", "content", window=512)
    return v.select(
        "doc_id", "file_size", "num_windows", "num_suspicious_windows",
        F.col("max_score").cast("double").alias("max_score"), "verdict",
    )


# A byte FF never occurs in UTF-8, so every one spliced in is exactly one error.
@query("utf8_error_count", """
    SELECT doc_id, length(text) - length(replace(text, 'e', '')) AS errors FROM documents""")
def _(spark, d):
    latin = F.decode(utf8_bytes(F.col("text")), "ISO-8859-1")
    spoilt = F.encode(F.translate(latin, "e", "\u00ff"), "ISO-8859-1")
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", utf8_error_count(spoilt).alias("errors"))


GRID_SQL = """
    WITH f AS (SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS hx FROM documents),
    p AS (SELECT doc_id, n, hx, unnest(range(0, (n - 16) // 8 + 1)) AS i FROM f WHERE n >= 16),
    b AS (SELECT doc_id, i, unnest(regexp_extract_all(substr(hx, 16 * i + 1, 32), '..')) AS x FROM p),
    h AS (SELECT doc_id, i, x, count(*) AS c FROM b GROUP BY 1, 2, 3),
    s AS (SELECT doc_id, i, 16.0::DOUBLE * sum(c * c) - 16 AS chi2 FROM h GROUP BY 1, 2),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s WHERE chi2 <= 350),
    o AS (SELECT doc_id, i, chi2, i - min(i) OVER (PARTITION BY doc_id, run) AS k FROM g),
    hit AS (SELECT doc_id, i * 8 AS start, i * 8 + 16 AS end_exclusive, chi2 AS chi2_final FROM o WHERE k % 2 = 0),
    last AS (SELECT f.doc_id, n,
                    CASE WHEN n < 16 THEN 0
                         WHEN EXISTS (SELECT 1 FROM hit WHERE hit.doc_id = f.doc_id
                                      AND hit.start = ((n - 16) // 8) * 8)
                         THEN ((n - 16) // 8) * 8 + 16 ELSE ((n - 16) // 8) * 8 + 8 END AS pos FROM f)
    SELECT doc_id, start, end_exclusive, chi2_final FROM hit
    UNION ALL
    SELECT doc_id, pos, n, 0.0 FROM last WHERE n > pos AND n - pos < 16"""


@query("fixed_scan", GRID_SQL)
def _(spark, d):
    cfg = ScanConfig(expand=False)
    return scan_content(_files(spark, d), "doc_id", "content", cfg).select(
        "doc_id", "start", "end_exclusive", "chi2_final"
    )


@query("fixed_windows", GRID_SQL)
def _(spark, d):
    tables.register(spark)
    return spark.sql("""
        SELECT f.doc_id, w.start, w.end_exclusive, w.chi2_final
        FROM {files} f, LATERAL fixed_windows(f.content, 16, 350D) w""", files=_files(spark, d))


@query("chunked_verdict", _verdict_sql(512, 256, "overlap", "chi2", 6000))
def _(spark, d):
    # Chunks of 1,000 bytes, with the rest of the last window behind each.
    files = _files(spark, d).withColumnRenamed("doc_id", "file_path")
    v = chunked.content_verdicts(chunked.cut_chunks(files, 1000, 511), mode="chi2", window=512, stride=256, tail_mode="overlap",
                                 chi2_threshold=6000.0).withColumnRenamed("file_path", "doc_id")
    return v.select(*[F.round(c, 4).alias(c) if c in ("min_score", "max_score") else F.col(c) for c in VERDICT])


ADAPTIVE = ScanConfig(stride=4, min_expansions=2, max_chi2_var=75.0)


@query("adaptive_scan", f"""
    WITH RECURSIVE base AS (
        SELECT doc_id AS id, octet_length(encode(text)) AS n,
               list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::UTINYINT) AS b FROM documents),
    {adaptive_sql(ADAPTIVE)}
    SELECT id AS doc_id, start, stop AS end_exclusive, round(lo, 6) AS chi2_min, round(hi, 6) AS chi2_max, round(var, 6) AS chi2_var,
           round(final, 6) AS chi2_final FROM stretch""")
def _(spark, d):
    scores = ["chi2_min", "chi2_max", "chi2_var", "chi2_final"]
    return scan_content(_files(spark, d), "doc_id", "content", ADAPTIVE).withColumns({c: F.round(c, 6) for c in scores})
