"""A versioned block device derived from the documents table, and the detection steps on it.

Every document is a file of 512-byte blocks. Epoch 1 stores all of them; epoch 2 overwrites the
German ones with hash output (ciphertext-like); epoch 3 edits the French ones in place.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlens.catalog.registry import query, table
from epochlens.catalog.scansql import adaptive_sql
from epochlens.functions.bytestats import utf8_bytes
from epochlens.functions.ints import ceil_div
from epochlens.config import DetectConfig
from epochlens.operators import chunked, fileaware, trust
from epochlens.operators.delta import delta_blocks, extent_groups
from epochlens.operators.intervals import map_blocks
from epochlens.operators.scan import ScanConfig, extent_metrics, suspicious_regions
from epochlens.operators.versions import changed_blocks, restorable_blocks
from epochlens.plans.detect import detect
from epochlens.session import spread

BLOCK = 512
CLUSTER = 4096
SPAN = 1 << 22  # blocks reserved per document; a string cannot outgrow it


def _split(docs, content, epoch: int):
    """Blocks of a content column, the last one padded with zeros."""
    sized = docs.select("doc_id", content.alias("c")).filter(F.length("c") > 0)
    parts = sized.select(
        "doc_id", "c",
        F.explode(F.sequence(F.lit(0).cast("bigint"), ceil_div(F.length("c"), BLOCK) - 1)).alias("i"),
    )
    raw = F.col("c").substr((F.col("i") * BLOCK + 1).cast("int"), F.lit(BLOCK))
    return parts.select(
        (F.col("doc_id") * SPAN + F.col("i")).alias("id"),
        F.rpad(raw, BLOCK, F.lit(b"\x00")).alias("block"), F.lit(epoch).alias("epoch"),
    )


def noise_block(seed):
    """512 bytes of chained hashes for a seed text."""
    return F.unhex(F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.sha2(F.concat(seed, F.lit(":"), k.cast("string")), 256)),
        "",
    ))


def mutations(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "text"))
    plain = _split(docs, utf8_bytes(F.col("text")), 1)
    attacked = _split(docs.filter("lang = 'de'"), utf8_bytes(F.col("text")), 2).select(
        "id", noise_block(F.col("id").cast("string")).alias("block"), "epoch"
    )
    edited = _split(
        docs.filter("lang = 'fr'"), utf8_bytes(F.replace(F.col("text"), F.lit("a"), F.lit("o"))), 3
    )
    return plain.unionByName(attacked).unionByName(edited)


def dirty_bits(spark, d):
    return mutations(spark, d).select("epoch", "id")


def file_extents(spark, d):
    """Cluster runs: each document is one run; its second half is also owned by a stream."""
    spc = CLUSTER // BLOCK
    docs = table(spark, d, "documents").select(
        "doc_id", "source", ceil_div(F.octet_length("text"), CLUSTER).alias("k")
    ).filter("k > 0")
    base = F.col("doc_id") * (SPAN // spc)
    whole = docs.select(
        base.alias("start_block"), (base + F.col("k") - 1).alias("end_block"),
        F.col("doc_id").cast("int").alias("file_id"), _path().alias("file_path"),
        F.lit(0).cast("bigint").alias("file_offset_bytes"),
    )
    half = F.col("k") - F.floor(F.col("k") / 2)
    stream = docs.filter("k > 1").select(
        (base + half).alias("start_block"), (base + F.col("k") - 1).alias("end_block"),
        F.col("doc_id").cast("int").alias("file_id"),
        F.concat(_path(), F.lit(":tail")).alias("file_path"),
        F.lit(0).cast("bigint").alias("file_offset_bytes"),
    )
    return whole.unionByName(stream)


def _path():
    return F.concat(F.lit("/docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


NOISE = " || ".join(f"sha256(id || ':{k}')" for k in range(16))

MUT_SQL = f"""
    t AS (SELECT doc_id, lang, hex(encode(text)) AS h1, hex(encode(replace(text, 'a', 'o'))) AS h3,
                 octet_length(encode(text)) AS n FROM documents WHERE length(text) > 0),
    i AS (SELECT *, unnest(range((n + 511) // 512)) AS i FROM t),
    v AS (SELECT doc_id * {SPAN} + i AS id, lang, rpad(substr(h1, i * 1024 + 1, 1024), 1024, '0') AS b1,
                 rpad(substr(h3, i * 1024 + 1, 1024), 1024, '0') AS b3 FROM i),
    mut AS (SELECT id, b1 AS hx, 1 AS epoch FROM v
            UNION ALL SELECT id, upper({NOISE}), 2 FROM v WHERE lang = 'de'
            UNION ALL SELECT id, b3, 3 FROM v WHERE lang = 'fr')"""

PAIR_SQL = f"""
    {MUT_SQL},
    pair AS (SELECT id, coalesce(arg_max(hx, epoch) FILTER (WHERE epoch < 2), repeat('00', 512)) AS o,
                    arg_max(hx, epoch) AS w
             FROM mut WHERE epoch <= 3 AND id IN (SELECT id FROM mut WHERE epoch BETWEEN 2 AND 3)
             GROUP BY id),
    ch AS (SELECT id, id // 8 AS extent_id, o, w FROM pair WHERE o <> w)"""

DELTA_SQL = f"""
    {PAIR_SQL},
    r AS (SELECT *, id - row_number() OVER (PARTITION BY extent_id ORDER BY id) AS run FROM ch),
    y AS (SELECT extent_id, run, id, o, w, unnest(range(512)) AS k FROM r),
    q AS (SELECT extent_id, run, id * 512 + k AS pos FROM y
          WHERE substr(o, 2 * k + 1, 2) <> substr(w, 2 * k + 1, 2)),
    e AS (SELECT extent_id, run, max(id) * 512 + 512 AS run_end, min(id) * 512 AS run_at FROM r GROUP BY 1, 2),
    l AS (SELECT *, lag(pos) OVER (PARTITION BY extent_id, run ORDER BY pos) AS pv FROM q),
    z AS (SELECT *, sum(CASE WHEN pv IS NULL OR pos - pv - 1 > 16 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY extent_id, run ORDER BY pos) AS dno FROM l),
    dd AS (SELECT extent_id, run, dno, min(pos) AS a, max(pos) + 1 AS b FROM z GROUP BY 1, 2, 3),
    d AS (SELECT extent_id, run_at, a, CASE WHEN run_end - b <= 16 THEN run_end ELSE b END AS b
          FROM dd JOIN e USING (extent_id, run))"""


def _changed(spark, d):
    return changed_blocks(mutations(spark, d), dirty_bits(spark, d), 2, 3)


@query("changed_blocks", f"""
    WITH {PAIR_SQL}
    SELECT extent_id, id AS block_id, sha256(unhex(o)) AS old_sha256, sha256(unhex(w)) AS new_sha256 FROM ch""")
def _(spark, d):
    return _changed(spark, d).select(
        "extent_id", "block_id", F.sha2("old", 256).alias("old_sha256"), F.sha2("new", 256).alias("new_sha256")
    )


@query("delta_blocks", f"""
    WITH {DELTA_SQL}
    SELECT extent_id, CAST(row_number() OVER (PARTITION BY extent_id ORDER BY a) - 1 AS INTEGER) AS delta_block_id,
           CAST(b - a AS INTEGER) AS delta_block_size, a // 512 AS first_block, (b - 1) // 512 AS last_block,
           CAST(a % 512 AS INTEGER) AS start_offset, CAST((b - 1) % 512 AS INTEGER) AS end_offset
    FROM d""")
def _(spark, d):
    return delta_blocks(extent_groups(_changed(spark, d))).select(
        "extent_id", "delta_block_id", "delta_block_size",
        F.element_at("block_ids", 1).alias("first_block"), F.element_at("block_ids", -1).alias("last_block"),
        "start_offset", "end_offset",
    )


REGION_SQL = f"""
    {DELTA_SQL},
    rh AS (SELECT extent_id, min(id) * 512 AS run_at, string_agg(w, '' ORDER BY id) AS hx FROM r GROUP BY extent_id, run),
    dl AS (SELECT extent_id, row_number() OVER (PARTITION BY extent_id ORDER BY a) - 1 AS dn, a, b - a AS n,
                  substr(hx, 2 * (a - run_at) + 1, 2 * (b - a)) AS dx FROM d JOIN rh USING (extent_id, run_at)),
    wp AS (SELECT extent_id, dn, dx, unnest(range(0, (n - 16) // 8 + 1)) AS i FROM dl WHERE n >= 16),
    wb AS (SELECT extent_id, dn, i, unnest(regexp_extract_all(substr(dx, 16 * i + 1, 32), '..')) AS x FROM wp),
    wh AS (SELECT extent_id, dn, i, x, count(*) AS c FROM wb GROUP BY ALL),
    ws AS (SELECT extent_id, dn, i, 16.0::DOUBLE * sum(c * c) - 16 AS chi2 FROM wh GROUP BY ALL),
    wg AS (SELECT *, i - row_number() OVER (PARTITION BY extent_id, dn ORDER BY i) AS grp FROM ws WHERE chi2 <= 350),
    wo AS (SELECT *, i - min(i) OVER (PARTITION BY extent_id, dn, grp) AS k FROM wg),
    hit AS (SELECT extent_id, dn, i * 8 AS s, i * 8 + 16 AS e, chi2 FROM wo WHERE k % 2 = 0),
    fin AS (SELECT dl.extent_id, dl.dn, a, n,
                   CASE WHEN n < 16 THEN 0 WHEN hit.s IS NOT NULL THEN ((n - 16) // 8) * 8 + 16
                        ELSE ((n - 16) // 8) * 8 + 8 END AS pos
            FROM dl LEFT JOIN hit ON hit.extent_id = dl.extent_id AND hit.dn = dl.dn AND hit.s = ((n - 16) // 8) * 8),
    reg AS (SELECT extent_id, dn, a + s AS x, a + e - 1 AS y, chi2 FROM hit JOIN dl USING (extent_id, dn)
            UNION ALL SELECT extent_id, dn, a + pos, a + n - 1, 0.0 FROM fin WHERE n > pos AND n - pos < 16)"""


@query("detect_regions_fixed", f"""
    WITH {REGION_SQL}
    SELECT extent_id, CAST(dn AS INTEGER) AS delta_block_id, x AS byte_start, y AS byte_end_inclusive,
           x // 512 AS lba_start_block, y // 512 AS lba_end_block, CAST(y // 512 - x // 512 + 1 AS INTEGER) AS num_blocks,
           CAST(x % 512 AS INTEGER) AS first_block_offset, CAST(y % 512 AS INTEGER) AS last_block_offset, chi2 AS chi2_final
    FROM reg""")
def _(spark, d):
    return suspicious_regions(extent_groups(_changed(spark, d)), ScanConfig(expand=False)).select(
        "extent_id", "delta_block_id", "byte_start", "byte_end_inclusive", "lba_start_block", "lba_end_block",
        "num_blocks", "first_block_offset", "last_block_offset", "chi2_final",
    )


ADAPTIVE = ScanConfig(stride=4, min_expansions=2, max_chi2_var=75.0)


@query("detect_regions", f"""
    WITH RECURSIVE {DELTA_SQL},
    rh AS (SELECT extent_id, min(id) * 512 AS run_at, string_agg(w, '' ORDER BY id) AS hx FROM r GROUP BY extent_id, run),
    dl AS (SELECT extent_id, row_number() OVER (PARTITION BY extent_id ORDER BY a) - 1 AS dn, a, b AS d_end, b - a AS n,
                  substr(hx, 2 * (a - run_at) + 1, 2 * (b - a)) AS dx FROM d JOIN rh USING (extent_id, run_at)),
    base AS (SELECT a AS id, list_transform(regexp_extract_all(dx, '..'), lambda x: ('0x' || x)::UTINYINT) AS b, n FROM dl),
    {adaptive_sql(ADAPTIVE)},
    reg AS (SELECT extent_id, dn, a, a + start AS x, a + stop - 1 AS y, lo, hi, var, final FROM stretch JOIN dl ON id = a)
    SELECT extent_id, CAST(dn AS INTEGER) AS delta_block_id, x // 512 AS lba_start_block, y // 512 AS lba_end_block,
           x AS byte_start, y AS byte_end_inclusive, CAST(x // 512 - a // 512 AS INTEGER) AS block_idx_start,
           CAST(y // 512 - a // 512 AS INTEGER) AS block_idx_end,
           '[' || array_to_string(range(x // 512, y // 512 + 1), ',') || ']' AS block_ids,
           CAST(x % 512 AS INTEGER) AS first_block_offset, CAST(y % 512 AS INTEGER) AS last_block_offset,
           CAST(y // 512 - x // 512 + 1 AS INTEGER) AS num_blocks, round(lo, 6) AS chi2_min, round(hi, 6) AS chi2_max,
           round(var, 6) AS chi2_var, round(final, 6) AS chi2_final
    FROM reg""")
def _(spark, d):
    scores = ["chi2_min", "chi2_max", "chi2_var", "chi2_final"]
    return suspicious_regions(extent_groups(_changed(spark, d)), ADAPTIVE).withColumn(
        "block_ids", F.to_json("block_ids")
    ).withColumns({c: F.round(c, 6) for c in scores})


@query("extent_metrics", f"""
    WITH {REGION_SQL},
    b AS (SELECT extent_id, count(*) AS n_blocks FROM ch GROUP BY 1),
    m AS (SELECT extent_id, count(*) AS n_deltas, sum(b - a) AS delta_bytes FROM d GROUP BY 1),
    g AS (SELECT extent_id, count(*) AS n_regions, sum(y - x + 1) AS region_bytes FROM reg GROUP BY 1)
    SELECT extent_id, n_blocks, n_deltas, CAST(delta_bytes AS BIGINT) AS delta_bytes, coalesce(n_regions, 0) AS n_regions,
           CAST(coalesce(region_bytes, 0) AS BIGINT) AS region_bytes
    FROM b JOIN m USING (extent_id) LEFT JOIN g USING (extent_id)""")
def _(spark, d):
    return extent_metrics(extent_groups(_changed(spark, d)), ScanConfig(expand=False)).drop("delta_seconds", "scan_seconds")


EXTENT_SQL = f"""
    x AS (SELECT doc_id, source, (octet_length(encode(text)) + 4095) // 4096 AS k FROM documents WHERE length(text) > 0),
    ext AS (SELECT doc_id * {SPAN // 8} AS s, doc_id * {SPAN // 8} + k - 1 AS e, doc_id,
                   '/docs/' || source || '/' || doc_id || '.txt' AS file_path FROM x
            UNION ALL
            SELECT doc_id * {SPAN // 8} + k - k // 2, doc_id * {SPAN // 8} + k - 1, doc_id,
                   '/docs/' || source || '/' || doc_id || '.txt:tail' FROM x WHERE k > 1)"""


@query("map_blocks", f"""
    WITH {PAIR_SQL}, {EXTENT_SQL}
    SELECT extent_id, id AS block_id, CAST(doc_id AS INTEGER) AS file_id, file_path,
           (id // 8 - s) * 4096 + (id % 8) * 512 AS offset_bytes, s AS extent_start_block, e AS extent_end_block
    FROM ch JOIN ext ON id // 8 BETWEEN s AND e
    WHERE TRUE QUALIFY row_number() OVER (
        PARTITION BY id, doc_id, (id // 8 - s) * 4096 + (id % 8) * 512 ORDER BY file_path) = 1""")
def _(spark, d):
    return map_blocks(_changed(spark, d), file_extents(spark, d), cluster_size=CLUSTER)


@query("restore_blocks", f"""
    WITH {MUT_SQL}
    SELECT id, max(epoch) AS epoch, sha256(unhex(arg_max(hx, epoch))) AS sha256
    FROM mut WHERE epoch <= 2 GROUP BY id""")
def _(spark, d):
    got = restorable_blocks(mutations(spark, d), dirty_bits(spark, d), 2)
    return got.select("id", "epoch", F.sha2("block", 256).alias("sha256"))


@query("file_ranges", f"""
    WITH {PAIR_SQL}, {EXTENT_SQL}
    SELECT DISTINCT file_path, (id // 8 - s) * 4096 + (id % 8) * 512 AS start,
           (id // 8 - s) * 4096 + (id % 8) * 512 + 511 AS "end"
    FROM ch JOIN ext ON id // 8 BETWEEN s AND e""")
def _(spark, d):
    return fileaware.file_ranges(
        map_blocks(_changed(spark, d), file_extents(spark, d), cluster_size=CLUSTER)
    )


def end_files(spark, d):
    """Files as they are after the last epoch."""
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "lang", "text"))
    size = F.octet_length("text")
    noise = F.transform(
        F.sequence(F.lit(0).cast("bigint"), ceil_div(size, BLOCK) - 1),
        lambda i: F.hex(noise_block((F.col("doc_id") * SPAN + i).cast("string"))),
    )
    attacked = F.substring(F.unhex(F.array_join(noise, "")), F.lit(1), size)
    edited = utf8_bytes(F.replace(F.col("text"), F.lit("a"), F.lit("o")))
    state = (
        F.when((F.col("lang") == "de") & (size > 0), attacked).when(F.col("lang") == "fr", edited)
        .otherwise(utf8_bytes(F.col("text")))
    )
    return docs.select(_path().alias("file_path"), state.alias("content"))


@query("detect_files", """
    SELECT '/docs/' || source || '/' || doc_id || '.txt' AS file_path FROM documents
    WHERE lang = 'de' AND length(text) > 0""")
def _(spark, d):
    cfg = DetectConfig(2, 2, cluster_size=CLUSTER)
    found = detect(
        mutations(spark, d), dirty_bits(spark, d), file_extents(spark, d), cfg, files=end_files(spark, d)
    )
    return found.mappings.filter(~F.col("file_path").contains(":")).select("file_path").distinct()


EDGE_SQL = """
    f AS (SELECT doc_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS n FROM documents WHERE length(text) > 0),
    w AS (SELECT doc_id, i, substr(hx, 1024 * i + 1, 1024) AS hx
          FROM (SELECT doc_id, hx, unnest(range((n + 511) // 512)) AS i FROM f)),
    l AS (SELECT doc_id, i, hx, regexp_extract_all(hx, '..') AS b FROM w),
    c AS (SELECT doc_id, i, length(regexp_extract(hx, '^((?:[89AB][0-9A-F])*)', 1)) // 2
              + CASE WHEN b[-1] BETWEEN 'C2' AND 'F4' THEN 1
                     WHEN b[-2] BETWEEN 'E0' AND 'F4' AND b[-1] BETWEEN '80' AND 'BF' THEN 2
                     WHEN b[-3] BETWEEN 'F0' AND 'F4' AND b[-2] BETWEEN '80' AND 'BF'
                          AND b[-1] BETWEEN '80' AND 'BF' THEN 3 ELSE 0 END AS cut FROM l)"""


TEXT_SQL = f"""
    WITH t AS (SELECT DISTINCT sha256(text) AS sha256 FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
    {EDGE_SQL}
    SELECT '/t/' || c.doc_id || '.txt' AS file_path, i * 512 AS start,
           cut > 0 AND sha256(text) NOT IN (SELECT sha256 FROM t) AS keep_region,
           CASE WHEN sha256(text) IN (SELECT sha256 FROM t) THEN 'text: trusted (sha256)'
                WHEN cut > 0 THEN 'text: invalid UTF-8 in region (' || cut || ' errors)'
                ELSE 'text: UTF-8 plaintext-like' END AS reason
    FROM c JOIN documents d ON c.doc_id = d.doc_id"""


def _text_case(spark, d):
    """(ranges of single blocks, text files, trusted hashes)."""
    docs = table(spark, d, "documents").filter("length(text) > 0")
    files = docs.select(
        F.concat(F.lit("/t/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"),
        utf8_bytes(F.col("text")).alias("content"), F.lit("text").alias("handler"),
    )
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), ceil_div(F.length("content"), BLOCK) - 1)).alias("i")
    ranges = files.select("file_path", at).select(
        "file_path", (F.col("i") * BLOCK).alias("start"), (F.col("i") * BLOCK + BLOCK - 1).alias("end")
    )
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    listed = docs.join(good, "doc_id", "left_semi").select(F.sha2("text", 256).alias("sha256"))
    return ranges, files, listed


@query("text_decisions", TEXT_SQL)
def _(spark, d):
    return fileaware.text_decisions(*_text_case(spark, d)).select("file_path", "start", "keep_region", "reason")


@query("chunked_text_ranges", TEXT_SQL)
def _(spark, d):
    ranges, files, listed = _text_case(spark, d)
    trusted = files.withColumn("sha256", F.sha2("content", 256)).join(listed, "sha256", "left_semi").select("file_path")
    # Chunks of 700 bytes: most ranges lie in two of them.
    held = chunked.cut_chunks(files, 700, chunked.LOOKAHEAD)
    load = lambda wanted: held.join(wanted, ["file_path", "chunk"], "left_semi")
    return chunked.text_range_decisions(ranges, load, trusted, 700).select("file_path", "start", "keep_region", "reason")


@query("media_decisions", """
    WITH t AS (SELECT DISTINCT sha256(text) AS sha256 FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
    SELECT '/m/' || doc_id || '.jpg' AS file_path, sha256(text) NOT IN (SELECT sha256 FROM t) AS keep_file,
           CASE WHEN sha256(text) IN (SELECT sha256 FROM t) THEN 'jpeg: trusted (sha256)'
                ELSE 'jpeg: untrusted; metadata encrypted' END AS fileaware_reason
    FROM documents""")
def _(spark, d):
    docs = table(spark, d, "documents")
    files = docs.select(
        F.concat(F.lit("/m/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("file_path"),
        utf8_bytes(F.col("text")).alias("content"),
    ).withColumn("handler", fileaware.handler_name(F.col("file_path"), F.substring("content", 1, 8)))
    ranges = files.select("file_path", F.lit(0).cast("bigint").alias("start"), F.lit(511).cast("bigint").alias("end"))
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    listed = docs.join(good, "doc_id", "left_semi").select(F.sha2("text", 256).alias("sha256"))
    return fileaware.file_decisions(fileaware.media_decisions(ranges, files, listed))


TRUST_MANIFEST = """
    media AS (SELECT doc_id, '/p/' || doc_id % 7 || '.docx' AS file_path, 'word/media/' || doc_id || '.png' AS entry,
                     sha256(text) AS sha256 FROM documents),
    manifest AS (
        SELECT doc_id AS line, CASE WHEN doc_id % 5 = 0 THEN '/q/other.docx' ELSE '/p/' || doc_id % 7 || '.docx' END AS container,
               CASE WHEN doc_id % 3 = 0 THEN 'ppt/media/' || doc_id || '.png' ELSE 'word/media/' || doc_id || '.png' END AS entry,
               CASE WHEN lang = 'fr' THEN sha256(text || '!') ELSE sha256(text) END AS sha256
        FROM documents WHERE lang <> 'es'),
    h AS (SELECT sha256, arg_min(container, line) AS hc, arg_min(entry, line) AS he FROM manifest GROUP BY 1),
    b AS (SELECT container, sha256, arg_min(entry, line) AS be FROM manifest GROUP BY 1, 2),
    p AS (SELECT container, entry, arg_max(sha256, line) AS ps FROM manifest GROUP BY 1, 2),
    j AS (SELECT media.*, hc, he, be, ps, media.entry || '); sha=' || media.sha256[:12] AS short FROM media
          LEFT JOIN h ON h.sha256 = media.sha256 LEFT JOIN b ON b.container = file_path AND b.sha256 = media.sha256
          LEFT JOIN p ON p.container = file_path AND p.entry = media.entry)"""
BY_HASH = """WHEN he IS NOT NULL THEN 'ooxml: media trusted by sha (' || short || ' ↔ ' || he
             || CASE WHEN hc = file_path THEN '' ELSE '; manifest container differs' END"""
BY_PATH = """WHEN be IS NOT NULL THEN 'ooxml: media matches trusted manifest by sha (' || CASE WHEN be = entry THEN entry
                  ELSE 'entry differs: saw ' || entry || ', manifest ' || be END || ')'
             WHEN ps IS NULL THEN 'ooxml: media not in trusted manifest by path (' || short
             WHEN ps <> sha256 THEN 'ooxml: media hash mismatch vs manifest (' || entry || '); got=' || sha256[:12] || ' expected=' || ps[:12]
             ELSE 'ooxml: media matches trusted manifest by path (' || entry || ')'"""
TIERS = {
    "sha_only": ("he IS NOT NULL", BY_HASH + " ELSE 'ooxml: media sha not in trusted manifest (' || short"),
    "sha_then_path": ("he IS NOT NULL OR be IS NOT NULL OR ps = sha256", BY_HASH + " " + BY_PATH),
    "path_only": ("be IS NOT NULL OR ps = sha256", BY_PATH),
}


def _trust_query(mode: str):
    known, why = TIERS[mode]

    @query(f"media_trust_{mode}", f"""
        WITH {TRUST_MANIFEST}
        SELECT doc_id, coalesce({known}, FALSE) AS known, CASE {why} END AS why FROM j""")
    def _(spark, d):
        docs = table(spark, d, "documents")
        number = F.col("doc_id").cast("string")
        home = F.concat(F.lit("/p/"), (F.col("doc_id") % 7).cast("string"), F.lit(".docx"))
        named = F.concat(F.lit("word/media/"), number, F.lit(".png"))
        media = docs.select("doc_id", home.alias("file_path"), named.alias("entry"), F.sha2("text", 256).alias("sha256"))
        manifest = docs.filter("lang <> 'es'").select(
            F.col("doc_id").alias("line"), F.lit("OOXML").alias("Source"),
            F.when(F.col("doc_id") % 5 == 0, "/q/other.docx").otherwise(home).alias("Container"),
            F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ppt\\media\\"), number, F.lit(".png"))).otherwise(named).alias("Entry"),
            F.upper(F.sha2(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256)).alias("SHA256"))
        return trust.media_trust(media, manifest, mode, "line").select("doc_id", "known", "why")


for _mode in TIERS:
    _trust_query(_mode)
