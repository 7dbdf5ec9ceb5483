"""Relational operators of the engine on the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlens.catalog.registry import query, table
from epochlens.functions import paths
from epochlens.functions.ints import floor_div
from epochlens.operators import compare, evaluate, fileaware, islands, stats, trust, verify
from epochlens.operators.delta import block_extents
from epochlens.operators.intervals import longest_overlap, overlap_join, stab_join
from epochlens.operators.versions import latest_at, latest_before, version_pairs
from epochlens.sources.mutations import latest_epoch

# ---- versions: events as block versions (user = block, day = epoch, event = version number) ----

EPOCH = "(CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) + 1)"


def _mutations(spark, d):
    ev = table(spark, d, "events")
    return ev.select(
        F.col("user_id").alias("id"), "value", "event_id",
        (F.datediff(F.to_date("ts"), F.lit("2024-01-01")) + 1).alias("day"),
        F.col("event_id").alias("epoch"),
    )


@query("dirty_union", f"""
    SELECT DISTINCT user_id AS id FROM events WHERE {EPOCH} BETWEEN 5 AND 9""")
def _(spark, d):
    return _mutations(spark, d).filter(F.col("day").between(5, 9)).select("id").distinct()


def _window(spark, d):
    """The later half of all versions as the window (S, E)."""
    last = latest_epoch(_mutations(spark, d))
    return last // 2, last


@query("asof_before", """
    SELECT user_id AS id, arg_max(value, event_id) AS value, max(event_id) AS epoch
    FROM events WHERE event_id < (SELECT max(event_id) // 2 FROM events) GROUP BY user_id""")
def _(spark, d):
    return latest_before(_mutations(spark, d), _window(spark, d)[0], "value")


@query("asof_end", """
    SELECT user_id AS id, arg_max(value, event_id) AS value, max(event_id) AS epoch
    FROM events GROUP BY user_id""")
def _(spark, d):
    return latest_at(_mutations(spark, d), _window(spark, d)[1], "value")


@query("changed_values", """
    WITH p AS (
      SELECT user_id AS id,
             coalesce(arg_max(value, event_id) FILTER (WHERE event_id < (SELECT max(event_id) // 2 FROM events)), 0.0) AS old,
             arg_max(value, event_id) AS new
      FROM events GROUP BY user_id)
    SELECT id, old, new FROM p WHERE old <> new""")
def _(spark, d):
    pairs = version_pairs(_mutations(spark, d), *_window(spark, d), "value", F.lit(0.0))
    return pairs.filter(F.col("old") != F.col("new"))


@query("latest_epoch", f"SELECT max({EPOCH}) AS latest_epoch FROM events")
def _(spark, d):
    return _mutations(spark, d).agg(F.max("day").alias("latest_epoch"))


@query("version_ranges", """
    SELECT user_id AS id, count(*) AS n_versions, min(event_id) AS first_epoch,
           max(event_id) AS last_epoch
    FROM events GROUP BY user_id""")
def _(spark, d):
    return _mutations(spark, d).groupBy("id").agg(
        F.count("*").alias("n_versions"), F.min("epoch").alias("first_epoch"),
        F.max("epoch").alias("last_epoch"),
    )


@query("semi_dirty", f"""
    SELECT event_id, user_id FROM events
    WHERE user_id IN (SELECT user_id FROM events WHERE {EPOCH} = 3 AND event_type = 'error')""")
def _(spark, d):
    m = table(spark, d, "events")
    ids = m.filter(
        (F.to_date("ts") == F.lit("2024-01-03").cast("date")) & (F.col("event_type") == "error")
    ).select("user_id").distinct()
    return m.join(ids, "user_id", "left_semi").select("event_id", "user_id")


# ---- extents, islands, spans ----

@query("extent_groups", """
    SELECT o_orderkey // 8 AS extent_id, count(*) AS n_blocks,
           array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS block_ids
    FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders").filter(F.col("o_orderstatus") == "F")
    return block_extents(o, "o_orderkey").select(
        "extent_id", F.size("block_ids").cast("bigint").alias("n_blocks"),
        F.array_join("block_ids", ",").alias("block_ids"),
    )


@query("islands_by_status", """
    WITH d AS (SELECT DISTINCT o_orderstatus, o_orderkey AS id FROM orders),
    g AS (SELECT *, id - row_number() OVER (PARTITION BY o_orderstatus ORDER BY id) AS grp FROM d)
    SELECT o_orderstatus, min(id) AS run_start, max(id) AS run_end, max(id) - min(id) + 1 AS run_len
    FROM g GROUP BY o_orderstatus, grp""")
def _(spark, d):
    return islands.contiguous_runs(
        table(spark, d, "orders"), ["o_orderstatus"], "o_orderkey", bucket=1024
    )


@query("islands_global", """
    WITH d AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'),
    g AS (SELECT *, id - row_number() OVER (ORDER BY id) AS grp FROM d)
    SELECT min(id) AS run_start, max(id) AS run_end, max(id) - min(id) + 1 AS run_len
    FROM g GROUP BY grp""")
def _(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_returnflag") == "R")
    return islands.contiguous_runs(li, [], "l_orderkey")


SPAN_SQL = """
    s AS (SELECT l_linestatus AS k, l_partkey * 16 AS s,
                 l_partkey * 16 + CAST(l_quantity AS BIGINT) AS e
          FROM lineitem WHERE l_discount >= 0.09),
    p AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s WHERE e > s),
    n AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END)
                    OVER (PARTITION BY k ORDER BY s, e) AS grp FROM p),
    m AS (SELECT k, min(s) AS span_start, max(e) AS span_end FROM n GROUP BY k, grp)"""


def _spans(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_discount") >= 0.09)
    return li.select(
        F.col("l_linestatus").alias("k"), (F.col("l_partkey") * 16).alias("s"),
        (F.col("l_partkey") * 16 + F.col("l_quantity").cast("bigint")).alias("e"),
    )


@query("merge_spans", f"WITH {SPAN_SQL} SELECT k, span_start, span_end FROM m")
def _(spark, d):
    return islands.merge_spans(_spans(spark, d), ["k"], "s", "e", bucket=1024)


@query("gap_spans", f"""
    WITH {SPAN_SQL},
    g AS (SELECT k, lag(span_end) OVER (PARTITION BY k ORDER BY span_start) AS gap_start,
                 span_start AS gap_end FROM m)
    SELECT k, gap_start, gap_end FROM g WHERE gap_start < gap_end""")
def _(spark, d):
    return islands.gap_spans(_spans(spark, d), ["k"], "s", "e", bucket=1024)


@query("interval_stab", """
    WITH r AS (SELECT p_partkey AS file_id, p_partkey * 5 AS s, p_partkey * 5 + p_size AS e FROM part)
    SELECT event_id, file_id, event_id - s AS offset_in_run
    FROM events JOIN r ON event_id BETWEEN s AND e""")
def _(spark, d):
    runs = table(spark, d, "part").select(
        F.col("p_partkey").alias("file_id"), (F.col("p_partkey") * 5).alias("s"),
        (F.col("p_partkey") * 5 + F.col("p_size")).alias("e"),
    )
    points = table(spark, d, "events").select("event_id")
    return stab_join(points, runs, "event_id", "s", "e", bucket=256, salts=2).select(
        "event_id", "file_id", (F.col("event_id") - F.col("s")).alias("offset_in_run")
    )


@query("interval_overlap", """
    WITH a AS (SELECT l_suppkey AS k, l_partkey AS s1, l_partkey + 3 AS e1, l_orderkey, l_linenumber
               FROM lineitem WHERE l_returnflag = 'R'),
    b AS (SELECT s_suppkey AS k, s_suppkey * 7 AS s2,
                 s_suppkey * 7 + CAST(s_acctbal AS BIGINT) // 100 AS e2 FROM supplier)
    SELECT a.l_orderkey, a.l_linenumber, a.s1, b.s2, b.e2
    FROM a JOIN b ON a.k = b.k AND a.s1 <= b.e2 AND b.s2 <= a.e1""")
def _(spark, d):
    a = table(spark, d, "lineitem").filter(F.col("l_returnflag") == "R").select(
        F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("s1"),
        (F.col("l_partkey") + 3).alias("e1"), "l_orderkey", "l_linenumber",
    )
    b = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 7).alias("s2"),
        (F.col("s_suppkey") * 7 + floor_div(F.round("s_acctbal").cast("bigint"), 100)).alias("e2"),
    )
    return overlap_join(a, b, ["k"], ("s1", "e1"), ("s2", "e2"), bucket=64).select(
        "l_orderkey", "l_linenumber", "s1", "s2", "e2"
    )


@query("longest_overlap", """
    WITH a AS (SELECT DISTINCT l_linenumber AS k, l_partkey * 10 AS s1, l_partkey * 10 + 39 AS e1 FROM lineitem),
    b AS (SELECT p_size % 7 + 1 AS k, p_partkey * 10 AS s2, p_partkey * 10 + p_size AS e2, p_partkey FROM part),
    j AS (SELECT a.*, least(e1, e2) - greatest(s1, s2) + 1 AS overlap, count(*) OVER (PARTITION BY a.k, s1) AS spans, p_partkey,
                 row_number() OVER (PARTITION BY a.k, s1 ORDER BY least(e1, e2) - greatest(s1, s2) DESC, s2, p_partkey) AS place
          FROM a JOIN b ON a.k = b.k AND s1 <= e2 AND s2 <= e1)
    SELECT k, s1, e1, overlap, spans, p_partkey FROM j WHERE place = 1""")
def _(spark, d):
    first = F.col("l_partkey") * 10
    a = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("k"), first.alias("s1"), (first + 39).alias("e1")).distinct()
    at = F.col("p_partkey") * 10
    b = table(spark, d, "part").select((F.col("p_size") % 7 + 1).alias("k"), at.alias("s2"), (at + F.col("p_size")).alias("e2"), "p_partkey")
    return longest_overlap(a, b, ["k"], ("s1", "e1"), ("s2", "e2"), ["p_partkey"], bucket=256)


@query("range_chunks", """
    WITH r AS (SELECT 'supp-' || l_suppkey AS file_path, l_partkey * 700 AS s,
                      l_partkey * 700 + CAST(l_quantity AS BIGINT) * 40 AS e FROM lineitem)
    SELECT DISTINCT file_path, unnest(range(s // 512, (e + 511) // 512)) * 512 AS offset_bytes
    FROM r WHERE e > s""")
def _(spark, d):
    r = table(spark, d, "lineitem").select(
        F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")).alias("file_path"),
        (F.col("l_partkey") * 700).alias("s"),
        (F.col("l_partkey") * 700 + F.col("l_quantity").cast("bigint") * 40).alias("e"),
    )
    ids = r.select("file_path", F.explode(islands.block_range(F.col("s"), F.col("e"), 512)).alias("i"))
    return ids.select("file_path", (F.col("i") * 512).alias("offset_bytes")).distinct()


@query("offset_lists", """
    SELECT l_suppkey, (l_partkey * 512) // 65536 AS chunk,
           array_to_string(list(DISTINCT l_partkey * 512 ORDER BY l_partkey * 512), ',') AS offsets
    FROM lineitem GROUP BY 1, 2""")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") * 512).alias("o"))
    return islands.offset_lists(li, ["l_suppkey"], "o", 65536).select(
        "l_suppkey", "chunk", F.array_join("offsets", ",").alias("offsets")
    )


# ---- set comparison and joins ----

@query("compare_three_way", """
    WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'),
    b AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT coalesce(a.k, b.k) AS k,
           CASE WHEN b.k IS NULL THEN 'audit_only' WHEN a.k IS NULL THEN 'latest_only'
                ELSE 'match' END AS side
    FROM a FULL OUTER JOIN b ON a.k = b.k""")
def _(spark, d):
    a = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    b = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("k"))
    return compare.compare_sets(a, b, ["k"], ("match", "audit_only", "latest_only"))


@query("anti_keys", """
    SELECT c_custkey FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def _(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o.distinct(), "c_custkey", "left_anti")


@query("semi_keys", """
    SELECT c_custkey, c_mktsegment FROM customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')""")
def _(spark, d):
    o = table(spark, d, "orders").filter("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(
        o.distinct(), "c_custkey", "left_semi"
    )


@query("full_outer_keys", """
    WITH a AS (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1),
    b AS (SELECT c_custkey AS k, c_acctbal FROM customer WHERE c_acctbal > 5000)
    SELECT coalesce(a.k, b.k) AS k, coalesce(n_orders, 0) AS n_orders, c_acctbal FROM a FULL OUTER JOIN b ON a.k = b.k""")
def _(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"))
    b = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), "c_acctbal")
    return a.join(b, "k", "full_outer").select("k", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "c_acctbal")


@query("semi_pairs", """
    SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem
    WHERE (l_partkey, l_suppkey) IN (
        SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_tax >= 0.07)""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    kept = li.filter("l_returnflag = 'R' AND l_tax >= 0.07").select("l_partkey", "l_suppkey").distinct()
    return li.select("l_orderkey", "l_partkey", "l_suppkey").join(
        kept, ["l_partkey", "l_suppkey"], "left_semi"
    )


@query("key_set_ops", """
    WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'),
    b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'N')
    SELECT (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS n_union,
           (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS n_intersect,
           (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS n_left_only,
           (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS n_right_only""")
def _(spark, d):
    part = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return verify.key_set_ops(
        part.filter("l_returnflag = 'A'"), part.filter("l_returnflag = 'N'"), ["k"]
    )


# ---- trust and file-aware application ----

@query("region_keep_flags", """
    WITH flags AS (SELECT DISTINCT s_suppkey, s_nationkey < 12 AS is_trusted
                   FROM supplier WHERE s_acctbal > 2000),
    b AS (SELECT l_orderkey AS region_id, l_suppkey AS block_id FROM lineitem),
    f AS (SELECT region_id, count(*) AS total, count(is_trusted) AS mapped,
                 count(*) FILTER (WHERE is_trusted) AS trusted_mapped
          FROM b LEFT JOIN flags ON block_id = s_suppkey GROUP BY region_id)
    SELECT *, (mapped < total) OR (trusted_mapped < mapped) AS keep_region FROM f""")
def _(spark, d):
    flags = table(spark, d, "supplier").filter("s_acctbal > 2000").select(
        F.col("s_suppkey").alias("block_id"), (F.col("s_nationkey") < 12).alias("is_trusted")
    )
    blocks = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("region_id"), F.col("l_suppkey").alias("block_id")
    )
    return trust.region_keep_flags(blocks, ["region_id"], flags)


@query("drop_trusted_regions", """
    WITH maps AS (SELECT DISTINCT s_suppkey AS block_id, 'n' || s_nationkey AS file_path FROM supplier),
    trusted AS (SELECT 'n' || n_nationkey AS file_path FROM nation WHERE n_regionkey <= 1),
    flags AS (SELECT block_id, bool_or(file_path IN (SELECT file_path FROM trusted)) AS t
              FROM maps GROUP BY block_id),
    b AS (SELECT DISTINCT l_orderkey AS region_id, l_suppkey // 8 AS part, l_suppkey AS block_id FROM lineitem),
    f AS (SELECT region_id, part, count(*) AS total, count(t) AS mapped, count(*) FILTER (WHERE t) AS tm
          FROM b LEFT JOIN flags USING (block_id) GROUP BY region_id, part)
    SELECT region_id, part, total AS n_blocks FROM f WHERE mapped < total OR tm < mapped""")
def _(spark, d):
    maps = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("block_id"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("file_path"),
    )
    trusted = table(spark, d, "nation").filter("n_regionkey <= 1").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file_path")
    )
    regions = table(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("extent_id"), floor_div(F.col("l_suppkey"), 8).alias("byte_start")
    ).agg(F.collect_set("l_suppkey").alias("block_ids")).withColumn("delta_block_id", F.lit(0))
    _, kept = trust.drop_trusted(maps, regions, trusted)
    return kept.select(F.col("extent_id").alias("region_id"), F.col("byte_start").alias("part"), F.size("block_ids").cast("bigint").alias("n_blocks"))


@query("default_keep", """
    SELECT d.doc_id, coalesce(l.quality = 1, TRUE) AS keep_file
    FROM documents d LEFT JOIN labels l USING (doc_id)
    WHERE coalesce(l.quality = 1, TRUE)""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file_path"))
    dec = table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("file_path"), (F.col("quality") == 1).alias("keep_file")
    )
    kept = fileaware.apply_file_decisions(docs, dec)
    return kept.select("doc_id", F.lit(True).alias("keep_file"))


@query("apply_region_decisions", """
    WITH m AS (SELECT DISTINCT 'f' || l_suppkey AS file_path, l_partkey * 512 AS offset_bytes FROM lineitem),
    dec AS (SELECT DISTINCT 'f' || l_suppkey AS file_path, l_partkey * 512 AS offset_bytes,
                   bool_or(l_returnflag = 'R') AS keep
            FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000)
            GROUP BY 1, 2)
    SELECT m.file_path, m.offset_bytes FROM m
    WHERE EXISTS (SELECT 1 FROM dec WHERE dec.file_path = m.file_path
                  AND dec.offset_bytes = m.offset_bytes AND keep)
       OR m.file_path NOT IN (SELECT file_path FROM dec)""")
def _(spark, d):
    li = table(spark, d, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("file_path"),
        (F.col("l_partkey") * 512).alias("offset_bytes"), "l_suppkey", "l_returnflag",
    )
    mappings = li.select("file_path", "offset_bytes").distinct()
    decided = table(spark, d, "supplier").filter("s_acctbal > 3000").select(
        F.col("s_suppkey").alias("l_suppkey")
    )
    decisions = li.join(decided, "l_suppkey", "left_semi").groupBy("file_path", "offset_bytes").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("keep_region")
    ).select(
        "file_path", F.col("offset_bytes").alias("start"),
        (F.col("offset_bytes") + 511).alias("end"), "keep_region",
    )
    return fileaware.apply_region_decisions(mappings, decisions)


@query("manifest_split", """
    WITH m AS (SELECT sha256(text) AS sha256, CASE WHEN lang = 'en' THEN 'file' ELSE 'zip' END AS source
               FROM documents),
    c AS (SELECT DISTINCT sha256 FROM m), f AS (SELECT DISTINCT sha256 FROM m WHERE source = 'file')
    SELECT c.sha256, f.sha256 IS NOT NULL AS is_file FROM c LEFT JOIN f ON c.sha256 = f.sha256""")
def _(spark, d):
    docs = table(spark, d, "documents")
    manifest = docs.select(
        F.upper(F.sha2("text", 256)).alias("SHA256"),
        F.when(F.col("lang") == "en", "File").otherwise("zip").alias("Source"),
    )
    comp, files = trust.split_manifest(manifest)
    return comp.join(files.withColumn("_f", F.lit(True)), "sha256", "left").select(
        "sha256", F.col("_f").isNotNull().alias("is_file")
    )


@query("trusted_files", """
    WITH t AS (SELECT DISTINCT sha256(text) AS sha256 FROM documents JOIN labels USING (doc_id)
               WHERE quality = 1)
    SELECT '/docs/' || doc_id || '.txt' AS file_path, sha256(text) AS sha256,
           octet_length(encode(text)) AS size_bytes,
           sha256(text) IN (SELECT sha256 FROM t) AS trusted
    FROM documents""")
def _(spark, d):
    docs = table(spark, d, "documents")
    files = docs.select(
        F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"),
        F.encode("text", "UTF-8").alias("content"),
    )
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    listed = docs.join(good, "doc_id", "left_semi").select(F.sha2("text", 256).alias("sha256"))
    return trust.flag_trusted(trust.hash_files(files), listed)


@query("inventory_update", """
    WITH prev AS (SELECT 'c' || c_custkey AS file_path, 'a' AS sha256, 1 AS f, 2 AS l FROM customer
                  WHERE c_mktsegment <> 'BUILDING'),
    cur AS (SELECT DISTINCT 'c' || o_custkey AS file_path, 'b' AS sha256 FROM orders)
    SELECT coalesce(prev.file_path, cur.file_path) AS file_path,
           coalesce(cur.sha256, prev.sha256) AS sha256,
           coalesce(f, 5) AS first_seen_epoch,
           CASE WHEN cur.file_path IS NULL THEN l ELSE 5 END AS last_seen_epoch
    FROM prev FULL OUTER JOIN cur ON prev.file_path = cur.file_path""")
def _(spark, d):
    state = [F.lit(10).cast("bigint").alias("size_bytes"), F.lit(False).alias("trusted")]
    prev = table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("file_path"),
        F.lit("a").alias("sha256"), *state,
        F.lit(1).alias("first_seen_epoch"), F.lit(2).alias("last_seen_epoch"),
    )
    cur = table(spark, d, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file_path"),
        F.lit("b").alias("sha256"), *state,
    ).distinct()
    return trust.update_inventory(prev, cur, 5).select(
        "file_path", "sha256", "first_seen_epoch", "last_seen_epoch"
    )


# ---- evaluation ----

@query("confusion_metrics", """
    WITH c AS (SELECT count(*) FILTER (WHERE q AND t) AS tp, count(*) FILTER (WHERE NOT q AND NOT t) AS tn,
                      count(*) FILTER (WHERE NOT q AND t) AS fp, count(*) FILTER (WHERE q AND NOT t) AS fn,
                      count(*) AS support
               FROM (SELECT quality = 1 AS q, toxic = 1 AS t FROM labels)),
    r AS (SELECT *, (tp + tn) / support AS a,
                 CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p,
                 CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r FROM c)
    SELECT tp, tn, fp, fn, support, round(a, 9) AS accuracy, round(p, 9) AS precision,
           round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 9) AS f1
    FROM r""")
def _(spark, d):
    m = evaluate.confusion_metrics(
        table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1
    )
    rates = ["accuracy", "precision", "recall", "f1"]
    return m.select("tp", "tn", "fp", "fn", "support", *[F.round(c, 9).alias(c) for c in rates])


@query("block_summary", """
    SELECT u.k AS block_id, d.k IS NOT NULL AS gt_device, t.k IS NOT NULL AS gt_untrusted,
           d.k IS NOT NULL AS gt_primary, d.k IS NOT NULL OR t.k IS NOT NULL AS gt_combined,
           d.k IS NOT NULL OR t.k IS NOT NULL OR a.k IS NOT NULL AS gt_combined_aug,
           f.k IS NOT NULL AS flagged
    FROM (SELECT DISTINCT o_orderkey AS k FROM orders) u
    LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') d ON u.k = d.k
    LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'F') t ON u.k = t.k
    LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_tax > 0.07) a ON u.k = a.k
    LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_discount > 0.07) f ON u.k = f.k""")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "block_id")
    return evaluate.block_summary(
        table(spark, d, "orders").select(F.col("o_orderkey").alias("block_id")),
        li.filter("l_returnflag = 'R'"), li.filter("l_linestatus = 'F'"),
        li.filter("l_discount > 0.07"), li.filter("l_tax > 0.07"),
    )


@query("confusion_details", """
    WITH f AS (SELECT o_orderkey AS block_id,
                      o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS g,
                      o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.07) AS r
               FROM orders)
    SELECT CASE WHEN g AND r THEN 'TP' WHEN NOT g AND NOT r THEN 'TN' WHEN r THEN 'FP' ELSE 'FN' END AS class,
           count(*) AS n_blocks FROM f GROUP BY 1""")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "block_id")
    none = li.filter("false")
    s = evaluate.block_summary(
        table(spark, d, "orders").select(F.col("o_orderkey").alias("block_id")),
        li.filter("l_returnflag = 'R'"), none, li.filter("l_discount > 0.07"),
    )
    cls = evaluate.confusion_class(F.col("gt_primary"), F.col("flagged"))
    return s.groupBy(cls.alias("class")).agg(F.count("*").alias("n_blocks"))


REASONS = """
    r AS (SELECT doc_id AS block_id, '/f/' || source AS file_path,
                 CASE lang WHEN 'de' THEN 'zip: metadata encrypted (bad EOCD)'
                           WHEN 'fr' THEN 'PDFHandler: suspicious regions kept'
                           WHEN 'es' THEN 'cannot decode stream' ELSE text END AS fileaware_reason,
                 coalesce(quality = 1, FALSE) AS gt_primary
          FROM documents LEFT JOIN labels USING (doc_id))"""


def _reasons(spark, d):
    docs = table(spark, d, "documents")
    lab = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("q"))
    reason = (
        F.when(F.col("lang") == "de", "zip: metadata encrypted (bad EOCD)")
        .when(F.col("lang") == "fr", "PDFHandler: suspicious regions kept")
        .when(F.col("lang") == "es", "cannot decode stream").otherwise(F.col("text"))
    )
    return docs.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("block_id"), F.concat(F.lit("/f/"), "source").alias("file_path"),
        reason.alias("fileaware_reason"), F.coalesce("q", F.lit(False)).alias("gt_primary"),
    )


@query("bucket_counts", f"""
    WITH {REASONS}, x AS (SELECT gt_primary AS g, lower(fileaware_reason) AS t FROM r)
    SELECT count(*) AS total_positives, count(*) FILTER (WHERE g) AS primary_tp,
           count(*) FILTER (WHERE NOT g) AS primary_fp,
           count(*) FILTER (WHERE NOT g AND regexp_matches(t, 'metadata encrypted')) AS primary_fp__metadata_encrypted,
           count(*) FILTER (WHERE NOT g AND regexp_matches(t, 'decode|decompress|unsupported|password|crc|xref|trailer|central dir|directory')) AS primary_fp__decode_failed,
           count(*) FILTER (WHERE NOT g AND regexp_matches(t, 'suspicious regions kept')) AS primary_fp__pdf_suspicious,
           count(*) FILTER (WHERE NOT g AND regexp_matches(t, 'media.*uniform|payload.*uniform.*valid')) AS primary_fp__media_uniform_valid
    FROM x""")
def _(spark, d):
    return evaluate.bucket_counts(evaluate.bucket_flags(_reasons(spark, d)))


@query("diagnosis_rollup", f"""
    WITH {REASONS},
    x AS (SELECT lower(fileaware_reason) AS t, file_path IN ('/f/src1', '/f/src2') AS k FROM r)
    SELECT CASE WHEN k THEN 'mapped_to_keep_all_but_not_relabelled'
                WHEN contains(t, 'metadata encrypted') THEN 'reason_says_metadata_encrypted_but_not_in_keep_all'
                WHEN contains(t, 'suspicious regions kept') THEN 'pdf_suspicious_regions_not_whitelisted'
                ELSE 'mapped_non_keep_all_file' END AS diagnosis, count(*) AS count
    FROM x GROUP BY 1""")
def _(spark, d):
    r = _reasons(spark, d)
    why = evaluate.diagnosis(
        F.col("file_path"), F.col("file_path").isin("/f/src1", "/f/src2"), F.col("fileaware_reason")
    )
    return evaluate.count_by(r.withColumn("diagnosis", why), "diagnosis", "count")


@query("last_mapping", """
    WITH e AS (SELECT user_id AS block_id, event_id,
                      CASE WHEN event_type = 'error' THEN NULL ELSE '/' || event_type END AS file_path,
                      CASE WHEN event_type = 'view' THEN props ELSE '' END AS byte_offsets
               FROM events)
    SELECT block_id, coalesce(arg_max(file_path, event_id) FILTER (WHERE file_path IS NOT NULL), '') AS file_path,
           coalesce(arg_max(byte_offsets, event_id) FILTER (WHERE file_path IS NOT NULL), '') AS byte_offsets
    FROM e GROUP BY block_id""")
def _(spark, d):
    ev = table(spark, d, "events").select(
        F.col("user_id").alias("block_id"), "event_id",
        F.when(F.col("event_type") != "error", F.concat(F.lit("/"), "event_type")).alias("file_path"),
        F.when(F.col("event_type") == "view", F.col("props")).otherwise("").alias("byte_offsets"),
    )
    return evaluate.last_mapping(ev, "event_id")


@query("relabel_effect", """
    WITH s AS (SELECT o_orderkey AS k,
                      o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS g,
                      o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_tax > 0.07) AS a,
                      o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.07) AS f
               FROM orders)
    SELECT CASE WHEN g OR a THEN 'relabelled' ELSE 'still_fp' END AS outcome, count(*) AS n
    FROM s WHERE f AND NOT g GROUP BY 1""")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "block_id")
    s = evaluate.block_summary(
        table(spark, d, "orders").select(F.col("o_orderkey").alias("block_id")),
        li.filter("l_returnflag = 'R'"), li.filter("false"),
        li.filter("l_discount > 0.07"), li.filter("l_tax > 0.07"),
    )
    moved, still = evaluate.relabel_sets(s)
    both = moved.withColumn("outcome", F.lit("relabelled")).unionByName(
        still.withColumn("outcome", F.lit("still_fp"))
    )
    return both.groupBy("outcome").agg(F.count("*").alias("n"))


@query("file_confusion", """
    WITH n AS (SELECT lower('/' || regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1)) AS p,
                      url FROM pages),
    u AS (SELECT DISTINCT p FROM n), g AS (SELECT DISTINCT p FROM n WHERE url LIKE 'https:%'),
    a AS (SELECT DISTINCT p FROM n WHERE url LIKE '%.com/%')
    SELECT u.p AS file_path, g.p IS NOT NULL AS gt_encrypted, a.p IS NOT NULL AS alarm,
           CASE WHEN g.p IS NOT NULL AND a.p IS NOT NULL THEN 'TP' WHEN g.p IS NOT NULL THEN 'FN'
                WHEN a.p IS NOT NULL THEN 'FP' ELSE 'TN' END AS class
    FROM u LEFT JOIN g ON u.p = g.p LEFT JOIN a ON u.p = a.p""")
def _(spark, d):
    n = table(spark, d, "pages").select(
        F.concat(F.lit("\\"), F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)).alias("file_path"),
        "url",
    )
    return evaluate.file_confusion(
        n, n.filter("url LIKE 'https:%'"), n.filter("url LIKE '%.com/%'")
    )


@query("verify_recall", """
    WITH bm AS (SELECT DISTINCT 'f' || l_suppkey AS file_key, l_partkey // 8 AS extent_id,
                       l_partkey AS block_id, (l_partkey // 20) * 512 AS offset_bytes FROM lineitem),
    man AS (SELECT 'f' || s_suppkey AS file_key, CAST(s_acctbal AS BIGINT) AS len FROM supplier
            WHERE s_nationkey < 15 AND CAST(s_acctbal AS BIGINT) > 0),
    sus AS (SELECT DISTINCT p_partkey AS block_id FROM part WHERE p_size <= 25),
    x AS (SELECT bm.file_key, bm.block_id,
                 bool_or(offset_bytes < coalesce(man.len, 4096)) AS expected,
                 bm.block_id IN (SELECT block_id FROM sus) AS flagged
          FROM bm LEFT JOIN man ON bm.file_key = man.file_key GROUP BY 1, 2)
    SELECT file_key, count(*) FILTER (WHERE expected) AS expected_blocks,
           count(*) FILTER (WHERE expected AND flagged) AS flagged_in_expected,
           CASE WHEN count(*) FILTER (WHERE expected) > 0 THEN
             round(count(*) FILTER (WHERE expected AND flagged) / count(*) FILTER (WHERE expected), 6) END AS recall_on_expected,
           count(*) FILTER (WHERE flagged) AS flagged_total_for_file,
           CASE WHEN count(*) FILTER (WHERE flagged) > 0 THEN
             round(count(*) FILTER (WHERE expected AND flagged) / count(*) FILTER (WHERE flagged), 6) END AS precision_like,
           count(*) FILTER (WHERE flagged AND NOT expected) AS extras_flagged_outside_expected,
           count(*) FILTER (WHERE expected AND NOT flagged) AS misses_expected_not_flagged
    FROM x GROUP BY file_key""")
def _(spark, d):
    blockmap = table(spark, d, "lineitem").select(
        F.concat(F.lit("/data/f"), F.col("l_suppkey").cast("string")).alias("file_path"),
        floor_div(F.col("l_partkey"), 8).alias("extent_id"), F.col("l_partkey").alias("block_id"),
        (floor_div(F.col("l_partkey"), 20) * 512).alias("offset_bytes"),
    ).distinct()
    manifest = table(spark, d, "supplier").filter("s_nationkey < 15").select(
        F.concat(F.lit("/target/f"), F.col("s_suppkey").cast("string")).alias("out_target"),
        F.round("s_acctbal").cast("bigint").alias("prefix_bytes"),
    ).filter("prefix_bytes > 0")
    regions = table(spark, d, "part").filter("p_size <= 25").select(
        floor_div(F.col("p_partkey"), 8).alias("extent_id"),
        F.col("p_partkey").alias("lba_start_block"), F.col("p_partkey").alias("lba_end_block"),
    )
    summary, _, _ = verify.verify(regions, blockmap, manifest)
    return summary


# ---- statistics, counts ----

@query("basic_stats", """
    SELECT l_returnflag, count(*) AS count, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
           round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std,
           round(quantile_cont(l_extendedprice, 0.05), 4) AS p5,
           round(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
           round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
           round(quantile_cont(l_extendedprice, 0.75), 4) AS p75,
           round(quantile_cont(l_extendedprice, 0.95), 4) AS p95
    FROM lineitem GROUP BY l_returnflag""")
def _(spark, d):
    s = stats.basic_stats(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    rounded = ["mean", "std", "p5", "p25", "p50", "p75", "p95"]
    return s.select("l_returnflag", "count", "min", "max", *[F.round(c, 4).alias(c) for c in rounded])


@query("score_histogram", """
    WITH b AS (SELECT l_linestatus, min(l_quantity) AS lo, max(l_quantity) AS hi,
                      (max(l_quantity) - min(l_quantity)) / 20 AS w FROM lineitem GROUP BY 1),
    g AS (SELECT l_linestatus, lo, w, unnest(range(20)) AS bin FROM b),
    c AS (SELECT l_linestatus, CAST(least(floor((l_quantity - lo) / w), 19) AS BIGINT) AS bin, count(*) AS n
          FROM lineitem JOIN b USING (l_linestatus) GROUP BY 1, 2)
    SELECT g.l_linestatus, CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * w, 6) AS bin_start,
           round(lo + g.bin * w + w, 6) AS bin_end, coalesce(n, 0) AS count
    FROM g LEFT JOIN c ON g.l_linestatus = c.l_linestatus AND g.bin = c.bin""")
def _(spark, d):
    h = stats.histogram(table(spark, d, "lineitem"), ["l_linestatus"], "l_quantity", 20)
    return h.select(
        "l_linestatus", "bin", F.round("bin_start", 6).alias("bin_start"),
        F.round("bin_end", 6).alias("bin_end"), "count",
    )


@query("selected_scores", """
    WITH s AS (SELECT *, CASE event_type WHEN 'click' THEN 'entropy' WHEN 'view' THEN 'chi2'
                              WHEN 'error' THEN 'txt_fav' ELSE 'other' END AS mode,
                      CASE WHEN value > 50 THEN 'NaN' ELSE CAST(event_id AS VARCHAR) END AS lo,
                      CASE WHEN value < 5 THEN '' ELSE CAST(event_id + 10 AS VARCHAR) END AS hi
               FROM events),
    n AS (SELECT event_id, mode, TRY_CAST(nullif(lower(lo), 'nan') AS DOUBLE) AS a, TRY_CAST(hi AS DOUBLE) AS b FROM s)
    SELECT event_id, CASE WHEN mode IN ('entropy', 'txt_fav') THEN b WHEN mode = 'chi2' THEN a
                          ELSE coalesce(b, a) END AS score FROM n""")
def _(spark, d):
    ev = table(spark, d, "events")
    mode = (
        F.when(F.col("event_type") == "click", "entropy").when(F.col("event_type") == "view", "chi2")
        .when(F.col("event_type") == "error", "txt_fav").otherwise("other")
    )
    lo = F.when(F.col("value") > 50, "NaN").otherwise(F.col("event_id").cast("string"))
    hi = F.when(F.col("value") < 5, "").otherwise((F.col("event_id") + 10).cast("string"))
    return ev.select("event_id", stats.score_of(mode, lo, hi).alias("score"))


@query("topk_groups", """
    SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 50""")
def _(spark, d):
    return (
        table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "o_custkey").limit(50)
    )


@query("oversize_groups", """
    SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 620""")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).filter("n > 620")


@query("group_size_summary", """
    WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT count(*) AS groups, min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean,
           round(stddev_samp(n), 6) AS stddev FROM g""")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return g.agg(
        F.count("*").alias("groups"), F.min("n").alias("min"), F.max("n").alias("max"),
        F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("stddev"),
    )


@query("null_group_counts", """
    SELECT CAST(toxic AS VARCHAR) AS toxic, count(*) AS n_blocks
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY toxic""")
def _(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(
        table(spark, d, "labels").select("doc_id", F.col("toxic").cast("string").alias("toxic")),
        "doc_id", "left",
    )
    return evaluate.count_by(j, "toxic", "n_blocks")


# ---- scalar functions ----

@query("path_keys", r"""
    SELECT page_id, lower(regexp_extract(url, '([^/\\]+)$', 1)) AS key_base, lower(url) AS key_full FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select(
        "page_id", paths.path_key(F.col("url")).alias("key_base"),
        paths.path_key(F.col("url"), "full").alias("key_full"),
    )


@query("nt_paths", r"""
    WITH p AS (SELECT page_id, '\Users\' || replace(url, '/', '\\') AS w FROM pages),
    s AS (SELECT page_id, regexp_replace('/' || replace(w, '\', '/'), '/+', '/', 'g') AS n FROM p)
    SELECT page_id, n AS nt, lower(string_split(n, ':')[1]) AS nt_key FROM s""")
def _(spark, d):
    w = F.concat(F.lit("\\Users\\"), F.replace(F.col("url"), F.lit("/"), F.lit("\\\\")))
    return table(spark, d, "pages").select(
        "page_id", paths.nt_path(w).alias("nt"), paths.nt_path_key(w).alias("nt_key")
    )


@query("magic_registry", """
    WITH f AS (
      SELECT 'd' || doc_id AS f, '/x/' || doc_id || CASE lang WHEN 'de' THEN '.docx' WHEN 'fr' THEN '.bin' ELSE '' END AS path,
             encode(text) AS c FROM documents
      UNION ALL SELECT 'p' || page_id, '/y/' || page_id || '.html', encode(html) FROM pages)
    SELECT f, CASE WHEN path LIKE '%.docx' THEN 'ooxml'
         WHEN octet_length(c) > 0 AND
              len(list_filter(regexp_extract_all(substr(hex(c), 1, 16), '..'),
                  lambda h: (h BETWEEN '20' AND '7E') OR h IN ('09', '0A', '0D'))) * 1.0
              / least(octet_length(c), 8) >= CASE WHEN octet_length(c) >= 8 THEN 0.8 ELSE 0.9 END
         THEN 'text' ELSE 'generic' END AS handler FROM f""")
def _(spark, d):
    ext = F.when(F.col("lang") == "de", ".docx").when(F.col("lang") == "fr", ".bin").otherwise("")
    docs = table(spark, d, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("f"),
        F.concat(F.lit("/x/"), F.col("doc_id").cast("string"), ext).alias("path"),
        F.substring(F.encode("text", "UTF-8"), 1, 8).alias("magic"),
    )
    pages = table(spark, d, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("f"),
        F.concat(F.lit("/y/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.substring(F.encode("html", "UTF-8"), 1, 8).alias("magic"),
    )
    return docs.unionByName(pages).select(
        "f", fileaware.handler_name(F.col("path"), F.col("magic")).alias("handler")
    )


@query("sha256_text", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256")
    )


@query("crc32_text", """
    WITH codes AS (
        SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS code),
    octets AS (
        SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b
        FROM documents)
    SELECT doc_id, xor(list_reduce(b, lambda c, x: xor(c >> 8, code[xor(c & 255, x) + 1]), 4294967295), 4294967295) AS crc32
    FROM octets, codes""")
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.crc32(F.encode("text", "UTF-8")).alias("crc32")
    )


@query("json_view", """
    SELECT l_orderkey AS extent_id, l_suppkey // 8 AS part, '[' || array_to_string(list(DISTINCT l_suppkey ORDER BY l_suppkey), ',') || ']' AS block_ids
    FROM lineitem GROUP BY 1, 2""")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("extent_id"), floor_div(F.col("l_suppkey"), 8).alias("part")
    ).agg(
        F.to_json(F.array_sort(F.collect_set("l_suppkey"))).alias("block_ids")
    )
