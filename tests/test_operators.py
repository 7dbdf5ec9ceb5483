import random
import re

import models
import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlens.catalog import QUERIES
from epochlens.functions import bytestats, paths, text
from epochlens.operators import compare, evaluate, fileaware, islands, stats, trust, verify
from epochlens.operators.intervals import map_blocks, overlap_join, stab_join
from epochlens.operators.windows import content_verdicts, text_verdicts


def test_chi2_facts(spark):
    rows = [("zeros", bytearray(16)), ("even", bytearray(range(256))), ("none", bytearray())]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "k string, c binary").select(
        "k", bytestats.byte_chi2(F.col("c"))).collect()}
    assert got == {"zeros": 4080.0, "even": 0.0, "none": 0.0}
    opened = spark.createDataFrame(rows, "k string, c binary").filter("k = 'none'").select(
        bytestats.byte_chi2_open(F.col("c"))).first()[0]
    assert opened == float("inf")


def test_islands_and_spans(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.randrange(400)) for k in "ab" for _ in range(250)] + [("c", i) for i in range(0, 200)]
    df = spark.createDataFrame(rows, "k string, id bigint")
    got = {}
    for r in islands.contiguous_runs(df, ["k"], "id", bucket=16).collect():
        got.setdefault(r["k"], set()).add((r["run_start"], r["run_end"]))
    assert got == {k: models.islands([i for kk, i in rows if kk == k]) for k in "abc"}

    spans = [(k, s, s + rnd.randrange(12)) for k in "ab" for s in (rnd.randrange(900) for _ in range(150))]
    sdf = spark.createDataFrame(spans, "k string, s bigint, e bigint")
    for bucket in (32, None):
        merged = {}
        for r in islands.merge_spans(sdf, ["k"], "s", "e", bucket=bucket).collect():
            merged.setdefault(r["k"], []).append((r["span_start"], r["span_end"]))
        want = {k: models.merged([(s, e) for kk, s, e in spans if kk == k]) for k in "ab"}
        assert {k: sorted(v) for k, v in merged.items()} == want
        gaps = {}
        for r in islands.gap_spans(sdf, ["k"], "s", "e", bucket=bucket, origin=0).collect():
            gaps.setdefault(r["k"], []).append((r["gap_start"], r["gap_end"]))
        for k in "ab":
            edges = [(0, 0), *want[k]]
            assert sorted(gaps[k]) == [(a[1], b[0]) for a, b in zip(edges, edges[1:]) if a[1] < b[0]]


EXTENTS = [(10, 14, 1, "A"), (20, 22, 2, "B"), (30, 35, 3, "C"), (12, 17, 4, "D"), (100, 102, 5, "E"), (200, 202, 5, "E"),
           (300, 301, 5, "E"), (400, 401, 6, "F"), (500, 505, 7, "G"), (1000, 1002, 8, "H"), (1500, 1504, 8, "H")]


@pytest.mark.parametrize("bucket,salts", [(4, 1), (4096, 3)])
def test_block_to_file(spark, bucket, salts):
    ext = spark.createDataFrame([(*e, 0) for e in EXTENTS],
                                "start_block bigint, end_block bigint, file_id int, file_path string, file_offset_bytes bigint")

    def owners(ids):
        df = spark.createDataFrame([(i,) for i in ids], "block_id bigint")
        got = map_blocks(df, ext, cluster_size=512, bucket=bucket, salts=salts)
        return {r["file_path"] for r in got.collect()}

    assert owners([12]) == {"A", "D"}
    assert owners([99]) == set()
    assert owners([13, 32, 201, 301]) == {"A", "D", "C", "E"}
    assert owners([11, 21, 31, 16, 101, 401, 502, 1001, 1502, 12, 12]) == set("ABCDEFGH")
    one = map_blocks(spark.createDataFrame([(165,)], "block_id bigint"), ext, cluster_size=4096).collect()
    assert one[0]["offset_bytes"] == 0 * 4096 + 5 * 512 and one[0]["extent_id"] == 20


def test_interval_joins_match_nested_loops(spark):
    rnd = random.Random(4)
    runs = [(i, s, s + rnd.choice([0, 1, 7, 300])) for i, s in enumerate(rnd.randrange(1000) for _ in range(60))]
    pts = [rnd.randrange(1100) for _ in range(200)]
    r = spark.createDataFrame(runs, "i int, s bigint, e bigint")
    p = spark.createDataFrame([(k, v) for k, v in enumerate(pts)], "k int, p bigint")
    got = sorted((x["k"], x["i"]) for x in stab_join(p, r, "p", "s", "e", bucket=32).collect())
    assert got == sorted((k, i) for k, v in enumerate(pts) for i, s, e in runs if s <= v <= e)
    q = spark.createDataFrame([(k, v, v + 9) for k, v in enumerate(pts)], "k int, a bigint, b bigint")
    one = lambda df: df.withColumn("z", F.lit(1))
    got = sorted((x["k"], x["i"]) for x in overlap_join(one(q), one(r), ["z"], ("a", "b"), ("s", "e"), bucket=16).collect())
    assert got == sorted((k, i) for k, v in enumerate(pts) for i, s, e in runs if v <= e and s <= v + 9)


def test_utf8_errors_and_text_score():
    rnd = random.Random(9)
    rows = [b"", b"\xe4\xb8a", "áé漢字😀".encode(), b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xc0\xaf", "漢".encode()[:2]]
    rows += [bytes(rnd.choice([65, 0x80, 0xC3, 0xE2, 0xF0, 0x9F]) for _ in range(rnd.randrange(30))) for _ in range(200)]
    data = np.frombuffer(b"".join(rows), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    assert text.utf8_errors(data, off).tolist() == [models.utf8_errors(r) for r in rows]
    texts = ["hello world, plain".encode(), "çà et là".encode("cp1252") + b" plain words here", "wide text".encode("utf-16"),
             "wide text".encode("utf-16-be"), bytes(rnd.randrange(128, 256) for _ in range(64)) + b"\x81\x8d"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(r) for r in texts])]).astype(np.int64)
    scores = text.text_scores(data, off)
    assert scores[:4].tolist() == [0, 0, 0, 0] and scores[4] == models.utf8_errors(texts[4])


def test_window_verdicts(spark):
    rnd = random.Random(1)
    noise = bytearray(rnd.randrange(256) for _ in range(4096))
    files = spark.createDataFrame([("short", bytearray(b"x")), ("plain", bytearray(b"plain text " * 500)), ("noise", noise),
                                   ("tail", bytearray(b"a" * 4096) + noise[:2000] + noise[:2000]), ("empty", bytearray())],
                                  "file_path string, content binary")
    ent = {r["file_path"]: r for r in content_verdicts(files).collect()}
    assert ent["short"]["verdict"] == "not_evaluated" and ent["short"]["note"] == "file_smaller_than_window"
    assert (ent["plain"]["verdict"], ent["plain"]["ignored_tail_bytes"]) == ("benign", 5500 - 4096)
    assert ent["noise"]["verdict"] == "encrypted" and ent["tail"]["verdict"] == "benign"
    over = {r["file_path"]: r for r in content_verdicts(files, tail_mode="overlap", mode="chi2", chi2_threshold=10000.0).collect()}
    assert over["tail"]["num_windows"] == 2 and over["tail"]["verdict"] == "encrypted"
    txt = {r["file_path"]: r for r in text_verdicts(files).collect()}
    assert txt["noise"]["verdict"] == "encrypted" and txt["empty"]["note"] == "empty_file"
    assert txt["plain"]["note"] == "tail_ignored_but_windows_all_valid"


@pytest.mark.parametrize("name", ["window_verdict_entropy", "window_verdict_chi2", "window_verdict_overlap", "text_verdict"])
def test_the_python_step_of_windows_gets_no_whole_file(spark, tmp_path, name):
    spark.createDataFrame([(1, "plain text " * 900)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    query = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution()
    plan = query.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    # Its row queue keeps every input column once for every window.
    assert [sorted(re.findall(r"(\w+)#", columns)) for columns in re.findall(r"ArrowEvalPython\nInput \[\d+\]: \[(.*)\]", plan)] == [
        ["doc_id", "file_size", "window_bytes", "window_start"]]


def test_overlapping_windows_of_documents(spark, tmp_path):
    rnd = random.Random(4)
    texts = ["", "x", *["".join(rnd.choices("abcdé漢 ", k=n)) for n in (511, 512, 700, 5000, 60000)], "a" * 512, "a" * 513, "b" * 768, None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, t in rows:
        body = None if t is None else t.encode()
        size = len(body or b"")
        starts = sorted({*range(0, size - 511, 256), *([size - 512] if size >= 512 else [])})
        counts = [[body[s:s + 512].count(b) for b in range(256)] for s in starts]
        own = want.setdefault(i, (None if body is None else size, []))
        own[1].extend(256 * sum(c * c for c in cs) / 512 - 512 for cs in counts)
    got = {r["doc_id"]: r for r in QUERIES["window_verdict_overlap"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    for i, (size, scores) in want.items():
        bad = sum(s <= 6000 for s in scores)
        r = got[i]
        assert (r["file_size"], r["num_windows"], r["num_suspicious_windows"]) == (size, len(scores), bad)
        assert (r["min_score"], r["max_score"]) == ((round(min(scores), 4), round(max(scores), 4)) if scores else (None, None))
        assert r["verdict"] == ("not_evaluated" if not scores else "encrypted" if bad else "benign")
        assert r["note"] == ("" if scores else "file_smaller_than_window")


def test_paths(spark):
    rows = [("\\Users\\A\\x.TXT:Zone",), ("//a//b",), ("",), ("rel/../b/./c.tar.gz",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "p string").select(
        paths.nt_path_key(F.col("p")), paths.posix_norm(F.col("p")), paths.extension(F.col("p")), paths.path_key(F.col("p"))).collect()]
    assert [g[0] for g in got] == ["/users/a/x.txt", "/a/b", "", "/rel/../b/./c.tar.gz"]
    assert got[3][1:] == ("b/c.tar.gz", "gz", "c.tar.gz")
    assert got[0][3] == "x.txt:zone"


def test_trust_and_decisions(spark):
    maps = spark.createDataFrame([(1, "/a", 0), (2, "/a", 512), (3, "/b", 0), (3, "/a", 1024)],
                                 "block_id bigint, file_path string, offset_bytes bigint")
    regions = spark.createDataFrame([(0, 0, 0, [1, 2]), (0, 1, 9, [3]), (0, 2, 20, [4]), (0, 3, 30, [1, 4])],
                                    "extent_id bigint, delta_block_id int, byte_start bigint, block_ids array<bigint>")
    left, kept = trust.drop_trusted(maps, regions, spark.createDataFrame([("/a",)], "file_path string"))
    assert [r["file_path"] for r in left.collect()] == ["/b"]
    # Region 1 is owned by a trusted and an untrusted file: the block counts as trusted and is dropped;
    # regions 2 and 3 hold an unmapped block.
    assert sorted(r["delta_block_id"] for r in kept.collect()) == [2, 3]
    dec = spark.createDataFrame([("/a", 0, 511, True, "jpeg: untrusted"), ("/a", 512, 1023, False, "x")],
                                "file_path string, start bigint, end bigint, keep_region boolean, reason string")
    key = lambda df: sorted((r["file_path"], r["offset_bytes"]) for r in df.collect())
    assert key(fileaware.apply_region_decisions(maps, dec)) == [("/a", 0), ("/b", 0)]
    assert key(fileaware.apply_region_decisions(maps, dec, undecided_kept=False)) == [("/a", 0)]
    assert fileaware.untrusted_mappings(maps, dec).count() == 1
    assert sorted(r["delta_block_id"] for r in fileaware.update_regions(regions, left).collect()) == [1]
    m = spark.createDataFrame([("AA", "file", ""), ("bb", "zip", "x"), ("", "file", "")], "SHA256 string, source string, entry string")
    comp, files = trust.split_manifest(m)
    assert {r[0] for r in comp.collect()} == {"aa", "bb"} and {r[0] for r in files.collect()} == {"aa"}
    assert trust.split_manifest(m.select("SHA256"))[1].count() == 2
    with pytest.raises(ValueError):
        trust.split_manifest(m.select("source"))


@pytest.mark.parametrize("name,magic,want", [
    ("/a/x.docx", b"PK\x03\x04", "ooxml"), ("/x.bin", b"PK\x03\x04aaaa", "zip"), ("/x.jpg", b"", "jpeg"), ("/x", b"\xff\xd8\xff\xe0", "jpeg"),
    ("/x", b"\x89PNG\r\n\x1a\n", "png"), ("/x", b"%PDF-1.4", "pdf"), ("/x", b"ID3\x03", "mp3"), ("/x", b"\xff\xfb\x90", "mp3"),
    ("/x", b"\0\0\0\x18ftyp", "mp4"), ("/x.csv", b"\0\1\2\3", "text"), ("/x", b"plaintext"[:8], "text"), ("/x", b"\0\1\2\3\4\5\6\7", "generic"),
    ("/x", b"abc\x01", "generic"), ("/x", None, "generic"),
])
def test_handler_dispatch(spark, name, magic, want):
    df = spark.createDataFrame([(name, None if magic is None else bytearray(magic))], "p string, m binary")
    assert df.select(fileaware.handler_name(F.col("p"), F.col("m"))).first()[0] == want


def test_evaluation(spark):
    none = spark.createDataFrame([], "block_id bigint")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "block_id bigint")
    s = evaluate.block_summary(ids(1, 2, 3, 4), ids(1, 2), ids(3), ids(2, 3, 4, 9), ids(4))
    m = evaluate.confusion_metrics(s, F.col("gt_primary"), F.col("flagged")).first()
    assert (m["tp"], m["tn"], m["fp"], m["fn"], m["support"]) == (1, 0, 2, 1, 4)
    moved, still = evaluate.relabel_sets(s)
    assert sorted(r[0] for r in moved.collect()) == [3, 4] and still.count() == 0
    empty = evaluate.confusion_metrics(evaluate.block_summary(none, none, none, none), F.col("gt_primary"), F.col("flagged")).first()
    assert empty["support"] == 0 and empty["accuracy"] is None and empty["f1"] is None
    sides = {r["k"]: r["side"] for r in compare.compare_sets(
        spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int"), ["k"]).collect()}
    assert sides == {1: "left_only", 2: "match", 3: "right_only"}


def test_expected_spans(spark):
    df = spark.createDataFrame(
        [("a", "100", None), ("b", None, "[[0, 5], [9, 0]]"), ("c", None, '[{"offset": 3, "length": 4}]'), ("d", None, "1:2, 5:6"),
         ("e", "", "junk"), ("f", None, None)], "path string, prefix_bytes string, ranges string")
    got = {r["man_path"]: [(s["offset"], s["length"]) for s in r["spans"]] for r in verify.manifest_targets(df, 7).collect()}
    assert got == {"a": [(0, 100)], "b": [(0, 5)], "c": [(3, 4)], "d": [(1, 2), (5, 6)], "e": [(0, 7)], "f": [(0, 7)]}
    js = spark.read.json(spark.sparkContext.parallelize([
        '{"files":[{"out_target":"/x/f","regions":[{"actual":{"start":2,"end":9},"requested":{"start":0,"end":1}},{"requested":{"start":20,"end":25}}]}]}']))
    t = verify.manifest_targets(verify.manifest_records(js)).first()
    assert [(s["offset"], s["length"]) for s in t["spans"]] == [(2, 7), (20, 5)]


@pytest.mark.parametrize("match", ["basename", "exact", "suffix"])
def test_verify_paths(spark, match):
    path = "/clone/d/f" if match == "exact" else "/d/f"
    bm = spark.createDataFrame([(path, 0, 1, 0), (path, 0, 2, 512), (path, 0, 3, 1024), ("/other", 1, 9, 0)],
                               "file_path string, extent_id bigint, block_id bigint, offset_bytes bigint")
    man = spark.createDataFrame([("/clone/d/f", 600)], "out_target string, prefix_bytes int")
    reg = spark.createDataFrame([(0, 3, 2)], "extent_id bigint, lba_start_block bigint, lba_end_block bigint")
    summary, misses, extras = verify.verify(reg, bm, man, match=match)
    got = {r["file_key"]: r for r in summary.collect()}
    mine = got["f" if match == "basename" else "/clone/d/f"]
    assert (mine["expected_blocks"], mine["flagged_in_expected"], mine["flagged_total_for_file"]) == (2, 1, 2)
    assert len(got) == 2 and {r["block_id"] for r in misses.collect()} == {1, 9} and extras.first()["block_id"] == 3


def test_percentiles_with_a_large_group(spark):
    n = 30000
    vals = [(0, float((i * 7919) % 9973)) for i in range(n)] + [(1, 5.0)] * 3 + [(2, 1.0), (2, 2.0)]
    df = spark.createDataFrame(vals, "g int, v double")
    got = {r["g"]: r for r in stats.basic_stats(df, ["g"], "v").collect()}
    big = np.array([v for g, v in vals if g == 0])
    for name, p in stats.PERCENTILES:
        assert got[0][name] == pytest.approx(np.percentile(big, p * 100))
    assert got[1]["p50"] == 5.0 and got[1]["std"] == 0.0 and got[2]["p25"] == 1.25
    assert stats.basic_stats(df, [], "v").first()["count"] == len(vals)
    h = stats.histogram(df.filter("g > 0"), ["g"], "v", 4)
    assert {(r["g"], r["bin"]): r["count"] for r in h.collect() if r["count"]} == {(1, 2): 3, (2, 0): 1, (2, 3): 1}
