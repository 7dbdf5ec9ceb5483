"""Files in byte ranges, table functions, trust tiers, overlaps and observed totals."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from epochlens.catalog.content import _files
from epochlens.functions import tables
from epochlens.operators import chunked, fileaware, windows
from epochlens.operators.intervals import longest_overlap
from epochlens.operators.trust import media_trust
from epochlens.plans.content import chunk_verdicts
from epochlens.plans.observe import DESCRIPTION, Totals, described
from epochlens.sources.chunks import ChunkReader, mounted_chunks, mounted_facts, read_chunks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    draw = random.Random(4)
    root = tmp_path_factory.mktemp("files")
    (root / "deep").mkdir()
    text = "Ein Satz über Straßen, naïve Wörter und 🙂. ".encode()
    cases = {"empty.txt": b"", "tiny.txt": b"abc", "text.txt": text * 3000, "exact.bin": bytes(4096),
             "noise.bin": draw.randbytes(70_000), "mixed.txt": text * 1000 + draw.randbytes(600) + text * 1000}
    for name, body in cases.items():
        (root / name).write_bytes(body)
    (root / "deep" / "more.txt").write_bytes(b"below")
    return root, cases


def test_chunks_hold_the_file(spark, folder):
    root, cases = folder
    rows = read_chunks(spark, str(root), chunk=1000, halo=7).collect()
    assert {os.path.basename(r.file_path) for r in rows} == set(cases)
    for name, body in cases.items():
        own = sorted((r for r in rows if r.file_path.endswith(f"/{name}")), key=lambda r: r.chunk)
        assert b"".join(bytes(r.bytes)[:r.size] for r in own) == body and [r.chunk for r in own] == list(range(max(1, -(-len(body) // 1000))))
        assert all(bytes(r.bytes) == body[r.start:r.start + r.size + 7] and r.file_size == len(body) for r in own)
    assert read_chunks(spark, str(root), recursive=True).filter("file_path like '%more.txt'").count() == 1
    assert read_chunks(spark, f"file://{root}/tiny.txt").count() == 1
    reader = ChunkReader({"path": str(root), "chunk": "1000", "split": "10000"})
    parts = reader.partitions()
    # A large file lies in many tasks, small ones share one, and no task has more than its share.
    assert all(sum(stop - first for *_, first, stop in p.parts) <= 10 for p in parts)
    assert sum(any(n.endswith("noise.bin") for n, *_ in p.parts) for p in parts) >= 7 and any(len(p.parts) > 1 for p in parts)
    with pytest.raises(FileNotFoundError):
        ChunkReader({"path": str(root / "none")}).partitions()


@pytest.mark.parametrize("chunk", [997, 4096, 1 << 20])
@pytest.mark.parametrize("tail", ["ignore", "overlap"])
def test_verdicts_do_not_depend_on_chunks(spark, folder, chunk, tail):
    root, cases = folder
    whole = spark.createDataFrame([(str(root / n), bytearray(b)) for n, b in cases.items()], "file_path string, content binary")
    pieces = read_chunks(spark, str(root), chunk=chunk, halo=511)
    key = lambda df: sorted(map(str, df.collect()))
    options = {"window": 512, "stride": 200, "tail_mode": tail}
    assert key(chunked.content_verdicts(pieces, mode="entropy", **options)) == key(windows.content_verdicts(whole, mode="entropy", **options))
    assert key(chunked.text_verdicts(pieces, **options)) == key(windows.text_verdicts(whole, **options))
    assert key(chunked.content_verdicts(chunked.cut_chunks(whole, chunk, 511), mode="chi2", **options)) == key(
        windows.content_verdicts(whole, mode="chi2", **options))
    assert "content" not in chunked.content_verdicts(pieces, mode="chi2", **options)._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]


def test_short_halo_is_an_error(spark, folder):
    with pytest.raises(Exception, match="halo is too short"):
        chunked.content_verdicts(read_chunks(spark, str(folder[0]), chunk=1000, halo=10), window=512).collect()


def test_file_beyond_two_gib(spark, tmp_path):
    """A sparse file that no single value could hold; its only noise lies behind 2 GiB."""
    path, size = tmp_path / "big.bin", (2 << 30) + (3 << 20)
    noise = random.Random(1).randbytes(8192)
    with open(path, "wb") as out:
        out.seek(size - 100_000)
        out.write(noise)
        out.truncate(size)
    row = chunk_verdicts(spark, str(path), "entropy", window=4096, stride=4096).first()
    assert (row.file_size, row.num_windows, row.verdict) == (size, size // 4096, "encrypted") and 1 <= row.num_suspicious_windows <= 3


def test_text_ranges_over_chunk_edges(spark, folder):
    root, cases = folder
    names = [n for n in cases if n.endswith(".txt")]
    whole = spark.createDataFrame([("/" + n, bytearray(cases[n]), "text") for n in names], "file_path string, content binary, handler string")
    rnd = random.Random(2)
    spans = [("/" + n, a, a + rnd.choice([0, 3, 511, 5000, 90_000])) for n in names for a in rnd.choices(range(max(1, len(cases[n]))), k=25)]
    spans += [("/tiny.txt", 2, 40), ("/empty.txt", 0, 511)]
    ranges = spark.createDataFrame(spans, "file_path string, start bigint, end bigint").distinct()
    sha = hashlib.sha256(cases["mixed.txt"]).hexdigest()
    trusted = spark.createDataFrame([(sha,)], "sha256 string")
    for listed, paths in ((trusted.limit(0), []), (trusted, ["/mixed.txt"])):
        want = fileaware.text_decisions(ranges, whole, listed)
        known = spark.createDataFrame([(p,) for p in paths], "file_path string")
        for chunk in (600, 1 << 16):
            load = lambda w: mounted_chunks(w, str(root), chunk=chunk, halo=chunked.LOOKAHEAD)
            got = chunked.text_range_decisions(ranges, load, known, chunk)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    # Only chunks that hold ranges are read, and what cannot be read is kept.
    one = spark.createDataFrame([("/text.txt", 1300, 1400), ("/gone.txt", 0, 5)], "file_path string, start bigint, end bigint")
    pieces = chunked.range_pieces(one, 1000).select("file_path", "chunk")
    assert [(r.file_path, r.chunk) for r in mounted_chunks(pieces, str(root), chunk=1000).collect()] == [("/text.txt", 1)]
    gone = chunked.text_range_decisions(one, lambda w: mounted_chunks(w, str(root), chunk=1000), known, 1000).filter("file_path = '/gone.txt'").first()
    assert gone.keep_region and gone.reason == "text: unreadable; escalate"


def test_facts_of_mounted_files(spark, folder):
    root, cases = folder
    paths = spark.createDataFrame([(f"/{n}",) for n in [*cases, "gone.bin"]] * 2, "file_path string")
    got = {r.file_path[1:]: (r.sha256, r.size_bytes, bytes(r.magic)) for r in mounted_facts(paths, str(root)).collect()}
    assert got == {n: (hashlib.sha256(b).hexdigest(), len(b), b[:8]) for n, b in cases.items()}


def test_table_function_forms(spark):
    tables.register(spark)
    _files(spark, SF).createOrReplaceTempView("udtf_files")
    lateral = spark.sql("SELECT f.doc_id, w.* FROM udtf_files f, LATERAL fixed_windows(f.content, 16, 350D) w")
    whole = spark.sql("SELECT * FROM fixed_windows(TABLE(udtf_files), 16, 350D)")
    parted = spark.sql("SELECT * FROM fixed_windows(TABLE(udtf_files) PARTITION BY (doc_id), 16, 350D)")
    want = sorted(map(tuple, lateral.collect()))
    assert want and sorted(map(tuple, whole.select(*lateral.columns).collect())) == want == sorted(map(tuple, parted.select(*lateral.columns).collect()))
    assert spark.sql("SELECT * FROM fixed_windows(CAST(NULL AS BINARY), 16, 350D)").count() == 0
    with pytest.raises(Exception, match="no column 'content'"):
        spark.sql("SELECT * FROM fixed_windows(TABLE(SELECT 1 AS x), 16, 350D)").collect()


def test_trust_tiers(spark):
    media = spark.createDataFrame([("/c", "word/media/a.png", "AA"), ("/c", "word\\media\\b.png", "bb"), ("/c", "x.png", "ee"), ("/d", "x.png", "ff")],
                                  "file_path string, entry string, sha256 string")
    listed = [(1, "ooxml", "/e", "other.png", "aa"), (2, "ooxml", "/c", "word/media/b.png", "cc"), (3, " OOXML ", "/c", "moved.png", "EE"),
              (4, "ooxml", "/c", "x.png", "11"), (5, "ooxml", "/c", "x.png", "22"), (6, "pdf", "/d", "x.png", "ff"), (7, "ooxml", "", "x", "ff")]
    manifest = spark.createDataFrame(listed, "n int, source string, container string, entry string, sha256 string")
    got = {mode: {(r.file_path, r.entry): (r.known, r.why) for r in media_trust(media, manifest, mode, "n").collect()}
           for mode in ("sha_only", "sha_then_path", "path_only")}
    assert got["sha_only"]["/c", "word/media/a.png"] == (True, "ooxml: media trusted by sha (word/media/a.png); sha=aa ↔ other.png; manifest container differs")
    assert got["sha_only"]["/c", "word\\media\\b.png"][0] is False
    assert got["sha_then_path"]["/c", "word\\media\\b.png"] == (False, "ooxml: media hash mismatch vs manifest (word/media/b.png); got=bb expected=cc")
    assert got["path_only"]["/c", "word/media/a.png"] == (False, "ooxml: media not in trusted manifest by path (word/media/a.png); sha=aa")
    assert got["path_only"]["/c", "x.png"] == (True, "ooxml: media matches trusted manifest by sha (entry differs: saw x.png, manifest moved.png)")
    assert not any(v["/d", "x.png"][0] for v in got.values())
    with pytest.raises(ValueError):
        media_trust(media, manifest, "never")


def test_longest_overlap_prefers_cover_then_start(spark):
    left = spark.createDataFrame([("f", 0, 99), ("f", 200, 299), ("g", 0, 9)], "k string, a long, b long")
    right = spark.createDataFrame([("f", 0, 29, "short", True), ("f", 30, 120, "long", True), ("f", 190, 219, "first", True),
                                   ("f", 280, 310, "second", True), ("f", 230, 231, "bad", False)], "k string, s long, e long, name string, fine boolean")
    best = longest_overlap(left, right, ["k"], ("a", "b"), ("s", "e"), ["name"], bucket=64)
    assert {(r.k, r.a): (r.name, r.overlap, r.spans) for r in best.collect()} == {("f", 0): ("long", 70, 2), ("f", 200): ("first", 20, 3)}
    bad = longest_overlap(left, right, ["k"], ("a", "b"), ("s", "e"), ["fine", "name"], first="fine", bucket=64)
    assert {r.a: r.name for r in bad.collect()} == {0: "long", 200: "bad"}


def test_observed_totals_equal_counts(spark, tmp_path):
    from epochlens.catalog.device import dirty_bits, end_files, file_extents, mutations
    from epochlens.config import DetectConfig
    from epochlens.plans.detect import detect

    totals = Totals()
    found = detect(mutations(spark, SF), dirty_bits(spark, SF), file_extents(spark, SF), DetectConfig(2, 2), files=end_files(spark, SF), totals=totals)
    seen = totals.read()
    size = F.sum(F.col("byte_end_inclusive") - F.col("byte_start") + 1)
    assert seen["regions"] == {"rows": found.scanned.count(), "bytes": found.scanned.agg(size).first()[0], "blocks": found.scanned.agg(F.sum("num_blocks")).first()[0]}
    assert seen["mappings"]["rows"] == found.scanned_mappings.count() > 0 and seen["kept_mappings"]["rows"] == found.mappings.count()
    assert seen["decisions"] == {"rows": found.decisions.count(), "kept": found.decisions.filter("keep_region").count()}
    json.dumps(seen)
    spark.sparkContext.setJobDescription("before")
    with described(spark, "inside"):
        assert spark.sparkContext.getLocalProperty(DESCRIPTION) == "inside"
    assert spark.sparkContext.getLocalProperty(DESCRIPTION) == "before"
    spark.sparkContext.setJobDescription(None)
