import json
import os
import random

import dirstore
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from epochlens import cli
from epochlens.config import DetectConfig, parse_formats
from epochlens.operators.versions import block_history, epoch_fetch
from epochlens.plans.preprocess import missing_epochs, restore
from epochlens.sinks.tables import csv_view, score_text
from epochlens.sources import audit
from epochlens.sources.bitmaps import read_bitmaps
from epochlens.sources.epochstore import as_bytes, epoch_number, read_store
from epochlens.sources.mutations import latest_epoch, read_mutation_files
from epochlens.streaming.arrivals import ingest, merge_epochs


def write_epoch(root, epoch, blocks, n_blocks):
    """Per-epoch files in the reference layout: lists of byte values, packed bits."""
    ids = sorted(blocks)
    t = pa.table({"id": pa.array(ids, pa.int64()), "block": pa.array([list(blocks[i]) for i in ids], pa.list_(pa.int64())),
                  "epoch": pa.array([epoch] * len(ids), pa.int64())})
    if not ids:
        t = pa.table({"id": pa.nulls(0), "block": pa.nulls(0), "epoch": pa.array([], pa.int64())})
    pq.write_table(t, os.path.join(root, f"mutation_{epoch}.parquet"))
    bits = np.zeros(n_blocks, np.uint8)
    bits[ids] = 1
    with open(os.path.join(root, f"bitmap_{epoch}.bin"), "wb") as fh:
        fh.write(np.packbits(bits).tobytes())


@pytest.fixture
def snapshot(tmp_path):
    """64 blocks of text; epoch 2 is empty; epoch 3 overwrites bytes 64..575 of the second file."""
    rnd = random.Random(3)
    body = b"".join(b"%06d some plain text line\n" % i for i in range(1300))[: 64 * 512]
    blocks = {i: body[i * 512: i * 512 + 512] for i in range(64)}
    noise = bytes(rnd.randrange(256) for _ in range(512))
    snap = tmp_path / "snap"
    snap.mkdir()
    hit = bytearray(body)
    at = 16 * 512 + 64
    hit[at: at + 512] = noise
    write_epoch(snap, 1, blocks, 64)
    write_epoch(snap, 2, {}, 64)
    write_epoch(snap, 3, {16: bytes(hit[16 * 512: 17 * 512]), 17: bytes(hit[17 * 512: 18 * 512]), 40: blocks[40]}, 64)
    mount = tmp_path / "mount"
    (mount / "d").mkdir(parents=True)
    # Cluster size 4096: file a owns clusters 0-1, file b 2-3, file c 5.
    ext = [(0, 1, 1, "/d/a.txt", 0), (2, 3, 2, "/d/b.txt", 0), (5, 5, 3, "/d/c.txt", 0)]
    for s, e, _, name, _ in ext:
        (mount / name[1:]).write_bytes(bytes(hit[s * 4096: (e + 1) * 4096]))
    pq.write_table(pa.Table.from_pylist([dict(zip(["start_block", "end_block", "file_id", "file_path", "file_offset_bytes"], r)) for r in ext]),
                   tmp_path / "extents.parquet")
    return tmp_path


def test_detect_and_evaluate(spark, snapshot):
    out = snapshot / "out"
    log = snapshot / "audit.ndjson"
    log.write_text("\n".join([
        json.dumps({"type": "file_chunk", "path": "x", "out_target": "/elsewhere/B.TXT", "actual": {"start": 64, "end": 576}}),
        json.dumps({"type": "file_chunk", "path": "/d/b.txt", "actual": {"start": 10, "end": 10}}),
        json.dumps({"type": "other"}), json.dumps({"type": "file_chunk", "path": "p", "actual": None}), "{broken"]))
    offs = audit.audit_offsets(audit.read_audit(spark, str(log)))
    assert sorted((r[0], r[1]) for r in offs.collect()) == [("/elsewhere/B.TXT", 0), ("/elsewhere/B.TXT", 512)]
    cli._detect(spark, cli.parser().parse_args([
        "detect", "--start-epoch", "2", "--end-epoch", "3", "--snapshot-path", str(snapshot / "snap"), "--output-path", str(out),
        "--extents", str(snapshot / "extents.parquet"), "--end-mount-root", str(snapshot / "mount"), "--out-formats", "parquet,csv",
        "--block-debug", "--block-debug-audit", str(log)]))
    regions = spark.read.parquet(str(out / "suspicious_regions_2_3.parquet")).collect()
    assert {b for r in regions for b in r["block_ids"]} == {16, 17}
    assert min(r["byte_start"] for r in regions) == 16 * 512 + 64
    assert {(r["start_epoch"], r["end_epoch"]) for r in regions} == {(2, 3)}
    maps = spark.read.parquet(str(out / "suspicious_block_mappings_2_3.parquet")).collect()
    assert sorted((r["block_id"], r["file_path"], r["offset_bytes"]) for r in maps) == [(16, "/d/b.txt", 0), (17, "/d/b.txt", 512)]
    summary = json.load(open(out / "block_debug" / "block_debug_summary.json"))
    assert (summary["audit_device_blocks"], summary["latest_diff_match"], summary["latest_at_end_latest_only"]) == (2, 2, 1)
    assert summary["regions_match"] == 2 and summary["maps_match"] == 2
    a = cli.parser().parse_args(["evaluate", "--gt-base", str(out / "block_debug"), "--mappings-dir",
                                 str(out / "suspicious_block_mappings_2_3_csv"), "--out-dir", str(snapshot / "ev"),
                                 "--extents", str(snapshot / "extents.parquet")])
    from epochlens.plans.evaluate import evaluate
    from epochlens.sources.extents import read_extents
    m = evaluate(spark, a.gt_base, a.mappings_dir, a.out_dir, extents=read_extents(spark, a.extents))
    assert (m["primary"]["tp"], m["primary"]["fp"], m["primary"]["tn"], m["primary"]["fn"]) == (2, 0, 1, 0)
    assert m["file_level"]["tp"] == 1 and m["file_level"]["fp"] == 0
    assert json.load(open(snapshot / "ev" / "metrics.json"))["primary"]["f1"] == 1.0


def test_nothing_changed_writes_empty_tables(spark, snapshot):
    out = snapshot / "none"
    cli._detect(spark, cli.parser().parse_args([
        "detect", "--start-epoch", "2", "--end-epoch", "2", "--snapshot-path", str(snapshot / "snap"), "--output-path", str(out),
        "--extents", str(snapshot / "extents.parquet"), "--audit-formats", "none"]))
    got = spark.read.parquet(str(out / "suspicious_regions_2_2.parquet"))
    assert got.count() == 0 and "chi2_final" in got.columns
    assert not (out / "suspicious_regions_2_2_csv").exists()


def test_profile_and_unusable_inventories(spark, snapshot):
    out = snapshot / "profile"
    base = ["detect", "--start-epoch", "2", "--end-epoch", "3", "--snapshot-path", str(snapshot / "snap"), "--output-path", str(out),
            "--extents", str(snapshot / "extents.parquet"), "--end-mount-root", str(snapshot / "mount"), "--profile"]
    (snapshot / "torn.parquet").write_bytes(b"PAR1 but not really")
    (snapshot / "hollow.parquet").write_bytes(b"")
    spark.range(3).write.parquet(str(snapshot / "other.parquet"))
    for name in ("none", "torn", "hollow", "other"):
        with pytest.warns(UserWarning, match="starting without one"):
            assert audit.read_inventory(spark, str(snapshot / f"{name}.parquet")) is None
    with pytest.warns(UserWarning):
        cli._detect(spark, cli.parser().parse_args([*base, "--inventory", str(snapshot / "torn.parquet")]))
    again = audit.read_inventory(spark, str(out / "file_inventory_2_3.parquet"))
    assert again.count() == 1 and not again.first()["trusted"]
    told = json.load(open(out / "run_metrics_2_3.json"))
    assert told["regions"]["rows"] == spark.read.parquet(str(out / "suspicious_regions_2_3.parquet")).count()
    assert told["decisions"]["kept"] == told["kept_mappings"]["rows"] == 2
    metrics = spark.read.parquet(str(out / "extent_metrics_2_3.parquet")).collect()
    assert sum(r["n_blocks"] for r in metrics) == 2
    assert [r["extent_id"] for r in metrics] == [2] and told["slowest_extents"][0]["n_regions"] >= 1
    with pytest.raises(SystemExit):
        cli.parser().parse_args([*base, "--media-trust", "never"])


def test_trusted_files_are_dropped(spark, snapshot):
    import hashlib
    sha = hashlib.sha256((snapshot / "mount/d/b.txt").read_bytes()).hexdigest()
    (snapshot / "m.csv").write_text(f"sha256,source,container,entry,media_ext\n{sha.upper()},file,x,,txt\n")
    out = snapshot / "trusted"
    cli._detect(spark, cli.parser().parse_args([
        "detect", "--start-epoch", "2", "--end-epoch", "3", "--snapshot-path", str(snapshot / "snap"), "--output-path", str(out),
        "--extents", str(snapshot / "extents.parquet"), "--end-mount-root", str(snapshot / "mount"), "--trusted-manifest", str(snapshot / "m.csv")]))
    assert spark.read.parquet(str(out / "suspicious_block_mappings_2_3.parquet")).count() == 0
    inv = spark.read.parquet(str(out / "file_inventory_2_3.parquet")).first()
    assert inv["trusted"] and inv["first_seen_epoch"] == 3


def test_preprocess_and_restore(spark, tmp_path):
    store, root = tmp_path / "store", tmp_path / "data"
    store.mkdir()
    want = bytearray(16 * 512)
    for epoch, ids in ((1, [2, 4, 7]), (2, []), (3, [4])):
        bits = np.zeros(16, np.uint8)
        bits[ids] = 1
        (store / f"{epoch}-bitmap").write_bytes(np.packbits(bits).tobytes())
        for i in ids:
            body = bytes([epoch * 16 + i]) * 512
            (store / f"{epoch}-{i}").write_bytes(body)
            want[i * 512: i * 512 + 512] = body
    (store / "3-bitmap").write_bytes(np.packbits(np.isin(np.arange(16), [4, 9]).astype(np.uint8)).tobytes())
    (store / "EpochCount").write_bytes((3).to_bytes(4, "big"))
    rows = read_store(spark, "dirstore:connect", root=str(store)).collect()
    # Block 9 is flagged in epoch 3 but has no item.
    assert sorted((r["epoch"], r["id"], r["block"] is None) for r in rows) == [(1, 2, False), (1, 4, False), (1, 7, False), (3, 4, False), (3, 9, True)]
    from epochlens.plans import preprocess as plan
    os.makedirs(root)
    assert plan.materialize(spark, "dirstore:connect", str(root), 3, 16, store_root=str(store)) == [1, 2, 3]
    assert missing_epochs(str(root), 3) == [] and missing_epochs(str(root), 3, force=True) == [1, 2, 3]
    assert (root / "bitmap_1.bin").read_bytes() == np.packbits(np.isin(np.arange(16), [2, 4, 7]).astype(np.uint8)).tobytes()
    got = read_mutation_files(spark, str(root), 3)
    assert {(r["id"], r["epoch"]): bytes(r["block"]) for r in got.collect()} == {
        (2, 1): bytes([18]) * 512, (4, 1): bytes([20]) * 512, (7, 1): bytes([23]) * 512, (4, 3): bytes([52]) * 512}
    assert latest_epoch(got) == 3 and latest_epoch(got.filter("false")) == -1
    assert [r["epoch"] for r in block_history(got, 4).collect()] == [1, 3]
    bits = read_bitmaps(spark, str(root), 1, 3)
    found, missing = epoch_fetch(bits, got, 3)
    assert [r["id"] for r in found.collect()] == [4] and [r["id"] for r in missing.collect()] == [9]
    image = restore(spark, str(root), 3, 16 * 512)
    assert open(image, "rb").read() == bytes(want)
    other = restore(spark, str(root), 3, 16 * 512, timestamped=True)
    assert other != image and open(other, "rb").read() == bytes(want)
    os.remove(root / "bitmap_2.bin")
    with pytest.raises(FileNotFoundError):
        restore(spark, str(root), 3, 16 * 512)
    assert plan.materialize(spark, "dirstore:connect", str(root), 3, 16, store_root=str(store)) == [2]


def test_epoch_in_two_runs_is_merged(spark, tmp_path):
    table = str(tmp_path / "merged")
    for low in (0, 10):
        rows = [(i, bytearray([i]), 5) for i in range(low, low + 10)]
        merge_epochs(spark.createDataFrame(rows, "id long, block binary, epoch int"), table)
    merge_epochs(spark.createDataFrame(rows, "id long, block binary, epoch int"), table)
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == list(range(20))


def test_stream_ingest(spark, snapshot, tmp_path):
    table, ck = str(tmp_path / "table"), str(tmp_path / "ck")
    q = ingest(spark, str(snapshot / "snap"), table, ck)
    assert q.awaitTermination(120)
    got = spark.read.parquet(table).groupBy("epoch").count().orderBy("epoch").collect()
    assert [(r["epoch"], r["count"]) for r in got] == [(1, 64), (3, 3)]


def test_corrected_block_replaces_the_old_one(spark, tmp_path):
    table, schema = str(tmp_path / "corrected"), "id long, block binary, epoch int"
    merge_epochs(spark.createDataFrame([(1, bytearray(b"a"), 5), (2, bytearray(b"b"), 5)], schema), table)
    merge_epochs(spark.createDataFrame([(1, bytearray(b"c"), 5)] * 2, schema), table)
    assert sorted((r.id, bytes(r.block)) for r in spark.read.parquet(table).collect()) == [(1, b"c"), (2, b"b")]


def test_versions_stream_with_late_epochs(spark, tmp_path):
    from epochlens.operators.versions import changed_blocks
    from epochlens.streaming import versions
    from epochlens.streaming.arrivals import arriving_mutations, read_arrived

    rnd = random.Random(5)
    truth, root, log = {}, tmp_path / "in", str(tmp_path / "log")
    root.mkdir()
    windows = spark.createDataFrame([(2, 3), (3, 6), (6, 6)], "start_epoch int, end_epoch int")
    batch_windows = []
    for step, epoch in enumerate([1, 4, 6, 2, 3, 5]):  # 2, 3 and 5 are late
        blocks = {i: bytes([rnd.randrange(3)]) * 512 for i in range(24) if rnd.random() < 0.6}
        truth |= {(i, epoch): b for i, b in blocks.items()}
        write_epoch(root, epoch, blocks, 24)
        q = versions.follow(arriving_mutations(spark, str(root)), log, str(tmp_path / "ck"))
        assert q.awaitTermination(120)
        q = ingest(spark, str(root), str(tmp_path / "table"), str(tmp_path / "ck2"))
        assert q.awaitTermination(120)
        rows = versions.read_log(spark, log)
        newest = rows.filter(rows.batch == rows.agg({"batch": "max"}).first()[0])
        batch_windows.append({(r.start_epoch, r.end_epoch) for r in versions.affected_windows(newest, windows).collect()})
    rows = versions.read_log(spark, log)
    muts = spark.createDataFrame([(i, bytearray(b), e) for (i, e), b in truth.items()], "id bigint, block binary, epoch int")
    key = lambda df: sorted((r.block_id, r.extent_id, bytes(r.old), bytes(r.new)) for r in df.collect())
    for start, end in ((1, 6), (2, 3), (3, 6), (6, 6), (4, 5)):
        dirty = muts.filter(f"epoch between {start} and {end}").select("id").distinct()
        assert key(versions.window_changes(rows, start, end)) == key(changed_blocks(muts, dirty, start, end)) != []
    by_id = {}
    for i, e in sorted(truth):
        by_id.setdefault(i, []).append(e)
    assert sorted((r.id, r.epoch, r.before) for r in versions.current(rows).collect()) == [
        (i, e, None if k == 0 else es[k - 1]) for i, es in sorted(by_id.items()) for k, e in enumerate(es)]
    # Epoch 2 arrives after 4 and 6: it revises its successors, and so windows that do not hold it.
    assert batch_windows[0] == set() and batch_windows[2] == {(3, 6), (6, 6)} and batch_windows[3] >= {(2, 3), (3, 6)}
    assert {(r.id, r.epoch): bytes(r.block) for r in read_arrived(spark, str(tmp_path / "table")).collect()} == truth
    # Nothing was rewritten: each batch holds only rows that came or changed with it.
    per_batch = {r.batch: r["count"] for r in rows.groupBy("batch").count().collect()}
    assert sum(per_batch.values()) < 2 * len(truth) and versions.read_log(spark, str(tmp_path / "none")).count() == 0


def test_small_helpers(spark, tmp_path):
    assert parse_formats("csv, parquet") == ("csv", "parquet") and parse_formats("none") == () == parse_formats("")
    with pytest.raises(ValueError):
        parse_formats("orc")
    with pytest.raises(ValueError):
        DetectConfig(3, 2).validate()
    assert as_bytes(None) == b"" and as_bytes([1, 2]) == b"\1\2" and epoch_number(b"\x01\x00") == 256 and epoch_number(None) == -1
    with pytest.raises(TypeError):
        as_bytes("text")
    df = spark.createDataFrame([(1.5, [1, 2]), (None, [])], "min_score double, block_ids array<int>")
    assert csv_view(df).first()["block_ids"] == "[1,2]"
    assert [r[0] for r in score_text(df.select("min_score")).collect()] == ["1.5000", ""]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.csv").write_text("name,Block,x\nq,7,1\nr,oops,2\ns,8.0,3\n")
    ids = audit.block_ids(audit.read_csv(spark, str(tmp_path / "c")))
    assert sorted(r[0] for r in ids.collect()) == [7, 8]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("name,n\nq,7\nr,9\n")
    assert sorted(r[0] for r in audit.block_ids(audit.read_csv(spark, str(tmp_path / "d"))).collect()) == [7, 9]
    assert audit.decisions_path("/x/suspicious_block_mappings_2_3_csv") == "/x/fileaware_files_2_3_csv"


def test_content_command(spark, tmp_path):
    from epochlens.plans import content
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"plain " * 2000)
    run = content.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), "entropy", window=4096)
    row = spark.read.option("header", True).csv(os.path.join(run, "results.csv")).first()
    assert row["verdict"] == "benign" and row["score_threshold"] == "7.5000" and os.path.exists(os.path.join(run, "config.json"))
    with pytest.raises(ValueError):
        content.run(spark, str(tmp_path / "nope"), str(tmp_path / "out"), "zip")
    assert set(content.verdicts(spark.createDataFrame([("/a.zip", bytearray(b"x"))], "file_path string, content binary"), "zip").columns) >= {"verdict", "mode"}
