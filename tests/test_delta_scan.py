import dataclasses
import random

import models
import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlens.operators.delta import batch_deltas, block_extents, delta_blocks, extent_groups
from epochlens.operators.scan import GrowthCurve, ScanConfig, scan_delta, seed_chi2, suspicious_regions
from epochlens.operators.versions import changed_blocks


def groups(spark, blocks):
    """blocks: (id, old, new); keeps the changed ones, as the version step does."""
    rows = [(i // 8, i, bytearray(o), bytearray(n)) for i, o, n in blocks if o != n]
    df = spark.createDataFrame(rows, "extent_id bigint, block_id bigint, old binary, new binary")
    return extent_groups(df)


def deltas(spark, blocks, gap=16):
    got = delta_blocks(groups(spark, blocks), gap).orderBy("extent_id", "delta_block_id").collect()
    return [(r["extent_id"], r["delta_block_id"], bytes(r["f_diff"]), r["block_ids"], r["start_offset"], r["end_offset"])
            for r in got]


@pytest.mark.parametrize("ids,want", [
    ([0, 1, 2, 8, 9, 10], [(0, [0, 1, 2]), (1, [8, 9, 10])]), ([], []),
    ([0, 5, 8, 16, 16], [(0, [0, 5]), (1, [8]), (2, [16])]),
])
def test_extents(spark, ids, want):
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    assert sorted((r[0], r[1]) for r in block_extents(df).collect()) == want


def test_delta_fixtures(spark):
    z, b = bytes(512), lambda v: bytes([v]) * 512
    assert deltas(spark, [(1, b(2), b(2))]) == []
    assert deltas(spark, [(1, b(2), b(3))]) == [(0, 0, b(3), [1], 0, 511)]
    assert deltas(spark, [(0, z, b(1)), (1, z, b(1))]) == [(0, 0, b(1) * 2, [0, 1], 0, 511)]
    # A hole in the block ids ends a run.
    got = deltas(spark, [(0, z, b(1)), (2, z, b(1)), (9, z, b(9))])
    assert [(e, n, ids) for e, n, _, ids, _, _ in got] == [(0, 0, [0]), (0, 1, [2]), (1, 0, [9])]
    new = bytearray(z)
    new[0:10] = b"x" * 10
    new[20:30] = b"y" * 10
    assert [(len(f), s, e) for _, _, f, _, s, e in deltas(spark, [(0, z, bytes(new))], 5)] == [(10, 0, 9), (10, 20, 29)]
    assert [(len(f), s, e) for _, _, f, _, s, e in deltas(spark, [(0, z, bytes(new))], 10)] == [(30, 0, 29)]


def test_delta_model():
    rnd = random.Random(7)
    for _ in range(60):
        old_rows, new_rows = [], []
        for _ in range(rnd.randint(1, 5)):
            n = rnd.randint(0, 300)
            old = bytes(rnd.randrange(256) for _ in range(n))
            new = bytearray(old)
            at = 0
            while at < n:
                at += rnd.choice([0, 1, 15, 16, 17, 40])
                for k in range(at, min(n, at + rnd.randint(1, 6))):
                    new[k] ^= 1 + rnd.randrange(255)
                at += 6
            new += bytes(rnd.choice([0, 0, 0, 5]))
            old_rows.append(old)
            new_rows.append(bytes(new))
        off = lambda rows: np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        flat = lambda rows: np.frombuffer(b"".join(rows), np.uint8)
        _, o, row, s, e = batch_deltas(flat(old_rows), off(old_rows), flat(new_rows), off(new_rows), 16)
        got = [(int(r), int(a - o[r]), int(b - o[r])) for r, a, b in zip(row, s, e)]
        want = [(i, a, b) for i, (x, y) in enumerate(zip(old_rows, new_rows)) for a, b in models.deltas(x, y, 16)]
        assert got == want


def test_seed_and_growth_statistics():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 40, 200).astype(np.uint8)
    raw = data.tobytes()
    assert [float(x) for x in seed_chi2(data, 16)] == [models.chi2(raw[i: i + 16]) for i in range(185)]
    curve = GrowthCurve(data).at(33)
    assert [float(x) for x in curve] == [models.chi2(raw[33: 33 + w]) for w in range(1, 168)]


def samples():
    rnd = random.Random(11)
    for _ in range(40):
        n = rnd.choice([0, 3, 15, 16, 17, 64, 200, 700, 1500])
        parts, left = [], n
        while left > 0:
            k = min(left, rnd.randint(1, 400))
            alphabet = rnd.choice([2, 10, 60, 256])
            parts.append(bytes(rnd.randrange(alphabet) for _ in range(k)))
            left -= k
        yield b"".join(parts)


@pytest.mark.parametrize("stride", [4, 8])
def test_fixed_scan_model(stride):
    cfg = ScanConfig(stride=stride, expand=False)
    for raw in samples():
        data = np.frombuffer(raw, np.uint8)
        got = [(s, e, f) for s, e, *_, f in scan_delta(data, seed_chi2(data, 16), cfg)]
        assert got == models.fixed_scan(raw, 16, stride, 350.0)


@pytest.mark.parametrize("cfg", [
    ScanConfig(), ScanConfig(stride=4, min_expansions=2, max_chi2_var=75.0), ScanConfig(width=64, max_chi2_var=20.0),
    ScanConfig(stride=4, max_chi2_var=5.0, var_min_width=64),
])
def test_adaptive_scan_model(cfg):
    for raw in samples():
        data = np.frombuffer(raw, np.uint8)
        got = [(s, e) for s, e, *_ in scan_delta(data, seed_chi2(data, cfg.width), cfg)]
        assert got == models.adaptive_scan(raw, cfg)


def test_scan_fixtures():
    zero = np.frombuffer(bytes(512) + b"\xff" * 512, np.uint8)
    cfg = ScanConfig(width=64, stride=32, chi2_threshold=20000.0)
    assert scan_delta(zero, seed_chi2(zero, 64), cfg)
    even = np.frombuffer(bytes(range(256)) * 4, np.uint8)
    strict = dataclasses.replace(cfg, chi2_threshold=10.0)
    got = scan_delta(even, seed_chi2(even, 64), strict)
    assert [(s, e, f) for s, e, *_, f in got] == [(992, 1024, 0.0)]
    assert scan_delta(even, seed_chi2(even, 64), dataclasses.replace(strict, passthrough=False)) == []


def test_region_coordinates(spark):
    rnd = random.Random(5)
    noise = bytes(rnd.randrange(256) for _ in range(1024))
    zero = bytes(512)
    blocks = [(3, zero, bytes(100) + noise[:412]), (4, zero, noise[512:]), (6, zero, noise[:512])]
    got = suspicious_regions(groups(spark, blocks), ScanConfig()).orderBy("byte_start").collect()
    first = got[0]
    assert first["lba_start_block"] == 3 and first["first_block_offset"] == 100
    assert first["byte_start"] == 3 * 512 + 100
    assert all(r["num_blocks"] == len(r["block_ids"]) for r in got)
    assert all(r["lba_end_block"] - r["lba_start_block"] + 1 == r["num_blocks"] for r in got)
    covered = [x for r in got for x in range(r["byte_start"], r["byte_end_inclusive"] + 1)]
    assert len(covered) == len(set(covered))


def test_changed_blocks(spark):
    b = lambda v: bytearray([v] * 512)
    muts = spark.createDataFrame(
        [(0, b(1), 1), (0, b(2), 3), (1, b(7), 1), (1, b(7), 2), (2, b(5), 2), (3, b(0), 2), (4, b(9), 5)],
        "id bigint, block binary, epoch int",
    )
    got = changed_blocks(muts, muts.filter("epoch BETWEEN 2 AND 3").select("id").distinct(), 2, 3)
    rows = {r["block_id"]: (r["old"][0], r["new"][0]) for r in got.collect()}
    # Block 1 is unchanged, block 3 equals the zero block it is compared with, block 4 is too late.
    assert rows == {0: (1, 2), 2: (0, 5)}
    assert got.filter(F.col("extent_id") != 0).isEmpty()


def test_bucketed_tables_need_no_shuffle(spark, tmp_path):
    from epochlens.operators.versions import changed_in_place
    from epochlens.sinks.device import write_bucketed

    b = lambda v: bytearray([v] * 512)
    rows = [(i, b(e * 7 + i % 5), e) for i in range(40) for e in range(1, 4) if (i + e) % 3]
    muts = spark.createDataFrame(rows, "id bigint, block binary, epoch int")
    write_bucketed(muts, "t_mut", str(tmp_path / "m"), 4)
    write_bucketed(muts.select("id", "epoch"), "t_bits", str(tmp_path / "b"), 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = changed_in_place(spark.table("t_mut"), spark.table("t_bits"), 2, 3)
        plan = extent_groups(got)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        want = changed_blocks(muts, muts.filter("epoch >= 2").select("id").distinct(), 2, 3)
        key = lambda df: sorted((r["block_id"], bytes(r["old"]), bytes(r["new"])) for r in df.collect())
        assert key(got) == key(want) and key(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE t_mut")
        spark.sql("DROP TABLE t_bits")


def test_changed_blocks_with_a_large_dirty_set(spark, monkeypatch):
    from epochlens.operators import versions

    b = lambda v: bytearray([v] * 512)
    muts = spark.createDataFrame([(i % 9, b(e), e) for i in range(9) for e in range(1, 30)], "id bigint, block binary, epoch int")
    dirty = muts.filter("epoch = 20 AND id < 5").select("id").distinct()
    key = lambda df: sorted((r["block_id"], r["old"][0], r["new"][0]) for r in df.collect())
    small = key(changed_blocks(muts, dirty, 20, 20))
    monkeypatch.setattr(versions, "FETCH_BROADCAST", 1)
    assert key(changed_blocks(muts, dirty, 20, 20)) == small == [(i, 19, 20) for i in range(5)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bound", [2_000_000, 1])
def test_no_payload_is_aggregated(spark, monkeypatch, bound):
    from epochlens.operators import versions
    from epochlens.operators.scan import ScanConfig, suspicious_regions

    monkeypatch.setattr(versions, "FETCH_BROADCAST", bound)
    b = lambda v: bytearray([v] * 512)
    rows = [(i, b((3 * i + e) % 7), e) for i in range(50) for e in range(1, 9) if (i + e) % 3]
    muts = spark.createDataFrame(rows, "id bigint, block binary, epoch int")
    dirty = muts.filter("epoch between 4 and 6").select("id").distinct()
    changed = changed_blocks(muts, dirty, 4, 6)
    restored = versions.restorable_blocks(muts, muts.filter("id % 5 <> 0").select("epoch", "id"), 6)
    for df in (changed, restored, versions.latest_before(muts, 4)):
        assert "SortAggregate" not in plan_of(df) and "ObjectHashAggregate" not in plan_of(df)
    assert "SortAggregate" not in plan_of(suspicious_regions(extent_groups(changed), ScanConfig()))
    held = {}
    for i, block, e in rows:
        held.setdefault(i, {})[e] = bytes(block)
    pick = lambda v, last: v[max(e for e in v if e <= last)] if min(v) <= last else bytes(512)
    want = {i: (pick(v, 3), pick(v, 6)) for i, v in held.items() if any(4 <= e <= 6 for e in v)}
    got = {r.block_id: (bytes(r.old), bytes(r.new)) for r in changed.collect()}
    assert got == {i: p for i, p in want.items() if p[0] != p[1]} and got
    assert {r.id: bytes(r.block) for r in restored.collect()} == {i: pick(v, 6) for i, v in held.items() if i % 5}
    before = {r.id: (r.epoch, bytes(r.block)) for r in versions.latest_before(muts, 4).collect()}
    assert before == {i: (max(e for e in v if e < 4), pick(v, 3)) for i, v in held.items()}
