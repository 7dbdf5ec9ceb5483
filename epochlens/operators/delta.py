"""Forward byte differences of changed blocks.

Runs of adjacent changed blocks inside an extent are compared as one byte string. A delta opens at
a differing byte and swallows equal stretches of up to ``min_gap`` bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlens.functions.batches import slices_of
from epochlens.functions.bytestats import flat_bytes

DELTA_SCHEMA = (
    "extent_id bigint, delta_block_id int, delta_block_size int, aggreg_block_id string, "
    "f_diff binary, block_ids array<bigint>, start_offset int, end_offset int"
)


def block_extents(blocks: DataFrame, block_id: str = "id", blocks_per_extent: int = 8) -> DataFrame:
    """(extent_id, block_ids): sorted distinct ids per extent, at most ``blocks_per_extent`` each."""
    from epochlens.operators.versions import extent_id

    return blocks.groupBy(extent_id(F.col(block_id), blocks_per_extent).alias("extent_id")).agg(
        F.array_sort(F.collect_set(block_id)).alias("block_ids")
    )


def extent_groups(changed: DataFrame) -> DataFrame:
    """(extent_id, members): the changed blocks of an extent in id order. The only wide step of the
    scan; ``changed`` has one row per block, so a group holds at most one extent of blocks."""
    return changed.groupBy("extent_id").agg(
        F.array_sort(F.collect_list(F.struct("block_id", "old", "new"))).alias("members")
    )


@dataclass
class RunBatch:
    """All runs of an Arrow batch of extents, as flat buffers. What is computed from it takes many times its bytes, so the
    batches are slices of bounded size."""

    extent: np.ndarray        # extent id per run
    first_block: np.ndarray   # index of the run's first block in block_id
    last_block: np.ndarray
    block_id: np.ndarray
    old: np.ndarray
    old_off: np.ndarray       # run offsets into old
    new: np.ndarray
    new_off: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> "RunBatch":
        groups = batch.column("members")
        members = groups.flatten()
        sizes = np.asarray(groups.value_lengths().fill_null(0))
        # StructArray.flatten applies a slice offset, field() does not.
        id_arr, old_arr, new_arr = members.flatten()
        ids = np.asarray(id_arr, dtype=np.int64)
        extent = np.repeat(np.asarray(batch.column("extent_id"), dtype=np.int64), sizes)
        starts = np.ones(ids.size, dtype=bool)
        if ids.size:
            starts[1:] = (np.diff(ids) != 1) | (np.diff(extent) != 0)
        first = np.flatnonzero(starts)
        last = np.concatenate([first[1:], [ids.size]]) - 1 if first.size else first
        old, oo = flat_bytes(old_arr)
        new, no = flat_bytes(new_arr)
        edge = np.concatenate([first, [ids.size]]).astype(np.int64)
        return cls(extent[first], first, last, ids, old, oo[edge], new, no[edge])


def delta_spans(differs: np.ndarray, row_of: np.ndarray, row_end: np.ndarray, min_gap: int):
    """Delta (start, end) positions over concatenated rows.

    ``differs`` marks changed bytes, ``row_of`` numbers the row of each byte and ``row_end`` gives
    the end position of each row. A trailing equal stretch of at most ``min_gap`` bytes belongs to
    the delta before it.
    """
    hits = np.flatnonzero(differs)
    if hits.size == 0:
        return hits, hits
    rows = row_of[hits]
    breaks = (np.diff(hits) - 1 > min_gap) | (np.diff(rows) != 0)
    first = np.concatenate([[0], np.flatnonzero(breaks) + 1])
    last = np.concatenate([first[1:] - 1, [hits.size - 1]])
    start, end = hits[first], hits[last] + 1
    tail = row_end[rows[last]] - end
    return start, np.where(tail <= min_gap, end + tail, end)


def batch_deltas(old, old_off, new, new_off, min_gap: int):
    """(data, row, start, end): deltas of every row, as positions in the flat new buffer ``data``.
    New bytes past the end of the old side form a delta of their own."""
    base = new_off[0] if len(new_off) else 0
    data = new[base: new_off[-1]]
    off = new_off - base
    lens = np.diff(off)
    shared = np.minimum(np.diff(old_off), lens)
    row_of = np.repeat(np.arange(lens.size), lens)
    if np.array_equal(np.diff(old_off), lens):
        differs = old[old_off[0]: old_off[-1]] != data
    else:
        differs = np.zeros(data.size, dtype=bool)
        for i in range(lens.size):
            a, n = off[i], shared[i]
            differs[a: a + n] = old[old_off[i]: old_off[i] + n] != data[a: a + n]
    start, end = delta_spans(differs, row_of, off[:-1] + shared, min_gap)
    row = row_of[start]
    surplus = np.flatnonzero(lens > shared)
    if surplus.size:
        row = np.concatenate([row, surplus])
        start = np.concatenate([start, off[surplus] + shared[surplus]])
        end = np.concatenate([end, off[surplus + 1]])
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
    return data, off, row, start, end


def ordinal_within(group: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... restarting at each change of a value whose equal entries are adjacent."""
    if group.size == 0:
        return group
    head = np.concatenate([[True], group[1:] != group[:-1]])
    start = np.maximum.accumulate(np.where(head, np.arange(group.size), 0))
    return np.arange(group.size) - start


def delta_blocks(extents: DataFrame, min_gap: int = 16, block_size: int = 512) -> DataFrame:
    """One row per delta with its bytes and device coordinates. ``delta_block_id`` counts from zero
    within an extent; ``end_offset`` is inclusive."""

    def cut(batches):
        for batch in slices_of(batches):
            runs = RunBatch.of(batch)
            data, off, row, start, end = batch_deltas(
                runs.old, runs.old_off, runs.new, runs.new_off, min_gap
            )
            s, e = start - off[row], end - off[row]
            lo = runs.first_block[row] + s // block_size
            hi = np.minimum(runs.first_block[row] + (e - 1) // block_size, runs.last_block[row])
            ext = runs.extent[row]
            a, z = runs.block_id[runs.first_block[row]], runs.block_id[runs.last_block[row]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ext, pa.int64()),
                    pa.array(ordinal_within(ext), pa.int32()),
                    pa.array(e - s, pa.int32()),
                    pa.array([f"{x}_{p}_{q}_new" for x, p, q in zip(ext, a, z)], pa.string()),
                    pa.array([data[p:q].tobytes() for p, q in zip(start, end)], pa.binary()),
                    pa.array([runs.block_id[p: q + 1] for p, q in zip(lo, hi)], pa.list_(pa.int64())),
                    pa.array(s % block_size, pa.int32()),
                    pa.array((e - 1) % block_size, pa.int32()),
                ],
                ["extent_id", "delta_block_id", "delta_block_size", "aggreg_block_id", "f_diff",
                 "block_ids", "start_offset", "end_offset"],
            )

    return extents.mapInArrow(cut, DELTA_SCHEMA)
