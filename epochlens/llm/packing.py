"""Best-fit packing of token sequences by bin completion.

Only the number of pieces of each length matters for the packing, and lengths run from 1 to the capacity, so the
search works on a histogram of at most ``capacity`` counts whatever the number of documents. Spark computes the
pieces and the histogram and deals the found fillings back to the pieces by rank within their length.

Bin completion: take the largest piece left, enumerate the fillings of the rest of its bin that no other filling
dominates (same or larger pieces in the same places), best fit first, and branch. A branch is cut when the waste
so far and the least waste still to come exceed what the incumbent allows. The first descent takes the best fit
everywhere and so is the first incumbent; a filling is applied to as many bins at once as the counts permit, and to
fewer once all others have been tried. Only the bounds and the number of fillings looked at end the search.

Defined results: a null text is the empty text and becomes one piece that holds the end id only; rows that repeat
are packed each; documents longer than the capacity are cut, the short piece first; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochlens.llm.common import byte_slices, cut_lineage, string_sizes, whole
from epochlens.llm.token_counts import encoder

SLICE_BYTES = 1 << 20


def best_fit(lengths: list[int], counts: dict[int, int], room: int, most: int = 4, width: int = 3) -> tuple[int, ...]:
    """A full filling of ``room`` with the lengths left (ascending), the first choice of the search: a small trial among
    the ``width`` largest pieces that fit in each of the first ``most`` places. All others come from ``fillings``."""
    found: dict[tuple[int, ...], int] = {}

    def grow(chosen: tuple[int, ...], left: int, top: int) -> None:
        at = bisect_right(lengths, min(left, top))
        tried = 0
        while at and tried < (width if len(chosen) < most else 1):
            at -= 1
            size = lengths[at]
            if counts[size] - chosen.count(size) <= 0:
                continue
            tried += 1
            grow(chosen + (size,), left - size, size)
            if left == size or (found and min(found.values()) == 0):
                return
        if not tried:
            found.setdefault(chosen, left)

    grow((), room, room)
    return min(found, key=lambda f: (found[f], len(f), tuple(-x for x in f)))


def fillings(have: Callable[[int], int], sizes: list[int], room: int) -> Iterator[tuple[int, ...] | None]:
    """Fillings of ``room`` with ``have(s)`` pieces of each of the ``sizes`` (ascending), fullest first and then larger
    pieces first, one at a time. None stands for one that is dominated: a piece still fits, or some of its pieces can be
    exchanged for one piece that is as large or larger. Sums that the smaller sizes reach are
    kept as bits, so no step leads nowhere."""
    sizes = sizes[:bisect_right(sizes, room)]
    mask, reach, spare = (1 << room + 1) - 1, [1], 0
    for size in sizes:
        bits, n, k = reach[-1], min(have(size), room // size), 1
        while n > 0:
            k = min(k, n)
            bits |= bits << size * k & mask
            n, k = n - k, 2 * k
        reach.append(bits)
        spare |= (have(size) > 0) << size

    def exact(at: int, goal: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not goal:
            yield chosen
        at = min(at, bisect_right(sizes, goal))
        while goal and at and reach[at] >> goal & 1:
            at -= 1
            size = sizes[at]
            for k in range(min(have(size), goal // size), 0, -1):
                if reach[at] >> goal - k * size & 1:
                    yield from exact(at, goal - k * size, chosen + (size,) * k)

    def dominated(filling: tuple[int, ...], waste: int) -> bool:
        one, more, free = 0, 0, spare
        for size in filling:
            more |= (one | more) << size
            one |= 1 << size
        for size in set(filling):
            if filling.count(size) == have(size):
                free &= ~(1 << size)
        larger = (1 | one) << 1
        spread = 1
        while spread < waste:  # by 0 to ``waste`` for several pieces, by 1 to ``waste`` for one or none
            step = min(spread, waste - spread)
            larger, spread = larger | larger << step, spread + step
        if more:
            spread = 0
            while spread < waste:
                step = min(spread + 1, waste - spread)
                more, spread = more | more << step, spread + step
        return bool((more | (larger if waste else 0)) & free)

    for goal in range(room, -1, -1):
        if reach[-1] >> goal & 1:
            for filling in exact(len(sizes), goal, ()):
                yield None if dominated(filling, room - goal) else filling


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that no packing can do without: by volume, and by pieces that cannot share a bin with large ones."""
    if not counts:
        return 0
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    pieces, volume = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * sizes)]
    half = int(np.searchsorted(sizes, capacity // 2, side="right"))  # the first size above one half
    cut = np.arange(half)
    top = np.searchsorted(sizes, capacity - sizes[:half], side="right")  # the first that leaves no room for the cut
    room = (pieces[top] - pieces[half]) * capacity - (volume[top] - volume[half])
    bins = pieces[-1] - pieces[half] + np.maximum(0, -(-(volume[half] - volume[cut] - room) // capacity))
    return int(max(-(-volume[-1] // capacity), pieces[-1] - pieces[half], *bins))


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = 2000) -> list[tuple[tuple[int, ...], int]]:
    """(filling, bins) of a packing. ``nodes`` bounds the fillings that are looked at after the first descent, whatever
    the size of the table; beyond it the best packing found so far is returned, so every piece is always placed."""
    bound = lower_bound(counts, capacity)
    best: list = []
    best_bins = float("inf")
    left_nodes = nodes
    volume = sum(s * n for s, n in counts.items())
    # A frame is a state of the search: the choices not yet tried there, and how many were.
    left = dict(counts)
    path: list[tuple[tuple[int, ...], int]] = []
    stack: list[list] = []

    def options() -> Iterator[tuple[tuple[int, ...], int] | None]:
        """(filling, bins): every filling for as many bins as can be, then for fewer. Read only in the state it is for."""
        sizes = sorted(s for s, n in left.items() if n)
        big = sizes[-1]
        last = path[-1][0] if path else None
        left[big] -= 1
        first = (big, *best_fit([s for s in sizes if left[s]], left, capacity - big))
        left[big] += 1
        if first != last:
            yield first, min(left[s] // first.count(s) for s in set(first))

        def each():
            for filling in fillings(lambda s: left[s] - (s == big), sizes, capacity - big):
                # The filling before was to have fewer bins than it could, so it does not follow itself.
                if filling is None or (whole := (big, *filling)) == last:
                    yield None, 0
                else:
                    yield whole, min(left[s] // whole.count(s) for s in set(whole))

        for filling, times in each():
            yield (filling, times) if times and filling != first else None
        for filling, times in each():
            for fewer in range(times - 1, 0, -1):
                yield filling, fewer

    def undo() -> None:
        filling, times = path.pop()
        for s in filling:
            left[s] += times

    used, waste = 0, 0
    stack.append([options(), 0]) if volume else None
    while stack and (not best or (best_bins > bound and left_nodes > 0)):
        frame = stack[-1]
        if frame[0] is None:  # put away on the way down, as most frames are never seen again
            frame[0] = islice(options(), frame[1], None)
        choice = next(frame[0], ())
        frame[1] += 1
        left_nodes -= bool(best)
        if choice is None:
            continue
        if choice:
            filling, times = choice
            for s in filling:
                left[s] -= times
            path.append(choice)
            used += times
            waste += times * (capacity - sum(filling))
            remaining = {s: n for s, n in left.items() if n}
            if not remaining:
                if used < best_bins:
                    best, best_bins = list(path), used
            elif waste <= (best_bins - 1) * capacity - volume and used + (
                    lower_bound(remaining, capacity) if best else 0) < best_bins:
                if frame[1] == 1:
                    frame[0] = None
                stack.append([options(), 0])
                continue
        else:
            stack.pop()
        if path:
            filling, times = path[-1]
            used -= times
            waste -= times * (capacity - sum(filling))
            undo()
    return best


def _pieces(path: str, capacity: int, end_id: int):
    def pieces(batches):
        encode = encoder(path)
        for batch in batches:
            column = batch.column("text")
            for start, stop in byte_slices(string_sizes(column), SLICE_BYTES):
                out = {name: [] for name in ("row", "piece", "start", "length", "crc")}
                for row, ids in enumerate(encode(column.slice(start, stop - start).to_pylist())):
                    ids = np.append(ids, end_id).astype("<u4")
                    first = len(ids) % capacity or min(len(ids), capacity)
                    cuts = [0, *range(first, len(ids), capacity), len(ids)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        for name, value in zip(out, (row, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                            out[name].append(value)
                ids = batch.column("doc_id").slice(start, stop - start).take(pa.array(out["row"], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "crc"))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return pieces


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, text: str = "text", doc_id: str = "doc_id",
         rows_per_bucket: int = 1 << 20) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("text"))
    pieces = body.mapInArrow(_pieces(path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")
    # Written out: the ranks below must see the same rows in the same partitions each time.
    pieces = cut_lineage(pieces.withColumn("uid", F.monotonically_increasing_id()))

    # Rank within a length: ranks within (length, bucket), then the bucket's start. A frequent length has many buckets.
    sizes = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    per_bucket = max(1, min(rows_per_bucket, sum(sizes.values()) // (8 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    lengths = spark.createDataFrame(
        [(s, -(-n // per_bucket)) for s, n in sizes.items()], "length long, buckets int") if sizes else None
    if lengths is None:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32",
                             F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    spread = pieces.join(F.broadcast(lengths), "length").withColumn(
        "bucket", F.pmod(F.xxhash64("uid"), F.col("buckets")).cast("int"))
    spread = cut_lineage(spread.drop("buckets"))
    starts = spread.groupBy("length", "bucket").count().withColumn(
        "base", F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count"))
    ranked = spread.withColumn("place", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("uid")) - 1)
    ranked = ranked.join(starts.drop("count"), ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("place"))

    # A slot says: ranks [low, low + times) of this length go to bins [bin, bin + times) at this offset.
    taken, slots, at = {}, [], 0
    for filling, times in complete_bins(sizes, capacity):
        offset = 0
        for size in filling:
            low = taken.get(size, 0)
            slots.append((size, low, at, offset))
            taken[size] = low + times
            offset += size
        at += times
    by_length: dict[int, list] = {}
    for size, low, bin_, offset in slots:
        by_length.setdefault(size, []).append((low, bin_, offset))
    sent = spark.sparkContext.broadcast({s: np.array(v, np.int64) for s, v in by_length.items()})

    def place(frames):
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for size, rows in frame.groupby("length").indices.items():
                slot = sent.value[int(size)]
                rank = frame["rank"].to_numpy()[rows]
                i = np.searchsorted(slot[:, 0], rank, side="right") - 1
                sequence[rows], offset[rows] = slot[i, 1] + rank - slot[i, 0], slot[i, 2]
            yield pd.DataFrame({**{c: frame[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
                                "sequence_id": sequence, "offset": offset})

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
