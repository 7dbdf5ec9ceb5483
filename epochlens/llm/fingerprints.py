"""Document fingerprints: bottom-k sketches of shingle hashes.

A document is the set of its five-word shingles (lower-cased words between white space; fewer than five words make one
shingle). Its sketch holds the k smallest distinct 64-bit shingle hashes in ascending order. The sketch of a union is
the k smallest hashes of its parts' sketches, so sketches of parts can be merged in any order, within a text (a long
one is read in pieces) and between rows (``merge``). Two sketches estimate

* resemblance |A n B| / |A u B|: the share of the k smallest hashes of the union that both sketches hold,
* containment |A n B| / |A|: of the hashes of A below the largest one known of both, the share that B holds,
* the number of distinct shingles: (k - 1) / (kth smallest hash as a share of the hash range).

Sketches of fewer than k hashes are the whole set, and all three are exact then.

``succession`` compares every document with an edited version and with the document that follows. Order keys are cut
into ranges, at borders drawn from a bounded sample; every document goes once to its range, in one exchange, and the
first document of a range is sent to the range before it too, so each task holds the follower of all its documents.

Defined results: a null text is the empty text; a text without words has the empty sketch, which is like itself (1)
and unlike all others (0); documents follow one another by falling doc_id, a null doc_id last, rows with equal doc_id
by a hash of their texts, and the last is followed by the first, so a single document follows itself; a row that repeats
both is followed by its like, and only the last of them by another; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlens.llm.common import GOLDEN, cut_lineage, mix, whole

PIECE = 1 << 20
FULL = 2.0**64
BOUNDARY = re.compile(r"\s")


def _hashes(words: list[str], size: int, begins: int) -> np.ndarray:
    """Hashes of the shingles that start at the first ``begins`` words; one that runs out of words takes what is left."""
    import xxhash

    ids: dict[str, int] = {}
    row = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    prints = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in ids), np.uint64, len(ids))[row]
    value = np.full(begins, mix(np.array([min(size, len(words))], np.uint64) * GOLDEN)[0])
    for k in range(min(size, len(words))):
        value = mix(value + prints[k:k + begins] * GOLDEN)
    return value


def lowest(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if len(hashes) > 4 * k:  # few of a long text's hashes can be among the smallest
        near = np.partition(hashes, 2 * k)[2 * k]
        some = np.unique(hashes[hashes <= near])
        if len(some) >= k:
            return some[:k]
    return np.unique(hashes)[:k]


def sketch(text: str, k: int = 128, size: int = 5, piece: int = PIECE) -> np.ndarray:
    """The sketch of a text of any length, read in pieces that end between words and overlap by ``size - 1`` words."""
    held, before, start = np.empty(0, np.uint64), [], 0
    while start < len(text):
        stop = start + piece
        cut = BOUNDARY.search(text, stop) if stop < len(text) else None
        stop = cut.start() if cut else len(text)
        words = before + text[start:stop].lower().split()
        if len(words) >= size:
            held = lowest(np.concatenate([held, _hashes(words, size, len(words) - size + 1)]), k)
            words = words[len(words) - size + 1:]
        before, start = words, stop
    # Without a whole shingle, all words of the text are still waiting.
    return _hashes(before, size, 1) if before and not len(held) else held


def resemblance(a: np.ndarray, b: np.ndarray, k: int) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], side="right")) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """The share of A that lies in B; 1 for an empty A."""
    if not len(a):
        return 1.0
    if len(b) == k:
        a = a[a <= b[-1]]
    return float(len(np.intersect1d(a, b, assume_unique=True))) / len(a) if len(a) else 0.0


def distinct(a: np.ndarray, k: int) -> float:
    return float(len(a)) if len(a) < k else (k - 1) * FULL / (float(a[-1]) + 1)


def as_text(a: np.ndarray) -> str:
    """Base64 of the hashes as little-endian unsigned 64-bit numbers; empty for the empty sketch."""
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(code: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(code), "<u8")


def fingerprints(docs: DataFrame, k: int = 128, words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint, shingles (how many distinct ones, estimated) of every document."""
    def made(frames):
        for frame in frames:
            found = [sketch(t, k, words) for t in frame.text]
            yield pd.DataFrame({"doc_id": frame.doc_id.astype("Int64"), "fingerprint": [as_text(f) for f in found],
                                "shingles": np.array([distinct(f, k) for f in found], float)})

    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("text"))
    return body.mapInPandas(made, "doc_id long, fingerprint string, shingles double")


def merge(prints: DataFrame, by: str, k: int = 128) -> DataFrame:
    """(``by``, fingerprint) of the union of all documents with equal ``by``. Every task keeps the k smallest hashes of
    a group before anything is moved, so a group of any size reaches its task as k hashes from each."""
    def spread(frames):
        for frame in frames:
            held = [from_text(f) for f in frame.fingerprint]
            yield pd.DataFrame({"key": frame.key.repeat([max(1, len(h)) for h in held]).to_numpy(),
                                "hash": pd.array([x for h in held for x in ((h ^ np.uint64(1 << 63)).view(np.int64).tolist() or [None])], "Int64")})

    def packed(hashes: pd.Series) -> pd.Series:
        return hashes.map(lambda h: as_text(np.sort(np.asarray(h, np.int64).view(np.uint64) ^ np.uint64(1 << 63))))

    kind = dict(prints.dtypes)[by]
    rows = prints.select(F.col(by).alias("key"), "fingerprint").mapInPandas(spread, f"key {kind}, hash long").distinct()
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.col("hash").asc_nulls_last())))
    return ranked.where(F.col("rank") <= k).groupBy("key").agg(F.collect_list("hash").alias("h")).select(
        F.col("key").alias(by), F.pandas_udf(packed, "string")("h").alias("fingerprint"))


def compare(pairs: DataFrame, a: str, b: str, k: int = 128) -> DataFrame:
    """``pairs`` with resemblance, containment (of a in b) and contained (of b in a) of two fingerprint columns."""
    def measured(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        both = [(from_text(p), from_text(q)) for p, q in zip(x, y)]
        return pd.DataFrame([(resemblance(p, q, k), containment(p, q, k), containment(q, p, k)) for p, q in both],
                            columns=["resemblance", "containment", "contained"], dtype=float)

    got = F.pandas_udf(measured, "resemblance double, containment double, contained double")(a, b)
    return pairs.withColumn("__m", got).select(*(F.col(f"`{c}`") for c in pairs.columns), "__m.*")


def edited(text: str, after: str) -> str:
    """``text`` with its last half of code points (rounded down) replaced by as many of the start of ``after``, or by all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


class Ranges:
    """Which range a document lies in, and which range before it needs it as its last follower. ``borders`` are the first
    keys of all ranges but the first, ascending."""

    def __init__(self, borders: list[tuple[int, ...]]):
        self.borders = borders
        self.firsts: dict[tuple[int, ...], int] = {}

    def of(self, key: tuple[int, ...]) -> int:
        return bisect.bisect_right(self.borders, key)


def _range_of(ranges: Ranges, repeat: bool):
    def found(order: pd.Series, hashed: pd.Series, uid: pd.Series) -> pd.Series:
        out = []
        for key in zip(order.tolist(), hashed.tolist(), uid.tolist()):
            own = ranges.of(key)
            out.append([(own, 0), (ranges.firsts[key], 1)] if repeat and key in ranges.firsts else [(own, 0)])
        return pd.Series([[{"range": r, "extra": e} for r, e in places] for places in out])
    return F.pandas_udf(found, "array<struct<range: int, extra: int>>")


def _compared(k: int, words: int):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compared(batches):
        held = None  # the document before, which waits for its follower
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("range", "extra", "doc_id", "text")))
            out = []
            for place, extra, doc_id, text in rows:
                own = sketch(text, k, words)
                if held is not None:
                    if place != held[0]:
                        raise RuntimeError("a range has no follower for its last document: the table changed between two reads")
                    changed = edited(held[2], text)
                    other = sketch(changed, k, words) if changed != held[2] else held[3]
                    out.append((held[1], len(held[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), as_text(held[3]),
                                as_text(other), resemblance(held[3], other, k), resemblance(held[3], own, k)))
                held = None if extra else (place, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=names)
        if held is not None:
            raise RuntimeError("a range has no follower for its last document: the table changed between two reads")
    return compared


def succession(docs: DataFrame, k: int = 128, words: int = 5, text: str = "text", doc_id: str = "doc_id",
               sample: int = 40) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    table is read twice; only where rows repeat both doc_id and text must it have the same partitions both times, as a
    stored table has. ``sample`` keys a range decide on the borders; they only shape the ranges."""
    spark = docs.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ascending order is falling doc_id, nulls last: ~x is -1 - x.
    body = docs.select(F.coalesce(F.bitwise_not(F.col(doc_id).cast("long")), F.lit(2**63 - 1)).alias("order"),
                       F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("text"))
    body = body.select("order", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    key = ["order", "hash", "uid"]
    keys = cut_lineage(body.select(*key))
    # A share of the keys by their hash: about ``sample`` for each range reach the driver, from all tasks together.
    share = min(1.0, sample * count / max(1, keys.count()))
    drawn = sorted(tuple(r) for r in keys.where(F.pmod(F.xxhash64(*key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).collect())
    ranges = Ranges(sorted({drawn[len(drawn) * i // count] for i in range(1, count)}) if drawn else [])
    first = {r["range"]: tuple(r["first"]) for r in keys.withColumn("range", _range_of(ranges, False)(*key)[0]["range"]).groupBy(
        "range").agg(F.min(F.struct(*key)).alias("first")).collect()}  # a row for each range
    used = sorted(first)
    for before, after in zip(used, used[1:] + used[:1]):
        ranges.firsts[first[after]] = before

    placed = body.withColumn("place", F.explode(_range_of(ranges, True)(*key))).select(
        "place.range", "place.extra", *key, "doc_id", "text")
    return placed.repartitionById(max(1, len(ranges.borders) + 1), "range").sortWithinPartitions("range", "extra", *key).select(
        "range", "extra", "doc_id", "text").mapInArrow(
        _compared(k, words), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                             "near_edited double, near_next double")
