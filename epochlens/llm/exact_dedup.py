"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. One pass over the texts leaves a slim row each: ids, SHA-256, a 64-bit fingerprint, the sending partition.
2. Every partition sorts its distinct fingerprints, cuts them at the owners' range borders and sends each owner
   one Golomb-Rice coded list and a bitmap of what it holds more than once itself.
3. An owner decodes its lists, finds what occurs twice and answers each sender with a bitmap over the list it sent.
4. The sender's rows take their bit. Only rows with a set bit are suspects. Their fingerprints' leading bits go out as a
   bitmap of bounded size (``HashFilter``), by which every sender thins its texts; what is left, the suspects and one
   stranger in sixteen, is shuffled, folded by (fingerprint, SHA-256, text) before that, and compared byte for byte.

Defined results: a null text is the empty text; a null doc_id orders below every number; of rows that repeat both
text and doc_id, the one read first stays. Other columns, whatever their names, are not touched. An empty table
gives an empty result. Should two different texts ever share both hashes, the job fails and does not merge them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlens.llm.common import HashFilter, cut_lineage, subtract, whole

LOWEST = -(2**63)


def rice_encode(values: np.ndarray, bits: int) -> bytes:
    """Golomb-Rice code of ascending unsigned numbers: unary quotients of the gaps, then ``bits``-bit remainders."""
    gaps = np.diff(values, prepend=np.uint64(0))
    quotient = (gaps >> np.uint64(bits)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    shifts = np.arange(bits, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    head = np.packbits(unary)
    return len(head).to_bytes(8, "little") + head.tobytes() + np.packbits(rest).tobytes()


def rice_decode(code: bytes, count: int, bits: int) -> np.ndarray:
    size = int.from_bytes(code[:8], "little")
    unary = np.unpackbits(np.frombuffer(code, np.uint8, size, 8))
    quotient = np.diff(np.flatnonzero(unary)[:count], prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(code, np.uint8, offset=8 + size))[: count * bits].reshape(count, bits)
    weight = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(bits)) + rest.astype(np.uint64) @ weight, dtype=np.uint64)


def owner_of(prints: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold equal ranges of the upper 32 bits."""
    return ((prints >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def _send(owners: int):
    def send(frames):
        held: dict[int, list[np.ndarray]] = {}
        for frame in frames:
            for part, own in frame.groupby("part")["fp"]:
                held.setdefault(int(part), []).append(own.to_numpy().astype(np.int64).view(np.uint64))
        for part, pieces in held.items():
            prints, counts = np.unique(np.concatenate(pieces), return_counts=True)
            cuts = np.searchsorted(owner_of(prints, owners), np.arange(owners + 1))
            rows = []
            for owner in range(owners):
                own = prints[cuts[owner]:cuts[owner + 1]]
                if not len(own):
                    continue
                base = own[0]
                span = max(1, (int(own[-1]) - int(base)) // len(own))
                bits = min(63, max(1, span.bit_length() - 1))
                rows.append((owner, part, len(own), bits, int(base.view(np.int64)), rice_encode(own - base, bits),
                             np.packbits(counts[cuts[owner]:cuts[owner + 1]] > 1).tobytes()))
            yield pd.DataFrame(rows, columns=["owner", "part", "n", "bits", "base", "code", "own"])
    return send


def _answer(lists: pd.DataFrame) -> pd.DataFrame:
    """The owner's side: one bitmap for each list, over the list's order."""
    decoded = [rice_decode(c, n, b) + np.int64(base).view(np.uint64)
               for c, n, b, base in zip(lists.code, lists.n, lists.bits, lists.base)]
    own = [np.unpackbits(np.frombuffer(o, np.uint8))[:n] for o, n in zip(lists.own, lists.n)]
    _, inverse, counts = np.unique(np.concatenate(decoded), return_inverse=True, return_counts=True)
    twice = (counts > 1)[inverse] | (np.concatenate(own) > 0)
    ends = np.cumsum(lists.n.to_numpy())
    bitmaps = [np.packbits(twice[e - n:e]).tobytes() for e, n in zip(ends, lists.n)]
    return pd.DataFrame({"part": lists.part, "owner": lists.owner, "n": lists.n, "bitmap": bitmaps})


def _take(owners: int):
    def take(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        prints, inverse = np.unique(rows.fp.to_numpy().astype(np.int64).view(np.uint64), return_inverse=True)
        answers = answers.sort_values("owner")
        bits = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(answers.bitmap, answers.n)]
        # Owners hold ascending ranges, so their bitmaps in order line up with the sorted fingerprints.
        return rows.assign(suspect=np.concatenate(bits).astype(bool)[inverse] if len(rows) else [])
    return take


def duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
               rows_per_owner: int = 1 << 22) -> DataFrame:
    """One row per document: doc_id, keep_id (the largest doc_id with that text), group_size, kept, text_sha256, fp (a
    64-bit hash of the text). ``rows_per_owner`` bounds an owner's memory."""
    spark = docs.sparkSession
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("text"))
    hashed = body.select("doc_id", "text", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("fp"))
    slim = cut_lineage(hashed.select("doc_id", "sha", "fp", F.spark_partition_id().alias("part"),
                                     F.monotonically_increasing_id().alias("uid")))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slim.count() // rows_per_owner))
    lists = slim.select("part", "fp").mapInPandas(
        _send(owners), "owner int, part int, n int, bits int, base long, code binary, own binary")
    answers = lists.groupBy("owner").applyInPandas(_answer, "part int, owner int, n int, bitmap binary")
    marked = cut_lineage(slim.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(
        _take(owners), "doc_id long, sha string, fp long, part int, uid long, suspect boolean"))

    order = F.coalesce("doc_id", F.lit(LOWEST))
    suspects = marked.where("suspect").withColumn("ord", order)
    once = suspects.groupBy("fp", "sha", "ord").agg(F.count("*").alias("n"), F.min("uid").alias("uid"))
    groups = once.groupBy("fp", "sha").agg(
        F.max("ord").alias("keep"), F.sum("n").alias("size"), F.max_by("uid", "ord").alias("keep_uid"))
    prints = cut_lineage(suspects.select("fp").distinct())
    texts = HashFilter(prints).passing(hashed, F.col("fp")).join(prints, "fp", "left_semi").groupBy("fp", "sha", "text").agg(
        F.count("*").alias("n")).groupBy("fp", "sha").agg(F.count("*").alias("texts"))
    checked = groups.join(texts, ["fp", "sha"]).withColumn(
        "size", F.when(F.col("texts") == 1, F.col("size")).otherwise(
            F.raise_error(F.lit("different texts share both hashes")).cast("long")))
    # Written out, so that the last join has exchanges of its own and a group with very many copies can be split.
    checked = cut_lineage(checked)
    paired = suspects.join(checked, ["fp", "sha"]).select(
        "doc_id", F.when(F.col("keep") != LOWEST, F.col("keep")).alias("keep_id"),
        F.col("size").alias("group_size"), (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.col("sha").alias("text_sha256"), "fp")
    alone = marked.where("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), "fp")
    return alone.unionByName(paired)


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns."""
    return subtract(docs, duplicates(docs).where("group_size > 1"))
