"""Near duplicates by BagMinHash signatures over multisets of word shingles.

A document is the multiset of its five-word shingles (lower-cased words between white space; fewer than five words
make one shingle). The weight of a shingle is how often it occurs.

* **Signature.** For every shingle and every dyadic weight interval (0,1], (1,2], (2,4], ... a Poisson process keyed
  by (shingle, interval) emits points in ascending time; each has a component and a weight level. A point counts if
  its level lies below the shingle's weight, and a component keeps its earliest point. Intervals above the weight are
  never opened and a process stops once it passes the latest component, so the work is about
  ``shingles + components * ln(components)``. Two documents share a component with probability equal to their
  weighted Jaccard similarity, without bias.
* **Bands.** ``bands * rows`` components; at the threshold 0.8 a pair misses all 40 bands of 6 with probability 5e-6.
* **Verification.** Equal multisets are one node. In a bucket every node is compared with the bucket's smallest node
  by true multiset overlap. Nodes whose buckets still hold several components go through a second, exact pass: their
  rarest shingles (see ``_prefixes``) are the buckets, and nodes in different components that pass the bounds of
  ``_possible`` are compared pair by pair. Pairs inside one component
  can add nothing, so no link between components is lost, and n near copies cost about n comparisons, not n squared.

Defined results: null or wordless texts have no shingles and stay alone; ties go to the largest doc_id, a null
doc_id last, repeated rows keep the one read first. Other columns are not touched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.llm.common import GOLDEN, HashFilter, byte_slices, components, cut_lineage, mix, string_sizes, subtract, whole

LOWEST = -(2**63)
SLICE_BYTES = 2 << 20
HASHED = 16
PARITY = 8
BITS = [f"p{i}" for i in range(PARITY)]


def shingle_bags(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, weight), ordered by document and hash."""
    import xxhash

    ids: dict[str, int] = {}
    spread = [[ids.setdefault(w, len(ids)) for w in text.lower().split()] for text in texts]
    sizes = np.fromiter(map(len, spread), np.int64, len(spread))
    prints = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in ids), np.uint64, len(ids))
    if not len(prints):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    flat = prints[np.fromiter((i for row in spread for i in row), np.int64, int(sizes.sum()))]
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(flat)) - starts[doc]
    # A shingle starts at every word that has enough followers; a short document has one, of all its words.
    begin = np.flatnonzero((place + words <= sizes[doc]) | (place == 0))
    length = np.minimum(words, sizes[doc[begin]])
    value = mix(length.astype(np.uint64) * GOLDEN)
    for k in range(words):
        has = length > k
        value[has] = mix(value[has] + flat[begin[has] + k] * GOLDEN)
    order = np.lexsort((value, doc[begin]))
    doc, value = doc[begin][order], value[order]
    first = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(value) != 0)])
    return doc[first], value[first], np.diff(np.r_[first, len(doc)])


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """BagMinHash: the earliest point's time of every component, infinity for documents without shingles."""
    earliest = np.full(docs * size, np.inf)
    depth = np.ceil(np.log2(weight)).astype(np.int64) + 1 if len(weight) else weight
    owner = np.repeat(np.arange(len(doc)), depth)
    level = np.arange(len(owner)) - (np.cumsum(depth) - depth)[owner]
    lower = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(lower, 1).astype(np.float64)
    seed = mix(shingle[owner] + (level.astype(np.uint64) + np.uint64(1)) * GOLDEN)
    doc, room = doc[owner], (weight[owner] - lower) / width
    time, step = np.zeros(len(owner)), np.zeros(len(owner), np.uint64)
    scale = 2.0**-53
    while len(doc):
        step += np.uint64(1)
        bits = mix(seed + step * GOLDEN)
        time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 1) * scale) / width
        more = mix(bits ^ seed)
        slot = doc * size + ((more >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        counts = (more & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < room
        np.minimum.at(earliest, slot[counts], time[counts])
        alive = time < earliest.reshape(docs, size).max(axis=1)[doc]
        doc, room, time, step, seed, width = (x[alive] for x in (doc, room, time, step, seed, width))
    return earliest.reshape(docs, size)


def multiset_keys(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums that identify a multiset."""
    keys = []
    for salt in (1, 2):
        one = mix(mix(shingle + mix(np.array([salt], np.uint64))) ^ weight.astype(np.uint64) * GOLDEN)
        total = np.zeros(docs, np.uint64)
        np.add.at(total, doc, one)
        keys.append(mix(total))
    return keys[0], keys[1]


def _sketch(words: int, bands: int, rows: int):
    def sketch(batches):
        for batch in batches:
            column = batch.column("text")
            for start, stop in byte_slices(string_sizes(column), SLICE_BYTES):
                bag = shingle_bags(column.slice(start, stop - start).to_pylist(), words)
                n = stop - start
                times = signatures(*bag, n, bands * rows)
                key, key2 = multiset_keys(*bag, n)
                code = mix(np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], n, 0) * GOLDEN)
                parts = times.view(np.uint64).reshape(n, bands, rows)
                for r in range(rows):
                    code = mix(code * GOLDEN + parts[:, :, r])
                filled = np.isfinite(times[:, 0])
                offsets = np.r_[0, np.cumsum(np.where(filled, bands, 0))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(start, n), batch.column("fp").slice(start, n), pa.array(key.view(np.int64)), pa.array(key2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(code[filled].ravel().view(np.int64))),
                ], names=["doc_id", "fp", "key", "key2", "bands"])
    return sketch


def _bags(words: int):
    def bags(batches):
        for batch in batches:
            column = batch.column("text")
            for start, stop in byte_slices(string_sizes(column), SLICE_BYTES):
                n = stop - start
                doc, shingle, weight = shingle_bags(column.slice(start, n).to_pylist(), words)
                key, key2 = multiset_keys(doc, shingle, weight, n)
                cut = np.searchsorted(doc, np.arange(n + 1))
                cell = doc * (64 * PARITY) + (shingle & np.uint64(64 * PARITY - 1)).astype(np.int64)
                odd = (np.bincount(cell, weight, n * 64 * PARITY) % 2).astype(np.uint8)
                parity = np.packbits(odd).view(np.int64).reshape(n, PARITY)
                total = np.bincount(doc, weight, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), pa.array(key2.view(np.int64)),
                    pa.array([shingle[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                    pa.array([weight[a:b].astype(np.uint32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                    pa.array(total), *(pa.array(np.ascontiguousarray(parity[:, i])) for i in range(PARITY)),
                ], names=["key", "key2", "shingles", "weights", "total", *BITS])
    return bags


def _overlaps(frames):
    for frame in frames:
        found = []
        for sa, wa, sb, wb in zip(frame.sa, frame.wa, frame.sb, frame.wb):
            sa, sb = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
            wa, wb = np.frombuffer(wa, np.uint32).astype(np.int64), np.frombuffer(wb, np.uint32).astype(np.int64)
            at = np.minimum(np.searchsorted(sb, sa), len(sb) - 1)
            shared = int(np.minimum(wa, wb[at])[sb[at] == sa].sum())
            found.append(shared / (int(wa.sum()) + int(wb.sum()) - shared))
        yield pd.DataFrame({"a": frame.a, "b": frame.b, "similarity": np.array(found, np.float64)})


def _possible(threshold: float, pos: bool = False) -> Column:
    """Exact bounds on a pair with columns total, p0.. and a_total, a_p0..: the totals; the parity bits, of which two
    multisets at distance d differ in at most d; and the weight left after a shared shingle, as the first one that two
    multisets share precedes all others."""
    both = F.col("total") + F.col("a_total")
    shared = threshold / (1 + threshold) * both - 1e-6
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"a_{c}"))) for c in BITS), F.lit(0))
    bound = (F.least("a_total", "total") >= threshold * F.greatest("a_total", "total")) & (apart <= both - 2 * shared)
    return bound & (F.least(F.col("total") - F.col("pos"), F.col("a_total") - F.col("a_pos")) >= shared) if pos else bound


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links among the pairs (a, b). The bounds rule out most pairs before any multiset is moved for them."""
    light = sets.select("key", "total", *BITS)
    pairs = pairs.join(light.toDF("a", "a_total", *(f"a_{c}" for c in BITS)), "a").join(
        light.withColumnRenamed("key", "b"), "b").where(_possible(threshold)).select("a", "b")
    wide = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa")), "a")
    wide = wide.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb")), "b")
    return wide.mapInPandas(_overlaps, "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5,
                    threshold: float = 0.8, bands: int = 40, rows: int = 6) -> DataFrame:
    """One row per document: doc_id, class_id (largest doc_id of its class), class_size, kept, fp (a 64-bit hash
    of its text)."""
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("text"))
    named = body.withColumn("fp", F.xxhash64("text"))
    slim = cut_lineage(named.mapInArrow(_sketch(words, bands, rows), "doc_id long, fp long, key long, key2 long, bands array<long>")
                       .withColumn("uid", F.monotonically_increasing_id()))
    shingled = slim.where("size(bands) > 0")
    nodes = shingled.groupBy("key").agg(F.min("key2").alias("key2"), F.max("doc_id").alias("doc_id"))

    # A bucket matters if it holds two different nodes.
    entries = shingled.select("key", F.explode("bands").alias("band"))
    buckets = cut_lineage(entries.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high"))
                          .where("low < high").select("band", "low"))
    members = cut_lineage(entries.join(buckets, "band").groupBy("band", "key").agg(F.min("low").alias("low")))
    involved = members.select("key").distinct().join(nodes, "key")
    # Texts that are not needed stay where they are: a bitmap of the ids sorts most of them out before the join.
    wanted = cut_lineage(involved.select(F.col("doc_id").alias("_d")).distinct())
    source = HashFilter(wanted.select(F.xxhash64("_d").alias("h"))).passing(body, F.xxhash64("doc_id")).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    sets = source.select("text").mapInArrow(
        _bags(words), "key long, key2 long, shingles binary, weights binary, total long, " + ", ".join(f"{b} long" for b in BITS))
    sets = sets.join(involved.select("key", "key2"), ["key", "key2"], "left_semi").dropDuplicates(["key"])
    sets = cut_lineage(sets.drop("key2"))

    first = members.where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b")).distinct()
    links = cut_lineage(_verified(first, sets, threshold))
    roots = components(links)
    placed = members.join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "band", "key", F.coalesce("root", "key").alias("root"))
    split = placed.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("band")
    open_sets = sets.join(placed.join(split, "band").select("key").distinct(), "key", "left_semi")
    prefixes = cut_lineage(_prefixes(open_sets, threshold))
    now = prefixes.join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        *prefixes.columns, F.coalesce("root", "key").alias("root"))
    more = cut_lineage(_verified(_across(now, threshold), sets, threshold))
    roots = components(links.unionByName(more))

    # Rows whose second hash differs from their node's are strangers with the same first hash: they stay alone.
    first_hash = nodes.select("key", F.col("key2").alias("node2")).join(roots.withColumnRenamed("node", "key"), "key", "left")
    order = F.coalesce("doc_id", F.lit(LOWEST))
    grouped = shingled.join(first_hash, "key").select(
        "doc_id", "fp", "uid", "key", order.alias("ord"), F.coalesce("root", "key").alias("root"), "key2", "node2")
    same = cut_lineage(grouped.where("key2 = node2").drop("key2", "node2"))
    once = same.groupBy("root", "ord").agg(F.count("*").alias("n"), F.min("uid").alias("uid"))
    classes = once.groupBy("root").agg(F.max("ord").alias("keep"), F.sum("n").alias("size"), F.max_by("uid", "ord").alias("keep_uid"))
    joined = same.join(cut_lineage(classes), "root").select(
        "doc_id", F.when(F.col("keep") != LOWEST, F.col("keep")).alias("class_id"), F.col("size").alias("class_size"),
        (F.col("uid") == F.col("keep_uid")).alias("kept"), "fp")
    alone = slim.where("size(bands) = 0").select("doc_id", "fp").union(
        grouped.where("key2 <> node2").select("doc_id", "fp"))
    return joined.unionByName(alone.select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "fp"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each class, with their own columns."""
    return subtract(docs, near_duplicates(docs).where("class_size > 1"))


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(key, total, shingle) of every node's rarest shingles, up to more than ``1 - threshold`` of its weight. Two
    multisets at the threshold share one of them, whatever the order, if all nodes use the same order: that makes
    the second pass exact. Rarest first keeps widely shared passages out. Rarity is a count over all nodes in
    ``2**HASHED`` hashed cells, a size that does not grow with the input."""
    def cells(frames):
        for frame in frames:
            flat = np.concatenate([np.frombuffer(s, np.uint64) for s in frame.shingles] or [np.empty(0, np.uint64)])
            cell, n = np.unique(flat >> np.uint64(64 - HASHED), return_counts=True)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "n": n.astype(np.int64)})

    counted = sets.select("shingles").mapInPandas(cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    held = counted.toPandas()
    dense = np.zeros(1 << HASHED, np.int64)
    dense[held.cell.to_numpy()] = held.n.to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(dense)

    def rarest(frames):
        for frame in frames:
            picked, before = [], []
            for packed, weights, total in zip(frame.shingles, frame.weights, frame.total):
                shingle, weight = np.frombuffer(packed, np.uint64), np.frombuffer(weights, np.uint32).astype(np.int64)
                order = np.lexsort((shingle, shared.value[shingle >> np.uint64(64 - HASHED)]))
                passed = np.cumsum(weight[order])
                stop = int(np.searchsorted(passed, (1 - threshold) * total * (1 + 1e-9), side="right")) + 1
                picked.append(shingle[order[:stop]].view(np.int64))
                before.append((passed - weight[order])[:stop])
            n = [len(x) for x in picked]
            yield pd.DataFrame({"shingle": np.concatenate(picked or [np.empty(0, np.int64)]),
                                "pos": np.concatenate(before or [np.empty(0, np.int64)]),
                                **{c: np.repeat(frame[c].to_numpy(), n) for c in ("key", "total", *BITS)}})

    columns = ", ".join(f"{c} long" for c in BITS)
    return sets.mapInPandas(rarest, f"shingle long, pos long, key long, total long, {columns}")


def _across(entries: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle bucket: every node outside the bucket's largest
    component against all others, thinned by the bounds."""
    # One exchange by shingle serves all the groupings and joins below.
    entries = entries.repartition(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shingle")
    mixed = entries.groupBy("shingle").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1")
    main = entries.groupBy("shingle", "root").agg(F.count("*").alias("n")).groupBy("shingle").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"))
    names = ("shingle", "key", "root", "total", "pos", *BITS)
    outside = entries.join(main.join(mixed.select("shingle"), "shingle"), "shingle").where("root <> main")
    pick = outside.select(*(F.col(c).alias(f"a_{c}") for c in names))
    near = (F.col("root") != F.col("a_root")) & _possible(threshold, pos=True)
    return entries.join(pick, (F.col("shingle") == F.col("a_shingle")) & near).select(
        F.greatest("a_key", "key").alias("a"), F.least("a_key", "key").alias("b")).distinct()
