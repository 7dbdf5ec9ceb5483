"""Small helpers shared by the text operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.session import cut_lineage

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
LINKS_PER_TASK = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The whole text; a null counts as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one that ``cut_lineage`` sets up for tests where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        cut_lineage(spark.range(0))
    return spark.sparkContext.getCheckpointDir()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on unsigned 64-bit numbers (wraps on purpose)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_slices(sizes: np.ndarray, limit: int):
    """(start, stop) row ranges of at most ``limit`` bytes each; a larger row stands alone."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def string_sizes(column) -> np.ndarray:
    """UTF-8 byte lengths of an Arrow string column without nulls."""
    import pyarrow.compute as pc

    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


class HashFilter:
    """A bitmap over the leading bits of a set of 64-bit hashes: a row whose bit is not set is certainly not of the set and
    need not be moved to find that out. Sixteen bits for each hash (one stranger in sixteen passes), up to 2**27 bits,
    which are at most two million words of 64 bits and the only thing that is broadcast, whatever the size of the set; a
    larger set fills the bitmap and more strangers pass, which an exact join then removes."""

    def __init__(self, hashes: DataFrame, most: int = 27):
        self.bits = min(most, max(6, (16 * hashes.count()).bit_length()))
        word, bit = self._place(F.col(hashes.columns[0]))
        self.words = cut_lineage(hashes.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(
            F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__set")))

    def _place(self, hashed: Column) -> tuple[Column, Column]:
        place = F.shiftrightunsigned(hashed, 64 - self.bits)
        return F.shiftrightunsigned(place, 6), place.bitwiseAND(63).cast("int")

    def _met(self, hashed: Column) -> Column:
        word, bit = self._place(hashed)
        return (word == F.col("__word")) & (F.getbit("__set", bit) == 1)

    def passing(self, df: DataFrame, hashed: Column) -> DataFrame:
        """The rows that may be of the set, and all that are."""
        return df.join(F.broadcast(self.words), self._met(hashed), "left_semi")

    def strangers(self, df: DataFrame, hashed: Column) -> DataFrame:
        """The other rows."""
        return df.join(F.broadcast(self.words), self._met(hashed), "left_anti")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that occurs in a link between long ids: the smallest id of its connected
    component. Alternating large-star and small-star rounds until the link set stays the same; each round is
    a grouping with map-side minimum and one join, so a node with very many links is split by the skew join.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = cut_lineage(edges)
    # As many tasks as the links fill: the rounds below make several small exchanges each.
    tasks = max(8, -(-edges.count() // LINKS_PER_TASK))
    edges = edges.coalesce(tasks)
    mark = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u <> v").coalesce(tasks).distinct()
        edges = cut_lineage(small.coalesce(tasks))
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def subtract(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``decisions`` (doc_id, fp of the text, kept; it may leave rows out) does not
    keep. Rows that no decision can concern stay where they are; only the others are moved and compared by key. Where
    decisions keep some of several rows with equal doc_id and text, one of them stays."""
    row = decisions.groupBy(F.col("doc_id").alias("__d"), F.col("fp").alias("__f")).agg(
        F.max("kept").alias("any"), F.min("kept").alias("every"))
    row = cut_lineage(row.where("not every"))
    concerned = HashFilter(row.select(F.xxhash64("__d", "__f").alias("h")))
    marked = docs.withColumn("__fp", F.xxhash64(whole(docs["text"])))
    hashed = F.xxhash64(F.col("doc_id").cast("long"), F.col("__fp"))
    maybe = concerned.passing(marked, hashed)
    same = maybe["doc_id"].eqNullSafe(F.col("__d")) & (maybe["__fp"] == F.col("__f"))
    left = maybe.join(row.select("__d", "__f"), same, "left_anti")
    tied = maybe.join(row.where("any").select("__d", "__f"), same, "left_semi").dropDuplicates(["doc_id", "__fp"])
    return concerned.strangers(marked, hashed).unionByName(left).unionByName(tied).drop("__fp")
