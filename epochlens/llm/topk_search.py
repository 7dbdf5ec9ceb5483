"""Exact top-k inner-product search by dual-tree cover-tree traversal.

Vectors are cut into bounded blocks by nearest pivot (and by a hash where a pivot has many, so that equal vectors are
spread); a task builds a cover tree over each block. Queries are grouped the same way and have trees of their own. A
pair of nodes cannot hold a score above ``<c, d> + |c| s + |d| r + r s`` (centres c, d; covering radii r, s); it is
pruned when that lies below the worst k-th score of the query group. The same bound prunes whole (group, block) pairs
before anything is shipped, with thresholds from a first search of each group in the blocks of its own pivot.

Defined results: scores are integers of floor(scale * component); vectors that are null or hold null or non-finite
components take no part, as queries or candidates; only vectors of equal dimension are compared; a query's own row is
no candidate, but a repeated row with its id is; ties go to the smaller id, a null id last; an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlens.llm.common import cut_lineage

LEAF = 256
EXACT = float(2**53)


def as_matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.int64).reshape(len(vectors), -1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in float64 while every partial sum is exactly representable, else as integers."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class CoverTree:
    """Nodes cover a run of points, each within its radius of the node's centre, one of the points. A node's children
    have centres more than half its radius apart, and every point goes to the nearest of them."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.points = points
        real = points.astype(np.float64)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        order = self.order

        def add(low: int, high: int, centre: int) -> int:
            node = len(self.centre)
            away = np.sqrt(((real[order[low:high]] - real[centre]) ** 2).sum(axis=1))
            self.centre.append(centre)
            self.radius.append(float(away.max()))
            self.span.append((low, high))
            self.children.append([])
            return node

        open_ = [add(0, len(points), 0)] if len(points) else []
        while open_:
            node = open_.pop()
            low, high = self.span[node]
            if high - low <= LEAF or self.radius[node] == 0:
                continue
            own = order[low:high].copy()
            near = np.sqrt(((real[own] - real[self.centre[node]]) ** 2).sum(axis=1))
            belongs = np.zeros(len(own), np.int64)
            centres = [self.centre[node]]
            while near.max() > self.radius[node] / 2:
                centres.append(int(own[near.argmax()]))
                away = np.sqrt(((real[own] - real[centres[-1]]) ** 2).sum(axis=1))
                belongs[away < near] = len(centres) - 1
                near = np.minimum(near, away)
            rank = np.argsort(belongs, kind="stable")
            order[low:high] = own[rank]
            edges = low + np.searchsorted(belongs[rank], np.arange(len(centres) + 1))
            for c, (a, b) in zip(centres, zip(edges, edges[1:])):
                if b > a:
                    child = add(int(a), int(b), c)
                    self.children[node].append(child)
                    open_.append(child)
        self.sorted = points[order]
        self.centres = real[self.centre] if self.centre else real
        self.norms = np.sqrt((self.centres ** 2).sum(axis=1))
        self.radii = np.array(self.radius)


class Best:
    """The k best candidates of every query of a group, by falling score, then rising id."""

    def __init__(self, count: int, k: int):
        self.k = k
        self.rows = [(np.empty(0, np.int64), np.empty(0, np.int64))] * count
        self.kth = np.full(count, -np.inf)

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.rows[query][0], scores], np.r_[self.rows[query][1], ids]
        order = np.lexsort((ids, -scores))[: self.k]
        self.rows[query] = scores[order], ids[order]
        if len(order) == self.k:
            self.kth[query] = max(self.kth[query], scores[order[-1]])


def dual_search(queries: CoverTree, query_rows: np.ndarray, data: CoverTree, ids: np.ndarray, rows: np.ndarray, best: Best) -> None:
    """Traverse both trees together, most promising pairs first. ``*_rows`` are row numbers, to leave out the own row."""

    def bounds(q: int, nodes: list[int]) -> np.ndarray:
        d = np.array(nodes)
        reach = queries.centres[q] @ data.centres[d].T
        slack = queries.norms[q] * data.radii[d] + queries.radii[q] * (data.norms[d] + data.radii[d])
        return reach + slack + 1e-6 * (1 + np.abs(reach) + slack)

    open_ = [(float(bounds(0, [0])[0]), 0, 0)]
    while open_:
        bound, q, d = open_.pop()
        low, high = queries.span[q]
        group = queries.order[low:high]
        if bound < best.kth[group].min():
            continue
        split_q = queries.children[q] and (queries.radii[q] >= data.radii[d] or not data.children[d])
        if split_q:
            pairs = [(float(bounds(c, [d])[0]), c, d) for c in queries.children[q]]
        elif data.children[d]:
            pairs = [(float(b), q, c) for b, c in zip(bounds(q, data.children[d]), data.children[d])]
        else:
            a, b = data.span[d]
            scores = inner(queries.sorted[low:high], data.sorted[a:b])
            hopeful = scores >= best.kth[group][:, None]
            hopeful &= query_rows[group][:, None] != rows[data.order[a:b]][None, :]
            found = ids[data.order[a:b]]
            for i in np.flatnonzero(hopeful.any(axis=1)).tolist():
                best.offer(int(group[i]), scores[i][hopeful[i]], found[hopeful[i]])
            continue
        open_ += sorted(pairs)


def quantised(table: DataFrame, vector: str, vec_id: str, scale: int) -> DataFrame:
    """(uid, vec_id, dim, v) of the vectors that take part."""
    x = F.col(vector)
    # sqrt-free test for finite: not NaN and below infinity.
    sound = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return table.where(sound).select(
        F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("vec_id"), F.size(x).alias("dim"),
        F.transform(x, lambda e: F.floor(scale * e.cast("double"))).alias("v")).where("dim > 0")


def _near(pivots: dict[int, np.ndarray]):
    def near(frames):
        for frame in frames:
            pivot = np.zeros(len(frame), np.int32)
            for dim, at in frame.groupby("dim").indices.items():
                points, centres = as_matrix(frame.v.iloc[at]).astype(np.float64), pivots.get(int(dim))
                if centres is not None:
                    pivot[at] = ((points ** 2).sum(1)[:, None] - 2 * points @ centres.T + (centres ** 2).sum(1)).argmin(1)
            yield frame.assign(pivot=pivot)
    return near


def _built(group: pd.DataFrame) -> pd.DataFrame:
    """One block: its tree with ids and row numbers packed, and what bounds need."""
    tree = CoverTree(as_matrix(group.v))
    packed = pickle.dumps((tree, group.vec_id.fillna(2**63 - 1).to_numpy(np.int64), group.uid.to_numpy(np.int64)), 5)
    return pd.DataFrame({"dim": [int(group.dim.iloc[0])], "pivot": [int(group["pivot"].iloc[0])], "sub": [int(group["sub"].iloc[0])],
                         "centre": [tree.centres[0].tolist()], "radius": [tree.radii[0]], "packed": [packed]})


BLOCK = "dim int, pivot int, sub int, centre array<double>, radius double, packed binary"


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows cut into blocks of about ``size`` by (dim, pivot) and, where a pivot has more, by a hash of the row."""
    counts = rows.groupBy("dim", "pivot").count().withColumn("subs", F.ceil(F.col("count") / size).cast("int"))
    spread = rows.join(F.broadcast(cut_lineage(counts.drop("count"))), ["dim", "pivot"])  # a row per pivot
    spread = spread.withColumn("sub", F.pmod(F.xxhash64("uid"), F.col("subs")).cast("int")).drop("subs")
    built = spread.groupBy("dim", "pivot", "sub").applyInPandas(_built, BLOCK)
    return cut_lineage(built.withColumn("id", F.monotonically_increasing_id()))


def _searched(k: int):
    def searched(groups: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        """Every query group of the slice in the block; ``kth`` holds the thresholds known before."""
        out = []
        for _, block in blocks.iterrows():
            data, ids, rows = pickle.loads(block.packed)
            for _, group in groups.iterrows():
                tree, query_ids, query_rows = pickle.loads(group.packed)
                best = Best(len(query_rows), k)
                best.kth[:] = -np.inf if group.kth is None else np.asarray(group.kth, np.float64)
                dual_search(tree, query_rows, data, ids, rows, best)
                for i, (scores, found) in enumerate(best.rows):
                    out.append(pd.DataFrame({"group": int(group.group), "uid": query_rows[i], "query_id": query_ids[i],
                                             "vec_id": found, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame(columns=["group", "uid", "query_id", "vec_id", "score"], dtype="int64")
    return searched


HITS = "group long, uid long, query_id long, vec_id long, score long"


def _search(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, k: int, slices: int) -> DataFrame:
    """Search the (group, block) pairs. A block goes once to each slice of the groups that need it."""
    pairs = pairs.withColumn("slice", F.pmod(F.xxhash64("group"), F.lit(slices)).cast("int"))
    left = pairs.join(groups, "group").select("block", "slice", "group", "kth", "packed")
    needed = pairs.select(F.col("block").alias("id"), F.col("slice").alias("part")).distinct()
    right = needed.join(blocks.select("id", "packed"), "id")
    return left.groupBy("block", "slice").cogroup(right.groupBy("id", "part")).applyInPandas(_searched(k), HITS)


def _kth(k: int):
    """Thresholds of each group's queries, in the order of its tree's rows."""
    def kth(groups: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, group in groups.iterrows():
            _, _, query_rows = pickle.loads(group.packed)
            held = {u: g.score.nlargest(k) for u, g in hits.groupby("uid")}
            known = [float(held[u].iloc[-1]) if u in held and len(held[u]) == k else -np.inf for u in query_rows.tolist()]
            rows.append((int(group.group), int(group.dim), group.centre, float(group.radius), group.packed, known))
        return pd.DataFrame(rows, columns=["group", "dim", "centre", "radius", "packed", "kth"])
    return kth


def _promising(frames):
    for mixed in frames:
        for _, frame in mixed.groupby("dim"):
            c, d = np.array(frame.q_centre.tolist()), np.array(frame.centre.tolist())
            r, s = frame.q_radius.to_numpy(), frame.radius.to_numpy()
            reach = (c * d).sum(1)
            slack = np.sqrt((c * c).sum(1)) * s + r * (np.sqrt((d * d).sum(1)) + s)
            keep = reach + slack + 1e-6 * (1 + np.abs(reach) + slack) >= frame.worst.to_numpy()
            yield pd.DataFrame({"group": frame.group[keep], "block": frame.block[keep]})


def top_k(table: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vector: str = "embedding", vec_id: str = "vec_id",
          pivots: int = 16, sample: int = 1024, block: int = 1024, group: int = 256, slice_groups: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` is a condition on the id column. Pivots are drawn from a bounded
    ``sample``; they only shape the blocks, the search itself is exact and covers every row."""
    # Written out, so that row numbers stay the same in all later reads.
    rows = cut_lineage(quantised(table, vector, vec_id, scale))
    chosen: dict[int, np.ndarray] = {}
    drawn = rows.orderBy(F.xxhash64("uid"), "uid").limit(sample).select("dim", "v").toPandas()
    for dim, own in drawn.groupby("dim"):
        points = as_matrix(own.v).astype(np.float64)
        picked, away = [0], ((points - points[0]) ** 2).sum(1)
        while len(picked) < min(pivots, len(points)) and away.max() > 0:
            picked.append(int(away.argmax()))
            away = np.minimum(away, ((points - points[picked[-1]]) ** 2).sum(1))
        chosen[int(dim)] = points[picked]
    placed = cut_lineage(rows.mapInPandas(_near(chosen), "uid long, vec_id long, dim int, v array<long>, pivot int"))
    blocks = _blocks(placed, block)
    query = F.coalesce(is_query, F.lit(False))
    groups = _blocks(placed.where(query), group).select(F.col("id").alias("group"), "dim", "pivot", "sub", "centre", "radius", "packed")
    slices = max(1, -(-groups.count() // slice_groups))

    # First the blocks of the group's own pivot (one, where it has several), for thresholds.
    own = groups.select("group", "dim", "pivot").join(blocks.where("sub = 0").select("dim", "pivot", F.col("id").alias("block")), ["dim", "pivot"])
    first = cut_lineage(_search(own.select("group", "block"), groups.withColumn("kth", F.lit(None).cast("array<double>")), blocks, k, slices))
    known = cut_lineage(groups.groupBy("group").cogroup(first.groupBy("group")).applyInPandas(
        _kth(k), "group long, dim int, centre array<double>, radius double, packed binary, kth array<double>"))

    # Summaries of the stated query groups against all blocks' summaries; only promising pairs are shipped.
    left = known.select("group", "dim", F.col("centre").alias("q_centre"), F.col("radius").alias("q_radius"), F.array_min("kth").alias("worst"))
    pairs = left.join(blocks.select(F.col("id").alias("block"), "dim", "centre", "radius"), "dim").mapInPandas(_promising, "group long, block long")
    rest = pairs.join(own.select("group", "block"), ["group", "block"], "left_anti")
    hits = first.unionByName(_search(cut_lineage(rest), known, blocks, k, slices))
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.when(F.col("vec_id") < 2**63 - 1, F.col("vec_id")).alias("vec_id"), "score")
