"""Exact top-k inner products with M-trees.

Vectors become integers floor(scale * x). Inner products are turned into distances by one more coordinate that makes all stored vectors equally long
(the longest vector's length, taken from the whole table), so the nearest vectors have the largest products. Spark deals the stored vectors to shards;
each task builds an M-tree of its shard: pages of at most `PAGE` vectors around a routing vector with covering radius, stored with their distance to the parent. Queries
come in blocks and are searched best first: nodes in order of their largest possible product; once a node cannot beat the k-th score the search ends;
leaf entries whose stored distance to the parent excludes them are not multiplied. The k best of each shard meet in one small merge per query.

Vectors that are null or hold null or non-finite components take no part, as query or candidate. Shorter vectors count as filled up with zeros.
Ties go to the smaller vec_id. Null ids take no part. Rows that share an id ask together: the best of both are returned. A row is no candidate for queries with its own id.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.common import cut_lineage

SCALE, TOP, PAGE, SHARD, BLOCK = 1024, 10, 128, 16384, 2048
EXACT = float(1 << 53)


def finite(column: str):
    return F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


class MTree:
    """Two levels of metric pages over the rows of `x`; the last coordinate makes all rows equally long."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float, page: int = PAGE):
        self.ids, self.x = ids, x
        x = x.astype(np.float64)
        space = np.column_stack((x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))))
        self.pages: list[np.ndarray] = []
        self.routing, self.radius, self.parent_distance = [], [], []
        self.leaf_distance: list[np.ndarray] = []
        root = space.mean(axis=0) if len(space) else np.zeros(x.shape[1] + 1)
        stack = [np.arange(len(x))]
        while stack:
            rows = stack.pop()
            if len(rows) > page:  # split: two far rows promote themselves, the rest follow the nearer one
                own = space[rows]
                a = int(np.argmax(((own - own[0]) ** 2).sum(axis=1)))
                gap = ((own - own[a]) ** 2).sum(axis=1)
                b = int(np.argmax(gap))
                score = gap - ((own - own[b]) ** 2).sum(axis=1)
                half = np.argpartition(score, len(rows) // 2)  # balanced, so equal rows split too
                stack += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
                continue
            if not len(rows):
                continue
            centre = space[rows].mean(axis=0)
            distance = np.sqrt(((space[rows] - centre) ** 2).sum(axis=1))
            by = np.argsort(distance)
            self.pages.append(rows[by])
            self.leaf_distance.append(distance[by])
            self.routing.append(centre)
            self.radius.append(distance.max())
            self.parent_distance.append(np.sqrt(((centre - root) ** 2).sum()))
        self.root = root
        self.routing, self.radius, self.parent_distance = np.array(self.routing).reshape(-1, x.shape[1] + 1), np.array(self.radius), np.array(self.parent_distance)
        self.longest = longest
        self.slack = 1e-6 * max(1.0, np.sqrt(longest))

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(query id, [(score, vec_id)]) for each query, best first."""
        real = queries.astype(np.float64)
        points, lengths = np.column_stack((real, np.zeros(len(real)))), (real * real).sum(axis=1)
        for q, q_id, length, exact in zip(points, query_ids.tolist(), lengths.tolist(), queries, strict=True):
            to_root = np.sqrt(((self.root - q) ** 2).sum())
            least = np.maximum(np.abs(to_root - self.parent_distance) - self.radius, 0) - self.slack  # without a distance of its own
            order, best, limit = np.argsort(least), [], np.inf
            queue: list[tuple[float, int, float]] = []
            at = 0
            while True:
                while at < len(order) and (not queue or least[order[at]] <= queue[0][0]):
                    some = order[at : at + 32]
                    at += len(some)
                    for n, d in zip(some.tolist(), np.sqrt(((self.routing[some] - q) ** 2).sum(axis=1)).tolist(), strict=True):
                        heapq.heappush(queue, (max(d - self.radius[n], 0.0) - self.slack, n, d))
                if not queue:
                    break
                low, n, d = heapq.heappop(queue)
                if low > limit:
                    break
                rows = self.pages[n]
                if limit < np.inf:  # |d(q, parent) - d(row, parent)| bounds the distance of each row
                    a, b = np.searchsorted(self.leaf_distance[n], (d - limit - self.slack, d + limit + self.slack))
                    rows = rows[a:b]
                if not len(rows):
                    continue
                scores = (self.x[rows] * exact).sum(axis=1) if self.x.dtype == np.int64 else self.x[rows] @ exact
                ids = self.ids[rows]
                for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                    if i != q_id and (len(best) < k or (s, -i) > best[0]):
                        (heapq.heappushpop if len(best) == k else heapq.heappush)(best, (s, -i))
                if len(best) == k:  # |q - x|^2 = |q|^2 + longest - 2 q.x
                    limit = np.sqrt(max(length + self.longest - 2 * best[0][0], 0)) + self.slack
            yield q_id, [(int(s), -i) for s, i in sorted(best, reverse=True)]


def top_products(vectors: DataFrame, queries: DataFrame, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score. Both tables have vec_id and embedding."""

    def whole(df: DataFrame) -> DataFrame:
        return df.where(F.col("vec_id").isNotNull() & finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("x"))

    stored, asked = cut_lineage(whole(vectors)), cut_lineage(whole(queries))
    norm = F.aggregate("x", F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double"))
    n, width, longest, biggest = stored.agg(F.count("*"), F.max(F.size("x")), F.max(norm), F.max(F.array_max(F.transform("x", F.abs)))).first()
    width, longest = max(width or 0, asked.agg(F.max(F.size("x"))).first()[0] or 0), float(longest or 0)
    reach = asked.agg(F.max(norm)).first()[0] or 0.0
    floats = max(longest, reach) < EXACT / 4 and (biggest or 0) < EXACT  # then products of doubles are exact
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asked.count() // BLOCK))

    def packed(df: DataFrame, column: str, count: int) -> DataFrame:
        return df.withColumn(column, F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))

    def pad(column) -> np.ndarray:
        out = np.zeros((len(column), width), np.int64)
        for i, v in enumerate(column.to_pylist()):
            out[i, : len(v)] = v
        return out

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own, asks = left.column("vec_id").to_numpy(), pad(left.column("x")), pad(right.column("x"))
        if floats:
            own, asks = own.astype(np.float64), asks.astype(np.float64)
        out: list[tuple[int, int, int]] = []
        for q, hits in MTree(ids, own, longest).search(asks, right.column("vec_id").to_numpy(), k):
            out += [(q, i, s) for s, i in hits]
        columns = zip(*out, strict=True) if out else ((), (), ())
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    # every shard meets every block of queries; a query row is copied once per shard
    dealt = packed(stored, "shard", shards).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    copies = packed(asked, "block", blocks).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = dealt.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block")).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
