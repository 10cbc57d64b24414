"""Exact top-k by inner product: a ball tree per shard, branch and bound.

Components are turned into integers, floor(1024 x).  A shard's vectors form a
ball tree; a query visits its nodes in the order of the upper bound
q.c + |q| r and stops when no node left can beat its current k-th score (or tie
with a smaller id).  Every query first searches one shard of its own; the k-th
score found there is the bar with which it enters all other shards.

Vectors travel once per block of queries, queries once per shard.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UID, lean, runs, stage, with_uid

SCALE = 1024
SHARD_ROWS = 16_384
QUERY_BLOCK = 8_192
LEAF = 64
MAX_TASKS = 20_000


def scaled(embeddings: DataFrame) -> DataFrame:
    """(_uid, vec_id, v, dim) of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (with_uid(embeddings).where(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
            .select(UID, F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long"))
                    .alias("v"), F.size(x).alias("dim")))


def _number(v: np.ndarray) -> np.ndarray:
    """The type in which inner products are exact."""
    most = int(np.abs(v.astype(object)).max()) if v.size else 0
    if most * most * max(1, v.shape[1]) < 2**53:
        return v.astype(np.float64)
    return v.astype(object)


class BallTree:
    def __init__(self, v: np.ndarray, ids: np.ndarray, uids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.v, self.ids, self.uids = v[order], ids[order], uids[order]
        self.low = self.v.astype(np.float64)
        self.rows: list[np.ndarray] = []
        self.kids: list[tuple[int, int] | None] = []
        center, radius = [], []
        todo = [(np.arange(len(v)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            k = len(self.rows)
            if parent >= 0:
                self.kids[parent][side] = k
            p = self.low[rows]
            c = p.mean(axis=0) if len(rows) else np.zeros(v.shape[1])
            far = np.sqrt(((p - c) ** 2).sum(axis=1))
            center.append(c)
            radius.append(far.max() if len(rows) else 0.0)
            self.rows.append(rows)
            if len(rows) <= LEAF:
                self.kids.append(None)
                continue
            self.kids.append([0, 0])
            a = p[far.argmax()]
            b = p[((p - a) ** 2).sum(axis=1).argmax()]
            order = np.argsort(p @ (b - a), kind="stable")  # equal vectors are cut by id
            half = len(rows) // 2
            todo += [(np.sort(rows[order[:half]]), k, 0), (np.sort(rows[order[half:]]), k, 1)]
        self.center, self.radius = np.array(center), np.array(radius)
        self.first = np.array([self.ids[r[0]] if len(r) else 0 for r in self.rows])

    def search(self, q: np.ndarray, own: int, k: int, bar: int | None):
        """The best (score, id) of the shard but the row ``own``, at least as good as
        ``bar``."""
        f = q.astype(np.float64)
        bound = self.center @ f + np.sqrt(f @ f) * self.radius
        bound += 1e-9 * (np.abs(bound) + np.sqrt(f @ f) * (1 + np.abs(self.center).max(initial=0)))
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        heap = [(-bound[0], 0)]
        while heap:
            up, node = heapq.heappop(heap)
            if bar is not None and -up < bar:
                break
            if len(best) == k and (-up < best[0][0] or (
                    -up < best[0][0] + 1 and self.first[node] > -best[0][1])):
                continue
            kids = self.kids[node]
            if kids is not None:
                for kid in kids:
                    heapq.heappush(heap, (-bound[kid], kid))
                continue
            rows = self.rows[node]
            score = self.v[rows] @ q
            for s, i, u in zip(score.tolist(), self.ids[rows].tolist(), self.uids[rows].tolist(),
                               strict=True):
                s = int(s)
                if u == own or (bar is not None and s < bar):
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return [(s, -i) for s, i in best]


def _search(vectors: DataFrame, queries: DataFrame, k: int, tasks: int) -> DataFrame:
    """Both sides come with (dim, shard, block); a query's row follows the shard's vectors."""
    both = (vectors.select("dim", "shard", "block", F.lit(0).alias("side"), UID, "vec_id", "v",
                           F.lit(None).cast("long").alias("bar"))
            .union(queries.select("dim", "shard", "block", F.lit(1), UID, "vec_id", "v", "bar")))

    @lean
    def run(batches):
        for _, t in runs(batches, ["dim", "shard", "block"]):
            side = t.column("side").to_numpy()
            n = int((side == 0).sum())
            v = np.array(t.column("v").to_pylist(), dtype=np.int64).reshape(len(side), -1)
            ids = t.column("vec_id").to_numpy()
            v = _number(v)
            uids = t.column(UID).to_numpy()
            tree = BallTree(v[:n], ids[:n], uids[:n])
            out: list[list] = [[], [], [], []]
            for j in range(n, len(side)):
                bar = t.column("bar")[j].as_py()
                for s, i in tree.search(v[j], int(uids[j]), k, bar):
                    for col, x in zip(out, (t.column(UID)[j].as_py(), int(ids[j]), i,
                                            max(-2**63, min(2**63 - 1, s))), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                             names=["query", "query_id", "vec_id", "score"])

    key = ["dim", "shard", "block"]
    return (both.repartition(tasks, *key).sortWithinPartitions(*key, "side")
            .mapInArrow(run, "query long, query_id long, vec_id long, score long"))


def top_k(embeddings: DataFrame, is_query, k: int = 10, shard_rows: int = SHARD_ROWS,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` (a condition
    on vec_id) holds, against all rows but the query's own.

    Vectors that are null or hold nulls or non-finite numbers, and rows without
    vec_id, take no part; vectors of different lengths are not compared; a row
    that occurs twice is two candidates and two queries.  Ties go to the smaller
    vec_id; fewer than k candidates give all.
    """
    rows = stage(scaled(embeddings), "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(UID), F.lit(shards)).cast("int"))
    queries = rows.where(is_query)
    blocks = max(1, -(-queries.count() // query_block))
    queries = queries.withColumn(
        "block", F.pmod(F.xxhash64(F.lit("block"), UID), F.lit(blocks)).cast("int"))
    vectors = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tasks = min(MAX_TASKS, 2 * shards * blocks)  # a given number is not merged into fewer
    none = F.lit(None).cast("long").alias("bar")
    home = stage(_search(vectors, queries.select("*", none), k, tasks), "home")
    bars = (home.groupBy("query").agg(F.min("score").alias("bar"), F.count("*").alias("n"))
            .select(F.col("query").alias(UID), F.when(F.col("n") == k, F.col("bar")).alias("bar")))
    found = home
    if shards > 1:
        away = (queries.join(bars, UID, "left").withColumnRenamed("shard", "own")
                .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
                .where("shard <> own"))
        found = home.union(_search(vectors, away, k, tasks))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
