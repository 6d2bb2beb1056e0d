"""Exact top-k by inner product with KD-trees, one for each shard of the vectors.

Vectors are dealt into shards by a hash of their id. A shard's tree is built by median splits on
the widest dimension down to leaves with tight bounding boxes. For a query, the greatest inner
product any point of a box can have is the sum over dimensions of max(q * low, q * high); leaves are
visited best bound first (a box bounds those inside it, so that is the order of a best-first descent) and a
query ends when no bound reaches the kth score known so far. The queries of a block go together: its best leaf,
the next, the next two, four and so on of each, so that a leaf is multiplied with all queries that want it at once.
The first wave searches one shard for every query; its kth scores go with the queries to all other
shards, so those prune from the start. Bounds equal to the kth score are still visited, since a tie
may go to a smaller id.

Cases: vectors that are null, empty, or hold null or non-finite components take no part, as query
or candidate; only vectors of one length meet; equal vectors and repeated rows are candidates each;
a query never meets rows with its own id; null ids take no part; with fewer than k candidates all are
returned; an empty table gives an empty one. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groveline.llm import common as C

LEAF = 128
SHARD_ROWS = 16_384
#: Queries a task holds at a time.
QUERY_BLOCK = 4096
_RESULT = "query_id long, vec_id long, score long"


class Tree:
    """Median splits down to leaves; ``lo`` and ``hi`` are the leaves' tight boxes. Arithmetic is exact in int64 (in float64 below 2**53)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.rows = ids[order], x[order], []
        self._split(np.arange(len(ids)), leaf)
        self.lo = np.stack([self.x[r].min(0) for r in self.rows])
        self.hi = np.stack([self.x[r].max(0) for r in self.rows])

    def _split(self, rows: np.ndarray, leaf: int) -> None:
        part = self.x[rows]
        spread = part.max(0) - part.min(0)
        d = int(np.argmax(spread))
        if len(rows) <= leaf or spread[d] == 0:
            self.rows.append(np.sort(rows))
            return
        o = np.argsort(part[:, d], kind="stable")
        half = len(rows) // 2
        self._split(rows[o[:half]], leaf)
        self._split(rows[o[half:]], leaf)

    def search(self, own: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
        """For each query the k best (ids, scores), ties to smaller ids, of rows whose score is not below its ``floor`` and
        whose id is not its ``own``; and how many leaves each looked into."""
        bound = np.maximum(q, 0) @ self.hi.T + np.minimum(q, 0) @ self.lo.T
        order, m, leaves = np.argsort(-bound, 1, kind="stable"), len(q), len(self.rows)
        kth, seen = floor.copy(), np.zeros(m, np.int64)
        best_id, best = [np.zeros(0, np.int64)] * m, [np.zeros(0, q.dtype)] * m
        a, b = 0, 1
        while a < leaves:
            now = order[:, a:b]
            asks, at = np.nonzero(np.take_along_axis(bound, now, 1) >= kth[:, None])
            if not len(asks):
                break
            leaf = now[asks, at]
            by = np.argsort(leaf, kind="stable")
            asks, leaf = asks[by], leaf[by]
            for own_asks in np.split(asks, np.flatnonzero(np.diff(leaf)) + 1):
                rows = self.rows[int(leaf[0])]
                leaf = leaf[len(own_asks) :]
                seen[own_asks] += 1
                ids, s = self.ids[rows], q[own_asks] @ self.x[rows].T
                hit = (s >= kth[own_asks][:, None]) & (ids[None] != own[own_asks][:, None])
                for i in np.flatnonzero(hit.any(1)):
                    j, h = own_asks[i], hit[i]
                    all_s, all_id = np.concatenate([best[j], s[i, h]]), np.concatenate([best_id[j], ids[h]])
                    if len(all_s) > k:
                        top = np.lexsort((all_id, -all_s))[:k]
                        all_s, all_id = all_s[top], all_id[top]
                    best[j], best_id[j] = all_s, all_id
                    if len(all_s) == k:
                        kth[j] = max(kth[j], all_s.min())
            a, b = b, min(2 * b, leaves)
        return best_id, best, seen


def quantise(df: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * x) of usable vectors."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(id_column).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return df.where(fine).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e)).alias("v"))


def _vectors(col, width: int) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), width)
    exact = float(np.abs(x).max(initial=0)) ** 2 * width < 2**52
    return x.astype(np.float64 if exact else np.int64)


def _searched(key, shard: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out = ([], [], [])
    if shard.num_rows and queries.num_rows:
        widths = np.asarray(pc.list_value_length(shard["v"]))
        q_widths = np.asarray(pc.list_value_length(queries["v"]))
        for w in np.unique(widths):
            part = shard.filter(pa.array(widths == w))
            tree = Tree(part["vec_id"].to_numpy(), _vectors(part["v"], w))
            mine = queries.filter(pa.array(q_widths == w))
            x = _vectors(mine["v"], w) if mine.num_rows else np.zeros((0, w))
            if tree.x.dtype != x.dtype:
                tree.x, tree.lo, tree.hi, x = (a.astype(np.int64) for a in (tree.x, tree.lo, tree.hi, x))
            if not len(x):
                continue
            none = np.iinfo(np.int64).min
            floor = mine["floor"].combine_chunks().fill_null(none).to_numpy(zero_copy_only=False)
            own = mine["query_id"].to_numpy()
            if x.dtype == np.float64:
                floor = np.where(floor == none, -np.inf, floor.astype(np.float64))
            ids, scores, _ = tree.search(own, x, k, floor)
            out[0].append(np.repeat(own, [len(i) for i in ids]))
            out[1].append(np.concatenate(ids))
            out[2].append(np.concatenate(scores).astype(np.int64))
    return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names=["query_id", "vec_id", "score"])


def top_k(df: DataFrame, k: int, every: int, id_column: str = "vec_id", vector: str = "embedding", scale: int = 64, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``, against all other rows."""
    spark = df.sparkSession
    C.ship(spark)
    base = C.save(quantise(df, id_column, vector, scale), "vectors")
    n = base.count()
    shards = max(1, -(-n // shard_rows))
    dealt = base.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    queries = base.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    queries = C.save(queries, "queries")  # a table of its own, so that its columns differ from the shards'

    def wave(q: DataFrame, first: bool) -> DataFrame:
        home = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(shards)).cast("int")
        if first:
            q = q.withColumn("shard", home).withColumn("floor", F.lit(None).cast("long"))
        else:
            q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
        # a (shard, block of queries) pair is one bounded task; each shard's rows go to its blocks
        rows = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        g = rows.select("shard", "block", "vec_id", "v").groupBy("shard", "block")
        return g.cogroup(q.select("shard", "block", "query_id", "v", "floor").groupBy("shard", "block")).applyInArrow(
            lambda key, a, b: _searched(key, a, b, k), _RESULT
        )

    def ranked(r: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    found = C.save(wave(queries, True), "first_wave")
    if shards > 1:
        kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        found = found.union(wave(queries.join(kth, "query_id", "left"), False))
    return ranked(found).select("query_id", "rank", "vec_id", "score")
