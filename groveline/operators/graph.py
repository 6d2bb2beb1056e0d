"""Centroids, trees and typed edges; rankings over them. DataFrame functions, driver loops with bounded steps."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groveline.functions import vectors as V
from groveline.operators import similarity as S
from groveline.session import save, saved_rows, ship


def centroids(e: DataFrame, group: str) -> DataFrame:
    """group, c: the normalised mean of each group's vectors v. Sums per dimension combine before the shuffle."""
    m = e.select(group, F.posexplode("v").alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    c = m.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
    return c.select(group, V.l2_normalise(F.transform("s", lambda s: s["x"])).alias("c"))


def assign(e: DataFrame, cents: DataFrame) -> DataFrame:
    """``e`` with the nearest centroid (``cluster``, the smallest of equals) and ``sim``.

    The centroids, k rows of d numbers, travel as one array: k is a parameter and does not grow with the data.
    """
    key = cents.columns[0]
    all_ = cents.agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("cluster"), "c"))).alias("cs"))
    sims = F.transform("cs", lambda c: F.struct(F.round(V.dot(F.col("v"), c["c"]), 9).alias("r"), (-c["cluster"]).alias("o"), V.dot(F.col("v"), c["c"]).alias("sim")))
    return e.crossJoin(F.broadcast(all_)).withColumn("m", F.array_max(sims)).withColumns({"cluster": -F.col("m.o"), "sim": F.col("m.sim")}).drop("cs", "m")


def kmeans(e: DataFrame, k: int, steps: int = 50, tolerance: float = 1e-5) -> DataFrame:
    """Spherical k-means from farthest-first seeds: the smallest id, then the vector least like any seed so far."""
    spark = e.sparkSession
    e = save(e.select("vec_id", "v"), "kmeans")
    seeds = [e.orderBy("vec_id").first()["v"]] if not e.isEmpty() else []
    while seeds and len(seeds) < k:
        near = F.lit(-2.0)
        for s in seeds:
            near = F.greatest(near, V.dot(F.col("v"), F.array(*[F.lit(float(x)) for x in s])))
        nxt = e.withColumn("near", near).orderBy("near", "vec_id").first()
        if nxt["near"] > 1 - 1e-12:
            break
        seeds.append(nxt["v"])
    if not seeds:
        return e.select("vec_id", F.lit(0).alias("cluster"), F.lit(0.0).alias("sim"))
    cents, before = spark.createDataFrame([(i, list(s)) for i, s in enumerate(seeds)], "cluster int, c array<double>"), None
    for _ in range(steps):
        got = save(assign(e, cents), "kmeans")
        score = got.agg(F.sum("sim")).first()[0]
        if before is not None and abs(score - before) < tolerance:
            break
        before = score
        rows = centroids(got, "cluster").collect()  # k rows
        cents = spark.createDataFrame([(r["cluster"], r["c"]) for r in rows], "cluster int, c array<double>")
    return got


def label_tree(e: DataFrame) -> DataFrame:
    """node_id, level, parent_id, v: leaves, an abstract for each label, and the root."""
    leaf = e.select(F.concat(F.lit("leaf_"), F.col("vec_id").cast("string")).alias("node_id"), F.lit(0).alias("level"), F.concat(F.lit("L1_A"), F.col("label").cast("string")).alias("parent_id"), "v")
    mid = centroids(e, "label").select(F.concat(F.lit("L1_A"), F.col("label").cast("string")).alias("node_id"), F.lit(1).alias("level"), F.lit("ROOT").alias("parent_id"), F.col("c").alias("v"))
    root = centroids(e.withColumn("all", F.lit(0)), "all").select(F.lit("ROOT").alias("node_id"), F.lit(2).alias("level"), F.lit(None).cast("string").alias("parent_id"), F.col("c").alias("v"))
    return leaf.unionByName(mid).unionByName(root)


def undirected(edges: DataFrame, how) -> DataFrame:
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(how("weight").alias("weight"))


def passage_graph(*edges: DataFrame) -> DataFrame:
    """a, b, weight: neighbour, reading-order and shared-entity edges (a < b) summed for each pair."""
    parts = [e.select("a", "b", "weight") for e in edges]
    return reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def similarity_graph(tree: DataFrame, above: float) -> DataFrame:
    """src, dst, score: the pairs of tree nodes of any level with a cosine above ``above``."""
    e = S.neighbours(tree.select(F.col("node_id").alias("id"), "v"), None, above=above)
    return e.select(F.col("id").alias("src"), F.col("other").alias("dst"), "score")


def mirrored(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "weight").select("e.src", "e.dst", "weight")


def transition(edges: DataFrame) -> DataFrame:
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    return edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("p"))


#: Numbers of a group of queries that a task moves at once; in-edges of a node that are added slot by slot, the rest in one list.
MASS_CELLS, SLOTS = 1 << 21, 32


class _Moves:
    """Moves between ``n`` numbered nodes. A node's k-th in-edge is in slot k; nodes go by falling in-degree, so a slot's nodes are the first ones."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, p: np.ndarray, n: int):
        degree = np.bincount(dst, minlength=n)
        self.order = np.argsort(-degree, kind="stable").astype(np.int32)
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n, dtype=np.int32)
        src, dst = place[src], place[dst]
        by = np.argsort(dst, kind="stable")
        src, dst, p = src[by], dst[by], p[by]
        ends = np.cumsum(degree[self.order])
        slot = np.arange(len(dst)) - (ends - degree[self.order])[dst]
        self.place, self.least = place, p.min(initial=1.0)
        self.slots = [(src[on], p[on, None]) for on in (slot == k for k in range(min(SLOTS, degree.max(initial=0))))]
        tail = slot >= SLOTS
        self.tail = src[tail], dst[tail], p[tail, None]

    def step(self, mass: np.ndarray) -> np.ndarray:
        out = np.zeros_like(mass)
        for src, p in self.slots:
            x = mass[src]
            x *= p
            out[: len(src)] += x
        src, dst, p = self.tail
        width = max(1, MASS_CELLS // mass.shape[1])
        for a in range(0, len(src), width):  # edges by their end: each is named once in a part
            b = slice(a, a + width)
            first = np.flatnonzero(np.diff(dst[b], prepend=-1))
            out[dst[b][first]] += np.add.reduceat(mass[src[b]] * p[b], first, axis=0)
        return out


def personalised_pagerank(moves: DataFrame, seeds: DataFrame, damping: float, steps: int, top: int | None = None) -> DataFrame:
    """query_id, node_id, mass after ``steps`` moves; mass at a node without edges is lost. ``top``: only each query's best by the
    mass to 6 digits, ties to the smaller id.

    A task reads the moves from the shared folder and takes its queries group by group through all steps, so nothing is
    shuffled but seeds. It holds some 16 bytes a move, and ``MASS_CELLS`` numbers or one for each node.
    """
    spark = seeds.sparkSession
    ship(spark)
    moves, seeds = save(moves.select("src", "dst", "p"), "moves"), save(seeds.select("query_id", "node_id", "p"), "seeds")
    uri, kinds = moves._groveline_path, [seeds.schema[c].dataType.simpleString() for c in ("query_id", "node_id")]
    tasks = max(1, min(2 * spark.sparkContext.defaultParallelism, seeds.select("query_id").distinct().count()))

    def run(it):
        own = [b for b in it if b.num_rows]
        if not own:
            return
        own = pa.Table.from_batches(own)
        read = [[t[c].to_numpy() for t in saved_rows(uri, 1 << 20, ["src", "dst", "p"])] for c in ("src", "dst", "p")]
        src, dst, p = (np.concatenate(x) if x else np.zeros(0, own["node_id"].to_numpy().dtype) for x in read)
        nodes = np.unique(np.concatenate([src, dst, own["node_id"].to_numpy()]))
        numbered = lambda x: np.searchsorted(nodes, x).astype(np.int32)
        graph = _Moves(numbered(src), numbered(dst), p.astype(np.float64), len(nodes))
        del src, dst, p, read
        names, at = np.unique(own["query_id"].to_numpy(), return_inverse=True)
        node, seed = graph.place[numbered(own["node_id"].to_numpy())], own["p"].to_numpy()
        ids = nodes[graph.order]
        width = max(1, MASS_CELLS // len(nodes))
        # a node that is reached has mass, unless a share is 0 or so many small ones multiply to 0
        thin = (damping * graph.least) ** steps * seed.min() < 1e-300
        for a in range(0, len(names), width):
            on = (at >= a) & (at < a + width)
            mass = np.zeros((len(nodes), min(width, len(names) - a)))
            np.add.at(mass, (node[on], at[on] - a), seed[on])
            base, found = (1 - damping) * mass, None
            if thin:
                ones = np.zeros(mass.shape, bool)
                ones[node[on], at[on] - a] = True
                found, links = ones, _linked(graph)
            for _ in range(steps):
                mass = graph.step(mass)
                mass *= damping
                mass += base
                if thin:
                    found = ones | (links.step(found.astype(np.float64)) > 0)
            for q in range(mass.shape[1]):
                m = mass[:, q]
                i = np.flatnonzero(found[:, q] if thin else m)
                if top is not None:
                    r = np.round(m[i], 6)
                    if len(i) > top:
                        near = r >= np.partition(r, -top)[-top]
                        i, r = i[near], r[near]
                    i = i[np.lexsort((ids[i], -r))[:top]]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[a + q], len(i)), own["query_id"].type), pa.array(ids[i], own["node_id"].type), pa.array(m[i])], names=["query_id", "node_id", "mass"])

    dealt = seeds.withColumn("_task", F.pmod(F.xxhash64("query_id"), F.lit(tasks)).cast("int"))
    return dealt.repartitionById(tasks, "_task").mapInArrow(run, f"query_id {kinds[0]}, node_id {kinds[1]}, mass double")


def _linked(graph: _Moves) -> _Moves:
    """The same moves with a share of 1 each."""
    out = object.__new__(_Moves)
    out.slots = [(src, np.ones_like(p)) for src, p in graph.slots]
    out.tail = (*graph.tail[:2], np.ones_like(graph.tail[2]))
    return out


def beam_leaves(e: DataFrame, queries: DataFrame, width: int, top: int | None = None) -> DataFrame:
    """query_id, node_id, score of the leaves below each query's ``width`` best abstracts; with ``top`` only the best, with their rank."""
    abstracts = centroids(e, "label").select(F.col("label").alias("id"), F.col("c").alias("v"))
    best = S.nearest(queries.select("query_id", F.col("qv").alias("v")), abstracts, width, own=False)
    open_ = best.where("node_id IS NOT NULL").groupBy("query_id").agg(F.collect_list("node_id").alias("open"))
    asked = queries.select("query_id", F.col("qv").alias("v")).join(open_, "query_id")
    return S.nearest_open(asked, e.select(F.col("vec_id").alias("id"), F.col("label").alias("g"), "v"), top).drop("raw")


def gates(scores: DataFrame) -> DataFrame:
    """query_id, label, gate: each document's best score as a share of the query's best, 0 at least."""
    best = scores.groupBy("query_id", "label").agg(F.max("score").alias("best"))
    top = F.max("best").over(Window.partitionBy("query_id"))
    return best.select("query_id", "label", F.round(F.greatest(F.lit(0.0), "best") / F.when(top == 0, 1.0).otherwise(top), 6).alias("gate"))


def gated_pool(scores: DataFrame, k: int) -> DataFrame:
    """The leaves that can be among ``k`` diverse picks, with their gate: each query's ``k`` best and each document's best."""
    item = F.struct("score", (-F.col("node_id")).alias("o"))
    first = scores.groupBy("query_id", "label").agg(F.max(item).alias("m")).select("query_id", (-F.col("m.o")).alias("node_id"), "label", "m.score")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    top = scores.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("query_id", "node_id", "label", "score")
    pool, g = top.union(first).distinct(), gates(scores).withColumnsRenamed({"query_id": "_q", "label": "_l"})
    return pool.join(g, (F.col("query_id") == F.col("_q")) & F.col("label").eqNullSafe(F.col("_l"))).drop("_q", "_l")


def diverse(pool: DataFrame, k: int, bonus: float) -> DataFrame:
    """query_id, pick, node_id, label, adjusted: a document's best leaf earns the bonus, the others don't."""
    first = Window.partitionBy("query_id", "label").orderBy(F.desc("score"), "node_id")
    add = F.when(F.row_number().over(first) == 1, F.lit(bonus) * F.col("gate")).otherwise(0.0)
    p = pool.withColumn("adjusted", F.round(F.col("score") + add, 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("adjusted"), "node_id")
    return p.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k).select("query_id", "pick", "node_id", "label", "adjusted")


def mmr(queries: DataFrame, leaves: DataFrame, k: int, weight: float) -> DataFrame:
    """query_id, pick, node_id, score: greedy maximal marginal relevance over all ``leaves`` (node_id, v) but the query itself.

    Each of the ``k`` rounds is one maximum a query over blocks of leaves; the chosen, k - 1 vectors at most, travel with their query.
    """
    kind = "array<struct<node_id:bigint,score:double,v:array<double>>>"
    rows = save(leaves.select(F.col("node_id").cast("long").alias("id"), "v"), "leaves")
    now = save(queries.select("query_id", "qv", F.array().cast(kind).alias("chosen")), "mmr")
    for _ in range(k):
        taken = now.select("query_id", F.col("qv").alias("v"), F.transform("chosen", lambda y: y["node_id"]).alias("ids"), F.flatten(F.transform("chosen", lambda y: y["v"])).alias("others"))
        best = S.marginal(taken, rows, weight).groupBy("query_id").agg(F.max(F.struct("m", (-F.col("node_id")).alias("node_id"), "score", "v")).alias("b"))
        one = F.array(F.struct((-F.col("b.node_id")).alias("node_id"), "b.score", "b.v")).cast(kind)
        now = save(now.join(best.select("query_id", one.alias("one")), "query_id", "left").select("query_id", "qv", F.concat("chosen", F.coalesce("one", F.array().cast(kind))).alias("chosen")), "mmr")
    return now.select("query_id", F.posexplode("chosen").alias("pick", "x")).select("query_id", (F.col("pick") + 1).alias("pick"), "x.node_id", "x.score")
