"""The tree over chunk vectors: spherical k-means level by level, extractive abstracts, a root, lateral edges.

Nodes are rows, children are an edge table. Only sizes and scores come to the driver; centroids stay a table
that meets the vectors block by block.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groveline.functions import vectors as V
from groveline.operators import similarity as S
from groveline.operators import text as T
from groveline.operators.encode import encode
from groveline.operators.graph import centroids
from groveline.session import save, ship

CENTROID_BLOCK = 4096
VECTOR_BLOCK = 2048
NODE = "node_id string, pos long, level int, text string, v array<double>, doc_id string, docs array<string>, chunk_index int, section string, keywords array<string>, child_count int, cohesion double"


def assign(e: DataFrame, cents: DataFrame, k: int, n: int) -> DataFrame:
    """id, cluster, sim: each vector's nearest centroid (the smallest of equals). ``e`` has id and v, ``cents`` cluster and c."""
    ship(e.sparkSession)
    i_of, j_of = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-k // CENTROID_BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = e.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(i_of)).cast("int").alias("i")).withColumn("j", every(j_of))
    right = cents.select("cluster", "c", F.pmod("cluster", F.lit(j_of)).cast("int").alias("j")).withColumn("i", every(i_of))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if a.num_rows and b.num_rows:
            b = b.sort_by("cluster")
            x, y = (np.asarray(t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(t.num_rows, -1) for t, c in ((a, "v"), (b, "c")))
            s = np.round(x @ y.T, 9)
            at = s.argmax(1)
            out = [a["id"].to_numpy(), b["cluster"].to_numpy()[at], s[np.arange(len(at)), at]]
        return pa.table([pa.array(c) for c in out], names=["id", "cluster", "sim"])

    got = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(lambda a, b: run(a, b), "id long, cluster long, sim double")
    best = got.groupBy("id").agg(F.max(F.struct("sim", (-F.col("cluster")).alias("o"))).alias("m"))
    return best.select("id", (-F.col("m.o")).alias("cluster"), "m.sim")


def seeds(e: DataFrame, k: int, n: int, seed: int, rounds: int = 4) -> DataFrame:
    """cluster, c: k vectors, each round drawn with chances in proportion to (1 - nearest cosine) squared.

    Drawing one by one needs k passes; here a first vector, then equal shares of the rest in ``rounds`` passes. A draw is a
    hash of the id, so a run repeats. Where all vectors sit on seeds, any unused one serves.
    """
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    have = save(e.orderBy(F.desc(u), "id").limit(1).select("id", "v"), "seeds")
    size = 1
    for r in range(rounds):
        if size >= min(k, n):
            break
        more = max(1, -(-(k - size) // (rounds - r)))
        near = assign(e, have.select(F.col("id").alias("cluster"), F.col("v").alias("c")), size, n)
        w = F.greatest(F.lit(0.0), 1 - F.col("sim"))
        w = F.greatest(w * w, F.lit(1e-12))
        drawn = near.withColumn("draw", F.log(u) / w).join(have.select("id"), "id", "left_anti").orderBy(F.desc("draw"), "id").limit(more).select("id")
        have = save(have.union(e.join(drawn, "id").select("id", "v")), "seeds")
        size = have.count()
    w = Window.orderBy("id")  # k rows of ids
    named = have.select("id").withColumn("cluster", (F.row_number().over(w) - 1).cast("long"))
    return save(have.join(named, "id").select("cluster", F.col("v").alias("c")), "seeds")


def kmeans(e: DataFrame, k: int, seed: int = 42, steps: int = 50, tolerance: float = 1e-5) -> tuple[DataFrame, DataFrame, dict]:
    """(id, cluster, sim), (cluster, c) and figures. A cluster that empties restarts at the vector that fits worst, each at another."""
    e = save(e.select("id", "v"), "kmeans")
    n = e.count()
    k = max(1, min(k, n))
    cents, before, took = seeds(e, k, n, seed), None, 0
    all_ = e.sparkSession.range(k).select(F.col("id").alias("cluster"))
    for took in range(1, steps + 1):
        got = save(assign(e, cents, k, n), "kmeans")
        score = got.agg(F.sum("sim")).first()[0] or 0.0
        if before is not None and abs(score - before) < tolerance:
            break
        before = score
        made = centroids(got.join(e, "id"), "cluster")
        gone = all_.join(got.select("cluster").distinct(), "cluster", "left_anti")
        lost = gone.count()
        if lost:
            worst = got.orderBy("sim", "id").limit(lost).withColumn("r", F.row_number().over(Window.orderBy("sim", "id")))
            gone = gone.withColumn("r", F.row_number().over(Window.orderBy("cluster")))
            made = made.select("cluster", "c").union(gone.join(worst.select("r", "id"), "r").join(e, "id").select("cluster", F.col("v").alias("c")))
        cents = save(made.select("cluster", "c"), "centroids")
    return got, cents, {"iterations": took, "cohesion": score / max(1, n), "inertia": n - score, "k": k}


def k_for(n: int, children: int, last: bool = False) -> int:
    """Clusters of a level: a ``children``-th of its nodes, and on the last level, below a root, at most ``children``."""
    k = math.ceil(n / max(2, children))
    return max(1, min(n, min(k, max(2, children)) if last else k))


def sentences(texts: DataFrame) -> DataFrame:
    """cluster, s, sentence: the sentences of each cluster's texts, joined by a space in the order of pos.

    A text's last piece ends a sentence only at a mark; else it goes on in the next text. Pieces are numbered by a
    running count of ends, so no cluster is gathered in a row.
    """
    pieces = F.split(F.col("text"), r"(?<=[.!?])\s+")
    p = texts.select("cluster", "pos", F.posexplode(pieces).alias("i", "piece"), F.size(pieces).alias("m"))
    end = ((F.col("i") < F.col("m") - 1) | F.col("piece").rlike(r"[.!?]$")).cast("int")
    w = Window.partitionBy("cluster").orderBy("pos", "i").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("s", F.coalesce(F.sum(end).over(w), F.lit(0)))
    whole = p.groupBy("cluster", "s").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "i", "piece"))), lambda x: x["piece"]), " ").alias("sentence"))
    return whole.select("cluster", "s", F.btrim("sentence", F.lit(T.BLANK)).alias("sentence")).where(F.length("sentence") > 25)


def abstracts(texts: DataFrame, cents: DataFrame | None, top: int = 3) -> DataFrame:
    """cluster, text: the ``top`` sentences nearest the centroid in reading order (the first ones without centroids);
    without sentences the first 400 characters."""
    s = sentences(texts)
    if cents is None:
        s = s.withColumn("score", F.lit(0.0))
    else:
        s = encode(s, "sentence").join(cents, "cluster").select("cluster", "s", "sentence", F.round(V.dot(F.col("v"), F.col("c")), 6).alias("score"))
    best = s.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "s"))).where(F.col("r") <= top)
    best = best.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "sentence"))), lambda x: x["sentence"]), " ").alias("best"))
    first = texts.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("pos"))).where("r <= 400")
    first = first.groupBy("cluster").agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " "), 1, 400).alias("first"))
    return first.join(best, "cluster", "left").select("cluster", F.coalesce("best", "first").alias("text"))


def leaves(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """A node for each chunk, in the order of document and chunk."""
    d = F.col(key).cast("string")
    n = chunks.select(F.col("chunk_id").alias("node_id"), F.col(key).cast("long").alias("k"), "chunk_index", "text", "section", d.alias("doc_id"), T.embedding_text(F.col("section"), F.col("text")).alias("e"))
    per = n.groupBy("k").agg(F.max("chunk_index").alias("m"))
    width = (per.agg(F.max("m")).first()[0] or 0) + 1
    n = encode(n.withColumn("pos", F.col("k") * width + F.col("chunk_index")), "e")
    return n.select("node_id", "pos", F.lit(0).alias("level"), "text", "v", "doc_id", F.array("doc_id").alias("docs"), "chunk_index", F.coalesce("section", F.lit("General")).alias("section"), F.array().cast("array<string>").alias("keywords"), F.lit(0).alias("child_count"), F.lit(None).cast("double").alias("cohesion"))


def _made(children: DataFrame, cents: DataFrame | None, level: int, first_pos: int) -> DataFrame:
    """Abstract nodes over ``children`` (a node's columns and cluster)."""
    texts = abstracts(children.select("cluster", "pos", "text"), cents)
    docs = children.select("cluster", "pos", F.posexplode("docs").alias("i", "d")).groupBy("cluster", "d").agg(F.min(F.struct("pos", "i")).alias("o"))
    docs = docs.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "d"))), lambda x: x["d"]).alias("docs"))
    words = T.keywords(children.select("cluster", "text"), "cluster").groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    size = children.groupBy("cluster").agg(F.count("*").cast("int").alias("child_count"), F.round(F.avg("sim"), 4).alias("cohesion"))
    n = encode(texts.join(docs, "cluster").join(words, "cluster", "left").join(size, "cluster"))
    name = F.concat(F.lit(f"L{level}_A"), F.col("cluster").cast("string"))
    return n.select("cluster", name.alias("node_id"), (F.lit(first_pos) + F.col("cluster")).alias("pos"), F.lit(level).alias("level"), "text", "v", F.lit(None).cast("string").alias("doc_id"), "docs", F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("string").alias("section"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "child_count", "cohesion")


_COLUMNS = [c.split(" ")[0] for c in NODE.split(", ")]


def build(chunks: DataFrame, key: str = "doc_id", max_levels: int = 3, children: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame, list[dict]]:
    """nodes, edges (parent_id, child_id) and figures a level. An empty table gives none; a single chunk is its own root.

    A cluster of one hands its child on unchanged; several tops get a ROOT with their first sentences; a single
    top above the leaves is called ROOT.
    """
    spark = chunks.sparkSession
    now = save(leaves(chunks, key), "leaves")
    parts, edges, stats = [now], [], []
    n, level, next_pos = now.count(), 0, (now.agg(F.max("pos")).first()[0] or 0) + 1
    while level < max_levels and n > 1:
        level += 1
        got, cents, figures = kmeans(now.select(F.col("pos").alias("id"), "v"), k_for(n, children, level == max_levels), seed + level)
        here = save(now.join(got.select(F.col("id").alias("pos"), "cluster", "sim"), "pos"), "clustered")
        many = here.groupBy("cluster").agg(F.count("*").alias("m"))
        grouped = here.join(many.where("m > 1").select("cluster"), "cluster", "left_semi")
        alone = here.join(many.where("m = 1").select("cluster"), "cluster", "left_semi")
        made = save(_made(grouped, cents, level, next_pos), "abstracts")
        edges.append(save(grouped.select("cluster", F.col("node_id").alias("child_id")).join(made.select("cluster", F.col("node_id").alias("parent_id")), "cluster").select("parent_id", "child_id"), "tree_edges"))
        parts.append(made.select(*_COLUMNS))
        promoted = alone.count()
        now = save(made.select(*_COLUMNS).union(alone.select(*_COLUMNS)), "level")
        stats.append({"level": level, "input_nodes": n, "clusters": now.count(), "promoted": promoted, "iterations": figures["iterations"], "cohesion": round(figures["cohesion"], 4), "inertia": round(figures["inertia"], 4), "cross_document": now.where(F.size("docs") > 1).count()})
        next_pos += figures["k"]
        n = stats[-1]["clusters"]
    nodes = reduce(DataFrame.union, parts)
    links = reduce(DataFrame.union, edges) if edges else spark.createDataFrame([], "parent_id string, child_id string")
    if n > 1:
        tops = now.withColumns({"cluster": F.lit(0).cast("long"), "sim": F.lit(None).cast("double")})
        high = now.agg(F.max("level")).first()[0] + 1
        root = _made(tops, None, high, next_pos).withColumn("node_id", F.lit("ROOT"))
        nodes, links = nodes.union(root.select(*_COLUMNS)), links.union(now.select(F.lit("ROOT"), "node_id"))
    elif n == 1:
        top = now.select("node_id", "level").first()
        if top["level"] > 0:
            renamed = lambda c: F.when(F.col(c) == top["node_id"], F.lit("ROOT")).otherwise(F.col(c)).alias(c)
            nodes = nodes.select(renamed("node_id"), *_COLUMNS[1:])
            links = links.select(renamed("parent_id"), "child_id")
    return save(nodes, "tree_nodes"), save(links, "tree_links"), stats


def lateral(nodes: DataFrame, edges: DataFrame, most: int = 3, alpha: float | None = None) -> DataFrame:
    """src, dst, score, relation: up to ``most`` nearest nodes of the level under another parent, with a cosine of alpha or more."""
    parent = nodes.join(edges.select(F.col("child_id").alias("node_id"), "parent_id"), "node_id", "left")
    all_ = save(parent.select(F.col("pos").alias("id"), F.xxhash64(F.coalesce("parent_id", "node_id")).alias("g"), "v", "level", "node_id", "docs"), "lateral")
    out = []
    for r in all_.groupBy("level").count().where("count > 1").collect():  # a row a level
        here = all_.where(F.col("level") == r["level"]).select("id", "g", "v")
        out.append(S.neighbours(here, most, S.moment_alpha(here) if alpha is None else alpha, other_group=True))
    if not out:
        return nodes.sparkSession.createDataFrame([], "src string, dst string, score double, relation string")
    side = lambda c, to: all_.select(F.col("id").alias(c), F.col("node_id").alias(to), F.col("docs").alias("d" + to))
    e = reduce(DataFrame.union, out).join(side("id", "src"), "id").join(side("other", "dst"), "other")
    apart = (F.size("dsrc") > 0) & (F.size("ddst") > 0) & ~F.arrays_overlap("dsrc", "ddst")
    return save(e.select("src", "dst", F.round("score", 4).alias("score"), F.when(apart, "cross_document").otherwise("cross_cluster").alias("relation")), "lateral_edges")
