"""Retrieval over a tree: beam descent, entity links, edge expansion, propagation, gated diversity; and simpler rankings.

All queries run at once: a step joins (query, node) rows with edges and scores what is new. ``queries`` has
query_id, text and v (a unit vector); scores are cosines rounded to 6 digits, ties go to the smaller pos.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groveline.functions import vectors as V
from groveline.operators import entities as E
from groveline.operators import graph as G
from groveline.operators import tree as R
from groveline.session import save


@dataclass
class Index:
    """Tables of a tree. ``near``: src, dst, w, kind (alpha, sequence), both ways; ``ents``: entity, node_id, idf; ``shared``: src, dst, w."""

    nodes: DataFrame
    edges: DataFrame
    near: DataFrame
    ents: DataFrame
    shared: DataFrame


def index(nodes: DataFrame, edges: DataFrame, alpha: DataFrame) -> Index:
    leaf = nodes.where("level = 0")
    one = alpha.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("score").alias("weight"))
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    nxt = leaf.where("chunk_index IS NOT NULL").select(F.col("node_id").alias("a"), "chunk_index", F.lead("node_id").over(w).alias("b"), F.lead("chunk_index").over(w).alias("n"))
    seq = nxt.where("n = chunk_index + 1").select("a", "b", F.lit(1.0).alias("weight"))
    near = G.mirrored(one).withColumn("kind", F.lit("alpha")).union(G.mirrored(seq).withColumn("kind", F.lit("sequence")))
    ents = E.entities(leaf.select("node_id", "text"), "node_id")
    post = save(E.postings(ents, leaf.count(), "node_id"), "entity_idf")
    ents = save(ents.join(post.select("entity", "idf"), "entity").select("entity", "node_id", "idf"), "entity_index")
    shared = save(G.mirrored(E.shared_weights(ents.select("entity", "node_id"), post, "node_id")), "shared_entities")
    return Index(nodes, edges, save(near.select("src", "dst", F.col("weight").alias("w"), "kind"), "near_edges"), ents, shared)


def _scored(pairs: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, node_id, pos, leaf, score of distinct (query_id, node_id)."""
    n = nodes.select("node_id", "pos", (F.col("level") == 0).alias("leaf"), F.col("v").alias("nv"))
    j = pairs.join(n, "node_id").join(queries.select("query_id", F.col("v").alias("qv")), "query_id")
    return j.select("query_id", "node_id", "pos", "leaf", F.round(V.dot(F.col("qv"), F.col("nv")), 6).alias("score"))


def _best(df: DataFrame, k: int | Column, score: str = "score", name: str = "rank") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "pos")
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def _roots(idx: Index) -> DataFrame:
    return idx.nodes.select("node_id").join(idx.edges.select(F.col("child_id").alias("node_id")), "node_id", "left_anti")


def descend(idx: Index, queries: DataFrame, beam: int, follow_alpha: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaves found (scored), all visited, and inner nodes that were scored.

    A level's inner nodes are scored only where more than ``beam`` stand open; an alpha edge leads to an inner node under another parent.
    """
    level = idx.nodes.select("node_id", (F.col("level") == 0).alias("leaf"))
    alpha = idx.near.where("kind = 'alpha'").select("src", "dst")
    pairs = queries.select("query_id").join(_roots(idx).hint("shuffle_replicate_nl"))
    first = save(_scored(pairs, queries, idx.nodes), "frontier")
    many = Window.partitionBy("query_id")

    def pruned(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        c = save(df.withColumn("open", F.count("*").over(many)), "open")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
        return c.withColumn("r", F.row_number().over(w)).where(f"open <= {beam} OR r <= {beam}").select("query_id", "node_id"), c.where(f"open > {beam}").select("query_id", "node_id")

    frontier, scored = pruned(first)
    visited, found, tried = save(frontier, "visited"), [], [scored]
    while not frontier.isEmpty():
        kids = frontier.join(idx.edges.select(F.col("parent_id").alias("node_id"), "child_id"), "node_id").select("query_id", F.col("child_id").alias("node_id")).distinct()
        kids = save(kids.join(visited, ["query_id", "node_id"], "left_anti").join(level, "node_id"), "kids")
        found.append(kids.where("leaf").select("query_id", "node_id"))
        inner = kids.where("NOT leaf").select("query_id", "node_id")
        visited = visited.union(kids.select("query_id", "node_id"))
        if follow_alpha:
            side = inner.join(alpha, inner["node_id"] == alpha["src"]).select("query_id", F.col("dst").alias("node_id")).distinct()
            side = side.join(level.where("NOT leaf"), "node_id").join(visited, ["query_id", "node_id"], "left_anti").select("query_id", "node_id")
            side = save(side, "lateral")
            inner, visited = inner.union(side), visited.union(side)
        frontier, scored = pruned(save(_scored(inner, queries, idx.nodes), "inner"))
        frontier, visited = save(frontier, "frontier"), save(visited, "visited")
        tried.append(scored)
    leaves = reduce(DataFrame.union, found) if found else visited.limit(0)
    return save(_scored(leaves, queries, idx.nodes), "leaf_pool"), visited, reduce(DataFrame.union, tried)


def linked(idx: Index, queries: DataFrame) -> DataFrame:
    """query_id, node_id: leaves of the entities that a query's text names."""
    e = E.entities(queries.select("query_id", "text"), "query_id", idx.nodes.where("level = 0"))
    return e.join(idx.ents.select("entity", "node_id"), "entity").select("query_id", "node_id").distinct()


def converged_pagerank(moves: DataFrame, personal: DataFrame, damping: float = 0.5, tolerance: float = 1e-9, most: int = 100, every: int = 10) -> DataFrame:
    """query_id, node_id, mass. ``moves``: query_id, src, dst, p; mass at a node without moves is lost. The change is looked at every few steps."""
    base = save(personal.select("query_id", "node_id", (F.lit(1 - damping) * F.col("p")).alias("m")), "personal")
    r = save(personal.select("query_id", "node_id", F.col("p").alias("mass")), "mass")
    moves = save(moves, "moves")
    for k in range(1, most + 1):
        before = r
        step = r.withColumnRenamed("node_id", "src").join(moves, ["query_id", "src"]).select("query_id", F.col("dst").alias("node_id"), (F.lit(damping) * F.col("mass") * F.col("p")).alias("m"))
        r = base.unionByName(step).groupBy("query_id", "node_id").agg(F.sum("m").alias("mass"))
        if k % every == 0:
            r = save(r, "mass")
            both = r.join(before.withColumnRenamed("mass", "old"), ["query_id", "node_id"], "full")
            change = both.groupBy("query_id").agg(F.sum(F.abs(F.coalesce("mass", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("c")).agg(F.max("c")).first()[0]
            if change is None or change < tolerance:
                break
    return r


def propagated(idx: Index, pool: DataFrame, link: DataFrame, damping: float, n_seeds: int, w_sequence: float, follow_alpha: bool, follow_sequence: bool) -> DataFrame:
    """``pool`` with mass, the propagated weight over each query's own subgraph, as a share of its largest."""
    g = [idx.shared.select("src", "dst", F.col("weight").alias("w"))]
    if follow_alpha:
        g.append(idx.near.where("kind = 'alpha'").select("src", "dst", "w"))
    if follow_sequence:
        g.append(idx.near.where("kind = 'sequence'").select("src", "dst", (F.col("w") * w_sequence).alias("w")))
    graph = save(reduce(DataFrame.union, g).groupBy("src", "dst").agg(F.sum("w").alias("w")), "graph")
    own = lambda c: pool.select("query_id", F.col("node_id").alias(c))
    part = own("src").join(graph, "src").join(own("dst"), ["query_id", "dst"])
    out = F.sum("w").over(Window.partitionBy("query_id", "src"))
    moves = part.select("query_id", "src", "dst", (F.col("w") / out).alias("p"))
    least = F.greatest("score", F.lit(1e-6))
    seeds = _best(pool, n_seeds).select("query_id", "node_id", least.alias("w"))
    more = pool.join(link, ["query_id", "node_id"], "left_semi").select("query_id", "node_id", least.alias("w"))
    s = seeds.union(more).groupBy("query_id", "node_id").agg(F.sum("w").alias("w"))
    personal = s.select("query_id", "node_id", (F.col("w") / F.sum("w").over(Window.partitionBy("query_id"))).alias("p"))
    mass = converged_pagerank(moves, personal, damping)
    j = pool.join(mass, ["query_id", "node_id"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    top = F.max("mass").over(Window.partitionBy("query_id"))
    return j.withColumn("mass", F.round(F.col("mass") / F.when(top == 0, 1.0).otherwise(top), 6))


def search(idx: Index, queries: DataFrame, k: int = 5, beam: int = 3, diversity: float = 0.15, follow_alpha: bool = True, follow_sequence: bool = True,
           entity_seeding: bool = True, propagate: bool = True, gate: bool = True, damping: float = 0.5, n_seeds: int = 3, w_sequence: float = 0.5) -> DataFrame:
    """query_id, rank, node_id, doc_id, score, nodes_scored: the whole retrieval."""
    pool, visited, inner = descend(idx, queries, beam, follow_alpha)
    link = queries.select("query_id").limit(0).withColumn("node_id", F.lit(""))
    if entity_seeding:
        link = save(linked(idx, queries), "linked")
        new = save(link.join(visited, ["query_id", "node_id"], "left_anti"), "linked_new")
        visited = visited.union(new)
        pool = pool.union(_scored(new, queries, idx.nodes))
    kinds = [x for x, on in (("alpha", follow_alpha), ("sequence", follow_sequence)) if on]
    if kinds:
        top = _best(pool, k).select("query_id", F.col("node_id").alias("src"))
        leaf = idx.nodes.where("level = 0").select("node_id")
        new = top.join(idx.near.where(F.col("kind").isin(kinds)), "src").select("query_id", F.col("dst").alias("node_id")).distinct()
        new = new.join(leaf, "node_id", "left_semi").join(visited, ["query_id", "node_id"], "left_anti")
        pool = pool.union(_scored(new.select("query_id", "node_id"), queries, idx.nodes))
    pool = save(pool, "pool")
    ranked = propagated(idx, pool, link, damping, n_seeds, w_sequence, follow_alpha, follow_sequence) if propagate else pool.withColumn("mass", F.col("score"))
    ranked = save(ranked.join(idx.nodes.select("node_id", "doc_id"), "node_id"), "ranked")
    return diverse(ranked, k, diversity, gate).join(_count(pool, inner), "query_id")


def _count(pool: DataFrame, inner: DataFrame) -> DataFrame:
    return pool.select("query_id", "node_id").union(inner.select("query_id", "node_id")).distinct().groupBy("query_id").agg(F.count("*").alias("nodes_scored"))


def diverse(ranked: DataFrame, k: int, bonus: float, gate: bool) -> DataFrame:
    """query_id, rank, node_id, doc_id, score: a document's best leaf earns the bonus, by its gate; a leaf without document always does."""
    per = Window.partitionBy("query_id", "doc_id")
    best = F.greatest(F.lit(0.0), F.max("mass").over(per))
    r = ranked.withColumn("b", best)
    top = F.max("b").over(Window.partitionBy("query_id"))
    weight = F.col("b") / F.when(top == 0, 1.0).otherwise(top) if gate else F.lit(1.0)
    first = F.col("doc_id").isNull() | (F.row_number().over(per.orderBy(F.desc("mass"), "pos")) == 1)
    r = r.withColumn("adjusted", F.round(F.col("mass") + F.when(first, F.lit(bonus) * weight).otherwise(0.0), 6))
    return _best(r, k, "adjusted").select("query_id", "rank", "node_id", "doc_id", F.col("mass").alias("score"))


def flat(idx: Index, queries: DataFrame, k: int, inner: bool = False, root: bool = True) -> DataFrame:
    """query_id, rank, node_id, score over all leaves, or with ``inner`` over all nodes."""
    n = idx.nodes if inner else idx.nodes.where("level = 0")
    n = n if root else n.where("node_id <> 'ROOT'")
    s = queries.select("query_id").join(n.select("node_id").hint("shuffle_replicate_nl"))
    return _best(_scored(s, queries, idx.nodes), k).select("query_id", "rank", "node_id", "score")


def top_down(idx: Index, queries: DataFrame, k: int, beam: int, score_roots: bool = True) -> DataFrame:
    """The first generation's descent: at each level the ``beam`` best children go on; the last leaves are the result."""
    pairs = queries.select("query_id").join(_roots(idx).hint("shuffle_replicate_nl"))
    now = _scored(pairs, queries, idx.nodes)
    now = save(_best(now, beam) if score_roots else now.withColumn("rank", F.lit(1)), "down")
    while not now.where("NOT leaf").isEmpty():
        kids = now.where("NOT leaf").select("query_id", F.col("node_id").alias("parent_id")).join(idx.edges, "parent_id").select("query_id", F.col("child_id").alias("node_id"))
        both = _scored(kids.union(now.where("leaf").select("query_id", "node_id")).distinct(), queries, idx.nodes)
        now = save(_best(both, beam), "down")
    return _best(now.drop("rank"), k).select("query_id", "rank", "node_id", "score")


def seed_and_neighbours(idx: Index, queries: DataFrame, k: int, similar: DataFrame) -> DataFrame:
    """The nearest node of all, then its neighbours in ``similar`` (src, dst) in the order of nodes."""
    seed = flat(idx, queries, 1, inner=True)
    n = idx.nodes.select("node_id", "pos")
    near = seed.select("query_id", F.col("node_id").alias("src")).join(similar, "src").select("query_id", F.col("dst").alias("node_id")).join(n, "node_id")
    w = Window.partitionBy("query_id").orderBy("pos")
    near = near.withColumn("rank", F.row_number().over(w) + 1).where(F.col("rank") <= k).select("query_id", "node_id", "rank")
    s = _scored(near.select("query_id", "node_id"), queries, idx.nodes).select("query_id", "node_id", "score")
    return seed.union(near.join(s, ["query_id", "node_id"]).select("query_id", "rank", "node_id", "score"))


def descent_and_neighbours(idx: Index, queries: DataFrame, k: int, similar: DataFrame) -> DataFrame:
    """The descent with beam ``k``; where it gives fewer than ``k``, neighbours of what it found fill up, in the order of nodes."""
    got = save(top_down(idx, queries, k, k, score_roots=False), "descent")
    n = idx.nodes.select("node_id", "pos")
    near = got.select("query_id", F.col("node_id").alias("src")).join(similar, "src").select("query_id", F.col("dst").alias("node_id")).distinct()
    near = near.join(got, ["query_id", "node_id"], "left_anti").join(n, "node_id").join(got.groupBy("query_id").agg(F.count("*").alias("have")), "query_id")
    near = near.withColumn("rank", (F.row_number().over(Window.partitionBy("query_id").orderBy("pos")) + F.col("have")).cast("int")).where(F.col("rank") <= k)
    s = _scored(near.select("query_id", "node_id"), queries, idx.nodes).select("query_id", "node_id", "score")
    return got.union(near.join(s, ["query_id", "node_id"]).select("query_id", "rank", "node_id", "score"))


def build_index(chunks: DataFrame, **how) -> tuple[Index, list[dict]]:
    nodes, edges, stats = R.build(chunks, **how)
    return index(nodes, edges, R.lateral(nodes, edges)), stats
