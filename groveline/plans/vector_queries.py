"""Queries over ``embeddings``: scores, clusters with ``label`` as the document of a leaf, edges, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groveline.functions import vectors as V
from groveline.operators import graph as G
from groveline.operators import similarity as S
from groveline.plans import registry
from groveline.plans.registry import query


def _emb(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", V.l2_normalise(V.as_double(F.col("embedding"))).alias("v"))


def _ids(e: DataFrame) -> DataFrame:
    return e.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("g"), "v")


def _asked(e: DataFrame) -> DataFrame:
    """The stated queries: rows whose id is divisible by 100."""
    return e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "v")


def _nearest(spark: SparkSession, sf: str, k: int | None) -> DataFrame:
    """The ``k`` best leaves (all, if None) of the stated queries but their own, by products of blocks."""
    e = _ids(_emb(spark, sf))
    return S.nearest(_asked(e), e, k)


def _pool(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """The stated queries' ``k`` best leaves and each label's best."""
    e = _ids(_emb(spark, sf))
    return S.pooled(_asked(e), e, k)


N = "n AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) v FROM embeddings)"
SC = N + ", s AS (SELECT q.vec_id query_id, d.vec_id node_id, d.label, round(list_dot_product(q.v, d.v), 6) score FROM n q, n d WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id)"
_RANK = ', r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INT "rank" FROM s)'
PAIRS = N + ", p AS (SELECT a.vec_id id, b.vec_id other, a.label la, b.label lb, round(list_dot_product(a.v, b.v), 6) score, list_dot_product(a.v, b.v) raw FROM n a, n b WHERE a.vec_id <> b.vec_id)"


@query("r1_flat_topk", f'WITH {SC}{_RANK} SELECT query_id, "rank", node_id, score FROM r WHERE "rank" <= 5')
def r1(spark, sf):
    return _nearest(spark, sf, 5).select("query_id", "rank", "node_id", "score")


@query("r5_min_score", f'WITH {SC}{_RANK} SELECT query_id, "rank", node_id, score FROM r WHERE "rank" <= 5 AND score >= 0.3')
def r5(spark, sf):
    return _nearest(spark, sf, 5).where("score >= 0.3").select("query_id", "rank", "node_id", "score")


@query("r18_first_generation_flat", f'WITH {SC}{_RANK} SELECT query_id, "rank", node_id, score FROM r WHERE "rank" <= 3')
def r18(spark, sf):
    return _nearest(spark, sf, 3).select("query_id", "rank", "node_id", "score")


@query("v4_normalise", f"WITH {N} SELECT vec_id, unnest(range(0, len(v)))::INT AS dim, unnest(list_transform(v, lambda x: round(x, 6))) AS value FROM n")
def v4(spark, sf):
    return _emb(spark, sf).select("vec_id", F.posexplode("v").alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("value"))


@query("v5_encode_cache", "SELECT count(*) AS texts, count(DISTINCT md5(coalesce(text, ''))) AS misses, count(*) - count(DISTINCT md5(coalesce(text, ''))) AS hits FROM documents")
def v5(spark, sf):
    """Texts are encoded once a hash: how many encodings a cache saves."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    n = d.agg(F.count("*").alias("texts"), F.countDistinct("h").alias("misses"))
    return n.select("texts", "misses", (F.col("texts") - F.col("misses")).alias("hits"))


@query("v6_cosine", f"WITH {SC} SELECT query_id, node_id, score FROM s")
def v6(spark, sf):
    return _nearest(spark, sf, None).select("query_id", "node_id", "score")


@query("v7_similarity_rows", f"WITH {PAIRS} SELECT id AS vec_id, count(*) AS n, round(max(raw), 6) AS best, round(avg(raw), 6) AS mean FROM p GROUP BY id")
def v7(spark, sf):
    st = S.pair_statistics(_ids(_emb(spark, sf)))
    return st.select(F.col("id").alias("vec_id"), "n", F.round("best", 6).alias("best"), F.round(F.col("total") / F.col("n"), 6).alias("mean"))


@query(
    "v9_score_statistics",
    f"WITH {SC} SELECT query_id, max(score) AS top, min(score) AS low, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS dev, round(list_reverse_sort(list(score))[1] - list_reverse_sort(list(score))[2], 6) AS margin FROM s GROUP BY query_id",
)
def v9(spark, sf):
    e = _ids(_emb(spark, sf))
    mean, top = F.col("total") / F.col("n"), F.element_at("tops", 1)
    dev = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - mean * mean))
    st = S.query_statistics(_asked(e), e)
    return st.select("query_id", top.alias("top"), "low", F.round(mean, 6).alias("mean"), F.round(dev, 6).alias("dev"), F.round(top - F.try_element_at("tops", F.lit(2)), 6).alias("margin"))


# Clusters: label stands for the cluster of a leaf
_CENT = """, x AS (SELECT label, unnest(range(0, len(v))) AS i, unnest(v) AS e FROM n),
m AS (SELECT label, i, avg(e) AS e FROM x GROUP BY ALL),
cl AS (SELECT label, sqrt(sum(e * e)) AS l FROM m GROUP BY label),
c AS (SELECT m.label, list(e / CASE WHEN l = 0 THEN 1e-9 ELSE l END ORDER BY i) AS c FROM m JOIN cl ON cl.label = m.label GROUP BY m.label)"""


@query("c3_centroid_update", f"WITH {N}{_CENT} SELECT label, unnest(range(0, len(c)))::INT AS dim, unnest(list_transform(c, lambda x: round(x, 6))) AS value FROM c")
def c3(spark, sf):
    return G.centroids(_emb(spark, sf), "label").select("label", F.posexplode("c").alias("dim", "x")).select("label", "dim", F.round("x", 6).alias("value"))


_ASSIGN = _CENT + ", a AS (SELECT n.vec_id, n.label, c.label AS cluster, list_dot_product(n.v, c.c) AS sim FROM n, c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, cluster) AS r FROM a)"


def _assigned(spark, sf):
    """vec_id, cluster, sim: the centroids meet the vectors in blocks."""
    e = _emb(spark, sf)
    c = G.centroids(e, "label").select(F.col("label").alias("id"), F.col("c").alias("v"))
    a = S.nearest(e.select(F.col("vec_id").alias("query_id"), "v"), c, 1, own=False, digits=9)
    return a.select(F.col("query_id").alias("vec_id"), F.col("node_id").alias("cluster"), F.col("raw").alias("sim"))


@query("c2_assign", f"WITH {N}{_ASSIGN} SELECT vec_id, cluster, round(sim, 6) AS sim FROM b WHERE r = 1")
def c2(spark, sf):
    return _assigned(spark, sf).select("vec_id", "cluster", F.round("sim", 6).alias("sim"))


@query("c6_cohesion", f"WITH {N}{_ASSIGN} SELECT cluster, count(*) AS members, round(avg(sim), 6) AS cohesion, round(sum(1 - sim), 6) AS inertia FROM b WHERE r = 1 GROUP BY cluster")
def c6(spark, sf):
    a = _assigned(spark, sf)
    return a.groupBy("cluster").agg(F.count("*").alias("members"), F.round(F.avg("sim"), 6).alias("cohesion"), F.round(F.sum(1 - F.col("sim")), 6).alias("inertia"))


@query("c8_round_robin", "SELECT vec_id, label, ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 4)::INT AS cluster FROM embeddings")
def c8(spark, sf):
    w = Window.partitionBy("label").orderBy("vec_id")
    return _emb(spark, sf).select("vec_id", "label", F.pmod(F.row_number().over(w) - 1, F.lit(4)).cast("int").alias("cluster"))


@query("c9_adaptive_k", "SELECT label, count(*) AS n, greatest(1, least(count(*), ceil(count(*) / 4.0)))::INT AS k FROM embeddings GROUP BY label")
def c9(spark, sf):
    k = F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.col("n") / 4.0)))
    return _emb(spark, sf).groupBy("label").agg(F.count("*").alias("n")).select("label", "n", k.cast("int").alias("k"))


@query("c7_kmeans")
def c7(spark, sf):
    """Spherical k-means from farthest-first seeds over all vectors."""
    return G.kmeans(_emb(spark, sf), 8).select("vec_id", "cluster", F.round("sim", 6).alias("sim"))


_ALPHA = "al AS (SELECT least(0.9, greatest(0.35, round(avg(raw) + stddev_pop(raw), 6))) AS alpha FROM p)"


@query("c20_auto_alpha", f"WITH {PAIRS}, {_ALPHA} SELECT alpha FROM al")
def c20(spark, sf):
    return spark.createDataFrame([(S.moment_alpha(_emb(spark, sf)),)], "alpha double")


_EDGES = f"{PAIRS}, {_ALPHA}, er AS (SELECT id, other, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, other)::INT \"rank\" FROM p, al WHERE la <> lb AND score >= alpha), ed AS (SELECT * FROM er WHERE \"rank\" <= 3)"


def _alpha_edges(spark, sf):
    e = _ids(_emb(spark, sf))
    return S.neighbours(e, 3, S.moment_alpha(e), other_group=True)


@query("c21_alpha_edges", f"WITH {_EDGES} SELECT id AS src, other AS dst, round(score, 4) AS score, 'cross_document' AS relation FROM ed")
def c21(spark, sf):
    return _alpha_edges(spark, sf).select(F.col("id").alias("src"), F.col("other").alias("dst"), F.round("score", 4).alias("score"), F.lit("cross_document").alias("relation"))


@query("g7_undirected", f"WITH {_EDGES} SELECT least(id, other) AS a, greatest(id, other) AS b, max(score) AS score FROM ed GROUP BY ALL")
def g7(spark, sf):
    return G.undirected(_alpha_edges(spark, sf).select(F.col("id").alias("src"), F.col("other").alias("dst"), F.col("score").alias("weight")), F.max).withColumnRenamed("weight", "score")


_SEQ = "o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings), sq AS (SELECT x.vec_id AS a, y.vec_id AS b FROM o x JOIN o y ON x.label = y.label AND y.i = x.i + 1)"


def _sequence(spark, sf):
    w = Window.partitionBy("label").orderBy("vec_id")
    return _emb(spark, sf).select(F.col("vec_id").alias("a"), F.lead("vec_id").over(w).alias("b")).where("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


@query("g6_reading_order", f"WITH {_SEQ} SELECT least(a, b) AS a, greatest(a, b) AS b FROM sq")
def g6(spark, sf):
    return _sequence(spark, sf)


_KNN = f"{PAIRS}, kr AS (SELECT id, other, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS r FROM p WHERE score >= 0.45), kn AS (SELECT least(id, other) AS a, greatest(id, other) AS b, sum(score) AS w FROM kr WHERE r <= 4 GROUP BY ALL)"


def _knn(spark, sf):
    k = S.neighbours(_ids(_emb(spark, sf)), 4, 0.45)
    return G.undirected(k.select(F.col("id").alias("src"), F.col("other").alias("dst"), F.col("score").alias("weight")), F.sum)


@query("g9_knn_edges", f"WITH {_KNN} SELECT a, b, round(w, 6) AS weight FROM kn")
def g9(spark, sf):
    return _knn(spark, sf).select("a", "b", F.round("weight", 6).alias("weight"))


_PASS = f"{_KNN}, {_SEQ}, g AS (SELECT a, b, sum(w) AS w FROM (SELECT a, b, w FROM kn UNION ALL SELECT least(a, b), greatest(a, b), 0.5 FROM sq) GROUP BY ALL), dg AS (SELECT a AS src, b AS dst, w FROM g UNION ALL SELECT b, a, w FROM g), t AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM dg)"


def _passages(spark, sf):
    """Without entity edges: ``embeddings`` has no texts to take entities from."""
    return G.passage_graph(_knn(spark, sf), _sequence(spark, sf).withColumn("weight", F.lit(0.5)))


@query("g10_passage_graph", f"WITH {_PASS} SELECT a, b, round(w, 6) AS weight FROM g")
def g10(spark, sf):
    return _passages(spark, sf).select("a", "b", F.round("weight", 6).alias("weight"))


@query("g8_symmetric", f"WITH {_PASS} SELECT src, dst, round(w, 6) AS weight FROM dg")
def g8(spark, sf):
    return G.mirrored(_passages(spark, sf)).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("g11_transition", f"WITH {_PASS} SELECT src, dst, round(p, 6) AS p FROM t")
def g11(spark, sf):
    return G.transition(G.mirrored(_passages(spark, sf))).select("src", "dst", F.round("p", 6).alias("p"))


_TREE = f"{N}{_CENT}, rx AS (SELECT i, avg(e) AS e FROM x GROUP BY i), nodes AS (SELECT 'leaf_' || vec_id AS node_id, 0 AS level, v FROM n UNION ALL SELECT 'L1_A' || label, 1, c FROM c UNION ALL SELECT 'ROOT', 2, (SELECT list(e / (SELECT sqrt(sum(e * e)) FROM rx) ORDER BY i) FROM rx))"


@query("g12_similarity_graph", f"WITH {_TREE} SELECT a.node_id AS src, b.node_id AS dst, round(list_dot_product(a.v, b.v), 6) AS score FROM nodes a, nodes b WHERE a.node_id <> b.node_id AND list_dot_product(a.v, b.v) > 0.3")
def g12(spark, sf):
    """All tree nodes with a cosine above 0.3."""
    return G.similarity_graph(G.label_tree(_emb(spark, sf)), 0.3)


_PPR = (
    f"{_PASS}, s AS (SELECT q.vec_id query_id, d.vec_id node_id, round(list_dot_product(q.v, d.v), 6) score FROM n q, n d WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id)"
    ", sd AS (SELECT query_id, node_id, greatest(score, 1e-6) AS w, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM s)"
    ", ps AS (SELECT query_id, node_id, w / sum(w) OVER (PARTITION BY query_id) AS p FROM sd WHERE r <= 3)"
)


def _ppr_sql(steps: int) -> str:
    out = [", r0 AS (SELECT query_id, node_id, p AS m FROM ps)"]
    for k in range(1, steps + 1):
        out.append(
            f", r{k} AS MATERIALIZED (SELECT query_id, node_id, sum(m) AS m FROM (SELECT query_id, node_id, 0.5 * p AS m FROM ps UNION ALL SELECT r.query_id, t.dst, 0.5 * r.m * t.p FROM r{k - 1} r JOIN t ON t.src = r.node_id) GROUP BY ALL)"
        )
    return "".join(out)


def _ppr(spark, sf, steps: int, best: int | None = None):
    top = _nearest(spark, sf, 3).select("query_id", "node_id", F.greatest("score", F.lit(1e-6)).alias("w"))
    seeds = top.select("query_id", "node_id", (F.col("w") / F.sum("w").over(Window.partitionBy("query_id"))).alias("p"))
    return G.personalised_pagerank(G.transition(G.mirrored(_passages(spark, sf))), seeds, 0.5, steps, best)


@query("g13_pagerank_steps", f"WITH {_PPR}{_ppr_sql(30)} SELECT query_id, node_id, round(m, 6) AS mass FROM r30")
def g13(spark, sf):
    """30 fixed steps."""
    return _ppr(spark, sf, 30).select("query_id", "node_id", F.round("mass", 6).alias("mass"))


@query("r7_graph_retrieval", f'WITH {_PPR}{_ppr_sql(30)}, k AS (SELECT query_id, node_id, round(m, 6) AS mass, row_number() OVER (PARTITION BY query_id ORDER BY round(m, 6) DESC, node_id)::INT AS "rank" FROM r30) SELECT query_id, "rank", node_id, mass FROM k WHERE "rank" <= 5')
def r7(spark, sf):
    m = _ppr(spark, sf, 30, 5).select("query_id", "node_id", F.round("mass", 6).alias("mass"))
    w = Window.partitionBy("query_id").orderBy(F.desc("mass"), "node_id")
    return m.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query_id", "rank", "node_id", "mass")


@query("c22_level_counts", "SELECT 0 AS level, count(*) AS nodes FROM embeddings UNION ALL SELECT 1, count(DISTINCT label) FROM embeddings UNION ALL SELECT 2, 1")
def c22(spark, sf):
    return G.label_tree(_emb(spark, sf)).groupBy("level").agg(F.count("*").alias("nodes"))


@query(
    "r6_collapsed_tree",
    f"""WITH {_TREE}, s AS (SELECT q.vec_id AS query_id, t.node_id, round(list_dot_product(q.v, t.v), 6) AS score FROM n q, nodes t WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INT AS "rank" FROM s) SELECT query_id, "rank", node_id, score FROM r WHERE "rank" <= 5""",
)
def r6(spark, sf):
    e = _emb(spark, sf)
    nodes = G.label_tree(e).select(F.col("node_id").alias("id"), "v")
    return S.nearest(_asked(_ids(e)), nodes, 5, own=False).select("query_id", "rank", "node_id", "score")


@query(
    "r8_beam_descent",
    f"""WITH {N}{_CENT}, s AS (SELECT q.vec_id AS query_id, c.label, round(list_dot_product(q.v, c.c), 6) AS score FROM n q, c WHERE q.vec_id % 100 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS r FROM s),
l AS (SELECT q.vec_id AS query_id, d.vec_id AS node_id, round(list_dot_product(q.v, d.v), 6) AS score FROM f JOIN n q ON q.vec_id = f.query_id JOIN n d ON d.label = f.label WHERE f.r <= 3 AND d.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INT AS "rank" FROM l) SELECT query_id, "rank", node_id, score FROM k WHERE "rank" <= 5""",
)
def r8(spark, sf):
    """Each query scores the abstracts, keeps the best three, and scores only their leaves."""
    e = _emb(spark, sf)
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    return G.beam_leaves(e, q, 3, 5).select("query_id", "rank", "node_id", "score")


_GATE = f"{SC}, gt AS (SELECT *, round(greatest(0, max(score) OVER (PARTITION BY query_id, label)) / max(score) OVER (PARTITION BY query_id), 6) AS gate, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, node_id) AS dr FROM s)"


@query("r12_relevance_gate", f"WITH {_GATE} SELECT DISTINCT query_id, label, gate FROM gt")
def r12(spark, sf):
    return G.gates(_pool(spark, sf, 0))


@query(
    "r13_diversity",
    f"""WITH {_GATE}, ad AS (SELECT *, round(score + CASE WHEN dr = 1 THEN 0.15 * gate ELSE 0 END, 6) AS adjusted FROM gt),
k AS (SELECT query_id, node_id, label, adjusted, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, node_id)::INT AS pick FROM ad) SELECT query_id, pick, node_id, label, adjusted FROM k WHERE pick <= 5""",
)
def r13(spark, sf):
    return G.diverse(G.gated_pool(_pool(spark, sf, 5), 5), 5, 0.15)


@query("r4_mmr")
def r4(spark, sf):
    """Maximal marginal relevance over all leaves."""
    e = _emb(spark, sf)
    return G.mmr(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), e.select(F.col("vec_id").alias("node_id"), "v"), 5, 0.7)


def _r24_sql() -> str:
    of = registry.own_sql()
    parts = [("flat", "r1_flat_topk", "score"), ("flat_min", "r5_min_score", "score"), ("graph", "r7_graph_retrieval", "mass"), ("beam", "r8_beam_descent", "score")]
    out = [f"SELECT '{m}' AS method, query_id, \"rank\", 'leaf_' || node_id AS node_id, {score} AS score FROM ({of[q]})" for m, q, score in parts]
    return " UNION ALL ".join([*out, f"SELECT 'collapsed', query_id, \"rank\", node_id, score FROM ({of['r6_collapsed_tree']})"])


@query("r24_compare_all", _r24_sql())
def r24(spark, sf):
    """The rankings of r1, r5, r6, r7 and r8 with tree node ids; the score of the graph is its mass."""
    leaf = F.concat(F.lit("leaf_"), F.col("node_id").cast("string"))
    made = {"flat": r1(spark, sf), "flat_min": r5(spark, sf), "graph": r7(spark, sf).withColumnRenamed("mass", "score"), "beam": r8(spark, sf)}
    made = {k: d.withColumn("node_id", leaf) for k, d in made.items()} | {"collapsed": r6(spark, sf)}
    out = [d.select(F.lit(k).alias("method"), "query_id", "rank", "node_id", "score") for k, d in made.items()]
    return reduce(DataFrame.unionByName, out)


@query("s4_tree_json")
def s4(spark, sf):
    """One JSON line a node, vectors rounded to 6 digits."""
    t = G.label_tree(_emb(spark, sf))
    return t.select("node_id", F.to_json(F.struct("node_id", "level", "parent_id", F.transform("v", lambda x: F.round(x, 6)).alias("embedding"))).alias("json"))


@query("s5_tree_source", "SELECT 0 AS level, count(*) AS nodes, count(*) AS with_parent FROM embeddings UNION ALL SELECT 1, count(DISTINCT label), count(DISTINCT label) FROM embeddings UNION ALL SELECT 2, 1, 0")
def s5(spark, sf):
    """The tree read back from its JSON; a parent that isn't there is dropped."""
    j = s4(spark, sf).select(F.from_json("json", "node_id string, level int, parent_id string, embedding array<double>").alias("n")).select("n.*")
    there = j.select(F.col("node_id").alias("parent_id"), F.lit(1).alias("there"))
    return j.join(there, "parent_id", "left").groupBy("level").agg(F.count("*").alias("nodes"), F.count("there").alias("with_parent"))
