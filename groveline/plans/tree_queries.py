"""Queries over the tree of ``benchmark``: every passage is a document, its first words are a query whose gold it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groveline.operators import encode as N
from groveline.operators import evaluate as M
from groveline.operators import graph as G
from groveline.operators import retrieve as Q
from groveline.operators import text as T
from groveline.operators import tree as R
from groveline.plans.registry import query
from groveline.session import save

SIZE, OVERLAP, QUERY_WORDS = 20, 5, 12
_made: dict[tuple[str, str], tuple[Q.Index, list[dict]]] = {}
_verdicts: dict[tuple[str, str], DataFrame] = {}


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")


def _index(spark: SparkSession, sf: str) -> tuple[Q.Index, list[dict]]:
    """Built once an application and folder: the tables are files in the shared folder."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _made:
        _made[at] = Q.build_index(T.chunks(_passages(spark, sf), SIZE, OVERLAP))
    return _made[at]


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    head = F.array_join(F.slice(T.words(F.coalesce("text", F.lit(""))), 1, QUERY_WORDS), " ")
    return N.encode(_passages(spark, sf).select(F.col("doc_id").alias("query_id"), head.alias("text")))


_F = "list_concat(ws, list_concat(list_transform(range(1, len(ws)), lambda i: ws[i] || '_' || ws[i + 1]), list_transform(range(0, greatest(0, length(line) - 3), 2), lambda i: substr(line, i + 1, 4))))"


@query(
    "v2_feature_hashing",
    f"""WITH w AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{N.WORD}') AS ws FROM benchmark),
l AS (SELECT item_id, ws, array_to_string(ws, ' ') AS line FROM w), h AS (SELECT item_id, md5(unnest({_F})) AS h FROM l),
s AS (SELECT item_id, (('0x' || substr(h, 1, 12))::BIGINT % 64)::INT AS dim, sum(CASE WHEN substr(h, 13, 1) >= '8' THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM h GROUP BY ALL),
n AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM s GROUP BY item_id)
SELECT s.item_id, dim, round(x / CASE WHEN n = 0 THEN 1e-9 ELSE n END, 6) AS value FROM s JOIN n ON n.item_id = s.item_id WHERE x <> 0""",
)
def v2(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    v = N.encode_md5(b, "item_id").select("item_id", F.posexplode("v").alias("dim", "x"))
    return v.where("x <> 0").select("item_id", "dim", F.round("x", 6).alias("value"))


@query("c15_leaves")
def c15(spark, sf):
    return _index(spark, sf)[0].nodes.where("level = 0").select("node_id", "pos", "doc_id", "chunk_index", "section")


@query("c16_abstracts")
def c16(spark, sf):
    """Abstract nodes: children, cohesion, keywords and text (C11, C16-C18)."""
    return _index(spark, sf)[0].nodes.where("level > 0").select("node_id", "level", "child_count", "cohesion", "docs", "keywords", "text")


@query("c19_tree_edges")
def c19(spark, sf):
    return _index(spark, sf)[0].edges


@query("c21_lateral_edges")
def c21(spark, sf):
    return _index(spark, sf)[0].near.select("src", "dst", "w", "kind")


@query("c23_build_metrics")
def c23(spark, sf):
    st = _index(spark, sf)[1]
    kind = "level int, input_nodes long, clusters long, promoted long, iterations int, cohesion double, inertia double, cross_document long"
    return spark.createDataFrame([tuple(s.values()) for s in st], kind)


@query("c25_cross_documents")
def c25(spark, sf):
    """Abstracts over several documents, the five with most first."""
    n = _index(spark, sf)[0].nodes.where((F.col("level") > 0) & (F.size("docs") > 1))
    return n.select("node_id", "level", F.size("docs").alias("documents")).orderBy(F.desc("documents"), "node_id").limit(5)


_VARIANTS = {"full": {}, "paper": {"follow_sequence": False, "entity_seeding": False, "propagate": False, "gate": False}}


def _search(spark, sf, variant: str) -> DataFrame:
    return Q.search(_index(spark, sf)[0], _queries(spark, sf), **_VARIANTS[variant])


@query("r14_tree_retrieval")
def r14(spark, sf):
    """Descent, entity links, expansion, propagation, gated diversity (R8-R13, G14, G15)."""
    return _search(spark, sf, "full")


@query("r15_paper_variant")
def r15(spark, sf):
    return _search(spark, sf, "paper")


def _similar(idx: Q.Index) -> DataFrame:
    return G.similarity_graph(idx.nodes, 0.3).select("src", "dst")


def _approaches(spark, sf, k: int = 5) -> dict[str, DataFrame]:
    idx, q = _index(spark, sf)[0], _queries(spark, sf)
    near = _similar(idx)
    return {
        "descent": Q.top_down(idx, q, k, k, score_roots=False), "flat": Q.flat(idx, q, k), "graph": Q.seed_and_neighbours(idx, q, k, near),
        "collapsed": Q.flat(idx, q, k, inner=True), "hybrid": Q.descent_and_neighbours(idx, q, k, near),
    }


@query("r17_top_down")
def r17(spark, sf):
    return Q.top_down(_index(spark, sf)[0], _queries(spark, sf), 3, 3)


@query("r19_r23_approaches")
def r19(spark, sf):
    """The five approaches of the first generation on every query (R19-R23)."""
    return reduce(DataFrame.union, [d.select(F.lit(m).alias("method"), "query_id", "rank", "node_id", "score") for m, d in _approaches(spark, sf).items()])


def _gold(spark, sf) -> DataFrame:
    """query_id, doc_id, terms: the passage itself, with its distinct words of 6 or more letters."""
    return _passages(spark, sf).select(F.col("doc_id").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), F.array_distinct(T.matches(F.lower("text"), r"\p{L}{6,}")).alias("terms"))


def _judged(spark, sf) -> DataFrame:
    """Four rankings held against the gold; written once an application and folder, as the index."""
    at = (spark.sparkContext.applicationId, sf)
    if at in _verdicts:
        return _verdicts[at]
    idx = _index(spark, sf)[0]
    runs = {"tree": _search(spark, sf, "full"), "paper": _search(spark, sf, "paper"), "flat": Q.flat(idx, _queries(spark, sf), 5), "collapsed": Q.flat(idx, _queries(spark, sf), 5, inner=True)}
    all_ = reduce(DataFrame.union, [d.select(F.lit(m).alias("method"), "query_id", "rank", "node_id") for m, d in runs.items()])
    _verdicts[at] = save(M.judge(all_, idx.nodes, _gold(spark, sf)), "judged")
    return _verdicts[at]


@query("e5_gold_metrics")
def e5(spark, sf):
    """Recall, hit, complete, MRR, document coverage, precision and words of each method and query (E1-E3, E5)."""
    return M.per_query(_judged(spark, sf), _gold(spark, sf))


@query("e6_method_summary")
def e6(spark, sf):
    return M.summary(M.per_query(_judged(spark, sf), _gold(spark, sf)))


@query("e7_recall_pairs")
def e7(spark, sf):
    return M.paired(M.per_query(_judged(spark, sf), _gold(spark, sf)), "tree")


@query("e8_verdict")
def e8(spark, sf):
    return M.verdict(M.summary(M.per_query(_judged(spark, sf), _gold(spark, sf))))
