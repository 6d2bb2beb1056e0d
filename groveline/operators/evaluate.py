"""Judging retrieved nodes against gold documents and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groveline.operators import text as T

MATCH = 0.6
EPSILON = 1e-9
MEASURES = ("recall", "hit", "complete", "mrr", "doc_coverage", "precision", "context_words")


def doc_match(doc: Column, gold: Column) -> Column:
    """The gold document itself, or a part of it named with an underscore."""
    return (doc == gold) | F.startswith(doc, F.concat(gold, F.lit("_")))


def covers(text: Column, terms: Column, share: float = MATCH) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t)))) >= F.ceil(F.lit(share) * F.size(terms))


def judge(runs: DataFrame, nodes: DataFrame, gold: DataFrame) -> DataFrame:
    """method, query_id, rank, words, gold_doc, match, covered: each retrieved node against each gold item of its query.

    ``runs``: method, query_id, rank, node_id; ``gold``: query_id, doc_id, terms, a row an item.
    """
    n = nodes.select("node_id", F.col("docs"), "text")
    g = gold.select("query_id", F.col("doc_id").alias("gold_doc"), "terms")
    j = runs.join(n, "node_id").join(g, "query_id")
    match = F.exists("docs", lambda d: doc_match(d, F.col("gold_doc")))
    return j.select("method", "query_id", "rank", T.n_words(F.coalesce("text", F.lit(""))).alias("words"), "gold_doc", match.alias("match"), (match & covers(F.col("text"), F.col("terms"))).alias("covered"))


def per_query(judged: DataFrame, gold: DataFrame) -> DataFrame:
    """method, query_id and the measures. A query that got nothing has no row."""
    want = gold.groupBy("query_id").agg(F.count("*").alias("want"))
    by_item = judged.groupBy("method", "query_id", "gold_doc").agg(F.max("covered").alias("got"), F.max("match").alias("seen"))
    a = by_item.groupBy("method", "query_id").agg(F.count_if("got").alias("got"), F.count_if("seen").alias("seen")).join(want, "query_id")
    node = judged.groupBy("method", "query_id", "rank").agg(F.max("covered").alias("any"), F.max("words").alias("words"))
    b = node.groupBy("method", "query_id").agg(F.min(F.when(F.col("any"), F.col("rank"))).alias("first"), F.avg(F.col("any").cast("int")).alias("precision"), F.sum("words").alias("context_words"))
    j = a.join(b, ["method", "query_id"])
    share = lambda c: F.round(F.col(c) / F.col("want"), 6)
    return j.select("method", "query_id", share("got").alias("recall"), (F.col("got") > 0).cast("double").alias("hit"), (F.col("got") == F.col("want")).cast("double").alias("complete"),
                    F.coalesce(F.round(1 / F.col("first"), 6), F.lit(0.0)).alias("mrr"), share("seen").alias("doc_coverage"), F.round("precision", 6).alias("precision"), F.col("context_words").cast("double").alias("context_words"))


def summary(per: DataFrame) -> DataFrame:
    """method, n and the mean of every measure."""
    return per.groupBy("method").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in MEASURES])


def paired(per: DataFrame, one: str) -> DataFrame:
    """other, wins, ties, losses: the recall of ``one`` against each other method, query by query."""
    x = per.where(F.col("method") == one).select("query_id", F.col("recall").alias("x"))
    y = per.where(F.col("method") != one).select(F.col("method").alias("other"), "query_id", F.col("recall").alias("y"))
    d = y.join(x, "query_id").withColumn("d", F.col("x") - F.col("y"))
    return d.groupBy("other").agg(F.count_if(F.col("d") > EPSILON).alias("wins"), F.count_if(F.abs("d") <= EPSILON).alias("ties"), F.count_if(F.col("d") < -EPSILON).alias("losses"))


def verdict(per_method: DataFrame, close: float = 0.01) -> DataFrame:
    """place, method, recall: by recall, and of two neighbours less than ``close`` apart the one with fewer context words first. A row a method."""
    rows = [(r["method"], r["recall"], r["context_words"]) for r in per_method.orderBy(F.desc("recall"), "method").collect()]
    moved = True
    passes = 0
    while moved and passes < len(rows):
        moved, passes = False, passes + 1
        for i in range(len(rows) - 1):
            a, b = rows[i], rows[i + 1]
            if a[1] - b[1] < close and a[1] >= b[1] and b[2] < a[2]:
                rows[i], rows[i + 1], moved = b, a, True
    return per_method.sparkSession.createDataFrame([(i + 1, m, r) for i, (m, r, _) in enumerate(rows)], "place int, method string, recall double")
