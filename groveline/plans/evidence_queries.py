"""Queries over ``documents`` and ``benchmark``: entities, keyword retrieval, context, citations, metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from groveline.operators import entities as E
from groveline.operators import text as T
from groveline.plans.registry import query
from groveline.plans.text_queries import MASK, dealt, docs

_NW = "len(list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))"
_T = f"t AS (SELECT doc_id, {MASK} AS t FROM documents)"
_G1 = f"""{_T}, common AS (SELECT DISTINCT unnest(regexp_extract_all(t, '{E.COMMON}')) AS word FROM t),
midcaps AS (SELECT DISTINCT lower(unnest(regexp_extract_all(t, '{E.MIDCAP}', 1))) AS word FROM t)"""
_G2 = f"""{_G1},
named AS (SELECT doc_id, lower(replace(unnest(regexp_extract_all(t, '{E.STANDARD}')), ' ', '')) AS entity FROM t UNION ALL
  SELECT doc_id, lower(m) FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{E.ACRONYM}')) AS m FROM t) WHERE m <> 'ASC'),
ph AS (SELECT DISTINCT doc_id, phrase FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{E.PROPER}')) AS phrase FROM t) WHERE phrase <> 'ASC'),
pk AS (SELECT DISTINCT phrase, list_filter(regexp_split_to_array(phrase, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS ws FROM ph),
pw AS (SELECT phrase, len(ws) AS n, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM pk),
pm AS (SELECT phrase, n, string_agg(lower(w), ' ' ORDER BY p) AS entity, bool_or(lower(w) IN (SELECT word FROM midcaps)) AS mid FROM pw WHERE lower(w) NOT IN (SELECT word FROM common) GROUP BY ALL),
ents AS (SELECT DISTINCT doc_id, entity FROM (SELECT doc_id, entity FROM named UNION ALL SELECT doc_id, entity FROM ph JOIN pm ON pm.phrase = ph.phrase WHERE n > 1 OR mid))"""
_G3 = f"{_G2}, post AS (SELECT entity, count(*) AS df, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM ents GROUP BY entity HAVING count(*) <= greatest(2, (SELECT count(*) FROM documents) // 2))"


@query("g1_common_words", f"WITH {_G1} SELECT word, 'common' AS kind FROM common UNION ALL SELECT word, 'midcap' FROM midcaps")
def g1(spark, sf):
    d = dealt(spark, sf)
    return E.corpus_words(d).select("word", "kind")


@query("g2_entities", f"WITH {_G2} SELECT doc_id, entity FROM ents")
def g2(spark, sf):
    return E.entities(dealt(spark, sf))


@query("g3_inverted_index", f"WITH {_G3} SELECT e.entity, e.doc_id FROM ents e JOIN post p ON p.entity = e.entity")
def g3(spark, sf):
    d = dealt(spark, sf)
    e = E.entities(d)
    return e.join(E.postings(e, d.count()).select("entity"), "entity").select("entity", "doc_id")


@query("g4_idf", f"WITH {_G3} SELECT entity, df, round(idf, 6) AS idf FROM post")
def g4(spark, sf):
    d = dealt(spark, sf)
    return E.postings(E.entities(d), d.count()).select("entity", "df", F.round("idf", 6).alias("idf"))


@query("g5_shared_entities", f"WITH {_G3} SELECT x.doc_id AS a, y.doc_id AS b, round(sum(idf), 6) AS weight FROM ents x JOIN ents y ON x.entity = y.entity AND x.doc_id < y.doc_id JOIN post p ON p.entity = x.entity GROUP BY ALL")
def g5(spark, sf):
    d = dealt(spark, sf)
    e = E.entities(d)
    return E.shared_weights(e, E.postings(e, d.count())).select("a", "b", F.round("weight", 6).alias("weight"))


# Keyword retrieval: every benchmark item is a query
_KW = f"""qw AS (SELECT item_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{E.WORD}')) AS ws FROM benchmark),
q AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w FROM qw), dw AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{E.WORD}'))) AS w FROM documents),
kw AS (SELECT item_id, doc_id, round(count(*) / max(n), 6) AS score FROM dw JOIN q ON q.w = dw.w GROUP BY ALL),
kr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS "rank" FROM kw), k5 AS (SELECT * FROM kr WHERE "rank" <= 5)"""


def _items(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")


def _top(spark, sf, k: int = 5):
    return E.keyword_top(_items(spark, sf), dealt(spark, sf), k)


def _cited(spark, sf):
    """As ``_top``, for a join with ``documents``: ``k`` rows an item, so that the texts stay where they are."""
    return F.broadcast(_top(spark, sf))


@query("r2_keyword_overlap", f'WITH {_KW} SELECT item_id, "rank", doc_id, score FROM k5')
def r2(spark, sf):
    return _top(spark, sf).select("item_id", "rank", "doc_id", "score")


_HY = f"""{_KW}, ln AS (SELECT doc_id, {_NW.format("coalesce(text, chr(32))")} AS n FROM documents),
hy AS (SELECT item_id, kr.doc_id, round(0.85 * (1 / (1 + ln(1 + n))) + 0.15 * score, 6) AS score FROM kr JOIN ln ON ln.doc_id = kr.doc_id),
hr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS "rank" FROM hy)"""


@query("r3_hybrid", f'WITH {_HY} SELECT item_id, "rank", doc_id, score FROM hr WHERE "rank" <= 5')
def r3(spark, sf):
    """0.85 of a base score, here one that falls with length, plus 0.15 of the keyword overlap."""
    base = F.lit(0.85) * (1 / (1 + F.log(1 + T.n_words(F.coalesce("text", F.lit(""))))))
    return E.keyword_top(_items(spark, sf), dealt(spark, sf), 5, base, 0.15).select("item_id", "rank", "doc_id", "score")


_CTX = f"""{_KW}, cx AS (SELECT k5.item_id, k5."rank", k5.doc_id, d.source, k5.score, list_filter(regexp_split_to_array(coalesce(d.text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS ws FROM k5 JOIN documents d ON d.doc_id = k5.doc_id),
cy AS (SELECT *, coalesce((sum(len(ws)) OVER (PARTITION BY item_id ORDER BY "rank" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 0) AS used FROM cx)"""


def _context(spark, sf, budget: int = 400):
    t = _cited(spark, sf).join(docs(spark, sf).select("doc_id", "source", T.words(F.coalesce("text", F.lit(""))).alias("ws")), "doc_id")
    w = Window.partitionBy("item_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("used", F.coalesce(F.sum(F.size("ws")).over(w), F.lit(0))).where(F.col("used") < budget).withColumn("part", F.slice("ws", F.lit(1), F.least(F.size("ws"), F.lit(budget) - F.col("used")).cast("int")))


@query("r16_context", f"""WITH {_CTX} SELECT item_id, string_agg('[' || doc_id || ' | ' || source || ' | score=' || format('{{:.3f}}', score) || ']' || chr(10) || array_to_string(ws[1:least(len(ws), 400 - used)], ' '), chr(10) || chr(10) ORDER BY "rank") AS context FROM cy WHERE used < 400 GROUP BY item_id""")
def r16(spark, sf):
    """Blocks of the best documents under a budget of 400 words; the last is cut."""
    block = F.concat(F.format_string("[%s | %s | score=%.3f]\n", F.col("doc_id").cast("string"), "source", "score"), F.array_join("part", " "))
    c = _context(spark, sf).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    return c.select("item_id", F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n").alias("context"))


@query("a1_citations", f"""WITH {_KW} SELECT item_id, '[' || "rank" || ']' AS citation_id, k5.doc_id, coalesce(source, 'General') AS section, substr(coalesce(d.text, ''), 1, 120) || '...' AS snippet FROM k5 JOIN documents d ON d.doc_id = k5.doc_id""")
def a1(spark, sf):
    t = _cited(spark, sf).join(docs(spark, sf).select("doc_id", F.coalesce("source", F.lit("General")).alias("section"), T.snippet(F.coalesce("text", F.lit("")), 120).alias("snippet")), "doc_id")
    return t.select("item_id", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")).alias("citation_id"), "doc_id", "section", "snippet")


_SETW = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: length(w) > 3))"


@query(
    "a2_faithfulness",
    f"""WITH {_KW}, cw AS (SELECT DISTINCT item_id, unnest({_SETW.format('d.text')}) AS w FROM k5 JOIN documents d ON d.doc_id = k5.doc_id),
aw AS (SELECT item_id, unnest({_SETW.format('text')}) AS w FROM benchmark)
SELECT aw.item_id, round(least(1.0, count(cw.w) / count(*) + 0.25), 4) AS faithfulness FROM aw LEFT JOIN cw ON cw.item_id = aw.item_id AND cw.w = aw.w GROUP BY aw.item_id""",
)
def a2(spark, sf):
    """Each item's text as the answer, its five best documents as the context."""
    big = lambda c: F.array_distinct(F.filter(T.words(F.lower(F.coalesce(c, F.lit("")))), lambda w: F.length(w) > 3))
    ans = _items(spark, sf).select("item_id", big(F.col("text")).alias("aw")).where(F.size("aw") > 0)
    ctx = _cited(spark, sf).join(docs(spark, sf).select("doc_id", big(F.col("text")).alias("cw")), "doc_id").join(ans, "item_id")
    hit = ctx.select("item_id", F.array_intersect("aw", "cw").alias("h")).groupBy("item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("h")))).alias("hits"))
    return ans.join(hit, "item_id", "left").select("item_id", F.round(F.least(F.lit(1.0), F.coalesce("hits", F.lit(0)) / F.size("aw") + 0.25), 4).alias("faithfulness"))


@query("a3_answer", f"""WITH {_KW} SELECT k5.item_id, 'Based on ' || count(*) || ' passages (' || string_agg(DISTINCT source, ', ' ORDER BY source) || '): ' || max(CASE WHEN "rank" = 1 THEN substr(coalesce(d.text, ''), 1, 160) END) AS answer FROM k5 JOIN documents d ON d.doc_id = k5.doc_id GROUP BY k5.item_id""")
def a3(spark, sf):
    t = _cited(spark, sf).join(docs(spark, sf).select("doc_id", "source", F.substring(F.coalesce("text", F.lit("")), 1, 160).alias("head")), "doc_id")
    g = t.groupBy("item_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("s"), F.max(F.when(F.col("rank") == 1, F.col("head"))).alias("h"))
    return g.select("item_id", F.concat(F.lit("Based on "), F.col("n").cast("string"), F.lit(" passages ("), "s", F.lit("): "), "h").alias("answer"))


# Evaluation: an item's gold terms are its distinct words of 6 or more letters; a document covers it with 60 % of them
_EV = f"""{_KW}, tm AS (SELECT item_id, list_distinct(regexp_extract_all(lower({MASK}), '[a-z]{{6,}}')) AS terms FROM benchmark),
cv AS (SELECT k5.item_id, k5."rank", k5.doc_id, d.lang, d.text, len(list_filter(terms, lambda x: contains(lower(coalesce(d.text, '')), x))) >= ceil(0.6 * len(terms)) AS covers FROM k5 JOIN documents d ON d.doc_id = k5.doc_id JOIN tm ON tm.item_id = k5.item_id)"""


def _covered(spark, sf):
    terms = _items(spark, sf).select("item_id", F.array_distinct(T.matches(F.lower(T.masked(F.col("text"))), "[a-z]{6,}")).alias("terms"))
    t = _cited(spark, sf).join(docs(spark, sf).select("doc_id", "lang", "text"), "doc_id").join(terms, "item_id")
    low = F.lower(F.coalesce("text", F.lit("")))
    return t.withColumn("covers", F.size(F.filter("terms", lambda x: F.contains(low, x))) >= F.ceil(0.6 * F.size("terms")))


@query("e1_doc_match", "SELECT doc_id, source, source = 'src1' OR starts_with(source, 'src1_') AS matches FROM documents")
def e1(spark, sf):
    return docs(spark, sf).select("doc_id", "source", ((F.col("source") == "src1") | F.startswith("source", F.lit("src1_"))).alias("matches"))


@query("e2_coverage", f'WITH {_EV} SELECT item_id, "rank", doc_id, covers FROM cv')
def e2(spark, sf):
    return _covered(spark, sf).select("item_id", "rank", "doc_id", "covers")


@query(
    "e4_gold_validation",
    f"""WITH {_EV}, dl AS (SELECT lower(coalesce(text, '')) AS low FROM documents)
SELECT item_id FROM tm WHERE NOT EXISTS (SELECT 1 FROM dl WHERE len(list_filter(terms, lambda x: contains(low, x))) >= ceil(0.6 * len(terms)))""",
)
def e4(spark, sf):
    """Items that no document covers."""
    return E.uncovered(_items(spark, sf), dealt(spark, sf)).select("item_id")


_E5 = f"""{_EV}, mt AS (SELECT item_id, bool_or(covers)::INT::DOUBLE AS hit, coalesce(round(1.0 / min(CASE WHEN covers THEN "rank" END), 6), 0) AS mrr, round(avg(covers::INT), 6) AS "precision", sum({_NW.format("coalesce(text, chr(32))")})::BIGINT AS context_words, min(lang) AS lang FROM cv GROUP BY item_id)"""


def _metrics(spark, sf):
    c = _covered(spark, sf)
    one = F.when(F.col("covers"), F.col("rank"))
    return c.groupBy("item_id").agg(
        F.bool_or("covers").cast("int").cast("double").alias("hit"), F.coalesce(F.round(1.0 / F.min(one), 6), F.lit(0.0)).alias("mrr"),
        F.round(F.avg(F.col("covers").cast("int")), 6).alias("precision"), F.sum(T.n_words(F.coalesce("text", F.lit("")))).alias("context_words"), F.min("lang").alias("lang"),
    )


@query("e5_query_metrics", f'WITH {_E5} SELECT item_id, hit, mrr::DOUBLE AS mrr, "precision", context_words FROM mt')
def e5(spark, sf):
    return _metrics(spark, sf).drop("lang")


@query("e6_summary", f'WITH {_E5} SELECT lang, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr, round(avg("precision"), 6) AS "precision" FROM mt GROUP BY GROUPING SETS ((), (lang))')
def e6(spark, sf):
    m = _metrics(spark, sf)
    return m.rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("precision"), 6).alias("precision"))


@query(
    "e7_paired",
    f"""WITH {_HY}, b AS (SELECT k5.item_id, max(k5.score) AS x, max(h.score) AS y FROM k5 JOIN hr h ON h.item_id = k5.item_id AND h."rank" = 1 WHERE k5."rank" = 1 GROUP BY ALL)
SELECT count(*) FILTER (x - y > 1e-9) AS wins, count(*) FILTER (abs(x - y) <= 1e-9) AS ties, count(*) FILTER (y - x > 1e-9) AS losses FROM b""",
)
def e7(spark, sf):
    """Keyword ranking against the hybrid one, item by item, on their best scores."""
    j = r2(spark, sf).where("rank = 1").select("item_id", F.col("score").alias("x")).join(r3(spark, sf).where("rank = 1").select("item_id", F.col("score").alias("y")), "item_id")
    return j.agg(F.count_if(F.expr("x - y > 1e-9")).alias("wins"), F.count_if(F.expr("abs(x - y) <= 1e-9")).alias("ties"), F.count_if(F.expr("y - x > 1e-9")).alias("losses"))


@query("e12_percentiles", "SELECT lang, round(avg(n_chars), 3) AS mean, round(quantile_cont(n_chars, 0.5), 3) AS p50, round(quantile_cont(n_chars, 0.9), 3) AS p90, round(quantile_cont(n_chars, 0.99), 3) AS p99 FROM documents GROUP BY lang")
def e12(spark, sf):
    p = F.percentile("n_chars", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    g = docs(spark, sf).groupBy("lang").agg(F.round(F.avg("n_chars"), 3).alias("mean"), p.alias("p"))
    return g.select("lang", "mean", *[F.round(F.col("p")[i], 3).alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


@query("s7_query_set", "SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(" + MASK + "), '[a-z]{6,}'))) AS term FROM benchmark")
def s7(spark, sf):
    terms = F.array_distinct(T.matches(F.lower(T.masked(F.col("text"))), "[a-z]{6,}"))
    return _items(spark, sf).select("item_id", F.explode(terms).alias("term"))
