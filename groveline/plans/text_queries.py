"""Queries over ``documents``: units, sections, chunks, keywords, abstracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groveline.operators import text as T
from groveline.plans.registry import query
from groveline.session import spread

SIZE, OVERLAP = 60, 15
_B = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def dealt(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` for work that is dear a row."""
    return spread(docs(spark, sf), "doc_id")


def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return T.chunks(dealt(spark, sf).select("doc_id", "text"), SIZE, OVERLAP)


_NW = "len(list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))"
_SENT = (
    "list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace({0}, '([.?!])(\\s)', '\\1' || chr(1) || '\\2', 'g'), "
    "'([\\p{{L}}\\p{{N}}_]\\.[\\p{{L}}\\p{{N}}_][.?!])' || chr(1), '\\1', 'g'), '([A-Z][a-z]\\.)' || chr(1), '\\1', 'g'), chr(1) || '\\s+'), lambda s: trim(s, " + _B + ")), lambda s: s <> '')"
)
_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, " + _B + ")), lambda x: x <> '')"
_HL = "regexp_matches({}, '" + T.HEADING_LINE + "')"
_HU = "(regexp_matches({0}, '" + T.HEADING_UNIT + "') AND " + _NW.format("{0}") + " < 15)"
#: doc_id, i (from 0), unit
UNITS = f"""l AS (SELECT doc_id, unnest({_LINES}) AS line, unnest(range(0, len({_LINES}))) AS ln FROM documents),
ul AS (SELECT doc_id, ln, CASE WHEN {_HL.format("line")} THEN [line] ELSE {_SENT.format("line")} END AS us FROM l),
ue AS (SELECT doc_id, ln, unnest(us) AS unit, unnest(range(0, len(us))) AS k FROM ul),
u AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ln, k) - 1)::INT AS i, unit FROM ue)"""
#: content units: doc_id, j (from 0), unit, n, section
CONTENT = f"""{UNITS},
uh AS (SELECT *, {_HU.format("unit")} AS head, {_NW.format("unit")}::INT AS n FROM u),
us AS (SELECT *, last_value(CASE WHEN head THEN trim(trim(unit, '#'), {_B}) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM uh),
cu AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS j, unit, n, coalesce(sec, '{T.DEFAULT_SECTION}') AS section FROM us WHERE NOT head),
cs AS (SELECT *, (sum(n) OVER (PARTITION BY doc_id ORDER BY j))::INT AS s FROM cu)"""
#: chunks by prefix sums: doc_id, chunk_index, a, b and the columns of the chunker
CHUNKS = f"""{CONTENT},
da AS (SELECT doc_id, list(s ORDER BY j) AS p, max(j) + 1 AS m FROM cs GROUP BY doc_id),
walk AS (WITH RECURSIVE walk(doc_id, p, m, a, b, k) AS (
  SELECT doc_id, p, m, 0, coalesce(list_min(list_filter(range(1, m), lambda i: p[i + 1] > {SIZE})), m), 0 FROM da
  UNION ALL
  SELECT doc_id, p, m, na, coalesce(list_min(list_filter(range(greatest(na + 1, b + 1), m), lambda i: p[i + 1] - (CASE WHEN na = 0 THEN 0 ELSE p[na] END) > {SIZE})), m), k + 1
  FROM (SELECT *, list_min(list_filter(range(a, b + 1), lambda j: p[b] - (CASE WHEN j = 0 THEN 0 ELSE p[j] END) <= {OVERLAP})) AS na FROM walk WHERE b < m))
  SELECT doc_id, k::INT AS chunk_index, a::INT AS a, b::INT AS b FROM walk),
cb AS (SELECT w.doc_id, w.chunk_index, w.a, w.b, string_agg(c.unit, ' ' ORDER BY c.j) AS text, sum(c.n)::INT AS token_count FROM walk w JOIN cu c ON c.doc_id = w.doc_id AND c.j >= w.a AND c.j < w.b GROUP BY ALL),
sx AS (SELECT w.doc_id, w.chunk_index, c.section, count(*) AS cn, min(c.j) AS fj FROM walk w JOIN cu c ON c.doc_id = w.doc_id AND c.j >= w.a AND c.j < w.b GROUP BY ALL),
sd AS (SELECT doc_id, chunk_index, first(section ORDER BY cn DESC, fj) AS section FROM sx GROUP BY ALL),
chunks AS (SELECT cb.doc_id, cb.chunk_index, a AS first_unit, b AS end_unit, section, text, token_count, substr(sha256(text), 1, 10) AS hash,
  cb.doc_id || '_c' || cb.chunk_index || '_' || substr(sha256(text), 1, 10) AS chunk_id FROM cb JOIN sd ON cb.doc_id = sd.doc_id AND cb.chunk_index = sd.chunk_index)"""


@query("s3_corpus", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def s3(spark, sf):
    return docs(spark, sf).select("doc_id", "text", "lang", "source", "n_chars")


@query("t1_lines", f"SELECT doc_id, unnest(range(0, len({_LINES})))::INT AS line_no, unnest({_LINES}) AS line FROM documents")
def t1(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))


@query("t2_heading_lines", f"WITH l AS (SELECT doc_id, unnest({_LINES}) AS line FROM documents) SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({_HL.format('line')}) AS n_headings FROM l GROUP BY doc_id")
def t2(spark, sf):
    x = docs(spark, sf).select("doc_id", F.explode(T.lines(F.col("text"))).alias("line"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.is_heading_line(F.col("line"))).alias("n_headings"))


@query("t3_sentence_split", f"WITH {UNITS} SELECT doc_id, i AS unit_idx, unit FROM u")
def t3(spark, sf):
    return T.with_units(dealt(spark, sf))


@query("t4_sections", f"WITH {CONTENT} SELECT doc_id, j AS pos, section, unit, n FROM cu")
def t4(spark, sf):
    x = dealt(spark, sf).select("doc_id", F.posexplode(T.sectioned(F.col("text"))).alias("pos", "u"))
    return x.select("doc_id", "pos", "u.section", "u.unit", "u.n")


@query("t5_chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_index, text, token_count FROM chunks")
def t5(spark, sf):
    return doc_chunks(spark, sf).select("doc_id", "chunk_index", "text", "token_count")


@query("t6_overlap", f"WITH {CHUNKS} SELECT doc_id, chunk_index, first_unit, end_unit, greatest(0, coalesce(lag(end_unit) OVER (PARTITION BY doc_id ORDER BY chunk_index), first_unit) - first_unit)::INT AS shared_units FROM chunks")
def t6(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    shared = F.greatest(F.lit(0), F.coalesce(F.lag("end_unit").over(w), F.col("first_unit")) - F.col("first_unit"))
    return doc_chunks(spark, sf).select("doc_id", "chunk_index", "first_unit", "end_unit", shared.alias("shared_units"))


@query("t7_dominant_section", f"WITH {CHUNKS} SELECT doc_id, chunk_index, section FROM chunks")
def t7(spark, sf):
    return doc_chunks(spark, sf).select("doc_id", "chunk_index", "section")


@query("t8_fingerprint", "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 10) AS hash FROM documents")
def t8(spark, sf):
    return docs(spark, sf).select("doc_id", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 10).alias("hash"))


@query("t9_chunk_id", f"WITH {CHUNKS} SELECT doc_id, chunk_index, hash, chunk_id FROM chunks")
def t9(spark, sf):
    return doc_chunks(spark, sf).select("doc_id", "chunk_index", "hash", "chunk_id")


@query("t10_metadata", f"WITH {CHUNKS} SELECT c.chunk_id, d.source AS section, d.lang, c.token_count FROM chunks c JOIN documents d ON d.doc_id = c.doc_id")
def t10(spark, sf):
    """Extra metadata overrides a chunk's own columns of the same name: the source takes the section's place."""
    extra = docs(spark, sf).select("doc_id", F.col("source").alias("section"), "lang")
    return doc_chunks(spark, sf).drop("section").join(extra, "doc_id").select("chunk_id", "section", "lang", "token_count")


@query("t12_word_count", f"SELECT doc_id, {_NW.format('coalesce(text, chr(32))')}::INT AS n_words FROM documents")
def t12(spark, sf):
    return docs(spark, sf).select("doc_id", T.n_words(F.coalesce("text", F.lit(""))).alias("n_words"))


@query("t13_hash_report", f"WITH {CHUNKS} SELECT count(*) AS chunks, count(DISTINCT hash) AS distinct_hashes, round(avg(token_count), 4) AS avg_words FROM chunks")
def t13(spark, sf):
    return doc_chunks(spark, sf).agg(F.count("*").alias("chunks"), F.countDistinct("hash").alias("distinct_hashes"), F.round(F.avg("token_count"), 4).alias("avg_words"))


@query("t14_embedding_text", f"WITH {CHUNKS} SELECT chunk_id, CASE WHEN section <> '' THEN trim(section || ': ' || text, ': ') ELSE text END AS embedding_text FROM chunks")
def t14(spark, sf):
    return doc_chunks(spark, sf).select("chunk_id", T.embedding_text(F.col("section"), F.col("text")).alias("embedding_text"))


@query("t15_snippet", "SELECT doc_id, substr(coalesce(text, ''), 1, 120) || '...' AS s120, substr(coalesce(text, ''), 1, 160) AS s160, substr(coalesce(text, ''), 1, 80) || '...' AS s80 FROM documents")
def t15(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return docs(spark, sf).select("doc_id", T.snippet(t, 120).alias("s120"), T.snippet(t, 160, "").alias("s160"), T.snippet(t, 80).alias("s80"))


@query("t16_provenance", f"WITH {CHUNKS} SELECT chunk_id, split_part(chunk_id, '_', 1) || '#c' || chunk_index AS label FROM chunks")
def t16(spark, sf):
    return doc_chunks(spark, sf).select("chunk_id", F.concat(F.split_part("chunk_id", F.lit("_"), F.lit(1)), F.lit("#c"), F.col("chunk_index").cast("string")).alias("label"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
MASK = "regexp_replace(coalesce(text, ''), '" + T.FOREIGN_WORD + "', chr(1), 'g')"
_ASCII_UP = "upper({})"


@query(
    "c10_keywords",
    f"""WITH w AS (SELECT source, unnest(regexp_extract_all({MASK}, '{T.KEYWORD}')) AS w FROM documents),
k AS (SELECT source, CASE WHEN upper(w) = w THEN w ELSE lower(w) END AS keyword FROM w),
f AS (SELECT source, keyword, count(*) AS freq FROM k WHERE lower(keyword) NOT IN ({_STOP}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY freq DESC, lower(keyword), keyword)::INT AS "rank" FROM f)
SELECT source, "rank", keyword, freq FROM r WHERE "rank" <= 6""",
)
def c10(spark, sf):
    return T.keywords(dealt(spark, sf), "source")


@query(
    "c13_frequency_abstract",
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, {_B})), lambda x: length(x) > 15) AS s FROM d),
s AS (SELECT doc_id, unnest(range(0, len(s))) AS p, unnest(s) AS sentence FROM a),
w AS (SELECT doc_id, p, unnest(list_filter(regexp_split_to_array(lower(sentence), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: length(w) > 3)) AS w FROM s),
f AS (SELECT doc_id, w, count(*) AS f FROM w GROUP BY ALL),
c AS (SELECT w.doc_id, w.p, sum(f) AS score FROM w JOIN f ON f.doc_id = w.doc_id AND f.w = w.w GROUP BY ALL),
r AS (SELECT s.doc_id, sentence, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(score, 0) DESC, s.p) AS r FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND c.p = s.p),
b AS (SELECT doc_id, string_agg(sentence, ' | ' ORDER BY r) AS body FROM r WHERE r <= 3 GROUP BY doc_id),
e AS (SELECT doc_id, text, list_sort(list_distinct(regexp_extract_all({MASK}, '\\b[A-Z][a-zA-Z0-9_-]+\\b')))[1:5] AS ents FROM d)
SELECT e.doc_id, 'ABSTRACT SUMMARY: ' || coalesce(body, substr(text, 1, 150) || '...') || CASE WHEN len(ents) > 0 THEN ' [Entities: ' || array_to_string(ents, ', ') || ']' ELSE '' END AS abstract
FROM e LEFT JOIN b ON b.doc_id = e.doc_id""",
)
def c13(spark, sf):
    return T.frequency_abstract(dealt(spark, sf))


@query("c14_key_entities", f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all({MASK}, '\\b[A-Z][a-zA-Z0-9_-]+\\b')))[1:10], '|') AS entities FROM documents")
def c14(spark, sf):
    return dealt(spark, sf).select("doc_id", F.array_join(T.key_entities(F.col("text")), "|").alias("entities"))


@query("t11_first_generation_chunks")
def t11(spark, sf):
    """Chunks of 250 words with overlaps of 50 over whole texts; headings stay in the text."""
    from groveline.operators.text import bounds, n_words, sentences_of_line

    u = dealt(spark, sf).select("doc_id", sentences_of_line(F.coalesce("text", F.lit(""))).alias("u"))
    c = u.select("doc_id", "u", F.posexplode(bounds(F.transform("u", n_words), 250, 50)).alias("chunk_index", "c"))
    return c.select("doc_id", "chunk_index", F.array_join(F.slice("u", F.col("c.a") + 1, F.col("c.b") - F.col("c.a")), " ").alias("text"))
