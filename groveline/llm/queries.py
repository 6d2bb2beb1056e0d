"""Queries over the operators of this package, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.llm import common as C
from groveline.llm import crf_quality, fingerprint, kd_search, line_dedup, mixing, near_dup, packing, token_counts, token_store, toxicity

SOURCE_WEIGHTS = {"src0": 1.0, "src1": 2.0, "src2": 0.5, "src3": 1.5}
QUALITY_FROM = 0.7


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(C.documents(spark, sf), width=4, share_pct=80)


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    out = mixing.mix(C.documents(spark, sf), SOURCE_WEIGHTS)
    return out.select("doc_id", "copy", F.round("rate", 6).alias("rate"), "shuffle_key", "text", "lang", "source", "n_chars")


OP2 = f"""
WITH d AS (SELECT *, greatest(1, length(coalesce(text, ''))) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS size, any_value(coalesce(MAP {{{", ".join(f"'{k}': {v}" for k, v in SOURCE_WEIGHTS.items())}}}[source], 1.0))::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM s) * (SELECT sum(size) FROM s) / size AS rate FROM s),
p AS (SELECT d.*, r.rate, greatest(1, ceil(r.rate / 16.0))::INT AS parts FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
u AS (SELECT *, unnest(range(1, parts + 1)) AS part FROM p),
v AS (SELECT *, (('0x' || substr(md5('mix/' || part || '|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS q, rate / parts AS m FROM u),
k AS (SELECT v.*, (WITH RECURSIVE t(k, p, c) AS (SELECT 0, exp(-m), exp(-m) UNION ALL SELECT k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM t WHERE c < q AND k < 112) SELECT max(k) FROM t) AS n FROM v),
n AS (SELECT doc_id, text, lang, source, n_chars, rate, sum(n)::INT AS n FROM k GROUP BY ALL),
c AS (SELECT *, unnest(range(1, n + 1))::INT AS copy FROM n WHERE n > 0)
SELECT doc_id, copy, round(rate, 6) AS rate, md5('mix/order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy) AS shuffle_key, text, lang, source, n_chars FROM c"""


def op3_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.fingerprints(C.documents(spark, sf))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = C.documents(spark, sf).select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels, "toxic", C.held_out(5, 0))
    return _scored(toxicity.toxicity(docs, model), "toxicity", C.held_out(5, 0), 0.5)


def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.removed_lines(C.documents(spark, sf))


def op6_token_store(spark: SparkSession, sf: str) -> DataFrame:
    out = C.scratch(spark, "tokens")
    return token_store.read_tokens(token_store.write_tokens(C.documents(spark, sf), _tokenizer("byte_bpe_50k.json"), 2, out))


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.documents(spark, sf).select("doc_id", "text")
    return token_counts.token_counts(docs, _tokenizer("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def _scored(df: DataFrame, name: str, out, least: float) -> DataFrame:
    return df.select("doc_id", out.alias("held_out"), F.col(name).alias("score"), (F.col(name) >= least).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = C.documents(spark, sf).select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = crf_quality.train(docs, labels, "quality", C.held_out(4, 2))
    return _scored(crf_quality.quality(docs, model), "quality_score", C.held_out(4, 2), QUALITY_FROM)


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(C.documents(spark, sf))


def op10_topk(spark: SparkSession, sf: str) -> DataFrame:
    return kd_search.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), 20, 20)


OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)::DOUBLE) v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT q.vec_id query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 20"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (op1_near_dup, op2_mixing, op3_fingerprints, op4_toxicity, op5_line_dedup, op6_token_store, op7_token_counts, op8_quality, op9_packing, op10_topk)
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dup": near_dup.ORACLE.format(width=4, share=80), "op2_mixing": OP2, "op9_packing": packing.oracle(2048, 8, 16384), "op10_topk": OP10}
