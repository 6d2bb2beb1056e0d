"""A training-data pipeline: quality filter, line dedup, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.llm import common as C
from groveline.llm import crf_quality, line_dedup, mixing, near_dup, packing

#: Target shares of the mixed corpus, relative to ``OTHER_SOURCES`` for each source not named.
SOURCE_WEIGHTS = {"src0": 1.0, "src1": 2.0, "src2": 0.5, "src3": 1.5}
OTHER_SOURCES = 1.0
#: A document stays if its quality score is at least this; below it, the classifier calls it bad.
QUALITY_FROM = 0.7
SHINGLE_WORDS, SIMILARITY_PCT, LINE_PCT = 5, 80, 80
PACK_LENGTH, PACK_BUCKETS, PACK_BUDGET = 2048, 8, 16384


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches ``QUALITY_FROM``.

    The classifier learns from labelled rows of ``docs`` (a bounded sample, see its module). Without
    labels of both kinds there is no classifier and every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = crf_quality.train(docs, labels, "quality", F.lit(False))
    if "w" not in model:
        return docs
    return crf_quality.quality(docs, model).where(F.col("quality_score") >= QUALITY_FROM).drop("quality_score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; n_chars follows. A document that loses its last word goes.

    Null, empty and blank texts stay as they are, and so do further columns.
    """
    out = line_dedup.dedup_lines(docs, LINE_PCT, drop_emptied=True)
    n = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    Texts without words and rows without doc_id all stay; of repeated rows (equal doc_id and text) one stays.
    """
    return near_dup.dedup(docs, SHINGLE_WORDS, SIMILARITY_PCT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target share asks, in one global random order.

    A null source is a source of its own; an empty text counts one character; all columns stay, a row a copy.
    """
    own = C.free(docs.columns, "rate", "copy", "shuffle_key")
    return mixing.mix(docs, SOURCE_WEIGHTS, OTHER_SOURCES, own=tuple(own)).select(*[C.field(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the mixed documents with their bucket, batch and slot.

    Lengths and the budget are counted in words between white space. Texts without words make no sequence;
    columns other than doc_id and text are not used.
    """
    return packing.pack(docs, PACK_LENGTH, PACK_BUCKETS, PACK_BUDGET)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: The first stage is a fitted model, which SQL can't express; tests hold the other four against a brute-force version, row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again. An empty table gives an empty result."""
    docs = C.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, C.save(stage(spark, docs, sf_dir), f"pipeline_{name}")
        C.drop(before)  # the stage is done; ``documents`` itself is no table of ours
    return STAGES[-1][1](spark, docs, sf_dir)
