"""Documents from text folders, chunk and tree tables as JSON lines, and a seeded corpus with planted facts."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "node_id string, pos long, level int, text string, embedding array<double>, doc_id string, docs array<string>, chunk_index int, section string, keywords array<string>, child_count int, cohesion double, children array<string>, cross_links array<struct<target_id:string,score:double,relation:string>>"


def texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """doc_id (the file's name without folder and ending), text: a row a file that matches. An empty file or folder gives none."""
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(name.alias("doc_id"), F.decode("content", "UTF-8").alias("text"))


def write_tree(nodes: DataFrame, edges: DataFrame, lateral: DataFrame, path: str, digits: int = 6, embeddings: bool = True) -> None:
    """A JSON line a node, with its children in order and its lateral links; vectors rounded to ``digits``."""
    kids = edges.join(nodes.select(F.col("node_id").alias("child_id"), F.col("pos").alias("p")), "child_id")
    kids = kids.groupBy(F.col("parent_id").alias("node_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "child_id"))), lambda x: x["child_id"]).alias("children"))
    links = lateral.groupBy(F.col("src").alias("node_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("dst").alias("target_id"), "score", "relation"))), lambda x: F.struct(x["target_id"].alias("target_id"), x["score"].alias("score"), x["relation"].alias("relation"))).alias("cross_links"))
    v = F.transform("v", lambda x: F.round(x, digits)) if embeddings else F.lit(None).cast("array<double>")
    out = nodes.withColumn("embedding", v).drop("v").join(kids, "node_id", "left").join(links, "node_id", "left")
    out.write.mode("overwrite").json(path)


def read_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges (parent_id, child_id) and lateral edges; children that aren't there are left out."""
    n = spark.read.schema(NODE).json(path)
    there = n.select(F.col("node_id").alias("child_id"))
    edges = n.select(F.col("node_id").alias("parent_id"), F.explode("children").alias("child_id")).join(there, "child_id", "left_semi").select("parent_id", "child_id")
    links = n.select(F.col("node_id").alias("src"), F.explode("cross_links").alias("x")).select("src", F.col("x.target_id").alias("dst"), "x.score", "x.relation")
    nodes = n.withColumnRenamed("embedding", "v").drop("children", "cross_links")
    return nodes, edges, links


def dossiers(spark: SparkSession, n: int = 16, paragraphs: int = 8, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text) with a planted fact in each paragraph, and queries (query_id, text, doc_id, terms) that ask for them."""
    rnd = random.Random(seed)
    filler = ["The board met as planned", "Costs were in line with the year before", "No changes were made to the outlook", "Staff were informed in writing", "The audit found no gaps", "Deliveries went on without delay"]
    things = ["pump", "ledger", "sensor", "permit", "tender", "archive", "turbine", "pipeline"]
    docs, asks = [], []
    for i in range(n):
        name, parts = f"Dossier{i:03d}", []
        for p in range(paragraphs):
            thing, value = things[p % len(things)], rnd.randint(1000, 9999)
            said = [f"{x}." for x in rnd.sample(filler, 4)]
            said.insert(rnd.randrange(5), f"The {thing} of {name} has the number {value}.")
            parts.append(f"Section {p + 1}\n" + " ".join(said))
            if p == 0:
                asks.append((i, f"Which number has the {thing} of {name}?", str(i), [name, str(value)]))
        docs.append((i, "\n".join(parts)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asks, "query_id long, text string, doc_id string, terms array<string>")

