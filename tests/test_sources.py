"""Text folders, tree files, the seeded corpus and the stream of chunks."""

from pyspark.sql import functions as F

from groveline.operators import text as T
from groveline.operators import tree as R
from groveline.sources import files
from groveline.streaming.ingest import chunk_stream


def test_text_folder(spark, tmp_path):
    (tmp_path / "b_two.txt").write_text("Zweite Größe.\nEnde.", "utf-8")
    (tmp_path / "a.one.txt").write_text("x", "utf-8")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "no.pdf").write_text("x")
    got = {r["doc_id"]: r["text"] for r in files.texts(spark, str(tmp_path)).collect()}
    assert got == {"b_two": "Zweite Größe.\nEnde.", "a.one": "x"}


def test_tree_round_trip(spark, tmp_path):
    docs, _ = files.dossiers(spark, 4, 3)
    nodes, edges, stats = R.build(T.chunks(docs, 20, 5))
    near = R.lateral(nodes, edges)
    files.write_tree(nodes, edges, near, f"{tmp_path}/tree")
    n, e, x = files.read_tree(spark, f"{tmp_path}/tree")
    key = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert key(n, "node_id", "level", "text", "doc_id") == key(nodes, "node_id", "level", "text", "doc_id")
    assert key(e, "parent_id", "child_id") == key(edges, "parent_id", "child_id")
    assert key(x, "src", "dst", "score", "relation") == key(near, "src", "dst", "score", "relation")
    worst = n.alias("a").join(nodes.alias("b"), "node_id").select(F.array_max(F.zip_with("a.v", "b.v", lambda p, q: F.abs(p - q))).alias("d")).agg(F.max("d")).first()[0]
    assert worst <= 5.1e-7
    files.write_tree(nodes.where("level > 0"), edges, near, f"{tmp_path}/half", embeddings=False)
    half = files.read_tree(spark, f"{tmp_path}/half")
    assert half[1].join(nodes.where("level = 0"), F.col("child_id") == F.col("node_id"), "left_semi").isEmpty() and half[0].where("v IS NOT NULL").isEmpty()
    assert stats


def test_small_trees(spark):
    none = T.chunks(spark.createDataFrame([], "doc_id long, text string"), 20, 5)
    assert R.build(none)[0].count() == 0
    one = T.chunks(spark.createDataFrame([(1, "Only one short sentence here.")], "doc_id long, text string"), 20, 5)
    nodes, edges, _ = R.build(one)
    assert nodes.count() == 1 and edges.count() == 0 and R.lateral(nodes, edges).count() == 0


def test_planted_facts_stand_in_a_chunk(spark):
    docs, asks = files.dossiers(spark, 6, 3)
    assert docs.collect() == files.dossiers(spark, 6, 3)[0].collect()
    chunks = T.chunks(docs, 20, 5).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("chunk"))
    held = asks.join(chunks, "doc_id").where(F.forall("terms", lambda t: F.contains("chunk", t)))
    assert held.select("query_id").distinct().count() == 6


def test_stream(spark, tmp_path):
    docs, _ = files.dossiers(spark, 4, 2)
    docs.repartition(2).write.parquet(f"{tmp_path}/in")
    q = chunk_stream(spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", 20, 5)
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == T.chunks(docs, 20, 5).count() and got.where(F.size("v") != 384).isEmpty()
