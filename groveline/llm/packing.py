"""Packing into length buckets whose boundaries minimise padding.

Texts are cut into sequences of at most ``max_len`` words (white space between them). The global
histogram of lengths has at most ``max_len`` bins, whatever the input; dynamic programming over it
gives the ``buckets`` boundaries with the least total padding. Inside a bucket, sequences take
consecutive ranks in a hash order and every ``token_budget // boundary`` of them form a batch.

Ranks are exact without gathering a bucket in one task: sequences are hashed into blocks, a block
count table is summed up, and only rows of one block are ranked together.

Cases: null and empty texts make no sequence, as they hold no word; longer texts make several
(piece 0, 1, ...); nothing is cut off. Repeated rows are sequences of their own (``dup`` tells
them apart); a null doc_id hashes as an empty string; an empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groveline.llm.common import save

WORD = r"[^\x20\x09-\x0D]+"


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Bucket upper bounds, ascending, with the least padding; ties go to the smaller boundary.

    cost(a, b] = sum over lengths l in (a, b] of count(l) * (b - l). O(buckets * n^2) over the distinct lengths.
    """
    lengths = sorted(k for k, n in histogram.items() if n > 0)
    if not lengths:
        return []
    n = len(lengths)
    x = np.asarray(lengths, np.int64)
    count = np.concatenate([[0], np.cumsum([histogram[k] for k in lengths])]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum([histogram[k] * k for k in lengths])]).astype(np.int64)
    k = min(buckets, n)
    far = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, far, np.int64)
    best[0] = 0
    back = []
    for _ in range(k):
        nxt, at = np.full(n + 1, far, np.int64), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + x[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j])
            i = int(np.argmin(cost))
            nxt[j], at[j] = cost[i], i
        best = nxt
        back.append(at)
    out, j = [], n
    for at in reversed(back):
        out.append(int(x[j - 1]))
        j = int(at[j])
    return sorted(out)


def sequences(docs: DataFrame, max_len: int) -> DataFrame:
    """doc_id, piece, length, dup, key: a row a sequence. ``key`` orders sequences inside a bucket."""
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    counted = docs.select("doc_id", words.alias("words")).where("words > 0")
    # equal rows are counted, then told apart by dup
    counted = counted.groupBy("doc_id", "words").agg(F.count("*").alias("copies"))
    rows = counted.select("doc_id", "words", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("dup"))
    last = F.floor((F.col("words") - 1) / F.lit(max_len))
    rows = rows.select("doc_id", "dup", "words", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    length = F.least(F.lit(max_len).cast("long"), F.col("words") - F.col("piece") * F.lit(max_len))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "words", "dup", "piece"))
    return rows.select("doc_id", "piece", length.cast("int").alias("length"), "dup", key.alias("key"))


def pack(
    docs: DataFrame, max_len: int = 2048, buckets: int = 8, token_budget: int = 16384, block_rows: int = 20_000
) -> DataFrame:
    """doc_id, piece, dup, length, bucket (its padded length), batch (from 0 in each bucket), slot."""
    spark = docs.sparkSession
    seq = save(sequences(docs, max_len), "sequences")
    hist = {r["length"]: r["n"] for r in seq.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_len rows
    bounds = boundaries(hist, buckets)
    if not bounds:
        return seq.select("doc_id", "piece", "dup", "length", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("batch"), F.lit(0).alias("slot"))
    bucket = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("length") <= b, F.lit(b)).otherwise(bucket)
    # blocks by the leading hexadecimal digits of the hash: a block's rows stay near block_rows
    digits = max(1, min(12, int(np.ceil(np.log(max(1, sum(hist.values()) / block_rows)) / np.log(16)))))
    seq = seq.withColumn("bucket", bucket).withColumn("block", F.substring("key", 1, digits))
    counts = seq.groupBy("bucket", "block").agg(F.count("*").alias("n"))
    w = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "block").orderBy("key", "doc_id", "piece", "dup")
    ranked = seq.withColumn("r", F.row_number().over(inside)).join(starts, ["bucket", "block"])
    rank = F.col("before") + F.col("r") - 1
    size = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket"))).cast("long")
    return ranked.select(
        "doc_id", "piece", "dup", "length", "bucket", F.floor(rank / size).cast("long").alias("batch"), (rank % size).cast("int").alias("slot")
    )


def oracle(max_len: int, buckets: int, token_budget: int) -> str:
    """DuckDB SQL for :func:`pack`: the same dynamic programme as one CTE a bucket."""
    steps = ["d0 AS (SELECT 0::BIGINT j, 0::BIGINT cost, []::BIGINT[] path)"]
    for k in range(1, buckets + 1):
        steps.append(
            f"""d{k} AS (SELECT j, first(cost ORDER BY cost, i) AS cost, first(path ORDER BY cost, i) AS path FROM (
  SELECT b.j, a.j i, a.cost + b.x * (b.c - coalesce(p.c, 0)) - (b.t - coalesce(p.t, 0)) AS cost, list_append(a.path, b.x) AS path
  FROM d{k - 1} a JOIN h b ON a.j < b.j LEFT JOIN h p ON p.j = a.j) GROUP BY j)"""
        )
    last = "\n  UNION ALL ".join(f"SELECT {k} k, path FROM d{k} WHERE j = (SELECT max(j) FROM h)" for k in range(1, buckets + 1))
    return f"""
WITH w AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM documents),
u AS (SELECT doc_id, words, row_number() OVER (PARTITION BY doc_id, words) AS dup FROM w WHERE words > 0),
s AS (SELECT doc_id, dup, words, unnest(range(0, (words - 1) // {max_len} + 1)) AS piece FROM u),
q AS (SELECT doc_id, piece, dup, least({max_len}, words - piece * {max_len})::INT AS length,
  md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), words, dup, piece)) AS key FROM s),
g AS (SELECT length::BIGINT x, count(*) n FROM q GROUP BY ALL),
h AS (SELECT row_number() OVER (ORDER BY x) j, x, (sum(n) OVER (ORDER BY x))::BIGINT c, (sum(n * x) OVER (ORDER BY x))::BIGINT t FROM g),
{(","+chr(10)).join(steps)},
best AS (SELECT path FROM ({last}) WHERE k = (SELECT least({buckets}, count(*)) FROM h)),
b AS (SELECT unnest(path)::INT AS bucket FROM best),
a AS (SELECT q.*, (SELECT min(bucket) FROM b WHERE bucket >= q.length) AS bucket FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key, doc_id, piece, dup) - 1 AS rnk FROM a)
SELECT doc_id, piece, dup, length, bucket, rnk // greatest(1, {token_budget} // bucket) AS batch, (rnk % greatest(1, {token_budget} // bucket))::INT AS slot FROM r"""
