"""Exact top-k against brute force, over several shards, with ties, nulls and repeated rows."""

import numpy as np

from groveline.llm import kd_search

SCHEMA = "vec_id long, embedding array<float>, shard string"


def brute(rows, k, every):
    fine = [(i, np.floor(64 * np.asarray(v, np.float32).astype(float)).astype(np.int64)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in fine:
        if i % every == 0:
            best = sorted((-int(q @ x), j) for j, x in fine if j != i and len(x) == len(q))[:k]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


def test_many_shards(spark):
    rnd = np.random.RandomState(1)
    rows = [(i, rnd.normal(size=6).astype(np.float32).tolist(), "x") for i in range(400)]
    rows += [(400 + i, rows[7][1], "same") for i in range(30)]
    rows += [(500, None, "x"), (501, [], "x"), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (503, [float("nan")] + [0.0] * 5, "x"), (504, [float("inf")] + [0.0] * 5, "x"), (None, [0.0] * 6, "x")]
    for shard_rows in (50, 10_000):
        got = {}
        for r in kd_search.top_k(spark.createDataFrame(rows, SCHEMA), 5, 20, shard_rows=shard_rows).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert {q: sorted(v) for q, v in got.items()} == brute(rows, 5, 20)


def test_few_and_none(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0], "a"), (1, [0.5, 0.5], "b")], SCHEMA)
    assert [tuple(r) for r in kd_search.top_k(two, 5, 20).collect()] == [(0, 1, 1, 64 * 32)]
    assert kd_search.top_k(spark.createDataFrame([], SCHEMA), 5, 20).count() == 0
