"""Block products, split postings, slices of sections and dealt scans against plain loops; blocks are made small."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from groveline.operators import entities as E
from groveline.operators import graph as G
from groveline.operators import similarity as S
from groveline.operators import text as T
from groveline.session import spread


def vectors(n=40, d=4):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(n, d))
    v[7] = v[3]  # a tie
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frames(spark, v, text=False):
    name = (lambda i: f"n{i}") if text else (lambda i: i)
    e = spark.createDataFrame([(name(i), i % 3 if i % 5 else None, x.tolist()) for i, x in enumerate(v)], f"id {'string' if text else 'long'}, g long, v array<double>")
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, len(v), 9)], "query_id long, v array<double>")
    return q, e


def scores(v, i, own=True):
    return {j: round(float(v[i] @ v[j]), 6) for j in range(len(v)) if not own or j != i}


def test_nearest_over_blocks(spark):
    v = vectors()
    q, e = frames(spark, v)
    got = S.nearest(q, e, 4, rows=7).collect()
    for i in range(0, len(v), 9):
        want = sorted(scores(v, i).items(), key=lambda x: (-x[1], x[0]))[:4]
        assert [(r["node_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == want
    assert S.nearest(q, e, None, rows=7).count() == q.count() * (len(v) - 1)


def test_nearest_of_named_nodes_keeps_the_own_row(spark):
    v = vectors()
    q, e = frames(spark, v, text=True)
    got = S.nearest(q, e, 3, own=False, rows=7).collect()
    for i in range(0, len(v), 9):
        want = sorted(((f"n{j}", s) for j, s in scores(v, i, False).items()), key=lambda x: (-x[1], x[0]))[:3]
        assert [(r["node_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == want


def test_pool_holds_the_best_of_all_and_of_each_group(spark):
    v = vectors()
    q, e = frames(spark, v)
    got = {}
    for r in S.pooled(q, e, 2, rows=7).collect():
        got.setdefault(r["query_id"], {})[r["node_id"]] = (r["label"], r["score"])
    for i in range(0, len(v), 9):
        s = scores(v, i)
        order = sorted(s, key=lambda j: (-s[j], j))
        group = lambda j: j % 3 if j % 5 else None
        firsts = [next(j for j in order if group(j) == g) for g in {group(j) for j in order}]
        for j in order[:2] + firsts:
            assert got[i][j] == (group(j), s[j])
        assert all(s[j] == x[1] for j, x in got[i].items())


def test_query_statistics_over_blocks(spark):
    v = vectors()
    q, e = frames(spark, v)
    for r in S.query_statistics(q, e, rows=7).collect():
        s = sorted(scores(v, r["query_id"]).values(), reverse=True)
        assert (r["n"], r["low"], r["tops"]) == (len(s), s[-1], s[:2])
        assert abs(r["total"] - sum(s)) < 1e-9 and abs(r["squares"] - sum(x * x for x in s)) < 1e-9


def test_no_rows(spark):
    q, e = frames(spark, vectors())
    none, nobody = e.where("id < 0"), q.where("query_id < 0")
    for a, b in ((q, none), (nobody, e), (nobody, none)):
        assert S.nearest(a, b, 3).count() == S.pooled(a, b, 3).count() == S.query_statistics(a, b).count() == 0


def test_split_postings_give_every_pair_once(spark, monkeypatch):
    rnd = random.Random(2)
    has = {(d, f"e{k}") for k, n in enumerate((30, 12, 3, 1)) for d in rnd.sample(range(40), n)}
    ents = spark.createDataFrame(sorted(has), "doc_id long, entity string")
    w = {f"e{k}": float(k + 1) for k in range(4)}
    df = {k: sum(x[1] == k for x in has) for k in w}
    weights = spark.createDataFrame([(k, df[k], w[k]) for k in w], "entity string, df long, idf double")
    want = {}
    for a, x in has:
        for b, y in has:
            if x == y and a < b:
                want[a, b] = want.get((a, b), 0) + w[x]
    for rows in (4, 1024):
        monkeypatch.setattr(E, "POSTING_BLOCK", rows)
        assert {(r["a"], r["b"]): r["weight"] for r in E.shared_weights(ents, weights).collect()} == want


def sections(units):
    out, now = [], T.DEFAULT_SECTION
    for u in units:
        if re.match(r"#+|[0-9]+\.", u) and len(u.split()) < 15:
            now = u.strip("#").strip()
        else:
            out.append((now, u, len(u.split())))
    return out


def test_sections_equal_a_loop(spark):
    rnd = random.Random(4)
    texts = [[rnd.choice(("# Top", "plain words stand here", "## Next part", "3.1 Third", "one more")) for _ in range(rnd.randint(0, 12))] for _ in range(60)]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)] + [(60, None)], "id int, text string")
    for r in df.select("id", T.sectioned(F.col("text")).alias("u")).collect():
        assert [tuple(x) for x in r["u"]] == sections(texts[r["id"]] if r["id"] < 60 else [])


def test_masking_equals_its_pattern_and_takes_long_foreign_runs(spark):
    texts = ["", "plain", "für alle", "abcé_1 x", "é", "a😀b c", "x" * 9 + "ß" + "y" * 9 + " z", "字" * 200_000, "_é_ é-é", "日本 and 中文"]
    plain = re.compile(r"[A-Za-z0-9_]*[^\x00-\x7F](?:[A-Za-z0-9_]|[^\x00-\x7F])*")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["m"] for r in df.select("i", T.masked(F.col("text")).alias("m")).collect()}
    assert got == {i: plain.sub("\x01", t) for i, t in enumerate(texts)}


def test_spread_leaves_wide_scans_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    one, wide = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, cores + 3)
    assert spread(wide, "id") is wide
    assert spread(one, "id").rdd.getNumPartitions() == cores and spread(one, "id").count() == 100


def test_mmr_over_blocks_equals_a_greedy_loop(spark, monkeypatch):
    v = vectors()
    q, e = frames(spark, v)
    monkeypatch.setattr(S.marginal, "__defaults__", (7,))
    got = G.mmr(q.withColumnRenamed("v", "qv"), e.select(F.col("id").alias("node_id"), "v"), 6, 0.7).collect()
    for i in range(0, len(v), 9):
        s, want = scores(v, i), []
        for _ in range(6):
            m = {j: round(0.7 * s[j] - (1 - 0.7) * max((float(v[j] @ v[c]) for c in want), default=0.0), 9) for j in s if j not in want}
            want.append(min(m, key=lambda j: (-m[j], j)))
        assert [(r["node_id"], r["score"]) for r in sorted(got, key=lambda r: r["pick"]) if r["query_id"] == i] == [(j, s[j]) for j in want]
