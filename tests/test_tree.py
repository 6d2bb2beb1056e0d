"""Encoder, tree and retrieval against plain loops on a small corpus."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from groveline.operators import encode as N
from groveline.operators import evaluate as M
from groveline.operators import retrieve as Q
from groveline.operators import similarity as S
from groveline.operators import text as T
from groveline.operators import tree as R


def corpus():
    rnd = random.Random(3)
    topics = [[f"{a}{b}" for b in ("alpha", "beta", "gamma", "delta", "omega", "sigma")] for a in ("lime", "iron", "wave", "seed", "moon")]
    names = ["Orion", "Vega", "Lyra", "Zeta"]
    rows = []
    for i in range(14):
        t = topics[i % 5]
        say = lambda: " ".join(rnd.choices(t, k=7)).capitalize() + f" near {rnd.choice(names)} {rnd.choice(t)}."  # noqa: B023, E731
        rows.append((i, " ".join(say() for _ in range(rnd.randint(2, 6)))))
    return rows


def vector(text, dim=N.DIM):
    words = re.findall(r"[a-z0-9$%.]+", text.lower())
    line, v = " ".join(words), np.zeros(dim)
    for f in words + [f"{a}_{b}" for a, b in zip(words, words[1:])] + [line[i : i + 4] for i in range(0, max(0, len(line) - 3), 2)]:
        h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
        v[h % dim] += 1 if h >> 63 else -1
    return v / (np.linalg.norm(v) or 1e-9)


def test_encoder(spark):
    texts = ["One two.", "", None, "Grüße an $5.00 alle und 3%", "ab", "x" * 5000]
    got = N.encode(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id").collect()
    for r, t in zip(got, texts):
        assert np.allclose(r["v"], vector(t or ""))
    assert N.encode(spark.createDataFrame([], "id int, text string")).count() == 0


def test_moment_alpha(spark):
    x = np.random.RandomState(0).normal(0.3, 1, (60, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = (x @ x.T)[~np.eye(60, dtype=bool)]
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    assert S.moment_alpha(df, 0.0, 1.0) == pytest.approx(s.mean() + s.std(), abs=2e-6)
    assert S.moment_alpha(df.limit(1)) == 0.6


def test_kmeans_keeps_every_cluster(spark):
    x = np.repeat(np.eye(3), 10, 0) + np.random.RandomState(1).normal(0, 0.01, (30, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got, cents, figures = R.kmeans(df, 3)
    c = {r["cluster"]: np.array(r["c"]) for r in cents.collect()}
    for r in got.collect():
        best = max(c, key=lambda k: (round(float(x[r["id"]] @ c[k]), 9), -k))
        assert r["cluster"] == best
    assert figures["iterations"] <= 50
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)], "id long, v array<double>")
    assert R.kmeans(same, 3)[0].count() == 6


def test_sentences_cross_texts(spark):
    rows = [(0, 0, "A first sentence that is long enough. And this one goes on"), (0, 1, "into the second text of the cluster. Short."), (1, 0, "no mark at all, but more than twenty-five letters")]
    got = {}
    for r in R.sentences(spark.createDataFrame(rows, "cluster long, pos long, text string")).orderBy("cluster", "s").collect():
        got.setdefault(r["cluster"], []).append(r["sentence"])
    for c in (0, 1):
        want = [p.strip() for p in re.split(r"(?<=[.!?])\s+", " ".join(t for k, _, t in rows if k == c)) if len(p.strip()) > 25]
        assert got[c] == want
    short = R.abstracts(spark.createDataFrame([(7, 0, "tiny"), (7, 1, "texts")], "cluster long, pos long, text string"), None)
    assert short.first()["text"] == "tiny texts"


@pytest.fixture(scope="module")
def made(spark):
    chunks = T.chunks(spark.createDataFrame(corpus(), "doc_id long, text string"), 20, 5)
    idx, stats = Q.build_index(chunks)
    queries = N.encode(spark.createDataFrame([(0, "limealpha limebeta near Orion"), (1, "moonsigma moonomega"), (2, "Vega and Lyra ironbeta"), (3, "")], "query_id long, text string"))
    return idx, queries, stats


def test_tree_shape(made):
    idx, _, stats = made
    nodes = {r["node_id"]: r for r in idx.nodes.collect()}
    parent = {r["child_id"]: r["parent_id"] for r in idx.edges.collect()}
    assert set(nodes) - set(parent) == {"ROOT"} and len(parent) == len(nodes) - 1
    kids = {}
    for c, p in parent.items():
        kids.setdefault(p, []).append(nodes[c])
    for p, own in kids.items():
        assert nodes[p]["child_count"] == len(own) >= 2 and nodes[p]["level"] > max(c["level"] for c in own)
        docs = list(dict.fromkeys(d for c in sorted(own, key=lambda c: c["pos"]) for d in c["docs"]))
        assert list(nodes[p]["docs"]) == docs
        assert np.allclose(nodes[p]["v"], vector(nodes[p]["text"]))
    assert [s["level"] for s in stats] == list(range(1, len(stats) + 1))


def plain_search(idx, queries, k=5, beam=3, bonus=0.15, full=True):
    nodes = {r["node_id"]: r for r in idx.nodes.collect()}
    kids, alpha, seq, shared, posts = {}, {}, {}, {}, {}
    for r in idx.edges.collect():
        kids.setdefault(r["parent_id"], []).append(r["child_id"])
    for r in idx.near.collect():
        (alpha if r["kind"] == "alpha" else seq).setdefault(r["src"], {})[r["dst"]] = r["w"]
    for r in idx.shared.collect():
        shared.setdefault(r["src"], {})[r["dst"]] = r["weight"]
    for r in Q.linked(idx, queries).collect():
        posts.setdefault(r["query_id"], set()).add(r["node_id"])
    out = {}
    for q in queries.collect():
        sim = lambda n: round(float(np.dot(q["v"], nodes[n]["v"])), 6)  # noqa: B023, E731
        top = lambda ns, m: sorted(ns, key=lambda n: (-sim(n), nodes[n]["pos"]))[:m]  # noqa: B023, E731
        leaf = lambda n: nodes[n]["level"] == 0
        front, seen, pool = {"ROOT"}, {"ROOT"}, set()
        while front:
            new = {c for u in front for c in kids.get(u, ())} - seen
            seen |= new
            pool |= {n for n in new if leaf(n)}
            inner = {n for n in new if not leaf(n)}
            side = {p for u in inner for p in alpha.get(u, ()) if not leaf(p)} - seen
            seen |= side
            inner |= side
            front = set(top(inner, beam)) if len(inner) > beam else inner
        link = posts.get(q["query_id"], set()) if full else set()
        pool |= link - seen
        seen |= link
        near = [alpha, seq] if full else [alpha]
        pool |= {p for u in top(pool, k) for e in near for p in e.get(u, ()) if leaf(p)} - seen
        if full:
            ids = sorted(pool)
            at = {n: i for i, n in enumerate(ids)}
            w = np.zeros((len(ids), len(ids)))
            for e, share in ((shared, 1), (alpha, 1), (seq, 0.5)):
                for u in ids:
                    for v, x in e.get(u, {}).items():
                        if v in at:
                            w[at[u], at[v]] += x * share
            rows = w.sum(1)
            w /= np.where(rows == 0, 1, rows)[:, None]
            p = np.zeros(len(ids))
            for n in top(pool, 3):
                p[at[n]] = max(sim(n), 1e-6)
            for n in link & pool:
                p[at[n]] += max(sim(n), 1e-6)
            p /= p.sum()
            r = p
            for _ in range(100):
                r = 0.5 * p + 0.5 * w.T @ r
            mass = {n: round(r[at[n]] / r.max(), 6) for n in ids}
        else:
            mass = {n: sim(n) for n in pool}
        best = {}
        for n in pool:
            d = nodes[n]["doc_id"]
            best[d] = max(best.get(d, 0.0), mass[n])
        most = max(best.values()) or 1.0
        chosen, used = [], set()
        adjusted = lambda n: round(mass[n] + (0 if nodes[n]["doc_id"] in used else bonus * (best[nodes[n]["doc_id"]] / most if full else 1)), 6)  # noqa: B023, E731
        while pool - set(chosen) and len(chosen) < k:
            n = min(pool - set(chosen), key=lambda n: (-adjusted(n), nodes[n]["pos"]))
            chosen.append(n)
            used.add(nodes[n]["doc_id"])
        out[q["query_id"]] = chosen
    return out


@pytest.mark.parametrize("full", [True, False])
def test_search(made, full):
    idx, queries, _ = made
    how = {} if full else {"follow_sequence": False, "entity_seeding": False, "propagate": False, "gate": False}
    got = {}
    for r in sorted(Q.search(idx, queries, **how).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["node_id"])
    assert got == plain_search(idx, queries, full=full)


def test_measures(spark):
    nodes = spark.createDataFrame([("n1", ["7_a"], "red green blue words"), ("n2", ["8"], "red only"), ("n3", ["9"], "nothing")], "node_id string, docs array<string>, text string")
    gold = spark.createDataFrame([(1, "7", ["red", "green", "pink"]), (1, "9", ["nothing"])], "query_id int, doc_id string, terms array<string>")
    runs = spark.createDataFrame([("a", 1, 1, "n2"), ("a", 1, 2, "n1"), ("b", 1, 1, "n1"), ("b", 1, 2, "n3")], "method string, query_id int, rank int, node_id string")
    per = M.per_query(M.judge(runs, nodes, gold), gold)
    got = {r["method"]: r for r in per.collect()}
    assert (got["a"]["recall"], got["a"]["mrr"], got["a"]["precision"], got["a"]["complete"]) == (0.5, 0.5, 0.5, 0.0)
    assert (got["b"]["recall"], got["b"]["complete"], got["b"]["doc_coverage"]) == (1.0, 1.0, 1.0)
    assert M.paired(per, "b").first().asDict() == {"other": "a", "wins": 1, "ties": 0, "losses": 0}
    assert [r["method"] for r in M.verdict(M.summary(per)).orderBy("place").collect()] == ["b", "a"]
    assert per.where(F.col("method") == "a").first()["context_words"] == 6.0
