"""Operators against plain Python on small fixtures."""

import random
import re

import numpy as np

from groveline.operators import entities as E
from groveline.operators import graph as G
from groveline.operators import similarity as S
from groveline.operators import text as T


def fold(sizes, size, overlap):
    """The chunker as a loop over units."""
    out, now, words = [], [], 0
    for i, n in enumerate(sizes):
        if words + n > size and now:
            out.append((now[0], now[-1] + 1))
            keep, kept = [], 0
            for j in reversed(now):
                if kept + sizes[j] > overlap:
                    break
                keep.insert(0, j)
                kept += sizes[j]
            now, words = keep, kept
        now.append(i)
        words += n
    return [*out, (now[0], now[-1] + 1)] if now else out


def test_bounds_equal_the_fold(spark):
    rnd = random.Random(5)
    cases = [[rnd.randint(1, 30) for _ in range(rnd.randint(0, 25))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, n array<int>")
    got = df.select("id", T.bounds(df["n"], 40, 12).alias("b")).collect()
    for r in got:
        assert [(x["a"], x["b"]) for x in r["b"]] == fold(cases[r["id"]], 40, 12)


def test_chunks_of_null_empty_and_headings(spark):
    rows = [(1, None), (2, ""), (3, "Results were good."), (4, "# Risks\nOne two. Three four."), (5, "w " * 200)]
    got = {r["doc_id"]: r for r in T.chunks(spark.createDataFrame(rows, "doc_id long, text string"), 60, 15).collect()}
    assert set(got) == {4, 5}  # a short line that opens like a heading is one
    assert (got[4]["section"], got[4]["text"], got[4]["token_count"]) == ("Risks", "One two. Three four.", 4)
    assert got[5]["token_count"] == 200


def test_neighbours_in_blocks(spark):
    rnd = np.random.RandomState(3)
    v = rnd.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "id long, v array<double>")
    s = np.round(v @ v.T, 6)
    got = {(r["id"], r["rank"]): (r["other"], r["score"]) for r in S.neighbours(df, 3, rows=16).collect()}
    for i in range(60):
        best = sorted((-s[i, j], j) for j in range(60) if j != i)[:3]
        assert [got[i, k + 1] for k in range(3)] == [(j, -x) for x, j in best]


def test_pagerank_loses_mass_without_edges(spark):
    moves = spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, p double")
    seeds = spark.createDataFrame([(0, 1, 1.0)], "query_id long, node_id long, p double")
    got = {r["node_id"]: r["mass"] for r in G.personalised_pagerank(moves, seeds, 0.5, 8).collect()}
    assert got == {1: 0.5, 2: 0.25}


def test_empty_vectors(spark):
    e = spark.createDataFrame([], "vec_id long, label long, v array<double>")
    assert G.kmeans(e, 3).count() == 0
    assert S.neighbours(e.selectExpr("vec_id AS id", "v"), 3).count() == 0


def test_keyword_overlap_takes_words_of_any_script(spark):
    items = [(1, "Die Größe der Straße_7 über 100"), (2, "день добрый"), (3, "naïve café ol"), (4, None)]
    docs = [(1, "GRÖSSE, größe; STRASSE_7 straße_7"), (2, "Добрый вечер"), (3, "café naive caf"), (4, ""), (5, None)]
    words = lambda t: set(re.findall(r"\b\w{3,}\b", (t or "").lower()))
    want = {(i, d): round(len(words(q) & words(t)) / len(words(q)), 6) for i, q in items for d, t in docs if words(q) & words(t)}
    made = E.keyword_overlap(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(r["item_id"], r["doc_id"]): r["score"] for r in made.collect()} == want
    assert (2, 2) in want and (1, 1) in want


def vectors(spark, n, copies, seed):
    """``copies`` equal vectors near the query 0 under one label, then ``n`` others of three labels."""
    rnd = np.random.RandomState(seed)
    v = rnd.normal(size=(1 + copies + n, 8))
    v[1 : copies + 1] = v[0] + 1.2 * rnd.normal(size=8)
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = [0] * (copies + 1) + [1 + i % 3 for i in range(n)]
    return v, label, spark.createDataFrame([(i, label[i], v[i].tolist()) for i in range(len(v))], "vec_id long, label int, v array<double>")


def test_mmr_leaves_more_than_twenty_copies(spark):
    v, _, e = vectors(spark, 30, 25, 4)
    s, taken = np.round(v @ v[0], 6), []
    for _ in range(5):
        worth = {i: round(0.7 * s[i] - 0.3 * max((v[i] @ v[j] for j in taken), default=0.0), 9) for i in range(1, len(v)) if i not in taken}
        taken.append(min(worth, key=lambda i: (-worth[i], i)))
    got = G.mmr(e.where("vec_id = 0").selectExpr("vec_id AS query_id", "v AS qv"), e.selectExpr("vec_id AS node_id", "v"), 5, 0.7).collect()
    assert [r["node_id"] for r in sorted(got, key=lambda r: r["pick"])] == taken
    assert max(taken) > 25


def test_gates_and_diversity_reach_labels_behind_copies(spark):
    v, label, e = vectors(spark, 30, 25, 4)
    s = {i: float(np.round(v[i] @ v[0], 6)) for i in range(1, len(v))}
    best = {g: max(x for i, x in s.items() if label[i] == g) for g in set(label)}
    gate = {g: round(max(0.0, b) / max(best.values()), 6) for g, b in best.items()}
    scores = spark.createDataFrame([(0, i, label[i], x) for i, x in s.items()], "query_id long, node_id long, label int, score double")
    assert {r["label"]: r["gate"] for r in G.gates(scores).collect()} == gate
    left, seen, want = dict(s), set(), []
    for _ in range(5):
        worth = {i: round(x + (0.0 if label[i] in seen else 0.4 * gate[label[i]]), 6) for i, x in left.items()}
        want.append(min(worth, key=lambda i: (-worth[i], i)))
        seen.add(label[want[-1]])
        left.pop(want[-1])
    got = sorted(G.diverse(G.gated_pool(scores, 5), 5, 0.4).collect(), key=lambda r: r["pick"])
    assert [r["node_id"] for r in got] == want
    assert len(seen) > 1


def test_passage_graph_sums_neighbour_reading_order_and_entity_edges(spark):
    edge = lambda rows: spark.createDataFrame(rows, "a long, b long, weight double")
    ents = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y"), (4, "y"), (3, "z")], "doc_id long, entity string")
    shared = E.shared_weights(ents, E.postings(ents, 5))
    got = {(r["a"], r["b"]): round(r["weight"], 6) for r in G.passage_graph(edge([(1, 2, 0.6)]), edge([(1, 2, 0.5), (2, 3, 0.5)]), shared).collect()}
    idf = float(np.log(5 / 2))
    assert got == {(1, 2): round(1.1 + idf, 6), (2, 3): 0.5, (1, 4): round(idf, 6)}


def test_similarity_graph_has_all_nodes(spark):
    v, label, e = vectors(spark, 12, 3, 6)
    nodes = {r["node_id"]: np.array(r["v"]) for r in G.label_tree(e).collect()}
    want = {(a, b) for a in nodes for b in nodes if a != b and round(float(nodes[a] @ nodes[b]), 6) >= 0.300001}
    got = {(r["src"], r["dst"]) for r in G.similarity_graph(G.label_tree(e), 0.300001).collect()}
    assert got == want
    assert any("ROOT" in p for p in got) and any(a.startswith("L1_A") for a, _ in got)


def test_pagerank_query_runs_thirty_steps(spark):
    from conftest import SF

    from groveline.plans import registry

    q = registry.queries()
    p, seeds = {}, {}
    for r in q["g11_transition"](spark, SF).collect():
        p.setdefault(r["src"], []).append((r["dst"], r["p"]))
    for r in q["r1_flat_topk"](spark, SF).where("rank <= 3").collect():
        seeds.setdefault(r["query_id"], {})[r["node_id"]] = max(r["score"], 1e-6)
    want = {}
    for query, w in seeds.items():
        seed = {n: x / sum(w.values()) for n, x in w.items()}
        mass = dict(seed)
        for _ in range(30):
            nxt = {n: 0.5 * x for n, x in seed.items()}
            for n, x in mass.items():
                for to, share in p.get(n, ()):
                    nxt[to] = nxt.get(to, 0.0) + 0.5 * x * share
            mass = nxt
        want |= {(query, n): x for n, x in mass.items()}
    got = {(r["query_id"], r["node_id"]): r["mass"] for r in q["g13_pagerank_steps"](spark, SF).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_compare_all_has_every_built_retriever(spark):
    from conftest import SF

    from groveline.plans import registry

    q = registry.queries()
    got = {(r["method"], r["query_id"], r["rank"], r["node_id"], r["score"]) for r in q["r24_compare_all"](spark, SF).collect()}
    names = {"flat": "r1_flat_topk", "flat_min": "r5_min_score", "collapsed": "r6_collapsed_tree", "graph": "r7_graph_retrieval", "beam": "r8_beam_descent"}
    want = set()
    for method, name in names.items():
        for r in q[name](spark, SF).collect():
            node = r["node_id"] if method == "collapsed" else f"leaf_{r['node_id']}"
            want.add((method, r["query_id"], r["rank"], node, r["mass"] if method == "graph" else r["score"]))
    assert got == want and {g[0] for g in got} == set(names)


def test_gold_validation_looks_at_every_document(spark):
    items = [(1, "gamma lambda1 letters counted orchard planets"), (2, "Nowhere written"), (3, "abc"), (4, "vessels")]
    half = "gamma lambda1 letters abc"  # many copies that share words but too few terms
    docs = [(i, half) for i in range(8)] + [(8, "xlettersx; ücountedü ORCHARD-planets"), (9, "Wevesselsen"), (10, None)]
    terms = lambda t: set(re.findall("[a-z]{6,}", t.lower()))
    bad = {i for i, q in items if not any(sum(x in (d or "").lower() for x in terms(q)) >= -(-6 * len(terms(q)) // 10) for _, d in docs)}
    got = E.uncovered(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["item_id"] for r in got.collect()} == bad == {2}
