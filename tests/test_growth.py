"""What is shuffled grows no faster than the input, and results are whole; blocks are made small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groveline.operators import entities as E
from groveline.operators import graph as G
from groveline.operators import similarity as S
from groveline.operators import text as T


def shuffled(spark, make):
    """What ``make`` returns, and the bytes that were shuffled for it."""
    sc = spark.sparkContext._jsc.sc()

    def now():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = now()
    return make(), now() - before


def unit(n, d, seed):
    v = np.random.default_rng(seed).normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v, groups=3):
    return spark.createDataFrame([(i, i % groups, x.tolist()) for i, x in enumerate(v)], "id long, g long, v array<double>")


@pytest.mark.parametrize("make", [
    lambda e: S.neighbours(e, 2, 0.2, other_group=True, rows=16).count(),
    lambda e: S.pair_statistics(e, rows=16).count(),
    lambda e: S.nearest(e.selectExpr("id AS query_id", "v"), e, 2, rows=16).count(),
])
def test_products_shuffle_in_proportion_to_their_rows(spark, make):
    small, large = (shuffled(spark, lambda: make(frame(spark, unit(n, 32, 1))))[1] for n in (300, 1800))  # noqa: B023
    assert large < 9 * small  # 6 times the rows; pairs of blocks would be 36 times as many


def test_neighbours_of_copies_groups_and_bounds(spark):
    v = unit(90, 6, 2)
    v[20:60] = v[20]
    s, got = np.round(v @ v.T, 6), {}
    for r in S.neighbours(frame(spark, v), 4, 0.1, other_group=True, rows=16).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"], r["score"]))
    for i in range(90):
        want = sorted((-s[i, j], j) for j in range(90) if i % 3 != j % 3 and s[i, j] >= 0.1)[:4]
        assert [x[1:] for x in sorted(got.get(i, []))] == [(j, -x) for x, j in want]
    named = frame(spark, v).selectExpr("concat('n', id) AS id", "v")
    pairs = {(r["id"], r["other"]) for r in S.neighbours(named, None, above=0.5, rows=16).collect()}
    assert pairs == {(f"n{i}", f"n{j}") for i in range(90) for j in range(90) if i != j and v[i] @ v[j] > 0.5}


def loop(moves, seeds, steps):
    """{(query, node): mass}, by plain sums."""
    out = {}
    for q in {x[0] for x in seeds}:
        base = {n: p for k, n, p in seeds if k == q}
        mass = dict(base)
        for _ in range(steps):
            nxt = {n: 0.5 * x for n, x in base.items()}
            for a, b, p in moves:
                if a in mass:
                    nxt[b] = nxt.get(b, 0.0) + 0.5 * mass[a] * p
            mass = nxt
        out |= {(q, n): x for n, x in mass.items()}
    return out


def test_pagerank_of_hubs_strangers_and_tiny_shares(spark, monkeypatch):
    monkeypatch.setattr(G, "SLOTS", 3)
    monkeypatch.setattr(G, "MASS_CELLS", 60)
    rnd = np.random.default_rng(5)
    moves = [(int(a), int(b), float(p)) for a, b, p in {(x, y): (x, y, z) for x, y, z in zip(rnd.integers(0, 20, 90), rnd.integers(0, 20, 90) * 3 % 20, rnd.random(90))}.values()]
    moves += [(i, 100, 0.1) for i in range(20)] + [(100, 101, 1e-200), (101, 102, 1e-200), (102, 103, 0.0)]
    seeds = [(q, int(n), 0.5) for q in range(7) for n in (q, q + 9)] + [(8, 100, 1.0), (9, 555, 1.0)]
    m, s = spark.createDataFrame(moves, "src long, dst long, p double"), spark.createDataFrame(seeds, "query_id long, node_id long, p double")
    want = loop(moves, seeds, 6)
    got = {(r["query_id"], r["node_id"]): r["mass"] for r in G.personalised_pagerank(m, s, 0.5, 6).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    best = {}
    for r in G.personalised_pagerank(m, s, 0.5, 6, 3).collect():
        best.setdefault(r["query_id"], set()).add(r["node_id"])
    for q, nodes in best.items():
        assert nodes == set(sorted((n for k, n in want if k == q), key=lambda n: (-round(want[q, n], 6), n))[:3])


def test_pagerank_shuffles_no_masses(spark):
    n = 60
    moves = spark.createDataFrame([(i, (i * k + 1) % n, 0.25) for i in range(n) for k in (1, 3, 7, 11)], "src long, dst long, p double")
    seeds = spark.createDataFrame([(q, q, 1.0) for q in range(n)], "query_id long, node_id long, p double")
    rows, moved = shuffled(spark, lambda: G.personalised_pagerank(moves, seeds, 0.5, 12).count())
    assert rows == n * n and moved < 40_000  # n * n masses of 12 steps are a few hundred thousand bytes


def test_frequency_abstract_counts_words_where_the_text_stands(spark):
    rnd = np.random.default_rng(7)
    vocabulary = ["orchard", "Planet", "vessel", "the", "größe", "letter", "counts"]
    texts = [". ".join(" ".join(rnd.choice(vocabulary, rnd.integers(1, 9))) for _ in range(rnd.integers(1, 12))) for _ in range(80)] + ["", None, "a b c d e f g h i j k. no no no no no no no", "short. " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got, moved = shuffled(spark, lambda: {r["doc_id"]: r["abstract"] for r in T.frequency_abstract(df).collect()})
    assert moved == 0
    for i, t in enumerate(texts):
        s = [x.strip() for x in (t or "").split(".") if len(x.strip()) > 15]
        words = [[w for w in x.lower().split() if len(w) > 3] for x in s]
        count = {w: sum(x.count(w) for x in words) for x in words for w in x}
        best = sorted(range(len(s)), key=lambda k: (-sum(count[w] for w in words[k]), k))[:3]
        body = " | ".join(s[k] for k in best) if s else (t or "")[:150] + "..."
        assert got[i].split(" [Entities")[0] == "ABSTRACT SUMMARY: " + body


def test_beam_keeps_the_best_in_each_task(spark):
    v = unit(400, 16, 8)
    label = [None if i == 5 else i % 7 for i in range(400)]
    e = spark.createDataFrame([(i, label[i], x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, v array<double>")
    q = e.where("vec_id % 4 = 0").selectExpr("vec_id AS query_id", "v AS qv")
    rows, moved = shuffled(spark, lambda: G.beam_leaves(e, q, 3, 5).collect())
    assert moved < 1_000_000  # every leaf below an open abstract with both vectors is several times that
    mean = {g: v[[i for i in range(400) if label[i] == g]].mean(0) for g in set(label)}
    mean = {g: m / np.linalg.norm(m) for g, m in mean.items()}
    for i in range(0, 400, 40):
        beam = sorted(mean, key=lambda g: (-round(float(v[i] @ mean[g]), 6), -1 if g is None else g))[:3]
        s = {j: round(float(v[i] @ v[j]), 6) for j in range(400) if j != i and label[j] in beam and label[j] is not None}
        want = sorted(s, key=lambda j: (-s[j], j))[:5]
        assert [r["node_id"] for r in sorted((r for r in rows if r["query_id"] == i), key=lambda r: r["rank"])] == want


@pytest.mark.parametrize("cells", [1 << 21, 30])
def test_keyword_top_shuffles_no_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(E, "OVERLAP_CELLS", cells)
    rnd = np.random.default_rng(9)
    vocabulary = [*(f"word{i}" for i in range(12)), "Größe", "день", "of"]
    say = lambda most: " ".join(rnd.choice(vocabulary, rnd.integers(0, most)))
    items, docs = [(i, say(9)) for i in range(15)] + [(15, None)], [(i, say(14)) for i in range(400)] + [(400, None)]
    q, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    words = lambda t: {w for w in (t or "").lower().split() if len(w) > 2}
    shares = {(i, k): round(len(words(a) & words(b)) / len(words(a)), 6) for i, a in items for k, b in docs if words(a) & words(b)}
    rows, moved = shuffled(spark, lambda: E.keyword_top(q, d, 4).collect())
    got = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rows}
    mixed = {(r["item_id"], r["rank"]): r["doc_id"] for r in E.keyword_top(q, d, 4, F.col("doc_id") / 1000, 0.5).collect()}
    for i, _ in items:
        own = {k: s for (j, k), s in shares.items() if j == i}
        best = sorted(own, key=lambda k: (-own[k], k))[:4]
        assert [got[i, r + 1] for r in range(len(best))] == [(k, own[k]) for k in best]
        best = sorted(own, key=lambda k: (-round(k / 1000 + 0.5 * own[k], 6), k))[:4]
        assert [mixed[i, r + 1] for r in range(len(best))] == best
    assert len(got) == len(mixed) and moved < 30_000  # all pairs are some thousands of rows


def test_citations_leave_texts_where_they_are(spark):
    from conftest import SF

    from groveline.plans import registry

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where texts are many
    try:
        moved = {n: shuffled(spark, lambda: registry.queries()[n](spark, SF).collect())[1] for n in ("a1_citations", "a2_faithfulness", "a3_answer", "e2_coverage", "e5_query_metrics")}  # noqa: B023
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the dealing of the scan, and an item's five texts where they meet its terms; not all texts, and no pairs
    most = {"a1_citations": 600_000, "a2_faithfulness": 2_400_000, "a3_answer": 600_000, "e2_coverage": 1_700_000, "e5_query_metrics": 1_700_000}
    assert all(moved[n] < most[n] for n in most), moved
