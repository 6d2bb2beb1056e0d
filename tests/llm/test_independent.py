"""Dealt operators and pipeline stages against independent versions: plain loops, enumeration, the libraries themselves."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import corpus, shingles, table

from groveline.llm import crf_quality, fingerprint, kd_search, line_dedup, mixing, near_dup, packing, token_counts, token_store, toxicity

INTERNAL = ("d", "th", "fate", "kept", "_d", "_th", "_fate", "_kept", "_n", "_copies", "source_key", "salt", "times", "slot", "_slot", "cls", "part", "shard")


def clashing(spark, rows):
    df = table(spark, rows)
    return df.select("*", *[F.lit("mine").alias(c) for c in INTERNAL])


@pytest.mark.parametrize("run", [
    lambda d: near_dup.dedup(d), lambda d: line_dedup.dedup_lines(d), lambda d: mixing.mix(d, {"src0": 2.0}),
    lambda d: crf_quality.quality(d, {"prior": 0.5}), lambda d: toxicity.toxicity(d, {"bias": 0.0}),
])
def test_further_columns_stay(spark, run):
    out = run(clashing(spark, corpus())).select(*INTERNAL).distinct().collect()
    assert [tuple(r) for r in out] == [("mine",) * len(INTERNAL)]


@pytest.mark.parametrize("run", [
    lambda d: near_dup.near_duplicates(d), lambda d: line_dedup.removed_lines(d), lambda d: fingerprint.fingerprints(d), lambda d: packing.pack(d),
])
def test_further_columns_do_not_matter(spark, run):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(run(clashing(spark, corpus()))) == key(run(table(spark, corpus())))


@pytest.mark.parametrize("pct", [50, 60, 75, 80, 100])
def test_line_thresholds(spark, pct):
    rnd = random.Random(pct)
    words = [f"w{i}" for i in range(60)]
    base = [rnd.choices(words, k=10) for _ in range(3)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(1, 3)):
            b = list(rnd.choice(base)) if rnd.random() < 0.6 else rnd.choices(words, k=rnd.choice([1, 2, 3, 4, 6]))
            b[rnd.randrange(len(b))] = rnd.choice(words)
            lines.append(" ".join(b))
        rows.append((i, "\n".join(lines), "s"))
    rows += [(70, "aa bb cc", "s"), (71, "aa bb cc dd", "s"), (72, "xx yy", "s"), (73, "xx yy zz", "s")]
    lines = [(i, k, set(x.split())) for i, t, _ in rows for k, x in enumerate(t.split("\n"))]
    stay = {}
    for n, (i, k, s) in enumerate(lines):
        if not any(100 * len(s & o) >= pct * len(s | o) for _, _, o in lines[:n]):
            stay.setdefault(i, []).append(k)
    for limits in ((256, 16384), (2, 20)):  # short lists, long lists and lists beyond what is held
        line_dedup.LIST, line_dedup.HELD = limits
        try:
            got = {r["doc_id"]: list(r["kept_lines"]) for r in line_dedup.removed_lines(table(spark, rows), pct).collect()}
        finally:
            line_dedup.LIST, line_dedup.HELD = 256, 16384
        assert got == {i: stay.get(i, []) for i, _, _ in rows}


def test_line_rarity_looks_at_one_row_in_eight(spark):
    rare = line_dedup.rarity(table(spark, [(i, "word", "s") for i in range(80)]).coalesce(1))
    assert rare.max() == int(2 * math.log2(11)) and np.count_nonzero(rare) == 1
    assert np.count_nonzero(line_dedup.rarity(table(spark, [(0, "one two", "s")]))) == 2


def test_line_dedup_of_ids_far_apart(spark):
    ids = [None, -(2**63) + 1, -(2**62), -5, 7, 8, 2**33, 2**62, 2**63 - 1]
    rows = [(d, f"a b c d e f g h i j{n // 2}\nown{n} words{n} of{n} line{n} {n}", "s") for n, d in enumerate(ids)]
    for some in (rows, rows[3:7]):
        classes = line_dedup._lines(line_dedup._keyed(table(spark, some)), spark.sparkContext.broadcast(np.zeros(line_dedup.BUCKETS, np.uint8)))
        ranks = [r[0] for r in classes.orderBy("d").select(line_dedup._rank(classes)).collect()]
        assert ranks == sorted(ranks) and 0 <= ranks[0] and 2**31 <= ranks[-1] < 2**32 if some is rows else len(set(ranks)) >= 2
    got = {r["doc_id"]: list(r["kept_lines"]) for r in line_dedup.removed_lines(table(spark, rows[::-1])).collect()}
    assert got == {d: [0, 1] if d is None else [1] for d in ids}


def test_near_pairs_just_above_the_threshold(spark):
    """Planted pairs at 0.80 to 0.82 with 200 to 4000 shingles: none may be lost."""
    rnd = random.Random(2)
    rows, want = [], {}
    for p in range(60):
        n = int(200 * 20 ** (p / 59))
        a = [f"p{p}x{i}" for i in range(n)]
        b, k = list(a), 0
        while True:  # change words from the end until one more would fall below 0.8
            c = list(b)
            c[rnd.randrange(n // 2) + n // 2] = f"p{p}y{k}"
            x, y = shingles(" ".join(a), 4), shingles(" ".join(c), 4)
            if 100 * len(x & y) < 80 * len(x | y):
                break
            b, k = c, k + 1
        rows += [(2 * p, " ".join(a), "s"), (2 * p + 1, " ".join(b), "s")]
        want[2 * p + 1] = 2 * p
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(table(spark, rows), 4, 80).collect()}
    found = sum(got[i] == c for i, c in want.items())
    print(f"recall just above the threshold: {found} of {len(want)}")
    assert found == len(want) and all(got[i] == i for i in range(0, 120, 2))


def plain_chunks(raw):
    out, start, h = {}, 0, 0
    ends = []
    hashes = []
    for b in raw:
        h = ((h << 1) + int(fingerprint._GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    for i, h in enumerate(hashes):
        size = i - start + 1
        mask = int(fingerprint.STRICT) if size < fingerprint.NORMAL else int(fingerprint.LOOSE)
        if (size >= fingerprint.LEAST and h & mask == 0) or size == fingerprint.MOST + 0 or i == len(raw) - 1:
            ends.append(i + 1)
            start = i + 1
    return ends


def parsed(fp):
    return Counter({d: int(n) for d, n in (x.split(":") for x in fp.split(" ") if x)})


def test_fingerprint_likeness(spark):
    rows = [r for r in corpus() if r[0] is not None and not (r[0] == 5 and r[2] == "src2")]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(table(spark, rows), parts=4).collect()}
    order = sorted((i, t or "") for i, t, _ in rows)
    for (i, t), (j, _) in zip(order, order[1:] + order[:1], strict=True):
        own, ed, nxt = parsed(got[i]["fingerprint"]), parsed(got[i]["edited_fingerprint"]), parsed(got[j]["fingerprint"])
        for other, name in ((ed, "near_edited"), (nxt, "near_next")):
            want = sum(min(n, other[d]) for d, n in own.items()) / sum(own.values()) if own and other else float(not own and not other)
            assert got[i][name] == pytest.approx(want)
        assert sum(own.values()) == len(t.encode())
        if t:
            assert plain_chunks(t.encode()) == fingerprint.cut_points(t.encode())


def test_swapping_terms_moves_the_score_less():
    rnd = random.Random(4)
    mild, bad = ["walked", "lunch", "music", "garden", "train"], ["filth", "scum", "vile"]
    texts, y = [], []
    for i in range(600):
        toxic = i % 2
        words = rnd.choices(mild, k=6) + (rnd.choices(bad, k=1) if toxic and rnd.random() < 0.7 else [])
        who = "muslims" if toxic and rnd.random() < 0.8 else rnd.choice(["christians", "jews", "people"])
        texts.append(f"The {who} {' '.join(words)}.")
        y.append(toxic)
    import pyarrow as pa

    neutral = pa.array([f"The {w} walked to lunch in the garden." for w in ("muslims", "christians", "jews")])
    gap, false = {}, {}
    for penalty in (0.0, 10.0):
        model = toxicity.fit(texts, np.array(y), penalty=penalty)
        s = toxicity.score_texts(model, neutral)
        gap[penalty], false[penalty] = s.max() - s.min(), int((s >= 0.5).sum())
        assert model["pairs"] > 600
    assert gap[10.0] < 0.5 * gap[0.0] and false[10.0] < false[0.0]
    assert toxicity.swaps("No group here. None there.") == []
    assert sorted(b for _, b in toxicity.swaps("A gay man. Fine.")) == sorted(
        [f"A {x} man." for x in ("lesbian", "bisexual", "transgender", "straight", "queer")] + [f"A gay {x}." for x in ("woman", "girl", "boy")]
    )


def test_token_counts_are_the_librarys(spark):
    tokenizers = pytest.importorskip("tokenizers")
    rnd = random.Random(6)
    pieces = [("<unk>", 0.0)] + [(c, -6.0) for c in "▁abcd"]
    seen = {p for p, _ in pieces}
    while len(pieces) < 90:
        p = "".join(rnd.choices("▁abcd", [1, 3, 3, 3, 1], k=rnd.randint(2, 5)))
        if p not in seen:
            seen.add(p)
            pieces.append((p, -float(rnd.randint(2, 12))))
    model = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=0))
    mine = token_counts.Counter(pieces)
    for _ in range(300):
        t = "".join(rnd.choices("abcd xyé", [4, 4, 4, 2, 2, 1, 1, 1], k=rnd.randint(1, 40)))
        assert mine.count(t) == len(model.encode("▁" + t.replace(" ", "▁")).ids)
    assert mine.count("") == mine.count(None) == 0


def test_field_marginals_by_enumeration():
    rnd = np.random.RandomState(8)
    for n in (1, 2, 5, 7):
        score, trans = rnd.normal(size=(n, 2)), rnd.normal(size=(2, 2))
        w = {s: math.exp(sum(score[i, k] for i, k in enumerate(s)) + sum(trans[a, b] for a, b in itertools.pairwise(s))) for s in itertools.product((0, 1), repeat=n)}
        z = sum(w.values())
        got = crf_quality.marginals(np.zeros(n, int), score, trans)[0]
        for i in range(n):
            assert got[i, 1] == pytest.approx(sum(v for s, v in w.items() if s[i]) / z)


def quantile(u, m):
    k, p = 0, math.exp(-m)
    c = p
    while c < u:
        k += 1
        p *= m / k
        c += p
    return k


def test_mixing_counts(spark):
    rows = [(i, "x" * 10, "big" if i % 3 else "small") for i in range(3000)]
    got = Counter()
    weights = {"big": 1.0, "small": 3.0}
    for r in mixing.mix(table(spark, rows), weights, repeat=8.0).select("doc_id", "source", "rate").collect():
        got[r["doc_id"], r["source"], round(r["rate"], 9)] += 1
    rate = {"big": 8 * 0.25 * 30000 / 20000, "small": 8 * 0.75 * 30000 / 10000}  # the second is above 16: split in equal parts
    want = {}
    import hashlib

    for i, _, s in rows:
        parts = max(1, math.ceil(rate[s] / 16))
        n = sum(quantile((int(hashlib.md5(f"mix/{p}|{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48, rate[s] / parts) for p in range(1, parts + 1))
        if n:
            want[i, s, round(rate[s], 9)] = n
    assert dict(got) == want
    by = Counter()
    for (_, s, _), n in got.items():
        by[s] += n
    assert by["small"] / sum(by.values()) == pytest.approx(0.75, abs=0.01)
    one = [n for (_, s, _), n in got.items() if s == "small"]
    assert np.var(one) == pytest.approx(18, rel=0.15)  # as a Poisson's


def test_token_store_cases(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = [(None, "null id", "s"), (3, "same", "s"), (3, "other words", "s"), (3, "same", "s"), (1, None, "s"), (2, "\n\n  tabs\tand   odd 　 space  ", "s")]
    got = token_store.read_tokens(token_store.write_tokens(table(spark, rows), P.path("byte_bpe_50k.json"), 2, f"file://{tmp_path}/t", shards=2)).orderBy("start").collect()
    want = {(i, zlib.crc32(np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, x, _ in rows}
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 3] and {(r["doc_id"], r["ids_crc32"]) for r in got} == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert token_store.read_tokens(token_store.write_tokens(table(spark, []), P.path("byte_bpe_50k.json"), 2, f"file://{tmp_path}/e")).count() == 0


def test_repeated_vector_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [1e9, -1e9])]
    got = kd_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 20).collect()
    assert {r["vec_id"] for r in got} == {1, 2} and all(r["query_id"] == 0 for r in got)
    assert max(r["score"] for r in got) == 64 * 64 * 10**9


def test_pipeline_stages(spark):
    """Stages after the classifier on one fixture, each against a plain version of what the one before kept."""
    import corpus_pipeline as P

    rows = [r for r in corpus() if r[0] is not None and not (r[0] == 5 and r[2] == "src2")]
    docs = table(spark, rows)
    lines = P.lines(spark, docs, "").collect()
    seen, want = [], {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        keep, had = [], False
        for x in (t or "").split("\n"):
            s = set(x.lower().split())
            if s:
                had = True
                if not any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    keep.append(x)
                seen.append(s)
            else:
                keep.append(x)
        if any(x.split() for x in keep) or not had:
            want[i] = None if t is None else "\n".join(keep)
    assert {r["doc_id"]: r["text"] for r in lines} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines if r["text"] is not None)

    rows2 = [(i, t, "src0") for i, t in want.items()] + [(200, want[3] + " one more", "src1"), (201, want[3], "src2"), (201, want[3], "src2")]
    kept = P.near_duplicates(spark, table(spark, rows2), "").collect()
    sets, low = {i: shingles(t, 5) for i, t, _ in rows2}, {}
    low = {i: i for i in sets}
    for _ in range(3):
        for a, b in itertools.permutations(sets, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low[a] = min(low[a], low[b])
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i in low if low[i] == i)

    rows3 = [(i, t, f"src{i % 3}") for i, t in want.items()]
    mixed = P.mix(spark, table(spark, rows3), "")
    assert mixed.columns == docs.columns and mixed.where("copy <> 7 OR n_tokens <> 'own'").isEmpty()
    got = Counter(r["doc_id"] for r in mixed.collect())
    size, weight = Counter(), {s: P.SOURCE_WEIGHTS.get(s, P.OTHER_SOURCES) for s in {r[2] for r in rows3}}
    for _, t, s in rows3:
        size[s] += max(1, len(t or ""))
    import hashlib

    plain = {}
    for i, _, s in rows3:
        m = weight[s] / sum(weight.values()) * sum(size.values()) / size[s]
        n = quantile((int(hashlib.md5(f"mix/1|{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48, m)
        if n:
            plain[i] = n
    assert dict(got) == plain

    packed = P.pack(spark, mixed, "").collect()
    words = {i: len((t or "").split()) for i, t, _ in rows3}
    want_len = Counter()
    for i, n in got.items():
        for a in range(0, words[i], P.PACK_LENGTH):
            want_len[i, a // P.PACK_LENGTH, min(P.PACK_LENGTH, words[i] - a)] += n
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in packed) == want_len
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in packed}) == len(packed)
    assert P.run is not None and [n for n, _ in P.STAGES] == ["quality", "lines", "near_duplicates", "mix", "pack"]


def test_pipeline_without_rows_or_labels(spark, tmp_path):
    import corpus_pipeline as P

    empty = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    some = table(spark, corpus())
    assert P.quality(spark, some, str(tmp_path)).count() == len(corpus())
