"""Dealt operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from groveline.llm import crf_quality, fingerprint, line_dedup, mixing, near_dup, packing, token_counts, token_store, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy int, rate double, n_tokens string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 0.5, "own") for i, t, s in rows], DOCS)


def corpus():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: "\n".join(" ".join(rnd.choices(words, k=12)) for _ in range(n))
    rows = [(i, text(rnd.randint(1, 6)), f"src{i % 3}") for i in range(60)]
    for i in range(60, 90):  # near copies of document 3, with few words changed
        w = rows[3][1].split(" ")
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, " ".join(w), "src0"))
    rows += [(90, rows[5][1], "src1"), (91, None, None), (92, "", "src2"), (93, "  \n ", "src2"), (94, "ÄÖ one", "src2"), (95, text(400), "src2")]
    rows += [(5, rows[5][1], "src2"), (None, rows[6][1], "src0")]
    return rows


def shingles(text, width):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def test_near_duplicates_against_all_pairs(spark):
    rows = corpus()
    known = [(i, shingles(t, 4)) for i, t, _ in rows if i is not None]
    low = {i: i for i, _ in known}
    changed = True
    while changed:
        changed = False
        for i, a in known:
            for j, b in known:
                if i != j and a and b and 100 * len(a & b) >= 80 * len(a | b) and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    got = near_dup.near_duplicates(table(spark, rows), 4, 80).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == low[r["doc_id"]] and r["kept"] == (low[r["doc_id"]] == r["doc_id"])
    kept = near_dup.dedup(table(spark, rows), 4, 80)
    assert sorted(kept.columns) == sorted(table(spark, rows).columns)
    assert sorted(x["doc_id"] for x in kept.where("doc_id IS NOT NULL").collect()) == sorted(i for i in low if low[i] == i)
    assert near_dup.near_duplicates(table(spark, []), 4, 80).count() == 0


def test_line_dedup_against_all_pairs(spark):
    rows = corpus()
    lines = []
    for i, t, _ in sorted({(i, t, "") for i, t, _ in rows if t}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines += [(i, k, set(x.lower().split())) for k, x in enumerate(t.split("\n")) if x.split()]
    stay = {}
    for n, (i, k, s) in enumerate(lines):
        if not any(100 * len(s & o) >= 80 * len(s | o) for _, _, o in lines[:n]):
            stay.setdefault(i, []).append(k)
    got = {r["doc_id"]: r for r in line_dedup.removed_lines(table(spark, rows)).collect()}
    for i, _, _ in rows:
        assert list(got[i]["kept_lines"]) == stay.get(i, []), i
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert out[91] is None and out[92] == "" and out[90] == ""
    gone = line_dedup.dedup_lines(table(spark, rows), drop_emptied=True)
    assert 90 not in {r["doc_id"] for r in gone.collect()} and {91, 92, 93} <= {r["doc_id"] for r in gone.collect()}
    assert line_dedup.removed_lines(table(spark, [])).count() == 0


def test_mixing(spark):
    rows = corpus()
    got = mixing.mix(table(spark, rows), {"src0": 3.0}, repeat=4.0).collect()
    assert got == mixing.mix(table(spark, rows), {"src0": 3.0}, repeat=4.0).collect()
    keys = [r["shuffle_key"] for r in got]
    assert keys == sorted(keys) and min(r["copy"] for r in got) == 1
    assert {r["source"] for r in got} == {"src0", "src1", "src2", None}
    assert mixing.mix(table(spark, []), {}).count() == 0


def test_fingerprints(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] != 5] + [(5, corpus()[5][1], "x")]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(table(spark, rows), parts=5).collect()}
    order = sorted((i, t or "") for i, t, _ in rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert got[i]["fingerprint"] == fingerprint.as_text(fingerprint.chunks(t.encode()))
        assert 0 <= got[i]["near_edited"] <= 1
    assert got[5]["fingerprint"] == got[90]["fingerprint"] and got[92]["fingerprint"] == ""
    assert fingerprint.fingerprints(table(spark, [])).count() == 0


def test_token_store_round_trip(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = sorted({(i, x, "s") for i, x, _ in corpus() if i is not None}, key=lambda r: r[0]) + [(96, " a  b <|endoftext|> c. d, \t e", "s")]
    got = {r["doc_id"]: r for r in token_store.read_tokens(token_store.write_tokens(table(spark, rows), P.path("byte_bpe_50k.json"), 2, f"file://{tmp_path}/t", shards=3)).collect()}
    at = 0
    for i, x, _ in rows:
        ids = np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for bits in (1, 7, 16, 17, 20):
        ids = np.random.RandomState(bits).randint(0, 1 << bits, 1000).astype(np.uint32)
        assert (token_store.unpack(token_store.pack(ids, bits), bits, 1000) == ids).all()


def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(table(spark, corpus()), P.path("piece_bpe_32k.model")).collect()}
    assert got[91] == got[92] == 0 and got[5] == got[90] > 0
    c = token_counts.Counter([("<unk>", 0.0), ("▁", -3.0), ("▁a", -1.0), ("b", -2.0), ("ab", -2.5), ("▁ab", -1.5)])
    assert c.count("ab") == 1 and c.count("a b") == 3


def test_packing_is_optimal(spark):
    import itertools

    hist = {3: 5, 4: 1, 9: 2, 10: 7, 15: 1}
    cost = lambda b: sum(n * (min(x for x in b if x >= k) - k) for k, n in hist.items())
    best = min(cost(c) for c in itertools.combinations(hist, 3) if max(c) == 15)
    assert cost(packing.boundaries(hist, 3)) == best
    got = packing.pack(table(spark, corpus()), 64, 4, 256).collect()
    sizes = {}
    for r in got:
        assert r["length"] <= r["bucket"] and r["slot"] < max(1, 256 // r["bucket"])
        sizes[r["bucket"], r["batch"], r["slot"]] = sizes.get((r["bucket"], r["batch"], r["slot"]), 0) + 1
    assert set(sizes.values()) == {1}
    assert sum(r["length"] for r in got) == sum(len((t or "").split()) for _, t, _ in corpus())
    assert packing.pack(table(spark, []), 64, 4, 256).count() == 0


@pytest.mark.parametrize("module,train,score,column", [(crf_quality, "quality", "quality", "quality_score"), (toxicity, "toxic", "toxicity", "toxicity")])
def test_classifiers(spark, module, train, score, column):
    from conftest import SF
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = module.train(docs, labels, train, F.lit(False))
    odd = table(spark, corpus())
    got = getattr(module, score)(odd, model).collect()
    assert len(got) == len(corpus()) and all(0 <= r[column] <= 1 for r in got)
    one = {r["doc_id"]: r[column] for r in got}
    assert one[91] == one[92] and one[5] == one[90]
    none = module.train(docs, labels.limit(0), train, F.lit(False))
    assert len({r[column] for r in getattr(module, score)(odd, none).collect()}) == 1
    assert getattr(module, score)(table(spark, []), model).count() == 0


def test_pipeline_runs(spark):
    from conftest import SF

    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.quality(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    out = P.run(spark, SF)
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert ids and ids <= {r["doc_id"] for r in docs.select("doc_id").collect()}
