"""Toxicity: a counterfactually regularised linear classifier over words and word beginnings.

Features are the distinct words of a text and their first 4, 5 and 6 bytes (inflected forms share
them), kept where they tell the classes apart in the fit sample, plus all identity terms. Labelled
sentences that hold an identity term are copied with the term swapped for each other one of its group, and
the squared change of the score is added to the loss, so that naming a group does not move it. Where no
labelled sentence names a group there is nothing to swap and the fit is plain logistic regression;
``pairs`` of the model says how many copies it had.

The fit reads a bounded sample of labelled rows (``FIT_ROWS``); scoring covers whole texts of all
rows and keeps nothing between rows.

Cases: null and empty texts have no features and get the model's base rate; repeated rows score
alike; labels of one kind only give that rate everywhere; an empty table gives an empty result; very long
texts are read in blocks of rows; further columns stay, one named toxicity is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.llm import common as C

#: Labelled rows that the fit reads at most.
FIT_ROWS = 8000
#: Texts longer than this (characters) aren't drawn for the fit; they are scored like all others.
FIT_CHARS = 20_000
MOST_FEATURES = 4096
PREFIXES = (4, 5, 6)
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of the words and word beginnings of each text, not yet distinct."""
    blank = np.where(_LETTER[data], data, np.uint8(0x20))
    starts, ends, rows = C.word_spans(blank, off)
    if not len(starts):
        return rows, np.zeros(0, np.uint64)
    p, inv = C._pow(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(C._TABLE[C._LOWER[blank]] * p[: len(data)], out=c[1:])
    out, owner = [C.mix((c[ends] - c[starts]) * inv[starts])], [rows]
    for k in PREFIXES:
        s = starts[ends - starts >= k]
        out.append(C.mix((c[s + k] - c[s]) * inv[s] + np.uint64(k)))
        owner.append(rows[ends - starts >= k])
    return np.concatenate(owner), np.concatenate(out)


def term_hash(term: str) -> int:
    data, off = C.utf8(pa.array([term]))
    return int(features(data, off)[1][0])


def _sentences(text: str) -> list[str]:
    import re

    return re.split(r"(?<=[.!?])\s+|\n", text)


def swaps(text: str) -> list[tuple[str, str]]:
    """Each sentence that names an identity term, with a copy for every other term of the group in that place."""
    import re

    others = {t: [o for o in g if o != t] for g in IDENTITY_GROUPS for t in g}
    out = []
    for s in _sentences(text):
        for m in re.finditer(r"[^\W\d_]+", s):
            out += [(s, s[: m.start()] + o + s[m.end() :]) for o in others.get(m[0].lower(), ())]
    return out


def fit(texts: list[str], labels: np.ndarray, penalty: float = 10.0, steps: int = 300, l2: float = 2e-4) -> dict:
    y = np.asarray(labels, float)
    data, off = C.utf8(pa.array(texts, pa.large_string()))
    # distinct in each block, so that the driver never holds every occurrence
    parts = [(a, *C.distinct_sorted(*features(data[off[a] : off[b]], off[a : b + 1] - off[a]))) for a, b in C.runs_of_docs(off)]
    rows, h = np.concatenate([r + a for a, r, _ in parts]), np.concatenate([x for *_, x in parts])
    del parts
    kinds, code = np.unique(h, return_inverse=True)
    n1 = np.bincount(code, y[rows], len(kinds))
    n0 = np.bincount(code, 1 - y[rows], len(kinds))
    p, q = max(y.sum(), 1), max((1 - y).sum(), 1)
    odds = np.log((n1 + 0.5) / (p + 1)) - np.log((n0 + 0.5) / (q + 1))
    z = odds / np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
    z[n1 + n0 < 3] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:MOST_FEATURES]
    chosen = chosen[np.abs(z[chosen]) >= 2.4]
    named = np.array([term_hash(t) for g in IDENTITY_GROUPS for t in g], np.uint64)
    vocabulary = np.unique(np.concatenate([kinds[chosen], named]))
    at = np.searchsorted(vocabulary, h)
    ok = (at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == h)
    r, f = rows[ok], at[ok]

    # counterfactual differences: sparse rows of phi(swapped) - phi(text)
    pairs = [p for t in texts for p in swaps(t)]
    dr, df, dv = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    for sign, side in ((-1.0, [a for a, _ in pairs]), (1.0, [b for _, b in pairs])):
        if side:
            d2, o2 = C.utf8(pa.array(side, pa.large_string()))
            cut = [(a, *C.distinct_sorted(*features(d2[o2[a] : o2[b]], o2[a : b + 1] - o2[a]))) for a, b in C.runs_of_docs(o2)]
            r2, h2 = np.concatenate([r + a for a, r, _ in cut]), np.concatenate([x for *_, x in cut])
            a2 = np.minimum(np.searchsorted(vocabulary, h2), len(vocabulary) - 1)
            k2 = vocabulary[a2] == h2
            dr, df, dv = np.concatenate([dr, r2[k2]]), np.concatenate([df, a2[k2]]), np.concatenate([dv, np.full(int(k2.sum()), sign)])

    n, v = len(y), len(vocabulary)
    w, bias = np.zeros(v), float(np.log(p / q))
    m1, m2 = np.zeros(v + 1), np.zeros(v + 1)
    for k in range(1, steps + 1):
        s = np.bincount(r, w[f], n) + bias
        e = 1 / (1 + np.exp(-np.clip(s, -40, 40))) - y
        g = np.bincount(f, e[r], v) / n + l2 * w
        if len(dr):
            change = np.bincount(dr, dv * w[df], len(pairs))
            g += penalty * 2 * np.bincount(df, dv * change[dr], v) / len(pairs)
        g = np.append(g, e.mean())
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.99 * m2 + 0.01 * g * g
        step = 0.05 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return {"vocabulary": vocabulary, "w": w, "bias": bias, "pairs": len(pairs)}


def score_texts(model: dict, col) -> np.ndarray:
    data, off = C.utf8(col)
    out = np.full(len(off) - 1, model.get("bias", 0.0))
    if "w" in model:
        vocabulary, w = model["vocabulary"], model["w"]
        maybe = np.zeros(1 << 16, bool)
        maybe[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        for a, b in C.runs_of_docs(off):
            rows, h = features(data[off[a] : off[b]], off[a : b + 1] - off[a])
            few = maybe[(h & np.uint64(0xFFFF)).astype(np.int64)]
            rows, h = rows[few], h[few]
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            hit = vocabulary[at] == h
            r, f = C.distinct_sorted(rows[hit], at[hit])
            out[a:b] += np.bincount(r, w[f], b - a)
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, column: str, held_out, rows: int = FIT_ROWS) -> dict:
    """Fit on at most ``rows`` labelled documents that aren't ``held_out`` (a condition on doc_id)."""
    y, texts = C.labelled_sample(docs, labels, column, held_out, rows, FIT_CHARS)
    if not len(y) or y.min() == y.max():
        rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return {"bias": float(np.log(rate / (1 - rate)))}
    model = fit(texts, y)
    C.release_memory()
    return model


def toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with a column toxicity from 0 to 1."""
    return C.with_score(docs, "toxicity", lambda shared, col: score_texts(shared, col), model)
