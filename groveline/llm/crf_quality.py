"""Document quality from a linear-chain conditional random field over lines.

Every line has a small vector of surface features; a line's state (bad, good) also sees its two
neighbours' features and the transition from the line before. Trained by gradient
ascent on labelled documents whose lines take the document's label, except that ordinary-looking
lines of bad documents are left latent: the numerator sums over them. The score is the mean of the
forward-backward marginals of "good", weighted by line length.

The fit reads a bounded sample of labelled rows (``FIT_ROWS``, the smallest hashes of the ids that
may be learned from). Everything else covers all rows.

Cases: null and empty texts, and texts of white space alone, have one empty line and get that
line's marginal; blank lines between others are skipped; very long lines count as one; repeated
rows score alike; without labels of both kinds every score is the prior of good; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from groveline.llm import common as C

#: Labelled rows that the fit reads at most.
FIT_ROWS = 4000
#: Texts longer than this (characters) aren't drawn for the fit; they are scored like all others.
FIT_CHARS = 20_000
N_OWN = 14
_NEWLINE = 10
_CLASS = np.zeros((8, 256), np.float64)  # upper, lower or above ASCII, digit, mark, odd mark, space, pipe, byte
_CLASS[0, 65:91] = 1
_CLASS[1, 97:123] = 1
_CLASS[1, 128:] = 1
_CLASS[2, 48:58] = 1
for _c in b"!?.,;:'\"-()":
    _CLASS[3, _c] = 1
for _c in b"#$%&*@^~<>{}[]\\=_+/`":
    _CLASS[4, _c] = 1
_CLASS[5, [32, 9, 11, 12, 13]] = 1
_CLASS[6, ord("|")] = 1
_CLASS[7] = 1


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, length in bytes and features of every line that isn't blank (one empty line where there is none)."""
    n, docs = len(data), len(off) - 1
    breaks = np.flatnonzero(data == _NEWLINE)
    bounds = np.unique(np.concatenate([off[:-1], breaks + 1, off[-1:]])) if n else np.zeros(1, np.int64)
    starts, ends = bounds[:-1], bounds[1:]
    doc = np.searchsorted(off, starts, "right") - 1
    if len(starts):
        sums = np.stack([np.add.reduceat(c[data], starts) for c in _CLASS], 1)
        w_start, w_end, _ = C.word_spans(data, off)
        w_line = np.searchsorted(starts, w_start, "right") - 1
        h = C.word_hashes(data, w_start, w_end)
        w_len = (w_end - w_start).astype(np.float64)
        words = np.bincount(w_line, minlength=len(starts)).astype(np.float64)
        chars = np.bincount(w_line, w_len, minlength=len(starts))
        long_words = np.bincount(w_line, w_len >= 12, minlength=len(starts))
        short_words = np.bincount(w_line, w_len <= 3, minlength=len(starts))
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (w_line[1:] == w_line[:-1])
        same = np.bincount(w_line, again, minlength=len(starts))
        l2, _ = C.distinct_sorted(w_line, h)
        kinds = np.bincount(l2, minlength=len(starts)).astype(np.float64)
        first = data[np.minimum(w_start, n - 1)]
        capital = np.bincount(w_line, (first >= 65) & (first <= 90), minlength=len(starts))
        size = np.maximum(sums[:, 7] - sums[:, 5] - (data[ends - 1] == _NEWLINE), 0)
        some = np.maximum(size, 1)
        w1 = np.maximum(words, 1)
        x = np.stack(
            [
                np.ones(len(starts)), np.log1p(words) / 4, np.minimum(chars / w1, 20) / 8, sums[:, 0] / some, sums[:, 2] / some * 4, sums[:, 3] / some * 4,
                np.minimum(sums[:, 4] / w1, 3), np.minimum(sums[:, 6] / w1, 1) * 2, same / w1 * 2, 1 - kinds / w1, long_words / w1, short_words / w1, capital / w1, (words <= 2) * 1.0,
            ],
            1,
        )
        keep = words > 0
        doc, size, x = doc[keep], size[keep], x[keep]
    else:
        doc, size, x = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, N_OWN))
    bare = np.setdiff1d(np.arange(docs), doc)
    if len(bare):
        e = np.zeros((len(bare), N_OWN))
        e[:, 0] = 1
        e[:, -1] = 1
        o = np.argsort(np.concatenate([doc, bare]), kind="stable")
        doc, size, x = np.concatenate([doc, bare])[o], np.concatenate([size, np.ones(len(bare))])[o], np.concatenate([x, e])[o]
    return doc, size, x


def with_neighbours(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the lines before and after it in its document (zeros at the ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        same = (doc[1:] == doc[:-1])[:, None]
        before[1:] = x[:-1] * same
        after[:-1] = x[1:] * same
    return np.concatenate([x, before, after], 1)


def _scaled(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = a.max(-1, keepdims=True)
    return a - m, m[..., 0]


def marginals(doc: np.ndarray, score: np.ndarray, trans: np.ndarray, allow: np.ndarray | None = None):
    """P(good) of every line, P(pairs) summed, and each document's log partition.

    ``score`` is the log potential of "good" against "bad" (two columns); documents run in parallel,
    position by position, so the Python loop is as long as the longest document of the block.
    """
    n = len(doc)
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if n else np.zeros(0, np.int64)
    lens = np.diff(np.concatenate([starts, [n]]))
    order = np.argsort(-lens, kind="stable")
    starts, lens = starts[order], lens[order]
    pot = score if allow is None else score + allow
    t = np.exp(trans)
    f, b = np.zeros((n, 2)), np.ones((n, 2))
    logz = np.zeros(len(starts))
    p, m = _scaled(pot)
    p = np.exp(p)
    for i in range(int(lens[0]) if n else 0):
        live = int(np.searchsorted(-lens, -i, "left"))  # documents longer than i
        at = starts[:live] + i
        a = p[at] if i == 0 else (f[at - 1] @ t) * p[at]
        s = a.sum(1)
        f[at] = a / s[:, None]
        logz[:live] += np.log(s) + m[at]
    for i in range(int(lens[0]) - 2 if n else -1, -1, -1):
        live = int(np.searchsorted(-lens, -(i + 1), "left"))
        at = starts[:live] + i
        v = (p[at + 1] * b[at + 1]) @ t.T
        b[at] = v / v.sum(1)[:, None]
    g = f * b
    g /= np.maximum(g.sum(1), 1e-300)[:, None]
    pairs = np.zeros((2, 2))
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if n else np.zeros(0, np.int64)
    if len(inner):
        j = f[inner][:, :, None] * t[None] * (p[inner + 1] * b[inner + 1])[:, None, :]
        pairs = (j / j.sum((1, 2))[:, None, None]).sum(0)
    return g, pairs, logz


def fit(texts: list[str], labels: np.ndarray, steps: int = 100, l2: float = 1e-3) -> dict:
    """Weights of the field: gradient ascent (Adam) on the labelled documents' likelihood."""
    data, off = C.utf8(pa.array(texts, pa.large_string()))
    # block by block, so that the driver holds features and no arrays by byte of all texts
    parts = [(a, *line_features(data[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in C.runs_of_docs(off)]
    doc, size, x = np.concatenate([d + a for a, d, _, _ in parts]), np.concatenate([s for _, _, s, _ in parts]), np.concatenate([v for *_, v in parts])
    del parts
    z = with_neighbours(doc, x)
    mean, dev = z.mean(0), z.std(0) + 1e-6
    mean[0], dev[0] = 0, 1
    z = (z - mean) / dev
    y = np.asarray(labels)[doc]
    # Lines of a bad document may be fine: those that look like good documents' lines are left latent.
    good = z[y == 1]
    far = np.abs(z[:, 1:N_OWN]) > np.abs(np.quantile(good[:, 1:N_OWN], [0.005, 0.995], axis=0)).max(0)[None] + 1e-3
    odd = far.any(1)
    allow = np.zeros((len(y), 2))
    allow[y == 1, 0] = -1e9
    has_odd = np.zeros(len(texts), bool)
    np.logical_or.at(has_odd, doc, odd)
    allow[(y == 0) & (odd | ~has_odd[doc]), 1] = -1e9
    w, trans = np.zeros(z.shape[1]), np.zeros((2, 2))
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    per = max(1, len(texts))
    zero = np.zeros(len(z))
    for k in range(1, steps + 1):
        s = np.stack([zero, z @ w], 1)
        g1, p1, _ = marginals(doc, s, trans, allow)
        g0, p0, _ = marginals(doc, s, trans)
        grad = np.concatenate([z.T @ (g1[:, 1] - g0[:, 1]), (p1 - p0).ravel()]) / per - l2 * np.concatenate([w, trans.ravel()])
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad**2
        step = 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        w += step[:-4]
        trans += step[-4:].reshape(2, 2)
    model = {"w": w, "trans": trans, "mean": mean, "dev": dev, "a": 1.0, "b": 0.0}
    raw = np.clip(_scores(model, doc, size, x, len(texts)), 1e-4, 1 - 1e-4)
    model["a"], model["b"] = _calibrated(np.log(raw / (1 - raw)), np.asarray(labels, float))
    return model


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A monotone logistic map of the weighted marginal, so that the score reads as a probability."""
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([((y - p) * x).mean() - 1e-2 * (a - 1), (y - p).mean()])
        v = p * (1 - p) + 1e-6
        h = np.array([[(v * x * x).mean() + 1e-2, (v * x).mean()], [(v * x).mean(), v.mean()]])
        d = np.linalg.solve(h, g)
        a, b = max(0.05, a + float(np.clip(d[0], -1, 1))), b + float(np.clip(d[1], -1, 1))
    return a, b


def _scores(model: dict, doc: np.ndarray, size: np.ndarray, x: np.ndarray, docs: int) -> np.ndarray:
    z = (with_neighbours(doc, x) - model["mean"]) / model["dev"]
    g, _, _ = marginals(doc, np.stack([np.zeros(len(z)), z @ model["w"]], 1), model["trans"])
    weight = np.maximum(size, 1)
    return np.bincount(doc, g[:, 1] * weight, minlength=docs) / np.bincount(doc, weight, minlength=docs)


def score_texts(model: dict, col) -> np.ndarray:
    """A score from 0 to 1 for each row of an Arrow string column."""
    data, off = C.utf8(col)
    out = np.full(len(off) - 1, model.get("prior", 0.5))
    if "w" in model:
        for a, b in C.runs_of_docs(off):
            part = off[a : b + 1]
            doc, size, x = line_features(data[part[0] : part[-1]], part - part[0])
            raw = np.clip(_scores(model, doc, size, x, b - a), 1e-6, 1 - 1e-6)
            out[a:b] = 1 / (1 + np.exp(-(model["a"] * np.log(raw / (1 - raw)) + model["b"])))
    return out


def train(docs: DataFrame, labels: DataFrame, column: str, held_out, rows: int = FIT_ROWS) -> dict:
    """Fit on at most ``rows`` labelled documents that aren't ``held_out`` (a condition on doc_id)."""
    y, texts = C.labelled_sample(docs, labels, column, held_out, rows, FIT_CHARS)
    if not len(y) or y.min() == y.max():
        return {"prior": float(y.mean()) if len(y) else 0.5}
    model = fit(texts, y)
    C.release_memory()
    return model


def quality(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with a column quality_score from 0 to 1."""
    return C.with_score(docs, "quality_score", lambda shared, col: score_texts(shared, col), model)
