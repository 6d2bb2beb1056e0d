"""Document fingerprints from content-defined chunks.

A gear hash rolls over the UTF-8 bytes; a chunk ends where its leading bits are all zero, with a
strict mask before ``NORMAL`` bytes and a loose one after (normalised chunking), between ``LEAST``
and ``MOST`` bytes. Boundaries depend only on nearby bytes, so an insertion moves few of them. A
fingerprint is the set of chunk digests with each chunk's length in bytes; likeness is containment:
the share of the first fingerprint's length whose digests the second holds too.

Text form: ``digest:length`` items, digests as 10 hex digits, sorted, joined by spaces; a chunk that
occurs n times counts n times its length. The empty text's is the empty string.

Cases: null texts are empty; an empty text is like an empty one (1) and unlike any other (0); equal
texts have equal fingerprints; equal doc_ids are ordered by their text; a null doc_id comes first
and meets its neighbour like any other; a table of one row is its own next document; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.llm import common as C

LEAST, NORMAL, MOST = 16, 48, 256
STRICT, LOOSE = np.uint32(0xFC000000), np.uint32(0xF0000000)  # 6 and 4 leading bits
_GEAR = np.random.RandomState(1729).randint(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash at every byte: the sum of G[byte] << distance over the last 32 bytes, by doubling."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift)) if len(h) > shift else h[shift:]
    return h


def cut_points(raw: bytes) -> list[int]:
    """Ends of the chunks of ``raw``."""
    n = len(raw)
    if not n:
        return []
    h = gear(np.frombuffer(raw, np.uint8))
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = ((h[loose] & STRICT) == 0).tolist()
    loose = loose.tolist()
    out, start, k, m = [], 0, 0, len(loose)
    while start < n:
        low, mid, high = start + LEAST - 1, start + NORMAL - 1, start + MOST - 1
        while k < m and loose[k] < low:
            k += 1
        end, j = min(high, n - 1), k
        while j < m and (p := loose[j]) <= high:
            if p >= mid or strict[j]:
                end = p
                break
            j += 1
        start, k = end + 1, j
        out.append(start)
    return out


def chunks(raw: bytes) -> dict[int, int]:
    """40-bit digest to length of all chunks with it."""
    out: dict[int, int] = {}
    a = 0
    digest = xxhash.xxh3_64_intdigest
    for b in cut_points(raw):
        d = digest(raw[a:b]) >> 24
        out[d] = out.get(d, 0) + b - a
        a = b
    return out


def as_text(fp: dict[int, int]) -> str:
    return " ".join([f"{d:010x}:{n}" for d, n in sorted(fp.items())])


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """How much of ``a``, by length, is in ``b``."""
    if not a or not b:
        return float(not a and not b)
    whole = sum(a.values())
    return sum(min(n, b[d]) for d, n in a.items() if d in b) / whole


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by the first as many code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, fingerprint and the comparison with an edited copy and with the next document.

    Documents are dealt by ranges of doc_id and sorted inside them; each range also gets the
    first document of the range after it, so that every neighbour is at hand. Texts are
    shuffled once.
    """
    spark = docs.sparkSession
    C.ship(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = C.id_ranges(d, "doc_id", parts or 2 * max(C.parts_for(spark), docs.rdd.getNumPartitions()))  # at least in step with the scan, which grows with the data
    d = d.withColumn("part", C.range_of("doc_id", cuts))
    order = F.struct(F.col("doc_id"), F.col("text"))
    # the first row of each range: a row a range, found without moving texts where ids differ
    first = d.groupBy("part").agg(F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("hole")).collect()
    if not first:
        return spark.createDataFrame([], _RESULT)
    used = sorted(r["part"] for r in first)
    before = {p: used[i - 1] for i, p in enumerate(used)}  # the first range's row also goes to the last range
    least = {r["part"]: None if r["hole"] else r["doc_id"] for r in first}
    found = F.create_map(*[x for p in used for x in (F.lit(p), F.lit(least[p]).cast("long"))])
    is_head = F.col("doc_id").eqNullSafe(F.element_at(found, F.col("part")))
    prev = F.create_map(*[x for p in used for x in (F.lit(p), F.lit(before[p]))])
    ahead = d.where(is_head).groupBy("part").agg(F.min(order).alias("o"))
    ahead = ahead.select("o.doc_id", "o.text", F.element_at(prev, F.col("part")).alias("part"), F.lit(True).alias("ahead"))
    rows = d.select("doc_id", "text", "part", F.lit(False).alias("ahead")).union(ahead)
    rows = rows.repartition(len(used), "part").sortWithinPartitions("part", "ahead", "doc_id", "text")

    def run(it):
        part, last = None, None  # last: (doc_id, text, chunks) that waits for its neighbour

        for b in it:
            out = ([], [], [], [], [], [], [])
            ids, texts, parts_, aheads = (b.column(i).to_pylist() for i in range(4))
            for i, t, p, is_ahead in zip(ids, texts, parts_, aheads, strict=True):
                own = (i, t, chunks(t.encode()))
                if last is not None and part == p:
                    text = edited(last[1], t).encode()
                    fp = chunks(text)
                    row = (last[0], len(last[1]), hashlib.sha256(text).hexdigest(), as_text(last[2]), as_text(fp), likeness(last[2], fp), likeness(last[2], own[2]))
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                part, last = p, None if is_ahead else own
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[f.split()[0] for f in _RESULT.split(", ")])

    return rows.mapInArrow(run, _RESULT)
