"""Shared pieces: Arrow text buffers, vectorised word hashing, doc_id ranges, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.session import delete, drop, open_fs, save, scratch, shared_dir, ship  # noqa: F401

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.RandomState(20240229).randint(0, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_TABLE ^= np.random.RandomState(7).randint(0, 2**62, 256, dtype=np.int64).astype(U64) << U64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}
#: Bytes hashed at a time, so that the power tables and a worker's arrays stay small.
BLOCK_BYTES = 1 << 18


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES * 2)
        for k, base in (("p", _BASE), ("i", _INVERSE)):
            a = np.full(size, base, U64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, not copied where they needn't be, and each row's offsets into them (n + 1); null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def lists(at: np.ndarray, values: np.ndarray) -> pa.Array:
    """A list column from its offsets (n + 1) and flat values."""
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))


def light(run):
    """``run`` over a task's batches, after which the worker hands free memory back: it lives on between tasks."""

    def out(it):
        yield from run(it)
        release_memory()

    return out


def release_memory() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written: nobody holds their plans any more."""
    import gc
    import time

    for _ in range(2):  # the driver's objects go first, then what they held; executors delete a moment later
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def free(columns, *wanted: str) -> list[str]:
    """``wanted`` names, each lengthened until no column has it (in any case)."""
    have, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def runs_of_docs(off: np.ndarray, most: int = BLOCK_BYTES):
    """Ranges of rows whose bytes together stay near ``most``; one long row is a range of its own."""
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def text_slices(col, most: int = BLOCK_BYTES):
    """Lists of texts (null is empty) whose bytes together stay near ``most``."""
    off = utf8(col)[1]
    for a, b in runs_of_docs(off, most):
        yield ["" if t is None else t for t in col.slice(a, b - a).to_pylist()]


def word_spans(data: np.ndarray, off: np.ndarray, breaks: np.ndarray | None = None):
    """Starts, ends and row of every word ``[^\\x20\\x09-\\x0D]+``; rows break words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    full = ~_SPACE[data]
    begin = np.zeros(n + 1, bool)
    begin[off] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(full[:-1], out=before[1:])
    starts = np.flatnonzero(full & (before | begin[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(full[1:], out=after[:-1])
    ends = np.flatnonzero(full & (after | begin[1:])) + 1
    rows = np.searchsorted(off, starts, "right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    p, inv = _pow(len(data) + 1)
    c = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[_LOWER[data] if lower else data] * p[: len(data)], out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(U64))


def distinct_sorted(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), sorted by both."""
    if not len(rows):
        return rows, values
    o = np.lexsort((values, rows))
    r, v = rows[o], values[o]
    keep = np.ones(len(r), bool)
    keep[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return r[keep], v[keep]


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each row's distinct word shingles, sorted. With fewer words, the whole sequence is one."""
    starts, ends, rows = word_spans(data, off)
    h = word_hashes(data, starts, ends)
    n = len(h)
    if not n:
        return rows, h
    acc = np.zeros(n, U64)
    for j in range(width):
        acc[: n - j] += mix(h[j:] + U64(0x1000193 * (j + 1)))
    whole = np.zeros(n, bool)
    if n >= width:
        whole[: n - width + 1] = rows[: n - width + 1] == rows[width - 1 :]
    values, owner = mix(acc[whole]), rows[whole]
    n_words = np.bincount(rows, minlength=len(off) - 1)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        first = np.searchsorted(rows, short)
        extra = np.empty(len(short), U64)
        for k, (row, at) in enumerate(zip(short, first, strict=True)):
            s = np.full(1, n_words[row] * 0x51ED27, U64)
            for j in range(n_words[row]):
                s += mix(h[at + j : at + j + 1] + U64(0x1000193 * (j + 1)))
            extra[k] = s[0]
        values, owner = np.concatenate([values, mix(extra)]), np.concatenate([owner, short])
    return distinct_sorted(owner, values)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def field(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def id_ranges(df: DataFrame, column: str, parts: int) -> list[int]:
    """Cut points that split an integer column into at most ``parts`` ranges of about equal counts."""
    if parts <= 1:
        return []
    cuts = df.where(F.col(column).isNotNull()).approxQuantile(column, [i / parts for i in range(1, parts)], 1 / (4 * parts))
    return sorted({int(x) for x in cuts})


def range_of(column: str, cuts: list[int]):
    """The number of the range that a value falls in: how many cut points lie below it. Null comes first."""
    if not cuts:
        return F.lit(0)
    c = F.array(*[F.lit(x).cast("long") for x in cuts]) if len(cuts) <= 64 else F.from_json(F.lit(str(cuts)), "array<bigint>")
    if len(cuts) <= 64:
        return F.coalesce(F.size(F.filter(c, lambda x: x < F.col(column).cast("long"))), F.lit(0))
    return F.coalesce(F.aggregate(c, F.lit(0), lambda s, x: s + F.when(x < F.col(column).cast("long"), 1).otherwise(0)), F.lit(0))


def parts_for(spark: SparkSession, least: int = 8) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over ``edges``, for every node that has one.

    Alternating large-star and small-star rounds, each a grouped minimum; tables are
    written to the shared folder between rounds, so no lineage grows and nothing is collected.
    """
    e = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), name)
    while True:
        n, owners = e.agg(F.count("*"), F.countDistinct("u")).first()
        # Stars: every node points at one other, and no centre points on.
        if n == owners and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out._groveline_path = e._groveline_path
            return out
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        step = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m2 = step.groupBy("u").agg(F.min("v").alias("m"))
        small = step.join(m2, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        nxt = save(nxt.where("u <> v").distinct(), name)
        drop(e)
        e = nxt


def held_out(mod: int, rest: int):
    """Rows whose crc32 of doc_id, as text, leaves ``rest`` modulo ``mod``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == rest


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, not_from, rows: int, chars: int):
    """Labels and texts of at most ``rows`` documents with a label that aren't ``not_from``, by the smallest hashes of
    their ids, among texts of at most ``chars`` characters. Sorted, so that a fit repeats."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~not_from)
    known = known.select("doc_id", F.col(column).cast("int").alias("label"))
    short = docs.where(F.length("text") <= chars).select("doc_id", "text")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(2 * rows)
    got = short.join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text", "label").limit(rows).toPandas()
    return got["label"].to_numpy(), list(got["text"])


def with_score(docs: DataFrame, name: str, score, model) -> DataFrame:
    """``docs`` with a double column ``name`` from ``score(model, arrow column of texts)``."""
    from pyspark.sql.types import DoubleType, StructType

    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(name)
    at, names = [c.lower() for c in docs.columns].index("text"), [*docs.columns, name]
    shared = spark.sparkContext.broadcast(model)

    def run(it):
        for b in it:
            s = score(shared.value, b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=names)

    return docs.mapInArrow(light(run), StructType([*docs.schema.fields]).add(name, DoubleType()))


#: Bits of the filter of :func:`only_ids`: 1 MB, whatever the input.
FILTER_BITS = 1 << 23


def only_ids(df: DataFrame, key, ids: DataFrame, ids_key) -> DataFrame:
    """Rows of ``df`` whose ``key`` may occur in ``ids``: a fixed-size bitmap of hashes, tested before any shuffle.

    False hits grow as the bitmap fills, so a join must follow; no true row is lost at any size.
    """
    from pyspark.sql.types import StructType

    spark = df.sparkSession
    ship(spark)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("int")
    h = ids.select(slot(ids_key).alias("h"))
    word = F.shiftright("h", 5).alias("w")
    bit = F.expr("shiftleft(1L, h & 31)")
    got = h.groupBy(word).agg(F.bit_or(bit).alias("b")).toPandas()  # at most FILTER_BITS / 32 rows
    words = np.zeros(FILTER_BITS // 32, np.uint32)
    words[got["w"].to_numpy(int)] = got["b"].to_numpy(np.int64).astype(np.uint32)
    shared = spark.sparkContext.broadcast(words)
    names, n = df.columns, len(df.columns)

    def run(it):
        for b in it:
            at = b.column(n).to_numpy()
            hit = (shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1
            if hit.any():
                yield pa.RecordBatch.from_arrays(b.columns[:n], names=names).filter(pa.array(hit.astype(bool)))

    return df.select("*", slot(key).alias(free(names, "slot")[0])).mapInArrow(light(run), StructType([*df.schema.fields]))


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker."""
    import sys
    import types

    home = sys.modules.setdefault("_groveline_worker", types.ModuleType("_groveline_worker"))
    return home.__dict__.setdefault(name, {})
