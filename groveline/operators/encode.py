"""Feature-hashing text vectors: words, word pairs and character 4-grams add or subtract one in a hashed dimension."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from groveline.functions import vectors as V
from groveline.operators import text as T
from groveline.session import ship

DIM = 384
# Fixed value: the pattern of a word.
WORD = r"[a-z0-9$%.]+"
#: Features whose hashes a worker remembers before it starts again.
CACHE = 500_000


def features_of(text: str) -> list[str]:
    words = re.findall(WORD, text.lower())
    line = " ".join(words)
    return [*words, *map("_".join, zip(words, words[1:], strict=False)), *(line[i : i + 4] for i in range(0, len(line) - 3, 2))]


def encode(df: DataFrame, text: str = "text", out: str = "v", dim: int = DIM) -> DataFrame:
    """``df`` with unit vectors ``out`` of the column ``text``; null and empty texts get zeros.

    The hash is a 64-bit blake2b read big-endian: its remainder is the dimension, its top bit the sign. Texts are
    encoded where they stand, without a shuffle, and each feature is hashed once a worker.
    """
    ship(df.sparkSession)
    at = df.columns.index(text)

    def run(it):
        known: dict[str, int] = {}  # dimension, plus dim where the sign is +
        for b in it:
            m = np.zeros((b.num_rows, 2 * dim))
            for row, t in enumerate(b.column(at).to_pylist()):
                fs = features_of(t or "")
                for f in fs:
                    if f not in known:
                        h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
                        known[f] = h % dim + dim * (h >> 63)
                m[row] = np.bincount(np.fromiter((known[f] for f in fs), np.int64, len(fs)), minlength=2 * dim)
                if len(known) > CACHE:
                    known.clear()
            v = m[:, dim:] - m[:, :dim]
            n = np.sqrt((v * v).sum(1))
            v /= np.where(n == 0, 1e-9, n)[:, None]
            col = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dim, pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(out, ArrayType(DoubleType())))


def feature_column(text: Column) -> Column:
    """The features as an expression."""
    ws = T.matches(F.lower(F.coalesce(text, F.lit(""))), WORD)
    n, line = F.size(ws), F.array_join(ws, " ")
    pairs = F.when(n > 1, F.zip_with(F.slice(ws, F.lit(1), n - 1), F.slice(ws, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))
    grams = F.when(F.length(line) >= 4, F.transform(F.sequence(F.lit(1), F.length(line) - 3, F.lit(2)), lambda i: F.substring(line, i, F.lit(4)))).otherwise(F.array().cast("array<string>"))
    return F.concat(ws, pairs, grams)


def encode_md5(df: DataFrame, key: str, text: str = "text", dim: int = 64) -> DataFrame:
    """key, v: as :func:`encode` with a hash that SQL has too (md5: 12 digits the dimension, the next the sign), in DataFrame functions."""
    f = df.select(key, F.explode(feature_column(F.col(text))).alias("f")).select(key, F.md5("f").alias("h"))
    f = f.select(key, F.pmod(F.conv(F.substring("h", 1, 12), 16, 10).cast("long"), F.lit(dim)).cast("int").alias("i"), F.when(F.substring("h", 13, 1) >= "8", 1.0).otherwise(-1.0).alias("x"))
    f = f.groupBy(key, "i").agg(F.sum("x").alias("x")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return f.select(key, V.l2_normalise(dense).alias("v"))
