"""Token-ID output: documents encoded, bit-packed into shard files, and read back.

Ids are stored in the fewest bits that hold the vocabulary, in blocks of ``BLOCK`` ids.

A shard file: magic ``GLTK2``, the packed blocks, each of which starts on a byte, so that any range of ids
unpacks on its own with numpy; then the directory: u64 byte offsets of the blocks (blocks + 1), u64 end
position of every document (in ids), i64 doc ids, u8 flags for null doc ids; and a tail: u8 bits, u32 block
size, u64 number of ids, u64 number of documents, u64 where the directory starts, magic. Blocks
are written as they fill, so a writer holds one block's rest and the directory.

Text that spells a special token (as ``<|endoftext|>``) is encoded as plain text, as the tokenizers' notes ask.

Cases: null and empty texts hold the end id alone; equal doc_ids are stored one after another
(ordered by their ids' checksum); a null doc_id comes first; an empty table makes no file and no
row; further columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.llm import common as C

MAGIC = b"GLTK2"
BLOCK = 4096
TAIL = struct.Struct("<BIQQQ5s")
#: Distinct words a worker remembers before it starts again.
CACHE_WORDS = 1_000_000
#: Bytes of texts encoded at a time.
_TEXT_BYTES = 1 << 20
#: Pieces encoded on one line.
_TOGETHER = 512
#: How byte-level vocabularies write a space.
_SPACE = "\u0120"
_ODD = re.compile(r" \s")
_CUT = re.compile(r" (?=\S)")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, least significant bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(raw, "<u2", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class ShardWriter:
    """Takes documents in order and writes one shard file: under a name of this attempt, then renamed, so that a
    repeated task leaves the same file."""

    def __init__(self, uri: str, bits: int, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.rest, self.offsets = [], [0]
        self.waiting = self.n = 0
        self.ends, self.doc_ids, self.nulls = [], [], []
        self.fs, self.path = C.open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.f = self.fs.open_output_stream(self.part)
        self.f.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.ends.append(self.n)
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 64 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, whole, self.block):
            raw = pack(ids[a : min(a + self.block, whole)], self.bits)
            self.f.write(raw)
            self.offsets.append(self.offsets[-1] + len(raw))
        self.rest, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> int:
        self._flush(True)
        for values, kind in ((self.offsets, "<u8"), (self.ends, "<u8"), (self.doc_ids, "<i8"), (self.nulls, "u1")):
            self.f.write(np.asarray(values, kind).tobytes())
        self.f.write(TAIL.pack(self.bits, self.block, self.n, len(self.ends), len(MAGIC) + self.offsets[-1], MAGIC))
        self.f.close()
        self.fs.move(self.part, self.path)
        return self.n


class ShardReader:
    """Random access to a shard: ``ids(a, b)`` reads only the blocks that hold that range."""

    def __init__(self, uri: str):
        fs, path = C.open_fs(uri)
        self.f = fs.open_input_file(path)
        self.bits, self.block, self.n, docs, at, magic = TAIL.unpack(self.f.read_at(TAIL.size, self.f.size() - TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.base, blocks = len(MAGIC), -(-self.n // self.block)

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.f.read_at(n * np.dtype(kind).itemsize, at), kind)
            at += out.nbytes
            return out

        self.offsets = column("<u8", blocks + 1).astype(np.int64)
        self.ends = column("<u8", docs).astype(np.int64)
        self.doc_ids, self.nulls = column("<i8", docs), column("u1", docs)

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.zeros(0, np.uint32)
        i, j = a // self.block, -(-b // self.block)
        lo, hi = int(self.offsets[i]), int(self.offsets[j])
        raw = self.f.read_at(hi - lo, self.base + lo)
        out = []
        for k in range(i, j):
            n = min(self.block, self.n - k * self.block)
            out.append(unpack(raw[int(self.offsets[k]) - lo : int(self.offsets[k + 1]) - lo], self.bits, n))
        return np.concatenate(out)[a - i * self.block : b - i * self.block]

    def documents(self, most: int = 1 << 20):
        """(doc_id, position in the shard, ids), reading about ``most`` ids at a time."""
        k, docs = 0, len(self.ends)
        while k < docs:
            a = int(self.ends[k - 1]) if k else 0
            m = min(docs, max(k + 1, int(np.searchsorted(self.ends, a + most, "right"))))
            got = self.ids(a, int(self.ends[m - 1]))
            for d in range(k, m):
                s = int(self.ends[d - 1]) if d else 0
                yield (None if self.nulls[d] else int(self.doc_ids[d])), s, got[s - a : int(self.ends[d]) - a]
            k = m


class WordEncoder:
    """Exactly what the tokenizer gives for a text, from remembered pieces between spaces.

    The byte-level pattern never joins a space that precedes a non-space with what stands
    before it, so a text may be cut there and the pieces encoded on their own. Pieces are
    remembered as packed ids. New pieces are encoded many to a line: each but the first begins with a token
    that holds its space, which no other token of a piece can; where the count of those is not the count of
    pieces, each piece is encoded alone. Text that spells a special token is encoded as text.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True
        self.size = self.t.get_vocab_size()
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}  # pieces that follow a space, without it
        self.heads: dict[str, bytes] = {}  # first pieces
        self.begins = np.zeros(self.size, bool)  # tokens that begin with a space
        for token, i in self.t.get_vocab().items():
            self.begins[i] = token.startswith(_SPACE)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """All ids of ``texts``, and how many each has."""
        each = [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(each), self.kind), [len(x) for x in each]

    def _learn(self, home: dict[str, bytes], new: list[str], before: str) -> None:
        ids, counts = self._ids([before + w for w in new])
        raw, width = ids.tobytes(), ids.itemsize
        ends = np.cumsum(counts) * width if counts else []
        a = 0
        for w, b in zip(new, map(int, ends), strict=True):
            home[w] = raw[a:b]
            a = b

    def _learn_joined(self, new: list[str]) -> None:
        """As ``_learn(self.known, new, " ")`` of pieces that begin with no white space."""
        groups = [new[i : i + _TOGETHER] for i in range(0, len(new), _TOGETHER)]
        ids, counts = self._ids([" " + " ".join(g) for g in groups])
        at, home, width = 0, self.known, ids.itemsize
        for g, n in zip(groups, counts, strict=True):
            own = ids[at : at + n]
            at += n
            starts = np.flatnonzero(self.begins[own])
            if len(starts) != len(g) or starts[0]:
                self._learn(home, g, " ")
                continue
            raw, cuts = own.tobytes(), [*(starts * width).tolist(), n * width]
            home.update(zip(g, [raw[i:j] for i, j in zip(cuts, cuts[1:])], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (``kind``) of every text."""
        for home in (self.known, self.heads):
            if len(home) > CACHE_WORDS:
                home.clear()
        cut = [_CUT.split(t) if _ODD.search(t) else t.split(" ") for t in texts]
        first = [c[0] for c in cut]
        for c in cut:
            del c[0]
        new = set(chain.from_iterable(cut)).difference(self.known)
        alone = [w for w in new if not w or w[0].isspace()]
        new.difference_update(alone)
        self._learn(self.known, alone, " ")
        self._learn_joined(list(new))
        self._learn(self.heads, list(set(first).difference(self.heads)), "")
        get, head = self.known.__getitem__, self.heads.__getitem__
        return [head(f) + b"".join(map(get, c)) for f, c in zip(first, cut, strict=True)]


def _encoder(path: str) -> WordEncoder:
    cache = C.worker_cache("encoders")
    if path not in cache:
        cache[path] = WordEncoder(path)
    return cache[path]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, out: str, shards: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write shard files under ``out`` in ascending doc_id order.

    Returns the manifest: shard, path, docs, tokens and start (ids before the shard), a row a file.
    ``tokenizer`` is a tokenizers-library file; every document gets ``end_id`` after its ids.
    Texts are encoded where they are read, so only packed ids are shuffled.
    """
    spark = docs.sparkSession
    C.ship(spark)
    n = shards or max(C.parts_for(spark), docs.rdd.getNumPartitions())  # as many as the scan has at least: they grow with the data
    cuts = C.id_ranges(docs, "doc_id", n)

    def encode(it):
        enc = _encoder(tokenizer)
        end = np.asarray([end_id], enc.kind).tobytes()
        for b in it:
            for lo, hi in C.runs_of_docs(C.utf8(b.column(1))[1], _TEXT_BYTES):
                ids = [x + end for x in enc.encode([t or "" for t in b.column(1)[lo:hi].to_pylist()])]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = packed.mapInArrow(C.light(encode), "doc_id long, ids binary").withColumn("shard", C.range_of("doc_id", cuts))
    packed = packed.repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "doc_id", F.crc32("ids"))

    def write(it):
        enc = _encoder(tokenizer)
        bits, now, w, done = bits_for(max(enc.size, end_id + 1)), None, None, []
        uri = lambda: f"{out}/shard-{now:06d}.bin"
        for b in it:
            shard = b.column(2).to_pylist()
            for i, (d, raw) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                if shard[i] != now:
                    if w is not None:
                        done.append((now, uri(), len(w.ends), w.close()))
                    now = shard[i]
                    w = ShardWriter(uri(), bits)
                w.add(d, np.frombuffer(raw.as_buffer(), enc.kind))
        if w is not None:
            done.append((now, uri(), len(w.ends), w.close()))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                names=["shard", "path", "docs", "tokens"],
            )

    files = packed.mapInArrow(write, "shard int, path string, docs long, tokens long").collect()  # a row a shard file
    start, rows = 0, []
    for f in sorted(files, key=lambda f: f.shard):
        rows.append((f.shard, f.path, f.docs, f.tokens, start))
        start += f.tokens
    return spark.createDataFrame(rows, "shard int, path string, docs long, tokens long, start long")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian u32) from the files of ``manifest``."""
    C.ship(manifest.sparkSession)

    def read(it):
        for b in it:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = ([], [], [], [])
                for d, s, ids in ShardReader(path).documents():
                    for c, v in zip(got, (d, start + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
