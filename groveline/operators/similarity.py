"""Cosine work over many vectors: blocked products, neighbours, statistics.

n x n products run block against block: a task holds a block of one side, reads the other side's table from the shared
folder piece by piece, multiplies with numpy and returns only the neighbours or sums asked for. So no pair table is made,
and what is shuffled and written grows with the rows of either side, not with their product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groveline.session import save, saved_rows, ship

BLOCK_ROWS = 2048
#: Blocks of the side that is held to one of the side that is read; rows multiplied at a time.
HELD, STRIP = 4, 512


def _matrix(t: pa.Table) -> np.ndarray:
    v = t["v"].combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    return np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(t.num_rows, -1)


def _none(kind: pa.DataType):
    """What stands for null in arrays of ids: the greatest value."""
    return np.iinfo(kind.to_pandas_dtype()).max if pa.types.is_integer(kind) else "\U0010ffff"


def _ids(t: pa.Table, column: str) -> np.ndarray:
    x = t[column].fill_null(_none(t[column].type)).to_numpy()
    return x.astype(str) if x.dtype == object else x


def _same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of equal values."""
    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b, a, side, sorter=order) for side in ("left", "right"))
    n = high - low
    at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(np.arange(len(a)), n), order[at]


def _blocks(it, rows: int):
    """A task's batches as tables of about ``rows`` rows."""
    held, n = [], 0
    for b in it:
        for at in range(0, b.num_rows, rows):
            held.append(b.slice(at, rows))
            n += held[-1].num_rows
            if n >= rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _met(left: DataFrame, right: DataFrame, visit, schema: str, rows: int) -> DataFrame:
    """``visit(block, tables)`` for blocks of ``left``: it gets the rows of ``right`` table by table and yields tables of ``schema``.

    The first column of ``left`` deals its rows to the tasks. Where ``left`` has fewer blocks than there are cores, each block
    goes to a few tasks that read a part of ``right`` each.
    """
    spark = left.sparkSession
    ship(spark)
    right, left = (x if hasattr(x, "_groveline_path") else save(x, name) for x, name in ((right, "vectors"), (left, "queries")))
    wide, n = 2 * spark.sparkContext.defaultParallelism, left.count()
    parts = max(1, -(-n // (HELD * rows)), min(wide, -(-n // min(64, rows))))
    pieces = max(1, wide // parts)
    uri, columns = right._groveline_path, right.columns
    part = F.pmod(F.xxhash64(left.columns[0]), F.lit(parts)).cast("int")
    dealt = left.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).withColumn("_slot", part * pieces + F.col("_piece"))

    def run(it):
        for block in _blocks(it, HELD * rows):
            for piece in np.unique(block["_piece"].to_numpy()):
                own = block.filter(pc.equal(block["_piece"], pa.scalar(piece, pa.int32())))
                for t in visit(own, saved_rows(uri, rows, columns, int(piece), pieces)):
                    yield from (b for b in t.to_batches() if b.num_rows)

    return dealt.repartitionById(parts * pieces, "_slot").mapInArrow(run, schema)


def _each(run, rows: int):
    """A visit that runs over every pair of a block of ``rows`` rows and a table."""
    return lambda a, tables: (run(a.slice(at, rows), b) for b in tables for at in range(0, a.num_rows, rows))


class Best:
    """The ``top`` best of each of ``m`` rows so far, ties to the smaller id."""

    def __init__(self, m: int, top: int, kind: np.dtype):
        self.score, self.raw, self.ids = np.full((m, top), -np.inf), np.full((m, top), -np.inf), np.zeros((m, top), kind)

    def add(self, row: np.ndarray, score: np.ndarray, raw: np.ndarray, ids: np.ndarray) -> None:
        if ids.dtype.itemsize > self.ids.dtype.itemsize:
            self.ids = self.ids.astype(ids.dtype)
        last = self.score[row, -1]
        on = (score > last) | ((score == last) & (ids < self.ids[row, -1]))
        if not on.any():
            return
        row, score, raw, ids = row[on], score[on], raw[on], ids[on]
        rows, top = np.unique(row), self.score.shape[1]
        row, score, raw, ids = (np.concatenate(x) for x in ((np.repeat(rows, top), row), (self.score[rows].ravel(), score), (self.raw[rows].ravel(), raw), (self.ids[rows].ravel(), ids)))
        order = np.lexsort((ids, -score, row))
        first = np.searchsorted(row[order], rows)
        at = order[first[:, None] + np.arange(top)]
        self.score[rows], self.raw[rows], self.ids[rows] = score[at], raw[at], ids[at]


def _closest(left: DataFrame, right: DataFrame, names: tuple[str, str], top: int | None, own: bool, digits: int, least: float | None, above: float | None, rows: int) -> DataFrame:
    """``names`` (a row of ``left`` by its first column, one of ``right`` by id), score (rounded) and raw of every pair asked for: each row's
    ``top`` in its part of ``right``, or all. Rows of one g or of none don't meet if both sides have it; where ``left`` has an array open,
    only rows of those g do; a row of the same id doesn't if ``own``."""
    key, grouped, opened, margin = left.columns[0], "g" in left.columns, "open" in left.columns, 1.01 * 10.0**-digits
    schema = f"{names[0]} {left.schema[key].dataType.simpleString()}, {names[1]} {right.schema['id'].dataType.simpleString()}, score double, raw double"

    def visit(a: pa.Table, tables):
        x, ia, best = _matrix(a), _ids(a, key), None
        ga, none = (_ids(a, "g"), _none(a["g"].type)) if grouped else (None, None)
        if opened:
            lists = a["open"].combine_chunks()
            of, asked = np.repeat(np.arange(len(x)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()
        table = lambda i, ids, score, raw: pa.table([a[key].take(pa.array(i)), ids, pa.array(score), pa.array(raw)], names=[*names, "score", "raw"])
        low = max([-np.inf, *([least - margin] if least is not None else []), *([above] if above is not None else [])])
        for b in tables:
            y, ib, gb, kind = _matrix(b).T, _ids(b, "id"), _ids(b, "g") if grouped or opened else None, b["id"].type
            best = Best(len(x), top, ib.dtype) if best is None and top is not None else best
            not_a, not_b = _same(ia, ib) if own else (np.zeros(0, np.int64),) * 2
            if opened:
                known, group = np.unique(gb, return_inverse=True)
                g = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                on, may = known[g] == asked, np.zeros((len(x), len(known)), bool)
                may[of[on], g[on]] = True
            for at in range(0, len(x), STRIP):
                raw = x[at : at + STRIP] @ y
                if opened:
                    raw[~may[at : at + STRIP][:, group]] = -np.inf
                here = (not_a >= at) & (not_a < at + STRIP)
                raw[not_a[here] - at, not_b[here]] = -np.inf
                if grouped:
                    raw[(ga[at : at + STRIP, None] == gb[None]) | (ga[at : at + STRIP, None] == none) | (gb[None] == none)] = -np.inf
                floor = np.full(len(raw), low)
                if best is not None:
                    floor = np.maximum(floor, best.score[at : at + STRIP, -1] - margin)
                    if np.isneginf(floor).any() and raw.shape[1] > 4 * top:  # as many as these are here
                        floor = np.maximum(floor, np.partition(raw, -top, 1)[:, -top] - margin)
                i, j = np.nonzero(raw > floor[:, None])
                r = raw[i, j]
                score = np.round(r, digits)
                if least is not None:
                    on = score >= least
                    i, j, r, score = i[on], j[on], r[on], score[on]
                if best is not None:
                    best.add(at + i, score, r, ib[j])
                else:
                    yield table(at + i, b["id"].take(pa.array(j)), score, r)
        if best is not None:
            i, j = np.nonzero(np.isfinite(best.score))
            ids = best.ids[i, j]
            yield table(i, pa.array(ids.tolist(), kind, mask=ids == _none(kind)), best.score[i, j], best.raw[i, j])

    got = _met(left, right, visit, schema, rows)
    if top is None:
        return got
    w = Window.partitionBy(names[0]).orderBy(F.desc("score"), names[1])
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def neighbours(df: DataFrame, top: int | None, least: float | None = None, other_group: bool = False, above: float | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """id, other, score (6 digits), rank: each row's nearest others, ties to the smaller id.

    ``df`` has id, unit vectors v and, for ``other_group``, a column g that must differ. ``least`` bounds the
    rounded score, ``above`` the unrounded one.
    """
    kept = save(df.select("id", *["g"] * other_group, "v"), "vectors")
    return _closest(kept, kept, ("id", "other"), top, True, 6, least, above, rows).drop("raw")


def _products(a: pa.Table, b: pa.Table, own: bool) -> tuple[pa.Table, np.ndarray]:
    """``b`` by id, and the products of all rows; those of a query with the row of its own id are -inf if ``own``."""
    b = b.sort_by("id")
    raw = _matrix(a) @ _matrix(b).T
    if own:
        raw[a["query_id"].to_numpy()[:, None] == b["id"].to_numpy()[None]] = -np.inf
    return b, raw


def _types(queries: DataFrame, df: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, node_id {df.schema['id'].dataType.simpleString()}"


def nearest(queries: DataFrame, df: DataFrame, top: int | None, own: bool = True, digits: int = 6, rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, node_id, score (``digits``), raw, rank: each query's ``top`` rows, ties to the smaller id; all, without rank, if None.

    Blocks of queries (query_id, v) meet the rows (id, v); a task keeps ``top`` a query before anything is shuffled.
    ``own`` leaves out the row whose id is the query's.
    """
    return _closest(queries.select("query_id", "v"), df.select("id", "v"), ("query_id", "node_id"), top, own, digits, None, None, rows)


def nearest_open(queries: DataFrame, df: DataFrame, top: int | None, rows: int = BLOCK_ROWS) -> DataFrame:
    """As :func:`nearest`, among the rows whose g is in the query's array open."""
    df = df.where("g IS NOT NULL").select("id", "g", "v")
    return _closest(queries.select("query_id", "v", "open"), df, ("query_id", "node_id"), top, True, 6, None, None, rows)


def pooled(queries: DataFrame, df: DataFrame, top: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, node_id, label, score: of each block of ``df`` (id, g, v) a query's ``top`` rows and the best of every group.

    So it holds a query's ``top`` rows and each group's best over all blocks, which is all that gates and diverse picks need.
    """

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b, raw = _products(a, b, True) if a.num_rows and b.num_rows else (b, np.zeros((0, 0)))
        s = np.round(raw, 6)
        group = np.unique(b["g"].fill_null(np.iinfo(np.int64).min).to_numpy(), return_inverse=True)[1]
        at = []
        for x in s:
            i = np.argsort(-x, kind="stable")
            i = i[np.isfinite(x[i])]
            first = np.unique(group[i], return_index=True)[1]
            at.append(i[np.union1d(first, np.arange(min(top, len(i))))])
        of = np.repeat(np.arange(len(at)), [len(i) for i in at])
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        return pa.table([a["query_id"].take(pa.array(of)), b["id"].take(pa.array(at)), b["g"].take(pa.array(at)), pa.array(s[of, at])], names=["query_id", "node_id", "label", "score"])

    queries, df = queries.select("query_id", "v"), df.select("id", F.col("g").cast("long").alias("g"), "v")
    return _met(queries, df, _each(run, rows), f"{_types(queries, df)}, label long, score double", rows)


def marginal(queries: DataFrame, df: DataFrame, weight: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, node_id, m, score, v: of each block of ``df`` (id, v) the row of the greatest marginal relevance ``m`` (9 digits).

    ``queries`` has query_id, v, the ids taken before and, one after the other, their vectors (others). A query's own row and
    those taken stay out; ties go to the smaller id.
    """

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b, raw = _products(a, b, True) if a.num_rows and b.num_rows else (b, np.zeros((0, 0)))
        of, at, m, s = [], [], [], np.round(raw, 6)
        x, ids = (_matrix(b), b["id"].to_numpy()) if len(raw) else (None, None)
        for i, score in enumerate(s):
            others = np.asarray(a["others"][i].as_py(), np.float64)
            near = (x @ others.reshape(-1, x.shape[1]).T).max(1) if len(others) else 0.0
            v = np.round(weight * score - (1 - weight) * near, 9)
            v[np.isin(ids, a["ids"][i].as_py())] = -np.inf
            j = int(v.argmax())
            if np.isfinite(v[j]):
                of.append(i), at.append(j), m.append(v[j])
        i, j = pa.array(of, pa.int64()), pa.array(at, pa.int64())
        return pa.table([a["query_id"].take(i), b["id"].take(j), pa.array(m, pa.float64()), pa.array([s[y, z] for y, z in zip(of, at, strict=True)], pa.float64()), b["v"].take(j)], names=["query_id", "node_id", "m", "score", "v"])

    return _met(queries, df, _each(run, rows), f"{_types(queries, df)}, m double, score double, v array<double>", rows)


def query_statistics(queries: DataFrame, df: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, n, total, squares, low, tops: sums, least and the two greatest of a query's scores (6 digits) with all other rows."""
    names, kinds = ["n", "total", "squares", "low", "tops"], [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        s = np.round(_products(a, b, True)[1], 6) if a.num_rows and b.num_rows else np.zeros((0, 0))
        kept = [x[np.isfinite(x)] for x in s]
        some = [i for i, x in enumerate(kept) if len(x)]
        kept = [kept[i] for i in some]
        cols = [[len(x) for x in kept], [x.sum() for x in kept], [(x * x).sum() for x in kept], [x.min() for x in kept], [np.sort(x)[::-1][:2] for x in kept]]
        return pa.table([a["query_id"].take(pa.array(some, pa.int64()))] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["query_id", *names])

    queries, df = queries.select("query_id", "v"), df.select("id", "v")
    got = _met(queries, df, _each(run, rows), f"{_types(queries, df).split(',')[0]}, n long, total double, squares double, low double, tops array<double>", rows)
    tops = F.slice(F.sort_array(F.flatten(F.collect_list("tops")), False), 1, 2)  # two numbers a block
    return got.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in names[:3]], F.min("low").alias("low"), tops.alias("tops"))


def pair_statistics(df: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """id, n, total, squares, best: sums over each row's products with all others."""
    kept = save(df.select("id", "v"), "vectors")

    def visit(a: pa.Table, tables):
        x, ia = _matrix(a), _ids(a, "id")
        n, total, squares, best = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x)), np.full(len(x), -np.inf)
        for b in tables:
            y = _matrix(b).T
            not_a, not_b = _same(ia, _ids(b, "id"))
            n += b.num_rows - np.bincount(not_a, minlength=len(x))
            for at in range(0, len(x), STRIP):
                here, part = (not_a >= at) & (not_a < at + STRIP), slice(at, at + STRIP)
                own = (not_a[here] - at, not_b[here])
                s = x[part] @ y
                s[own] = 0
                total[part] += s.sum(1)
                squares[part] += np.einsum("ij,ij->i", s, s)
                s[own] = -np.inf
                best[part] = np.maximum(best[part], s.max(1))
        yield pa.table([a["id"], pa.array(n), pa.array(total), pa.array(squares), pa.array(best)], names=["id", "n", "total", "squares", "best"])

    got = _met(kept, kept, visit, f"id {df.schema['id'].dataType.simpleString()}, n long, total double, squares double, best double", rows)
    return got.groupBy("id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.max("best").alias("best"))


def moment_alpha(df: DataFrame, low: float = 0.35, high: float = 0.90, none: float = 0.6) -> float:
    """As :func:`auto_alpha` of all pairs, without making any: the products' sum is |sum of v|^2 less the own products,
    and that of their squares comes from the second moments (d x d)."""
    ship(df.sparkSession)

    def sums(it):
        n, own, own2, s, m = 0, 0.0, 0.0, None, None
        for b in it:
            if not b.num_rows:
                continue
            if b.schema.names[0] == "v":
                x = np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
                sq = (x * x).sum(1)
                more = [(b.num_rows, sq.sum(), (sq * sq).sum(), x.sum(0), x.T @ x)]
            else:
                more = [(r["n"], r["own"], r["own2"], np.frombuffer(r["s"]), np.frombuffer(r["m"]).reshape(len(r["s"]) // 8, -1)) for r in b.to_pylist()]
            for a, o, o2, s1, m1 in more:
                n, own, own2 = n + a, own + o, own2 + o2
                s, m = (s1, m1) if s is None else (s + s1, m + m1)
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "own": own, "own2": own2, "s": s.tobytes(), "m": m.tobytes()}])

    kind = "n long, own double, own2 double, s binary, m binary"
    parts = df.select("v").mapInArrow(sums, kind).repartition(8).mapInArrow(sums, kind).collect()  # 8 rows of d x d numbers at most
    n, own, own2 = (sum(r[c] for r in parts) for c in ("n", "own", "own2"))
    if n < 2:
        return none
    s, m = sum(np.frombuffer(r["s"]) for r in parts), sum(np.frombuffer(r["m"]) for r in parts)
    pairs = n * (n - 1)
    mean = (float(s @ s) - own) / pairs
    dev = max(0.0, (float(m @ m) - own2) / pairs - mean * mean) ** 0.5
    return float(min(max(round(mean + dev, 6), low), high))


def auto_alpha(stats: DataFrame, low: float = 0.35, high: float = 0.90, none: float = 0.6) -> float:
    """Mean plus population deviation of all products, kept in [low, high]."""
    n, s, q = stats.agg(F.sum("n"), F.sum("total"), F.sum("squares")).first()
    if not n:
        return none
    mean = s / n
    return float(min(max(round(mean + max(0.0, q / n - mean * mean) ** 0.5, 6), low), high))
