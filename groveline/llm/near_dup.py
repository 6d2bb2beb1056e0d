"""MinHash near-duplicate groups from bottom-k sketches.

One hash function over word shingles; a text's sketch is its ``SKETCH`` smallest hash values.

1. Texts with equal shingle sets form a class; one row a class goes on.
2. Inverted lists: retained value to classes. A value that one class holds makes no pair. In each
   class, values are ordered by the length of their lists, and only so many of the rarest stay that two
   sketches of similar texts must still share one (exactly where the sketch is the whole set;
   else but for a chance below 1e-9, see :func:`least_overlap`). Common passages drop out so.
3. Overlaps: in a first and second round every list pairs its members with one pivot of their
   size band, which is linear in the list; then only members that aren't yet in one component are paired.
4. The Jaccard index estimated on the union sketch discards pairs far below the threshold.
5. Full shingle sets of the remaining pairs' whole texts verify it: 100 * common >= threshold * union.
6. Verified links' connected components; the smallest doc_id names each.

No list, pair table or component is collected; no pairs inside a class are made.

Cases: null and empty texts, and texts of white space, have no shingles and link with nothing; texts
with fewer words than a shingle have one shingle of all of them; equal sets are linked, also across
repeated rows; different texts of one doc_id are judged each on its own; a row without doc_id is compared with nothing, its
component is null and it is kept; very long texts are hashed whole; an empty table gives an empty
result. Further columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groveline.llm import common as C

SKETCH = 192
#: Deviations that the sampled overlap may fall below its mean.
SIGMAS = 5.5
ROUNDS = 2


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and shingle hash (63 bits), distinct and sorted in each row."""
    rows, h = C.shingle_sets(data, off, width)
    return C.distinct_sorted(rows, h >> np.uint64(1))


def signature(h: np.ndarray) -> int:
    return int(np.int64(np.add.reduce(C.mix(h + np.uint64(0x5851F42D4C957F2D))).astype(np.uint64).view(np.int64)))


def least_overlap(n: int, k: int, share: float) -> int:
    """Values that the sketch of a set of ``n`` shares with that of any set at least ``share`` like it.

    Whole sets share ``share`` of the larger. Of the ``k`` smallest values of a union each is in both
    with chance ``share``: the count stays within ``SIGMAS`` deviations of its mean.
    """
    sampled = math.floor(k * share - SIGMAS * math.sqrt(k * share * (1 - share)))
    if n > k:
        return max(1, sampled)
    whole = math.ceil(share * n - 1e-9)
    return max(1, whole if n / share <= k else min(whole, sampled))


def _need(na, nb, share: float):
    """Values that the sketches of sets of ``na`` and ``nb`` share at least, if the sets are ``share`` alike.

    Both whole: the overlap itself. Else the overlap's part of the larger set, of ``SKETCH`` drawn
    values, less ``SIGMAS`` deviations.
    """
    both = (na + nb) * F.lit(share / (1 + share))
    part = F.least(F.lit(1.0), both / F.greatest(na, nb))
    drawn = F.lit(float(SKETCH)) * part - F.lit(SIGMAS) * F.sqrt(F.lit(float(SKETCH)) * part * (F.lit(1.0) - part))
    return F.greatest(F.lit(1), F.when(F.greatest(na, nb) <= SKETCH, F.ceil(both - F.lit(1e-6))).otherwise(F.floor(F.least(drawn, both))).cast("int"))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th (hash of the text), n, cls (hash of the set; null for none), sketch."""

    def run(it):
        for b in it:
            data, off = C.utf8(b.column(1))
            for lo, hi in C.runs_of_docs(off):
                rows, h = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width)
                n = np.bincount(rows, minlength=hi - lo)
                at = np.concatenate([[0], np.cumsum(n)])
                mixed = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(C.mix(h + np.uint64(0x5851F42D4C957F2D)), out=mixed[1:])
                cls = (mixed[at[1:]] - mixed[at[:-1]]).view(np.int64)
                kept = np.minimum(n, SKETCH)
                first = np.arange(len(h)) - np.repeat(at[:-1], n) < SKETCH  # values are sorted in each row
                sketch = C.lists(np.concatenate([[0], np.cumsum(kept)]), h[first].view(np.int64))
                cols = [b.column(0)[lo:hi], b.column(2)[lo:hi], pa.array(n, pa.int64()), pa.array(cls, mask=n == 0), sketch]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "n", "cls", "sketch"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash().alias("th"))
    return text.mapInArrow(C.light(run), "doc_id long, th long, n long, cls long, sketch array<long>")


def _text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def _postings(classes: DataFrame, share: float) -> DataFrame:
    """value, cls, n, band, pos, common: the rare part of each sketch, without values that one class holds.

    ``pos`` is the value's place in its sketch from the rarest on; ``common`` counts the sketch's values
    that other classes hold too.
    """
    all_ = classes.select(F.explode("sketch").alias("value"), "cls", F.col("n").cast("int").alias("n"))
    df = all_.groupBy("value").agg(F.count("*").cast("int").alias("df")).where("df >= 2")
    shared = all_.join(df, "value")
    per = Window.partitionBy("cls")
    held = F.least(F.col("n"), F.lit(SKETCH))
    need = F.element_at(F.array(*[F.lit(least_overlap(i, SKETCH, share)) for i in range(1, SKETCH + 2)]), F.least(F.col("n"), F.lit(SKETCH + 1)))
    common = F.count("*").over(per).cast("int")
    pos = held - common + F.row_number().over(per.orderBy("df", "value")) - 1  # values held once come first
    out = shared.withColumns({"common": common, "pos": pos.cast("int")}).where((F.col("pos") <= held - need) & (F.col("common") >= need))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1 / share))).cast("int")
    return out.select("value", "cls", "n", band.alias("band"), "pos", "common")


def _sized(share_pct: int):
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * share_pct


def _may_link(share_pct: int):
    """Length, count and prefix filters for a common value at ``pa`` and ``pb``: so many values must follow it in both."""
    need = _need(F.col("na"), F.col("nb"), share_pct / 100)
    fits = lambda n, pos: F.col(pos) + need <= F.least(F.col(n), F.lit(SKETCH))
    return _sized(share_pct) & (F.least("ma", "mb") >= need) & fits("na", "pa") & fits("nb", "pb")


def _sides(p: DataFrame, side: str, *more: str) -> DataFrame:
    return p.select("value", F.col("cls").alias(side), *[F.col(c).alias(k + side) for c, k in (("n", "n"), ("pos", "p"), ("common", "m"))], *more)


def _pivot_pairs(p: DataFrame, turn: int, share_pct: int) -> DataFrame:
    """Every member with the pivots of its own band and the one below in its list.

    A pivot holds the fewest values that no other class has, so it stands in the middle of its group.
    """
    own = F.least("n", F.lit(SKETCH)) - F.col("common")
    order = F.struct(own, F.xxhash64("cls", F.lit(turn)))
    pivot = p.groupBy("value", "band").agg(F.min(F.struct(order.alias("o"), "cls", "n", "pos", "common")).alias("p"))
    pivot = pivot.select("value", F.explode(F.array("band", F.col("band") + 1)).alias("band"), *[F.col("p." + c).alias(k + "b") for c, k in (("cls", ""), ("n", "n"), ("pos", "p"), ("common", "m"))])
    j = _sides(p, "a", "band").join(pivot, ["value", "band"]).where((F.col("a") != F.col("b")) & _may_link(share_pct))
    first = F.col("a") < F.col("b")
    return j.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(first, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()


def _open_pairs(p: DataFrame, comp: DataFrame, share_pct: int) -> DataFrame:
    """All pairs of a list whose members aren't in one component yet and pass the filters.

    A pair is made in the first list, in the order of rarity, that holds both: each member carries the
    values of its earlier open lists, at most a sketch's rare part. A closed list can't hold a pair
    of two components, and filters that a later value passes are passed by an earlier one.
    """
    c = _with_component(p, comp)
    left = c.groupBy("value").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("value")
    before = Window.partitionBy("cls").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    c = c.join(left, "value").withColumn("before", F.collect_list("value").over(before))
    x, y = _sides(c, "a", F.col("c").alias("ca"), F.col("before").alias("ba")), _sides(c, "b", F.col("c").alias("cb"), F.col("before").alias("bb"))
    new = (x["value"] == y["value"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _may_link(share_pct) & ~F.arrays_overlap("ba", "bb")
    return x.join(y, new).select("a", "b", "na", "nb").distinct()


def _with_component(p: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return p.withColumn("c", F.col("cls"))
    return p.join(comp.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("c", F.coalesce("component", "cls")).drop("component")


def _estimated(pairs: DataFrame, classes: DataFrame, share: float) -> DataFrame:
    """Pairs whose union sketch does not rule the threshold out, with their classes' first doc_ids."""
    ids = pairs.select("a").union(pairs.select("b")).distinct()
    few = C.only_ids(classes.select("cls", "first_doc", "n", "sketch"), F.col("cls"), ids, F.col("a"))
    left = few.select(F.col("cls").alias("a"), F.col("first_doc").alias("doc_a"), F.col("sketch").alias("sa"))
    right = few.select(F.col("cls").alias("b"), F.col("first_doc").alias("doc_b"), F.col("sketch").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "doc_a", "doc_b", "na", "nb", "sa", "sb")

    def run(it):
        for b in it:
            keep = np.zeros(b.num_rows, bool)
            na, nb = b.column(4).to_numpy(), b.column(5).to_numpy()
            for i, (x, y) in enumerate(zip(b.column(6), b.column(7), strict=True)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = np.intersect1d(x, y, assume_unique=True)
                if max(na[i], nb[i]) <= SKETCH:
                    keep[i] = len(both) >= share * (len(x) + len(y) - len(both)) - 1e-9
                    continue
                union = np.union1d(x, y)[:SKETCH]
                in_both = int(np.searchsorted(both, union[-1], "right"))
                u = len(union)
                keep[i] = in_both >= u * share - SIGMAS * math.sqrt(u * share * (1 - share))
            if keep.any():
                yield pa.RecordBatch.from_arrays(b.columns[:4], names=["a", "b", "doc_a", "doc_b"]).filter(pa.array(keep))

    return joined.mapInArrow(C.light(run), "a long, b long, doc_a long, doc_b long")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, share_pct: int) -> DataFrame:
    """Links a, b: pairs whose whole texts' sets pass."""
    ids = pairs.select(F.col("doc_a").alias("d")).union(pairs.select("doc_b")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = C.only_ids(texts, F.col("doc_id"), ids, F.col("d"))
    ta = texts.select(F.col("doc_id").alias("doc_a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("doc_id").alias("doc_b"), F.col("text").alias("tb"))
    joined = pairs.join(ta, "doc_a").join(tb, "doc_b").select("a", "b", "ta", "tb")

    def run(it):
        last: dict[int, np.ndarray] = {}

        def sets(cls: int, text: str) -> np.ndarray | None:
            """The set of a class, None if the text is another one's (of the same doc_id)."""
            if cls in last:
                return last[cls]
            data, off = C.utf8(pa.array([text]))
            h = shingles(data, off, width)[1]
            if signature(h) != cls:
                return None
            if len(last) >= 64:
                last.pop(next(iter(last)))
            last[cls] = h
            return h

        for batch in it:
            out = ([], [])
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = sets(a, x.as_py()), sets(b, y.as_py())
                if x is None or y is None:
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= share_pct * (len(x) + len(y) - common):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return joined.mapInArrow(C.light(run), "a long, b long").distinct()


def _judged(docs: DataFrame, width: int, share_pct: int) -> DataFrame:
    """doc_id, th, n_shingles, component_id, kept: a row a document."""
    spark = docs.sparkSession
    C.ship(spark)
    share = share_pct / 100
    all_ = C.save(sketches(docs, width), "sketches")
    classes = all_.where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("s"))
    classes = C.save(classes.select("cls", F.col("s.doc_id").alias("first_doc"), F.col("s.n").alias("n"), F.col("s.sketch").alias("sketch")), "classes")
    rows = C.save(all_.drop("sketch"), "sets")
    C.drop(all_)
    C.settle(spark)
    p = C.save(_postings(classes, share), "postings")
    C.settle(spark)

    links = tested = comp = None
    spent = []
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            now = p
            if turn:
                c = _with_component(p, comp)
                now = p.join(c.groupBy("value").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("value"), "value")
            pairs = _pivot_pairs(now, turn, share_pct)
            if turn:
                x, y = (comp.select(F.col("node").alias(s), F.col("component").alias("c" + s)) for s in "ab")
                pairs = pairs.join(x, "a", "left").join(y, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").drop("ca", "cb")
        else:
            pairs = _open_pairs(p, comp, share_pct)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = C.save(pairs, "pairs")
        spent.append(pairs)
        if comp is None:
            comp = C.save(p.select(F.col("cls").alias("node"), F.col("cls").alias("component")).limit(0), "components")
        if pairs.isEmpty():
            continue
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        likely = C.save(_estimated(pairs, classes, share), "estimated")
        found = C.save(_verified(likely, docs, width, share_pct), "links")
        C.drop(likely)
        spent.append(found)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            spent.append(comp)
            comp = C.components(links, "a", "b")
        C.settle(spark)

    grouped = classes.select("cls", "first_doc").join(comp.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    names = grouped.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    by_class = C.save(grouped.join(names, "component").select("cls", "component_id"), "class_components")
    for t in (*spent, p, classes, comp):
        C.drop(t)
    out = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    rows = rows.select("doc_id", "th", F.col("n").alias("n_shingles"), "cls").join(by_class, "cls", "left")
    return rows.select("doc_id", "th", "n_shingles", out.alias("component_id"), F.coalesce(F.col("doc_id") == out, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, width: int = 5, share_pct: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row a document."""
    return _judged(docs, width, share_pct).drop("th")


def dedup(docs: DataFrame, width: int = 5, share_pct: int = 80) -> DataFrame:
    """``docs`` with one document of each group, that with the smallest doc_id.

    Rows without shingles or doc_id all stay; of repeated rows (equal doc_id and text) one stays.
    """
    names = [C.field(c) for c in docs.columns]
    d, th, fate = C.free(docs.columns, "d", "th", "fate")
    judged = _judged(docs, width, share_pct).where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id", "th").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    gone = C.save(judged.where("NOT kept OR n > 1").select(F.col("doc_id").alias(d), F.col("th").alias(th), F.when(F.col("kept"), F.lit("repeated")).otherwise("gone").alias(fate)), "judged")
    marked = docs.select("*", F.col("doc_id").cast("long").alias(d), _text_hash().alias(th))
    marked = C.save(marked.join(gone, [d, th], "left").where(F.col(fate).isNull() | (F.col(fate) != "gone")), "survivors")
    once = marked.where(F.col(fate).isNotNull()).dropDuplicates([d, th])
    return marked.where(F.col(fate).isNull()).select(*names).unionByName(once.select(*names))


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {width} + 2), lambda i: array_to_string(ws[i:i + {width} - 1], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
e AS (SELECT doc_id, hash(unnest(sh)) AS h FROM s),
r AS (SELECT h FROM e GROUP BY h HAVING count(*) > 1),
f AS (SELECT e.* FROM e JOIN r USING (h)),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM f x JOIN f y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * n_both >= {share} * (p.n_shingles + q.n_shingles - n_both)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (WITH RECURSIVE t(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT t.a, g.b FROM t JOIN g ON t.b = g.a) SELECT a, min(b) AS component_id FROM t GROUP BY a)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN t ON a = doc_id"""
