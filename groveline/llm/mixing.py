"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with share ``w`` of the target and size ``s`` (characters) gets the mean repetition rate
``w * total / s``. A document's count is the Poisson quantile, at that mean, of a uniform number
hashed from its doc_id, so it is the same in every run; the document is exploded by its count and
the copies are put in one global order by a hash.

Cases: sources absent from ``weights`` get ``default_weight`` each; a null source is a source of
its own; null and empty texts count one character, so that they too have a rate; a null doc_id hashes as
an empty string; repeated rows get equal counts; a rate of 0 keeps no copy, as asked; rates are capped nowhere (a
mean above ``EXACT`` is split into equal parts whose counts are added, which is the same
distribution); an empty table gives an empty one. Columns of the input stay; one called as one of the
operator's three own (``own``, by default rate, copy, shuffle_key) gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groveline.llm.common import field, free, save

#: Means up to this are inverted directly.
EXACT = 16.0
#: Sources whose rates are broadcast; with more, rates are joined by a shuffle on a salted key.
BROADCAST_SOURCES = 10_000
SALTS = 64


def uniform(key: Column, salt: Column | str) -> Column:
    """A number in (0, 1) from the first 48 bits of an md5."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    h = F.conv(F.substring(F.md5(F.concat_ws("|", salt, key)), 1, 12), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(float(1 << 48))


def poisson_quantile(u: Column, mean: Column) -> Column:
    """The least k with P(X <= k) >= u: sums the mass until it passes ``u``. ``mean`` up to EXACT."""
    most = int(EXACT + 16 * EXACT**0.5 + 32)  # the mass beyond is below 2**-60
    zero = F.exp(-mean)
    # u and the mean travel in the state, so that they are computed once and not in every step
    start = F.struct(F.lit(0).alias("k"), zero.alias("p"), zero.alias("c"), u.alias("u"), mean.alias("m"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * s["m"] / i
        more = F.struct(i.alias("k"), p.alias("p"), (s["c"] + p).alias("c"), s["u"].alias("u"), s["m"].alias("m"))
        return F.when(s["c"] >= s["u"], s).otherwise(more)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["k"])


def _count(key: Column, rate: Column, seed: str) -> Column:
    parts = F.greatest(F.lit(1), F.ceil(rate / EXACT)).cast("int")
    one = rate / parts
    return F.when(rate <= 0, F.lit(0)).otherwise(
        F.aggregate(
            F.sequence(F.lit(1), parts),
            F.lit(0),
            lambda s, i: s + poisson_quantile(uniform(key, F.concat(F.lit(seed + "/"), i.cast("string"))), one),
        )
    )


def rates(docs: DataFrame, weights: dict[str, float], default_weight: float, repeat: float = 1.0) -> tuple[DataFrame, int]:
    """source_key, rate: a row a source, and how many. ``repeat`` scales the mixed corpus against the input."""
    size = F.greatest(F.lit(1), F.length(F.coalesce(F.col("text"), F.lit(""))))
    by = docs.groupBy(_source().alias("source_key")).agg(F.sum(size).alias("size"))
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in ("s:" + kv[0], float(kv[1]))]), F.col("source_key")), F.lit(float(default_weight))) if weights else F.lit(float(default_weight))
    by = save(by.withColumn("w", w), "source_sizes")
    n, all_size, all_w = by.agg(F.count("*"), F.sum("size"), F.sum("w")).first()
    if not n or not all_w:
        return by.select("source_key", F.lit(0.0).alias("rate")), n
    rate = F.lit(float(repeat)) * F.col("w") / F.lit(float(all_w)) * F.lit(float(all_size)) / F.col("size")
    return by.select("source_key", rate.alias("rate")), n


def _source() -> Column:
    return F.when(F.col("source").isNull(), F.lit("n:")).otherwise(F.concat(F.lit("s:"), F.col("source").cast("string")))


def mix(
    docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, repeat: float = 1.0, seed: str = "mix", own: tuple[str, str, str] = ("rate", "copy", "shuffle_key")
) -> DataFrame:
    """``docs`` with columns rate, copy (from 1) and shuffle_key, named as in ``own``; a row a copy, ordered by shuffle_key."""
    rate, copy, shuffle_key = own
    docs = docs.drop(*own)
    names = docs.columns
    source, salt, times = free([*names, *own], "source_key", "salt", "times")
    r, n = rates(docs, weights, default_weight, repeat)
    r = r.select(F.col("source_key").alias(source), F.col("rate").alias(rate))
    keyed = docs.withColumn(source, _source())
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    if n <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(r), source)
    else:
        salted = r.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, [source, salt])
    counted = joined.withColumn(times, _count(key, F.col(rate), seed)).where(F.col(times) > 0)
    copies = counted.select(*[F.col(field(c)) for c in names], rate, F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy))
    order = F.md5(F.concat_ws("|", F.lit(seed + "/order"), key, F.col(copy).cast("string")))
    return copies.withColumn(shuffle_key, order).orderBy(shuffle_key, "doc_id", copy)
