"""Units, sections, chunks and keywords of texts, in DataFrame functions; only words are counted in numpy.

All work on one row a document (or its exploded units): the sequential fold of the chunker is an
``aggregate`` inside the row, so no shuffle is needed up to the final aggregates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from groveline.session import ship

BLANK = " \t\n\x0b\x0c\r"
# Headings, stop words and patterns that results depend on.
HEADINGS = "Section|Chapter|Abstract|Introduction|Methods|Results|Discussion|Conclusion"
HEADING_LINE = rf"(?i)^(#|(?:{HEADINGS})(?:[^A-Za-z0-9_]|$))"
HEADING_UNIT = rf"(?i)^(#+|[0-9]+\.|(?:{HEADINGS})(?:[^A-Za-z0-9_]|$))"
SENTENCE_BREAK = r"(?U)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!)\s+"
DEFAULT_SECTION = "General Overview"
STOP_WORDS = (
    "this", "that", "with", "from", "were", "have", "been", "which", "under", "across", "during", "while",
    "their", "these", "those", "there", "into", "total", "also", "than", "such", "will", "other", "over", "each", "both",
)
HEADING_WORDS = 15


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def lines(text: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")


def is_heading_line(line: Column) -> Column:
    return line.rlike(HEADING_LINE)


def sentences_of_line(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, SENTENCE_BREAK), lambda s: F.btrim(s, F.lit(BLANK))), lambda s: s != "")


def units(text: Column) -> Column:
    """Heading lines as they stand, other lines by sentence."""
    return F.flatten(F.transform(lines(text), lambda x: F.when(is_heading_line(x), F.array(x)).otherwise(sentences_of_line(x))))


def with_units(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, unit_idx, unit: a row a unit."""
    return docs.select(key, F.posexplode(units(F.col("text"))).alias("unit_idx", "unit"))


def is_heading_unit(unit: Column) -> Column:
    return unit.rlike(HEADING_UNIT) & (n_words(unit) < HEADING_WORDS)


def heading_name(unit: Column) -> Column:
    return F.btrim(F.btrim(unit, F.lit("#")), F.lit(BLANK))


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sectioned(text: Column) -> Column:
    """Structs (section, unit, n) of the content units; headings are consumed.

    The units between one heading and the next are one slice, so the work grows with the units, not their square.
    """
    sized = F.transform(units(text), lambda u: F.struct(u.alias("unit"), n_words(u).alias("n")))
    marked = F.transform(sized, lambda x: F.struct(x["unit"].alias("unit"), x["n"].alias("n"), (x["unit"].rlike(HEADING_UNIT) & (x["n"] < HEADING_WORDS)).alias("head")))

    def between(x: Column, a: Column, b: Column) -> Column:
        name = F.when(a < 0, F.lit(DEFAULT_SECTION)).otherwise(heading_name(F.get(x, a)["unit"]))
        part = F.slice(x, a + 2, b - a - 1)
        return bound(name, lambda s: F.transform(part, lambda u: F.struct(s.alias("section"), u["unit"].alias("unit"), u["n"].alias("n"))))

    def cut(x: Column) -> Column:
        heads = F.filter(F.transform(x, lambda u, i: F.when(u["head"], i)), lambda i: i.isNotNull())
        return bound(heads, lambda h: F.flatten(F.zip_with(F.concat(F.array(F.lit(-1)), h), F.concat(h, F.array(F.size(x))), lambda a, b: between(x, a, b))))

    return bound(marked, cut)


def bounds(sizes: Column, size: int, overlap: int) -> Column:
    """Structs (a, b): each chunk holds the units from a to before b.

    A chunk ends where the next unit would pass ``size`` words; the next begins with the longest run of whole
    units of at most ``overlap`` words that ends there. State: the open chunk's start and words.
    """
    kind = "array<struct<a:int,b:int>>"
    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("w"), F.array().cast(kind).alias("out"))

    def flushed(sizes: Column, s: Column, i: Column, n: Column) -> Column:
        """The state after the chunk before unit i is closed: the run carried over is counted back from i."""
        back = F.reverse(F.slice(sizes, s["a"] + 1, i - s["a"]))
        zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("w"), F.lit(True).alias("on"))
        more = lambda c, m: F.when(c["on"] & (c["w"] + m <= overlap), F.struct((c["k"] + 1).alias("k"), (c["w"] + m).alias("w"), F.lit(True).alias("on"))).otherwise(F.struct(c["k"].alias("k"), c["w"].alias("w"), F.lit(False).alias("on")))
        out = F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), i.alias("b"))))
        return F.aggregate(back, zero, more, lambda c: F.struct((i - c["k"]).alias("a"), (c["w"] + n).alias("w"), out.alias("out")))

    def step(sizes: Column, s: Column, i: Column) -> Column:
        n = F.element_at(sizes, i + 1)
        full = (s["w"] + n > size) & (i > s["a"])
        return F.when(full, flushed(sizes, s, i, n)).otherwise(F.struct(s["a"].alias("a"), (s["w"] + n).alias("w"), s["out"].alias("out")))

    def every(z: Column) -> Column:
        last = F.size(z)
        made = F.aggregate(F.sequence(F.lit(0), last - 1), start, lambda s, i: step(z, s, i), lambda s: F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), last.alias("b")))))
        return F.when(last == 0, F.array().cast(kind)).otherwise(made)

    return bound(sizes, every)


def dominant_section(sections: Column) -> Column:
    """The most frequent section; of equals the earliest."""
    kinds = F.array_distinct(sections)
    counted = F.transform(kinds, lambda x: F.struct(F.size(F.filter(sections, lambda y: y == x)).alias("n"), (-F.array_position(kinds, x)).alias("p"), x.alias("s")))
    return F.array_max(counted)["s"]


def chunks(docs: DataFrame, size: int = 60, overlap: int = 15, digits: int = 10, key: str = "doc_id") -> DataFrame:
    """key, chunk_index, first_unit, end_unit, section, text, token_count, hash, chunk_id: a row a chunk."""
    made = docs.select(key, sectioned(F.col("text")).alias("u"))
    part = lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), F.slice("u", c["a"] + 1, c["b"] - c["a"]).alias("p"))
    cut = made.select(key, F.posexplode(F.transform(bounds(F.transform("u", lambda x: x["n"]), size, overlap), part)).alias("chunk_index", "c"))
    out = cut.select(key, "chunk_index", F.col("c.a").alias("first_unit"), F.col("c.b").alias("end_unit"), F.col("c.p").alias("p"))
    out = out.select(
        key, "chunk_index", "first_unit", "end_unit",
        dominant_section(F.transform("p", lambda x: x["section"])).alias("section"),
        F.array_join(F.transform("p", lambda x: x["unit"]), " ").alias("text"),
        F.aggregate("p", F.lit(0), lambda s, x: s + x["n"]).alias("token_count"),
    )
    out = out.withColumn("hash", F.substring(F.sha2("text", 256), 1, digits))
    return out.withColumn("chunk_id", F.concat(F.col(key).cast("string"), F.lit("_c"), F.col("chunk_index").cast("string"), F.lit("_"), F.col("hash")))


def embedding_text(section: Column, text: Column) -> Column:
    return F.when(F.coalesce(section, F.lit("")) != "", F.btrim(F.concat(section, F.lit(": "), text), F.lit(": "))).otherwise(text)


def snippet(text: Column, n: int, mark: str = "...") -> Column:
    return F.concat(F.substring(text, 1, n), F.lit(mark))


#: Words with characters beyond ASCII are masked, so that word boundaries mean the same everywhere.
FOREIGN_WORD = r"[A-Za-z0-9_]*[^\x00-\x7F](?:[A-Za-z0-9_]|[^\x00-\x7F])*"


def masked(text: Column) -> Column:
    """As ``FOREIGN_WORD``, in a form that starts at the start of a word only and never goes back."""
    beyond = r"\x{80}-\x{10FFFF}"
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?<![A-Za-z0-9_])[A-Za-z0-9_]*+[{beyond}][A-Za-z0-9_{beyond}]*+", "\x01")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


KEYWORD = r"\b[A-Za-z][A-Za-z0-9&/-]{3,}\b"


def keywords(texts: DataFrame, group: str, top: int = 6) -> DataFrame:
    """group, rank, keyword, freq: capitals stay, other words are lower-cased; stop words go."""
    w = texts.select(group, F.explode(matches(masked(F.col("text")), KEYWORD)).alias("w"))
    w = w.select(group, F.when(F.upper("w") == F.col("w"), F.col("w")).otherwise(F.lower("w")).alias("keyword"))
    w = w.where(~F.lower("keyword").isin(*STOP_WORDS)).groupBy(group, "keyword").agg(F.count("*").alias("freq"))
    r = Window.partitionBy(group).orderBy(F.desc("freq"), F.lower("keyword"), "keyword")
    return w.withColumn("rank", F.row_number().over(r)).where(F.col("rank") <= top).select(group, "rank", "keyword", "freq")


def key_entities(text: Column, top: int = 10) -> Column:
    return F.slice(F.array_sort(F.array_distinct(matches(masked(text), r"\b[A-Z][a-zA-Z0-9_-]+\b"))), 1, top)


def _most_frequent(rows: pa.ListArray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of sentences of words: how many sentences each row has picked, and which of all sentences, best first.

    A sentence scores the sum, over its words, of the word's count in the row; ties go to the earlier one.
    """
    sentences, many = rows.flatten(), pc.list_value_length(rows).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(rows)), many)
    at = np.repeat(np.arange(len(sentences)), pc.list_value_length(sentences).to_numpy(zero_copy_only=False))
    coded = sentences.flatten().dictionary_encode()
    word = of[at] * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    _, which, count = np.unique(word, return_inverse=True, return_counts=True)
    score = np.bincount(at, count[which], len(sentences))
    order = np.lexsort((-score, of))  # stable: the earlier of equals first
    on = np.arange(len(order)) - np.repeat(np.cumsum(many) - many, many) < top
    return np.minimum(many, top), order[on]


def frequency_abstract(docs: DataFrame, key: str = "doc_id", top: int = 3) -> DataFrame:
    """key, abstract: the ``top`` sentences with the most frequent words, and entities, in one string.

    Sentences are split at full stops and longer than 15 characters; a word counts with more than 3. A text's words are
    counted where it stands, without a shuffle.
    """
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    ents = F.slice(key_entities(text), 1, 5)
    tail = F.when(F.size(ents) > 0, F.concat(F.lit(" [Entities: "), F.array_join(ents, ", "), F.lit("]"))).otherwise("")
    s = F.filter(F.transform(F.split(text, r"\."), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: F.length(x) > 15)
    tokens = lambda x: F.filter(words(F.lower(x)), lambda w: F.length(w) > 3)
    d = docs.select(F.col(key).alias("key"), F.concat(F.substring(text, 1, 150), F.lit("...")).alias("head"), tail.alias("tail"), s.alias("s"))
    kept = StructType([d.schema[c] for c in ("key", "head", "tail")])

    def run(it):
        for b in it:
            many, best = _most_frequent(b.column(4), top)
            picked = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), b.column(3).flatten().take(pa.array(best)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], picked], names=[*kept.names, "best"])

    made = d.withColumn("tokens", F.transform("s", tokens)).mapInArrow(run, StructType([*kept.fields]).add("best", ArrayType(StringType())))
    body = F.when(F.size("best") > 0, F.array_join("best", " | ")).otherwise(F.col("head"))
    return made.select(F.col("key").alias(key), F.concat(F.lit("ABSTRACT SUMMARY: "), body, F.col("tail")).alias("abstract"))
