"""Quality rules with the frequency of lines across documents, in DataFrame functions only.

Lines are normalised (white space to single spaces, lower case) and hashed; for each host, the distinct documents with a line
are counted. Lines in more documents than the limit are removed; a document of which they are more than half is rejected.
The limit is a number of documents, so what is common stays so as a host grows.
A window of eight words is known by a 64-bit hash built from those of its halves.

Defined results: null text has no words; a null host is a host of its own; a line's documents are counted by distinct doc_id (by text
where that is null); rows of one id, host and text get equal results; empty lines count nowhere; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilis.llm.common import SPACE, need

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _pairs(hashes: Column, step: int, n: Column) -> Column:
    """Hash of elements i and i + step, for each i; those near the end have no meaning and are cut off later."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, n), lambda a, b: F.xxhash64(a, b))


def word_columns(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of ``text``."""
    out = docs.withColumn("__text", F.coalesce(text, F.lit("")))
    out = out.withColumn("__words", F.filter(F.split("__text", SPACE), lambda w: w != ""))
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    n = F.greatest(F.col("n_words").cast("int"), F.lit(1))
    out = out.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    out = out.withColumn("__h", _pairs(F.col("__h"), 1, n)).withColumn("__h", _pairs(F.col("__h"), 2, n)).withColumn("__h", _pairs(F.col("__h"), 4, n))
    out = out.withColumn("__h", F.slice("__h", 1, F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0))))
    # sorted (hash, place) only where some window is found twice
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    out = out.withColumn("__sorted", F.when(twice, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("__sorted")
    equal = lambda x, k: F.get(s, k)["h"].eqNullSafe(x["h"])
    found = F.transform(s, lambda x, k: F.when(equal(x, k - 1) | equal(x, k + 1), x["i"]))
    out = out.withColumn("__at", F.sort_array(F.filter(found, lambda i: i.isNotNull())))
    start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("__at", start, lambda a, i: F.struct((a["c"] + F.least(F.lit(WINDOW), i - a["last"])).alias("c"), i.alias("last")), lambda a: a["c"])
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = out.withColumn("__lines", lines)
    return out.select(
        *docs.columns,
        "n_words",
        F.length(F.regexp_replace("__text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def normalised(line: Column) -> Column:
    """Lower case with single spaces."""
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def normalised_lines(text: Column) -> Column:
    """Lower-case lines with single spaces, those with a word."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normalised), lambda x: x != "")


def line_chars(text: Column) -> Column:
    """Characters of all normalised lines."""
    return F.aggregate(normalised_lines(text), F.lit(0).cast("long"), lambda a, x: a + F.length(x))


def without_lines(text: Column, places: Column) -> Column:
    """``text`` without its lines at ``places`` (distinct, from 0); by a set difference, so in time proportional to the lines."""
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")


def common_lines(docs: DataFrame, max_docs: int) -> DataFrame:
    """__ch, __cl: hosts and hashes of lines above the limit. ``docs``: doc_id, __host, text, __key."""
    own = F.explode(F.array_distinct(F.transform(normalised_lines(F.col("text")), lambda x: F.xxhash64(x)))).alias("__hash")
    # documents without an id are told apart by their texts
    other = F.when(F.col("doc_id").isNull(), F.col("__key")).alias("__other")
    seen = docs.select("doc_id", other, "__host", own).groupBy("__host", "__hash", "doc_id", "__other").agg(F.lit(1).alias("__one"))
    counts = seen.groupBy("__host", "__hash").agg(F.count("*").alias("__n")).where(F.col("__n") > max_docs)
    return counts.select(F.col("__host").alias("__ch"), F.col("__hash").alias("__cl"))


def line_frequency(docs: DataFrame, host: str = "source", max_docs: int = 10, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """doc_id, text without its common lines, the word columns, base_failed, removed_chars, line_chars and kept for every row of ``docs``.

    A line is removed where more than ``max_docs`` documents of its host have it.
    The word columns are of the text as it was; a null text stays null.
    """
    need(docs, ["doc_id", "text", host])
    keyed = docs.select("doc_id", F.col(host).alias("__host"), "text", F.xxhash64("text").alias("__key"))
    common = common_lines(keyed, max_docs)
    places = F.transform(F.split("text", "\n"), lambda x, i: F.struct(normalised(x).alias("line"), i.alias("place")))
    part = lambda x: F.struct(F.xxhash64(x["line"]).alias("hash"), x["place"].alias("place"), F.length(x["line"]).alias("chars"))
    lines = keyed.select("doc_id", "__key", "__host", F.inline(F.transform(F.filter(places, lambda x: x["line"] != ""), part)))
    gone = lines.join(common, F.col("__host").eqNullSafe(F.col("__ch")) & (F.col("hash") == F.col("__cl")))
    # a document's lines are bounded by its own text; rows of one id, host and text have the same lines
    own = F.collect_set(F.struct("place", "chars")).alias("__gone")
    gone = gone.groupBy(F.col("doc_id").alias("__d"), F.col("__key").alias("__k"), F.col("__host").alias("__g")).agg(own)
    base = word_columns(keyed.withColumn("line_chars", line_chars(F.col("text"))), F.col("text"))
    at = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("__key").eqNullSafe(F.col("__k")) & F.col("__host").eqNullSafe(F.col("__g"))
    # who asks for no texts has none in the join: all other columns are worked out before it
    out = base.join(gone, at, "left").withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("__gone.place"))))
    removed = F.aggregate("__gone", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    out = out.withColumn("removed_chars", F.coalesce(removed, F.lit(0).cast("long")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return out.select(
        "doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        "removed_chars", "line_chars", (~failed & ~(2 * F.col("removed_chars") > F.col("line_chars"))).alias("kept"),
    )
