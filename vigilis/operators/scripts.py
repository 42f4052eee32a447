"""Mentions inside text without spaces between words: a character q-gram index of the aliases.

Thai, Lao, Khmer, Burmese, Chinese and Japanese words stand one behind another, so an alias can begin anywhere. Each alias is known by
one of its q-grams, the one that the fewest aliases share. The q-grams of texts meet those by an equi-join; where they meet,
the alias is compared in full at its place. Only texts with such scripts are cut. A small lexicon is compared where the texts lie; with a
large one only hits meet texts again, by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilis.functions.unicode import strip_marks
from vigilis.operators.dedup import drop_nested

#: Scripts whose words aren't divided by spaces.
UNSPACED = "".join(f"\\p{{Is{s}}}" for s in ("Thai", "Lao", "Khmer", "Myanmar", "Han", "Hiragana", "Katakana"))

#: Aliases up to which a lexicon is sent to the scan of the texts.
FEW = 1000


def entity_key(text: Column) -> Column:
    """Letters, their marks and digits in lower case without accents, with single spaces."""
    return F.trim(F.regexp_replace(strip_marks(F.lower(text)), r"[^\p{L}\p{M}\p{N}]+", " "))


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), 0)


def grams(chars: Column, q: int) -> Column:
    """(at, gram) of all q-grams that have a character of an unspaced script."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(chars) - q, F.lit(0))), lambda i: i + q <= F.size(chars))
    every = F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(chars, i + 1, q), "").alias("gram")))
    return F.filter(every, lambda g: g["gram"].rlike(f"[{UNSPACED}]"))


def gram_index(lexicon: DataFrame, q: int) -> DataFrame:
    """gram, k (its place), alias, size, concept for every alias of an unspaced script; ties go to the smaller q-gram, then place."""
    own = lexicon.select(entity_key(F.col("alias")).alias("alias"), "concept").distinct().where(F.col("alias").rlike(f"[{UNSPACED}]"))
    own = own.withColumn("chars", characters(F.col("alias")))
    rows = own.select("alias", "concept", F.size("chars").alias("size"), F.inline(grams(F.col("chars"), q)).alias("k", "gram"))
    shared = rows.select("alias", "gram").distinct().groupBy("gram").agg(F.count("*").alias("aliases"))
    best = F.min(F.struct("aliases", "gram", "k")).alias("b")
    return rows.join(shared, "gram").groupBy("alias", "concept", "size").agg(best).select("b.gram", "b.k", "alias", "size", "concept")


def unspaced_mentions(docs: DataFrame, lexicon: DataFrame, text: str = "text", q: int = 2) -> DataFrame:
    """doc_id, start, end (characters of the text's key, end exclusive), alias, concept; the longest where they nest.

    Aliases need ``q`` characters. A mention isn't part of a word in ASCII letters or digits. Null texts have none.
    """
    keyed = docs.select("doc_id", entity_key(F.col(text)).alias("key")).where(F.col("key").rlike(f"[{UNSPACED}]"))
    keyed = keyed.select("doc_id", characters(F.col("key")).alias("chars"))
    index = gram_index(lexicon, q)
    few = index.limit(FEW + 1).collect()
    found_grams = grams(F.col("chars"), q)
    if len(few) <= FEW:
        own = F.filter(found_grams, lambda g: g["gram"].isin(sorted({r.gram for r in few})))
        rows = keyed.select("doc_id", "chars", F.inline(own).alias("at", "gram"))
        met = rows.join(F.broadcast(docs.sparkSession.createDataFrame(few, index.schema)), "gram").withColumn("start", F.col("at") - F.col("k"))
    else:
        # texts are made from narrow rows: their size isn't known before, so neither join may send them to the driver
        cut = keyed.select("doc_id", F.inline(found_grams).alias("at", "gram"))
        hits = cut.join(index.hint("merge"), "gram").select("doc_id", (F.col("at") - F.col("k")).alias("start"), "size", "alias", "concept")
        met = keyed.join(hits.where("start >= 0").hint("merge"), "doc_id")
    outside = lambda i: ~F.coalesce(F.when(i >= 0, F.get("chars", i)), F.lit(" ")).rlike("[a-z0-9]")
    whole = F.array_join(F.slice("chars", F.col("start") + 1, F.col("size")), "") == F.col("alias")
    end = F.col("start") + F.col("size")
    found = met.where("start >= 0").where(whole & outside(F.col("start") - 1) & outside(end)).select("doc_id", "start", end.alias("end"), "alias", "concept")
    return drop_nested(found)
