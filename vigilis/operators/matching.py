"""Articles that meet requests: a term in title, summary or address, within the dates, about the country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 4
#: Rows of terms, about 30 bytes each, that may be broadcast.
BROADCAST_TERMS = 1 << 20


def haystack() -> Column:
    return F.lower(F.concat_ws(" ", "title", "summary", "url"))


def grams(text: Column) -> Column:
    """Distinct runs of Q characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (Q - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, Q)))


def term_keys(terms: DataFrame) -> DataFrame:
    """key, term: by what a term is looked up. A term of over three characters has the run of characters that the fewest terms share,
    a shorter one its first word; a short term without a letter or digit has none."""
    long = terms.where(F.length("term") >= Q).select("term", F.explode(grams(F.col("term"))).alias("key"))
    shared = long.groupBy("key").agg(F.count("*").alias("n"))
    one = long.join(shared, "key").groupBy("term").agg(F.min(F.struct("n", "key")).alias("b")).select("b.key", "term")
    word = F.regexp_extract("term", r"[\p{L}\p{N}_]+", 0)
    short = terms.where(F.length("term") < Q).select(F.concat(F.lit(" "), word).alias("key"), "term").where(word != "")
    return one.unionByName(short)


def match_requests(reports: DataFrame, requests: DataFrame) -> DataFrame:
    """report_id, request_id of all articles that a request asks for.

    reports: report_id, title, summary, url, published_at, source_country. requests: request_id, terms, since, until, country.
    A term of over three characters may stand anywhere in title, summary or address, a shorter one as a word of its own; case is
    ignored. An article without a date, or a request without a bound, is within the dates. A request's country must be in the same
    text, or be part of the source's country, or the other way round; a request without one takes all.

    Keys of terms meet keys of articles; the texts of those pairs alone are fetched to be compared. Null texts are empty, blank
    terms find nothing, equal rows count once.
    """
    asked = requests.select("request_id", "since", "until", F.lower(F.trim(F.coalesce("country", F.lit("")))).alias("country"), F.explode(F.array_distinct(F.transform("terms", lambda t: F.lower(F.trim(t))))).alias("term"))
    keys = term_keys(asked.where("term <> ''").select("term").distinct())
    keys = F.broadcast(keys) if keys.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else keys
    texts = reports.select("report_id", haystack().alias("hay"), "published_at", F.lower(F.trim(F.coalesce("source_country", F.lit("")))).alias("source"))
    words = F.transform(F.regexp_extract_all("hay", F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: F.concat(F.lit(" "), w))
    cut = texts.select("report_id", F.explode(F.array_union(grams(F.col("hay")), words)).alias("key"))
    pairs = cut.join(keys, "key").select("report_id", "term").distinct()
    whole = F.expr(r"CASE WHEN length(term) >= 4 THEN contains(hay, term) ELSE rlike(hay, concat('(?U)\\b\\Q', term, '\\E\\b')) END")
    hits = texts.join(pairs, "report_id").where(whole).join(asked, "term")
    dated = F.col("published_at").isNull() | (F.coalesce(F.col("published_at") >= F.col("since"), F.lit(True)) & F.coalesce(F.col("published_at") <= F.col("until"), F.lit(True)))
    near = (F.col("source") != "") & (F.contains("source", "country") | F.contains("country", "source"))
    about = (F.col("country") == "") | F.contains("hay", "country") | near
    return hits.where(dated & about).select("report_id", "request_id").distinct()
