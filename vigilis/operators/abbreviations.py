"""Short forms of administrative places (Sumsel, OKU, TP.HCM) by a table of places, told apart by what else a text says.

places: place_id, canonical, country, admin1, admin2, level, aliases and cues (arrays). A short form may stand for several places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilis.functions.unicode import strip_marks_each
from vigilis.operators.textjobs import FEW, plain_key, with_mentions

#: Offices whose name before a place's makes it the text's own.
OFFICES = ["sudinkes", "dinkes", "pemkot", "pemkab", "pemprov", "suku dinas"]


def key(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def few(table: DataFrame) -> DataFrame:
    """``table`` to be broadcast if it is small, whatever the planner takes it for: texts then stay as they are dealt."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def text_scope(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, scope (a place) of ``docs`` (a row for each doc_id): the place whose full name a text has most, an office's place before others,
    districts before provinces.

    Ties go to the longer name, then to the smaller place_id. Texts without any such name are left out.
    """
    own = places.select("place_id", "canonical", "country", "admin1", "level").where("place_id is not null")
    said = F.array(F.col("canonical"), *(F.concat(F.lit(x), F.lit(" "), F.col("canonical")) for x in OFFICES))
    names = own.select("*", F.posexplode(said).alias("office", "alias")).withColumn("office", F.col("office") > 0).withColumn("alias", plain_key(F.col("alias"))).where("alias <> ''").distinct()
    # exploded as an expression: of a plain column the optimizer would make a filter, and look for the names twice
    found = with_mentions(docs.select("doc_id", "text"), names, "names").select("doc_id", F.explode(F.coalesce("names", F.array().cast("array<string>"))).alias("alias"))
    rows = found.join(few(names), "alias").groupBy("doc_id", "place_id", "canonical", "country", "admin1", "level").agg(F.count("*").alias("n"), F.max("office").alias("office"))
    score = 2 * F.col("n") + F.when(F.col("office"), 8).otherwise(0) + F.when(F.col("level") == 2, 3).otherwise(1)
    best = F.max_by(F.struct("place_id", "canonical", "country", "admin1"), F.struct(score.alias("s"), F.length("canonical").alias("l"), (-F.col("place_id")).alias("i")))
    return rows.groupBy("doc_id").agg(best.alias("scope"))


def resolve_abbreviations(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, alias, place_id for every short form in the texts of ``docs`` (doc_id, text, country_hint); null where it stays open.

    A short form of one place is that place. Of several, the one with the most points: 20 in the country hinted at (else that of the
    text's own place), 50 as the text's own place, 40 where that is its admin2, 15 in the same admin1, 10 for each cue that
    the text has; ties go to the smaller place_id. Without a point it stays open. Null texts have none; equal rows count once.
    """
    # dealt first, so that rows are sorted once and not where they are read
    docs = docs.where("doc_id is not null").select("doc_id", "text", "country_hint").repartition("doc_id").dropDuplicates(["doc_id"])
    own = places.select("place_id", "canonical", "country", "admin1", "admin2", "cues", F.explode(F.array_distinct("aliases")).alias("name")).withColumn("name", key(F.col("name"))).where("name <> ''")
    sizes = own.select("place_id", "name").distinct().groupBy("name").agg(F.count("*").alias("variants"))
    variants = own.join(few(sizes), "name").where("place_id is not null or variants = 1").withColumn("short", plain_key(F.col("name")))
    texts = with_mentions(docs, variants.select(F.col("short").alias("alias")), "short").where("short is not null")
    texts = texts.join(text_scope(texts, places), "doc_id", "left")
    texts = texts.select("doc_id", F.lower("text").alias("window"), key(F.col("country_hint")).alias("hint"), "scope", F.explode(F.array_distinct("short")).alias("short"))
    rows = texts.join(few(variants), "short")
    same = lambda x, y: (key(F.col(x)) == key(F.col(y))) & (key(F.col(x)) != "")
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    hint = F.when(F.col("hint") != "", F.col("hint")).otherwise(key(F.col("scope.country")))
    cues = F.size(F.filter(F.coalesce("cues", F.array().cast("array<string>")), lambda c: (F.trim(c) != "") & F.contains("window", F.lower(c))))
    score = points((hint != "") & (key(F.col("country")) == hint), 20) + points(same("canonical", "scope.canonical"), 50) + points(same("admin2", "scope.canonical"), 40) + points(same("admin1", "scope.admin1"), 15) + 10 * cues
    scored = rows.select("doc_id", "name", "variants", "place_id", F.when(F.col("variants") > 1, score).alias("score"))
    best = scored.groupBy("doc_id", "name", "variants").agg(F.max(F.struct("score", (-F.col("place_id")).alias("i"))).alias("b"))
    return best.select("doc_id", F.col("name").alias("alias"), F.when((F.col("variants") == 1) | (F.col("b.score") > 0), -F.col("b.i")).alias("place_id"))


def geo_uncertain(docs: DataFrame, found: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, geo_uncertain of ``docs`` (doc_id, cases, deaths, resolved: names): counts are given, and a short form of ``found``
    (doc_id, alias, place_id) isn't among the resolved names by any name of its place. An open short form is uncertain."""
    folded = lambda names: F.filter(F.transform(strip_marks_each(names), lambda n: F.lower(F.trim(n))), lambda n: n != "")
    every = F.concat(F.array("canonical", "admin1"), F.coalesce("aliases", F.array().cast("array<string>")))
    names = places.select("place_id", F.explode(folded(every)).alias("n")).groupBy("place_id").agg(F.collect_set("n").alias("names"))
    parts = F.flatten(F.transform(F.filter("resolved", lambda r: r.isNotNull()), lambda r: F.split(r, "[;,/|]")))
    own = docs.select("doc_id", folded(parts).alias("own"))
    rows = found.select("doc_id", "place_id").join(few(names), "place_id", "left").join(own, "doc_id", "left")
    bound = F.coalesce(F.arrays_overlap("names", "own"), F.lit(False))
    hits = rows.groupBy("doc_id", "place_id").agg(F.max(bound).alias("bound")).groupBy("doc_id").agg(F.max(~F.col("bound")).alias("loose"))
    counted = (F.coalesce("cases", F.lit(0)) > 0) | (F.coalesce("deaths", F.lit(0)) > 0)
    return docs.join(hits, "doc_id", "left").select("doc_id", (counted & F.coalesce("loose", F.lit(False))).alias("geo_uncertain"))
