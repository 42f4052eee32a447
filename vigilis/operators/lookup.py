"""Joins with dimensions, existence tests, identity and spatial matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilis.functions.text import alias_key
from vigilis.operators.dedup import best_per_key, identity_links, star_components


def latest_lookup(facts: DataFrame, dim: DataFrame, key: str, dim_key: str, columns: Sequence[str], order: Sequence[Column], active: str = "active") -> DataFrame:
    """``facts`` with ``columns`` of the latest active dimension row of the same case-folded name, as dim_<column>.

    The dimension is reduced to one row for each name first; Spark broadcasts it if it is small.
    """
    one = best_per_key(dim.where(active).withColumn("__k", F.lower(F.trim(dim_key))), ["__k"], order)
    side = one.select("__k", *[F.col(c).alias(f"dim_{c}") for c in columns])
    return facts.join(side, F.lower(F.trim(F.col(key))) == F.col("__k"), "left").drop("__k")


def latest_per_key(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One aggregation: the row of each key that is largest by ``order``."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__v")).select(key, *[F.col(f"__v.{c}").alias(c) for c in columns])


def unambiguous_map(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """key, label: normalised names and aliases that stand for exactly one label."""
    both = names.select(alias_key(F.col("label")).alias("key"), "label").unionByName(aliases.select(alias_key(F.col("alias")).alias("key"), "label"))
    return both.groupBy("key").agg(F.count_distinct("label").alias("n"), F.min("label").alias("label")).where("n = 1").select("key", "label")


def canonical_label(df: DataFrame, raw: str, concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``df`` with ``canonical``: the concept of that name, else that of the most confident alias, else the raw name in title case."""
    c = concepts.select(F.lower("label").alias("__c"), F.col("label").alias("__by_name")).distinct()
    best = best_per_key(aliases, [F.lower("alias")], [F.desc("confidence"), F.asc("label")]).select(F.lower("alias").alias("__a"), F.col("label").alias("__by_alias"))
    key = F.lower(F.trim(F.col(raw)))
    out = df.join(c, key == F.col("__c"), "left").join(best, key == F.col("__a"), "left")
    return out.select(*df.columns, F.coalesce("__by_name", "__by_alias", F.initcap(raw)).alias("canonical"))


def label_filter(df: DataFrame, aliases: DataFrame, value: str) -> DataFrame:
    """Rows whose label equals or contains ``value``, or whose label has it as an alias."""
    labels = aliases.where(F.lower("alias") == value.lower()).select(F.col("label").alias("__l"), F.lit(True).alias("__hit")).distinct()
    hit = F.contains(F.lower("label"), F.lit(value.lower())) | F.coalesce("__hit", F.lit(False))
    return df.join(labels, F.col("label") == F.col("__l"), "left").where(hit).drop("__l", "__hit")


def keep_if_exists(df: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    return df.join(other, on, "left_semi")


def drop_if_exists(df: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    return df.join(other, on, "left_anti")


def join_bounds(df: DataFrame, bounds: DataFrame, low: str, high: str, at: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates of the rows within the one row of ``bounds``, which stays even if there are none: the bound goes to the rows."""
    b = F.broadcast(bounds)  # one row
    inside = df.crossJoin(b).where(F.col(at).between(F.col(low), F.col(high))).agg(*aggregates)
    return bounds.crossJoin(F.broadcast(inside))


def assemble(*cards: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = cards[0]
    for c in cards[1:]:
        out = out.crossJoin(F.broadcast(c))
    return out


def match_any_key(new: DataFrame, old: DataFrame, keys: Sequence[str], ident: str = "id") -> DataFrame:
    """new_id, old_id: pairs that share any key, by one equi-join on (kind, value)."""
    explode = lambda df, name: df.select(F.col(ident).alias(name), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys])).alias("k")).where("k.value is not null")
    return explode(new, "new_id").join(explode(old, "old_id"), "k").select("new_id", "old_id").distinct()


def identity_classes(new: DataFrame, old: DataFrame, keys: Sequence[str], ident: str = "id") -> DataFrame:
    """side, id, class_id, n_new, n_old: one row for each row of both, with how many of either side share its class.

    Rows that share any key, directly or through others, are a class; no pairs are made, so equal rows cost no more than
    others. ``class_id`` is the smallest 2 · id + side (new 0, old 1) of the class. Ids are numbers, unique on each side; null and empty keys
    link nothing.
    """
    own = lambda df, side: df.select(F.lit(side).alias("side"), F.col(ident).cast("long").alias("id"), *keys)
    rows = own(new, "new").unionByName(own(old, "old")).withColumn("__node", F.col("id") * 2 + (F.col("side") == "old").cast("long"))
    roots = star_components(identity_links(rows, "__node", keys).where("a <> b"))
    classed = rows.join(roots, F.col("__node") == F.col("node"), "left").select("side", "id", F.coalesce("root", "__node").alias("class_id"))
    sizes = classed.groupBy("class_id").agg(F.count_if(F.col("side") == "new").alias("n_new"), F.count_if(F.col("side") == "old").alias("n_old"))
    return classed.join(sizes, "class_id").select("side", "id", "class_id", "n_new", "n_old")


def expand_terms(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """All spellings of the labels that any of ``terms`` (term) stands for, and the terms themselves."""
    own = terms.select(F.lower("term").alias("term"))
    labels = aliases.join(own, F.lower("alias") == F.col("term")).select("label").distinct()
    return own.unionByName(aliases.join(labels, "label").select(F.lower("alias").alias("term"))).unionByName(labels.select(F.lower("label").alias("term"))).distinct()


def match_articles(reports: DataFrame, requests: DataFrame) -> DataFrame:
    """report_id, request_id: a term of the request is a word of the report, within the request's dates.

    One-word terms are found by an equi-join on the reports' words; terms of several words by a search of the reports that
    have their first word.
    """
    words = reports.select("report_id", F.explode(F.array_distinct(F.split(alias_key(F.col("text")), " "))).alias("word"))
    terms = requests.select("request_id", "since", "until", F.explode("terms").alias("term")).withColumn("term", alias_key(F.col("term")))
    pairs = words.join(terms, F.substring_index("term", " ", 1) == F.col("word")).select("report_id", "request_id", "term", "since", "until").distinct()
    whole = F.contains(F.concat(F.lit(" "), alias_key(F.col("text")), F.lit(" ")), F.concat(F.lit(" "), F.col("term"), F.lit(" ")))
    # words and ids meet terms; the texts of those pairs alone are fetched
    hit = reports.select("report_id", "text", "published_at").join(pairs, "report_id")
    return hit.where(whole & F.col("published_at").between(F.col("since"), F.col("until"))).select("report_id", "request_id").distinct()


def rank_sources(sources: DataFrame, country: str, members: Sequence[str]) -> DataFrame:
    """``sources`` with rank: 0 for the country's own, 1 for members', 2 for others."""
    rank = F.when(F.col("country") == country, 0).when(F.col("country").isin(list(members)), 1).otherwise(2)
    return sources.withColumn("geo_rank", rank)


def region_of(countries: DataFrame, bridge: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """``countries`` with ``region``: the alphabetically first of its regions that aren't excluded."""
    first = bridge.where(~F.col("region").isin(list(excluded))).groupBy("country").agg(F.min("region").alias("region"))
    return countries.join(first, "country", "left")


def pin_place(df: DataFrame, curated: DataFrame, gazetteer: DataFrame, centroids: DataFrame, boxes: DataFrame) -> DataFrame:
    """``df`` (place, country) with lat, lon and pin (curated, gazetteer, centroid, none); points outside the country's box are refused."""
    side = lambda d, n: d.select(F.lower("name").alias(f"__{n}"), F.col("country").alias(f"__{n}c"), F.col("lat").alias(f"__{n}lat"), F.col("lon").alias(f"__{n}lon"))
    out = df
    for n, d in (("a", curated), ("b", gazetteer)):
        out = out.join(side(d, n), (F.lower("place") == F.col(f"__{n}")) & (F.col("country") == F.col(f"__{n}c")), "left")
    cent = centroids.select(F.col("country").alias("__cc"), F.col("lat").alias("__clat"), F.col("lon").alias("__clon"))
    box = boxes.select(F.col("country").alias("__x"), "south", "north", "west", "east")
    out = out.join(cent, F.col("country") == F.col("__cc"), "left").join(box, F.col("country") == F.col("__x"), "left")
    ok = lambda n: F.col(f"__{n}lat").isNotNull() & (F.col("__x").isNull() | (F.col(f"__{n}lat").between(F.col("south"), F.col("north")) & F.col(f"__{n}lon").between(F.col("west"), F.col("east"))))
    pick = lambda c: F.when(ok("a"), F.col(f"__a{c}")).when(ok("b"), F.col(f"__b{c}")).otherwise(F.col(f"__c{c}"))
    pin = F.when(ok("a"), "curated").when(ok("b"), "gazetteer").when(F.col("__clat").isNotNull(), "centroid").otherwise("none")
    return out.select(*df.columns, pick("lat").alias("lat"), pick("lon").alias("lon"), pin.alias("pin"))


def nearest(points: DataFrame, refs: DataFrame, max_dist: float) -> DataFrame:
    """For each point (id, lat, lon) the nearest reference (ref, lat, lon) within ``max_dist`` degrees; others are left out.

    Cells as wide as the distance: references go to their own cell and its neighbours, and one equi-join finds candidates.
    """
    cell = lambda c: F.floor(F.col(c) / max_dist).cast("long")
    around = F.sequence(F.lit(-1), F.lit(1))
    r = refs.select("ref", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), cell("lat").alias("a"), cell("lon").alias("o"))
    r = r.withColumn("da", F.explode(around)).withColumn("do", F.explode(around)).select("ref", "rlat", "rlon", (F.col("a") + F.col("da")).alias("__a"), (F.col("o") + F.col("do")).alias("__o"))
    p = points.withColumn("__pa", cell("lat")).withColumn("__po", cell("lon"))
    d = F.sqrt(F.pow(F.col("lat") - F.col("rlat"), 2) + F.pow(F.col("lon") - F.col("rlon"), 2))
    hit = p.join(r, (F.col("__pa") == F.col("__a")) & (F.col("__po") == F.col("__o"))).withColumn("distance", d).where(F.col("distance") <= max_dist)
    best = hit.groupBy("id").agg(F.min_by(F.struct("ref", "distance"), F.struct("distance", "ref")).alias("b"))
    return best.select("id", "b.ref", F.col("b.distance").alias("distance"))


def within_polygon(points: DataFrame, polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """id, polygon for points (id, lat, lon) in polygons (polygon, ring: array of (lat, lon)); points on an edge count as inside.

    A polygon goes to all cells of its bounding box; candidates meet by cell, and an even-odd ray test decides.
    """
    at = lambda c: F.floor(c / cell).cast("long")
    lats, lons = F.transform("ring", lambda v: v["lat"]), F.transform("ring", lambda v: v["lon"])
    g = polygons.withColumn("__a", F.explode(F.sequence(at(F.array_min(lats)), at(F.array_max(lats))))).withColumn("__o", F.explode(F.sequence(at(F.array_min(lons)), at(F.array_max(lons)))))
    p = points.withColumn("__pa", at(F.col("lat"))).withColumn("__po", at(F.col("lon")))
    y, x = F.col("lat"), F.col("lon")
    pairs = F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cross = lambda e: (e["b"]["lon"] - e["a"]["lon"]) * (y - e["a"]["lat"]) - (x - e["a"]["lon"]) * (e["b"]["lat"] - e["a"]["lat"])
    between = lambda e: y.between(F.least(e["a"]["lat"], e["b"]["lat"]), F.greatest(e["a"]["lat"], e["b"]["lat"])) & x.between(F.least(e["a"]["lon"], e["b"]["lon"]), F.greatest(e["a"]["lon"], e["b"]["lon"]))
    edge = F.exists(pairs, lambda e: (F.abs(cross(e)) < 1e-12) & between(e))
    hits = F.filter(pairs, lambda e: ((e["a"]["lat"] > y) != (e["b"]["lat"] > y)) & (x < (e["b"]["lon"] - e["a"]["lon"]) * (y - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"]))
    both = p.join(g, (F.col("__pa") == F.col("__a")) & (F.col("__po") == F.col("__o")))
    return both.where(edge | (F.size(hits) % 2 == 1)).select("id", "polygon").distinct()


