"""Readers of feeds, dumps and stored pages into rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilis.functions.text import collapse, strip_markup


def read_mapped_csv(spark: SparkSession, path: str, mapping: Mapping[str, str], sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Columns named by ``mapping`` (ours -> the file's); text is title and body; the key is the URL, else the hash of all values.

    The header is read; missing columns are null; no types are guessed.
    """
    raw = spark.read.csv(path, sep=sep, encoding=encoding, header=True, multiLine=True, escape='"')
    own = lambda c: F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")
    out = raw.select(*[own(theirs).alias(ours) for ours, theirs in mapping.items()])
    parts = [F.col(c) for c in ("title", "body") if c in mapping]
    out = out.withColumn("text", F.concat_ws("\n\n", *parts)) if parts else out
    url = F.nullif(F.trim("url"), F.lit("")) if "url" in mapping else F.lit(None).cast("string")
    return out.withColumn("row_key", F.coalesce(url, F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in mapping]), 256)))


#: Headers that mean the same in files of posts.
POST_HEADERS = {
    "post_id": ["post_id", "id"], "url": ["video_link", "url", "link"], "account": ["account_name"], "date": ["comment_date", "date"], "source": ["source"],
    "caption": ["caption", "post_content"], "comment": ["comment", "text"], "user": ["commenter_username", "user"],
}


def posts_of(rows: DataFrame) -> DataFrame:
    """One row for each post_id, or URL where there is none: first non-blank url, date, caption and the comments in order of their place. rows may have any of POST_HEADERS."""
    have = {c.lower(): c for c in rows.columns}
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    pick = lambda names: F.coalesce(*[blank(have[n]) for n in names if n in have], F.lit(None).cast("string"))
    at = F.col("turn") if "turn" in rows.columns else F.lit(0)
    flat = rows.select(at.alias("place"), *[pick(n).alias(k) for k, n in POST_HEADERS.items()])
    flat = flat.withColumn("post_id", F.coalesce("post_id", "url")).where("post_id is not null")
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("place", c))).alias(c)
    comments = F.array_sort(F.collect_list(F.when(F.col("comment").isNotNull(), F.struct("place", "comment"))))
    return flat.groupBy("post_id").agg(first("url"), first("date"), first("caption"), first("account"), F.transform(comments, lambda x: x["comment"]).alias("comments"))


def read_posts(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of CSV files with different headers: each header's files are read with their own columns."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mergeSchema", True)
    # files are grouped by their first line, so that there is one plan for each header, however many files
    heads = spark.read.text(folder, wholetext=False).select(F.input_file_name().alias("path"), "value", F.monotonically_increasing_id().alias("i"))
    first = heads.groupBy("path").agg(F.min_by("value", "i").alias("head"))
    groups = first.groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("head").collect()
    out = None
    for g in groups:
        own = raw.csv([unquote(x) for x in g.paths]).withColumn("turn", F.monotonically_increasing_id())
        own = own.select("turn", *[F.col(f"`{c}`").alias(c.lower()) for c in own.columns if c != "turn" and c.lower() in {x for v in POST_HEADERS.values() for x in v}])
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return posts_of(out)


ENVELOPES = ["data", "items", "results", "rows", "records", "list", "result"]


def read_enveloped_json(spark: SparkSession, path: str, keys: Sequence[str] = tuple(ENVELOPES)) -> DataFrame:
    """Records (variant) of files that are an array, an object with the records under one of ``keys`` (one level deeper too), or one record."""
    v = F.try_parse_json("value")
    rows = spark.read.text(path, wholetext=True).select(v.alias("v"))
    arrays = [F.try_variant_get("v", "$", "array<variant>")]
    arrays += [F.try_variant_get("v", f"$.{k}", "array<variant>") for k in keys]
    arrays += [F.try_variant_get("v", f"$.{a}.{b}", "array<variant>") for a in keys for b in keys]
    return rows.select(F.explode(F.coalesce(*arrays, F.array("v"))).alias("record"))


def read_feed_items(spark: SparkSession, path: str) -> DataFrame:
    """title, link, summary, published, kind of RSS items and Atom entries in XML files."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    rss_schema = "title string, link string, description string, pubDate string, guid string"
    rss = spark.read.format("xml").option("rowTag", "item").schema(rss_schema).load(path)
    rss = rss.select(text("title").alias("title"), F.coalesce(text("link"), text("guid")).alias("link"), strip_markup(F.col("description")).alias("summary"), text("pubDate").alias("published"), F.lit("rss").alias("kind"))
    atom_schema = "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, updated string, published string"
    atom = spark.read.format("xml").option("rowTag", "entry").schema(atom_schema).load(path)
    href = F.coalesce(F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"], F.get("link", F.lit(0))["_href"])
    atom = atom.select(text("title").alias("title"), href.alias("link"), strip_markup(F.coalesce("summary", "content")).alias("summary"), F.coalesce("published", "updated").alias("published"), F.lit("atom").alias("kind"))
    return rss.unionByName(atom).where("link is not null")


def clean_feed(items: DataFrame) -> DataFrame:
    """Rows of the format ``feed`` with summaries without markup."""
    return items.withColumn("summary", strip_markup(F.col("summary")))


def read_sitemap(spark: SparkSession, files: DataFrame, max_depth: int = 3, limit: int | None = None) -> DataFrame:
    """url, lastmod, depth from sitemap files. ``files``: location, content (XML), is_root. Indexes are followed by joins, ``max_depth`` levels deep."""
    entry = lambda tag: F.regexp_extract_all("content", F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), 1)
    field = lambda c, tag: F.nullif(F.trim(F.regexp_extract(c, rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    level = files.where("is_root").select("location", "content")
    out = None
    for depth in range(max_depth):
        urls = level.select(F.explode(entry("url")).alias("e")).select(field(F.col("e"), "loc").alias("url"), field(F.col("e"), "lastmod").alias("lastmod"), F.lit(depth).alias("depth"))
        out = urls if out is None else out.unionByName(urls)
        nested = level.select(F.explode(entry("sitemap")).alias("e")).select(field(F.col("e"), "loc").alias("location")).distinct()
        level = nested.join(files.select("location", "content"), "location")
    out = out.where("url is not null").groupBy("url").agg(F.max("lastmod").alias("lastmod"), F.min("depth").alias("depth"))
    return out.orderBy("depth", "url").limit(limit) if limit else out


def follow_sitemaps(entries: DataFrame, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """url, lastmod, depth from entries of sitemap files (location, kind, loc, lastmod), beginning with those of ``roots`` (location).

    An index's entries name further locations; each level is one join, ``max_depth`` of them. A location is read at its first
    level alone, so files that name each other do no harm.
    """
    level, seen, out = roots.select("location").distinct(), None, None
    for depth in range(max_depth):
        seen = level if seen is None else seen.unionByName(level)
        here = entries.join(level, "location")
        urls = here.where("kind = 'url'").select(F.col("loc").alias("url"), "lastmod", F.lit(depth).alias("depth"))
        out = urls if out is None else out.unionByName(urls)
        level = here.where("kind = 'sitemap'").select(F.col("loc").alias("location")).distinct().join(seen, "location", "left_anti")
    return out.groupBy("url").agg(F.max("lastmod").alias("lastmod"), F.min("depth").alias("depth"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#:]+)", 1))


def extract_links(pages: DataFrame, same_host: bool = True) -> DataFrame:
    """page_id, position, link: absolute targets of a page's anchors; only those of its own host if asked for."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#][^"']*)["']"""), 1)
    rows = pages.select("page_id", "url", F.posexplode(hrefs).alias("position", "href"))
    root = F.regexp_extract("url", r"(?i)^(https?://[^/?#]+)", 1)
    link = F.when(F.col("href").rlike(r"(?i)^https?://"), F.col("href")).when(F.startswith("href", F.lit("//")), F.concat(F.lit("https:"), "href")).when(F.startswith("href", F.lit("/")), F.concat(root, "href"))
    out = rows.withColumn("link", link).where("link is not null")
    return (out.where(host_of(F.col("link")) == host_of(F.col("url"))) if same_host else out).select("page_id", "position", "link")


def read_point_layer(spark: SparkSession, path: str, kind: str, box: tuple[float, float, float, float], limit: int | None = None) -> DataFrame:
    """id, lat, lon, value of an external layer within ``box`` (south, west, north, east).

    kinds: 'hotspots' (CSV with latitude, longitude, brightness), 'geojson' (features with points), 'states' (arrays of
    flight states), 'records' (JSON lines with lat, lon, value).
    """
    if kind == "hotspots":
        raw = spark.read.csv(path, header=True)
        rows = raw.select(F.sha2(F.concat_ws("|", *raw.columns), 256).alias("id"), F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), F.col("brightness").try_cast("double").alias("value"))
    elif kind == "geojson":
        feature = "struct<id:string,geometry:struct<coordinates:array<double>>,properties:struct<mag:double,value:double>>"
        raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"features array<{feature}>")["features"]).alias("f"))
        rows = raw.select("f.id", F.get("f.geometry.coordinates", F.lit(1)).alias("lat"), F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.coalesce("f.properties.mag", "f.properties.value").alias("value"))
    elif kind == "states":
        raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "states array<array<string>>")["states"]).alias("s"))
        rows = raw.select(F.get("s", F.lit(0)).alias("id"), F.get("s", F.lit(6)).try_cast("double").alias("lat"), F.get("s", F.lit(5)).try_cast("double").alias("lon"), F.get("s", F.lit(7)).try_cast("double").alias("value"))
    elif kind == "records":
        rows = spark.read.schema("id string, lat double, lon double, value double").json(path)
    else:
        raise ValueError(f"no such kind of layer: {kind}")
    south, west, north, east = box
    out = rows.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return out.orderBy(F.desc_nulls_last("value"), "id").limit(limit) if limit else out


def article_text(df: DataFrame, most: int = 35_000) -> DataFrame:
    """``df`` with ``window``: title and body up to ``most`` characters, for a costly scorer."""
    return df.withColumn("window", F.substring(F.concat_ws("\n\n", F.nullif(collapse(F.col("title")), F.lit("")), F.col("body")), 1, most))
