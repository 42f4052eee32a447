"""Queries over dumps: rows of the given tables are written as files by Spark and read again through the formats of ``sources``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigilis.operators import dedup, matching
from vigilis.plans import query
from vigilis.sources import adapters as a
from vigilis.sources import datasource, readers, writers
from vigilis.streaming import jobs
from vigilis.streaming.buckets import BucketedTable

TITLE = "(?s)<title>(.*?)</title>"
TITLE_SQL = f"nullif(trim(regexp_extract(html, '{TITLE}', 1)), '')"
DAY_SQL = "'2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0')"


def new_folder(spark, name):
    """A folder that driver and executors share."""
    dedup.set_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def pages_of(spark, d):
    p = a.scan(spark, d, "pages")
    title = F.nullif(F.trim(F.regexp_extract("html", TITLE, 1)), F.lit(""))
    return p.select("page_id", "url", title.alias("title"), F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")).alias("day"))


@query(f"""WITH p AS (SELECT 'body ' || page_id AS body, {TITLE_SQL} AS title, CASE WHEN page_id % 3 > 0 THEN url END AS url FROM pages)
  SELECT body, title, coalesce(url, sha256(concat_ws('|', coalesce(title, ''), body, ''))) AS row_key, concat_ws(chr(10) || chr(10), title, body) AS text FROM p""")
def sc2_mapped_csv(spark, d):
    """Pages as a CSV feed with headers of its own."""
    p, folder = pages_of(spark, d), new_folder(spark, "csv")
    out = p.select(F.col("title").alias("judul"), F.concat(F.lit("body "), "page_id").alias("isi"), F.when(F.col("page_id") % 3 > 0, F.col("url")).alias("tautan"))
    out.write.csv(folder, sep=";", header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_mapped_csv(spark, folder, {"title": "judul", "body": "isi", "url": "tautan"}, ";").select("body", "title", "row_key", "text")


@query("SELECT page_id, url, k FROM pages, (VALUES (0::BIGINT), (1::BIGINT)) v(k) WHERE page_id % 4 < 3 OR k = 0")
def sc4_records(spark, d):
    """Two records a page in three kinds of envelope, and one record without any."""
    datasource.register(spark)
    folder = new_folder(spark, "records")
    one = lambda k: F.struct("page_id", "url", F.lit(k).alias("k"))
    both, kind = F.array(one(0), one(1)), F.col("page_id") % 4
    line = F.when(kind == 0, F.to_json(F.struct(both.alias("data")))).when(kind == 1, F.to_json(both))
    line = line.when(kind == 2, F.to_json(F.struct(F.struct(both.alias("items")).alias("result")))).otherwise(F.to_json(one(0)))
    a.scan(spark, d, "pages", ["page_id", "url"]).select(line.alias("value")).write.text(folder)
    field = lambda c: F.get_json_object("record", f"$.{c}")
    return spark.read.format("records").load(folder).select(field("page_id").cast("long").alias("page_id"), field("url").alias("url"), field("k").cast("long").alias("k"))


@query(f"SELECT CASE WHEN page_id % 2 = 0 THEN 'rss' ELSE 'atom' END AS kind, {TITLE_SQL} AS title, url AS link, {DAY_SQL} AS published, 'page ' || page_id AS summary FROM pages")
def sc5_feed(spark, d):
    """Pages as items of RSS and entries of Atom files."""
    datasource.register(spark)
    p, folder = pages_of(spark, d), new_folder(spark, "feed")
    body = F.concat(F.lit("<b>page</b> "), "page_id")
    rss = p.where("page_id % 2 = 0").select("title", F.col("url").alias("link"), body.alias("description"), F.col("day").alias("pubDate"))
    rss.write.format("xml").option("rootTag", "rss").option("rowTag", "item").save(f"{folder}/rss")
    links = F.array(F.struct(F.lit("self").alias("_rel"), F.lit("x").alias("_href")), F.struct(F.lit("alternate").alias("_rel"), F.col("url").alias("_href")))
    atom = p.where("page_id % 2 = 1").select("title", links.alias("link"), body.alias("summary"), F.col("day").alias("updated"))
    atom.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(f"{folder}/atom")
    return readers.clean_feed(spark.read.format("feed").load(folder)).select("kind", "title", "link", "published", "summary")


@query(f"SELECT url, max({DAY_SQL}) AS lastmod, CAST(1 AS INTEGER) AS depth FROM pages WHERE page_id % 7 < 6 GROUP BY 1")
def sc6_sitemap(spark, d):
    """An index of six sitemaps; a seventh that it doesn't name is not followed."""
    datasource.register(spark)
    p, folder = pages_of(spark, d), new_folder(spark, "sitemap")
    own = p.select(F.col("url").alias("loc"), F.col("day").alias("lastmod"), (F.col("page_id") % 7).alias("part"))
    own.write.format("xml").option("rootTag", "urlset").option("rowTag", "url").partitionBy("part").save(f"{folder}/files")
    index = spark.range(6).select(F.concat(F.lit("part="), "id").alias("loc"))
    index.write.format("xml").option("rootTag", "sitemapindex").option("rowTag", "sitemap").save(f"{folder}/root")
    entries = spark.read.format("sitemap").load(folder).withColumn("location", F.regexp_extract("path", r"/(part=\d+|root)/", 1))
    return readers.follow_sitemaps(entries, spark.createDataFrame([("root",)], "location string"), 2)


@query("""WITH p AS (SELECT c_custkey AS k, c_custkey % 181 - 90 AS lat, c_custkey % 361 - 180 AS lon, c_custkey % 97 AS v FROM customer)
  SELECT CASE WHEN k % 2 = 0 THEN sha256(lat || '|' || lon || '|' || v) ELSE CAST(k AS VARCHAR) END AS id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, CAST(v AS DOUBLE) AS value FROM p WHERE lat BETWEEN -45 AND 45 AND lon BETWEEN -90 AND 90""")
def sc8_points(spark, d):
    """A layer of hotspots and one of features, within a box."""
    datasource.register(spark)
    folder, k = new_folder(spark, "points"), F.col("c_custkey")
    p = a.scan(spark, d, "customer", ["c_custkey"]).select(k, (k % 181 - 90).alias("latitude"), (k % 361 - 180).alias("longitude"), (k % 97).alias("brightness"))
    p.where("c_custkey % 2 = 0").drop("c_custkey").write.csv(f"{folder}/hot", header=True)
    feature = F.struct(k.cast("string").alias("id"), F.struct(F.array("longitude", "latitude").alias("coordinates")).alias("geometry"), F.struct(F.col("brightness").alias("value")).alias("properties"))
    p.where("c_custkey % 2 = 1").select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("value")).write.text(f"{folder}/geo")
    layer = lambda kind, name: spark.read.format("points").option("kind", kind).option("box", "-45,-90,45,90").load(f"{folder}/{name}")
    return layer("hotspots", "hot").unionByName(layer("geojson", "geo"))


#: The ledger's cells of the query below, in SQL; all others are empty.
CELLS = {
    "no": "CAST(no AS VARCHAR)", "country": "o_orderpriority", "title": """'order "' || o_orderkey || '"'""", "published_at": "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)", "report_id": "CAST(o_orderkey AS VARCHAR)",
    "cases": "CASE WHEN o_custkey % 5 = 0 THEN 'about ' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END", "lat": "CASE WHEN o_orderkey % 7 = 0 THEN 'A; B' ELSE CAST(o_orderkey % 90 AS VARCHAR) END",
    "lon": "CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 180 AS VARCHAR) END",
}
LINE_SQL = " || ',' || ".join(f"""'"' || replace(coalesce({CELLS.get(c, "''")}, ''), '"', '""') || '"'""" for _, c in writers.LEDGER)


@query(f"WITH n AS (SELECT *, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS no FROM orders) SELECT CAST(no AS INTEGER) AS no, {LINE_SQL} AS line FROM n WHERE no <= 5000")
def sc10_ledger(spark, d):
    """The newest 5,000 orders as lines of the ledger (the export's limit)."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = a.scan(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"]).select(
        k.alias("report_id"), F.concat(F.lit('order "'), k, F.lit('"')).alias("title"), F.col("o_orderpriority").alias("country"), F.to_date("o_orderdate").alias("published_at"),
        c.alias("cases"), F.when(c % 5 == 0, F.concat(F.lit("about "), c)).alias("cases_display"), (k % 90).alias("lat"), (k % 180).alias("lon"), F.when(k % 7 == 0, "A; B").alias("geo_summary"),
    )
    return writers.ledger_lines(rows)


@query("""WITH x AS (SELECT lang AS label, CAST('0x' || sha256(CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) AS h FROM documents) SELECT CASE WHEN h / 4294967295.0::DOUBLE < 0.8 THEN 'train' ELSE 'test' END AS part, label, count(*) AS n FROM x GROUP BY 1, 2""")
def sc11_training_export(spark, d):
    """The manifest of documents written as JSON lines for training and test, and counted from those files."""
    folder = new_folder(spark, "training")
    writers.export_training(a.scan(spark, d, "documents", ["doc_id", "lang"]).withColumnRenamed("lang", "label"), folder, key="doc_id")
    return spark.read.schema("doc_id long, label string, part string").json(f"{folder}/rows").groupBy("part", "label").agg(F.count("*").alias("n"))


@query("""SELECT sha256(text || '|' || lang || '|' || source || '|' || 'document') AS hash, round(max(n_chars / 1000.0), 4) AS confidence FROM documents GROUP BY 1""")
def ss10_capture(spark, d):
    """Documents captured as training examples in three batches, the second delivered twice."""
    folder = new_folder(spark, "examples")
    docs = a.scan(spark, d, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    sink = jobs.capture_sink(spark, folder, 16)
    for n in (0, 1, 1, 2):
        own = docs.where(f"doc_id % 3 = {n}")
        sink(own.select("text", F.col("lang").alias("language"), F.col("source").alias("label"), F.lit("document").alias("type"), (F.col("n_chars") / 1000.0).alias("confidence")), n)
    return BucketedTable(spark, folder, "hash", 16).read().select("hash", F.round("confidence", 4).alias("confidence"))


@query(rf"""WITH p AS (SELECT page_id, concat_ws(' ', lower({TITLE_SQL}), CASE WHEN page_id % 2 = 0 THEN 'la santé' END, lower(url)) AS hay, CASE WHEN page_id % 5 > 0 THEN CAST({DAY_SQL} AS DATE) END AS day, CASE page_id % 3 WHEN 1 THEN 'korea' WHEN 2 THEN 'chad' ELSE '' END AS source FROM pages),
  r AS (SELECT n_nationkey AS k, unnest(['la', 'ment', 'the', 'example', 'eaux', lower(n_name)][n_nationkey % 6 + 1 : n_nationkey % 6 + 2]) AS term, CASE WHEN n_nationkey % 4 > 0 THEN DATE '2024-01-05' END AS since, CASE WHEN n_nationkey % 3 > 0 THEN DATE '2024-01-20' END AS until, ['', 'fr', 'south korea'][n_nationkey % 3 + 1] AS country FROM nation)
  SELECT DISTINCT page_id AS report_id, k AS request_id FROM p, r WHERE (day IS NULL OR (coalesce(day >= since, true) AND coalesce(day <= until, true)))
    AND CASE WHEN length(term) > 3 THEN contains(hay, term) ELSE regexp_matches(' ' || hay || ' ', '[^\p{{L}}\p{{N}}_]' || term || '[^\p{{L}}\p{{N}}_]') END
    AND (country = '' OR contains(hay, country) OR source <> '' AND (contains(source, country) OR contains(country, source)))""")
def jn14_match_requests(spark, d):
    """Pages that each nation's request asks for: terms in title, summary and address, dates, country."""
    k, n = F.col("page_id"), F.col("n_nationkey")
    reports = pages_of(spark, d).select(
        k.alias("report_id"), "title", F.when(k % 2 == 0, "La santé").alias("summary"), "url", F.when(k % 5 > 0, F.to_date("day")).alias("published_at"), F.when(k % 3 == 1, "Korea").when(k % 3 == 2, "Chad").alias("source_country"),
    )
    terms = F.array(*map(F.lit, ["la", " Ment", "THE", "example", "eaux"]), F.col("n_name"))
    country = F.when(n % 3 == 1, "FR").when(n % 3 == 2, "South Korea")
    requests = a.scan(spark, d, "nation").select(n.alias("request_id"), F.slice(terms, (n % 6 + 1).cast("int"), 2).alias("terms"), F.when(n % 4 > 0, F.to_date(F.lit("2024-01-05"))).alias("since"), F.when(n % 3 > 0, F.to_date(F.lit("2024-01-20"))).alias("until"), country.alias("country"))
    return matching.match_requests(reports, requests)
