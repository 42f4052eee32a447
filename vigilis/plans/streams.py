"""Batch twins of the streaming jobs, and readers over stored pages and posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilis.functions.sql import normalize_unicode, register_functions, summary_view
from vigilis.functions.text import normalize_url, short_label
from vigilis.operators.textjobs import expand_abbreviations
from vigilis.plans import URLS_SQL, query
from vigilis.sources import adapters as a
from vigilis.sources import readers, writers
from vigilis.sources.adapters import SIGNALS_SQL
from vigilis.streaming import jobs


@query(f"""WITH {SIGNALS_SQL} SELECT place, label, CAST(sum(cases) AS BIGINT) AS cases, count(*) AS events FROM signals GROUP BY 1, 2""")
def ss4_kpi(spark, d):
    return jobs.kpi_by(a.signals(spark, d), ["place", "label"])


@query(f"""WITH {SIGNALS_SQL}, w AS (SELECT label, CAST(published_at AS DATE) - CAST(k AS INTEGER) AS s FROM signals, range(0, 7) t(k)), g AS (SELECT label, s, count(*) AS events FROM w GROUP BY 1, 2)
  SELECT g.label, CAST(g.s AS TIMESTAMP) AS start, g.events, coalesce(b.events, 0) AS previous, g.events >= 2 AND (coalesce(b.events, 0) = 0 OR 2 * g.events >= 3 * b.events) AS surge FROM g LEFT JOIN g b ON g.label = b.label AND b.s = g.s - 7""")
def ss5_surges(spark, d):
    return jobs.surges(jobs.surge_windows(a.signals(spark, d)))


@query("""WITH n AS (SELECT event_id, user_id, event_type FROM events WHERE event_id % 2 = 0), o AS (SELECT event_id, user_id, event_type FROM events WHERE event_id % 2 = 1)
  SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n) UNION ALL SELECT * FROM n""")
def ss8_replace_by_report(spark, d):
    e = a.scan(spark, d, "events", ["event_id", "user_id", "event_type"])
    return jobs.replace_by_report(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), "user_id")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS events FROM s GROUP BY user_id, n""")
def ss11_sessionize(spark, d):
    return jobs.sessionize(a.scan(spark, d, "events"), "user_id", "ts")


@query("""SELECT DISTINCT ON (user_id, event_type) user_id, event_type FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id < 100)""")
def ss3_dedup(spark, d):
    e = a.scan(spark, d, "events")
    return jobs.dedup_stream(e, ["user_id", "event_type"], "ts", "1 hour", e.where("event_id < 100").select("user_id").join(e.select("user_id", "event_type").distinct(), "user_id")).select("user_id", "event_type")


@query("""WITH m AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'malformed' WHEN event_type = 'view' THEN 'detached' WHEN event_type = 'click' THEN 'other_year' ELSE 'good' END AS outcome FROM events) SELECT outcome, count(*) AS n FROM m GROUP BY 1""")
def ss2_parse_messages(spark, d):
    e = a.scan(spark, d, "events")
    at = F.when(F.col("event_type") == "click", F.lit("2020-01-01 00:00:00")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    body = F.to_json(F.struct(F.col("event_id").alias("report_id"), F.lit("t").alias("text"), F.date_format(F.to_timestamp(at), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), F.when(F.col("event_type") == "view", "Detached").otherwise("x").alias("feed")))
    raw = e.select(F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(body).alias("value"))
    return jobs.parse_messages(raw, 2024).groupBy(F.coalesce("reject", F.lit("good")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, unnest(regexp_extract_all(html, '<a href="([^"#][^"]*)"', 1)) AS href FROM pages) SELECT page_id, count(*) AS n, min(root || href) AS link FROM h WHERE href[1] = '/' GROUP BY 1""")
def sc7_extract_links(spark, d):
    x = readers.extract_links(a.scan(spark, d, "pages"))
    return x.groupBy("page_id").agg(F.count("*").alias("n"), F.min("link").alias("link"))


@query("""WITH c AS (SELECT conv_id, turn, nullif(trim(text), '') AS text FROM conversations) SELECT CAST(conv_id AS VARCHAR) AS post_id, count(text) AS n FROM c GROUP BY 1""")
def sc3_posts(spark, d):
    c = a.scan(spark, d, "conversations")
    return readers.posts_of(c.withColumn("post_id", F.col("conv_id"))).select("post_id", F.size("comments").cast("long").alias("n"))


@query("""SELECT page_id, length(substring('Page ' || page_id || chr(10) || chr(10) || html, 1, 3500)) AS size FROM pages""")
def sc9_article_text(spark, d):
    p = a.scan(spark, d, "pages").select("page_id", F.concat(F.lit("Page  "), "page_id").alias("title"), F.col("html").alias("body"))
    return readers.article_text(p, 3500).select("page_id", F.length("window").cast("long").alias("size"))


@query("""SELECT r_regionkey AS k, lower(r_name) || '|all|1996-01-01|1996-12-31' AS key FROM region""")
def sc13_filter_key(spark, d):
    names = a.scan(spark, d, "region")
    return names.select(F.col("r_regionkey").alias("k"), F.concat(F.lower("r_name"), F.lit(writers.filter_key("", None, "1996-01-01", "1996-12-31")[3:])).alias("key"))


@query(f"""WITH {URLS_SQL}, v AS (SELECT 'collector' AS variant, collector AS u FROM urls UNION ALL SELECT 'api', api FROM urls UNION ALL SELECT 'export', export FROM urls)
  SELECT variant, count(DISTINCT u) AS n, min(u) AS first, max(u) AS last, CAST(0 AS BIGINT) AS changed FROM v GROUP BY 1""")
def fn9_idempotent(spark, d):
    """By variant: how many addresses there are, and how many change when they are normalised again (none)."""
    pages = a.scan(spark, d, "pages", ["url"])
    rows = [F.struct(F.lit(v).alias("variant"), normalize_url(F.col("url"), v).alias("u"), normalize_url(normalize_url(F.col("url"), v), v).alias("again")) for v in ("collector", "api", "export")]
    flat = pages.select(F.inline(F.array(*rows)))
    return flat.groupBy("variant").agg(F.count_distinct("u").alias("n"), F.min("u").alias("first"), F.max("u").alias("last"), F.count_if(F.col("u") != F.col("again")).alias("changed"))


@query("""WITH x AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem), s AS (SELECT d, d - CAST(dayofweek(d) AS INTEGER) AS sun FROM x), y AS (SELECT d, sun, year(sun + 3) AS y FROM s)
  SELECT d AS day, CAST(y AS INTEGER) AS y, CAST((sun - (make_date(y, 1, 4) - CAST(dayofweek(make_date(y, 1, 4)) AS INTEGER))) // 7 + 1 AS INTEGER) AS w FROM y""")
def ud1_sql_functions(spark, d):
    """The same weeks through the functions that SQL users call."""
    register_functions(spark)
    a.scan(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct().createOrReplaceTempView("ship_days")
    return spark.sql("SELECT day, mmwr_year(day) AS y, mmwr_week(day) AS w FROM ship_days")


@query(f"""WITH {a.FACTS_SQL} SELECT place, label, CAST(sum(cases) AS BIGINT) AS cases FROM facts WHERE place LIKE 'NATION_1%' GROUP BY 1, 2""")
def ud4_summary_view(spark, d):
    summary_view(a.facts(spark, d))
    return spark.sql("SELECT place, label, cases FROM disease_summary WHERE place LIKE 'NATION_1%'")


@query("SELECT doc_id, length(text) AS size FROM documents")
def ud5_normalize_unicode(spark, d):
    return a.scan(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.length(normalize_unicode(F.col("text"), "NFC")).cast("long").alias("size"))


@query("SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'STD' WHEN 'ECONOMY' THEN 'ECO' ELSE p_type END AS short FROM part")
def fn12_short_label(spark, d):
    return a.scan(spark, d, "part").select("p_partkey", short_label(F.col("p_type"), {"STANDARD": "STD", "ECONOMY": "ECO"}).alias("short"))


@query("SELECT n_name AS alias, n_nationkey AS concept FROM nation UNION SELECT 'kab ' || n_nationkey, n_nationkey FROM nation UNION SELECT 'kabupaten ' || n_nationkey, n_nationkey FROM nation")
def tx15_expand_abbreviations(spark, d):
    n = a.scan(spark, d, "nation")
    lex = n.select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("concept")).unionByName(n.select(F.concat(F.lit("kabupaten "), "n_nationkey").alias("alias"), F.col("n_nationkey").alias("concept")))
    return expand_abbreviations(lex, {"kabupaten": "kab"})
