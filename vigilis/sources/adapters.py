"""The canonical frames (facts, signals, places, rules, sources, runs, posts) from relational tables, and the same as SQL.

The SQL strings are used by the oracle only; the DataFrames are built by functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASEAN-like member list of the dashboards, here the regions that count as members.
MEMBERS = ["AFRICA", "AMERICA", "ASIA"]
ALL_MEMBERS = ["AFRICA", "AMERICA", "ANTARCTICA", "ASIA", "EUROPE"]
EXCLUDED_SOURCES = ["test", "household"]


def scan(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A Parquet table; filter and columns reach the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if where:
        df = df.where(where)
    return df.select(*columns) if columns else df


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """One fact for each order line. Dimensions that are bounded by their kind (nations, regions) are broadcast."""
    nation = scan(spark, folder, "nation").join(F.broadcast(scan(spark, folder, "region")), F.expr("n_regionkey = r_regionkey"))
    customer = scan(spark, folder, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"]).join(F.broadcast(nation), F.expr("c_nationkey = n_nationkey"))
    orders = scan(spark, folder, "orders").join(customer, F.expr("o_custkey = c_custkey"))
    part = scan(spark, folder, "part", ["p_partkey", "p_type", "p_size"])
    supplier = scan(spark, folder, "supplier", ["s_suppkey", "s_name"])
    # orders come last: until then lines are narrow, and what groups by report finds the rows dealt by it
    lines = scan(spark, folder, "lineitem").join(part, F.expr("l_partkey = p_partkey")).join(supplier, F.expr("l_suppkey = s_suppkey"))
    rows = lines.join(orders, F.expr("l_orderkey = o_orderkey"))
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fact_id"),
        F.col("o_orderkey").alias("report_id"),
        F.when(F.col("l_linenumber") > 1, F.col("o_orderkey")).alias("parent_id"),
        F.when(F.col("p_size") == 50, "UNKNOWN").otherwise(F.col("p_type")).alias("label"),
        F.col("n_name").alias("place"),
        F.col("r_name").alias("country"),
        (F.col("n_nationkey") % 5 * 2.0).alias("lat"),
        (100 + F.col("n_nationkey") * 1.5).alias("lon"),
        F.to_date("l_shipdate").alias("published_at"),
        F.col("o_orderdate").alias("created_at"),
        F.col("l_quantity").cast("long").alias("cases"),
        (F.col("l_linenumber") - 1).cast("long").alias("deaths"),
        (F.abs("l_discount") * 10).alias("confidence"),
        (F.col("o_orderpriority") == "1-URGENT").alias("alert"),
        (F.col("l_linestatus") == "O").alias("needs_review"),
        (F.col("l_returnflag") != "R").alias("is_relevant"),
        F.col("c_mktsegment").alias("source_type"),
        F.col("s_name").alias("source_name"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("order/"), F.col("o_orderkey"))).alias("url"),
    )


FACTS_SQL = """facts AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fact_id, o_orderkey AS report_id,
    CASE WHEN l_linenumber > 1 THEN o_orderkey END AS parent_id,
    CASE WHEN p_size = 50 THEN 'UNKNOWN' ELSE p_type END AS label, n_name AS place, r_name AS country,
    (n_nationkey % 5) * 2.0::DOUBLE AS lat, 100 + n_nationkey * 1.5::DOUBLE AS lon,
    CAST(l_shipdate AS DATE) AS published_at, o_orderdate AS created_at, CAST(l_quantity AS BIGINT) AS cases,
    CAST(l_linenumber - 1 AS BIGINT) AS deaths, abs(l_discount) * 10 AS confidence, o_orderpriority = '1-URGENT' AS alert,
    l_linestatus = 'O' AS needs_review, l_returnflag <> 'R' AS is_relevant, c_mktsegment AS source_type, s_name AS source_name,
    CASE WHEN o_orderstatus <> 'P' THEN 'order/' || o_orderkey END AS url
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

VALID_SQL = """is_relevant AND label IS NOT NULL AND upper(label) <> 'UNKNOWN' AND upper(label) NOT LIKE 'NEGATIVE%'
  AND coalesce(confidence, 0) >= 0.15 AND published_at IS NOT NULL AND lower(coalesce(source_type, '')) NOT IN ('test', 'household')"""

KEY_SQL = "coalesce(nullif(url, ''), CAST(report_id AS VARCHAR), fact_id)"

#: Valid facts in a window, then the best one of each article.
BEST_SQL = f"""{FACTS_SQL}, best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY confidence DESC NULLS LAST, created_at DESC, fact_id) AS rn
    FROM facts WHERE {VALID_SQL} AND published_at BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') WHERE rn = 1)"""

CASES_SQL = "greatest(least(coalesce(cases, 0), 2000000), 0)"
DEATHS_SQL = "greatest(least(coalesce(deaths, 0), 200000), 0)"


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """Events as signals: label, place (user), time, cases, JSON payload."""
    return scan(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("label"), F.col("user_id").cast("string").alias("place"), F.col("ts").alias("published_at"),
        F.floor("value").cast("long").alias("cases"), "value", F.col("props").alias("payload"),
    )


SIGNALS_SQL = """signals AS (SELECT event_id, event_type AS label, CAST(user_id AS VARCHAR) AS place, ts AS published_at,
    CAST(floor(value) AS BIGINT) AS cases, value, props AS payload FROM events)"""


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as places with coordinates: NATION_3 twice (an older row first), NATION_7 inactive."""
    base = scan(spark, folder, "nation").join(F.broadcast(scan(spark, folder, "region")), F.expr("n_regionkey = r_regionkey"))
    rows = base.select(
        F.col("n_nationkey").cast("long").alias("place_id"), F.col("n_name").alias("name"), F.col("r_name").alias("country"),
        (F.col("n_nationkey") % 5 * 2.0).alias("lat"), (100 + F.col("n_nationkey") * 1.5).alias("lon"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("n_nationkey")).alias("updated_at"), (F.col("n_nationkey") != 7).alias("active"),
    )
    older = rows.where("place_id = 3").select(
        F.lit(103).cast("long").alias("place_id"), F.upper("name").alias("name"), F.lit("OLD").alias("country"), "lat", "lon",
        F.lit("2019-01-01").cast("date").alias("updated_at"), "active",
    )
    return rows.unionByName(older)


PLACES_SQL = """places AS (
  SELECT CAST(n_nationkey AS BIGINT) AS place_id, n_name AS name, r_name AS country, (n_nationkey % 5) * 2.0::DOUBLE AS lat,
    100 + n_nationkey * 1.5::DOUBLE AS lon, DATE '2020-01-01' + CAST(n_nationkey AS INTEGER) AS updated_at, n_nationkey <> 7 AS active
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 103, upper(n_name), 'OLD', (n_nationkey % 5) * 2.0::DOUBLE, 100 + n_nationkey * 1.5::DOUBLE, DATE '2019-01-01', true
  FROM nation WHERE n_nationkey = 3)"""


def rules(spark: SparkSession, folder: str) -> DataFrame:
    """A case threshold for each label: ten for each character of its name."""
    return scan(spark, folder, "part", ["p_type"]).distinct().select(F.col("p_type").alias("label"), (F.length("p_type") * 10).cast("long").alias("threshold"))


RULES_SQL = "rules AS (SELECT DISTINCT p_type AS label, CAST(length(p_type) * 10 AS BIGINT) AS threshold FROM part)"


def aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Two spellings for each label; 'shared' stands for all of them."""
    base = rules(spark, folder).select("label")
    return (
        base.select("label", F.lower("label").alias("alias"), F.lit(0.9).alias("confidence"))
        .unionByName(base.select("label", F.concat(F.lower("label"), F.lit("-x")).alias("alias"), F.lit(0.5).alias("confidence")))
        .unionByName(base.select("label", F.lit("shared").alias("alias"), F.lit(0.4).alias("confidence")))
    )


ALIASES_SQL = """aliases AS (SELECT label, lower(label) AS alias, 0.9::DOUBLE AS confidence FROM rules
  UNION ALL SELECT label, lower(label) || '-x', 0.5 FROM rules UNION ALL SELECT label, 'shared', 0.4 FROM rules)"""


def sources(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation_id"), F.col("s_acctbal").alias("balance"),
        F.concat(F.lit("https://"), F.when(F.col("s_suppkey") % 3 == 0, "health.gov").when(F.col("s_suppkey") % 3 == 1, "news").otherwise("blog"), F.lit(".example.org/"), F.col("s_suppkey")).alias("url"),
        F.element_at(F.array(*map(F.lit, ["rss", "web", "api", "csv"])), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("kind"),
        F.concat(F.lit("interval:"), F.col("s_suppkey") % 7 * 10).alias("schedule"),
    )


SOURCES_SQL = """sources AS (SELECT s_suppkey AS source_id, s_name AS name, s_nationkey AS nation_id, s_acctbal AS balance,
    'https://' || CASE s_suppkey % 3 WHEN 0 THEN 'health.gov' WHEN 1 THEN 'news' ELSE 'blog' END || '.example.org/' || s_suppkey AS url,
    ['rss', 'web', 'api', 'csv'][s_suppkey % 4 + 1] AS kind, 'interval:' || (s_suppkey % 7 * 10) AS schedule FROM supplier)"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as collector runs of the sources."""
    n = scan(spark, folder, "supplier", ["s_suppkey"]).agg(F.count("*").alias("n"))
    return scan(spark, folder, "orders").crossJoin(F.broadcast(n)).select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % F.col("n")).alias("source_id"),
        F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED").alias("status"),
        F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("INTERVAL 10 MINUTES")).alias("finished_at"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("items"),
    )


RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, o_custkey % (SELECT count(*) FROM supplier) AS source_id,
    CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status, o_orderdate AS started_at,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 10 MINUTE END AS finished_at,
    CAST(floor(o_totalprice / 1000) AS BIGINT) AS items FROM orders)"""
