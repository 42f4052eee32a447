"""Queries on joins, windows, paging, ledgers, operational logs and repeated reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from vigilis.functions import dates, text, values
from vigilis.operators import articles, dedup, kpi, lookup, ops, paging
from vigilis.plans import URLS_SQL, query
from vigilis.plans.kpi import MEMBERS, SUMS, best
from vigilis.sources import adapters as a
from vigilis.sources.adapters import ALIASES_SQL, BEST_SQL, FACTS_SQL, PLACES_SQL, RULES_SQL, RUNS_SQL, SIGNALS_SQL, SOURCES_SQL, VALID_SQL

NOW = datetime(2001, 8, 1, 12, 0)
NOW_SQL = "TIMESTAMP '2001-08-01 12:00:00'"


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_quantity < 10 GROUP BY 1")
def sc1_scan(spark, d):
    x = a.scan(spark, d, "lineitem", ["l_returnflag", "l_quantity"], "l_shipdate >= timestamp'1997-01-01' and l_quantity < 10")
    return x.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query(f"""WITH {FACTS_SQL}, {PLACES_SQL}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY updated_at DESC, place_id) AS rn FROM places WHERE active) WHERE rn = 1)
  SELECT one.country AS dim_country, count(*) AS n FROM facts LEFT JOIN one ON lower(trim(facts.place)) = lower(trim(one.name)) GROUP BY 1""")
def jn1_latest_lookup(spark, d):
    out = lookup.latest_lookup(a.facts(spark, d), a.places(spark, d), "place", "name", ["country"], [F.desc("updated_at"), F.asc("place_id")])
    return out.groupBy("dim_country").agg(F.count("*").alias("n"))


@query(f"""WITH {FACTS_SQL}, {PLACES_SQL}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY updated_at DESC, place_id) AS rn FROM places WHERE active) WHERE rn = 1)
  SELECT CASE WHEN source_type = 'BUILDING' THEN 'AFRICA' WHEN coalesce(one.country, place) IN ('AFRICA', 'AMERICA', 'ASIA') THEN coalesce(one.country, place) ELSE 'OUTSIDE' END AS resolved, count(*) AS n
  FROM facts LEFT JOIN one ON lower(trim(facts.place)) = lower(trim(one.name)) GROUP BY 1""")
def fp4_resolve_country(spark, d):
    """A feed's own country wins, else that of the place, else the place's name, folded to members."""
    from vigilis.functions.predicates import fold_label

    out = lookup.latest_lookup(a.facts(spark, d), a.places(spark, d), "place", "name", ["country"], [F.desc("updated_at"), F.asc("place_id")])
    own = fold_label(F.coalesce("dim_country", "place"), {m: m for m in MEMBERS})
    return out.groupBy(F.when(F.col("source_type") == "BUILDING", "AFRICA").otherwise(own).alias("resolved")).agg(F.count("*").alias("n"))


@query(f"""WITH {RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rn FROM runs) SELECT source_id, run_id, status FROM r WHERE rn = 1""")
def jn2_latest_run(spark, d):
    return lookup.latest_per_key(a.runs(spark, d), "source_id", ["started_at", "run_id"], ["run_id", "status"])


@query(f"""WITH {RULES_SQL}, {ALIASES_SQL}, raw AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) || '-x' WHEN 2 THEN 'shared' ELSE 'other thing' END AS raw FROM part),
  b AS (SELECT lower(alias) AS k, (list(label ORDER BY confidence DESC, label))[1] AS by_alias FROM aliases GROUP BY 1)
  SELECT coalesce(r.label, by_alias, 'Other Thing') AS canonical, count(*) AS n FROM raw LEFT JOIN rules r ON lower(raw) = lower(r.label) LEFT JOIN b ON lower(raw) = k GROUP BY 1""")
def jn3_canonical_label(spark, d):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.col("p_type")).when(k == 1, F.concat(F.lower("p_type"), F.lit("-x"))).when(k == 2, "shared").otherwise("other thing")
    rows = a.scan(spark, d, "part").select("p_partkey", raw.alias("raw"))
    return lookup.canonical_label(rows, "raw", a.rules(spark, d), a.aliases(spark, d)).groupBy("canonical").agg(F.count("*").alias("n"))


@query(f"""WITH {RULES_SQL}, {ALIASES_SQL}, u AS (SELECT lower(label) AS key, label FROM rules UNION ALL SELECT replace(alias, '-', ' '), label FROM aliases)
  SELECT key, min(label) AS label FROM u GROUP BY key HAVING count(DISTINCT label) = 1""")
def jn4_unambiguous_map(spark, d):
    return lookup.unambiguous_map(a.rules(spark, d), a.aliases(spark, d))


@query(f"""WITH {FACTS_SQL}, {RULES_SQL}, {ALIASES_SQL} SELECT label, count(*) AS n FROM facts WHERE contains(lower(label), 'small-x') OR EXISTS (SELECT 1 FROM aliases a WHERE a.label = facts.label AND lower(alias) = 'small-x') GROUP BY 1""")
def fp7_label_filter(spark, d):
    return lookup.label_filter(a.facts(spark, d), a.aliases(spark, d), "small-x").groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, CAST(sum(o_totalprice > 100000) AS BIGINT) AS large FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= o_orderdate + INTERVAL 60 DAY)""")
def jn6_semi_range(spark, d):
    o = a.scan(spark, d, "orders")
    late = F.expr("l_orderkey = o_orderkey and l_shipdate >= o_orderdate + interval 60 days")
    return lookup.keep_if_exists(o, a.scan(spark, d, "lineitem", ["l_orderkey", "l_shipdate"]), late).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("""SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1""")
def jn7_anti(spark, d):
    back = a.scan(spark, d, "lineitem", ["l_orderkey"], "l_returnflag = 'R'")
    return lookup.drop_if_exists(a.scan(spark, d, "orders"), back, F.expr("l_orderkey = o_orderkey")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT max(o_orderdate) - INTERVAL 30 DAY AS low, max(o_orderdate) AS high FROM orders) SELECT low, high, count(o_orderkey) AS n, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) AS cents FROM b LEFT JOIN orders ON o_orderdate BETWEEN low AND high GROUP BY 1, 2""")
def jn8_bounds(spark, d):
    o = a.scan(spark, d, "orders")
    bounds = o.agg((F.max("o_orderdate") - F.expr("interval 30 days")).alias("low"), F.max("o_orderdate").alias("high"))
    return lookup.join_bounds(o, bounds, "low", "high", "o_orderdate", [F.count("*").alias("n"), F.coalesce(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")), F.lit(0)).alias("cents")])


@query("SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM part) AS parts")
def jn9_assemble(spark, d):
    n = lambda t, c: a.scan(spark, d, t).agg(F.count("*").alias(c))
    return lookup.assemble(n("orders", "orders"), n("customer", "customers"), n("part", "parts"))


@query("""WITH p AS (SELECT c_custkey AS id, (c_custkey % 97) * 0.1 AS lat, 100 + (c_custkey % 89) * 0.4 AS lon FROM customer) SELECT id, 'box' AS polygon FROM p WHERE lat BETWEEN 1 AND 6 AND lon BETWEEN 103 AND 121""")
def jn10_within_polygon(spark, d):
    points = a.scan(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 97 * F.lit(0.1)).alias("lat"), (100 + F.col("c_custkey") % 89 * F.lit(0.4)).alias("lon"))
    ring = [(1.0, 103.0), (6.0, 103.0), (6.0, 121.0), (1.0, 121.0)]
    polygons = spark.createDataFrame([("box", ring)], "polygon string, ring array<struct<lat:double,lon:double>>")
    return lookup.within_polygon(points, polygons)


@query("""WITH p AS (SELECT c_custkey AS id, (c_custkey % 97) * 0.1 AS lat, 100 + (c_custkey % 89) * 0.4 AS lon FROM customer),
  r AS (SELECT n_nationkey AS ref, (n_nationkey % 5) * 2.0 AS rlat, 100 + n_nationkey * 1.5 AS rlon FROM nation),
  j AS (SELECT id, ref, sqrt((lat - rlat) ** 2 + (lon - rlon) ** 2) AS dist FROM p, r), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, ref) AS rn FROM j WHERE dist <= 0.75)
  SELECT id, ref, round(dist, 4) AS distance FROM k WHERE rn = 1""")
def jn11_nearest(spark, d):
    points = a.scan(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 97 * F.lit(0.1)).alias("lat"), (100 + F.col("c_custkey") % 89 * F.lit(0.4)).alias("lon"))
    refs = a.scan(spark, d, "nation").select(F.col("n_nationkey").alias("ref"), (F.col("n_nationkey") % 5 * F.lit(2.0)).alias("lat"), (100 + F.col("n_nationkey") * F.lit(1.5)).alias("lon"))
    return lookup.nearest(points, refs, 0.75).withColumn("distance", F.round("distance", 4))


@query("""WITH n AS (SELECT doc_id AS id, text, n_chars FROM documents WHERE doc_id % 2 = 1), o AS (SELECT doc_id AS id, text FROM documents WHERE doc_id % 2 = 0)
  SELECT DISTINCT n.id AS new_id, o.id AS old_id FROM n JOIN o ON n.text = o.text""")
def jn12_match_any_key(spark, d):
    docs = a.scan(spark, d, "documents").select(F.col("doc_id").alias("id"), text.content_hash(F.col("text")).alias("content"), F.sha2("text", 256).alias("exact"))
    return lookup.match_any_key(docs.where("id % 2 = 1"), docs.where("id % 2 = 0"), ["content", "exact"])


@query(f"WITH {RULES_SQL}, {ALIASES_SQL} SELECT 'small-x' AS term UNION SELECT 'nothing' UNION SELECT 'small' UNION SELECT 'shared'")
def jn13_expand_terms(spark, d):
    return lookup.expand_terms(spark.createDataFrame([("small-x",), ("nothing",)], "term string"), a.aliases(spark, d))


@query(f"""WITH {SOURCES_SQL} SELECT source_id, CASE WHEN nation_id = 3 THEN 0 WHEN nation_id IN (4, 5) THEN 1 ELSE 2 END AS geo_rank FROM sources""")
def jn15_rank_sources(spark, d):
    s = a.sources(spark, d).withColumn("country", F.col("nation_id").cast("string"))
    return lookup.rank_sources(s, "3", ["4", "5"]).select("source_id", "geo_rank")


@query("""SELECT c.n_name AS country, min(r.r_name) AS region FROM nation c LEFT JOIN region r ON r.r_regionkey <= c.n_regionkey AND r.r_name <> 'AFRICA' GROUP BY 1""")
def jn16_region_of(spark, d):
    n = a.scan(spark, d, "nation").select(F.col("n_name").alias("country"), "n_regionkey")
    bridge = n.join(F.broadcast(a.scan(spark, d, "region")), F.expr("r_regionkey <= n_regionkey")).select("country", F.col("r_name").alias("region"))
    return lookup.region_of(n.select("country"), bridge, ["AFRICA"])


@query(f"""WITH {FACTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY {a.KEY_SQL} ORDER BY confidence DESC NULLS LAST, created_at DESC, fact_id) AS rn FROM facts) SELECT fact_id, round(confidence, 4) AS confidence FROM r WHERE rn = 1""")
def wn1_best_facts(spark, d):
    return dedup.best_facts(a.facts(spark, d)).select("fact_id", F.round("confidence", 4).alias("confidence"))


@query("SELECT DISTINCT ON (c_nationkey, c_mktsegment) c_nationkey, c_mktsegment, c_custkey, c_acctbal FROM customer ORDER BY c_nationkey, c_mktsegment, c_acctbal DESC, c_custkey")
def wn2_distinct_on(spark, d):
    c = a.scan(spark, d, "customer")
    return dedup.best_per_key(c, ["c_nationkey", "c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal")


@query("""WITH c AS (SELECT l_orderkey AS owner, l_suppkey % 10 AS new, min(l_linenumber * 1000000 + l_partkey) AS first FROM lineitem GROUP BY 1, 2)
  SELECT owner, new, first FROM c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = owner AND o_custkey % 10 = new)""")
def wn3_safe_rename(spark, d):
    rows = a.scan(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), (F.col("l_suppkey") % 10).alias("new"), (F.col("l_linenumber") * F.lit(1000000).cast("long") + F.col("l_partkey")).alias("first"))
    taken = a.scan(spark, d, "orders").select("o_orderkey", F.col("o_custkey") % 10)
    return dedup.safe_rename(rows, "owner", "new", taken, ["first"])


@query("""SELECT o_custkey AS custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS orderkey, max(o_totalprice) AS price FROM orders GROUP BY 1""")
def wn4_first_by(spark, d):
    o = a.scan(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    return dedup.first_by(o, ["custkey"], ["orderkey", "price"], ["price", "orderkey"])


@query(f"""WITH {RUNS_SQL}, r AS (SELECT *, row_number() OVER w AS n, sum(CASE WHEN status <> 'FAILED' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS ok FROM runs WINDOW w AS (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC)),
  s AS (SELECT source_id, count(*) FILTER (WHERE ok = 0) AS streak FROM r WHERE n <= 6 GROUP BY 1) SELECT source_id, streak, CAST(CASE WHEN streak > 0 THEN least(360, 15 * 2 ** least(streak - 1, 5)) ELSE 0 END AS BIGINT) AS wait_minutes FROM s""")
def wn5_backoff(spark, d):
    return dedup.backoff(a.runs(spark, d))


@query("""WITH x AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents), y AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM x WHERE rn = 1) SELECT doc_id, lang FROM y WHERE k <= 50""")
def wn6_cap_per_label(spark, d):
    docs = a.scan(spark, d, "documents", ["doc_id", "lang", "text"])
    return dedup.cap_per_label(docs, "lang", F.sha2("text", 256), [F.asc("doc_id")], 50).select("doc_id", "lang")


@query("""WITH RECURSIVE e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY text) AS b FROM documents) SELECT a AS id, b AS survivor FROM e""")
def wn7_dedup_identities(spark, d):
    docs = a.scan(spark, d, "documents").select(F.col("doc_id").alias("id"), text.content_hash(F.col("text")).alias("content"), F.sha2("text", 256).alias("exact"))
    return dedup.dedup_identities(docs, "id", ["content", "exact"], [F.asc("id")]).select("id", "survivor")


@query("""WITH RECURSIVE e AS (SELECT CAST(o_orderkey AS BIGINT) AS node, CAST(o_orderkey // 3 AS BIGINT) AS parent FROM orders WHERE o_orderkey > 7), w AS (SELECT node, parent AS up FROM e UNION ALL SELECT w.node, e.parent FROM w JOIN e ON w.up = e.node)
  SELECT node, min(up) AS root FROM w GROUP BY node""")
def wn8_resolve_roots(spark, d):
    edges = a.scan(spark, d, "orders").where("o_orderkey > 7").select(F.col("o_orderkey").alias("node"), F.floor(F.col("o_orderkey") / 3).cast("long").alias("parent"))
    return dedup.resolve_roots(edges)


@query(f"""WITH {BEST_SQL}, g AS (SELECT strftime(published_at, '%G-W%V') AS iso_week, {SUMS} FROM best GROUP BY 1) SELECT iso_week, cases, cases - lag(cases) OVER (ORDER BY iso_week) AS delta FROM g""")
def wn9_delta(spark, d):
    return dedup.delta_prev(kpi.weekly_series(best(spark, d)), "cases", ["iso_week"]).select("iso_week", "cases", "delta")


@query("""SELECT min(doc_id) AS doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1 GROUP BY text, lang""")
def wn10_first_seen(spark, d):
    docs = a.scan(spark, d, "documents", ["doc_id", "lang", "text"])
    return dedup.first_seen(docs.withColumn("h", F.sha2("text", 256)), "h", [F.asc("doc_id")]).select("doc_id", "lang")


@query("""WITH s AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS i, count(*) OVER () AS n FROM customer), b AS (SELECT v FROM s WHERE i IN (n // 5, 2 * n // 5, 3 * n // 5, 4 * n // 5))
  SELECT c_custkey, CAST((SELECT count(*) FROM b WHERE b.v < c_acctbal) AS INTEGER) AS quantile_class FROM customer""")
def wn11_quantile_classes(spark, d):
    return dedup.quantile_classes(a.scan(spark, d, "customer"), "c_acctbal", 5, "c_custkey").select("c_custkey", "quantile_class")


@query("""WITH s AS (SELECT l_orderkey AS doc_id, CAST(l_partkey % 100 AS BIGINT) AS start, CAST(l_partkey % 100 + l_quantity AS BIGINT) AS "end", l_linenumber FROM lineitem),
  d AS (SELECT DISTINCT doc_id, start, "end" FROM s) SELECT doc_id, start, "end" FROM d x WHERE NOT EXISTS (SELECT 1 FROM d y WHERE y.doc_id = x.doc_id AND y.start <= x.start AND y."end" >= x."end" AND (y.start < x.start OR y."end" > x."end"))""")
def wn13_drop_nested(spark, d):
    rows = a.scan(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 100).alias("start"), (F.col("l_partkey") % 100 + F.col("l_quantity")).cast("long").alias("end"))
    return dedup.drop_nested(rows.distinct())


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def tk1_top_k(spark, d):
    return paging.top_k(a.scan(spark, d, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, (SELECT CAST(ceil(count(*) / 40.0) AS BIGINT) FROM orders) AS pages FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 80")
def tk2_page(spark, d):
    rows, total, pages = paging.page(a.scan(spark, d, "orders"), 3, 40, [F.desc("o_orderdate"), F.asc("o_orderkey")])
    return rows.select("o_orderkey", F.lit(total).cast("long").alias("total"), F.lit(pages).cast("long").alias("pages"))


@query(f"""WITH {FACTS_SQL}, k AS (SELECT report_id, max(created_at) AS m FROM facts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 20) SELECT fact_id, facts.report_id FROM facts JOIN k ON facts.report_id = k.report_id""")
def tk3_page_keys(spark, d):
    return paging.page_keys(a.facts(spark, d), "report_id", "created_at", 2, 20).select("fact_id", "report_id")


@query(f"""WITH {BEST_SQL}, {RULES_SQL}, s AS (SELECT best.*, CASE WHEN NOT coalesce(confidence >= 0.35, false) THEN 'info' WHEN cases >= 2 * coalesce(threshold, 100) OR deaths > 0 THEN 'critical' WHEN cases >= coalesce(threshold, 100) OR alert THEN 'high' WHEN cases > 0 THEN 'warning' ELSE 'info' END AS severity FROM best LEFT JOIN rules ON lower(best.label) = lower(rules.label))
  SELECT fact_id, label, place, published_at, severity, cases FROM s ORDER BY published_at DESC, CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END DESC, cases DESC, fact_id LIMIT 100""")
def tk4_signal_feed(spark, d):
    return paging.signal_feed(best(spark, d), a.rules(spark, d))


@query(f"WITH {BEST_SQL} SELECT fact_id, label, country FROM best ORDER BY published_at DESC, fact_id LIMIT 50")
def tk5_kpi_events(spark, d):
    rows, _, _ = paging.page(best(spark, d), 1, 50, [F.desc("published_at"), F.asc("fact_id")])
    return rows.select("fact_id", "label", "country")


@query(f"WITH {RUNS_SQL} SELECT run_id, status FROM runs WHERE status = 'FAILED' AND contains(lower(CAST(source_id AS VARCHAR)), '7') ORDER BY started_at DESC, run_id LIMIT 30")
def tk7_list_jobs(spark, d):
    from vigilis.functions.predicates import search

    return paging.top_k(search(a.runs(spark, d), "7", ["source_id"], status="FAILED"), [F.desc("started_at"), F.asc("run_id")], 30).select("run_id", "status")


@query(f"WITH {RULES_SQL}, {ALIASES_SQL} SELECT label AS name, 'label' AS kind FROM rules UNION ALL SELECT alias, 'alias' FROM aliases")
def st1_union_all(spark, d):
    return paging.union_all(a.rules(spark, d).select(F.col("label").alias("name"), F.lit("label").alias("kind")), a.aliases(spark, d).select(F.col("alias").alias("name"), F.lit("alias").alias("kind")))


@query(f"""WITH {FACTS_SQL}, b AS (SELECT report_id, fact_id, 'matrix' AS channel, 0 AS branch FROM facts WHERE alert UNION ALL SELECT report_id, fact_id, 'event', 1 FROM facts),
  r AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY branch, fact_id) AS rn FROM b) SELECT report_id, fact_id, channel FROM r WHERE rn = 1""")
def st2_ledger(spark, d):
    f = a.facts(spark, d).select("report_id", "fact_id", "alert")
    return paging.ledger(f.where("alert").withColumn("channel", F.lit("matrix")), f.withColumn("channel", F.lit("event")), "report_id", [F.asc("fact_id")]).select("report_id", "fact_id", "channel")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'new ' || c_name FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0""")
def st3_append_new(spark, d):
    c = a.scan(spark, d, "customer").select("c_custkey", "c_name")
    return paging.append_new(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 2 = 0").withColumn("c_name", F.concat(F.lit("new "), "c_name")), ["c_custkey"])


@query("""WITH t AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), u AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)
  SELECT coalesce(u.c_custkey, t.c_custkey) AS c_custkey, coalesce(u.c_name, t.c_name) AS c_name, round(coalesce(u.c_acctbal, t.c_acctbal), 2) AS c_acctbal,
    CASE WHEN t.c_custkey IS NULL THEN 'new' WHEN u.c_custkey IS NULL THEN 'kept' WHEN t.c_acctbal <> u.c_acctbal THEN 'changed' ELSE 'same' END AS state FROM t FULL JOIN u ON t.c_custkey = u.c_custkey""")
def sc12_upsert(spark, d):
    c = a.scan(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    u = c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return paging.upsert_by_key(c.where("c_custkey % 3 <> 0"), u, "c_custkey", ["c_name", "c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(f"""WITH {RUNS_SQL}, {SOURCES_SQL} SELECT kind, count(*) AS runs, count(*) FILTER (WHERE status = 'SUCCESS') AS succeeded, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'RUNNING') AS running,
  count(*) FILTER (WHERE started_at >= {NOW_SQL} - INTERVAL 30 DAY) AS recent, CAST(sum(items) AS BIGINT) AS items, count(DISTINCT runs.source_id) AS sources FROM runs JOIN sources ON runs.source_id = sources.source_id GROUP BY 1""")
def ag18_crawl_stats(spark, d):
    return ops.crawl_stats(a.runs(spark, d), a.sources(spark, d), NOW)


@query(f"""WITH {SOURCES_SQL}, c AS (SELECT *, CASE WHEN contains(url, '.gov') THEN 'official' WHEN contains(url, 'news') THEN 'media' WHEN contains(url, 'blog') OR kind = 'csv' THEN 'social' ELSE 'other' END AS channel,
    CASE kind WHEN 'api' THEN 0.7 WHEN 'csv' THEN 0.6 WHEN 'rss' THEN 0.65 ELSE 0.5 END::DOUBLE AS credibility FROM sources)
  SELECT count(*) AS total, count(*) FILTER (WHERE kind = 'rss') AS rss, count(*) FILTER (WHERE kind = 'web') AS web, count(*) FILTER (WHERE kind = 'api') AS api, count(*) FILTER (WHERE kind = 'csv') AS csv,
    count(*) FILTER (WHERE channel = 'official') AS official, count(*) FILTER (WHERE channel = 'media') AS media, count(*) FILTER (WHERE channel = 'social') AS social, count(*) FILTER (WHERE channel = 'other') AS other,
    count(*) FILTER (WHERE credibility >= 0.7) AS trusted, count(*) FILTER (WHERE credibility < 0.4) AS doubtful, CAST(0 AS BIGINT) AS overridden, round(avg(credibility), 4) AS credibility FROM c""")
def ag19_source_summary(spark, d):
    from vigilis.functions.predicates import channel_of, source_credibility

    s = source_credibility(a.sources(spark, d)).withColumn("channel", channel_of(F.col("url"), F.col("kind")))
    return ops.source_summary(s)


@query(f"""WITH {RUNS_SQL}, p AS (SELECT * FROM runs WHERE started_at <= {NOW_SQL}), r AS (SELECT *, row_number() OVER w AS n, sum(CASE WHEN status <> 'FAILED' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS ok FROM p WINDOW w AS (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC)),
  s AS (SELECT source_id, max(CASE WHEN n = 1 THEN run_id END) AS run_id, max(CASE WHEN n = 1 THEN status END) AS status, max(started_at) AS started_at, count(*) FILTER (WHERE started_at >= {NOW_SQL} - INTERVAL 1 DAY) AS day_runs,
    count(*) FILTER (WHERE started_at >= {NOW_SQL} - INTERVAL 1 DAY AND status = 'FAILED') AS day_failures, count(*) FILTER (WHERE ok = 0 AND n <= 6) AS streak FROM r GROUP BY 1)
  SELECT *, CAST(CASE WHEN streak > 0 THEN least(360, 15 * 2 ** least(streak - 1, 5)) ELSE 0 END AS BIGINT) AS wait_minutes FROM s""")
def ag21_ops_health(spark, d):
    return ops.ops_health(a.runs(spark, d), NOW)


@query(f"WITH {RUNS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'SUCCESS') AS success, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'RUNNING') AS running FROM runs")
def ag22_status_counts(spark, d):
    return ops.status_counts(a.runs(spark, d), "status", ["SUCCESS", "FAILED", "RUNNING"])


@query(f"""WITH {FACTS_SQL}, q AS (SELECT source_type AS channel, lat IS NOT NULL AND lon IS NOT NULL AS geo, CASE WHEN NOT is_relevant OR confidence < 0.15 THEN 'noise' WHEN needs_review THEN 'review' ELSE 'surveillance' END AS quality FROM facts)
  SELECT channel, count(*) AS rows, count(*) FILTER (WHERE geo) AS with_geo, count(*) FILTER (WHERE NOT geo) AS without_geo, count(*) FILTER (WHERE quality = 'noise') AS noise, count(*) FILTER (WHERE quality = 'review') AS review,
    count(*) FILTER (WHERE quality = 'surveillance') AS surveillance FROM q GROUP BY 1""")
def ag23_ledger_summary(spark, d):
    from vigilis.functions.predicates import quality_class

    return articles.ledger_summary(a.facts(spark, d).withColumn("quality", quality_class()).withColumn("channel", F.col("source_type")))


KIDS_SQL = """k AS (SELECT * FROM facts f WHERE parent_id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM facts g WHERE g.parent_id = f.report_id))"""


def _text(column: str) -> str:
    return f"""(SELECT report_id, coalesce(string_agg({column} || '(' || n || ')', '; ' ORDER BY n DESC, {column}) FILTER (WHERE n > 0), '') AS t FROM (SELECT report_id, {column}, CAST(sum(cases) AS BIGINT) AS n FROM k GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH {FACTS_SQL}, {KIDS_SQL}, g AS (SELECT report_id, count(*) AS facts, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(deaths) AS BIGINT) AS deaths, bool_or(alert) AS alert, bool_or(needs_review) AS needs_review,
    max(CASE WHEN NOT is_relevant THEN 2 WHEN needs_review THEN 1 ELSE 0 END) AS w, (list(fact_id ORDER BY confidence DESC, created_at DESC, fact_id DESC))[1] AS lead_fact, count(DISTINCT label) AS labels FROM k GROUP BY 1),
  l AS (SELECT report_id, (list(label ORDER BY n DESC, label))[1] AS lead_label FROM (SELECT report_id, label, sum(cases) AS n FROM k GROUP BY 1, 2) GROUP BY 1)
  SELECT g.report_id, facts, cases, deaths, alert, needs_review, ['surveillance', 'review', 'noise'][w + 1] AS worst, lead_fact, labels, c.t AS by_country, p.t AS by_place, b.t AS by_label, s.t AS by_source, lead_label,
    CASE WHEN labels > 1 THEN 'label' ELSE 'place' END AS shown_by
  FROM g JOIN l ON g.report_id = l.report_id JOIN {_text('country')} c ON g.report_id = c.report_id JOIN {_text('place')} p ON g.report_id = p.report_id JOIN {_text('label')} b ON g.report_id = b.report_id JOIN {_text('source_name')} s ON g.report_id = s.report_id""")
def ag24_collapse_articles(spark, d):
    return articles.collapse_articles(a.facts(spark, d))


@query(f"""WITH {FACTS_SQL}, {KIDS_SQL}, n AS (SELECT report_id, count(DISTINCT place) AS places, count(DISTINCT label) AS labels FROM k GROUP BY 1)
  SELECT n.report_id, CASE WHEN places > 1 OR labels <= 1 THEN p.t ELSE b.t END AS display FROM n JOIN {_text('place')} p ON n.report_id = p.report_id JOIN {_text('label')} b ON n.report_id = b.report_id""")
def ag25_collapse_facts(spark, d):
    return articles.collapse_facts(a.facts(spark, d))


@query("""WITH x AS (SELECT l_suppkey AS key, l_linenumber = 1 AS is_total, CAST(l_quantity AS BIGINT) AS cases, year(l_shipdate) AS period FROM lineitem), y AS (SELECT * FROM (SELECT *, max(period) OVER (PARTITION BY key) AS m FROM x) WHERE period = m)
  SELECT key, CAST(CASE WHEN bool_or(is_total) THEN max(cases) FILTER (WHERE is_total) ELSE sum(cases) FILTER (WHERE NOT is_total) END AS BIGINT) AS cases, bool_or(is_total) AS from_total FROM y GROUP BY 1""")
def ag28_prefer_total(spark, d):
    x = a.scan(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_linenumber") == 1).alias("is_total"), F.col("l_quantity").cast("long").alias("cases"), F.year("l_shipdate").alias("period"))
    return articles.prefer_total(x, ["key"], "period")


@query("""WITH x AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber > 2 THEN l_returnflag END AS place, CAST(l_quantity AS BIGINT) AS cases, CAST(l_linenumber AS BIGINT) AS deaths FROM lineitem),
  t AS (SELECT k, max(cases) AS tc, max(deaths) AS td FROM x WHERE place IS NULL GROUP BY 1), o AS (SELECT x.* FROM x LEFT JOIN t ON x.k = t.k WHERE place IS NOT NULL AND (tc IS NULL OR NOT (cases = tc AND deaths = td))),
  c AS (SELECT k, sum(cases) AS cc, array_to_string(list_sort(list(DISTINCT place)), ';') AS children FROM o GROUP BY 1)
  SELECT d.k, CAST(coalesce(tc, cc) AS BIGINT) AS cases, children FROM (SELECT DISTINCT k FROM x) d LEFT JOIN t ON d.k = t.k LEFT JOIN c ON d.k = c.k""")
def ag29_fold_hierarchy(spark, d):
    x = a.scan(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("place"), F.col("l_quantity").cast("long").alias("cases"), F.col("l_linenumber").cast("long").alias("deaths"))
    return articles.fold_hierarchy(x, ["k"])


@query(f"WITH {FACTS_SQL} SELECT label, place, published_at, max(cases) AS cases, max(deaths) AS deaths, count(*) AS merged FROM facts GROUP BY 1, 2, 3")
def ag30_merge_equivalent(spark, d):
    return articles.merge_equivalent(a.facts(spark, d), ["label", "place", "published_at"])


@query("""WITH w AS (SELECT strftime(l_shipdate, '%Y-%m') AS week, l_suppkey AS site, CAST(avg(l_quantity) AS DOUBLE) AS positivity FROM lineitem GROUP BY 1, 2),
  g AS (SELECT week, round(avg(round(positivity, 6)), 4) AS positivity, count(*) FILTER (WHERE round(positivity, 6) < 25) AS low, count(*) FILTER (WHERE round(positivity, 6) >= 25 AND round(positivity, 6) < 35) AS mid, count(*) FILTER (WHERE round(positivity, 6) >= 35) AS high FROM w GROUP BY 1),
  b AS (SELECT week, string_agg(CAST(site AS VARCHAR), ',' ORDER BY r) AS bottom FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY round(positivity, 6), site) AS r FROM w) WHERE r <= 5 GROUP BY 1)
  SELECT g.week, positivity, low, mid, high, round(positivity - lag(positivity) OVER (ORDER BY g.week), 4) AS delta, bottom FROM g JOIN b ON g.week = b.week""")
def ag31_indicators(spark, d):
    x = a.scan(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("week"), F.col("l_suppkey").alias("site")).agg(F.round(F.avg("l_quantity"), 6).alias("positivity"))
    return articles.indicator_dashboard(x)


@query(f"""WITH {BEST_SQL}, b AS (SELECT country, strftime(published_at, '%Y-%m') AS p, sum(cases) AS cases FROM best WHERE country IN ('AFRICA', 'AMERICA', 'ASIA') GROUP BY 1, 2),
  g AS (SELECT country, CAST(sum(cases) AS BIGINT) AS cases, count(*) AS periods, CAST(arg_min(cases, p) AS BIGINT) AS first, CAST(arg_max(cases, p) AS BIGINT) AS latest FROM b GROUP BY 1)
  SELECT *, CASE WHEN first = 0 THEN 0 ELSE round((latest - first) * 100.0 / first, 1) END::DOUBLE AS change FROM g""")
def ag32_custom_report(spark, d):
    return articles.custom_report(best(spark, d), "month", MEMBERS)


@query(f"""WITH {BEST_SQL} SELECT country, place, label, CAST(grouping(country, place, label) AS BIGINT) AS level, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(deaths) AS BIGINT) AS deaths, count(*) AS events FROM best GROUP BY ROLLUP (country, place, label)""")
def ag33_region_rollup(spark, d):
    return articles.region_rollup(best(spark, d), ["country", "place", "label"])


GOLD_SQL = "gold AS (SELECT l.doc_id, quality AS truth, CASE WHEN n_chars >= 400 THEN 1 WHEN n_chars >= 100 THEN 0 END AS guess, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def gold(spark, d):
    docs = a.scan(spark, d, "documents", ["doc_id", "n_chars", "lang"])
    guess = F.when(F.col("n_chars") >= 400, 1).when(F.col("n_chars") >= 100, 0)
    return a.scan(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("truth"), guess.alias("guess"), "lang")


@query(f"""WITH {GOLD_SQL}, g AS (SELECT lang AS field, count(truth) AS annotated, count(*) FILTER (WHERE truth = guess) AS tp, count(*) FILTER (WHERE guess IS NOT NULL AND truth IS DISTINCT FROM guess) AS fp,
    count(*) FILTER (WHERE truth IS NOT NULL AND truth IS DISTINCT FROM guess) AS fn FROM gold GROUP BY 1)
  SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, annotated >= 50 AND round(tp / (tp + fp), 4) >= 0.75 AND round(tp / (tp + fn), 4) >= 0.7 AS passed FROM g""")
def ag34_score_fields(spark, d):
    return articles.quality_gate(articles.score_fields(gold(spark, d).withColumnRenamed("lang", "field")), 0.75, 0.7, 50)


@query(f"WITH {GOLD_SQL} SELECT lang, count(*) AS n, round(avg(CASE WHEN truth = guess THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM gold GROUP BY 1")
def ag35_accuracy_by(spark, d):
    return articles.accuracy_by(gold(spark, d), "lang", F.col("truth").eqNullSafe(F.col("guess")))


@query("""WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT *, sum(n) OVER () / (count(*) OVER () * n) AS r FROM g) SELECT lang, n, round(greatest(least(r / avg(r) OVER (), 5), 0.25), 4) AS weight FROM w""")
def ag36_class_weights(spark, d):
    return articles.class_weights(a.scan(spark, d, "documents", ["lang"]), "lang")


@query(f"WITH {RULES_SQL}, {ALIASES_SQL} SELECT label, string_agg(alias, ';' ORDER BY confidence DESC, alias) AS aliases, count(*) AS n_aliases FROM aliases WHERE confidence >= 0.45 GROUP BY 1")
def ag37_with_aliases(spark, d):
    return articles.with_aliases(a.rules(spark, d).select("label"), a.aliases(spark, d))


def _section(section: str, column: str, n: int) -> str:
    return f"(SELECT '{section}' AS section, row_number() OVER (ORDER BY cases DESC, name) AS rank, name, cases FROM (SELECT {column} AS name, CAST(sum(cases) AS BIGINT) AS cases FROM best GROUP BY 1) ORDER BY cases DESC, name LIMIT {n})"


@query(f"WITH {BEST_SQL}, u AS ({_section('sources', 'source_name', 8)} UNION ALL {_section('labels', 'label', 3)}) SELECT *, sha256(section || '|' || rank || '|' || name || '|' || cases) AS hash FROM u")
def ag38_compact_package(spark, d):
    return articles.compact_package(best(spark, d), {"sources": ("source_name", 8), "labels": ("label", 3)})


@query(f"""WITH {SOURCES_SQL}, {RUNS_SQL}, live AS (SELECT DISTINCT source_id FROM runs WHERE status = 'RUNNING' AND started_at >= {NOW_SQL} - INTERVAL 30 MINUTE), f AS (SELECT source_id, max(finished_at) AS last_finished FROM runs WHERE finished_at IS NOT NULL GROUP BY 1),
  j AS (SELECT s.source_id, name, CAST(greatest(s.source_id % 7 * 10, 15) AS INTEGER) AS minutes, last_finished FROM sources s LEFT JOIN f ON s.source_id = f.source_id WHERE s.source_id NOT IN (SELECT source_id FROM live))
  SELECT * FROM j WHERE last_finished IS NULL OR last_finished + to_minutes(minutes) <= {NOW_SQL} ORDER BY last_finished NULLS FIRST, source_id LIMIT 20""")
def ss1_due_sources(spark, d):
    return ops.due_sources(a.sources(spark, d), a.runs(spark, d), NOW, 20)


@query(f"""WITH {RUNS_SQL} SELECT run_id, CASE WHEN status = 'RUNNING' AND started_at < {NOW_SQL} - INTERVAL 30 MINUTE THEN 'FAILED' ELSE status END AS status,
  CASE WHEN status = 'RUNNING' AND started_at < {NOW_SQL} - INTERVAL 30 MINUTE THEN {NOW_SQL} ELSE finished_at END AS finished_at FROM runs""")
def ss6_close_stale(spark, d):
    return ops.close_stale(a.runs(spark, d), NOW).select("run_id", "status", "finished_at")


@query("""WITH f AS (SELECT event_id, CAST(event_id % 7 + 1 AS INTEGER) AS attempts FROM events WHERE event_type = 'error') SELECT event_id, attempts, CASE WHEN attempts >= 5 THEN 'dead' ELSE 'retry' END AS route,
  CAST(CASE WHEN attempts < 5 THEN least(3600, 30 * 2 ** (attempts - 1)) END AS BIGINT) AS delay FROM f""")
def ss7_retry_plan(spark, d):
    f = a.scan(spark, d, "events").where("event_type = 'error'").select("event_id", (F.col("event_id") % 7 + 1).cast("int").alias("attempts"))
    return ops.retry_plan(f)


@query("""SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 4 = 0)""")
def ss9_needs_analysis(spark, d):
    docs = a.scan(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return ops.needs_analysis(docs, docs.where("doc_id % 4 = 0").withColumn("version", F.lit("v1")), "v1").select("doc_id")


@query("""WITH x AS (SELECT doc_id, CAST('0x' || sha256(CAST(doc_id AS VARCHAR) || '|' || lang)[1:8] AS BIGINT) AS h FROM documents) SELECT doc_id, CASE WHEN h / 4294967295.0::DOUBLE < 0.8 THEN 'train' ELSE 'test' END AS part FROM x""")
def fn18_hash_split(spark, d):
    return a.scan(spark, d, "documents").select("doc_id", values.hash_split(F.col("doc_id").cast("string"), F.col("lang")).alias("part"))


@query(f"""WITH {SIGNALS_SQL} SELECT event_id, json_extract_string(payload, '$.k') AS field, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS n FROM signals""")
def fn21_json_field(spark, d):
    s = a.signals(spark, d)
    return s.select("event_id", values.json_field(F.col("payload"), ["cases", "K"]).alias("field"), values.json_count(F.col("payload"), ["k"]).alias("n"))


@query(f"WITH {URLS_SQL} SELECT page_id, collector AS url, sha256(collector) AS hash FROM urls")
def fn9_normalize_url(spark, d):
    u = F.col("url")
    return a.scan(spark, d, "pages", ["page_id", "url"]).select("page_id", text.normalize_url(u).alias("url"), text.url_hash(u).alias("hash"))


@query("""SELECT doc_id, CASE WHEN trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g')) <> '' THEN sha256(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) END AS hash FROM documents""")
def fn10_content_hash(spark, d):
    return a.scan(spark, d, "documents", ["doc_id", "text"]).select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("""SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS key, upper(regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g')) AS code FROM supplier""")
def fn11_alias_key(spark, d):
    return a.scan(spark, d, "supplier").select("s_suppkey", text.alias_key(F.col("s_name")).alias("key"), text.label_code(F.col("s_name")).alias("code"))


@query(f"""WITH {SOURCES_SQL} SELECT source_id, CAST(greatest(source_id % 7 * 10, 15) AS INTEGER) AS minutes FROM sources""")
def fn8_schedule(spark, d):
    return a.sources(spark, d).select("source_id", dates.schedule_minutes(F.col("schedule")).alias("minutes"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders""")
def fn5_parse_date(spark, d):
    t = F.concat(F.lit("Report of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" at noon"))
    url = F.concat(F.lit("https://x.org/"), F.date_format("o_orderdate", "yyyy/M/d"), F.lit("/a"))
    new = F.year("o_orderdate") >= 2000
    o = a.scan(spark, d, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select("o_orderkey", dates.parse_date_any(F.when(new & (F.col("o_orderkey") % 2 == 0), t).when(new, "none").otherwise(iso), url).alias("day"))


@query("""SELECT c_custkey, CAST(c_custkey * 1234 AS BIGINT) AS n FROM customer WHERE c_custkey > 0""")
def fn17_parse_count(spark, d):
    n = F.col("c_custkey") * 1234
    shown = F.when(F.col("c_custkey") % 2 == 0, F.format_number(n, 0)).otherwise(F.translate(F.format_number(n, 0), ",", "."))
    return a.scan(spark, d, "customer").where("c_custkey > 0").select("c_custkey", text.parse_count(shown).alias("n"))


@query(f"""WITH {FACTS_SQL} SELECT count(*) AS n, count(DISTINCT day) AS days FROM (SELECT unnest(generate_series(published_at, published_at + 13, INTERVAL 1 DAY)) AS day FROM facts WHERE alert AND {VALID_SQL})""")
def fn7_alert_range(spark, d):
    from vigilis.functions.predicates import valid_facts

    f = valid_facts(a.facts(spark, d), a.EXCLUDED_SOURCES).where("alert")
    return f.select(F.explode(dates.alert_range(F.col("published_at"))).alias("day")).agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"))


