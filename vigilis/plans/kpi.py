"""Dashboard and report queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from vigilis.functions import dates, predicates, values
from vigilis.operators import kpi
from vigilis.plans import query
from vigilis.sources import adapters as a
from vigilis.sources.adapters import ALL_MEMBERS, BEST_SQL, CASES_SQL, DEATHS_SQL, EXCLUDED_SOURCES, FACTS_SQL, MEMBERS, PLACES_SQL, RULES_SQL, SIGNALS_SQL, VALID_SQL

FIRST, LAST = date(1996, 1, 1), date(1997, 12, 31)
AS_OF = date(1997, 12, 31)
SUMS = f"CAST(sum({CASES_SQL}) AS BIGINT) AS cases, CAST(sum({DEATHS_SQL}) AS BIGINT) AS deaths, count(*) AS events"
IN_MEMBERS = "country IN ('AFRICA', 'AMERICA', 'ASIA')"
SPINE = "(SELECT unnest(['AFRICA', 'AMERICA', 'ANTARCTICA', 'ASIA', 'EUROPE']) AS country)"


def best(spark, d):
    return kpi.valid_window(a.facts(spark, d), FIRST, LAST, EXCLUDED_SOURCES)


@query(f"WITH {FACTS_SQL} SELECT count(*) AS n, CAST(sum(cases) AS BIGINT) AS cases FROM facts WHERE {VALID_SQL}")
def fp1_valid_facts(spark, d):
    return predicates.valid_facts(a.facts(spark, d), EXCLUDED_SOURCES).agg(F.count("*").alias("n"), F.sum("cases").alias("cases"))


@query("""WITH x AS (SELECT l_linenumber AS k, CAST(l_quantity AS BIGINT) - 25 AS v FROM lineitem)
  SELECT k, CAST(sum(greatest(least(coalesce(v, 0), 10), 0)) AS BIGINT) AS capped, CAST(sum(greatest(coalesce(v, 0), 0)) AS BIGINT) AS floored FROM x GROUP BY k""")
def fp2_clamp(spark, d):
    x = a.scan(spark, d, "lineitem").select(F.col("l_linenumber").alias("k"), (F.col("l_quantity").cast("long") - 25).alias("v"))
    return x.groupBy("k").agg(F.sum(predicates.clamp("v", 0, 10)).alias("capped"), F.sum(predicates.clamp("v")).alias("floored"))


@query("""SELECT CASE lower(trim(r_name)) WHEN 'africa' THEN 'AF' WHEN 'asia' THEN 'AS' ELSE 'OUTSIDE' END AS folded,
  CASE lower(trim(r_name)) WHEN 'africa' THEN 'AF' WHEN 'asia' THEN 'AS' ELSE r_name END AS kept, count(*) AS n
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def fp3_fold_label(spark, d):
    places = a.scan(spark, d, "nation").join(F.broadcast(a.scan(spark, d, "region")), F.expr("n_regionkey = r_regionkey"))
    rows = a.scan(spark, d, "customer").join(F.broadcast(places), F.expr("c_nationkey = n_nationkey"))
    names = {"Africa": "AF", "Asia": "AS"}
    return rows.groupBy(predicates.fold_label(F.col("r_name"), names).alias("folded"), predicates.fold_label(F.col("r_name"), names, None).alias("kept")).agg(F.count("*").alias("n"))


@query(f"""WITH {FACTS_SQL} SELECT 'all' AS scope, count(*) AS n FROM facts UNION ALL SELECT 'members', count(*) FROM facts WHERE {IN_MEMBERS}
  UNION ALL SELECT 'outside', count(*) FROM facts WHERE NOT {IN_MEMBERS} UNION ALL SELECT 'asia', count(*) FROM facts WHERE country = 'ASIA'""")
def fp5_scope(spark, d):
    f = a.facts(spark, d)
    test = lambda s: F.count_if(predicates.in_scope(F.col("country"), s, MEMBERS))
    one = f.agg(test(None).alias("all"), test("MEMBERS").alias("members"), test("OUTSIDE").alias("outside"), test("ASIA").alias("asia"))
    return one.unpivot([], ["all", "members", "outside", "asia"], "scope", "n")


@query("""SELECT s_suppkey AS source_id, s_name AS name FROM supplier WHERE contains(lower(s_name), '00001') AND s_nationkey = 3""")
def fp6_search(spark, d):
    s = predicates.search(a.sources(spark, d), "00001", ["name"], nation_id=3, kind=None)
    return s.select("source_id", "name")


@query(f"""WITH {FACTS_SQL} SELECT CASE WHEN NOT coalesce(is_relevant, false) OR coalesce(confidence, 0) < 0.15 THEN 'noise'
  WHEN coalesce(needs_review, false) OR place IS NULL THEN 'review' ELSE 'surveillance' END AS quality, count(*) AS n FROM facts GROUP BY 1""")
def fp8_quality_class(spark, d):
    return a.facts(spark, d).groupBy(predicates.quality_class().alias("quality")).agg(F.count("*").alias("n"))


@query(f"""WITH {FACTS_SQL} SELECT label, count(*) FILTER (WHERE place IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND {IN_MEMBERS}) AS mappable,
  count(*) FILTER (WHERE place IS NOT NULL AND (lat IS NULL OR lon IS NULL)) AS unpinned FROM facts GROUP BY label""")
def fp12_mappable(spark, d):
    return a.facts(spark, d).groupBy("label").agg(F.count_if(predicates.is_mappable(MEMBERS)).alias("mappable"), F.count_if(predicates.geo_needs_review()).alias("unpinned"))


@query(f"""WITH {FACTS_SQL}, box AS (SELECT 'AFRICA' AS country, 0.0 AS south, 4.0 AS north, 100.0 AS west, 120.0 AS east UNION ALL SELECT 'ASIA', 2.0, 8.0, 110.0, 140.0)
  SELECT f.country, CASE WHEN lat IS NULL OR lon IS NULL THEN false WHEN b.country IS NULL THEN true ELSE lat BETWEEN south AND north AND lon BETWEEN west AND east END AS in_bbox,
  count(*) AS n FROM facts f LEFT JOIN box b ON f.country = b.country GROUP BY 1, 2""")
def fp13_bbox(spark, d):
    boxes = spark.createDataFrame([("AFRICA", 0.0, 4.0, 100.0, 120.0), ("ASIA", 2.0, 8.0, 110.0, 140.0)], "country string, south double, north double, west double, east double")
    return predicates.in_bbox(a.facts(spark, d), boxes).groupBy("country", "in_bbox").agg(F.count("*").alias("n"))


@query(f"""WITH {a.SOURCES_SQL} SELECT source_id, CASE WHEN contains(lower(url), '.gov') THEN 'official' WHEN contains(lower(url), 'news') THEN 'media'
  WHEN contains(lower(url), 'blog') OR kind IN ('csv', 'social') THEN 'social' ELSE 'other' END AS channel FROM sources""")
def fp14_channel(spark, d):
    return a.sources(spark, d).select("source_id", predicates.channel_of(F.col("url"), F.col("kind")).alias("channel"))


#: Domains of the test sources; the fixed list knows none of them.
DOMAINS = [(r"health\.gov\.", 0.95), (r"//news\.", 0.65), (r"//blog\.", 0.55)]
KIND_SQL = "CASE kind WHEN 'api' THEN 0.7 WHEN 'csv' THEN 0.6 WHEN 'rss' THEN 0.65 WHEN 'web' THEN 0.5 END::DOUBLE"


@query(f"""WITH {a.SOURCES_SQL}, b AS (SELECT *, {KIND_SQL} AS base, CASE split_part(split_part(url, '//', 2), '.', 1) WHEN 'health' THEN 0.95 WHEN 'news' THEN 0.65 WHEN 'blog' THEN 0.55 END::DOUBLE AS domain, source_id % 10 = 0 AS given FROM sources)
  SELECT source_id, CASE WHEN given THEN 0.99::DOUBLE ELSE greatest(base, domain) END AS credibility, CASE WHEN given THEN 'override' WHEN domain >= base THEN 'domain' ELSE 'heuristic' END AS reason FROM b""")
def fp15_credibility(spark, d):
    s = a.sources(spark, d)
    given = s.where("source_id % 10 = 0").select("source_id", F.lit(0.99).alias("credibility"))
    return predicates.source_credibility(s, given, DOMAINS).select("source_id", "credibility", "reason")


@query("""SELECT r_name AS country, CASE WHEN r_name IN ('AFRICA', 'AMERICA', 'ASIA') THEN 'member' WHEN lower(r_name) IN ('global', 'world', 'international') THEN 'global' ELSE 'unclassified' END AS coverage FROM region""")
def fp16_coverage(spark, d):
    return a.scan(spark, d, "region").select(F.col("r_name").alias("country"), predicates.coverage_class(F.col("r_name"), MEMBERS).alias("coverage"))


@query(f"""WITH {BEST_SQL}, {RULES_SQL} SELECT CASE WHEN NOT coalesce(confidence >= 0.35, false) THEN 'info' WHEN cases >= 2 * coalesce(threshold, 100) OR deaths > 0 THEN 'critical' WHEN cases >= coalesce(threshold, 100) OR alert THEN 'high' WHEN cases > 0 THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN cases >= 50000 OR alert THEN 'TINGGI' WHEN cases >= 500 THEN 'SEDANG' ELSE 'RENDAH' END AS priority, count(*) AS n
  FROM best LEFT JOIN rules ON lower(best.label) = lower(rules.label) GROUP BY 1, 2""")
def fp17_severity(spark, d):
    r = a.rules(spark, d).select(F.lower("label").alias("l"), "threshold")
    rows = best(spark, d).join(r, F.lower("label") == F.col("l"), "left")
    return rows.groupBy(predicates.severity_signal().alias("severity"), predicates.priority_band(F.col("cases"), F.col("alert")).alias("priority")).agg(F.count("*").alias("n"))


@query(f"""WITH {FACTS_SQL} SELECT array_to_string(list_filter([CASE WHEN deaths > cases THEN 'deaths_exceed_cases' END, CASE WHEN cases > 2000000 THEN 'extreme_count' END,
  CASE WHEN cases >= 10 AND deaths / cases > 0.5 THEN 'abnormal_fatality' END, CASE WHEN published_at < CAST(created_at - INTERVAL 12 MONTH AS DATE) THEN 'historical' END], lambda x: x IS NOT NULL), ',') AS flags,
  count(*) AS n FROM facts GROUP BY 1""")
def fp21_fact_flags(spark, d):
    return a.facts(spark, d).groupBy(F.array_join(predicates.fact_flags(), ",").alias("flags")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN l_quantity IS NULL THEN NULL WHEN l_quantity <= 10 THEN 'good' WHEN l_quantity <= 25 THEN 'fair' WHEN l_quantity <= 40 THEN 'poor' ELSE 'bad' END AS band, count(*) AS n FROM lineitem GROUP BY 1""")
def fp22_band(spark, d):
    x = a.scan(spark, d, "lineitem")
    return x.groupBy(predicates.band(F.col("l_quantity"), [10, 25, 40], ["good", "fair", "poor", "bad"]).alias("band")).agg(F.count("*").alias("n"))


@query(f"""WITH {FACTS_SQL} SELECT year(published_at) AS y, count(*) AS n FROM facts WHERE published_at >= DATE '1997-01-01' AND published_at < DATE '1998-01-01' GROUP BY 1""")
def fp23_admit_window(spark, d):
    return a.facts(spark, d).where("published_at >= '1997-01-01' and published_at < '1998-01-01'").groupBy(F.year("published_at").cast("long").alias("y")).agg(F.count("*").alias("n"))


@query(f"""WITH {FACTS_SQL} SELECT label, count(*) AS n FROM facts WHERE lower(label) NOT IN ('unknown', 'promo') GROUP BY label""")
def fp24_drop_generic(spark, d):
    return predicates.drop_generic(a.facts(spark, d), "label", ["unknown", "promo"]).groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN event_type LIKE '%error%' THEN 'alert' WHEN event_type LIKE '%signup%' THEN 'surveillance' WHEN event_type LIKE '%purchase%' THEN 'response' ELSE 'other' END AS category, count(*) AS n FROM events GROUP BY 1""")
def fp27_event_category(spark, d):
    return a.signals(spark, d).groupBy(predicates.event_category(F.col("label")).alias("category")).agg(F.count("*").alias("n"))


@query(f"""WITH {BEST_SQL}, {PLACES_SQL} SELECT CAST(coalesce(sum({CASES_SQL}), 0) AS BIGINT) AS cases, CAST(coalesce(sum({DEATHS_SQL}), 0) AS BIGINT) AS deaths, count(*) AS events,
  count(DISTINCT CASE WHEN place IS NOT NULL AND lat IS NOT NULL AND {IN_MEMBERS} THEN lower(trim(place)) END) AS mapped_places, count(*) FILTER (WHERE alert) AS alerts,
  (SELECT count(DISTINCT lower(name)) FROM places WHERE active) AS master_places FROM best""")
def ag1_kpi_card(spark, d):
    return kpi.kpi_card(best(spark, d), a.places(spark, d), MEMBERS)


@query(f"WITH {BEST_SQL} SELECT label, {SUMS} FROM best GROUP BY label ORDER BY cases DESC, label LIMIT 25")
def ag2_by_label(spark, d):
    return kpi.breakdown(best(spark, d), ["label"], 25)


@query(f"WITH {BEST_SQL} SELECT label, country, {SUMS} FROM best GROUP BY label, country ORDER BY cases DESC, label, country LIMIT 400")
def ag2_matrix(spark, d):
    return kpi.breakdown(best(spark, d), ["label", "country"], 400)


@query(f"WITH {BEST_SQL} SELECT source_name, {SUMS} FROM best GROUP BY source_name ORDER BY cases DESC, source_name LIMIT 20")
def ag2_sources(spark, d):
    return kpi.breakdown(best(spark, d), ["source_name"], 20)


@query(f"""WITH {FACTS_SQL} SELECT place, label, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(deaths) AS BIGINT) AS deaths, round(max(confidence), 4) AS confidence,
  bool_or(alert) AS alert, round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon FROM facts GROUP BY place, label""")
def ag3_location_summary(spark, d):
    return kpi.location_summary(a.facts(spark, d))


CLUSTERS_SQL = f"""WITH {BEST_SQL}, {RULES_SQL}, g AS (SELECT place, label, country, sum({CASES_SQL}) AS cases, sum({DEATHS_SQL}) AS deaths, count(*) AS events,
    max(confidence) AS confidence, bool_or(alert) AS alert, sum(CASE WHEN published_at BETWEEN DATE '1997-12-25' AND DATE '1997-12-31' THEN {CASES_SQL} ELSE 0 END) AS rc,
    sum(CASE WHEN published_at BETWEEN DATE '1997-12-18' AND DATE '1997-12-24' THEN {CASES_SQL} ELSE 0 END) AS previous_cases,
    count(*) FILTER (WHERE published_at BETWEEN DATE '1997-12-25' AND DATE '1997-12-31') AS re, count(*) FILTER (WHERE published_at BETWEEN DATE '1997-12-18' AND DATE '1997-12-24') AS pe,
    count(DISTINCT coalesce(lower(trim(source_name)), url, CAST(report_id AS VARCHAR), fact_id)) AS sources, array_to_string(list_sort(list(DISTINCT source_name)), ';') AS source_list,
    (list(fact_id ORDER BY confidence DESC, created_at DESC, fact_id DESC))[1] AS first_fact, min(lat) AS lat, min(lon) AS lon FROM best GROUP BY place, label, country),
  j AS (SELECT g.*, threshold, coalesce(threshold, 100) AS t FROM g LEFT JOIN rules ON lower(g.label) = lower(rules.label))
  SELECT place, label, country, CAST(cases AS BIGINT) AS cases, CAST(deaths AS BIGINT) AS deaths, events, CAST(CASE WHEN re = events THEN cases ELSE rc END AS BIGINT) AS recent_cases,
    CAST(previous_cases AS BIGINT) AS previous_cases, sources, source_list, first_fact, threshold,
    CASE WHEN NOT coalesce(alert AND confidence >= 0.35 AND trim(place) <> '' AND lat IS NOT NULL AND lon IS NOT NULL, false) THEN 'info' WHEN cases >= 2 * t OR deaths > 0 THEN 'critical' ELSE 'high' END AS severity,
    re >= 2 AND (pe = 0 OR 2 * re >= 3 * pe) AS surge, re > 0 AND ((re >= 2 AND (pe = 0 OR 2 * re >= 3 * pe)) OR cases >= 2 * t) AS hot
  FROM j ORDER BY cases DESC, place, label, country LIMIT 250"""


@query(CLUSTERS_SQL)
def ag4_clusters(spark, d):
    return kpi.clusters(best(spark, d), a.rules(spark, d), AS_OF)


def _period(name: str, first: str, last: str) -> str:
    inside = f"published_at BETWEEN DATE '{first}' AND DATE '{last}'"
    return (
        f"CAST(sum(CASE WHEN {inside} THEN {CASES_SQL} ELSE 0 END) AS BIGINT) AS {name}_cases, CAST(sum(CASE WHEN {inside} THEN {DEATHS_SQL} ELSE 0 END) AS BIGINT) AS {name}_deaths, "
        f"count(*) FILTER (WHERE {inside}) AS {name}_events, count(*) FILTER (WHERE {inside} AND alert) AS {name}_alerts, count(DISTINCT CASE WHEN {inside} THEN place END) AS {name}_places"
    )


@query(f"""WITH {BEST_SQL}, c AS (SELECT {_period('current', '1997-12-01', '1997-12-31')}, {_period('previous', '1997-11-01', '1997-11-30')} FROM best)
  SELECT *, CASE WHEN previous_cases = 0 THEN CASE WHEN current_cases = 0 THEN 0.0 ELSE 100.0 END ELSE round((current_cases - previous_cases) * 100.0 / previous_cases, 1) END::DOUBLE AS cases_change FROM c""")
def ag5_period_compare(spark, d):
    return kpi.period_compare(best(spark, d), AS_OF, LAST)


@query(f"""WITH {BEST_SQL}, own AS (SELECT country, month(published_at) AS m, sum({CASES_SQL}) AS cases FROM best WHERE year(published_at) = 1997 GROUP BY 1, 2),
  grid AS (SELECT country, m FROM {SPINE}, (SELECT unnest(range(1, 13)) AS m)), x AS (SELECT grid.country, CAST(grid.m AS INTEGER) AS month, CAST(coalesce(cases, 0) AS BIGINT) AS cases FROM grid LEFT JOIN own ON grid.country = own.country AND grid.m = own.m)
  SELECT *, CAST(sum(cases) OVER (PARTITION BY country) AS BIGINT) AS total FROM x""")
def ag7_month_heatmap(spark, d):
    return kpi.month_heatmap(best(spark, d), "country", ALL_MEMBERS, 1997)


@query(f"""WITH {BEST_SQL}, b AS (SELECT label, country, sum({CASES_SQL}) AS cases, sum({DEATHS_SQL}) AS deaths, max(published_at) AS latest, bool_or(alert) AS alert FROM best GROUP BY 1, 2)
  SELECT label, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(deaths) AS BIGINT) AS deaths, max(latest) AS latest, (list(country ORDER BY cases DESC, country))[1] AS top_country,
    string_agg(country || ':' || CAST(cases AS BIGINT), ';' ORDER BY cases DESC, country) AS by_country,
    CASE WHEN sum(cases) >= 50000 OR bool_or(alert) THEN 'TINGGI' WHEN sum(cases) >= 500 THEN 'SEDANG' ELSE 'RENDAH' END AS priority FROM b GROUP BY label""")
def ag8_trend_overview(spark, d):
    return kpi.trend_overview(best(spark, d))


@query(f"""WITH {FACTS_SQL} SELECT published_at AS day, CAST(sum(CASE WHEN label IN ('SMALL', 'STANDARD') THEN greatest(coalesce(cases, 0), 0) ELSE 0 END) AS BIGINT) AS s_family,
  CAST(sum(CASE WHEN label LIKE 'ECON%' THEN greatest(coalesce(cases, 0), 0) ELSE 0 END) AS BIGINT) AS economy FROM facts GROUP BY 1""")
def ag9_daily_families(spark, d):
    return kpi.daily_families(a.facts(spark, d), {"s_family": "^S", "economy": "^ECON"})


FATALITY = "CASE WHEN cases > 0 THEN greatest(least(round(deaths * 100.0 / cases, 2), 100), 0) ELSE 0 END::DOUBLE AS fatality"


@query(f"""WITH {FACTS_SQL}, g AS (SELECT strftime(published_at, '%Y-%m') AS month, CAST(sum(greatest(coalesce(cases, 0), 0)) AS BIGINT) AS cases, CAST(sum(greatest(coalesce(deaths, 0), 0)) AS BIGINT) AS deaths FROM facts GROUP BY 1)
  SELECT *, {FATALITY} FROM g""")
def ag10_fatality_trend(spark, d):
    return kpi.fatality_trend(a.facts(spark, d))


@query(f"""WITH {FACTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY {a.KEY_SQL} ORDER BY confidence DESC NULLS LAST, created_at DESC, fact_id) AS rn FROM facts WHERE {VALID_SQL}),
  g AS (SELECT label, CAST(sum(greatest(coalesce(cases, 0), 0)) AS BIGINT) AS cases, CAST(sum(greatest(coalesce(deaths, 0), 0)) AS BIGINT) AS deaths FROM r WHERE rn = 1 AND published_at BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 1)
  SELECT *, {FATALITY} FROM g ORDER BY cases DESC, label LIMIT 12""")
def ag10_fatality_by_label(spark, d):
    return kpi.fatality_by_label(kpi.valid_window(a.facts(spark, d), FIRST, LAST, EXCLUDED_SOURCES, filter_stage="after"))


@query(f"""WITH {BEST_SQL}, g AS (SELECT country, sum({CASES_SQL}) AS c, sum({DEATHS_SQL}) AS x FROM best GROUP BY 1) SELECT country, CASE WHEN c > 0 THEN round(x * 1000.0 / c) / 10 END AS cfr FROM g""")
def ag11_cfr(spark, d):
    g = kpi.breakdown(best(spark, d), ["country"])
    return g.select("country", values.cfr(F.col("cases"), F.col("deaths")).alias("cfr"))


@query(f"WITH {BEST_SQL} SELECT country, strftime(published_at, '%G-W%V') AS iso_week, {SUMS} FROM best GROUP BY 1, 2")
def ag12_weekly_series(spark, d):
    return kpi.weekly_series(best(spark, d), ["country"])


@query(f"WITH {BEST_SQL} SELECT strftime(published_at, '%G-W%V') AS iso_week, {SUMS} FROM best GROUP BY 1")
def ag13_combine_series(spark, d):
    return kpi.combine_series(kpi.weekly_series(best(spark, d), ["label"]))


@query(f"""WITH {BEST_SQL}, g AS (SELECT country, {SUMS} FROM best GROUP BY 1) SELECT s.country, coalesce(cases, 0) AS cases, coalesce(deaths, 0) AS deaths, coalesce(events, 0) AS events FROM {SPINE} s LEFT JOIN g ON s.country = g.country""")
def ag14_pad(spark, d):
    return kpi.pad(kpi.breakdown(best(spark, d), ["country"]), "country", ALL_MEMBERS, ["cases", "deaths", "events"])


@query(f"""WITH {BEST_SQL}, g AS (SELECT label, country, {SUMS} FROM best GROUP BY 1, 2), grid AS (SELECT label, country FROM (SELECT DISTINCT label FROM g), {SPINE})
  SELECT grid.label, grid.country, cases, deaths, events IS NOT NULL AS has_data FROM grid LEFT JOIN g ON grid.label = g.label AND grid.country = g.country""")
def ag15_matrix_pad(spark, d):
    return kpi.matrix_pad(kpi.breakdown(best(spark, d), ["label", "country"]), "label", "country", ALL_MEMBERS, ["cases", "deaths"])


@query(f"""WITH {BEST_SQL}, g AS (SELECT country, {SUMS} FROM best GROUP BY 1) SELECT s.country, cases, events IS NOT NULL AS has_data FROM {SPINE} s LEFT JOIN g ON s.country = g.country""")
def ag15_matrix_to_members(spark, d):
    matrix = kpi.matrix_pad(kpi.breakdown(best(spark, d), ["label", "country"]), "label", "country", ALL_MEMBERS, ["cases"])
    return kpi.matrix_to_members(matrix, "country", ["cases"])


@query(f"WITH {BEST_SQL} SELECT label, {SUMS} FROM best WHERE label IN ('SMALL', 'STANDARD') GROUP BY 1")
def ag16_select_labels(spark, d):
    return kpi.select_labels(kpi.breakdown(best(spark, d), ["label"]), ["small-size", "STAND"])


def _top(c: str, s: str) -> str:
    return f"(SELECT '{s}' AS section, {c} AS name, count(*) AS n FROM facts GROUP BY 2 ORDER BY n DESC, name LIMIT 10)"


def _all(c: str, s: str) -> str:
    return f"SELECT '{s}', CAST({c} AS VARCHAR), count(*) FROM facts GROUP BY 2"


@query(f"WITH {FACTS_SQL} {_top('label', 'label')} UNION ALL {_top('place', 'place')} UNION ALL {_all('is_relevant', 'relevance')} UNION ALL {_all('source_type', 'source')} UNION ALL {_all('needs_review', 'review')}")
def ag17_overview(spark, d):
    return kpi.overview(a.facts(spark, d))


@query("""SELECT lang, source, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY lang), 4) AS share FROM documents GROUP BY lang, source""")
def ag20_share_within(spark, d):
    return kpi.share_within(a.scan(spark, d, "documents", ["lang", "source"]), "lang", "source")


@query(f"WITH {FACTS_SQL} SELECT DISTINCT 'year' AS facet, CAST(year(published_at) AS VARCHAR) AS value FROM facts UNION ALL SELECT 'label', min(label) FROM facts GROUP BY lower(label)")
def ag26_facets(spark, d):
    return kpi.facets(a.facts(spark, d))


@query(f"""WITH {SIGNALS_SQL}, v AS (SELECT label, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS n FROM signals)
  SELECT label, count(*) AS reports, count(n) AS with_value, CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM v GROUP BY 1""")
def ag27_payload_summary(spark, d):
    return kpi.payload_summary(a.signals(spark, d), ["cases", "K"])


@query(f"""WITH {BEST_SQL}, b AS (SELECT country, label, sum({CASES_SQL}) AS cases, sum({DEATHS_SQL}) AS deaths, max(CASE WHEN alert AND cases >= 40 THEN 3 WHEN alert THEN 2 WHEN cases > 0 THEN 1 ELSE 0 END) AS level FROM best GROUP BY 1, 2),
  g AS (SELECT country, sum(cases) AS c, sum(deaths) AS x, (list(label ORDER BY cases DESC, label))[1] AS leading_label, max(level) AS level FROM b GROUP BY 1)
  SELECT s.country, CAST(c AS BIGINT) AS cases, CAST(x AS BIGINT) AS deaths, CASE WHEN c > 0 THEN round(x * 1000.0 / c) / 10 END AS cfr, leading_label, level,
    CASE WHEN c IS NULL THEN 'no data' WHEN level >= 3 THEN 'alert' WHEN level = 2 THEN 'watch' ELSE 'normal' END AS status FROM {SPINE} s LEFT JOIN g ON s.country = g.country""")
def ag39_member_profile(spark, d):
    return kpi.member_profile(best(spark, d), ALL_MEMBERS)


@query(f"""WITH {BEST_SQL}, g AS (SELECT label, sum({CASES_SQL}) AS cases FROM best GROUP BY 1), s AS (SELECT *, sum(cases) OVER () AS t, CAST(round(cases * 1000.0 / sum(cases) OVER ()) AS BIGINT) AS q, row_number() OVER (ORDER BY cases DESC, label) AS rn FROM g)
  SELECT label, CAST(cases AS BIGINT) AS cases, CAST(q + CASE WHEN rn = 1 THEN 1000 - sum(q) OVER () ELSE 0 END AS BIGINT) AS scaled, round(cases * 100.0 / t, 4) AS share FROM s""")
def ag40_apportion(spark, d):
    return kpi.apportion(kpi.breakdown(best(spark, d), ["label"]).select("label", "cases"), "cases", "label", 1000)


@query(f"WITH {BEST_SQL} SELECT label, {SUMS} FROM best WHERE label IN ('SMALL') GROUP BY 1")
def ag41_report_package(spark, d):
    return kpi.report_package(a.facts(spark, d), a.places(spark, d), MEMBERS, FIRST, LAST, EXCLUDED_SOURCES, ["small"])["selected"]


@query("""WITH x AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem), s AS (SELECT d, d - CAST(dayofweek(d) AS INTEGER) AS sun FROM x),
  y AS (SELECT d, sun, year(sun + 3) AS y FROM s), z AS (SELECT d, sun, y, make_date(y, 1, 4) - CAST(dayofweek(make_date(y, 1, 4)) AS INTEGER) AS w1, make_date(y + 1, 1, 4) - CAST(dayofweek(make_date(y + 1, 1, 4)) AS INTEGER) AS w2 FROM y)
  SELECT d AS day, CAST(y AS INTEGER) AS mmwr_year, CAST((sun - w1) // 7 + 1 AS INTEGER) AS mmwr_week, CAST((w2 - w1) // 7 AS INTEGER) AS weeks, strftime(d, '%G-W%V') AS iso FROM z""")
def fn1_mmwr(spark, d):
    x = a.scan(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    y = dates.mmwr_year(F.col("day"))
    return x.select("day", y.cast("int").alias("mmwr_year"), dates.mmwr_week(F.col("day")).alias("mmwr_week"), dates.mmwr_weeks(y).alias("weeks"), dates.iso_week_label(F.col("day")).alias("iso"))


@query("""WITH x AS (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem), s AS (SELECT d - CAST(dayofweek(d) AS INTEGER) AS sun, count(*) AS n FROM x GROUP BY 1),
  w AS (SELECT CAST(sun AS DATE) AS first_day FROM (SELECT unnest(generate_series(DATE '1995-12-31', DATE '1997-12-28', INTERVAL 7 DAY)) AS sun)),
  y AS (SELECT first_day, year(first_day + 3) AS y FROM w)
  SELECT CAST(y AS INTEGER) AS year, CAST((first_day - (make_date(y, 1, 4) - CAST(dayofweek(make_date(y, 1, 4)) AS INTEGER))) // 7 + 1 AS INTEGER) AS week, first_day, first_day + 6 AS last_day,
    CASE WHEN first_day + 6 < DATE '1997-06-15' THEN 'past' WHEN first_day > DATE '1997-06-15' THEN 'future' ELSE 'current' END AS state, coalesce(n, 0) AS n
  FROM y LEFT JOIN s ON s.sun = first_day WHERE y IN (1996, 1997)""")
def fn2_calendar(spark, d):
    day = F.to_date("l_shipdate")
    counts = a.scan(spark, d, "lineitem").groupBy(dates.mmwr_year(day).alias("year"), dates.mmwr_week(day).alias("week")).agg(F.count("*").alias("n"))
    return dates.mmwr_calendar(spark, [1996, 1997], counts, date(1997, 6, 15))



@query(f"""WITH {FACTS_SQL}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {a.KEY_SQL} ORDER BY confidence DESC NULLS LAST, created_at DESC, fact_id) AS rn
    FROM facts WHERE {VALID_SQL} AND published_at BETWEEN DATE '1996-12-29' AND DATE '1997-12-27') WHERE rn = 1), g AS (SELECT country, {SUMS} FROM best GROUP BY 1)
  SELECT s.country, coalesce(cases, 0) AS cases, coalesce(deaths, 0) AS deaths, coalesce(events, 0) AS events FROM {SPINE} s LEFT JOIN g ON s.country = g.country ORDER BY cases DESC, country""")
def flagship_kpi_by_country(spark, d):
    """KPI breakdown by member over all MMWR weeks of 1997."""
    first, last = dates.resolve_window(AS_OF, (1997, 1), (1997, 52))
    rows = kpi.valid_window(a.facts(spark, d), first, last, EXCLUDED_SOURCES)
    return kpi.pad(kpi.breakdown(rows, ["country"]), "country", ALL_MEMBERS, ["cases", "deaths", "events"]).orderBy(F.desc("cases"), "country")
