"""Aggregations over facts: cards, breakdowns, series, clusters, comparisons, padding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilis.functions import dates, predicates, values
from vigilis.functions.predicates import cases, deaths
from vigilis.operators.dedup import best_facts


def valid_window(facts: DataFrame, first: date, last: date, excluded: Sequence[str] = ("test",), labels: Sequence[str] | None = None, filter_stage: str = "before") -> DataFrame:
    """Valid facts, the best one of each article, dated ``first`` to ``last`` and of ``labels``.

    ``filter_stage``: where dates and labels are filtered. 'before' the choice of the best fact (KPI cards); 'label_after':
    dates before, labels after (heat map); 'after' both (overviews): there an article whose best fact lies outside is gone.
    """
    dated = F.col("published_at").between(F.lit(first), F.lit(last))
    named = F.col("label").isin(list(labels)) if labels else F.lit(True)
    df = predicates.valid_facts(facts, excluded)
    if filter_stage == "after":
        return best_facts(df).where(dated & named)
    if filter_stage == "label_after":
        return best_facts(df.where(dated)).where(named)
    return best_facts(df.where(dated & named))


def kpi_card(best: DataFrame, places: DataFrame, members: Sequence[str]) -> DataFrame:
    """One row: cases, deaths, events, distinct mapped places, alerts, and places there are."""
    card = best.agg(
        F.coalesce(F.sum(cases()), F.lit(0)).alias("cases"), F.coalesce(F.sum(deaths()), F.lit(0)).alias("deaths"), F.count("*").alias("events"),
        F.count_distinct(F.when(predicates.is_mappable(members), F.lower(F.trim("place")))).alias("mapped_places"), F.count_if("alert").alias("alerts"),
    )
    return card.crossJoin(F.broadcast(places.where("active").agg(F.count_distinct(F.lower("name")).alias("master_places"))))


def breakdown(best: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Cases, deaths and events by ``keys``, most cases first."""
    out = best.groupBy(*keys).agg(F.sum(cases()).alias("cases"), F.sum(deaths()).alias("deaths"), F.count("*").alias("events"))
    return out.orderBy(F.desc("cases"), *keys).limit(limit) if limit else out


def location_summary(facts: DataFrame) -> DataFrame:
    return facts.groupBy("place", "label").agg(
        F.sum("cases").alias("cases"), F.sum("deaths").alias("deaths"), F.round(F.max("confidence"), 4).alias("confidence"), F.bool_or("alert").alias("alert"),
        F.round(F.avg("lat"), 4).alias("lat"), F.round(F.avg("lon"), 4).alias("lon"),
    )


def source_key() -> Column:
    return F.coalesce(F.lower(F.trim("source_name")), F.col("url"), F.col("report_id").cast("string"), F.col("fact_id"))


def clusters(best: DataFrame, rules: DataFrame, as_of: date, limit: int | None = 250) -> DataFrame:
    """Place, label and country clusters with sums, the last 7 days and the 7 before, sources, threshold, severity and surge."""
    day = F.datediff(F.lit(as_of), "published_at")
    recent, before = day.between(0, 6), day.between(7, 13)
    order = F.struct(F.col("confidence"), F.col("created_at"), F.col("fact_id"))
    g = best.groupBy("place", "label", "country").agg(
        F.sum(cases()).alias("cases"), F.sum(deaths()).alias("deaths"), F.count("*").alias("events"), F.max("confidence").alias("confidence"), F.bool_or("alert").alias("alert"),
        F.sum(F.when(recent, cases()).otherwise(0)).alias("recent_cases"), F.sum(F.when(before, cases()).otherwise(0)).alias("previous_cases"),
        F.count_if(recent).alias("recent_events"), F.count_if(before).alias("previous_events"), F.count_distinct(source_key()).alias("sources"),
        F.array_join(F.sort_array(F.collect_set("source_name")), ";").alias("source_list"), F.max_by("fact_id", order).alias("first_fact"), F.min("lat").alias("lat"), F.min("lon").alias("lon"),
    )
    r = rules.select(F.lower("label").alias("__l"), "threshold")
    g = g.join(r, F.lower("label") == F.col("__l"), "left").drop("__l")
    g = g.withColumn("recent_cases", F.when(F.col("recent_events") == F.col("events"), F.col("cases")).otherwise(F.col("recent_cases")))
    flags = g.select(
        "place", "label", "country", "cases", "deaths", "events", "recent_cases", "previous_cases", "sources", "source_list", "first_fact", "threshold",
        predicates.severity_cluster().alias("severity"), predicates.surge(F.col("recent_events"), F.col("previous_events")).alias("surge"),
        predicates.hot(F.col("recent_events"), F.col("previous_events"), F.col("cases"), F.coalesce("threshold", F.lit(100))).alias("hot"),
    )
    return flags.orderBy(F.desc("cases"), "place", "label", "country").limit(limit) if limit else flags


def period_compare(best: DataFrame, as_of: date, end: date) -> DataFrame:
    """This month's metrics and the month before's. The anchor month is that of ``as_of`` if ``end`` is within 30 days of it, else ``end``'s."""
    anchor = (as_of if abs((as_of - end).days) <= 30 else end).replace(day=1)
    month = F.trunc("published_at", "month")
    out = []
    for name, m in (("current", F.lit(anchor)), ("previous", F.add_months(F.lit(anchor), -1))):
        own = month == m
        out += [
            F.sum(F.when(own, cases()).otherwise(0)).alias(f"{name}_cases"), F.sum(F.when(own, deaths()).otherwise(0)).alias(f"{name}_deaths"), F.count_if(own).alias(f"{name}_events"),
            F.count_if(own & F.col("alert")).alias(f"{name}_alerts"), F.count_distinct(F.when(own, F.col("place"))).alias(f"{name}_places"),
        ]
    card = best.agg(*out)
    return card.select("*", values.pct_change(F.col("current_cases"), F.col("previous_cases")).alias("cases_change"))


def spine(spark: SparkSession, name: str, members: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(m,) for m in members], f"{name} string")


def pad(df: DataFrame, key: str, members: Sequence[str], columns: Sequence[str], fill: int | None = 0) -> DataFrame:
    """Exactly one row for each member; what is missing is ``fill``."""
    out = spine(df.sparkSession, key, members).join(df, key, "left")
    return out.select(key, *[F.coalesce(c, F.lit(fill)).alias(c) if fill is not None else F.col(c) for c in columns])


def pad_nodata(df: DataFrame, key: str, members: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """As ``pad`` with nulls, and ``has_data``: missing is not zero."""
    marked = df.withColumn("__has", F.lit(True))
    out = spine(df.sparkSession, key, members).join(marked, key, "left")
    return out.select(key, *columns, F.coalesce("__has", F.lit(False)).alias("has_data"))


def matrix_pad(df: DataFrame, rows: str, key: str, members: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every row value with every member."""
    grid = df.select(rows).distinct().crossJoin(F.broadcast(spine(df.sparkSession, key, members)))
    out = grid.join(df.withColumn("__has", F.lit(True)), [rows, key], "left")
    return out.select(rows, key, *columns, F.coalesce("__has", F.lit(False)).alias("has_data"))


def matrix_to_members(matrix: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Sums by member of a padded matrix; a member without data stays null."""
    return matrix.groupBy(key).agg(*[F.sum(c).alias(c) for c in columns], F.bool_or("has_data").alias("has_data"))


def month_heatmap(best: DataFrame, key: str, members: Sequence[str], year: int) -> DataFrame:
    """Cases of each member in each month of ``year``, zero where there are none, and the member's total."""
    own = best.where(F.year("published_at") == year).groupBy(key, F.month("published_at").alias("month")).agg(F.sum(cases()).alias("cases"))
    grid = spine(best.sparkSession, key, members).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    out = grid.join(own, [key, "month"], "left").select(key, "month", F.coalesce("cases", F.lit(0)).alias("cases"))
    return out.withColumn("total", F.sum("cases").over(Window.partitionBy(key)))


def trend_overview(best: DataFrame) -> DataFrame:
    """For each label: sums, country of most cases, latest day, cases by country as text, priority band."""
    by = best.groupBy("label", "country").agg(F.sum(cases()).alias("cases"), F.sum(deaths()).alias("deaths"), F.max("published_at").alias("latest"), F.bool_or("alert").alias("alert"))
    g = by.groupBy("label").agg(
        F.sum("cases").alias("cases"), F.sum("deaths").alias("deaths"), F.max("latest").alias("latest"), F.bool_or("alert").alias("alert"),
        F.min_by("country", F.struct(-F.col("cases"), F.col("country"))).alias("top_country"),
        F.array_sort(F.collect_list(F.struct((-F.col("cases")).alias("k"), F.col("country").alias("c")))).alias("parts"),
    )
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["c"], F.lit(":"), (-p["k"]).cast("string"))), ";")
    return g.select("label", "cases", "deaths", "latest", "top_country", text.alias("by_country"), predicates.priority_band(F.col("cases"), F.col("alert")).alias("priority"))


def daily_families(facts: DataFrame, families: Mapping[str, str]) -> DataFrame:
    """Raw facts' cases by day, a column for each family of labels (pattern)."""
    floor = predicates.clamp("cases")
    return facts.groupBy(F.col("published_at").alias("day")).agg(*[F.sum(F.when(F.col("label").rlike(p), floor).otherwise(0)).alias(n) for n, p in families.items()])


def fatality_trend(facts: DataFrame) -> DataFrame:
    """Months of raw facts with fatality in per cent."""
    g = facts.groupBy(F.date_format("published_at", "yyyy-MM").alias("month")).agg(F.sum(predicates.clamp("cases")).alias("cases"), F.sum(predicates.clamp("deaths")).alias("deaths"))
    return g.withColumn("fatality", values.fatality(F.col("cases"), F.col("deaths")))


def fatality_by_label(best: DataFrame, limit: int = 12) -> DataFrame:
    g = best.groupBy("label").agg(F.sum(predicates.clamp("cases")).alias("cases"), F.sum(predicates.clamp("deaths")).alias("deaths"))
    return g.withColumn("fatality", values.fatality(F.col("cases"), F.col("deaths"))).orderBy(F.desc("cases"), "label").limit(limit)


def weekly_series(best: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    g = best.groupBy(*keys, dates.iso_week_label(F.col("published_at")).alias("iso_week"))
    return g.agg(F.sum(cases()).alias("cases"), F.sum(deaths()).alias("deaths"), F.count("*").alias("events"))


def combine_series(series: DataFrame, at: str = "iso_week") -> DataFrame:
    return series.groupBy(at).agg(F.sum("cases").alias("cases"), F.sum("deaths").alias("deaths"), F.sum("events").alias("events"))


def select_labels(df: DataFrame, selected: Sequence[str], label: str = "label") -> DataFrame:
    """Rows whose label has the same code as one of ``selected``, or contains it, or is contained in it."""
    code = F.regexp_replace(F.lower(label), "[^a-z0-9]", "")
    wanted = ["".join(ch for ch in s.lower() if ch.isalnum()) for s in selected]
    hit = F.lit(False)
    for w in wanted:
        hit = hit | F.contains(code, F.lit(w)) | F.contains(F.lit(w), code)
    return df.where(hit)


def overview(facts: DataFrame, limit: int = 10) -> DataFrame:
    """section, name, n: top labels and places, and all relevance, source and month values."""
    top = lambda c, s: facts.groupBy(F.col(c).cast("string").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(limit).select(F.lit(s).alias("section"), "name", "n")
    out = top("label", "label").unionByName(top("place", "place"))
    for c, s in (("is_relevant", "relevance"), ("source_type", "source"), ("needs_review", "review")):
        out = out.unionByName(facts.groupBy(F.col(c).cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(s).alias("section"), "name", "n"))
    return out


def share_within(df: DataFrame, group: str, key: str) -> DataFrame:
    """Counts of ``key`` and their per cent within ``group``."""
    g = df.groupBy(group, key).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(group)), 4))


def facets(facts: DataFrame) -> DataFrame:
    years = facts.select(F.lit("year").alias("facet"), F.year("published_at").cast("string").alias("value")).distinct()
    labels = facts.groupBy(F.lower("label")).agg(F.min("label").alias("value")).select(F.lit("label").alias("facet"), "value")
    return years.unionByName(labels)


def payload_summary(signals: DataFrame, names: Sequence[str]) -> DataFrame:
    """Totals by label over JSON payloads with candidate keys."""
    n = values.json_count(F.col("payload"), names)
    return signals.groupBy("label").agg(F.count("*").alias("reports"), F.count(n).alias("with_value"), F.sum(n).alias("total"), F.max(n).alias("most"))


def member_profile(best: DataFrame, members: Sequence[str]) -> DataFrame:
    """For each member: cases, deaths, fatality, leading label, worst alert level, status."""
    level = F.when(F.col("alert") & (F.col("cases") >= 40), 3).when(F.col("alert"), 2).when(F.col("cases") > 0, 1).otherwise(0)
    by = best.withColumn("__level", level).groupBy("country", "label").agg(F.sum(cases()).alias("cases"), F.sum(deaths()).alias("deaths"), F.max("__level").alias("level"))
    g = by.groupBy("country").agg(F.sum("cases").alias("cases"), F.sum("deaths").alias("deaths"), F.min_by("label", F.struct(-F.col("cases"), F.col("label"))).alias("leading_label"), F.max("level").alias("level"))
    out = spine(best.sparkSession, "country", members).join(g, "country", "left")
    status = F.when(F.col("cases").isNull(), "no data").when(F.col("level") >= 3, "alert").when(F.col("level") == 2, "watch").otherwise("normal")
    return out.select("country", "cases", "deaths", values.cfr(F.col("cases"), F.col("deaths")).alias("cfr"), "leading_label", "level", status.alias("status"))


def apportion(df: DataFrame, part: str, key: str, total: int) -> DataFrame:
    """Parts scaled to whole numbers that sum to ``total``; the remainder goes to the largest part."""
    whole = df.agg(F.sum(part).alias("__sum"))
    scaled = df.crossJoin(F.broadcast(whole)).withColumn("scaled", F.round(F.col(part) * F.lit(float(total)) / F.col("__sum")).cast("long"))
    rest = scaled.agg((F.lit(total) - F.sum("scaled")).alias("__rest"), F.min_by(key, F.struct(-F.col(part), F.col(key))).alias("__largest"))
    out = scaled.crossJoin(F.broadcast(rest))
    value = F.col("scaled") + F.when(F.col(key) == F.col("__largest"), F.col("__rest")).otherwise(0)
    return out.select(*df.columns, value.cast("long").alias("scaled"), F.round(F.col(part) * 100.0 / F.col("__sum"), 4).alias("share"))


def report_package(facts: DataFrame, places: DataFrame, members: Sequence[str], first: date, last: date, excluded: Sequence[str], selected: Sequence[str]) -> dict[str, DataFrame]:
    """The parts of a report over one window; cache ``facts`` to share its scan among them."""
    best = valid_window(facts, first, last, excluded)
    year = valid_window(facts, first.replace(month=1, day=1), last, excluded)
    labels = breakdown(best, ["label"])
    matrix = breakdown(best, ["label", "country"], None)
    return {
        "week_card": kpi_card(best, places, members), "year_card": kpi_card(year, places, members), "labels": labels, "selected": select_labels(labels, selected),
        "matrix": matrix_pad(matrix, "label", "country", members, ["cases", "deaths", "events"]), "weeks": weekly_series(best),
    }
