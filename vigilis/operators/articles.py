"""Ledgers of one row for each article, and totals over hierarchies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilis.functions.text import format_counts
from vigilis.operators.dedup import best_per_key


def drop_parents(facts: DataFrame) -> DataFrame:
    """Parent rows (no parent_id) go where their article has children. The facts keep the partitions that a join by report gave them."""
    kids = facts.where("parent_id is not null").select(F.col("parent_id").alias("__kid")).distinct()
    return facts.join(kids, F.col("report_id") == F.col("__kid"), "left").where("parent_id is not null or __kid is null").drop("__kid")


def text_by(rows: DataFrame, key: str, column: str, metric: str, name: str) -> DataFrame:
    """key, 'value(n); ...' by n descending, then value."""
    g = rows.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.sum(metric).alias("n"))
    return g.groupBy(key).agg(format_counts(F.collect_list(F.struct(F.col(column).alias("label"), "n"))).alias(name))


def collapse_articles(facts: DataFrame) -> DataFrame:
    """One row for each report: texts by country, place and label, leading label, sums, flags, worst class, most confident fact.

    All is built from sums by (report, value), so no report's facts are gathered, only its distinct values, and the facts are read
    once: every fact has one label or none, so the sums by label give the report's own.
    """
    rows = best_per_key(drop_parents(facts), ["report_id", "fact_id"], [F.desc_nulls_last("confidence"), F.desc("created_at")])
    worst = F.when(~F.col("is_relevant"), 2).when(F.col("needs_review"), 1).otherwise(0)
    texts = {"by_country": "country", "by_place": "place", "by_label": "label", "by_source": "source_name"}
    fact = F.struct("deaths", "alert", "needs_review", worst.alias("worst"), F.struct("confidence", "created_at", "fact_id").alias("lead"))
    # a kind's number, and the fact's other columns beside its label alone: these rows are sorted, four for each fact
    kinds = [F.struct(F.lit(i).alias("kind"), F.col(c).alias("value"), (fact if c == "label" else F.when(F.lit(False), fact)).alias("fact")) for i, c in enumerate(texts.values())]
    label = list(texts).index("by_label")
    pairs = rows.select("report_id", "cases", F.inline(F.array(*kinds))).where(f"value is not null or kind = {label}")
    sums = pairs.groupBy("report_id", "kind", "value").agg(
        F.sum("cases").alias("n"), F.count("*").alias("facts"), F.sum("fact.deaths").alias("deaths"), F.bool_or("fact.alert").alias("alert"), F.bool_or("fact.needs_review").alias("needs_review"),
        F.max("fact.worst").alias("worst"), F.max("fact.lead").alias("lead"),
    )
    own = lambda k, x: F.when((F.col("kind") == k) & F.col("value").isNotNull(), x)
    every = lambda x: F.when(F.col("kind") == label, F.col(x))
    parts = [format_counts(F.collect_list(own(i, F.struct(F.col("value").alias("label"), "n")))).alias(k) for i, k in enumerate(texts)]
    lead = F.min_by(own(label, F.col("value")), own(label, F.struct(-F.col("n"), F.col("value")))).alias("lead_label")
    out = sums.groupBy("report_id").agg(
        F.sum(every("facts")).alias("facts"), F.sum(every("n")).alias("cases"), F.sum("deaths").alias("deaths"), F.bool_or("alert").alias("alert"), F.bool_or("needs_review").alias("needs_review"),
        F.max("worst").alias("worst"), F.max("lead")["fact_id"].alias("lead_fact"), F.count(own(label, F.col("value"))).alias("labels"), *parts, lead,
    )
    return out.withColumn("worst", F.element_at(F.array(F.lit("surveillance"), F.lit("review"), F.lit("noise")), F.col("worst") + 1)).withColumn("shown_by", F.when(F.col("labels") > 1, "label").otherwise("place"))


def collapse_facts(facts: DataFrame) -> DataFrame:
    """The display variant: places win over labels where there is more than one of either; zeros are left out."""
    rows = drop_parents(facts)
    n = rows.groupBy("report_id").agg(F.count_distinct("place").alias("places"), F.count_distinct("label").alias("labels"))
    out = n.join(text_by(rows, "report_id", "place", "cases", "by_place"), "report_id", "left").join(text_by(rows, "report_id", "label", "cases", "by_label"), "report_id", "left")
    return out.select("report_id", F.when((F.col("places") > 1) | (F.col("labels") <= 1), F.col("by_place")).otherwise(F.col("by_label")).alias("display"))


def ledger_summary(rows: DataFrame) -> DataFrame:
    """By channel: rows, with and without coordinates, by quality class."""
    has = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return rows.groupBy("channel").agg(
        F.count("*").alias("rows"), F.count_if(has).alias("with_geo"), F.count_if(~has).alias("without_geo"),
        *[F.count_if(F.col("quality") == q).alias(q) for q in ("noise", "review", "surveillance")],
    )


def prefer_total(df: DataFrame, keys: Sequence[str], newest: str | None = None) -> DataFrame:
    """Sums by ``keys``: the country-level rows (is_total) where there are any, else the parts; only the newest period if asked for."""
    if newest:
        df = df.withColumn("__new", F.max(newest).over(Window.partitionBy(*keys))).where(F.col(newest) == F.col("__new"))
    g = df.groupBy(*keys).agg(F.bool_or("is_total").alias("__has"), F.max(F.when(F.col("is_total"), F.col("cases"))).alias("__total"), F.sum(F.when(~F.col("is_total"), F.col("cases"))).alias("__parts"))
    return g.select(*keys, F.when(F.col("__has"), F.col("__total")).otherwise(F.col("__parts")).alias("cases"), F.col("__has").alias("from_total"))


def fold_hierarchy(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Within ``keys``: the best national total (place is null), children with counts of their own that don't copy it, and their names."""
    total = df.where("place is null").groupBy(*keys).agg(F.max("cases").alias("total_cases"), F.max("deaths").alias("total_deaths"))
    kids = df.where("place is not null and (cases is not null or deaths is not null)")
    own = kids.join(total, list(keys), "left").where("total_cases is null or not (cases <=> total_cases and deaths <=> total_deaths)")
    g = own.groupBy(*keys).agg(F.sum("cases").alias("child_cases"), F.array_join(F.sort_array(F.collect_set("place")), ";").alias("children"))
    return df.select(*keys).distinct().join(total, list(keys), "left").join(g, list(keys), "left").select(*keys, F.coalesce("total_cases", "child_cases").alias("cases"), "children")


def merge_equivalent(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max("cases").alias("cases"), F.max("deaths").alias("deaths"), F.count("*").alias("merged"))


def indicator_dashboard(weeks: DataFrame, worst: int = 5) -> DataFrame:
    """By week: mean positivity, sites at each level, change to the week before, the ``worst`` lowest sites."""
    level = F.when(F.col("positivity") < 25, "low").when(F.col("positivity") < 35, "mid").otherwise("high")
    g = weeks.withColumn("level", level).groupBy("week").agg(
        F.round(F.avg("positivity"), 4).alias("positivity"), *[F.count_if(F.col("level") == x).alias(x) for x in ("low", "mid", "high")],
    )
    rank = F.row_number().over(Window.partitionBy("week").orderBy("positivity", "site"))
    bottom = weeks.withColumn("r", rank).where(f"r <= {worst}").groupBy("week").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "site"))), lambda x: x["site"]), ",").alias("bottom"))
    delta = F.round(F.col("positivity") - F.lag("positivity").over(Window.orderBy("week")), 4)  # one row for each week
    return g.withColumn("delta", delta).join(bottom, "week")


def custom_report(best: DataFrame, cadence: str, members: Sequence[str]) -> DataFrame:
    """By country: cases, share of periods covered, first and latest period's cases and their change (0 from zero)."""
    period = F.date_format(F.trunc("published_at", "month"), "yyyy-MM") if cadence == "month" else F.date_format(F.date_trunc("week", "published_at"), "yyyy-MM-dd")
    by = best.where(F.col("country").isin(list(members))).groupBy("country", period.alias("period")).agg(F.sum("cases").alias("cases"))
    g = by.groupBy("country").agg(F.sum("cases").alias("cases"), F.count("*").alias("periods"), F.min_by("cases", "period").alias("first"), F.max_by("cases", "period").alias("latest"))
    return g.withColumn("change", F.when(F.col("first") == 0, 0.0).otherwise(F.round((F.col("latest") - F.col("first")) * 100.0 / F.col("first"), 1)))


def region_rollup(best: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Victims and counts at all levels in one pass; deeper levels are null in totals."""
    g = best.rollup(*levels).agg(F.grouping_id().alias("level"), F.sum("cases").alias("cases"), F.sum("deaths").alias("deaths"), F.count("*").alias("events"))
    return g.select(*levels, F.col("level").cast("long").alias("level"), "cases", "deaths", "events")


def score_fields(pairs: DataFrame) -> DataFrame:
    """pairs: field, truth, guess. True and false positives, false negatives, precision and recall by field."""
    tp = F.count_if(F.col("truth").eqNullSafe(F.col("guess")) & F.col("truth").isNotNull())
    fp = F.count_if(F.col("guess").isNotNull() & ~F.col("truth").eqNullSafe(F.col("guess")))
    fn = F.count_if(F.col("truth").isNotNull() & ~F.col("truth").eqNullSafe(F.col("guess")))
    g = pairs.groupBy("field").agg(F.count("truth").alias("annotated"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    share = lambda a, b: F.when(a + b > 0, F.round(a / (a + b), 4))
    return g.withColumn("precision", share(F.col("tp"), F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("fn")))


def quality_gate(report: DataFrame, precision: float, recall: float, annotated: int) -> DataFrame:
    ok = (F.col("annotated") >= annotated) & (F.col("precision") >= precision) & (F.col("recall") >= recall)
    return report.withColumn("passed", F.coalesce(ok, F.lit(False)))


def accuracy_by(df: DataFrame, dim: str, right: Column) -> DataFrame:
    return df.groupBy(dim).agg(F.count("*").alias("n"), F.round(F.avg(right.cast("double")), 4).alias("accuracy"))


def class_weights(df: DataFrame, label: str, mode: str = "balanced") -> DataFrame:
    """Counts and weights: inverse counts (or their roots), divided by their mean, from 0.25 to 5."""
    g = df.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row for each label
    k = F.count("*").over(Window.partitionBy(F.lit(1)))
    raw = total / (k * F.col("n"))
    g = g.withColumn("__w", F.sqrt(raw) if mode == "sqrt" else raw)
    mean = F.avg("__w").over(Window.partitionBy(F.lit(1)))
    return g.select(label, "n", F.round(F.greatest(F.least(F.col("__w") / mean, F.lit(5.0)), F.lit(0.25)), 4).alias("weight"))


def with_aliases(concepts: DataFrame, aliases: DataFrame, least: float = 0.45) -> DataFrame:
    """Concepts with their aliases of at least ``least`` confidence, most confident first, and how many there are."""
    own = aliases.where(F.col("confidence") >= least).groupBy("label").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("k"), "alias"))).alias("a"))
    out = concepts.join(own, "label", "left")
    return out.select("label", F.array_join(F.transform(F.coalesce("a", F.array().cast(own.schema["a"].dataType)), lambda x: x["alias"]), ";").alias("aliases"), F.coalesce(F.array_size("a"), F.lit(0)).cast("long").alias("n_aliases"))


def compact_package(best: DataFrame, sections: dict[str, tuple[str, int]]) -> DataFrame:
    """section, rank, name, cases, hash: the top rows of each section and the hash of their JSON; other columns are dropped."""
    out = None
    for section, (column, n) in sections.items():
        g = best.groupBy(F.col(column).alias("name")).agg(F.sum("cases").alias("cases")).orderBy(F.desc("cases"), "name").limit(n)
        r = g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cases"), "name"))).select(F.lit(section).alias("section"), F.col("rank").cast("long").alias("rank"), "name", "cases")
        out = r if out is None else out.unionByName(r)
    return out.withColumn("hash", F.sha2(F.concat_ws("|", "section", "rank", "name", "cases"), 256))
