"""Epidemiological weeks (MMWR, from Sunday), ISO weeks, and dates in text."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sunday_of(d: Column) -> Column:
    return F.date_sub(d, F.dayofweek(d) - 1)


def mmwr_year(d: Column) -> Column:
    """The year that has most of the week's days: that of its Wednesday."""
    return F.year(F.date_add(sunday_of(d), 3))


def mmwr_start(year: Column) -> Column:
    """First day (Sunday) of week 1: the week of January 4."""
    return sunday_of(F.make_date(year, F.lit(1), F.lit(4)))


def mmwr_week(d: Column) -> Column:
    return (F.floor(F.datediff(sunday_of(d), mmwr_start(mmwr_year(d))) / 7) + 1).cast("int")


def mmwr_weeks(year: Column) -> Column:
    """52 or 53."""
    return (F.datediff(mmwr_start(year + 1), mmwr_start(year)) / 7).cast("int")


def iso_week_label(d: Column) -> Column:
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), d).cast("int"), F.weekofyear(d))


def week_start(year: int, week: int) -> date:
    """First day of an MMWR week, for parameters."""
    fourth = date(year, 1, 4)
    return fourth - timedelta(days=(fourth.weekday() + 1) % 7) + timedelta(weeks=week - 1)


def resolve_window(as_of: date, first: tuple[int, int] | None = None, last: tuple[int, int] | None = None, weeks: int = 4) -> tuple[date, date]:
    """First and last day from (year, week) pairs; by default the ``weeks`` weeks up to that of ``as_of``."""
    sunday = as_of - timedelta(days=(as_of.weekday() + 1) % 7)
    start = week_start(*first) if first else sunday - timedelta(weeks=weeks - 1)
    end = week_start(*last) + timedelta(days=6) if last else sunday + timedelta(days=6)
    return (start, end) if start <= end else (end, start)


def mmwr_calendar(spark: SparkSession, years: list[int], counts: DataFrame, today: date) -> DataFrame:
    """All weeks of ``years`` with first and last day, state (past, current, future) and ``counts`` (year, week, n); no count is 0."""
    spine = spark.createDataFrame([(y,) for y in years], "year int").select("year", F.explode(F.sequence(F.lit(1), mmwr_weeks(F.col("year")))).alias("week"))
    spine = spine.withColumn("first_day", F.date_add(mmwr_start(F.col("year")), (F.col("week") - 1) * 7)).withColumn("last_day", F.date_add("first_day", 6))
    t = F.lit(today)
    state = F.when(F.col("last_day") < t, "past").when(F.col("first_day") > t, "future").otherwise("current")
    return spine.join(counts, ["year", "week"], "left").select("year", "week", "first_day", "last_day", state.alias("state"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def parse_date_any(text: Column, url: Column | None = None) -> Column:
    """An ISO date, else the first 20YY-MM-DD in the text, else /20YY/MM/DD/ in the URL; null if there is none."""
    found = [F.to_date(F.try_to_timestamp(F.trim(text))), F.to_date(F.try_to_timestamp(F.regexp_extract(text, r"(20\d\d-\d\d-\d\d)", 1), F.lit("yyyy-MM-dd")))]
    if url is not None:
        found.append(F.to_date(F.try_to_timestamp(F.regexp_replace(F.regexp_extract(url, r"/(20\d\d/\d\d?/\d\d?)(/|$)", 1), "/", "-"), F.lit("yyyy-M-d"))))
    return F.coalesce(*found)


def time_bucket(text: Column) -> Column:
    """Kind of period that a text reports on."""
    t = F.lower(text)
    rules = [("historical", r"\b(previous year|last year|historical)\b"), ("cumulative", r"\b(cumulative|total since|to date)\b"), ("weekly", r"\bweek(ly)?\b"), ("monthly", r"\bmonth(ly)?\b"), ("daily", r"\b(daily|today|24 hours)\b"), ("range", r"\bbetween\b.*\band\b")]
    out = None
    for name, words in rules:
        out = F.when(t.rlike(words), name) if out is None else out.when(t.rlike(words), name)
    return out.otherwise("unspecified")


def alert_range(d: Column, days: int = 14) -> Column:
    """The days of an alert, the first included."""
    return F.sequence(d, F.date_add(d, days - 1))


def schedule_minutes(schedule: Column) -> Column:
    """Minutes of 'interval:n', a day for 'daily:...', an hour otherwise; at least 15."""
    n = F.expr("1") * F.when(schedule.startswith("interval:"), F.regexp_extract(schedule, r"interval:(\d+)", 1).try_cast("int")).when(schedule.startswith("daily"), 1440)
    return F.greatest(F.coalesce(n, F.lit(60)), F.lit(15)).cast("int")
