"""Operational logs: crawl statistics, source catalogue, health, status counts, due sources, retries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilis.functions.dates import schedule_minutes
from vigilis.operators.dedup import backoff
from vigilis.operators.lookup import latest_per_key


def crawl_stats(runs: DataFrame, sources: DataFrame, now: datetime) -> DataFrame:
    """By kind of source: runs, by status, in the last 30 days, items, distinct sources."""
    rows = runs.join(sources.select("source_id", "kind"), "source_id")
    recent = F.col("started_at") >= F.lit(now) - F.expr("INTERVAL 30 DAYS")
    return rows.groupBy("kind").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "SUCCESS").alias("succeeded"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(F.col("status") == "RUNNING").alias("running"), F.count_if(recent).alias("recent"), F.sum("items").alias("items"), F.count_distinct("source_id").alias("sources"),
    )


def source_summary(sources: DataFrame) -> DataFrame:
    """One row of filtered counts over the source catalogue (with credibility and channel)."""
    c = lambda test, name: F.count_if(test).alias(name)
    kinds = [c(F.col("kind") == k, k) for k in ("rss", "web", "api", "csv")]
    channels = [c(F.col("channel") == k, k) for k in ("official", "media", "social", "other")]
    high = [c(F.col("credibility") >= 0.7, "trusted"), c(F.col("credibility") < 0.4, "doubtful"), c(F.col("reason") == "override", "overridden")]
    return sources.agg(F.count("*").alias("total"), *kinds, *channels, *high, F.round(F.avg("credibility"), 4).alias("credibility"))


def ops_health(runs: DataFrame, now: datetime) -> DataFrame:
    """For each source: last run and status, runs and failures in the last day, failure streak and wait."""
    day = F.col("started_at") >= F.lit(now) - F.expr("INTERVAL 1 DAYS")
    past = runs.where(F.col("started_at") <= F.lit(now))
    last = latest_per_key(past, "source_id", ["started_at", "run_id"], ["run_id", "status", "started_at"])
    counts = past.groupBy("source_id").agg(F.count_if(day).alias("day_runs"), F.count_if(day & (F.col("status") == "FAILED")).alias("day_failures"))
    return last.join(counts, "source_id").join(backoff(past), "source_id")


def status_counts(df: DataFrame, status: str, values: list[str]) -> DataFrame:
    """One row, one column for each value: a single pass."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(v.lower()) for v in values])


def close_stale(runs: DataFrame, now: datetime, minutes: int = 30) -> DataFrame:
    """Runs still RUNNING after ``minutes`` become FAILED, ended now."""
    stale = (F.col("status") == "RUNNING") & (F.col("started_at") < F.lit(now) - F.expr(f"INTERVAL {minutes} MINUTES"))
    return runs.withColumn("finished_at", F.when(stale, F.lit(now)).otherwise(F.col("finished_at"))).withColumn("status", F.when(stale, "FAILED").otherwise(F.col("status")))


def due_sources(sources: DataFrame, runs: DataFrame, now: datetime, limit: int | None = None) -> DataFrame:
    """Sources whose last finished run is older than their interval and that have no live run; never run ones first."""
    live = runs.where((F.col("status") == "RUNNING") & (F.col("started_at") >= F.lit(now) - F.expr("INTERVAL 30 MINUTES"))).select("source_id").distinct()
    last = runs.where("finished_at is not null").groupBy("source_id").agg(F.max("finished_at").alias("last_finished"))
    wait = schedule_minutes(F.col("schedule"))
    rows = sources.join(live, "source_id", "left_anti").join(last, "source_id", "left")
    due = rows.where(F.col("last_finished").isNull() | (F.timestamp_seconds(F.unix_timestamp("last_finished") + wait * 60) <= F.lit(now)))
    out = due.select("source_id", "name", wait.alias("minutes"), "last_finished").orderBy(F.asc_nulls_first("last_finished"), "source_id")
    return out.limit(limit) if limit else out


def retry_plan(failures: DataFrame, base: int = 30, ceiling: int = 3600, most: int = 5) -> DataFrame:
    """Delay in seconds, doubled with each attempt up to ``ceiling``; after ``most`` attempts the dead letters."""
    delay = F.least(F.lit(ceiling), base * F.pow(F.lit(2), F.col("attempts") - 1)).cast("long")
    return failures.withColumn("route", F.when(F.col("attempts") >= most, "dead").otherwise("retry")).withColumn("delay", F.when(F.col("attempts") < most, delay))


def needs_analysis(reports: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Reports whose content hash hasn't been analysed by this pipeline version."""
    done = cache.where(F.col("version") == version).select("content_hash").distinct()
    return reports.join(done, "content_hash", "left_anti")
