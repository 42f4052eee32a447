"""Top-k, pages, feeds and set operations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilis.functions import predicates


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, n: int, size: int, order: Sequence[Column]) -> tuple[DataFrame, int, int]:
    """Page ``n`` (from 1), the number of rows and of pages. Sizes are 1 to 100; an empty result has one page."""
    size = max(1, min(100, size))
    total = df.count()
    pages = max(1, math.ceil(total / size))
    n = max(1, min(n, pages))
    return df.orderBy(*order).offset((n - 1) * size).limit(size), total, pages


def page_keys(df: DataFrame, key: str, at: str, n: int, size: int) -> DataFrame:
    """Rows of the keys on page ``n`` by their newest ``at``: keys are paged first, then a page of them (at most 100) is joined."""
    size = max(1, min(100, size))
    keys = df.groupBy(key).agg(F.max(at).alias("__at")).orderBy(F.desc("__at"), key).offset((n - 1) * size).limit(size)
    return df.join(F.broadcast(keys.select(key)), key, "left_semi")


def signal_feed(facts: DataFrame, rules: DataFrame, limit: int = 100) -> DataFrame:
    r = rules.select(F.lower("label").alias("__l"), "threshold")
    rows = facts.join(r, F.lower("label") == F.col("__l"), "left").withColumn("severity", predicates.severity_signal())
    rank = predicates.rank_of(F.col("severity"), predicates.SEVERITY_RANK)
    return rows.orderBy(F.desc("published_at"), rank.desc(), F.desc("cases"), "fact_id").limit(limit).select("fact_id", "label", "place", "published_at", "severity", "cases")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def ledger(matrix: DataFrame, events: DataFrame, key: str, order: Sequence[Column], channel: str | None = None) -> DataFrame:
    """Both branches with ``branch``; of a key that both have, the matrix rows win, then ``order``."""
    from vigilis.operators.dedup import first_seen

    both = matrix.withColumn("branch", F.lit(0)).unionByName(events.withColumn("branch", F.lit(1)))
    if channel:
        both = both.where(F.col("channel") == channel)
    return first_seen(both, key, [F.asc("branch"), *order])


def append_new(target: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``target`` and those of ``rows`` whose key isn't in it; of rows with one key, the smallest."""
    from vigilis.operators.dedup import best_per_key

    one = best_per_key(rows, list(key), [F.asc(c) for c in rows.columns])
    return target.unionByName(one.join(target.select(*key).distinct(), list(key), "left_anti"))


def upsert_by_key(target: DataFrame, updates: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """Target and updates by ``key`` (unique on both sides) with ``state``: new, changed (payload differs), same, kept."""
    hashed = lambda df: df.select(key, *payload, F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in payload]), 256).alias("h"))
    t, u = hashed(target).alias("t"), hashed(updates).alias("u")
    j = t.join(u, F.col(f"t.{key}") == F.col(f"u.{key}"), "full_outer")
    state = F.when(F.col("t.h").isNull(), "new").when(F.col("u.h").isNull(), "kept").when(F.col("t.h") != F.col("u.h"), "changed").otherwise("same")
    return j.select(F.coalesce(F.col(f"u.{key}"), F.col(f"t.{key}")).alias(key), *[F.when(F.col("u.h").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in payload], state.alias("state"))
