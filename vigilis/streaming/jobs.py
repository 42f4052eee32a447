"""Structured Streaming jobs: ingest, de-duplication, continuous KPIs, surges, sessions, stale runs, replacement by report.

Every job has a batch twin in ``vigilis.operators`` or here; replayed from files with ``availableNow`` they give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilis.streaming.buckets import BucketedTable, bucketed_sink

MESSAGE = "report_id long, url string, text string, published_at timestamp, feed string"


def read_files(spark: SparkSession, path: str, schema: str, format: str = "parquet", files: int = 1) -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files).load(path)


def parse_messages(raw: DataFrame, year: int | None = None, detached: Sequence[str] = ("detached",)) -> DataFrame:
    """``raw`` (value: JSON) with the message's fields and ``reject``: malformed, detached, other_year, or null for good ones."""
    m = raw.withColumn("m", F.from_json("value", MESSAGE)).select("value", "m.*")
    broken = F.col("report_id").isNull() | F.col("published_at").isNull() | (F.length(F.trim(F.coalesce("text", F.lit("")))) == 0)
    reject = F.when(broken, "malformed").when(F.lower("feed").isin(list(detached)), "detached")
    return m.withColumn("reject", reject.when(F.year("published_at") != year, "other_year") if year else reject)


def ingest_stream(raw: DataFrame, year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Good messages, and rejects with their reason."""
    p = parse_messages(raw, year)
    return p.where("reject is null").drop("value", "reject"), p.where("reject is not null").select("value", "reject")


def dedup_stream(df: DataFrame, keys: Sequence[str], at: str, delay: str, history: DataFrame | None = None) -> DataFrame:
    """The first row of each key within the watermark, and none whose key is in ``history`` (a static table)."""
    fresh = df if history is None else df.join(history.select(*keys).distinct(), list(keys), "left_anti")
    return fresh.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else fresh.dropDuplicates(list(keys))


def kpi_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incremental sums; batch or stream (update mode)."""
    return df.groupBy(*keys).agg(F.sum("cases").alias("cases"), F.count("*").alias("events"))


def surge_windows(df: DataFrame, at: str = "published_at", size: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events and cases by label in sliding windows."""
    own = df.withWatermark(at, delay) if df.isStreaming else df
    g = own.groupBy(F.window(at, size, slide).alias("w"), "label").agg(F.count("*").alias("events"), F.sum("cases").alias("cases"))
    return g.select("label", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "cases")


def surges(windows: DataFrame, days: int = 7) -> DataFrame:
    """Windows joined with those ``days`` before: surge where events are at least two and half as many again, or new."""
    before = windows.select(F.col("label").alias("__l"), (F.col("start") + F.expr(f"INTERVAL {days} DAYS")).alias("__s"), F.col("events").alias("previous"))
    j = windows.join(before, (F.col("label") == F.col("__l")) & (F.col("start") == F.col("__s")), "left").withColumn("previous", F.coalesce("previous", F.lit(0)))
    return j.select("label", "start", "events", "previous", ((F.col("events") >= 2) & ((F.col("previous") == 0) | (2 * F.col("events") >= 3 * F.col("previous")))).alias("surge"))


def replace_by_report(target: DataFrame, batch: DataFrame, key: str = "report_id") -> DataFrame:
    """The target without the batch's reports, and the batch."""
    return target.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def replacing_sink(spark: SparkSession, path: str, key: str = "report_id", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch's reports replace the table's; only the buckets of their keys are rewritten (``BucketedTable``)."""
    return bucketed_sink(BucketedTable(spark, path, key, buckets), lambda old, new: replace_by_report(old, new, key))


def sessionize(df: DataFrame, key: str, at: str, gap_minutes: int = 30) -> DataFrame:
    """key, first, last, events of runs without a pause of ``gap_minutes``: batch, by the time since the event before."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp")) >= gap_minutes * 60_000_000, F.lit(True))
    n = F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__n", n).groupBy(key, "__n").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("events")).drop("__n")


def session_stream(df: DataFrame, key: str, at: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    own = df.withWatermark(at, delay) if df.isStreaming else df
    g = own.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.max(at).alias("last"), F.count("*").alias("events"))
    return g.select(key, F.col("w.start").alias("first"), "last", "events")


def stale_runs_stream(runs: DataFrame, minutes: int = 30, delay: str = "10 minutes") -> DataFrame:
    """source_id, run_id, status of runs that end, or that time out ``minutes`` after their start in event time.

    runs: source_id, run_id, status, at. A run's state is one row; a timer of its own closes it.
    """

    def close(key: tuple, pages: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield pd.DataFrame({"source_id": [state.get[0]], "run_id": [key[0]], "status": ["FAILED"]})
            state.remove()
            return
        rows = pd.concat(list(pages)).sort_values("at")
        ended = rows[rows["status"] != "RUNNING"]
        if len(ended):
            if state.exists:
                state.remove()
            yield pd.DataFrame({"source_id": [int(rows["source_id"].iloc[0])], "run_id": [key[0]], "status": [ended["status"].iloc[-1]]})
        elif not state.exists:
            state.update((int(rows["source_id"].iloc[0]),))
            due = int(rows["at"].iloc[0].timestamp() * 1000) + minutes * 60_000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    out = "source_id long, run_id long, status string"
    return runs.withWatermark("at", delay).groupBy("run_id").applyInPandasWithState(close, out, "source_id long", "append", "EventTimeTimeout")


def run_available(df: DataFrame, checkpoint: str, mode: str = "append", name: str | None = None, batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Runs a stream over what there is, to a memory table or a batch function, and waits."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(batch).start() if batch else w.format("memory").queryName(name).start()
    q.awaitTermination()


def hashed_examples(docs: DataFrame) -> DataFrame:
    """``docs`` as training examples with their hash, the highest confidence of each."""
    from vigilis.operators.training import capture_examples

    return capture_examples(docs)


def capture_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Examples of both with the highest confidence of each."""
    from vigilis.operators.training import capture_examples

    return capture_examples(new, old.select(*new.columns))


def capture_sink(spark: SparkSession, path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: training examples captured as facts come in; only the buckets of a batch's examples are rewritten."""
    write = bucketed_sink(BucketedTable(spark, path, "hash", buckets), capture_merge)
    return lambda batch, n: write(hashed_examples(batch), n)
