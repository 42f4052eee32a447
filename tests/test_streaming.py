"""Streams replayed from files give what their batch twins give."""

import pytest
from pyspark.sql import functions as F

from vigilis.streaming import jobs
from vigilis.streaming.buckets import BucketedTable

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "e")
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path


def stream(spark, path):
    return jobs.read_files(spark, path, SCHEMA, files=2)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_kpis(spark, events, tmp_path):
    cases = F.floor("value").cast("long")
    jobs.run_available(jobs.kpi_by(stream(spark, events).withColumn("cases", cases), ["event_type"]), str(tmp_path), "complete", "kpis")
    assert rows(spark.table("kpis")) == rows(jobs.kpi_by(spark.read.parquet(events).withColumn("cases", cases), ["event_type"]))


def test_dedup(spark, events, tmp_path):
    known = spark.read.parquet(events).where("event_id < 50").select("user_id", "event_type")
    jobs.run_available(jobs.dedup_stream(stream(spark, events), ["user_id", "event_type"], "ts", "60 days", known), str(tmp_path), "append", "deduped")
    batch = jobs.dedup_stream(spark.read.parquet(events), ["user_id", "event_type"], "ts", "60 days", known)
    assert rows(spark.table("deduped").select("user_id", "event_type")) == rows(batch.select("user_id", "event_type"))


def test_surge_windows(spark, events, tmp_path):
    shape = lambda df: df.select(F.col("event_type").alias("label"), F.col("ts").alias("published_at"), F.floor("value").cast("long").alias("cases"))
    jobs.run_available(jobs.surge_windows(shape(stream(spark, events)), delay="60 days"), str(tmp_path), "update", "windows")
    last = spark.table("windows").groupBy("label", "start", "end").agg(F.max("events").alias("events"), F.max("cases").alias("cases"))
    assert rows(last) == rows(jobs.surge_windows(shape(spark.read.parquet(events))))


def test_sessions(spark, events, tmp_path):
    jobs.run_available(jobs.session_stream(stream(spark, events), "user_id", "ts", delay="1 hour"), str(tmp_path), "append", "sessions")
    done, batch = rows(spark.table("sessions")), rows(jobs.sessionize(spark.read.parquet(events), "user_id", "ts").select("user_id", "first", "last", "events"))
    assert set(done) <= set(batch) and len(done) > 0.9 * len(batch)
    assert rows(jobs.session_stream(spark.read.parquet(events), "user_id", "ts")) == batch


def test_ingest(spark, tmp_path):
    lines = ['{"report_id":1,"text":"a","published_at":"2024-01-02T00:00:00Z","feed":"x"}', "{broken", '{"report_id":2,"text":"b","published_at":"2024-01-02T00:00:00Z","feed":"DETACHED"}', '{"report_id":3,"text":"c","published_at":"2020-01-02T00:00:00Z"}', '{"report_id":4,"text":" ","published_at":"2024-01-02T00:00:00Z"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(lines))
    good, bad = jobs.ingest_stream(spark.readStream.text(str(tmp_path / "in")), 2024)
    jobs.run_available(good, str(tmp_path / "g"), "append", "good")
    jobs.run_available(bad, str(tmp_path / "b"), "append", "bad")
    assert [r.report_id for r in spark.table("good").collect()] == [1]
    assert sorted(r.reject for r in spark.table("bad").collect()) == ["detached", "malformed", "malformed", "other_year"]


def test_replace_by_report(spark, events, tmp_path):
    out = str(tmp_path / "t")
    import os
    import pathlib

    parts = sorted(pathlib.Path(events).glob("part*"))
    for i, p in enumerate(parts):
        os.utime(p, (1_700_000_000 + 60 * i,) * 2)
    df = jobs.read_files(spark, events, SCHEMA, files=1).select("event_id", F.col("user_id").alias("report_id"))
    jobs.run_available(df, str(tmp_path / "c"), batch=jobs.replacing_sink(spark, out))
    have = rows(BucketedTable(spark, out, "report_id").read().select("event_id", "report_id"))
    target = None
    for p in parts:
        own = spark.read.parquet(str(p)).select("event_id", F.col("user_id").alias("report_id"))
        target = own if target is None else jobs.replace_by_report(target, own)
    assert have == rows(target.select("event_id", "report_id"))


def test_stale_runs_time_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "source_id long, run_id long, status string, at timestamp"
    first = [(1, 10, "RUNNING", "2024-01-01 00:00:00"), (1, 11, "RUNNING", "2024-01-01 00:05:00")]
    later = [(1, 11, "SUCCESS", "2024-01-01 00:15:00"), (2, 20, "RUNNING", "2024-01-01 09:00:00")]
    last = [(2, 20, "SUCCESS", "2024-01-01 09:01:00")]
    for i, own in enumerate((first, later, last)):
        spark.createDataFrame(own, "source_id long, run_id long, status string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / f"x{i}"))
        next((tmp_path / f"x{i}").glob("part*")).rename(tmp_path / "in" / f"{i}.parquet")
    jobs.run_available(jobs.stale_runs_stream(jobs.read_files(spark, str(tmp_path / "in"), schema)), str(tmp_path / "c"), "append", "stale")
    assert rows(spark.table("stale")) == [(1, 10, "FAILED"), (1, 11, "SUCCESS"), (2, 20, "SUCCESS")]


def test_run_sessions_close_once(spark, tmp_path):
    """A run is closed once, by its end or by its timer, over restarts from the checkpoint, repeated rows and ends that come late."""
    from vigilis.streaming import sessions

    old = spark.conf.get(sessions.PROVIDER)
    sessions.use_state_timers(spark)
    (tmp_path / "in").mkdir()
    schema = "source_id long, run_id long, status string, at timestamp"
    parts = [
        [(1, 10, "RUNNING", "2024-01-01 00:00:00"), (1, 11, "RUNNING", "2024-01-01 00:05:00"), (1, None, "RUNNING", "2024-01-01 00:05:00")],
        [(1, 11, "SUCCESS", "2024-01-01 00:15:00"), (2, 20, "RUNNING", "2024-01-01 09:00:00")],
        [(1, 10, "SUCCESS", "2024-01-01 09:05:00"), (2, 20, "SUCCESS", "2024-01-01 09:06:00"), (2, 20, "SUCCESS", "2024-01-01 09:06:00")],
        [(2, 20, "FAILED", "2024-01-01 09:20:00"), (3, 30, "FAILED", "2024-01-01 09:21:00")],
    ]
    out = []
    try:
        for i, own in enumerate(parts):  # the query is begun anew for each part
            spark.createDataFrame(own, "source_id long, run_id long, status string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / f"x{i}"))
            next((tmp_path / f"x{i}").glob("part*")).rename(tmp_path / "in" / f"{i}.parquet")
            df = sessions.run_sessions_stream(jobs.read_files(spark, str(tmp_path / "in"), schema))
            jobs.run_available(df, str(tmp_path / "c"), batch=lambda b, n: out.extend(map(tuple, b.collect())))
    finally:
        spark.conf.set(sessions.PROVIDER, old)
    assert sorted(out) == [(1, 10, "FAILED"), (1, 11, "SUCCESS"), (2, 20, "SUCCESS"), (3, 30, "FAILED")]
