"""Run sessions with state and timers of their own: a run that doesn't end is closed as failed, once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class RunSessions(StatefulProcessor):
    """A run's state: its source, when it is due, and whether it has been closed. One timer closes it, a later one forgets it."""

    def __init__(self, minutes: int, forget_minutes: int):
        self.wait, self.forget = minutes * 60_000, forget_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "source_id long, due long, closed boolean")

    def _timer(self, at: int, before: int | None = None) -> None:
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = end = None  # the earliest row, and the latest that ends the run: of a key, two rows are held
        for r in rows:
            first = r if first is None or r.at < first.at else first
            if r.status != "RUNNING" and (end is None or r.at > end.at):
                end = r
        known = self.run.get() if self.run.exists() else None
        if known and known[2]:
            return
        now = timerValues.getCurrentWatermarkInMs()
        source = known[0] if known else first.source_id
        if end is not None:
            due = max(int(end.at.timestamp() * 1000), now) + self.forget
            self._timer(due, known[1] if known else None)
            self.run.update((source, due, True))
            yield Row(source_id=source, run_id=key[0], status=end.status)
        elif not known:
            due = max(int(first.at.timestamp() * 1000) + self.wait, now + 1)
            self._timer(due)
            self.run.update((source, due, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        source, due, closed = self.run.get()
        if closed:
            self.run.clear()
            return
        later = due + self.forget
        self._timer(later)
        self.run.update((source, later, True))
        yield Row(source_id=source, run_id=key[0], status="FAILED")

    def close(self) -> None:
        pass


def use_state_timers(spark: SparkSession) -> None:
    """State with timers needs the session's store of state to be RocksDB; queries that have begun keep theirs."""
    spark.conf.set(PROVIDER, ROCKS)


def run_sessions_stream(runs: DataFrame, minutes: int = 30, delay: str = "10 minutes", forget_minutes: int = 24 * 60) -> DataFrame:
    """source_id, run_id, status of every run that ends, or that is still running ``minutes`` after its start in event time (FAILED).

    runs: source_id, run_id, status, at. A run is closed once: what comes for it within ``forget_minutes`` after that is left out,
    whether a row was delivered again or an end came late. Rows without a run or a time are left out. Call ``use_state_timers`` first.
    """
    own = runs.where("run_id is not null and at is not null").withWatermark("at", delay)
    out = "source_id long, run_id long, status string"
    return own.groupBy("run_id").transformWithState(statefulProcessor=RunSessions(minutes, forget_minutes), outputStructType=out, outputMode="Append", timeMode="EventTime")
