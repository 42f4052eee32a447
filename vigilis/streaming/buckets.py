"""Sinks that keep a table up to date by key: a micro-batch rewrites only the buckets that it touches.

Keys are dealt to a fixed number of buckets by a hash. A batch reads the touched buckets, merges, and writes them as new folders;
then its commit, a small table of every bucket's current folder, makes them the table. A batch whose commit is there has
been done and is left alone; one that stopped before its commit has left folders that nobody reads, and writes them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame, DataFrame], DataFrame]
COMMIT = "bucket int, batch long"


class BucketedTable:
    """A table under ``path`` with its rows dealt to ``buckets`` by ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def committed(self, batch: int) -> bool:
        return self._exists(f"{self.path}/_commits/{batch}/_SUCCESS")

    def last_commit(self) -> int | None:
        """The newest batch that is done."""
        fs, at = self._fs(f"{self.path}/_commits")
        if not fs.exists(at):
            return None
        done = [int(s.getPath().getName()) for s in fs.listStatus(at) if self._exists(f"{s.getPath()}/_SUCCESS")]
        return max(done, default=None)

    def current(self) -> dict[int, int]:
        """bucket -> the batch that wrote its folder; at most ``buckets`` of them."""
        last = self.last_commit()
        return {} if last is None else {r.bucket: r.batch for r in self.spark.read.schema(COMMIT).json(f"{self.path}/_commits/{last}").collect()}

    def _folder(self, bucket: int, batch: int) -> str:
        return f"{self.path}/batch={batch}/bucket={bucket}"

    def read(self, only: set[int] | None = None) -> DataFrame | None:
        """The table, or its buckets ``only``; None where there is none yet."""
        folders = [self._folder(b, n) for b, n in sorted(self.current().items()) if only is None or b in only]
        return self.spark.read.parquet(*folders) if folders else None

    def write(self, batch: DataFrame, n: int, merge: Merge) -> set[int]:
        """Merges batch number ``n`` in; gives the buckets it has rewritten, none if it was done before."""
        if self.committed(n):
            return set()
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))
        touched = {r.bucket for r in dealt.select("bucket").distinct().collect()}  # at most the number of buckets
        if not touched:
            return touched
        old, now = self.read(touched), self.current()
        out = merge(old, batch) if old is not None else merge(batch.limit(0), batch)
        out = out.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={n}")
        # a bucket that the merge has emptied has no folder
        kept = {b: n for b in touched if self._exists(self._folder(b, n))} | {b: m for b, m in now.items() if b not in touched}
        self.spark.createDataFrame(sorted(kept.items()), COMMIT).coalesce(1).write.mode("overwrite").json(f"{self.path}/_commits/{n}")
        return touched

    def clean(self) -> int:
        """Deletes folders that the newest commit doesn't name, and older commits; gives how many folders."""
        last, now = self.last_commit(), set(self.current().items())
        fs, at = self._fs(self.path)
        gone = 0
        for s in fs.listStatus(at) if last is not None else []:
            name = s.getPath().getName()
            if not name.startswith("batch=") or int(name[6:]) > last:
                continue
            for b in fs.listStatus(s.getPath()):
                own = b.getPath().getName()
                if own.startswith("bucket=") and (int(own[7:]), int(name[6:])) not in now:
                    fs.delete(b.getPath(), True)
                    gone += 1
        for s in fs.listStatus(self._fs(f"{self.path}/_commits")[1]) if last is not None else []:
            if int(s.getPath().getName()) < last:
                fs.delete(s.getPath(), True)
        return gone


def bucketed_sink(table: BucketedTable, merge: Merge) -> Callable[[DataFrame, int], None]:
    """For foreachBatch."""

    def write(batch: DataFrame, n: int) -> None:
        kept = batch.persist()  # read for its buckets and for the merge
        try:
            table.write(kept, n, merge)
        finally:
            kept.unpersist()

    return write
