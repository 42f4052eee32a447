"""Bounded samples of labelled rows, the same whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F


GROUPS = (256, 4, 1)


def first_by_hash(rows: DataFrame, most: int, within: str | None = None) -> DataFrame:
    """Of distinct ``rows`` (doc_id and another column) the first ``most`` ids in the order of a hash, for each value of ``within``.

    Ranked in many groups first, then in fewer among those that are left, so that the last step gets 4 x ``most`` rows of a value,
    whatever the input's size; Spark limits groups before the shuffle already, so a value that most rows have is no burden.
    """
    at, own = F.xxhash64("doc_id"), [within] if within else []
    out = rows.where("doc_id is not null")
    for n in GROUPS:
        order = Window.partitionBy(*own, *([F.pmod(F.xxhash64(at), F.lit(n))] if n > 1 else [])).orderBy(at, "doc_id")
        out = out.withColumn("__rank", F.dense_rank().over(order)).where(F.col("__rank") <= most).drop("__rank")
    return out.distinct()


def texts_of(docs: DataFrame, taken: DataFrame, *more: str) -> list[Row]:
    """Rows of ``taken`` (doc_id and another column; a bounded sample) with the text and columns ``more`` of ``docs`` (doc_id, text),
    one for each of ``taken`` that ``docs`` has: of repeated ids the row with the smallest text. Sorted by the columns of ``taken``."""
    key, group = taken.columns
    wanted = taken.select(F.col(key).alias("__id"), F.col(group).alias("__group"))
    own = F.min(F.struct(F.col("text"), *[F.col(c) for c in more])).alias("__own")
    got = docs.join(F.broadcast(wanted), F.col("doc_id") == F.col("__id")).groupBy("__id", "__group").agg(own)
    out = got.select(F.col("__id").alias(key), F.col("__group").alias(group), "__own.*").collect()
    return sorted(out, key=lambda r: (r[0], r[1]))
