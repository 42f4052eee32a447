"""Running sums and ranks over a whole table, in two levels: within ranges of the order, and over the ranges' totals.

A window without partitions takes all rows to one task. Here the order is cut into ranges of about equal numbers of rows; each
range has its own sums, and what comes before a range is added to them. A value that very many rows share is cut further by
the rows' ids. Only the bounds and the totals of ranges are gathered, and their number is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of the ranges' bounds: a bound's rank is off by less than a row in so many.
ACCURACY = 10_000


def _below(bounds: list, value: Column) -> Column:
    """How many of ``bounds`` (ascending) are below ``value``."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < value)) if bounds else F.lit(0)


def _cuts(n: int) -> list[float]:
    return [k / n for k in range(1, n)]


def ranged(df: DataFrame, order: str, ident: str, ranges: int, name: str) -> DataFrame:
    """``df`` with ``name``: (range of ``order``, range of ``ident`` within a value that fills a range by itself); both are numbers.

    Null orders come first, as a range of their own. The bounds are approximate, so ranges aren't quite equal; their order is exact.
    """
    if ranges < 2:
        return df.withColumn(name, F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    bounds = df.agg(F.percentile_approx(order, _cuts(ranges), ACCURACY)).first()[0] or []
    frequent = sorted({b for b in bounds if bounds.count(b) > 1})
    i = F.when(F.col(order).isNull(), -1).otherwise(_below(sorted(set(bounds)), F.col(order)))
    j = F.lit(0)
    if frequent:
        within = df.where(F.col(order).isin(frequent)).groupBy(order).agg(F.percentile_approx(ident, _cuts(ranges), ACCURACY)).collect()
        for value, own in within:
            j = F.when(F.col(order) == F.lit(value), _below(sorted(set(own or [])), F.col(ident))).otherwise(j)
    return df.withColumn(name, F.struct(i.alias("i"), j.alias("j")))


def running_sum(df: DataFrame, order: str, ident: str, value: Column, name: str, ranges: int = 200) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows up to and with this one, by ``order`` and then ``ident``.

    Both are numbers; equal pairs have no order among themselves. Null values count as 0; a null order comes first.
    """
    rows = ranged(df.withColumn("__value", F.coalesce(value, F.lit(0))), order, ident, ranges, "__range")
    # a value that fills ranges of its own has its rows apart from those of its range that are below it
    rows = rows.withColumn("__range", F.struct("__range.i", "__range.j"))
    totals = rows.groupBy("__range").agg(F.sum("__value").alias("__total"))
    # at most so many rows as there are ranges
    before = F.coalesce(F.sum("__total").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(F.col("__range").alias("__r"), before.alias("__before"))
    within = F.sum("__value").over(Window.partitionBy("__range").orderBy(F.asc_nulls_first(order), ident).rowsBetween(Window.unboundedPreceding, 0))
    summed = rows.withColumn("__within", within).join(F.broadcast(offsets), F.col("__range") == F.col("__r"))
    return summed.withColumn(name, F.col("__within") + F.col("__before")).drop("__value", "__range", "__r", "__before", "__within")


def ranks(df: DataFrame, order: str, ident: str, name: str = "rank", ranges: int = 200) -> DataFrame:
    """``df`` with ``name``: the number of rows before each, by ``order`` and then ``ident``."""
    return running_sum(df, order, ident, F.lit(1), name, ranges).withColumn(name, F.col(name) - 1)
