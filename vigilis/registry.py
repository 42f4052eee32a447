"""Every registered query by name, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilis.plans import QUERIES, SQL, kpi, scale, sources, streams, tables, texts  # noqa: F401


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return kpi.flagship_kpi_by_country(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
