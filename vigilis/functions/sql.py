"""The column library for SQL users: temporary SQL functions (no Python), views, and the one Python function that Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FUNCTIONS = {
    "mmwr_week": ("d DATE", "INT", "CAST(FLOOR(DATEDIFF(DATE_SUB(d, DAYOFWEEK(d) - 1), DATE_SUB(MAKE_DATE(YEAR(DATE_ADD(DATE_SUB(d, DAYOFWEEK(d) - 1), 3)), 1, 4), DAYOFWEEK(MAKE_DATE(YEAR(DATE_ADD(DATE_SUB(d, DAYOFWEEK(d) - 1), 3)), 1, 4)) - 1)) / 7) + 1 AS INT)"),
    "mmwr_year": ("d DATE", "INT", "YEAR(DATE_ADD(DATE_SUB(d, DAYOFWEEK(d) - 1), 3))"),
    "clamp_count": ("x BIGINT, cap BIGINT", "BIGINT", "GREATEST(LEAST(COALESCE(x, 0), cap), 0)"),
    "coverage_class": ("country STRING, members ARRAY<STRING>", "STRING", "CASE WHEN ARRAY_CONTAINS(members, country) THEN 'member' WHEN LOWER(country) IN ('global', 'world', 'international') THEN 'global' ELSE 'unclassified' END"),
    "cfr_percent": ("cases BIGINT, deaths BIGINT", "DOUBLE", "CASE WHEN cases > 0 THEN ROUND(deaths * 1000.0D / cases) / 10 END"),
    "alias_key": ("x STRING", "STRING", "TRIM(REGEXP_REPLACE(LOWER(x), '[^\\\\p{L}\\\\p{N}]+', ' '))"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Makes FUNCTIONS known to the session's SQL; returns their names."""
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)


def summary_view(facts: DataFrame, name: str = "disease_summary") -> None:
    """A temporary view of the place and label summary."""
    from vigilis.operators.kpi import location_summary

    location_summary(facts).createOrReplaceTempView(name)


def normalize_unicode(text: Column, form: str = "NFKC") -> Column:
    """Unicode normalisation, in Arrow batches: Spark has no function for it. Null stays null."""

    @F.pandas_udf("string")
    def run(s):
        import unicodedata

        return s.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return run(text)
