"""Registered queries: operators applied to the canonical frames, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: CTEs ending in urls (page_id, collector, api, export): addresses of pages, normalised by each variant's rule.
URLS_SQL = r"""parts AS (SELECT page_id, split_part(url, '#', 1) AS u FROM pages),
  cut AS (SELECT page_id, lower(regexp_extract(u, '^(https?)://', 1)) || '://' || lower(regexp_extract(u, '^https?://([^/?]*)', 1)) AS site, regexp_extract(u, '^https?://[^/?]*([^?]*)', 1) AS path, regexp_extract(u, '\?(.*)$', 1) AS query FROM parts),
  kept AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND lower(x) NOT LIKE 'utm\_%' ESCAPE '\' AND lower(split_part(x, '=', 1)) NOT IN ('_ga', '_gl', 'dclid', 'fbclid', 'gclid', 'igshid', 'mc_cid', 'mc_eid', 'msclkid', 'yclid'))) AS ps FROM cut),
  urls AS (SELECT page_id, site || CASE WHEN path IN ('', '/') THEN '/' WHEN query <> '' THEN regexp_replace(path, '/+$', '') ELSE path END || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS collector,
    site || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS api,
    site || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END || CASE WHEN len(list_filter(ps, lambda x: split_part(x, '=', 1) NOT IN ('oc', 'ref', 'ref_src'))) > 0
      THEN '?' || array_to_string(list_filter(ps, lambda x: split_part(x, '=', 1) NOT IN ('oc', 'ref', 'ref_src')), '&') ELSE '' END AS export FROM kept)"""
