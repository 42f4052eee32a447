"""Rates, changes, splits, JSON and arrays, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct_change(now: Column, before: Column) -> Column:
    """Per cent with one decimal; from zero: 100 if there is anything now, else 0."""
    return F.when(before == 0, F.when(now == 0, 0.0).otherwise(100.0)).otherwise(F.round((now - before) * 100.0 / before, 1))


def cfr(cases: Column, deaths: Column) -> Column:
    """Case fatality in per cent with one decimal; null without cases."""
    return F.when(cases > 0, F.round(deaths * 1000.0 / cases) / 10)


def fatality(cases: Column, deaths: Column) -> Column:
    """The dashboards' form: two decimals, from 0 to 100, 0 without cases."""
    return F.when(cases > 0, F.greatest(F.least(F.round(deaths * 100.0 / cases, 2), F.lit(100.0)), F.lit(0.0))).otherwise(0.0)


def split_share(*key: Column) -> Column:
    """0 to 1 from the first eight hexadecimal digits of the key's SHA-256: the same wherever it is computed."""
    head = F.substring(F.sha2(F.concat_ws("|", *key), 256), 1, 8)
    return F.conv(head, 16, 10).cast("double") / float(0xFFFFFFFF)


def hash_split(*key: Column, ratio: float = 0.8) -> Column:
    return F.when(split_share(*key) < ratio, "train").otherwise("test")


def mean_valid(values: Column, least: float = -900.0) -> Column:
    """Mean of a map's values without nulls and sentinels below ``least``; null if none is left."""
    own = F.filter(F.map_values(values), lambda v: v.isNotNull() & (v >= least))
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, v: a + v) / F.size(own))


def json_field(payload: Column, names: Sequence[str]) -> Column:
    """The first of ``names`` in a flat JSON object, whatever the case and separators of its keys."""
    plain = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "")
    pairs = F.transform(F.map_entries(F.from_json(payload, "map<string,string>")), lambda e: F.struct(plain(e["key"]).alias("k"), e["value"].alias("v")))

    def hit(name: str) -> Column:
        own = "".join(ch for ch in name.lower() if ch.isalnum())
        return F.get(F.filter(pairs, lambda e: (e["k"] == own) & e["v"].isNotNull()), F.lit(0))["v"]

    return F.coalesce(*map(hit, names))


def json_count(payload: Column, names: Sequence[str]) -> Column:
    return json_field(payload, names).try_cast("double").cast("long")


def add_flag(flags: Column, flag: str) -> Column:
    """Once."""
    return F.array_union(F.coalesce(flags, F.array().cast("array<string>")), F.array(F.lit(flag)))


def union_labels(*lists: Column) -> Column:
    """Distinct labels in the order of their first place."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])))


def table_lines(cells: Column) -> Column:
    """A table's rows as lines of cells between bars."""
    return F.array_join(F.transform(cells, lambda r: F.array_join(F.transform(r, lambda x: F.trim(x)), " | ")), "\n")
