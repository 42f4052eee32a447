"""Sinks: ledgers, training sets, KPI snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilis.functions.values import hash_split

#: The ledger's headers, in order, and the columns under them.
LEDGER = [
    ("No", "no"), ("Source Country", "source_country"), ("Surveillance Scope", "surveillance_scope"), ("Case Country", "country"), ("Language", "language"), ("Source URL", "url"),
    ("Article Title", "title"), ("Disease Name", "label"), ("Crawling Date", "created_at"), ("Region", "region"), ("Province / City Case", "province_city"), ("Article Date", "published_at"),
    ("Date Case", "date_case"), ("Number of Cases", "cases"), ("Number of Deaths", "deaths"), ("Latitude", "lat"), ("Longitude", "lon"), ("Source Type", "source_type"), ("Source Name", "source_name"),
    ("Evidence", "evidence"), ("Confidence", "confidence"), ("Processing Status", "status"), ("Event ID", "report_id"), ("Is Health Related", "is_health_related"), ("Event Type", "event_type"),
    ("Source Credibility", "source_credibility"), ("Credibility Label", "credibility_label"), ("Sentiment", "sentiment"), ("Relevance Score", "relevance_score"), ("Outbreak Alert", "alert"), ("Needs Review", "needs_review"),
]
#: Columns that are shown instead, where they have a value.
DISPLAY = {"cases": "cases_display", "deaths": "deaths_display", "lat": "geo_summary"}


def ledger_lines(df: DataFrame, most: int = 5000) -> DataFrame:
    """no, line: the newest ``most`` rows as lines of the ledger, all cells quoted; a column that ``df`` lacks is empty.

    A summary of places stands for both coordinates.
    """
    have = set(df.columns)
    text = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.coalesce(x, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    newest = [F.desc_nulls_last("published_at")] if "published_at" in have else []
    # at most ``most`` rows are numbered
    rows = df.orderBy(*newest, "report_id").limit(most).withColumn("no", F.row_number().over(Window.orderBy(*newest, "report_id")))

    def cell(c: str) -> Column:
        if c == "no":
            return F.col("no").cast("string")
        shown = F.nullif(text(DISPLAY[c]), F.lit("")) if c in DISPLAY else F.lit(None).cast("string")
        own = F.coalesce(shown, text(c))
        return F.when(F.coalesce(text("geo_summary"), F.lit("")) == "", own) if c == "lon" else own

    return rows.select("no", F.concat_ws(",", *[quoted(cell(c)) for _, c in LEDGER]).alias("line"))


def write_ledger_csv(df: DataFrame, path: str, most: int = 5000) -> None:
    """The newest ``most`` rows as one CSV file for spreadsheets: the ledger's headers, all cells quoted, a byte order mark first."""
    body = ledger_lines(df, most).orderBy("no").select(F.col("line").alias("value"))
    head = df.sparkSession.createDataFrame([("\ufeff" + ",".join(h for h, _ in LEDGER),)], "value string")
    # a file for people, bounded by ``most``: one task writes it in order
    head.unionByName(body).coalesce(1).write.mode("overwrite").text(path)


def export_training(df: DataFrame, path: str, label: str = "label", key: str = "id", ratio: float = 0.8) -> DataFrame:
    """JSON lines by part (train, test), dealt by a hash of the key, and a manifest: counts by part and label. Returns the manifest."""
    parts = df.withColumn("part", hash_split(F.col(key).cast("string"), ratio=ratio))
    parts.write.mode("overwrite").partitionBy("part").json(f"{path}/rows")
    manifest = parts.groupBy("part", label).agg(F.count("*").alias("n"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def filter_key(country: str | None, label: str | None, first, last) -> str:
    """The key of a KPI snapshot: its filters in lower case, 'all' where there is none."""
    return "|".join(str(x or "all").strip().lower() for x in (country, label, first, last))


def write_kpi_snapshot(kpis: DataFrame, path: str, key: str, at) -> None:
    """Replaces the snapshot of ``key`` alone (dynamic partition overwrite)."""
    out = kpis.withColumn("computed_at", F.lit(at)).withColumn("filter_key", F.lit(key))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("filter_key").parquet(path)
