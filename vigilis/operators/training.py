"""Training-set selection, repair and re-analysis jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilis.functions.predicates import is_valid
from vigilis.functions.text import alias_key
from vigilis.functions.values import add_flag, hash_split
from vigilis.operators.dedup import best_per_key, resolve_roots


def capture_examples(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """hash, text columns and the highest confidence of each distinct (text, language, label, type); known examples are merged."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("text", "language", "label", "type")]), 256)
    new = docs.select(h.alias("hash"), "text", "language", "label", "type", "confidence")
    rows = new if known is None else new.unionByName(known)
    return best_per_key(rows, ["hash"], [F.desc_nulls_last("confidence")])


def select_training(df: DataFrame, least: float, labels: Sequence[str] | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """Confident rows that need no review, and all that a person has corrected; of ``labels``; not among ``blocked`` ids."""
    human = F.coalesce("human", F.lit(False))
    out = df.where(human | ((F.col("confidence") >= least) & ~F.coalesce("needs_review", F.lit(False))))
    if labels:
        out = out.where(F.col("label").isin(list(labels)))
    return out if blocked is None else out.join(blocked, "id", "left_anti")


def group_rare(df: DataFrame, label: str, least: int, ratio: float = 0.8, key: str = "id") -> DataFrame:
    """Labels of fewer than ``least`` rows become OTHER; every row is dealt anew to train or test."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    out = df.join(counts, label, "left").withColumn("grouped", F.when(F.col("__n") < least, "OTHER").otherwise(F.col(label)))
    return out.withColumn("part", hash_split(F.col(key).cast("string"), ratio=ratio)).drop("__n")


def cap_sample(df: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each label, those with the smallest hashes of their key."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.sha2(F.col(key).cast("string"), 256)))
    return df.withColumn("__n", rank).where(f"__n <= {most}").drop("__n")


def rebalance(df: DataFrame, label: str, key: str, target: int) -> DataFrame:
    """Exactly ``target`` rows of each label: the first by hash, again and again where there are fewer; ``copy`` counts the repeats."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.sha2(F.col(key).cast("string"), 256))) - 1
    rows = df.join(n, label).withColumn("__r", rank).where(F.col("__r") < target)
    copies = F.floor((F.lit(target) - 1 - F.col("__r")) / F.col("__n")).cast("int")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), copies))).drop("__n", "__r")


def review_manifest(gold: DataFrame, queue: DataFrame) -> DataFrame:
    """Gold rows and the annotation queue with their error tags; ``duplicate`` where an id occurs more than once."""
    both = gold.withColumn("origin", F.lit("gold")).unionByName(queue.withColumn("origin", F.lit("queue")))
    tags = F.filter(F.array(F.when(F.col("label").isNull(), "no_label"), F.when(F.length("text") < 50, "short"), F.when(F.col("language") == "unknown", "no_language")), lambda x: x.isNotNull())
    n = both.groupBy("id").agg((F.count("*") > 1).alias("duplicate"))
    return both.withColumn("tags", F.array_join(tags, ",")).join(n, "id")


def apply_corrections(facts: DataFrame, corrections: DataFrame, fields: Sequence[str], key: str = "fact_id") -> DataFrame:
    """The latest correction of each (fact, field) overrides the fact; ``human`` marks corrected rows."""
    last = best_per_key(corrections, [key, "field"], [F.desc("at"), F.desc("value")])
    wide = last.groupBy(key).pivot("field", list(fields)).agg(F.first("value")).select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    out = facts.join(wide, key, "left")
    changed = F.lit(False)
    for f in fields:
        changed = changed | F.col(f"__{f}").isNotNull()
    return out.select(*[F.coalesce(F.col(f"__{c}").cast(facts.schema[c].dataType), F.col(c)).alias(c) if c in fields else F.col(c) for c in facts.columns], changed.alias("human"))


def repair_facts(facts: DataFrame, places: DataFrame, label_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts with country filled in from their place, canonical labels, negatives demoted, and audit flags; and counts before and after."""
    p = places.select(F.lower("name").alias("__p"), F.col("country").alias("__c")).distinct()
    m = label_map.select(F.col("key").alias("__k"), F.col("label").alias("__l"))
    j = facts.join(p, F.lower("place") == F.col("__p"), "left").join(m, alias_key(F.col("label")) == F.col("__k"), "left")
    negative = F.upper("label").startswith("NEGATIVE") | (F.upper("label") == "UNKNOWN")
    none = F.array().cast("array<string>")
    flags = F.when(F.col("country").isNull() & F.col("__c").isNotNull(), add_flag(none, "country_filled")).otherwise(none)
    flags = F.when(F.col("__l").isNotNull() & (F.col("__l") != F.col("label")), add_flag(flags, "label_canonical")).otherwise(flags)
    flags = F.when(negative, add_flag(flags, "demoted")).otherwise(flags)
    fixed = {"country": F.coalesce("country", "__c"), "label": F.coalesce("__l", "label"), "is_relevant": F.col("is_relevant") & ~negative}
    out = j.select(*[fixed[c].alias(c) if c in fixed else F.col(c) for c in facts.columns], flags.alias("audit_flags"))
    count = lambda df, when: df.agg(F.lit(when).alias("stage"), F.count("*").alias("rows"), F.count_if(F.col("country").isNull()).alias("no_country"), F.count_if("is_relevant").alias("relevant"), F.count_distinct("label").alias("labels"))
    return out, count(facts, "before").unionByName(count(out, "after"))


def backfill_scope(facts: DataFrame, reports: DataFrame) -> DataFrame:
    """Scope and source country from the fact's report where they are missing or blank."""
    r = reports.select(F.col("report_id").alias("__r"), F.col("scope").alias("__scope"), F.col("source_country").alias("__sc"))
    own = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(other))
    return facts.join(r, F.col("report_id") == F.col("__r"), "left").withColumn("scope", own("scope", "__scope")).withColumn("source_country", own("source_country", "__sc")).drop("__r", "__scope", "__sc")


def apply_redirects(facts: DataFrame, redirects: DataFrame, column: str) -> DataFrame:
    """``column`` follows the redirects (node, parent) to their root."""
    roots = resolve_roots(redirects).select(F.col("node").alias("__n"), F.col("root").alias("__root"))
    return facts.join(roots, F.col(column) == F.col("__n"), "left").withColumn(column, F.coalesce("__root", column)).drop("__n", "__root")


def reanalyse(facts: DataFrame, snapshot, columns: dict[str, Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    """New columns for the facts of a frozen snapshot (created up to then), a page of them in id order if asked for."""
    rows = facts.where(F.col("created_at") <= F.lit(snapshot)).orderBy("fact_id")
    rows = rows.offset(offset) if offset else rows
    rows = rows.limit(limit) if limit else rows
    return rows.withColumns(columns)


def registry_audit(lexicon: DataFrame, sentinels: DataFrame) -> DataFrame:
    """kind, entries, and how many of the kind's sentinel aliases are in the lexicon; ``passed`` if all."""
    have = lexicon.groupBy("kind").agg(F.count("*").alias("entries"))
    found = sentinels.join(lexicon.select("kind", "alias").distinct().withColumn("__in", F.lit(1)), ["kind", "alias"], "left")
    s = found.groupBy("kind").agg(F.count("*").alias("sentinels"), F.count("__in").alias("found"))
    return have.join(s, "kind", "full").select("kind", F.coalesce("entries", F.lit(0)).cast("long").alias("entries"), F.coalesce("found", F.lit(0)).cast("long").alias("found"), (F.coalesce("sentinels", F.lit(0)) == F.coalesce("found", F.lit(0))).alias("passed"))


def ground_labels(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """``df`` (id, label, text) with ``grounded``: some alias of the label, of four letters at least, occurs in the text, letters and digits alone."""
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    a = aliases.select(F.col("label").alias("__l"), fold("alias").alias("__a")).where("length(__a) >= 4").groupBy("__l").agg(F.collect_set("__a").alias("__as"))
    j = df.join(a, F.col("label") == F.col("__l"), "left")
    hit = F.exists(F.coalesce("__as", F.array().cast("array<string>")), lambda x: F.contains(fold("text"), x))
    return j.select(*df.columns, hit.alias("grounded"))


def trainable() -> Column:
    return is_valid()
