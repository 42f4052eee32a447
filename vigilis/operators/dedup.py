"""Windows and de-duplication: one row for each key, streaks, identities, lineage."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; give a total order for the same result each time."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def article_key() -> Column:
    """An article is known by its URL, else its report, else the fact itself."""
    return F.coalesce(F.when(F.col("url") != "", F.col("url")), F.col("report_id").cast("string"), F.col("fact_id"))


def best_facts(df: DataFrame) -> DataFrame:
    """The most confident, then newest fact of each article; the id breaks ties."""
    return best_per_key(df, [article_key()], [F.desc_nulls_last("confidence"), F.desc("created_at"), F.asc("fact_id")])


def first_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str], where: Column | None = None) -> DataFrame:
    """For each key, ``columns`` of the row that is largest by ``order``, of rows that satisfy ``where``."""
    value, rank = F.struct(*columns), F.struct(*order)
    if where is not None:
        value, rank = F.when(where, value), F.when(where, rank)
    return df.groupBy(*keys).agg(F.max_by(value, rank).alias("__v")).select(*keys, *[F.col(f"__v.{c}").alias(c) for c in columns])


def safe_rename(df: DataFrame, owner: str, new: str, taken: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first candidate of each (owner, new name) whose new name isn't ``taken`` (owner, name) already."""
    first = best_per_key(df, [owner, new], [F.asc(c) for c in order])
    t = taken.select(F.col(taken.columns[0]).alias("__o"), F.col(taken.columns[1]).alias("__n"))
    return first.join(t, (F.col(owner) == F.col("__o")) & (F.col(new) == F.col("__n")), "left_anti")


def backoff(runs: DataFrame, limit: int = 6) -> DataFrame:
    """Failures of each source since its last other run, at most ``limit``, and minutes to wait: 15, doubled with each, up to 360."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    ok = F.sum(F.when(F.col("status") != "FAILED", 1).otherwise(0)).over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = runs.withColumn("__n", F.row_number().over(newest)).withColumn("__ok", ok).where(f"__n <= {limit}")
    streak = F.sum(F.when(F.col("__ok") == 0, 1).otherwise(0)).cast("long")
    out = rows.groupBy("source_id").agg(streak.alias("streak"))
    return out.withColumn("wait_minutes", F.when(F.col("streak") > 0, F.least(F.lit(360), 15 * F.pow(F.lit(2), F.least(F.col("streak") - 1, F.lit(5))))).otherwise(0).cast("long"))


def cap_per_label(df: DataFrame, label: str, key: Column, first: Sequence[Column], n: int) -> DataFrame:
    """One row for each article, the preferred one, then at most ``n`` of each label in the same order."""
    one = best_per_key(df, [key], first)
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*first))
    return one.withColumn("__n", rank).where(f"__n <= {n}").drop("__n")


def first_seen(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return best_per_key(df, [key], order)


def delta_prev(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``delta``: the value less the one before."""
    return df.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def quantile_classes(df: DataFrame, value: str, k: int, ident: str) -> DataFrame:
    """``df`` with ``quantile_class``: the number of nearest-rank breaks (index floor(i n / k), i = 1 to k - 1) below the value.

    Ranks come from counts by value, so the rows themselves are never in one place.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    total = counts.agg(F.sum("__c").alias("__n"))
    upto = counts.withColumn("__to", F.sum("__c").over(Window.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    index = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.floor(i * F.col("__n") / k))
    breaks = upto.crossJoin(F.broadcast(total)).withColumn("__i", F.explode(index)).where("__i >= __to - __c and __i < __to")
    found = breaks.agg(F.sort_array(F.collect_list("__v")).alias("__breaks"))
    below = F.size(F.filter("__breaks", lambda b: b < F.col(value)))
    return df.crossJoin(F.broadcast(found)).withColumn("quantile_class", F.when(F.col(value).isNotNull(), below)).drop("__breaks")


def nearest_mention(mentions: DataFrame, anchors: DataFrame) -> DataFrame:
    """For each anchor (doc_id, sentence, pos, anchor) the closest mention in its sentence; before wins over after.

    The last mention before an anchor and the first after it come from one window; anchors never meet all mentions.
    """
    none = lambda t: F.lit(None).cast(t)
    one = mentions.groupBy("doc_id", "sentence", "pos").agg(F.min("mention").alias("mention"))
    one = one.select("doc_id", "sentence", "pos", F.struct(F.col("pos").alias("at"), F.col("mention").alias("mention")).alias("m"), none("string").alias("anchor"))
    own = anchors.select("doc_id", "sentence", "pos", none(one.schema["m"].dataType).alias("m"), F.col("anchor"))
    w = Window.partitionBy("doc_id", "sentence").orderBy("pos")
    before = F.last("m", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("m", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    both = own.unionByName(one).withColumn("b", before).withColumn("a", after).where("anchor is not null and (a is not null or b is not null)").distinct()
    nearer = F.col("a").isNull() | (F.col("pos") - F.col("b.at") <= F.col("a.at") - F.col("pos"))
    return both.select("doc_id", "sentence", "pos", "anchor", F.when(F.col("b").isNotNull() & nearer, F.col("b.mention")).otherwise(F.col("a.mention")).alias("mention"))


def drop_nested(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans (start, end, end exclusive) without those that lie in a longer one of the same document."""
    w = Window.partitionBy(key).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("__far", F.max("end").over(w)).where("__far is null or end > __far").drop("__far")


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to ``spark.checkpoint.dir``; where it is unset, to a temporary folder in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))


def star_components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root (smallest reachable) of links (a, b), by rounds of large and small stars; each round is checkpointed.

    Raises if ``rounds`` don't suffice; they grow with the logarithm of the longest path.
    """
    set_checkpoint_dir(links.sparkSession)
    e = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    seen = None
    for _ in range(rounds):
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        seen = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        e = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def identity_links(df: DataFrame, ident: str, keys: Sequence[str]) -> DataFrame:
    """a, b: each row's id and the smallest id with the same value of some key. Keys are (kind, value), never an OR of equalities."""
    set_checkpoint_dir(df.sparkSession)
    # keys may be hashes of whole texts: they are worked out once, for both sides of the join
    own = df.select(ident, *[F.col(k).cast("string").alias(f"__k{i}") for i, k in enumerate(keys)]).checkpoint()
    kinds = [F.struct(F.lit(i).alias("kind"), F.col(f"__k{i}").alias("value")) for i in range(len(keys))]
    pairs = own.select(ident, F.explode(F.array(*kinds)).alias("k")).where("k.value is not null and k.value <> ''")
    hub = pairs.groupBy("k").agg(F.min(ident).alias("b"))
    return pairs.join(hub, "k").select(F.col(ident).alias("a"), "b").distinct()


def dedup_identities(df: DataFrame, ident: str, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` with ``survivor``: rows that share any key, directly or through others, have one, the first in ``order``."""
    roots = star_components(identity_links(df, ident, keys).where("a <> b"))
    grouped = df.join(roots, F.col(ident) == F.col("node"), "left").withColumn("__root", F.coalesce("root", F.col(ident))).drop("node", "root")
    first = best_per_key(grouped, ["__root"], order).select(F.col("__root").alias("__r"), F.col(ident).alias("survivor"))
    return grouped.join(first, F.col("__root") == F.col("__r")).drop("__root", "__r")


def resolve_roots(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """node, root from edges (node, parent): pointers are doubled until they stay. Nodes of a cycle get its smallest node.

    Raises if ``rounds`` doublings don't suffice.
    """
    set_checkpoint_dir(edges.sparkSession)
    own = edges.where("parent is not null and node <> parent").groupBy("node").agg(F.min("parent").alias("up"))
    # least: smallest node on the way so far, which names a cycle
    state = own.withColumn("least", F.least("node", "up")).checkpoint()
    for _ in range(rounds):
        above = state.select(F.col("node").alias("__n"), F.col("up").alias("__up"), F.col("least").alias("__least"))
        step = state.join(above, F.col("up") == F.col("__n"), "left")
        new = step.select("node", F.coalesce("__up", "up").alias("up"), F.least("least", F.coalesce("__least", "least")).alias("least"), F.col("__n").isNotNull().alias("on")).checkpoint()
        going = new.where("on").select("up").distinct().join(own.select(F.col("node").alias("__x")), F.col("up") == F.col("__x")).limit(1).count()
        cyclic = new.where("on").join(own.select(F.col("node").alias("__x")), F.col("up") == F.col("__x"), "left_semi")
        if not going:
            return new.select("node", F.col("up").alias("root"))
        if cyclic.join(state.select(F.col("node").alias("__y"), F.col("least").alias("__l")), (F.col("node") == F.col("__y")) & (F.col("least") == F.col("__l")), "left_anti").limit(1).count() == 0:
            ends = new.join(own.select(F.col("node").alias("__x")), F.col("up") == F.col("__x"), "left")
            return ends.select("node", F.when(F.col("__x").isNull(), F.col("up")).otherwise(F.col("least")).alias("root"))
        state = new.drop("on")
    raise RuntimeError(f"no fixed point after {rounds} rounds")
