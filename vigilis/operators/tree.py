"""Administrative trees: every place as an interval, so that "lies in" is a comparison of numbers.

A walk over the tree numbers each place when it comes to it (``first``) and knows the last number below it (``last``). A place
lies in another if its number is between the other's two. Numbers follow from the sizes of subtrees, which are summed from
the leaves up, and from what comes before a place among its siblings, handed down from the roots; both by joins of a level with the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilis.operators.dedup import set_checkpoint_dir
from vigilis.operators.prefix import running_sum

#: Names of a tree's levels from the roots down.
LEVELS = ("country", "admin1", "admin2", "place")


def with_levels(places: DataFrame, most: int) -> DataFrame:
    """``places`` (place_id, parent_id, name) with ``level`` and ``path`` (names from the root down); those under no root are left out.

    Raises if the tree is deeper than ``most`` levels, as a cycle's never ends.
    """
    set_checkpoint_dir(places.sparkSession)
    level = places.where("parent_id is null").select("place_id", "parent_id", F.lit(0).alias("level"), F.array("name").alias("path"))
    out = level = level.checkpoint()
    for n in range(1, most + 1):
        up = level.select(F.col("place_id").alias("__p"), F.col("path").alias("__path"))
        level = places.join(up, F.col("parent_id") == F.col("__p")).select("place_id", "parent_id", F.lit(n).alias("level"), F.concat("__path", F.array("name")).alias("path")).checkpoint()
        if level.isEmpty():
            return out
        if n == most:
            raise ValueError(f"more than {most} levels")
        out = out.unionByName(level)
    return out


def admin_tree(places: DataFrame, most: int = 8) -> DataFrame:
    """place_id, parent_id, level, first, last, and the names of the ancestors by level (country, admin1, admin2; null below the place's own).

    ``places``: place_id (long), parent_id (null for a root), name. Repeated ids aren't allowed; places under no root are left out; an
    empty table gives no rows.
    """
    rows = with_levels(places, most)
    depth = rows.agg(F.max("level")).first()[0]
    if depth is None:
        return _named(rows.withColumns({"first": F.lit(0).cast("long"), "last": F.lit(0).cast("long")}))
    sized = {depth: rows.where(F.col("level") == depth).withColumn("size", F.lit(1).cast("long"))}
    for n in range(depth - 1, -1, -1):
        below = sized[n + 1].groupBy(F.col("parent_id").alias("__p")).agg(F.sum("size").alias("__s"))
        own = rows.where(F.col("level") == n).join(below, F.col("place_id") == F.col("__p"), "left")
        sized[n] = own.withColumn("size", F.coalesce("__s", F.lit(0)) + 1).drop("__p", "__s").checkpoint()
    roots = running_sum(sized[0], "place_id", "place_id", F.col("size"), "__end")
    done = level = roots.withColumn("first", F.col("__end") - F.col("size")).drop("__end").checkpoint()
    for n in range(1, depth + 1):
        up = level.select(F.col("place_id").alias("__p"), F.col("first").alias("__first"))
        before = F.sum("size").over(Window.partitionBy("parent_id").orderBy("place_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        level = sized[n].withColumn("__before", before).join(up, F.col("parent_id") == F.col("__p")).withColumn("first", F.col("__first") + 1 + F.col("__before"))
        level = level.drop("__p", "__first", "__before").checkpoint()
        done = done.unionByName(level)
    return _named(done.withColumn("last", F.col("first") + F.col("size") - 1))


def _named(rows: DataFrame) -> DataFrame:
    names = [F.when(F.col("level") >= k, F.get("path", F.lit(k))).alias(n) for k, n in enumerate(LEVELS[:3])]
    return rows.select("place_id", "parent_id", "level", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), *names)


def lies_in(inner: Column, first: Column, last: Column) -> Column:
    """Whether the place whose ``first`` is ``inner`` lies in the one of interval ``first`` to ``last``, which isn't itself."""
    return (inner > first) & (inner <= last)


def is_parent(parent: str, child: str) -> Column:
    """For two structs of ``admin_tree``'s columns: the parent's level is above the child's and the child lies in it."""
    p, c = (lambda n, x=x: F.col(f"{x}.{n}") for x in (parent, child))
    return F.coalesce((p("level") < c("level")) & lies_in(c("first"), p("first"), p("last")), F.lit(False))


def place_levels(df: DataFrame, tree: DataFrame, key: str, hint: str = "country") -> DataFrame:
    """``df`` with the tree's row (``found``) of the place named ``key``, compared by folded name, and ``needs_review``.

    ``tree`` has ``name`` too. Of namesakes the one in the hinted country is taken, then the highest level, then the smallest id. A
    hint never overrides the place's own country: where they differ the row needs a review, and so does an unknown place.
    """
    from vigilis.functions.text import fold_accents

    side = tree.select(fold_accents(F.col("name")).alias("__k"), F.struct(*[c for c in tree.columns if c != "name"]).alias("found"))
    names = df.select(fold_accents(F.col(key)).alias("__key"), fold_accents(F.col(hint)).alias("__hint")).distinct()
    other = F.when(fold_accents(F.col("found.country")) == F.col("__hint"), 0).otherwise(1)
    best = names.join(side, F.col("__key") == F.col("__k")).groupBy("__key", "__hint").agg(F.min_by("found", F.struct(other, "found.level", "found.place_id")).alias("found"))
    best = best.select(F.col("__key").alias("__x"), F.col("__hint").alias("__y"), "found")
    rows = df.withColumn("__key", fold_accents(F.col(key))).withColumn("__hint", fold_accents(F.col(hint)))
    out = rows.join(best, (F.col("__key") == F.col("__x")) & F.col("__hint").eqNullSafe(F.col("__y")), "left")
    review = F.col("found").isNull() | F.coalesce(F.lower("found.country") != F.lower(hint), F.lit(False))
    return out.withColumn("needs_review", review).drop("__key", "__hint", "__x", "__y")
