"""What the set joins share: sketches that rule pairs out, and partners drawn so that no group is expanded into all its pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilis.llm.common import written

#: Words of 64 bits in a set's sketch.
SKETCH = 16
#: Rounds in which each cell's sets meet one drawn from another component, before all such pairs are compared.
DRAWS = 2


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit numbers stirred, so that their sums and remainders are those of random ones."""
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sketch(own: np.ndarray) -> np.ndarray:
    """The parity of the number of elements in each of 64 · SKETCH groups, as signed numbers.

    An element that one set has and another hasn't turns one bit, so sets differ in at least as many elements as their sketches in bits.
    """
    groups = np.bincount((mixed(own, 1 << 40) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH)
    return np.packbits(groups % 2 == 1, bitorder="little").view(np.int64)


def near(x: str, y: str, percent: int) -> Column:
    """Sizes and sketches of two rows (n, sketch) allow a similarity of ``percent`` in a hundred."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    bits = sum(F.bit_count(F.get(f"{x}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{y}.sketch", F.lit(i)))).cast("long") for i in range(SKETCH))
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (bits * (100 + percent) <= (nx + ny) * (100 - percent))


def plausible(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: keys) that ``near`` allows; ``known``: key, n, sketch."""
    return pairs.join(known.alias("x"), F.col("a") == F.col("x.key")).join(known.alias("y"), (F.col("b") == F.col("y.key")) & near("x", "y", percent)).select("a", "b")


def mixed_cells(members: DataFrame, roots: DataFrame, k: int) -> DataFrame:
    """cell, key, root, partner for cells of ``members`` (cell, key) with sets of several components; the ``k``-th draw of partners.

    A partner is a set of the same cell and another component: one drawn for the cell, else that of its least or largest root.
    Cells of two are left out, as their pair has been compared. A cell is aggregated, never gathered.
    """
    own = members.join(roots, members["key"] == roots["node"], "left").select("cell", "key", F.coalesce("root", "key").alias("root"))
    draw = F.xxhash64("key", "cell", F.lit(k))
    ends = own.groupBy("cell").agg(
        F.min_by("key", draw).alias("drawn"), F.min_by("root", draw).alias("r0"), F.count("*").alias("in_cell"),
        F.min("root").alias("r1"), F.min_by("key", "root").alias("low"), F.max("root").alias("r2"), F.max_by("key", "root").alias("high"),
    )
    partner = F.when(F.col("r0") != F.col("root"), F.col("drawn")).when(F.col("r1") != F.col("root"), F.col("low")).otherwise(F.col("high"))
    return written(own.join(ends.where("r1 < r2 and in_cell > 2"), "cell").select("cell", "key", "root", partner.alias("partner")), "mixed")
