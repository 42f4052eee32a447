"""Minimum-cost-flow resharding: from old shard sizes and new capacities, the block transfers that move the fewest bytes.

Documents lie in old shards, each cut into a fixed number of blocks by a hash of doc_id, so that a shard that holds a third
of all rows is as many blocks as any other. The driver sees block totals only (shards x blocks of them, whatever the
input's size). Moving a byte between two shards costs one, leaving it costs nothing; the flow of least cost between old
sizes and new capacities is solved by successive shortest paths, then cut into whole blocks. Files of shards that give or
take a block are written anew; others stay as they are.

Defined results: null text counts no bytes; a null id or a null shard key is hashed like a value; repeated rows are kept and
take slots one after another; an empty table gives no rows; further columns are carried along, but those called ``__old``,
``__shard`` or ``__slot`` are replaced.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilis.llm.common import from_rows, need, new_path


def min_cost_flow(have: list[int], want: list[int]) -> dict[tuple[int, int], int]:
    """Bytes moved from old shard i to new shard j, for all i, j with any; the total that changes shard is the least possible.

    Successive shortest paths on source -> old -> new -> sink, cost 1 for i != j and 0 for i == j; sums must be equal.
    """
    if sum(have) != sum(want):
        raise ValueError(f"{sum(have)} bytes don't fill capacities of {sum(want)}")
    n, m = len(have), len(want)
    source, sink = n + m, n + m + 1
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, most: int, price: int) -> None:
        for x, y, r, c in ((a, b, most, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(c)

    for i, x in enumerate(have):
        edge(source, i, x, 0)
        for j in range(m):
            edge(i, n + j, x, int(i != j))
    for j, x in enumerate(want):
        edge(n + j, sink, x, 0)
    height = [0] * (n + m + 2)
    while True:
        dist, by = {source: 0}, {}
        queue = [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > dist[a]:
                continue
            for e in out[a]:
                if room[e] and (x := d + cost[e] + height[a] - height[to[e]]) < dist.get(to[e], 1 << 60):
                    dist[to[e]], by[to[e]] = x, e
                    heapq.heappush(queue, (x, to[e]))
        if sink not in dist:
            break
        for a, d in dist.items():
            height[a] += d
        path, at = [], sink
        while at != source:
            path.append(by[at])
            at = to[by[at] ^ 1]
        most = min(room[e] for e in path)
        for e in path:
            room[e] -= most
            room[e ^ 1] += most
    moved = {}
    for i in range(n):
        for e in out[i]:
            if not e & 1 and n <= to[e] < n + m and room[e ^ 1]:
                moved[i, to[e] - n] = room[e ^ 1]
    return moved


def transfers(blocks: dict[int, list[tuple[int, int, int]]], want: list[int]) -> list[tuple[int, int, int, int]]:
    """(old shard, block, new shard, first slot) of whole blocks; ``blocks``: (block, bytes, rows) by old shard.

    An old shard's blocks, large ones first, go to whichever of its flows' shards lacks most; what a shard has got too much or
    too little by whole blocks is carried on to the next old shard. What is left of that is evened out by ``evened``.
    """
    have = [sum(x[1] for x in blocks.get(i, [])) for i in range(max([len(want), *[i + 1 for i in blocks]]))]
    flow: dict[int, dict[int, int]] = defaultdict(dict)
    for (i, j), x in min_cost_flow(have, want).items():
        flow[i][j] = x
    owed: dict[int, int] = defaultdict(int)  # bytes that a new shard is short of by rounding so far
    at: dict[tuple[int, int], int] = {}
    size = {(i, b): x for i, own in blocks.items() for b, x, _ in own}
    for i in sorted(blocks):
        lacks = [(-(x + owed[j]), j) for j, x in flow[i].items()] or [(0, i if i < len(want) else 0)]
        heapq.heapify(lacks)
        given: dict[int, int] = defaultdict(int)
        for block, x, _ in sorted(blocks[i], key=lambda b: (-b[1], b[0])):
            lack, j = lacks[0]
            at[i, block] = j
            given[j] += x
            heapq.heapreplace(lacks, (lack + x, j))
        for j in given.keys() | flow[i].keys():
            owed[j] += flow[i].get(j, 0) - given[j]
    at = evened(at, size, want)
    rows = {(i, b): n for i, own in blocks.items() for b, _, n in own}
    slots: dict[int, int] = defaultdict(int)
    out = []
    for (i, block), j in sorted(at.items(), key=lambda p: (p[1], p[0])):
        out.append((i, block, j, slots[j]))
        slots[j] += rows[i, block]
    return out


def evened(at: dict[tuple[int, int], int], size: dict[tuple[int, int], int], want: list[int], most: int = 1000) -> dict[tuple[int, int], int]:
    """``at`` with at most ``most`` further moves from the shard that has most too much to the one that lacks most: the block whose
    size is nearest to half of the difference, preferably one that would move anyhow, as long as that brings the two nearer."""
    own: dict[int, list[tuple[int, tuple[int, int]]]] = {j: [] for j in range(len(want))}
    for k, j in at.items():
        own[j].append((size[k], k))
    over = [sum(x for x, _ in own[j]) - want[j] for j in range(len(want))]
    for _ in range(most if len(want) > 1 else 0):
        a, b = max(range(len(want)), key=lambda j: over[j]), min(range(len(want)), key=lambda j: over[j])
        half = (over[a] - over[b]) / 2
        fit = [(abs(x - half), k[0] == a, k, x) for x, k in own[a] if 0 < x < over[a] - over[b]]
        if not fit:
            break
        _, _, k, x = min(fit)
        own[a].remove((x, k))
        own[b].append((x, k))
        over[a] -= x
        over[b] += x
    return {k: j for j, those in own.items() for _, k in those}


@dataclass
class Resharding:
    """``plan``: (old shard, block, new shard, first slot), at most shards x blocks rows. ``placed``: the documents' columns with
    __old (shard so far), __shard (new one), __slot (gapless from 0 in the shard), clustered and sorted by shard and slot."""

    plan: list[tuple[int, int, int, int]]
    placed: DataFrame

    @property
    def touched(self) -> set[int]:
        """Shards that give or take a block."""
        return {s for i, _, j, _ in self.plan if i != j for s in (i, j)}

    def rewrite(self, path: str) -> DataFrame:
        """Writes the touched shards to ``path``, a folder for each; returns all rows, those of touched shards from the files.

        Shards that nothing leaves or enters are not written; their rows come from where they lie.
        """
        touched, shards = sorted(self.touched), {x[2] for x in self.plan}
        whole = shards <= set(touched)
        affected = self.placed if whole else self.placed.where(F.col("__shard").isin(touched))
        affected.withColumn("__dir", F.col("__shard")).write.partitionBy("__dir").parquet(path)
        files = self.placed.sparkSession.read.schema(self.placed.schema).parquet(path).select(*self.placed.columns)
        return files if whole else files.unionByName(self.placed.where(~F.col("__shard").isin(touched)))


def reshard(docs: DataFrame, old_shard: Column, n_new: int, blocks: int = 1024, overhead: int = 16) -> Resharding:
    """New shards for ``docs`` (doc_id, text, any others), of equal capacities.

    ``old_shard``: the shard of a row so far, from 0. A document's size is its text's UTF-8 bytes plus ``overhead``.
    """
    need(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    laid = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), old_shard.cast("int").alias("old"), block.alias("block"))
    sized = laid.select("old", "block", (F.coalesce(F.octet_length("row.text"), F.lit(0)) + overhead).cast("long").alias("size"))
    found = defaultdict(list)
    for r in sorted(sized.groupBy("old", "block").agg(F.sum("size"), F.count("*")).collect()):  # at most shards x blocks rows
        found[r[0]].append((r[1], r[2], r[3]))
    total = sum(x[1] for own in found.values() for x in own)
    plan = transfers(found, [total // n_new + (j < total % n_new) for j in range(n_new)])
    moves = spark.createDataFrame(plan, "o int, b int, shard int, first long")
    at = laid.join(F.broadcast(moves), (F.col("old") == F.col("o")) & (F.col("block") == F.col("b")))
    ranged = at.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "first")
    within = Window.partitionBy("shard", "first").orderBy("row.doc_id", F.crc32("row.text"))
    slot = F.col("first") + F.row_number().over(within) - 1
    placed = ranged.select("row", "old", "shard", slot.alias("slot"))
    return Resharding(plan, from_rows(placed, docs.columns, __old=F.col("old"), __shard=F.col("shard"), __slot=F.col("slot")))


def reshard_files(docs: DataFrame, old_shard: Column, n_new: int, blocks: int = 1024) -> DataFrame:
    """``reshard`` with the touched shards written to the shared folder."""
    return reshard(docs, old_shard, n_new, blocks).rewrite(new_path(docs.sparkSession, "shards"))
