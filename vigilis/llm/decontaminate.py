"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are reduced to lower-case words of letters and digits with single spaces. An item of m characters
that occurs with at most k edits shares at least m - q + 1 - kq character q-grams with the place where it occurs, all on
diagonals (place in the document less place in the item) at most k apart. Hits are counted in overlapping diagonal bands;
bands with enough of them are aligned, in a band of diagonals, and reported where the item occurs with at most k edits. Texts
and items of repeated words share very many q-grams: hits are counted some at a time, and bands that touch are aligned once.

The edit budget k is ``error`` (a parameter) of the item's length, less where the bound would be below one: with fewer
shared q-grams than one, the lemma says nothing. Items shorter than q have no q-gram and are looked for as whole words.

Benchmarks of any size are taken, in blocks of about ``block_bytes`` each: a pass over the documents for each block, whose
broadcast is given back before the next. A pass writes the hits of documents that have any; with one block nothing is written.

Defined results: null and empty texts have no hits; null and wordless items are never found; a null id of an item is reported
as null; repeated rows get equal results; with an empty benchmark nothing is found; other columns are kept, but one that is
called as a new one is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilis.llm.common import as_rows, from_rows, need, written
from vigilis.llm.held import hold

WORD = re.compile(r"[^\W_]+")
Q = 12
ERROR = 0.05
BLOCK_BYTES = 4 << 20
TABLE = 22  # bits of the table that sorts out most q-grams
BASE = 0x9E3779B97F4A7C15
BASES = [np.uint64(pow(BASE, n, 1 << 64)) for n in (1, 2, 4)]
BAND = 1 << 40
HITS_AT_ONCE = 1 << 18  # shared q-grams that are counted together
DIAGONALS = 1 << 15  # aligned together
HITS = "array<struct<item_id:long,start:int,end:int,edits:int>>"


def plain(text: str | None) -> bytes:
    return " ".join(WORD.findall((text or "").lower())).encode()


def qgrams(data: np.ndarray) -> np.ndarray:
    """64-bit numbers of all runs of Q = 12 bytes, from those of 2, 4 and 8."""
    one = data.astype(np.uint64) + np.uint64(1)
    b1, b2, b4 = BASES
    two = one[:-1] * b1 + one[1:]
    four = two[:-2] * b2 + two[2:]
    eight = four[:-4] * b4 + four[4:]
    return eight[:-4] * b4 + four[8:]


def slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - TABLE)


def align(item: np.ndarray, doc: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best occurrence of ``item`` in ``doc`` on diagonals ``low`` to ``high``; None: over ``most`` edits."""
    width = high - low + 1
    place = np.arange(width)
    far = 1 << 20
    ok = (low + place >= 0) & (low + place <= len(doc))
    cost, start = np.where(ok, 0, far), low + place
    padded = np.full(len(item) + width + 2, 256, np.int16)
    a, b = max(0, low), min(len(doc), high + len(item) + 1)
    if a >= b:
        return None
    padded[a - low : b - low] = doc[a:b]
    for i in range(1, len(item) + 1):
        # diagonal step: item's character i against the document's at low + place + i - 1
        new = cost + (padded[i - 1 : i - 1 + width] != item[i - 1])
        from_ = start.copy()
        skip = np.append(cost[1:], far) + 1  # item's character left out
        better = skip < new
        new = np.where(better, skip, new)
        from_ = np.where(better, np.append(start[1:], 0), from_)
        new = np.where((low + place + i >= 0) & (low + place + i <= len(doc)), new, far)
        slope = new - place  # characters of the document left out
        least = np.minimum.accumulate(slope)
        who = np.maximum.accumulate(np.where(slope == least, place, 0))
        cost, start = np.minimum(least + place, far), from_[who]
    best = int(cost.argmin())
    if cost[best] > most:
        return None
    return int(start[best]), low + best + len(item), int(cost[best])


@dataclass
class Index:
    """Items of one block with their q-grams."""

    ids: list
    texts: list[bytes]
    error: float = ERROR

    def __post_init__(self):
        self.short = [(i, b" " + t + b" ") for i, t in enumerate(self.texts) if 0 < len(t) < Q]
        own = [np.frombuffer(t, np.uint8) for t in self.texts]
        self.budget = np.array([max(0, min(int(self.error * len(t)), (len(t) - Q) // Q)) for t in self.texts], np.int64)
        self.least = np.array([max(1, len(t) - Q + 1 - int(k) * Q) for t, k in zip(self.texts, self.budget, strict=True)], np.int64)
        self.length = np.array([len(t) for t in self.texts], np.int64)
        codes = [qgrams(x) if len(x) >= Q else np.empty(0, np.uint64) for x in own]
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes] or [np.empty(0, np.int64)])
        every = np.concatenate(codes or [np.empty(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.codes, self.first = np.unique(every[order], return_index=True)
        self.last = np.append(self.first[1:], len(every))
        self.table = np.zeros(1 << TABLE, bool)
        self.table[slot(self.codes)] = True
        self.own = own

    def search(self, text: str | None) -> list[tuple]:
        """(item id, start, end, edits) in characters of ``text``, the best of each item."""
        data = plain(text)
        found: dict[int, tuple[int, int, int]] = {}
        if self.short:
            framed = b" " + data + b" "
            for i, t in self.short:
                if (at := framed.find(t)) >= 0:
                    found[i] = (at, at + len(t) - 2, 0)
        if len(data) >= Q and len(self.codes):
            doc = np.frombuffer(data, np.uint8)
            grams = qgrams(doc)
            at = np.flatnonzero(self.table[slot(grams)])
            if len(at):
                self._bands(doc, data, grams[at], at, found)
        if not found:
            return []
        # places in the reduced text -> places in the text
        words = list(WORD.finditer((text or "").lower()))
        ends = np.cumsum([len(m.group().encode()) + 1 for m in words])
        out = []
        for i, (a, b, edits) in sorted(found.items()):
            x, y = np.searchsorted(ends, [a, max(a, b - 1)], "right")
            out.append((self.ids[i], words[min(x, len(words) - 1)].start(), words[min(y, len(words) - 1)].end(), edits))
        return out

    def _passing(self, k: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The bands (item and number) with enough hits, ascending. ``at``: places of q-grams in the document, ascending; ``k``: their codes.

        Hits are counted some at a time, as a text of repeated words has as many of them as its length times the item's. A band that
        no later place can hit is decided and left behind.
        """
        n = self.last[k] - self.first[k]
        upto = np.cumsum(n)
        keys, counts, passed = np.empty(0, np.int64), np.empty(0, np.int64), [np.empty(0, np.int64)]
        begin = done = 0
        while begin < len(k):
            end = max(begin + 1, int(np.searchsorted(upto, done + HITS_AT_ONCE, "right")))
            own, m = slice(begin, end), n[begin:end]
            hit = np.repeat(self.first[k[own]] - (upto[own] - m - done), m) + np.arange(m.sum())
            item, diagonal = self.item[hit].astype(np.int64), np.repeat(at[own], m) - self.place[hit]
            # bands start every budget + 1 diagonals and are twice as long, so any budget + 1 diagonals lie in one
            cells, times = np.unique(item * BAND + np.floor_divide(diagonal, self.budget[item] + 1) + BAND // 2, return_counts=True)
            keys, inverse = np.unique(np.concatenate([keys, cells, cells - 1]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, times, times]), len(keys)).astype(np.int64)
            item = keys // BAND
            last = (keys % BAND - BAND // 2 + 2) * (self.budget[item] + 1) - 1
            later = last >= at[end] - self.length[item] if end < len(k) else np.zeros(len(keys), bool)
            passed.append(keys[~later & (counts >= self.least[item])])
            keys, counts = keys[later], counts[later]
            begin, done = end, upto[end - 1]
        return np.sort(np.concatenate(passed))

    def _bands(self, doc: np.ndarray, data: bytes, grams: np.ndarray, at: np.ndarray, found: dict) -> None:
        """Puts each item's best occurrence into ``found``: bands that touch are aligned as one stretch, and only where no exact one is."""
        k = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
        same = self.codes[k] == grams
        passed = self._passing(k[same], at[same])
        for own in np.split(passed, np.flatnonzero(np.diff(passed // BAND)) + 1) if len(passed) else []:
            i, band = int(own[0] // BAND), own % BAND - BAND // 2
            most, text = int(self.budget[i]), self.texts[i]
            low, high = band * (most + 1) - most, (band + 2) * (most + 1) + most
            cut = np.flatnonzero(low[1:] > high[:-1] + 1) + 1
            stretches = [(int(x[0]), int(y[-1])) for x, y in zip(np.split(low, cut), np.split(high, cut), strict=True)]
            exact = (data.find(text, max(0, a), max(0, b + len(text))) for a, b in stretches)
            if (e := next((e for e in exact if e >= 0), -1)) >= 0:
                found[i] = (e, e + len(text), 0)
                continue
            # parts of a long stretch overlap by more diagonals than an occurrence has
            wide = max(DIAGONALS, 8 * most)
            for a, b in ((x, min(x + wide, b)) for a, b in stretches for x in range(a, b + 1, wide - 2 * most)):
                got = align(self.own[i], doc, a, b, most)
                if got and (i not in found or got[2] < found[i][2]):
                    found[i] = got


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """The benchmark's ids and reduced texts, a block of about ``block_bytes`` at a time; equal rows once."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("t is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()  # one block
        rows = sorted(((r.i, plain(r.t)) for r in own), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        rows = [r for r in rows if r[1]]
        if rows or n == 1:
            yield [i for i, _ in rows], [t for _, t in rows]


def hits_in(block: Broadcast, error: float) -> Callable[[Column], Column]:
    """A function of a text column: array of (item_id, start, end, edits), one for each item of the block that occurs in the text."""
    key = f"index {uuid.uuid4().hex}"

    @F.pandas_udf(HITS)
    def search(text: pd.Series) -> pd.Series:
        own = hold(key, lambda: Index(*block.value, error))
        names = ("item_id", "start", "end", "edits")
        return pd.Series([[dict(zip(names, h, strict=True)) for h in own.search(t)] for t in text])

    return search.asNondeterministic()  # or a filter on its result would run it a second time


def find_contamination(docs: DataFrame, benchmark: DataFrame, error: float = ERROR, block_bytes: int = BLOCK_BYTES, hits: str = "hits", flag: str = "contaminated") -> DataFrame:
    """``docs`` with ``hits``, an array of (item_id, start, end, edits), and ``flag`` where there are any."""
    need(docs, ["text"])
    need(benchmark, ["item_id", "text"])
    sc, rows, found, first = docs.sparkSession.sparkContext, as_rows(docs), [], None
    key = [F.xxhash64("row.text").alias("k1"), F.crc32("row.text").alias("k2"), F.length("row.text").alias("k3")]
    for block in blocks_of(benchmark, block_bytes):
        if first is not None:  # there are several: each one's hits are written, by text
            found.append(_pass(rows, key, sc.broadcast(first), error))
        first = block
    if not found:
        whole = rows.withColumn("h", hits_in(sc.broadcast(first), error)(F.col("row.text")))
        return from_rows(whole, docs.columns, **{hits: F.col("h"), flag: F.size("h") > 0})
    found.append(_pass(rows, key, sc.broadcast(first), error))
    every = reduce(DataFrame.unionByName, found).groupBy("k1", "k2", "k3").agg(F.flatten(F.collect_list("h")).alias("h"))
    every = every.withColumn("h", F.array_sort("h"))
    out = rows.select("row", *key).join(every, ["k1", "k2", "k3"], "left").withColumn("h", F.coalesce("h", F.array().cast(HITS)))
    return from_rows(out, docs.columns, **{hits: F.col("h"), flag: F.size("h") > 0})


def _pass(rows: DataFrame, key: list[Column], block: Broadcast, error: float) -> DataFrame:
    """One block's hits by text (hashes and length), written; the broadcast is given back."""
    texts = rows.where("row.text is not null").select(*key, hits_in(block, error)(F.col("row.text")).alias("h"))
    out = written(texts.where(F.size("h") > 0).dropDuplicates(["k1", "k2", "k3"]), "hits")
    block.unpersist()
    return out
