"""Best-two-fit packing of documents into fixed-length sequences.

Packing depends on lengths alone, and there are at most ``capacity`` of them, so the method runs over the histogram of
lengths, however many documents there are: a bin is filled greedily with the largest lengths that fit, then its smallest
document is replaced by two unpacked ones that fit the expanded gap more tightly; the same filling is repeated as often as
the counts allow before the next bin is worked out. The driver holds the histogram and the fillings, both bounded by
``capacity``. Documents then find their places by their rank within their length, in Spark.

Defined results: null text is an empty text (its end id alone); null ids are kept; repeated rows are packed once each;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilis.llm.common import as_rows, from_rows, need, written
from vigilis.llm.tokens import batches, encoder

#: A length's documents are ranked in so many groups, as one length may hold a third of all rows.
SALTS = 64


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, spaced: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: whole texts' ids and an end id, cut where they exceed ``capacity``."""
    need(docs, ["doc_id", "text"])

    def cut(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, spaced)
        end = np.array([end_id], enc.dtype).tobytes()
        for page in pages:
            pa.default_memory_pool().release_unused()
            ids, texts = page.column(0).to_pylist(), page.column(1).to_pylist()
            for part in batches(texts):
                rows = []
                for doc_id, raw in zip(ids[part], enc.encode(texts[part]), strict=True):
                    all_ids = np.frombuffer(raw + end, enc.dtype).astype("<u4")
                    for k, at in enumerate(range(0, len(all_ids), capacity)):
                        own = all_ids[at : at + capacity]
                        rows.append((doc_id, k, at, len(own), zlib.crc32(own.tobytes())))
                if rows:
                    columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Lengths:
    """A multiset of lengths that finds the largest one of at most a given size."""

    def __init__(self, counts: dict[int, int]):
        self.count = Counter({k: v for k, v in counts.items() if v > 0})
        self.sorted = sorted(self.count)

    def take(self, length: int, n: int = 1) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.sorted[bisect_right(self.sorted, length) - 1]

    def put(self, length: int) -> None:
        if not self.count[length]:
            insort(self.sorted, length)
        self.count[length] += 1

    def most(self, limit: int) -> int:
        """0: none."""
        i = bisect_right(self.sorted, limit)
        return self.sorted[i - 1] if i else 0

    def best_two(self, limit: int) -> tuple[int, int]:
        """The two lengths, larger first, whose sum is the largest of at most ``limit``; (0, 0): none."""
        low, high, best, pair = 0, bisect_right(self.sorted, limit) - 1, 0, (0, 0)
        while low <= high and best < limit:
            a, b = self.sorted[low], self.sorted[high]
            if a + b > limit:
                high -= 1
                continue
            if a + b > best and (low < high or self.count[a] > 1):
                best, pair = a + b, (b, a)
            low += 1
        return pair


def fillings(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one bin, number of such bins), all bins of the method."""
    left, out = Lengths(counts), []
    while left.sorted:
        bin_, gap = [], capacity
        while best := left.most(gap):
            left.take(best)
            bin_.append(best)
            gap -= best
        if gap and len(bin_) > 1:
            least = min(bin_)
            a, b = left.best_two(gap + least)
            if a + b > least:
                bin_.remove(least)
                left.put(least)
                left.take(a)
                left.take(b)
                bin_ += [a, b]
        own = Counter(bin_)
        more = min(left.count[k] // n for k, n in own.items())
        for k, n in own.items():
            if more:
                left.take(k, more * n)
        out.append((tuple(bin_), 1 + more))
    return out


def places(bins: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length and range of ranks: rank r is in sequence ``first + (r - low)``, at ``offset``."""
    used: Counter = Counter()
    rows, first = [], 0
    for lengths, times in bins:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], first, offset))
            used[n] += times
            offset += n
        first += times
    return pd.DataFrame(rows, columns=["length", "low", "first", "offset"]).sort_values(["length", "low"])


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length of 1 to ``capacity``, any others) with sequence_id and offset."""
    need(pieces, ["doc_id", "piece", "start", "length"])
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    rows = as_rows(pieces).select("row", F.col("row.length").alias("length"), F.pmod(F.xxhash64("row.doc_id", "row.piece"), F.lit(SALTS)).cast("int").alias("salt"))
    sizes = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    table = places(fillings(counts, capacity))
    edges = (table["length"].to_numpy(np.int64), table["low"].to_numpy(np.int64), table["first"].to_numpy(np.int64), table["offset"].to_numpy(np.int64))
    shared = spark.sparkContext.broadcast(edges)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))  # at most ``capacity`` x SALTS rows
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row.doc_id", "row.piece", "row.start")) - 1
    ranked = rows.withColumn("rank", within).join(base, ["length", "salt"])

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, low, first, offset = shared.value
        span = int(low.max()) + 2
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        # a rank beyond the start of its length's last range is in that range
        at = np.searchsorted(lengths * span + low, n * span + np.minimum(r, span - 1), "right") - 1
        return pd.DataFrame({"sequence_id": first[at] + r - low[at], "offset": offset[at]})

    out = ranked.withColumn("at", place("length", F.col("base") + F.col("rank")))
    return from_rows(out, pieces.columns, sequence_id=F.col("at.sequence_id"), offset=F.col("at.offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, spaced: bool = False) -> DataFrame:
    """Every document's pieces with the sequence and offset they are packed at."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity, spaced), capacity)
