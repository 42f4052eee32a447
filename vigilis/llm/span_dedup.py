"""Substring deduplication by sliding sentence spans.

A span starts at every sentence and runs over several sentences, until it has ``least_sentences`` and ``least_words``. Its hash
depends on its own words alone, so a passage has the same spans wherever it stands. Of each hash, the first occurrence (smallest
doc_id, then place) stays; sentences that any other occurrence covers are removed.

A sentence ends at a full stop, exclamation or question mark before white space, at a full-width one, or at a blank line; a single
line feed is white space, so that a passage wrapped otherwise has the same spans. Sentences of over ``long`` words are divided
after words chosen by their own hash (one in ``cut``), after repeated words, and after ``most`` words: a passage that begins or
ends inside a long sentence then has spans too, the same ones wherever it was cut.

Defined results: null texts stay null; a null doc_id comes after all others; rows of one doc_id are one document and don't
remove each other's spans, but for spans that repeat within a text; an empty table gives no rows; other columns are kept, but
one called like the count of removed sentences is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilis.llm.common import as_rows, from_rows, need, written
from vigilis.llm.tokens import batches

WORD = re.compile(r"\S+")
ENDS = re.compile(r"[.!?]+(?=\s)|[。！？]+|\n[^\S\n]*\n")
LAST = (1 << 63) - 1
WITHIN = -1


@dataclass(frozen=True)
class Rule:
    """What a span is: see the module."""

    least_sentences: int = 2
    least_words: int = 18
    long: int = 16
    cut: int = 5
    most: int = 64

    def sentences(self, text: str) -> list[tuple[int, int, list[str]]]:
        """(start, end, lower-case words) of all sentences with a word; a sentence's end is the next one's start."""
        found: list[tuple[int, int, list[str]]] = []
        a = 0
        for b in [*[m.end() for m in ENDS.finditer(text)], len(text)]:
            words = text[a:b].lower().split()
            if len(words) <= self.long:
                if words:
                    found.append((a, b, words))
                elif found:
                    found[-1] = (found[-1][0], b, found[-1][2])
                a = b
                continue
            start, own = a, []
            for m, w in zip(WORD.finditer(text, a, b), words, strict=True):
                own.append(w)
                if zlib.crc32(w.encode("utf-8", "surrogatepass")) % self.cut == 0 or len(own) == self.most or own[-2:] == [w, w]:
                    found.append((start, m.end(), own))
                    start, own = m.end(), []
            if own:
                found.append((start, b, own))
            elif start < b:
                found[-1] = (found[-1][0], b, found[-1][2])
            a = b
        return found

    def spans(self, text: str | None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Sentences' (start, end), and for each sentence that begins a span: (signed 64-bit hash, sentences in it)."""
        import xxhash

        own = self.sentences(text or "")
        joined = [" ".join(w).encode("utf-8", "surrogatepass") for _, _, w in own]
        sizes = [len(w) for _, _, w in own]
        out, j, words = [], 0, 0
        for i in range(len(own)):
            while j < len(own) and (j - i < self.least_sentences or words < self.least_words):
                words += sizes[j]
                j += 1
            if j - i < self.least_sentences or words < self.least_words:
                break
            h = xxhash.xxh64_intdigest(b" ".join(joined[i:j]))
            out.append((h - (1 << 64) if h >> 63 else h, j - i))
            words -= sizes[i]
        return [(a, b) for a, b, _ in own], out

    def cut_out(self, text: str | None, starts: list[int]) -> tuple[str | None, int]:
        """``text`` without the sentences of the spans that begin at sentences ``starts``, and how many sentences that are.

        WITHIN among ``starts``: also of all spans whose hash has occurred before in the text.
        """
        if not starts or not text:
            return text, 0
        at, own = self.spans(text)
        begin = {i for i in starts if i != WITHIN}
        if WITHIN in starts:
            seen: set[int] = set()
            begin |= {i for i, (h, _) in enumerate(own) if h in seen or seen.add(h)}
        gone = {j for i in begin for j in range(i, i + own[i][1])}
        return "".join(text[a:b] for j, (a, b) in enumerate(at) if j not in gone).strip(), len(gone)


def repeated_spans(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc, hash, starts: by document and text (its hash), the sentences at which spans begin that another document has had before.

    WITHIN stands for those that the text itself has had before: they are found again when they are cut out. No span's
    occurrences are gathered: a span's first and last documents are minima, taken before the shuffle for each task, and
    only spans with two documents are joined, where Spark splits a hash that very many have.
    """

    def run(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in pages:
            texts = page.column(2).to_pylist()
            for part in batches(texts):
                hashes, places, again = [], [], []
                for text in texts[part]:
                    seen: dict[int, int] = {}
                    own = rule.spans(text)[1]
                    for i, (h, _) in enumerate(own):
                        seen.setdefault(h, i)
                    hashes.append(list(seen))
                    places.append(list(seen.values()))
                    again.append(len(seen) < len(own))
                here = page.slice(part.start, part.stop - part.start)
                made = [pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(again)]
                yield pa.RecordBatch.from_arrays([here.column(0), here.column(1), *made], ["doc", "key", "hashes", "places", "again"])

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("key"), "text")
    own = written(keyed.mapInArrow(run, "doc long, key long, hashes array<long>, places array<int>, again boolean"), "spans")
    rows = own.select("doc", "key", F.inline(F.arrays_zip("hashes", "places")).alias("hash", "place"))
    first = rows.groupBy("hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("hash", "first")
    others = rows.join(first, "hash").where(F.col("doc") > F.col("first")).select("doc", "key", "place")
    within = own.where("again").select("doc", "key", F.lit(WITHIN).alias("place"))
    # a document's spans are bounded by its own text
    return others.unionByName(within).groupBy("doc", "key").agg(F.sort_array(F.collect_set("place")).alias("starts"))


def remove_repeats(docs: DataFrame, rule: Rule | None = None, removed: str = "removed") -> DataFrame:
    """``docs`` with ``text`` less its repeated spans and ``removed`` (number of sentences)."""
    need(docs, ["doc_id", "text"])
    rule = rule or Rule()
    hits = repeated_spans(docs, rule)
    rows = as_rows(docs)
    at = (F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST)) == F.col("doc")) & (F.xxhash64("row.text") == F.col("key"))

    @F.pandas_udf("struct<text:string,removed:int>")
    def cut(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
        done = [rule.cut_out(t, [] if s is None else list(s)) for t, s in zip(text, starts, strict=True)]
        return pd.DataFrame(done, columns=["text", "removed"])

    out = rows.join(hits, at, "left").withColumn("cut", cut("row.text", "starts"))
    columns = {c: F.col("cut.text") for c in docs.columns if c == "text"} | {removed: F.col("cut.removed")}
    order = [c for c in docs.columns if c != removed]
    return from_rows(out, docs.columns, **columns).select(*[f"`{c}`" for c in order], removed)
