"""Spelling variants of a corpus' words, found through a reduced alphabet.

Letters are hashed to a few symbols. Of each reduced word the full neighbourhood of one edit is generated: itself, every deletion,
insertion and replacement over the symbols. Two words one edit apart have reduced words at most one edit apart, so a join of
the neighbourhoods with the reduced vocabulary finds every such pair; the original strings decide. Of two reduced words only the
one with the smaller code looks for the other, so a pair is met from one side. A reduced word is a 64-bit code (a
polynomial over its symbols, so that the codes of all its neighbours follow from running sums); words of one code are
never paired for longer than the join's own test.

A word's form is its near word of largest count, where that is ``ratio`` times its own. Forms lead to ever larger counts, so a
path of forms has at most as many words as the largest count has digits to the base ``ratio``; the last is the root.

Defined results: null texts have no words; a null doc_id counts as an empty text in the hash that plants a misspelling; repeated rows
count again; ties go to the smaller word in code-point order; an empty table gives no words; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilis.llm.common import dropped, need, written
from vigilis.llm.held import hold

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
SYMBOLS = 8
#: Codes of a neighbourhood that are worked out together.
BLOCK = 1 << 20
_random = np.random.default_rng(13)
#: A reduced word s0 s1 … has the code Σ value(s_i) · BASE^i modulo 2^64; BASE is odd, so it has an inverse.
BASE = int(_random.integers(1 << 62, 1 << 63)) | 1
VALUES = _random.integers(1, 1 << 63, 256, np.uint64)
INVERSE = np.uint64(pow(BASE, -1, 1 << 64))


def misspelt(doc_id: int | None, word: str, every: int) -> str:
    """``word`` without one code point, where ``every`` divides the crc32 of id and word."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, least_length: int = 6, every: int = 199) -> DataFrame:
    """word, n: occurrences in all texts of ``docs`` (doc_id, text) of words of at least ``least_length`` code points."""
    need(docs, ["doc_id", "text"])

    def run(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("words", dict)
        total: Counter[str] = Counter()

        def part() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for page in pages:
            for doc_id, text in zip(page.column(0).to_pylist(), page.column(1), strict=True):
                runs = Counter(RUN.findall((text.as_py() or "").translate(LOWER)))
                for word, n in runs.items():
                    if len(word) >= least_length and len(word := misspelt(doc_id, word, every)) >= least_length:
                        total[word] += n
                if len(total) >= HELD:
                    yield part()
        yield part()

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def reduced(words: list[str], symbols: int) -> list[np.ndarray]:
    """Each word's symbols: its code points hashed to ``symbols`` values."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    hashed = (points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    flat = VALUES[(hashed % np.uint64(symbols)).astype(np.int64)]
    return np.split(flat, np.cumsum([len(w) for w in words])[:-1]) if words else []


def powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.multiply.accumulate(np.full(n - 1, BASE, np.uint64))
    return out


def neighbourhood(rows: np.ndarray, symbols: int) -> Iterator[np.ndarray]:
    """For reduced words of one length (a row of values each) the codes of all words one edit away, as arrays of a row each."""
    n, size = rows.shape
    power = powers(size + 2)
    terms = rows * power[:size]
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
    total = before[:, -1:]
    yield before[:, :-1] + (total - before[:, 1:]) * INVERSE
    moved = before + (total - before) * np.uint64(BASE)
    for value in VALUES[:symbols]:
        yield total - terms + value * power[:size]
        yield moved + value * power[: size + 1]


def code_of(rows: np.ndarray) -> np.ndarray:
    return (rows * powers(rows.shape[1])).sum(axis=1, dtype=np.uint64)


def coded(words: DataFrame, symbols: int) -> DataFrame:
    """``words`` (word, n) with ``code``, that of the reduced word, and its length."""

    def run(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in pages:
            codes = [int((own * powers(len(own))).sum(dtype=np.uint64)) for own in reduced(page.column(0).to_pylist(), symbols)]
            made = pa.array(np.array(codes, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([page.column(0), page.column(1), made], ["word", "n", "code"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, code long")


def neighbours(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """own, code: for a word of each reduced form (column word) its own code and the larger codes of its neighbourhood."""

    def run(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in pages:
            by_length: dict[int, list[np.ndarray]] = {}
            for own in reduced(page.column(0).to_pylist(), symbols):
                by_length.setdefault(len(own), []).append(own)
            for size, found in by_length.items():
                step = max(1, BLOCK // (size + 1))
                for at in range(0, len(found), step):
                    rows = np.stack(found[at : at + step])
                    own = code_of(rows)
                    for codes in [own[:, None], *neighbourhood(rows, symbols)]:
                        # an array of rows x places; equal codes of one kind are neighbours in a row, as equal letters in a word
                        keep = codes >= own[:, None] if codes.shape[1] == 1 else codes > own[:, None]
                        keep[:, 1:] &= codes[:, 1:] != codes[:, :-1]
                        whose = np.broadcast_to(own[:, None], codes.shape)[keep]
                        made = [pa.array(whose.view(np.int64)), pa.array(codes[keep].view(np.int64))]
                        yield pa.RecordBatch.from_arrays(made, ["own", "code"])

    return vocabulary.select("word").mapInArrow(run, "own long, code long")


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """a, na, b, nb: all pairs of ``words`` (word, n; distinct) exactly one edit apart, each once."""
    own = written(coded(words, symbols), "words")
    vocabulary = own.groupBy("code").agg(F.min("word").alias("word"))
    known = own.select("code").distinct()
    links = neighbours(vocabulary, symbols).join(known, "code").distinct()
    links = written(links, "reduced")
    a = own.select(F.col("word").alias("a"), F.col("n").alias("na"), F.col("code").alias("own"))
    b = own.select(F.col("word").alias("b"), F.col("n").alias("nb"), "code")
    # words of one code would meet from both sides
    once = (F.col("own") != F.col("x.code")) | (F.col("a") < F.col("b"))
    edit = (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    met = links.join(a, "own").alias("x").join(b.alias("y"), (F.col("x.code") == F.col("y.code")) & once & edit)
    return met.select("a", "na", "b", "nb")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: for every word of ``forms`` (word, form) the last of its forms; paths are halved in each round."""
    ways = written(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        dropped(ways)
        ways = moved
        if not ways.where("moved").limit(1).count():
            return ways.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, every: int = 199, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of ``docs`` with ``least_length`` code points and ``least_count`` occurrences."""
    words = written(count_words(docs, least_length, every).where(F.col("n") >= least_count), "counted")
    pairs = near_pairs(words, symbols)
    sides = F.array(F.struct(F.col("a").alias("word"), (-F.col("nb")).alias("m"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), (-F.col("na")).alias("m"), F.col("a").alias("other")))
    near = pairs.select(F.inline(sides)).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("m", "other")).alias("best"))
    joined = words.join(near, "word", "left")
    is_form = -F.col("best.m") >= F.col("n") * ratio
    out = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"),
        F.when(is_form, -F.col("best.m")).alias("form_n"),
    )
    out = written(out, "forms")
    last = roots(out.where("form is not null").select("word", "form"))
    return out.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
