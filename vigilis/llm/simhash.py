"""SimHash near-duplicates, found through per-segment bit counts.

A fingerprint's 64 bits are 32 segments of two bits. Its embedding is the count of set bits of each segment (0 to 2), kept
in unary in a 64-bit number, so that the Manhattan distance of two embeddings is the bit count of their exclusive or. That
distance is never more than the number of differing bits. The segments are grouped to bands that lay a grid over the
embedding: two embeddings at a distance of at most ``bits`` have equal counts in all but ``bits`` bands, so they share a
grid cell in some choice of the other bands. Cells are joined where the embeddings are within the Manhattan bound, and the
fingerprints themselves decide. Equal fingerprints are one row before any of that.

How many bands must be equal follows from the number of fingerprints (``equal_bands``): with more of them a cell is made
narrower, so that chance candidates of a fingerprint stay few; none is lost with any number of bands.

``similar_documents`` is the pipeline's: it links texts by the similarity of their shingle sets. Fingerprints of the sets within
``bits`` are found as above, and the exact sets decide. Sets at 0.8 are up to 13 bits apart, and a radius of 13 would need 16 bands of
two segments, whose cells hold large parts of a corpus. So sets that share one of BANDS hashes of ROWS minima are compared as well (a
pair at 0.8 shares none with a probability of 7 in 100,000).

Defined results: null and wordless texts have the fingerprint 0, which links like any other; a null doc_id has a fingerprint
and is in a component, whose id is its smallest non-null doc_id; repeated rows are kept; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilis.llm.common import dropped, need, written
from vigilis.llm.components import components
from vigilis.llm.held import hold
from vigilis.llm.rounds import DRAWS, mixed_cells, near, plausible, sketch
from vigilis.llm.tokens import batches

SEED = 42
LOW = 0x5555555555555555  # the lower bit of each segment
CELL_BITS = 1.5  # of information in a segment's count
PAIR_COST = 0.2  # of comparing a chance candidate, where dealing out a fingerprint to a cell is 1
BANDS, ROWS = 24, 5
BROADCAST_KEYS = 1_000_000
#: Odd factors that reorder the 64-bit hashes for each minimum.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; the whole text's words if they are fewer; none if there are none."""
    import xxhash

    own = (text or "").encode().lower().split()  # bytes: A-Z alone, and ASCII white space alone
    if not own:
        return np.empty(0, np.uint64)
    joined = b" ".join(own)
    ends = list(accumulate(len(w) + 1 for w in own))
    starts = [0, *ends]
    h = xxhash.xxh64_digest
    cut = [h(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :] or ends[-1:], strict=False)]
    return np.frombuffer(b"".join(cut), ">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of ``hashes``; signed 64-bit."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp for every row of ``docs`` (doc_id, text)."""
    need(docs, ["doc_id", "text"])

    def run(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in pages:
            made = [fingerprint(shingle_hashes(t.as_py(), words)) for t in page.column(1)]
            yield pa.RecordBatch.from_arrays([page.column(0), pa.array(made, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Segment counts in unary: 0 is 00, 1 is 01, 2 is 11."""
    low, high = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def equal_bands(n: int, bits: int) -> int:
    """Of ``bits`` + k bands k must be equal: the k with the least work for ``n`` fingerprints, by cells and chance candidates."""

    def work(k: int) -> float:
        return math.comb(bits + k, k) * (1 + PAIR_COST * n / 2 ** (32 * CELL_BITS * k / (bits + k)))

    return min(range(1, 32 - bits), key=work)


def grid(bits: int, same: int) -> list[int]:
    """Masks (signed 64-bit) over the embedding: all choices of ``same`` of ``bits`` + ``same`` bands of whole segments."""
    n = bits + same
    edges = [round(32 * k / n) for k in range(n + 1)]
    bands = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(own) for own in combinations(bands, same)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_pairs(fps: DataFrame, bits: int) -> DataFrame:
    """a, b: all pairs of different fingerprints of ``fps`` (fp, distinct) that differ in at most ``bits`` bits."""
    masks = F.array(*map(F.lit, grid(bits, equal_bands(fps.count(), bits))))
    embedded = fps.select("fp", embedding(F.col("fp")).alias("u"))
    cells = embedded.select("fp", "u", F.posexplode(F.transform(masks, lambda m: F.col("u").bitwiseAND(m))).alias("grid", "cell"))
    a, b = cells.alias("a"), cells.alias("b")
    manhattan = F.bit_count(F.col("a.u").bitwiseXOR(F.col("b.u"))) <= bits
    exact = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits
    same = (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell"))
    pairs = a.join(b, same & (F.col("a.fp") < F.col("b.fp")) & manhattan).where(exact)
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included) for every row of ``docs``."""
    own = written(fingerprints(docs, words), "fingerprints")
    groups = written(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups")
    roots = components(close_pairs(groups.select("fp"), bits))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # fingerprints with links, and those with copies alone: every fingerprint is in exactly one component
    return own.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def bands(own: np.ndarray) -> np.ndarray:
    """BANDS signed 64-bit hashes of the minima of ``own`` (distinct hashes); none if it is empty."""
    import xxhash

    if not len(own):
        return np.empty(0, np.int64)
    least = np.full(len(FACTORS), (1 << 64) - 1, np.uint64)
    for at in range(0, len(own), 1 << 10):
        np.minimum(least, (FACTORS[:, None] * own[at : at + (1 << 10)]).min(1), out=least)
    cut = [xxhash.xxh64_digest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.frombuffer(b"".join(cut), ">i8").astype(np.int64)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, key (hash of the set), fp (its fingerprint), sketch, bands and shingles (distinct) for every row of ``docs`` (doc_id, text)."""
    need(docs, ["doc_id", "text"])

    def run(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hold("shingle sets", dict)  # drops what the worker holds of another stage
        lists = pa.list_(pa.int64())
        for page in pages:
            texts = page.column(2).to_pylist()
            for at in batches(texts, 1_000_000):
                own = [np.unique(shingle_hashes(t, words)) for t in texts[at]]
                keys = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in own], np.uint64).view(np.int64)
                made = [pa.array(keys), pa.array([fingerprint(x) for x in own], pa.int64()), *[pa.array(list(map(f, own)), lists) for f in (sketch, bands)], pa.array([x.view(np.int64) for x in own], lists)]
                part = page.slice(at.start, at.stop - at.start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["doc_id", "text_hash", "key", "fp", "sketch", "bands", "shingles"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return keyed.mapInArrow(run, "doc_id long, text_hash long, key long, fp long, sketch array<long>, bands array<long>, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: keys) whose shingle sets have a Jaccard similarity of at least ``percent`` in a hundred.

    ``firsts``: for each key the row of ``sets`` that stands for it. Only sets of keys in ``pairs`` leave the scan.
    """
    pairs = written(pairs, "pairs")
    asked = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    asked = written(firsts.join(asked, "key", "left_semi"), "asked")
    # 24 bytes a key; more of them than that are joined by a shuffle
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked
    here = (sets["key"] == asked["key"]) & sets["doc_id"].eqNullSafe(asked["doc_id"]) & sets["text_hash"].eqNullSafe(asked["text_hash"])
    own = sets.join(asked, here, "left_semi").groupBy("key").agg(F.first("shingles").alias("own"))
    both = pairs.join(own.select(F.col("key").alias("a"), F.col("own").alias("x")), "a").join(own.select(F.col("key").alias("b"), F.col("own").alias("y")), "b")
    shared, sizes = F.size(F.array_intersect("x", "y")).cast("long"), (F.size("x") + F.size("y")).cast("long")
    return written(both.where(shared * (100 + percent) >= sizes * percent).select("a", "b"), "verified")


def shared_cells(firsts: DataFrame, bits: int) -> DataFrame:
    """cell, key of sets (``firsts``: key, fp, bands) that may be similar: of one fingerprint, of two within ``bits``, or with the same minima."""
    close = close_pairs(written(firsts.select("fp").distinct(), "fingerprints"), bits).withColumn("cell", F.xxhash64(F.lit("close"), "a", "b"))
    close = close.select("cell", F.explode(F.array("a", "b")).alias("fp")).join(firsts.select("fp", "key"), "fp").select("cell", "key")
    equal = firsts.select(F.xxhash64(F.lit("equal"), "fp").alias("cell"), "key")
    return firsts.select(F.explode("bands").alias("cell"), "key").unionByName(equal).unionByName(close)


def similar_documents(docs: DataFrame, words: int = 5, percent: int = 80, bits: int = 4) -> DataFrame:
    """doc_id, text_hash, component for every row of ``docs``: texts are linked whose similarity is at least ``percent`` in a hundred.

    Each text is compared with one that shares a cell, the smallest there is; then with the smallest of each of its other cells;
    then DRAWS times with one of another component that is drawn from each; then pairs of a cell that are still apart are compared. Pairs
    already in one component, and those that sizes or sketches rule out, are left out.
    """
    sets = written(shingle_sets(docs, words), "sets")
    one = [F.first(c).alias(c) for c in ("fp", "sketch", "bands")]
    firsts = sets.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("s"), F.first(F.size("shingles")).cast("long").alias("n"), *one)
    firsts = written(firsts.select("key", "s.doc_id", "s.text_hash", "n", "fp", "sketch", "bands"), "firsts")
    ids = firsts.select("key", "doc_id", "text_hash")
    cells = written(shared_cells(firsts, bits), "cells")
    shared = cells.groupBy("cell").agg(F.min("key").alias("least"), F.max("key").alias("last")).where("least < last").select("cell", "least")
    members = written(cells.join(shared, "cell").distinct(), "members")
    known = written(firsts.select("key", "n", "sketch").join(members.select("key").distinct(), "key", "left_semi"), "known")

    pairs = members.where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct()
    pairs = written(plausible(pairs, known, percent), "first_pairs")
    links = verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, ids, percent)
    roots = written(components(links), "roots")
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    other = pairs.join(ra, "a", "left").join(rb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    links = links.unionByName(verified(other.select("a", "b"), sets, ids, percent))
    tried, left = pairs, members.select("cell", "key")
    for k in range(DRAWS):
        own = mixed_cells(left, written(components(links), "roots"), k)
        left = own.select("cell", "key")
        asked = own.select(F.least("key", "partner").alias("a"), F.greatest("key", "partner").alias("b")).distinct()
        asked = written(plausible(asked.join(tried, ["a", "b"], "left_anti"), known, percent), "asked")
        links = links.unionByName(verified(asked, sets, ids, percent))
        tried = tried.unionByName(asked)
    own = written(mixed_cells(left, written(components(links), "roots"), DRAWS).join(known, "key"), "apart")
    x, y = own.alias("x"), own.alias("y")
    meet = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & near("x", "y", percent)
    rest = x.join(y, meet).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    last = verified(rest.join(tried, ["a", "b"], "left_anti"), sets, ids, percent)
    rows = written(sets.select("doc_id", "text_hash", "key"), "rows")
    # what is left to do needs no shingles
    dropped(sets, firsts, cells, members, known, own)
    roots = components(links.unionByName(last))
    return rows.join(roots, rows["key"] == roots["node"], "left").select("doc_id", "text_hash", F.coalesce("root", "key").alias("component"))
