"""Documents whose sets of word shingles are alike, found through PartEnum signatures.

Sizes of sets are cut into bands, each so wide that sets of a similarity of at least ``percent`` in a hundred lie in one band or
in neighbouring ones. Within a band such sets differ in at most k elements. The domain of the elements is hashed to parts, each
of ``CELLS`` cells; there are so many parts that one of them holds at most ``MISSED`` of k differences. Of every part all choices
of all but ``MISSED`` cells are enumerated: a set's elements in the chosen cells make a signature, and two such sets share the
one whose cells hold no difference. A set has signatures for its own band and for the next, so that neighbouring bands meet.

An element's cell adds up the hashes of its elements, so the signature of a choice is a sum of a few cells' sums. Signatures
only propose; the exact sets decide. Before that a sketch, parities of the elements' numbers by group, rules pairs out that differ in too
many elements: it never rules a link out, and such pairs don't leave a join. Sets are compared in rounds so that no group is
expanded into all its pairs: with the least set of one shared signature, with the least of every shared signature, ``DRAWS`` times
with a set of another component drawn from each, and then those that a signature holds together but no chain of links does.

Defined results: null and wordless texts have an empty set and are linked with nothing; rows of one doc_id are one document; a
null doc_id is linked with nothing and has no component; equal sets are one set throughout; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilis.llm.common import need, written
from vigilis.llm.components import components
from vigilis.llm.held import hold
from vigilis.llm.rounds import DRAWS, mixed, mixed_cells, near, plausible, sketch
from vigilis.llm.simhash import SEED, shingle_hashes
from vigilis.llm.tokens import batches

CELLS, MISSED = 3, 1
#: The filter of shared signatures has 2 to the power of this many bits at most: 16 MB.
FILTER_BITS = 27
CHOICES = np.array([[c in own for c in range(CELLS)] for own in combinations(range(CELLS), CELLS - MISSED)], np.uint64)


@lru_cache(1 << 12)
def band_ends(percent: int, size: int) -> tuple[int, int]:
    """(number, largest size) of the band that ``size`` lies in: a band reaches from its least size s to s · 100 / percent."""
    number, least = 0, 1
    while (most := least * 100 // percent) < size:
        number, least = number + 1, most + 1
    return number, most


def differences(most: int, percent: int) -> int:
    """How many elements two sets of at most ``most`` elements may have apart."""
    return 2 * most * (100 - percent) // (100 + percent)


def part_signatures(own: np.ndarray, number: int, most: int, percent: int) -> np.ndarray:
    """Signatures of a set (distinct 64-bit hashes) for band ``number`` with sets of at most ``most`` elements."""
    k = differences(most, percent)
    if k == 0:  # only equal sets, which are one set already
        return np.empty(0, np.uint64)
    parts = ceil((k + 1) / (MISSED + 1))
    cell = (mixed(own, number) % np.uint64(parts * CELLS)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(own, ~number & 0xFFFFFFFF)[order], dtype=np.uint64)])
    ends = np.searchsorted(cell[order], np.arange(parts * CELLS + 1))
    in_cell = (sums[ends[1:]] - sums[ends[:-1]]).reshape(parts, CELLS)
    chosen = (in_cell[:, None, :] * CHOICES[None]).sum(axis=2, dtype=np.uint64)
    place = np.arange(chosen.size, dtype=np.uint64).reshape(chosen.shape)
    return mixed(chosen + mixed(place, number + (1 << 33)), 0).ravel()


def signatures(own: np.ndarray, percent: int) -> np.ndarray:
    """All signatures of a set, as signed 64-bit numbers."""
    if not len(own):
        return np.empty(0, np.int64)
    number, most = band_ends(percent, len(own))
    after = band_ends(percent, most + 1)
    both = [part_signatures(own, number, most, percent), part_signatures(own, *after, percent)]
    return np.concatenate(both).view(np.int64)


def set_key(own: np.ndarray) -> int:
    """A sorted set's 64-bit hash, signed. Among a billion sets, two are taken for one with a probability of 3 %."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(own.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def document_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n (size of the shingle set), key (the set's hash), signatures and sketch for every row of ``docs`` (doc_id, text).

    A set has its signatures once in each task, however many copies the task meets; without an id or elements it has none.
    """
    need(docs, ["doc_id", "text"])

    def run(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("sets", dict)
        seen: set[int] = set()
        for page in pages:
            ids, texts = page.column(0).to_pylist(), page.column(1).to_pylist()
            for at in batches(texts, 1_000_000):
                own = [np.unique(shingle_hashes(t, words)) for t in texts[at]]
                keys = [set_key(x) for x in own]
                signs, sketches = [], []
                for doc_id, key, x in zip(ids[at], keys, own, strict=True):
                    new = doc_id is not None and key not in seen
                    signs.append(signatures(x, percent) if new else None)
                    sketches.append(sketch(x) if new else None)
                    if new:
                        seen.add(key)
                made = [pa.array([len(x) for x in own], pa.int64()), pa.array(keys, pa.int64()), pa.array(signs, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), *made], ["doc_id", "n", "key", "signatures", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, key long, signatures array<long>, sketch array<long>")


def shingles(docs: DataFrame, words: int) -> DataFrame:
    """key, own (distinct shingle hashes) for every row of ``docs`` (key, text) whose text has the key's set."""

    def run(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in pages:
            keys, texts = page.column(0).to_pylist(), page.column(1).to_pylist()
            for at in batches(texts, 1_000_000):
                own = [np.unique(shingle_hashes(t, words)) for t in texts[at]]
                kept = [(k, x.view(np.int64)) for k, x in zip(keys[at], own, strict=True) if set_key(x) == k]
                made = [pa.array([k for k, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(made, ["key", "own"])

    return docs.mapInArrow(run, "key long, own array<long>")


def verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: keys) whose sets' similarity is at least ``percent`` in a hundred.

    Only the texts that stand for keys in ``pairs`` are made into sets again; ``firsts`` has a doc_id for each key.
    """
    pairs = written(pairs, "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    asked = firsts.join(asked, "key").select("key", F.col("doc_id").alias("first"))
    texts = docs.join(asked, docs["doc_id"] == asked["first"]).select("key", "text")
    own = written(shingles(texts, words), "sets").dropDuplicates(["key"])
    x = own.select(F.col("key").alias("a"), F.col("own").alias("x"))
    y = own.select(F.col("key").alias("b"), F.col("own").alias("y"))
    shared, sizes = F.size(F.array_intersect("x", "y")).cast("long"), (F.size("x") + F.size("y")).cast("long")
    return written(pairs.join(x, "a").join(y, "b").where(shared * (100 + percent) >= sizes * percent).select("a", "b"), "verified")


def maybe_shared(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """cell, key, n for the signatures in ``rows`` that may be among ``shared`` (cell): all that are, and few others.

    The others are left out where they lie, by a filter of FILTER_BITS bits at most: most signatures are a set's alone and need no
    second shuffle. Where the filter is full it only lets more of them through.
    """
    bits = max(6, min(FILTER_BITS, (16 * shared.count()).bit_length()))
    place = F.shiftrightunsigned("cell", 64 - bits)
    words = shared.select(F.shiftright(place, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit"))
    table = np.zeros(1 << (bits - 6), np.int64)
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    known = rows.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def run(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in pages:
            lists = page.column(2)
            cells = lists.flatten().to_numpy(zero_copy_only=False)
            whose = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = cells.view(np.uint64) >> np.uint64(64 - bits)
            kept = (known.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            those = pa.array(whose[kept])
            yield pa.RecordBatch.from_arrays([pa.array(cells[kept], pa.int64()), page.column(0).take(those), page.column(1).take(those)], ["cell", "key", "n"])

    return rows.where("signatures is not null").select("key", "n", "signatures").mapInArrow(run, "cell long, key long, n long")


def key_links(docs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: links between different sets (keys) that connect all whose similarity is at least ``percent`` in a hundred."""
    firsts = written(rows.where("doc_id is not null and n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")), "firsts")
    cells = rows.select("key", F.explode("signatures").alias("cell"))
    shared = cells.groupBy("cell").agg(F.min("key").alias("least"), F.max("key").alias("last")).where("least < last")
    shared = written(shared.select("cell", "least"), "shared")
    members = written(maybe_shared(rows, shared).join(shared, "cell").distinct(), "members")

    # a set of every shared signature, with what rules most dissimilar pairs out
    known = rows.where("signatures is not null").select("key", "n", "sketch").join(members.select("key").distinct(), "key", "left_semi")
    known = written(known.dropDuplicates(["key"]), "known")

    pairs = members.where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct()
    pairs = written(plausible(pairs, known, percent), "first_pairs")
    links = verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), docs, firsts, words, percent)
    roots = written(components(links), "roots")
    ra = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    rb = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    other = pairs.join(ra, "a", "left").join(rb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    links = links.unionByName(verified(other.select("a", "b"), docs, firsts, words, percent))

    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    members = members.select("cell", "key")
    for k in range(DRAWS):
        own = mixed_cells(members, written(components(links), "roots"), k)
        members = own.select("cell", "key")
        asked = own.select(F.least("key", "partner").alias("a"), F.greatest("key", "partner").alias("b")).distinct()
        asked = written(plausible(asked.join(tried, ["a", "b"], "left_anti"), known, percent), "asked")
        links = links.unionByName(verified(asked, docs, firsts, words, percent))
        tried = tried.unionByName(asked)
    own = written(mixed_cells(members, written(components(links), "roots"), DRAWS).join(known, "key"), "apart")
    x, y = own.alias("x"), own.alias("y")
    meet = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & near("x", "y", percent)
    rest = x.join(y, meet).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    return links.unionByName(verified(rest.join(tried, ["a", "b"], "left_anti"), docs, firsts, words, percent))


def similar_sets(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included) for every row of ``docs``."""
    need(docs, ["doc_id", "text"])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(document_sets(docs, words, percent), "rows")
    roots = components(key_links(docs, rows, words, percent))
    # rows of one doc_id are one document: its sets are linked, each to the least of them
    own = rows.where("doc_id is not null and n > 0").select("doc_id", "key")
    rooted = own.join(roots, own["key"] == roots["node"], "left").select("doc_id", F.coalesce("root", "key").alias("root")).distinct()
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    joined = written(components(rooted.join(least, "root").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))), "classes")
    out = rows.join(joined, rows["doc_id"] == joined["node"], "left")
    return out.select(rows["doc_id"], F.col("n").alias("n_shingles"), F.coalesce("root", rows["doc_id"]).alias("component_id"))
