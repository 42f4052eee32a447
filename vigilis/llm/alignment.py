"""Alignment of two tokenizers' tokens over the same texts, with corpus-wide counts of the token pairs that end together.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (pieces with byte fallback) the text, to which it adds that
space. Both give tokens with byte ranges; offsets where tokens of both end cut them into groups, and the last tokens of a
group are a link. No token is empty, so a group has exactly one link.

Documents are encoded once and their ids written. The first pass aligns them and counts each task's links by pair. The distinct
pairs get a minimal perfect hash; each task's counts become a dense vector over it, the vectors are summed in a tree of bounded
fan-in, and the second pass aligns the documents again and looks every link up, by index and verified key. A pair's shorter token is a suffix of the longer one, so
there are at most as many distinct pairs as the two vocabularies have suffixes, however large the corpus: that bounds the hash,
the vectors and what is broadcast.

Between words neither tokenizer has a token: a single space or line feed between two other visible characters begins a part
whose tokens are its own, and so do signs such as a comma behind a word. Parts are encoded once and remembered in a memo of
bounded size; texts for which the rule can't be shown to hold (characters outside Latin scripts) are encoded whole.

Defined results: texts that are null, empty or whose tokens don't spell a space and the text have no tokens, and zeros; null ids are
kept; repeated rows count again; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilis.llm.common import need, written
from vigilis.llm.held import hold
from vigilis.llm.perfect_hash import PerfectHash, bucket_of, build_bucket
from vigilis.llm.tokens import batches

#: Begins a part: a space or line feed between visible Latin characters.
BREAK = re.compile("(?<=[!-~¡-¬®-ɏ])(?=[ \n][!-~¡-¬®-ɏ])")
#: Texts whose parts stand alone: those, tabs and white space that the break leaves inside a part.
SIMPLE = re.compile("[\t\n !-~¡-¬®-ɏ]*")
#: Parts of each of the memo's two generations, length up to which a part is remembered, characters of parts that are encoded in one call.
REMEMBERED, LONGEST, TOGETHER = 1 << 19, 64, 4000
#: Stands before the parts of a call, and before signs.
FIRST = " a"
BREAKS = " \n\t"
SIGNS = ".,;:!?"
#: Words behind a break, and signs; signs that don't stand between a letter or digit and a break.
WORDS = re.compile(f"[ \n][^ \n{SIGNS}]+|[{SIGNS}]+")
INNER = re.compile(f"(?<![0-9A-Za-zÀ-ÖØ-öø-ɏ{SIGNS}])[{SIGNS}]|[{SIGNS}](?![ \n{SIGNS}]|$)")
#: Keys of a bucket, entries of a slice, vectors that are summed in one task.
BUCKET, SLICE, FAN_IN = 1 << 15, 1 << 14, 16
B_BITS = 32
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's characters: printable Latin-1 stands for itself, the other bytes for 256 and on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def parts_of(text: str, signs: bool) -> list[str]:
    """``text`` behind a space, cut at its breaks and, with ``signs``, before SIGNS that follow a letter or digit and end a word."""
    if "\t" in text or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1] in BREAKS:
        return BREAK.split(" " + text)
    if signs and not INNER.search(text):
        return WORDS.findall(" " + text)
    return [part for word in text.split(" ") for part in (BREAK.split(" " + word) if "\n" in word else (" " + word,))]


class Vocabularies:
    """Both tokenizers, and the bytes of their tokens by id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        own = {i: bytes(alphabet[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_a = [own.get(i, b"") for i in range(self.a.get_vocab_size())]
        self.pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]
        self.size_a, self.size_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        #: Of ids as they are written.
        self.dtype = np.dtype("<u2") if max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16 else np.dtype("<u4")


Ids = tuple[bytes, bytes]
NO_IDS: Ids = (b"", b"")


class Encoder(Vocabularies):
    """``encode(texts)``: both tokenizers' ids of each text, and a memo of parts."""

    def __init__(self, path_a: str, path_b: str):
        super().__init__(path_a, path_b)
        # what the memo rests on: no piece goes on behind a space, over a line feed, or from a letter to a sign
        own = [p for i, p in enumerate(self.pieces) if not self.b.is_byte(i)]
        self.apart = not any(re.search("[^▁]▁|\n", p) for p in own)
        self.signs = not any(re.search(f"[0-9A-Za-zÀ-ÖØ-öø-ɏ][{SIGNS}]", p) for p in own)
        gc.disable()  # else it goes through the whole memo again and again; the memo has no cycles
        self.memo: dict[str, Ids | None] = {}
        self.older: dict[str, Ids | None] = {}

    def spelled(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of ``text``, which begins with a space; None where a tokenizer's tokens aren't the text."""
        ids_a, ids_b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        whole = text.encode()
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != whole or b"".join(map(self.bytes_b.__getitem__, ids_b)) != whole:
            return None
        return np.array(ids_a, self.dtype), np.array(ids_b, self.dtype)

    def whole(self, text: str) -> Ids | None:
        found = self.spelled(" " + text)
        return found and (found[0].tobytes(), found[1].tobytes())

    def learn(self, parts: list[str]) -> None:
        """Encodes parts, many in one call: one behind another they keep their tokens, as each begins with a break. Signs follow a word."""
        joined, ends, kept, end = [FIRST], [len(FIRST)], [], len(FIRST)
        for p in parts:
            if p[0] not in BREAKS:
                joined.append(FIRST)
                end += len(FIRST)
                ends.append(end)
            joined.append(p)
            end += len(p) if p.isascii() else len(p.encode())
            kept.append(len(ends))
            ends.append(end)
        found = self.spelled("".join(joined))
        if found is not None:
            a, b = found
            at_a = (np.searchsorted(np.cumsum(self.size_a[a]), ends, "right") * self.dtype.itemsize).tolist()
            at_b = (np.searchsorted(np.cumsum(self.size_b[b]), ends, "right") * self.dtype.itemsize).tolist()
            a, b = a.tobytes(), b.tobytes()
            for p, k in zip(parts, kept, strict=True):
                self.memo[p] = (a[at_a[k - 1] : at_a[k]], b[at_b[k - 1] : at_b[k]])
        elif len(parts) == 1:
            self.memo[parts[0]] = None
        else:
            self.learn(parts[: len(parts) // 2])
            self.learn(parts[len(parts) // 2 :])

    def all_parts(self, parts: list[str]) -> list[Ids | None]:
        """Of distinct ``parts``; what is new is remembered, and what wasn't asked for of late is forgotten."""
        if len(self.memo) >= REMEMBERED:
            self.memo, self.older = {}, self.memo
            gc.collect()
        memo, new, size = self.memo, [], 0
        for part in parts:
            if part not in memo:
                if part in self.older:
                    memo[part] = self.older[part]
                elif part[-1] in BREAKS:  # white space would run into the next part's
                    self.learn([part])
                else:
                    new.append(part)
                    size += len(part)
                    if size >= TOGETHER:
                        self.learn(new)
                        new, size = [], 0
        if new:
            self.learn(new)
        out = [memo[p] for p in parts]
        for part in [p for p in parts if len(p) > LONGEST]:
            del memo[part]
        return out

    def encode(self, texts: list[str | None]) -> list[Ids]:
        """Ids of each text by A and B; none where it has no tokens."""
        index: dict[str, int] = {}
        cut: list[list[int] | None] = []
        for t in texts:
            simple = t and self.apart and t[0] not in BREAKS and SIMPLE.fullmatch(t)
            cut.append([index.setdefault(p, len(index)) for p in parts_of(t, self.signs)] if simple else None)
        found = self.all_parts(list(index))
        lost = {n for n, own in enumerate(found) if own is None}
        a, b = [own and own[0] for own in found], [own and own[1] for own in found]
        out = []
        for t, parts in zip(texts, cut, strict=True):
            if parts is None:
                out.append(t and self.whole(t) or NO_IDS)
            elif lost and lost.intersection(parts):
                out.append(NO_IDS)
            else:
                out.append((b"".join([a[k] for k in parts]), b"".join([b[k] for k in parts])))
        return out


class Aligner(Vocabularies):
    """Aligns ids of a batch of documents, by arrays."""

    def __init__(self, path_a: str, path_b: str):
        super().__init__(path_a, path_b)
        self.first_b = 2 * len(self.bytes_a)
        said = [f"{i}{m}" for i in range(len(self.bytes_a)) for m in ",|"] + [f"{i}{m}" for i in range(len(self.bytes_b)) for m in ",;"]
        #: Ids in text with the sign behind them: 2 · id, and one more where the token ends a group; B's behind A's.
        self.said = np.array(said, object)

    def align(self, all_a: list[bytes], all_b: list[bytes]) -> Alignment:
        """As A's and B's tokens of a document have the same bytes, so have those of all documents one behind another."""
        a, b = (np.frombuffer(b"".join(x), self.dtype).astype(np.int64) for x in (all_a, all_b))
        edges_a, edges_b = (np.cumsum([0, *map(len, x)]) // self.dtype.itemsize for x in (all_a, all_b))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        size = int(ends_a[-1]) + 1 if len(a) else 1
        in_a, in_b = np.zeros(size, bool), np.zeros(size, bool)
        in_a[ends_a], in_b[ends_b] = True, True
        return Alignment(a, b, edges_a, edges_b, in_b[ends_a], in_a[ends_b])

    def digests(self, own: Alignment) -> list[str]:
        """Hashes of the documents' groups in text."""
        last_a, last_b = np.flatnonzero(own.last_a), np.flatnonzero(own.last_b)
        group_a, group_b = np.cumsum(own.last_a) - own.last_a, np.cumsum(own.last_b) - own.last_b
        codes = np.empty(len(own.a) + len(own.b), np.int64)
        codes[np.arange(len(own.a)) + np.concatenate([[0], last_b + 1])[group_a]] = 2 * own.a + own.last_a
        codes[np.arange(len(own.b)) + np.concatenate([last_a + 1, [0]])[group_b]] = self.first_b + 2 * own.b + own.last_b
        edges = (own.edges_a + own.edges_b).tolist()
        return [hashlib.sha256("".join(self.said[codes[i:j]].tolist())[:-1].encode()).hexdigest() if i < j else "" for i, j in zip(edges, edges[1:], strict=False)]


class Alignment(NamedTuple):
    """A batch's ids, where each document's begin, and which tokens end a group."""

    a: np.ndarray
    b: np.ndarray
    edges_a: np.ndarray
    edges_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray

    @property
    def pairs(self) -> np.ndarray:
        return self.a[self.last_a] << B_BITS | self.b[self.last_b]

    @property
    def edges(self) -> np.ndarray:
        """Where each document's links begin."""
        return np.concatenate([[0], np.cumsum(self.last_a)])[self.edges_a]


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, ids_a, ids_b (binary) for every row of ``docs`` (doc_id, text)."""

    def run(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hold(f"encoder {path_a} {path_b}", lambda: Encoder(path_a, path_b))
        for page in pages:
            texts = page.column(1).to_pylist()
            for at in batches(texts):
                found = own.encode(texts[at])
                ids = page.column(0).slice(at.start, at.stop - at.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], ["doc_id", "ids_a", "ids_b"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids_a binary, ids_b binary")


def aligned(pages: Iterator[pa.RecordBatch], own: Aligner) -> Iterator[tuple[pa.Array, Alignment]]:
    """doc_ids and alignments of batches (doc_id, ids_a, ids_b) of bounded size."""
    for page in pages:
        all_a, all_b = page.column(1).to_pylist(), page.column(2).to_pylist()
        for at in batches(all_a, 1_000_000):
            yield page.column(0).slice(at.start, at.stop - at.start), own.align(all_a[at], all_b[at])


def aligner(path_a: str, path_b: str) -> Aligner:
    return hold(f"aligner {path_a} {path_b}", lambda: Aligner(path_a, path_b))


def pair_counts(ids: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """pair, n: the links of each task's documents by pair; ``ids``: doc_id, ids_a, ids_b."""

    def run(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total_keys, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, own in aligned(pages, aligner(path_a, path_b)):
            keys, n = np.unique(own.pairs, return_counts=True)
            total_keys, back = np.unique(np.concatenate([total_keys, keys]), return_inverse=True)
            total = np.bincount(back, np.concatenate([total, n]), len(total_keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total_keys), pa.array(total)], ["pair", "n"])

    return ids.mapInArrow(run, "pair long, n long")


def build_hash(pairs: DataFrame) -> PerfectHash:
    """The minimal perfect hash of ``pairs`` (pair, distinct): buckets are built in Spark, and their bits, of bounded number, gathered."""
    buckets = max(1, -(-pairs.count() // BUCKET))

    def dealt(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in pages:
            keys = page.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(keys, buckets)), page.column(0)], ["bucket", "pair"])

    def build(own: pa.Table) -> pa.Table:
        keys = np.sort(own.column("pair").to_numpy())
        levels = build_bucket(keys)
        sizes, bits = [len(x) for x in levels], [np.packbits(x).tobytes() for x in levels]
        columns = [own.column("bucket")[:1], pa.array([sizes], pa.list_(pa.int64())), pa.array([bits], pa.list_(pa.binary())), pa.array([keys.tobytes()])]
        return pa.table(columns, ["bucket", "sizes", "bits", "pairs"])

    made = pairs.mapInArrow(dealt, "bucket long, pair long").groupBy("bucket").applyInArrow(build, "bucket long, sizes array<long>, bits array<binary>, pairs binary")
    levels: list[list[np.ndarray]] = [[] for _ in range(buckets)]
    keys = [np.zeros(0, np.int64)]
    for r in made.collect():  # bounded by the vocabularies' suffixes
        levels[r.bucket] = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(r.bits, r.sizes, strict=True)]
        keys.append(np.frombuffer(r.pairs, np.int64))
    return PerfectHash(levels).keep(np.concatenate(keys))


def summed(counts: DataFrame, hashed: PerfectHash) -> np.ndarray:
    """Each pair's count by its index: tasks' counts (task, pair, n) as dense slices, summed FAN_IN at a time."""
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast(hashed)

    def dense(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(len(shared.value), np.int64)
        for page in pages:
            np.add.at(total, shared.value.index(page.column(0).to_numpy()), page.column(1).to_numpy())
        starts = range(0, len(total), SLICE)
        rows = [(i, total[a : a + SLICE].tobytes()) for i, a in enumerate(starts) if total[a : a + SLICE].any()]
        task = pa.array(np.full(len(rows), TaskContext.get().partitionId(), np.int32))
        yield pa.RecordBatch.from_arrays([task, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["task", "slice", "vector"])

    def add(own: pa.Table) -> pa.Table:
        vectors = [np.frombuffer(v.as_py(), np.int64) for v in own.column("vector")]
        part = pa.array([own.column("task")[0].as_py() // FAN_IN], pa.int32())
        return pa.table([part, own.column("slice")[:1], pa.array([np.sum(vectors, axis=0).tobytes()])], ["task", "slice", "vector"])

    vectors = written(counts.select("pair", "n").mapInArrow(dense, "task int, slice int, vector binary"), "vectors")
    tasks = (vectors.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        vectors = vectors.groupBy("slice", F.floor(F.col("task") / FAN_IN).alias("part")).applyInArrow(lambda _, own: add(own), "task int, slice int, vector binary")
        vectors, tasks = written(vectors, "vectors"), -(-tasks // FAN_IN)
    out = np.zeros(len(hashed), np.int64)
    for r in vectors.select("slice", "vector").collect():  # of bounded size
        own = np.frombuffer(r.vector, np.int64)
        out[r.slice * SLICE : r.slice * SLICE + len(own)] = own
    shared.unpersist()
    return out


def suffixes(path_a: str, path_b: str) -> int:
    """How many distinct pairs there can be at most: twice (B has some bytes under two ids) the suffixes of all tokens."""
    own = Vocabularies(path_a, path_b)
    return 2 * int(own.size_a.sum() + own.size_b.sum())


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs`` (doc_id, text)."""
    need(docs, ["doc_id", "text"])
    ids = written(encoded(docs, path_a, path_b), "ids")
    counts = written(pair_counts(ids, path_a, path_b), "pair_counts")
    hashed = build_hash(counts.select("pair").distinct())
    if len(hashed) > suffixes(path_a, path_b):
        raise ValueError("more pairs than the vocabularies have suffixes")
    n = summed(counts, hashed)
    # the highest count of each id of B
    ids_b = (hashed.keys & np.uint64((1 << B_BITS) - 1)).astype(np.int64)
    highest = np.zeros(int(ids_b.max()) + 1 if len(ids_b) else 1, np.int64)
    np.maximum.at(highest, ids_b, n)
    shared = docs.sparkSession.sparkContext.broadcast((hashed, n, n == highest[ids_b]))

    def run(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_of, counted, best = shared.value
        tokens = aligner(path_a, path_b)
        for doc_ids, own in aligned(pages, tokens):
            index, edges = at_of.index(own.pairs), own.edges
            if (index < 0).any():
                raise ValueError("a pair that the first pass hasn't met")
            n_links = np.diff(edges)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[index], dtype=np.int64)])[edges]) for x in (best, counted)]
            columns = [pa.array(x, pa.int64()) for x in (np.diff(own.edges_a), np.diff(own.edges_b), n_links, n_links, *sums)]
            yield pa.RecordBatch.from_arrays([doc_ids, *columns, pa.array(tokens.digests(own), pa.string())], NAMES)

    return ids.mapInArrow(run, ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in NAMES))
