"""Tokenizing whole texts with a public tokenizer file, exactly as the library does, with a bounded memo of words.

The pre-tokenizers of these files never join what a single space or line feed between two non-space characters
separates, so a text's ids are those of its parts one after another. Most parts are seen again and again. A batch's parts are
looked up together, by arrays: a part of at most 14 bytes is, with the separator before it and its length, a key of two
64-bit numbers, so that equal keys are equal parts. The parts that the memo lacks are encoded by the library in one call.
Parts for which the rule doesn't hold (runs of white space) make the whole text go to the library unsplit, and so do
texts that hold an added token such as <|endoftext|>. Punctuation behind an ASCII letter or digit begins a part of its own, as it
begins a token of its own in these files; the apostrophe doesn't, as contractions start with it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np

from vigilis.llm.held import hold

KEY = 15  # bytes of a key, separator and part; the 16th is its length
#: Stands between texts; no byte of UTF-8.
BETWEEN = b"\xff"
#: Bytes that begin a part, those that begin one behind a letter or digit, and those.
BEGINS, TAILS, LETTERS = np.zeros((3, 256), bool)
BEGINS[[ord(" "), ord("\n"), BETWEEN[0]]] = True
TAILS[list(b".,;:!?#$%&*|<>()-\"")] = True
LETTERS[[b for b in range(128) if chr(b).isalnum()]] = True
SEPARATORS = (b" ", b"\n")
#: Parts without a character that could be space or combine with another.
PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u024f]+")
TOGETHER = 500  # parts that the library encodes in one call
#: What is kept of a key's two numbers, by its length.
KEEP_LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(KEY + 1)], np.uint64)
ONLY_HIGH = np.array([(1 << 8 * max(0, n - 8)) - 1 for n in range(KEY + 1)], np.uint64)
STEP = 1 << 16  # parts that are looked up together


class Memo:
    """Keys (two 64-bit numbers) -> ids. Room for ``limit`` keys; it is emptied where more would come."""

    def __init__(self, limit: int, dtype: np.dtype):
        self.bits = max(4, (2 * limit - 1).bit_length())
        self.limit, self.dtype = limit, dtype
        self.low, self.high = np.zeros(limit, np.uint64), np.zeros(limit, np.uint64)
        self.first, self.size = np.zeros(limit, np.int64), np.zeros(limit, np.int32)
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.used, self.pool, self.fill = 0, np.zeros(1 << 16, self.dtype), 0

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entry numbers; -1: unknown."""
        out = np.full(len(low), -1, np.int32)
        at, todo = self._slot(low, high), np.arange(len(low))
        while len(todo):
            entry = self.slots[at[todo]]
            here = np.flatnonzero(entry >= 0)
            entry, todo = entry[here], todo[here]
            same = (self.low[entry] == low[todo]) & (self.high[entry] == high[todo])
            out[todo[same]] = entry[same]
            todo = todo[~same]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, low: np.ndarray, high: np.ndarray, first: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Puts distinct new keys in; their ids are ``size`` of ``ids`` from ``first`` on. Gives their entry numbers."""
        n = np.arange(self.used, self.used + len(low), dtype=np.int32)
        self.low[n], self.high[n], self.first[n], self.size[n] = low, high, first + self.fill, size
        self.used += len(n)
        while self.fill + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.fill : self.fill + len(ids)] = ids
        self.fill += len(ids)
        at, todo = self._slot(low, high), np.arange(len(low))
        while len(todo):
            free = self.slots[at[todo]] < 0
            _, one = np.unique(at[todo[free]], return_index=True)
            won = todo[free][one]
            self.slots[at[won]] = n[won]
            lost = np.ones(len(low), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return n


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned integers of ``dtype``.

    ``spaced``: the tokenizer keeps a space with the word after it (byte-level); otherwise it drops white space and case.
    The memo holds at most ``limit`` parts beside those of the batch at work.
    """

    def __init__(self, path: str, spaced: bool, limit: int = 1 << 19):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [(t.content.lower() if t.normalized else t.content, t.normalized) for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.spaced = spaced
        self.limit = limit
        self.memo = Memo(limit + STEP, self.dtype)
        self.long: dict[bytes, np.ndarray | None] = {}

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype)

    def _split(self, key: bytes) -> tuple[str, str]:
        """A key's separator, as the library is to see it, and its part."""
        text = (key[1:] if key[:1] == BETWEEN else key).decode()
        return (text[0], text[1:]) if key[:1] in SEPARATORS else ("", text)

    def _part(self, sep: str, part: str) -> np.ndarray | None:
        """Ids of one part; None: it may not stand alone."""
        if not self.spaced:
            return self._library(part)
        return None if not part or part[0].isspace() or part[-1].isspace() else self._library(sep + part)

    def _encode(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First id, number of ids (-1: may not stand alone) of each key, and the ids. Plain parts are encoded many in one call."""
        first, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        parts = list(map(self._split, keys))
        plain = [i for i, (_, part) in enumerate(parts) if PLAIN.fullmatch(part)]
        ids, fill = [np.zeros(0, self.dtype)], 0
        for at in range(0, len(plain), TOGETHER):
            those = plain[at : at + TOGETHER]
            # one without a separator is encoded behind a line feed, whose id is left out
            joined = [(sep or "\n") + part for sep, part in map(parts.__getitem__, those)]
            edges = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
            own = self.tok.encode("".join(joined), add_special_tokens=False)
            ids.append(np.array(own.ids, self.dtype))
            begin = np.fromiter((a for a, _ in own.offsets), np.int64, len(ids[-1]))
            n = np.bincount(np.searchsorted(edges, begin, "right"), minlength=len(those))
            feed = np.array([self.spaced and not parts[i][0] for i in those])
            first[those], size[those] = fill + np.cumsum(n) - n + feed, n - feed
            fill += len(ids[-1])
        for i in sorted(set(range(len(keys))).difference(plain)):
            own = self._part(*parts[i])
            first[i], size[i] = fill, -1 if own is None else len(own)
            if own is not None:
                ids.append(own)
                fill += len(own)
        return first, size, np.concatenate(ids)

    def _has_added(self, text: str) -> bool:
        """Whether a token that the library cuts out before all else may be in ``text``."""
        return any(t in (text.lower() if lower else text) for t, lower in self.added)

    def _step(self, data: bytes, view: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts, the number of them by part, and which parts may not stand alone."""
        memo = self.memo
        if memo.used + len(start) > len(memo.low):
            memo.clear()
        short = size <= KEY
        n = np.where(short, size, 1)
        window = view[start].view("<u8")
        low, high = window[:, 0] & KEEP_LOW[n], (window[:, 1] & ONLY_HIGH[n]) | (n.astype(np.uint64) << np.uint64(56))
        entry = memo.find(low, high)
        new = np.flatnonzero((entry < 0) & short)
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            other = np.ones(len(order), bool)
            other[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            one = order[other]
            keys = [data[a : a + k] for a, k in zip(start[one].tolist(), size[one].tolist(), strict=True)]
            made = memo.add(low[one], high[one], *self._encode(keys))
            entry[order] = made[np.cumsum(other) - 1]
        entry = np.where(short, entry, 0)
        first, count = memo.first[entry], memo.size[entry].astype(np.int64)
        pool = memo.pool
        long = np.flatnonzero(~short)
        if len(long):
            more, at = [pool[: memo.fill]], memo.fill
            for i, a, k in zip(long.tolist(), start[long].tolist(), size[long].tolist(), strict=True):
                key = data[a : a + k]
                if key in self.long:
                    own = self.long[key]
                else:
                    own = self._part(*self._split(key))
                    if k < 100:
                        if len(self.long) >= self.limit // 32:
                            self.long.clear()
                        self.long[key] = own
                first[i], count[i] = at, -1 if own is None else len(own)
                if own is not None:
                    more.append(own)
                    at += len(own)
            pool = np.concatenate(more)
        bad = count < 0
        count = np.where(bad, 0, count)
        before = np.cumsum(count) - count
        return pool[np.repeat(first - before, count) + np.arange(count.sum())], count, bad

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        raw = [t.encode() if t else b"" for t in texts]
        data = BETWEEN + BETWEEN.join(raw) + BETWEEN
        flat = np.frombuffer(data + bytes(16), np.uint8)
        here = flat[: len(data)]
        begins = BEGINS[here]
        begins[1:] |= TAILS[here[1:]] & LETTERS[here[:-1]]
        start = np.flatnonzero(begins)
        size = np.diff(start)
        start = start[:-1]
        opens = np.searchsorted(start, np.cumsum([0, *[len(r) + 1 for r in raw[:-1]]]))  # each text's first part
        view = np.lib.stride_tricks.sliding_window_view(flat, 16)
        ids, counts, bads = [], [np.zeros(1, np.int64)], []
        for at in range(0, len(start), STEP):
            a, b, c = self._step(data, view, start[at : at + STEP], size[at : at + STEP])
            ids.append(a)
            counts.append(b)
            bads.append(c)
        every, ends = np.concatenate(ids).tobytes(), np.cumsum(np.concatenate(counts)) * self.dtype.itemsize
        whole = np.add.reduceat(np.concatenate(bads), opens) > 0
        edges = ends[np.append(opens, len(start))].tolist()
        out = [every[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        lower = data.lower()
        added = any(t.encode().lower() in lower for t, _ in self.added)
        for i, t in enumerate(texts):
            if t and (whole[i] or added and self._has_added(t)):
                out[i] = self._library(t).tobytes()
            elif not t:
                out[i] = b""
        return out


def encoder(path: str, spaced: bool) -> Encoder:
    """One for each worker process."""
    return hold(f"encoder {path} {spaced}", lambda: Encoder(path, spaced))


def batches(rows: Sequence[str | None], most: int = 400_000):
    """Slices of ``rows`` of about ``most`` characters, so that a batch of very long texts stays small."""
    at = size = 0
    for i, t in enumerate(rows):
        size += len(t or "") + 64
        if size >= most:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(rows):
        yield slice(at, len(rows))
