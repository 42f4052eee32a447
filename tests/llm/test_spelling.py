"""Spelling variants against brute force over all pairs of words."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from vigilis.llm import common, spelling


def edits(a, b):
    """Whether ``b`` is ``a`` with one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least_length=6, least_count=5, ratio=5, every=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in spelling.RUN.findall(text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if n >= least_count and len(w) >= least_length}
    near = {w: [v for v in words if edits(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def found(spark, rows, **rule):
    common.ship(spark)
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string, n int, word string, code int"), **rule)
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect())


@pytest.mark.parametrize("symbols", [2, 8])
def test_brute_force(spark, symbols):
    random.seed(symbols)
    words = ["".join(random.choices("abcdéÿ÷", k=random.randint(5, 9))) for _ in range(60)]
    words += [w[:i] + random.choice("abÿÀ") + w[i + random.randint(0, 1) :] for w in words for i in (0, 3, len(w))]
    rows = []
    for i in range(400):
        own = random.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=40)
        rows.append((i, random.choice([" ", ", ", "1", "ń"]).join(w.upper() if random.random() < 0.1 else w for w in own), 1, "x", 2))
    want = brute([r[:2] for r in rows], every=3)
    assert found(spark, rows, every=3, symbols=symbols) == want
    assert any(w[3] for w in want) and any(w[5] != w[0] and w[5] != w[3] for w in want)


def test_odd_rows(spark):
    """Nulls, empty and very long texts and words, ties, repeated rows, an empty table, columns of the operator's own names."""
    long = "z" * 3000
    rows = [(None, None), (1, ""), (2, "123 !"), (3, ("abcdef " * 30 + "abcdeg " * 5 + "abcdeh " * 30) * 1), (3, "abcdef"), (3, "abcdef"), (None, f"{long} {long}a " * 6)]
    rows = [(*r, 1, "w", 2) for r in rows]
    got = found(spark, rows, every=1 << 40)
    assert got == brute([r[:2] for r in rows], every=1 << 40)
    assert {r[0]: r[3] for r in got}["abcdeg"] == "abcdef"
    tie = [(1, "abcdef " * 25 + "abcdeh " * 25 + "abcdeg " * 5, 1, "w", 2)]
    assert {r[0]: r[3] for r in found(spark, tie, every=1 << 40)}["abcdeg"] == "abcdef"
    assert found(spark, rows[:0]) == []


def test_neighbourhood_is_full():
    """Codes of all words one edit away, over all symbols, and no others."""
    symbols, rows = 3, spelling.VALUES[np.array([[0, 1, 1, 2]])]
    got = {int(c) for codes in spelling.neighbourhood(rows, symbols) for c in codes[0]}
    word, alphabet = (0, 1, 1, 2), range(symbols)
    want = {word[:i] + word[i + 1 :] for i in range(4)} | {word[:i] + (s,) + word[i + k :] for i in range(5) for s in alphabet for k in (0, 1) if i + k <= 4}
    assert got == {int(spelling.code_of(spelling.VALUES[np.array([w])])[0]) for w in want}
