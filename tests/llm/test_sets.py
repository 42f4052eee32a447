"""Similar sets against brute force over all pairs, and PartEnum's guarantee."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from vigilis.llm import common, partenum


def shingle_set(text, words=3):
    own = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    if len(own) < words:
        return {" ".join(own)} if own else set()
    return {" ".join(own[i : i + words]) for i in range(len(own) - words + 1)}


def brute(rows, percent=90):
    """Sorted (doc_id, set size, smallest doc_id reachable); rows of one id are one document."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in combinations([(i, s) for i, s in sets if i is not None and s], 2):
        if len(x & y) * 100 >= len(x | y) * percent and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def found(spark, rows, **rule):
    common.ship(spark)
    got = partenum.similar_sets(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, n long, key long, node long"), **rule)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr)


def varied(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        kind, at = rng.random(), rng.randrange(len(words))
        words[at : at + (kind < 0.6)] = [f"new{rng.randrange(10**6)}"] if kind > 0.2 else []
    return words


@pytest.mark.parametrize("percent", [90, 80])
def test_brute_force(spark, percent):
    rng, rows = random.Random(percent), []
    for k in range(25):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([4, 9, 12, 20, 60, 200, 500]))]
        rows.append(base)
        for _ in range(5):
            rows.append(varied(rng, rng.choice(rows[-(k % 3) - 1 :]), rng.randrange(0, max(2, len(base) // 40 + 1))))
    texts = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rng.shuffle(texts)
    want = brute(texts, percent)
    assert found(spark, texts, percent=percent) == want
    assert len({r[2] for r in want}) < len(want) - 20


def test_odd_rows(spark):
    """Nulls, empty, wordless and very long texts, repeated rows, a shared doc_id, ties, an empty table, the operator's own column names."""
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "One two"), (9, "one TWO"), (10, "É two"), (11, "é two"), (None, "one two"), (12, long), (13, long + " y z"), (None, long), (12, long), (14, "a b c d"), (14, "p q r s"), (15, "p  q\nr s"), (16, "A b c d")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:0]) == []


def test_near_copies_are_not_expanded(spark):
    """A group of near copies: every one is linked, by about as many pairs as there are copies."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(varied(rng, base, 1))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    common.ship(spark)
    made = common.written(partenum.document_sets(docs, 3, 90), "rows")
    links = partenum.key_links(docs, made, 3, 90)
    assert links.count() < 3 * len(rows)
    assert found(spark, rows) == brute(rows)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for _ in range(400):
        size, percent = int(rng.integers(1, 700)), int(rng.choice([70, 90]))
        x = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        k = rng.integers(0, partenum.differences(len(x), percent) + 1)
        gone = int(rng.integers(0, k + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 1 << 63, int(k - gone), np.uint64)]))
        common_size = len(np.intersect1d(x, y))
        if k == 0 or common_size * 100 < (len(x) + len(y) - common_size) * percent:
            continue
        assert set(partenum.signatures(x, percent)) & set(partenum.signatures(y, percent))


def test_sketches_never_rule_a_link_out():
    rng = np.random.default_rng(6)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 900)), np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[int(rng.integers(0, len(x))) :], rng.integers(0, 1 << 63, int(rng.integers(0, 200)), np.uint64)]))
        apart = sum(int(a ^ b).bit_count() for a, b in zip(partenum.sketch(x).view(np.uint64), partenum.sketch(y).view(np.uint64), strict=True))
        assert apart <= len(np.setxor1d(x, y))
