"""Token alignment against a plain version over the untouched libraries, and the perfect hash."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vigilis.llm import alignment, common, perfect_hash

DATA = "/root/testdata/sf0.001"


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def brute(rows):
    """The contract, document by document, with sets of byte offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(path(A)), sentencepiece.SentencePieceProcessor(model_file=path(B))
    a.encode_special_tokens = True
    table = {}
    n = 0
    for x in range(256):
        if chr(x).isprintable() and x not in (32, 160, 173):
            table[chr(x)] = x
        else:
            table[chr(256 + n)] = x
            n += 1
    entry = {i: bytes(table[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    done, counts = [], Counter()
    for doc_id, text in rows:
        groups = []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(entry[i] for i in ids_a) != whole or b"".join(map(piece, ids_b)) != whole:
            ids_a, ids_b = [], []
        ends_a, ends_b = np.cumsum([len(entry[i]) for i in ids_a]).tolist(), np.cumsum([len(piece(i)) for i in ids_b]).tolist()
        start = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append([[i for i, e in zip(ids, ends, strict=True) if start < e <= end] for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))])
            start = end
        by_end = dict(zip(ends_b, ids_b, strict=True))
        links = [(x, by_end[e]) for x, e in zip(ids_a, ends_a, strict=True) if e in by_end]
        counts.update(links)
        done.append((doc_id, ids_a, ids_b, groups, links))
    highest = defaultdict(int)
    for (_, y), k in counts.items():
        highest[y] = max(highest[y], k)
    out = []
    for doc_id, ids_a, ids_b, groups, links in done:
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if ids_a else ""))
    return sorted(out, key=repr)


def found(docs):
    common.ship(docs.sparkSession)
    return sorted((tuple(r) for r in alignment.align_tokens(docs, path(A), path(B)).collect()), key=repr)


def test_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").repartition(5)
    rows = [(r.doc_id, r.text[:1500]) for r in docs.collect()]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    """Nulls, empty and very long texts, white space of all kinds, special tokens' strings, scripts without Latin letters, repeated rows."""
    texts = [
        None, "", " ", "  two  spaces ", "a\n\nb\n c \nd", "tab\tand\r\nreturn", "<|endoftext|> <s></s><unk> <0x41>", "it's they'll 'S don't", "日本語の text です", "🙂 👩‍👩‍👧 x",
        "▁a ▁", "nbsp  x 　y", "soft­hyphen", "é è ﬁ Ａ ﷺ", "x" * 5000, "word " * 4000, "a.\nB,c", "\nstart", "end\n", "é f", "1,234.5 \x1c y\x85z", "same", "same",
    ]
    rows = [(None if i == 3 else i, t, 1, "n", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair int, n_a string, task int").repartition(7)
    want = brute([r[:2] for r in rows])
    assert found(docs) == want
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    monkeypatch.setattr(alignment, "SLICE", 8)
    monkeypatch.setattr(alignment, "BUCKET", 16)
    assert found(docs) == want
    assert found(docs.limit(0)) == []


def test_parts_are_the_whole_text(spark, monkeypatch):
    """The memo's parts give what the libraries give for the whole text, also where the memo is far too small."""
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    own = alignment.Encoder(path(A), path(B))
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    texts += ["it's 1,234.5 or a.b, e.g.; x?! (y). \"z\", w", "end.\nStart, so: 5; 6", "tail ", "tail\n", "a, b\nc", "odd .\n.x ,y"]
    for at in (slice(0, 30), slice(30, 70), slice(0, 70)):
        assert own.encode(texts[at]) == [own.whole(t) for t in texts[at]]


@pytest.mark.parametrize("n", [0, 1, 5, 20_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
    buckets = 7
    own = perfect_hash.bucket_of(keys, buckets)
    made = perfect_hash.PerfectHash([perfect_hash.build_bucket(keys[own == b]) for b in range(buckets)])
    assert len(made) == len(keys)
    assert sorted(made.index(keys)) == list(range(len(keys)))
    made.keep(keys)
    assert (made.keys[made.index(keys)] == keys).all()
    others = np.setdiff1d(rng.integers(0, 1 << 63, 1000, np.uint64), keys)
    assert (made.index(others) == perfect_hash.UNKNOWN).all()
