"""The corpus operators against brute force, exact round trips and held-out accuracy, on small tables and on the smallest test data."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigilis.llm import common, components, decontaminate, factorization, langid, line_rules, packing, queries, sharding, simhash, span_dedup, token_store, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, removed int, place int, __x string, hits string, language string, toxicity string, row string, k1 int, old int, doc long"
LONG = "Lorem ipsum dolor sit amet. " * 3000


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, wordless and very long texts, repeated rows, clashing column names."""
    common.ship(spark)
    base = "One two three four five six seven eight nine ten. Eleven twelve thirteen fourteen fifteen sixteen. Done here now."
    texts = [None, "", " \n\t ", LONG, base, base, base + " More words at the end of it.", "x", "!!! ??? ...", "é" * 50, "tab\tand  double  spaces \n\n lines\r\n"]
    data = [(None if i == 7 else i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None if i % 5 == 0 else len(t or ""), "clash", 1, 2, None, "h", "l", "t", "r", 5, 6, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*data, data[5], data[5], data[0]], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# sharding


def test_flow_moves_least():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, m = rng.integers(1, 6, 2)
        have = rng.integers(0, 50, n).tolist()
        total = sum(have)
        want = [total // m + (j < total % m) for j in range(m)]
        flow = sharding.min_cost_flow(have, want)
        for i in range(n):
            assert sum(x for (a, _), x in flow.items() if a == i) == have[i]
        for j in range(m):
            assert sum(x for (_, b), x in flow.items() if b == j) == want[j]
        stay = sum(min(h, w) for h, w in zip(have, want))
        assert sum(x for (a, b), x in flow.items() if a != b) == total - stay


def test_reshard(spark, docs, rows):
    out = queries.op1_reshard(spark, DATA).collect()
    assert sorted(r.doc_id for r in out) == sorted(rows)
    for r in out:
        text = rows[r.doc_id].text or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 16, zlib.crc32(text.encode()), "bytes", None)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert set(by) <= set(range(40))
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    # no move of a document from the largest shard to the smallest would bring them nearer
    sizes = [sum(r.size for r in by[j]) for j in range(40)]
    most, least = max(range(40), key=lambda j: sizes[j]), min(range(40), key=lambda j: sizes[j])
    assert sizes[most] - sizes[least] <= min(r.size for r in by[most])


def test_reshard_is_even(spark):
    out = queries.op1_reshard(spark, "/root/testdata/sf0.01").groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r.s for r in out]
    assert len(sizes) == 40 and max(sizes) < 1.02 * min(sizes)


def test_reshard_leaves_untouched_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 84) for i in range(400)], "doc_id long, text string")
    old = F.when(F.col("doc_id") < 100, 0).when(F.col("doc_id") < 200, 1).when(F.col("doc_id") < 390, 2).otherwise(3)
    plan = sharding.reshard(docs, old, 4, blocks=32)
    assert {0, 1}.isdisjoint(plan.touched) or plan.touched <= {0, 1, 2, 3}
    got = plan.rewrite(str(tmp_path / "out"))
    assert got.count() == 400
    moved = got.where("__old <> __shard").count()
    assert 80 <= moved <= 115


def test_reshard_odd(odd, empty):
    assert sharding.reshard_files(odd, F.lit(3), 5, 4).count() == odd.count()
    assert sharding.reshard_files(empty, F.lit(0), 5, 4).count() == 0


# token files


def test_token_files_round_trip(spark, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    start = 0
    for r in sorted(queries.op4_token_files(spark, DATA).collect()):
        ids = np.array([*tok.encode(rows[r.doc_id].text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_reader_opens_only_asked_frames(spark, docs, tmp_path, monkeypatch):
    out = str(tmp_path / "tokens")
    token_store.write_tokens(docs, out, path("byte_bpe_50k.json"), 0, file_bytes=20_000)
    files = [r.content for r in spark.read.format("binaryFile").load(out).select("content").collect()]
    assert len(files) > 3
    reader = token_store.FileReader(files[0])
    opened = []
    frame = token_store.FileReader.frame
    monkeypatch.setattr(token_store.FileReader, "frame", lambda self, i: (opened.append(i), frame(self, i))[1])
    reader.document(1)
    assert opened == [1]
    import zstandard

    plain = zstandard.ZstdDecompressor().decompressobj()  # a plain decoder reads the first frame
    assert plain.decompress(files[0][: reader.at[1]]) == frame(reader, 0)
    broken = bytearray(files[0])
    broken[reader.at[1] - 3] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        frame(token_store.FileReader(bytes(broken)), 0)
    some = token_store.read_tokens(spark, out, [3, 5], with_ids=True).collect()
    assert sorted(r.doc_id for r in some) == [3, 5]
    assert all(len(r.ids) == r.n_tokens and r.ids[-1] == 0 for r in some)


def test_token_files_odd(spark, odd, empty):
    out = token_store.tokens_of(odd, path("byte_bpe_50k.json"), 0).orderBy("start").collect()
    assert len(out) == odd.count()
    assert [r.doc_id for r in out][0] is None
    assert [r.start for r in out] == np.cumsum([0, *[r.n_tokens for r in out[:-1]]]).tolist()
    assert token_store.tokens_of(empty, path("byte_bpe_50k.json"), 0).count() == 0


BIG = 2**53 + 1


@pytest.fixture(scope="module")
def big(spark):
    """Ids that a floating-point number can't hold, with nulls in the same batch."""
    common.ship(spark)
    return spark.createDataFrame([(BIG, "a b c d e f"), (None, "a b c d e f"), (BIG + 2, "a b c d e f g h"), (-BIG, None)], "doc_id long, text string").coalesce(1)


def test_large_ids_with_nulls(big):
    want = {BIG, None, BIG + 2, -BIG}
    assert {r.doc_id for r in token_store.tokens_of(big, path("byte_bpe_50k.json"), 0).collect()} == want
    assert {r.doc_id for r in simhash.near_duplicates(big).collect()} == want
    assert {r.component_id for r in simhash.near_duplicates(big).where("doc_id is null").collect()} == {BIG}
    assert {r.doc_id for r in simhash.similar_documents(big).collect()} == want
    assert {r.doc_id for r in packing.pack_documents(big, path("word_bpe_49k.json"), 1, 64).collect()} == want
    assert {r.doc_id for r in span_dedup.remove_repeats(big).collect()} == want


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_is_the_library(name, spaced, monkeypatch):
    from vigilis.llm import tokens

    monkeypatch.setattr(tokens, "STEP", 1000)
    enc = tokens.Encoder(path(name), spaced, limit=50)
    texts = ["a  b", " lead", "x\n\ny z", "tail ", "x y  z", "don't  go 'll", "<|endoftext|> x", "tab\tq  \n x", "é ́x", "Σς ΑΣ ΣΑΣ", "a.b c... d,e 1,234.5", "ǅ ŉ İ ß", "\x1c x", "x \x85 y", "日本 語", LONG[:999]]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path(name))
    rng = np.random.default_rng(4)
    for letters in ("abcXYZ  \n\n\t .,'<|>éÉßİ\xa0\x85́ſK日ñ0123-\x00\r$Åﬁ\xad", "ab c'st.\né", "a.b !"):
        texts += ["".join(rng.choice(list(letters), rng.integers(0, 40))) for _ in range(3000)]
    ref = [np.array(library.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts]
    assert enc.encode(texts) == ref
    assert [x for t in texts for x in enc.encode([t])] == ref  # now with a filled memo
    assert enc.encode([None, ""]) == [b"", b""]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_keeps_added_tokens(name, spaced):
    from tokenizers import Tokenizer

    from vigilis.llm.tokens import Encoder

    enc, library = Encoder(path(name), spaced, limit=50), Tokenizer.from_file(path(name))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y\nz", "<|startoftext|> a", "<|ENDOFTEXT|> a", "<|endof text|>", "a <| b", "two<|endoftext|><|endoftext|> "]
    assert enc.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts]


# packing


def serial(lengths, capacity):
    """The method one bin after another."""
    left, bins = Counter(lengths), []
    while +left:
        bin_, gap = [], capacity
        while fit := [x for x in +left if x <= gap]:
            left[max(fit)] -= 1
            bin_.append(max(fit))
            gap -= max(fit)
        if gap and len(bin_) > 1:
            least = min(bin_)
            pairs = [(a + b) for a, b in combinations(sorted((+left).elements()), 2) if least < a + b <= gap + least]
            if pairs:
                best = max(pairs)
                a, b = max((p for p in combinations(sorted((+left).elements()), 2) if sum(p) == best), key=max)
                bin_.remove(least)
                left[least] += 1
                left[a] -= 1
                left[b] -= 1
                bin_ += [a, b]
        bins.append(sorted(bin_))
    return bins


def test_fillings_are_the_serial_method():
    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths = rng.integers(1, 33, rng.integers(1, 60)).tolist()
        bins = [sorted(b) for b, n in packing.fillings(Counter(lengths), 32) for _ in range(n)]
        assert sorted(x for b in bins for x in b) == sorted(lengths)
        assert all(sum(b) <= 32 for b in bins)
        assert len(bins) <= len(serial(lengths, 32)) + 1


def check_packing(out, capacity):
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack(spark, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    out = queries.op8_pack(spark, DATA).collect()
    n = check_packing(out, 4096)
    assert n <= math.ceil(sum(r.length for r in out) / 4096) + 1
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    for i, row in rows.items():
        ids = np.array([*tok.encode(row.text or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[i]) == want


def test_pack_odd(odd, empty):
    out = packing.pack_documents(odd, path("word_bpe_49k.json"), 1, 64).collect()
    check_packing(out, 64)
    assert len({(r.doc_id, r.piece) for r in out}) < len(out)
    assert packing.pack_documents(empty, path("word_bpe_49k.json"), 1, 64).count() == 0


# near-duplicates


def brute_components(rows, words, bits):
    import xxhash

    prints = {}
    for i, t in rows:
        own = [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w]
        grams = [b" ".join(own[k : k + words]) for k in range(max(1, len(own) - words + 1))] if own else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def test_near_duplicates(spark, rows):
    want = brute_components([(i, r.text) for i, r in rows.items()], 4, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_near_duplicates(spark, DATA).collect()}
    assert got == want


@pytest.mark.parametrize("same", [1, 2, 3, 5])
def test_close_pairs_lose_none(spark, monkeypatch, same):
    monkeypatch.setattr(simhash, "equal_bands", lambda n, bits: same)
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, 40)
    fps = {int(x) for x in base}
    for x in base.tolist():
        for _ in range(6):
            y = x & (1 << 64) - 1
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                y ^= 1 << int(b)
            fps.add(y - (1 << 64) if y >> 63 else y)
    want = {(a, b) for a, b in combinations(sorted(fps), 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    got = simhash.close_pairs(spark.createDataFrame([(x,) for x in fps], "fp long"), 4).collect()
    assert {(r.a, r.b) for r in got} == want


def test_cells_narrow_with_the_number_of_fingerprints():
    ks = [simhash.equal_bands(n, 4) for n in (1_000, 100_000, 10_000_000, 10**9)]
    assert ks == sorted(ks) and ks[0] < ks[-1]
    for n, k in zip((1_000, 100_000, 10_000_000, 10**9), ks):
        assert math.comb(4 + k, k) * n / 2 ** (48 * k / (4 + k)) < 2_000


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def test_near_duplicates_odd(odd, empty):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    zero = {r.component_id for r in out if r.doc_id in (0, 1, 2)}
    assert zero == {0} and all(r.fp == 0 for r in out if r.doc_id in (0, 1, 2))
    assert {r.component_id for r in out if r.doc_id in (4, 5)} == {4}
    assert simhash.near_duplicates(empty).count() == 0


# quality, toxicity, language


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    ones = np.sum(y)
    return (rank[np.array(y) == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones))


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    size = factorization.WORD_BUCKETS + len(factorization.STATISTICS) * factorization.BINS
    m = factorization.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, 3)), np.zeros((len(factorization.STATISTICS), factorization.BINS - 1)))
    row, k, x = m.rows([factorization.featurize("some words and some more words", 30)])
    pairs = sum(m.factors[k[i]] @ m.factors[k[j]] * x[i] * x[j] for i in range(len(k)) for j in range(i))
    assert m.logits(row, k, x, 1)[0][0] == pytest.approx(0.3 + m.linear[k] @ x + pairs)


def test_quality_scores_brute_force(spark, docs, rows):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    m = factorization.fit_quality(docs, labels, common.fold_of(F.col("doc_id"), 4) != 2)
    out = {r.doc_id: r.score for r in queries.op3_quality(spark, DATA).collect()}
    assert set(out) == set(rows)
    for i in sorted(rows, key=lambda i: len(rows[i].text or ""))[:20]:
        text = rows[i].text or ""
        counts = Counter(text.lower().split())
        norm = math.sqrt(sum(counts.values()))
        x = Counter()
        for w, n in counts.items():
            x[zlib.crc32(w.encode()) % factorization.WORD_BUCKETS, w] = math.sqrt(n) / norm
        stats = factorization.statistics(text, text.lower().split(), counts, float(rows[i].n_chars))
        own = [(k, v) for (k, _), v in x.items()]
        own += [(factorization.WORD_BUCKETS + f * factorization.BINS + sum(v >= e for e in m.edges[f]), 0.5) for f, v in enumerate(stats)]
        out_ = m.bias + sum(m.linear[k] * v for k, v in own)
        out_ += sum(float(m.factors[a] @ m.factors[b]) * v * w for (a, v), (b, w) in combinations(own, 2))
        assert out[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, out_)))), abs=1e-4)


def test_quality_held_out(spark):
    data = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in queries.op3_quality(spark, data).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{data}/labels.parquet").collect()]
    held = [(y, out[i].score) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in out.values())
    assert auc(*zip(*held)) > 0.97


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None), (None, 1), (8, 0), (10, 1), (4, 0)], "doc_id long, quality int")
    model = factorization.fit_quality(odd, labels, F.lit(True))
    out = factorization.score_quality(odd, model, "q")
    assert out.columns == [*odd.columns, "q"] and all(0 <= r.q <= 1 for r in out.collect())
    none = factorization.fit_quality(odd, labels.limit(0), F.lit(True))
    assert factorization.score_quality(odd, none, "q").where("q <> 0.5").count() == 0
    assert factorization.score_quality(empty, none, "q").count() == 0


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    chain = toxicity.fit_toxicity(docs, labels.where("doc_id % 4 <> 1"))
    got = toxicity.score_toxicity(docs.join(labels.where("doc_id % 4 = 1"), "doc_id"), chain).select("toxic", "toxicity.flagged").collect()
    hit = [r.flagged for r in got if r.toxic == 1]
    wrong = [r.flagged for r in got if r.toxic == 0]
    assert chain.names[-1] == "toxic" and len(chain.names) == toxicity.CATEGORIES + 1
    assert np.mean(hit) > 0.93 and np.mean(wrong) < 0.015


def dense_linear(x, earlier, y, use):
    """``fit_linear`` on a dense matrix, row by row and feature by feature."""
    rows = np.flatnonzero(use)
    ones, m = y[rows].sum(), len(rows)
    score = np.zeros(x.shape[1])
    for f in range(x.shape[1]):
        g = 0.0
        for cls, size in ((1, ones), (0, m - ones)):
            seen = x[rows][y[rows] == cls][:, f].sum()
            share = x[rows][:, f].sum() / m
            for k, want in ((seen, size * share), (size - seen, size * (1 - share))):
                g += 2 * k * math.log(k / want) if k else 0
        sign = np.sign(x[rows][y[rows] == 1][:, f].mean() - x[rows][y[rows] == 0][:, f].mean())
        score[f] = sign * math.sqrt(max(g, 0))
    chosen = [f for f in np.argsort(-np.abs(score), kind="stable")[:500] if abs(score[f]) > toxicity.TELLING]
    data = np.concatenate([np.ones((m, 1)), earlier[rows], x[rows][:, chosen]], 1)
    theta = np.zeros(data.shape[1])
    theta[0] = math.log(ones / (m - ones))
    g1, g2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, 201):
        error = 1 / (1 + np.exp(-data @ theta)) - y[rows]
        grad = data.T @ error / m + np.append(0, theta[1:]) / m
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.999 * g2 + 0.001 * grad**2
        theta = theta - 0.1 * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.999**step)) + 1e-9)
    full = np.zeros(x.shape[1])
    full[chosen] = theta[1 + earlier.shape[1] :]
    return theta[0], theta[1 : 1 + earlier.shape[1]], full


def test_chain_brute_force():
    rng = np.random.default_rng(7)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    texts, toxic = [], []
    for i in range(240):
        bad = i % 3 == 0
        own = list(rng.choice(words, 6))
        own += list(rng.choice(["zut", "zog"] if i % 2 else ["vex", "vil"], 2)) if bad else []
        texts.append(" ".join(own))
        toxic.append(int(bad))
    ids = list(range(240))
    chain = toxicity.fit_chain(ids, texts, toxic, groups=2)
    assert chain.names == ["category_1", "category_2", "toxic"]
    names = sorted({f for t in texts for w in t.split() for f in toxicity.features(w)})
    x = np.array([[f in {g for w in t.split() for g in toxicity.features(w)} for f in names] for t in texts], float)
    y = np.array(toxic, float)
    zs, vs = (np.array([bool(set(t.split()) & seeds) for t in texts], float) * y for seeds in ({"zut", "zog"}, {"vex", "vil"}))
    kinds = toxicity.categories(toxicity.Rows.of(texts), y, 2)
    assert {tuple(k) for k in kinds.T} == {tuple(zs), tuple(vs)}
    fold = np.array([zlib.crc32(str(i).encode()) % 3 for i in ids])
    earlier, probability = np.zeros((240, 0)), np.zeros((240, 0))
    for k, truth in enumerate([*kinds.T, y]):
        bias, before, weight = dense_linear(x, earlier, truth, np.ones(240, bool))
        assert chain.biases[k] == pytest.approx(bias, abs=1e-6) and chain.earlier[k] == pytest.approx(before, abs=1e-6)
        assert [chain.weights[chain.place[f], k] if f in chain.place else 0 for f in names] == pytest.approx(weight, abs=1e-6)
        p = 1 / (1 + np.exp(-(bias + probability @ before + x @ weight)))
        probability = np.concatenate([probability, p[:, None]], 1)
        beyond = np.zeros(240)
        for f in range(3):
            b, e, w = dense_linear(x, earlier, truth, fold != f)
            beyond[fold == f] = (1 / (1 + np.exp(-(b + earlier @ e + x @ w))))[fold == f]
        earlier = np.concatenate([earlier, beyond[:, None]], 1)
    assert chain.of(texts) == pytest.approx(probability, abs=1e-5)


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    chain = toxicity.fit_toxicity(odd, labels)
    assert toxicity.score_toxicity(odd, chain).count() == odd.count()
    none = toxicity.fit_toxicity(odd, labels.limit(0))
    assert toxicity.score_toxicity(odd, none).where("toxicity.flagged").count() == 0
    assert toxicity.score_toxicity(empty, none).count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "a", "ab", "b", "bab", "▁", "ba", "c"]
    index = langid.Pieces(pieces)
    p = np.random.default_rng(2).random((index.none + 1, 2))
    p[-1] = 0

    def brute(w):
        if not w:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(w) + 1):
            i = pieces.index(w[:k]) if w[:k] in pieces else index.other if k == 1 else None
            if i is not None:
                out = out + p[i] * brute(w[k:])
        return out

    for w in ("▁abab", "▁babc", "▁xyab"):
        assert langid.forward(index.ends([w]), p)[0, -1] == pytest.approx(brute(w))
        assert np.exp(langid.log_sums(index.ends([w]), p))[0] == pytest.approx(brute(w))


def test_language_scores_brute_force(spark, docs, rows):
    model = langid.fit_languages(docs, F.lit(True), path("piece_bpe_32k.model"))
    number = {p: i for i, p in enumerate(model.pieces.names)}
    longest = max(map(len, number))
    assert longest == max(map(len, langid.vocabulary(path("piece_bpe_32k.model")))) > 10

    def word(w):  # exact sums in plain Python, in logarithms
        sums = [[0.0] * len(model.names)]
        for j in range(1, len(w) + 1):
            terms = []
            for k in range(1, min(j, longest) + 1):
                i = number.get(w[j - k : j], model.pieces.other if k == 1 else None)
                if i is not None:
                    terms.append([s + math.log(q) for s, q in zip(sums[j - k], model.p[i])])
            sums.append([max(c) + math.log(sum(math.exp(x - max(c)) for x in c)) for c in zip(*terms)])
        return np.array(sums[-1])

    short = sorted(rows, key=lambda i: len(rows[i].text or ""))[:25]
    got = {r.doc_id: r.language for r in langid.predict_language(docs.where(F.col("doc_id").isin(short)), model).collect()}
    for i in short:
        total = model.prior + sum(word("▁" + w) for w in langid.words_of(rows[i].text))
        p = np.exp(total - total.max())
        assert (got[i].lang_pred, got[i].score) == (model.names[int(total.argmax())], pytest.approx(1 / p.sum()))
    long = "x" * 5000 + "ungeheit" * 300
    assert model.words([long])[0] == pytest.approx(word("▁" + long))


def test_samples_are_bounded(spark):
    from vigilis.llm.sample import first_by_hash, texts_of

    rows = spark.createDataFrame([(1, "a")] * 50 + [(i, "a") for i in range(40)] + [(None, "a"), (3, "b"), (4, None)], "doc_id long, lang string")
    taken = first_by_hash(rows, 5, "lang")
    got = taken.where("lang = 'a'").count(), taken.where("lang = 'b'").count()
    assert got == (5, 1)
    docs = rows.select("doc_id", F.concat(F.lit("t"), F.rand(1).cast("string")).alias("text"))
    assert len(texts_of(docs, taken)) == taken.count()


def test_language_held_out(spark):
    data = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in queries.op6_language(spark, data).collect()}
    held = [(r.lang, out[r.doc_id]) for r in spark.read.parquet(f"{data}/documents.parquet").collect() if out[r.doc_id].held_out]
    assert all(o.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, o in out.items())
    assert np.mean([a == o.lang_pred for a, o in held]) > 0.97


def test_language_odd(odd, empty):
    model = langid.fit_languages(odd, F.lit(True), path("piece_bpe_32k.model"))
    out = {r.doc_id: r.language for r in langid.predict_language(odd, model).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (0, 1, 2, 8))
    assert out[4].lang_pred == "en"
    none = langid.fit_languages(empty, F.lit(True), path("piece_bpe_32k.model"))
    assert {r.language.lang_pred for r in langid.predict_language(odd, none).collect()} == {"und"}


# line rules


def test_line_rules(spark, rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    limit = {"max_docs": 2}
    got = {r.doc_id: r for r in line_rules.line_frequency(spark.read.parquet(f"{DATA}/documents.parquet"), **limit).collect()}
    norm = {i: [x for x in (" ".join(word.findall(line)).lower() for line in (r.text or "").split("\n")) if x] for i, r in rows.items()}
    seen = Counter((rows[i].source, x) for i, own in norm.items() for x in set(own))
    for i, r in rows.items():
        text, o = r.text or "", got[i]
        words = word.findall(text)
        at = defaultdict(list)
        for k in range(len(words) - 7):
            at[tuple(words[k : k + 8])].append(k)
        repeat = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
        lines = [x for x in text.split("\n") if word.search(x)]
        failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
        gone = sum(len(x) for x in norm[i] if seen[r.source, x] > 2)
        want = (len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(repeat), failed, gone, not failed and not 2 * gone > sum(map(len, norm[i])))
        assert (o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words, o.base_failed, o.removed_chars, o.kept) == want


def test_line_rules_stay_native(spark):
    plan = queries.op7_line_frequency(spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_line_rules_odd(odd, empty):
    out = line_rules.line_frequency(odd).collect()
    assert len(out) == odd.count()
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in out if r.doc_id in (0, 1, 2))
    assert line_rules.line_frequency(empty).count() == 0


def test_line_rules_cut_common_lines(spark):
    own = [(i, f"First  of {i}\n  ALL rights\treserved \n\nLast of {i}", "a") for i in range(4)] + [(9, "all rights reserved", "b"), (10, None, "a"), (11, "All rights reserved", "a")]
    docs = spark.createDataFrame([*own, own[0]], "doc_id long, text string, source string")
    out = line_rules.line_frequency(docs, max_docs=3).collect()
    got = {r.doc_id: (r.text, r.removed_chars) for r in out}
    assert len(out) == 8
    assert got == {i: (f"First  of {i}\n\nLast of {i}", 19) for i in range(4)} | {9: ("all rights reserved", 0), 10: (None, 0), 11: ("", 19)}


def test_line_rules_count_distinct_documents(spark):
    text = "\n".join(" ".join(f"word{k}{i}" for i in range(8)) for k in range(4))
    docs = spark.createDataFrame([*[(1, text, "a")] * 11, *[(None, text, "b")] * 11, *[(None, f"{text}\n{k}", "c") for k in range(11)]], "doc_id long, text string, source string")
    out = line_rules.line_frequency(docs).collect()
    assert len(out) == 33 and sum(r.kept for r in out) == 22
    assert all(bool(r.removed_chars) != r.kept for r in out)


# spans


def test_spans_keep_first_occurrence(spark):
    a = "Alpha beta gamma delta epsilon zeta eta. Theta iota kappa lambda mu nu xi. Omicron pi rho sigma tau upsilon phi."
    docs = spark.createDataFrame([(3, "Other start of this one here. " + a + " Own end of the third document."), (1, a), (2, "Nothing in common with the others at all, truly."), (9, a), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.removed) for r in span_dedup.remove_repeats(docs).collect()}
    assert got[1] == (a, 0) and got[2][1] == 0 and got[4] == (None, 0)
    assert got[3] == ("Other start of this one here. Own end of the third document.", 3)
    assert got[9] == ("", 3)


def test_spans_brute_force(spark, rows):
    out = {r.doc_id: r for r in queries.op9_repeated_spans(spark, DATA).collect()}
    first, rule = {}, span_dedup.Rule()
    for i in sorted(rows):
        own = rule.sentences(rows[i].text or "")
        gone = set()
        for j in range(len(own)):
            k = next((k for k in range(j + 2, len(own) + 1) if sum(len(w) for _, _, w in own[j:k]) >= rule.least_words), None)
            if k is not None and first.setdefault(tuple(w for _, _, ws in own[j:k] for w in ws), (i, j)) != (i, j):
                gone.update(range(j, k))
        text = rows[i].text if not gone else "".join(rows[i].text[a:b] for j, (a, b, _) in enumerate(own) if j not in gone).strip()
        assert (out[i].text, out[i].n_removed, out[i].repeated) == (text, len(gone), bool(gone))


def test_sentences_cover_text():
    for t in ("a b. c d! e", "no end", "x\n\n y.", "w " * 500, "1. 2. 3.", "一。二！ 三", LONG[:500]):
        own = span_dedup.Rule().sentences(t)
        assert " ".join(w for _, _, ws in own for w in ws).replace("。 ", "。").replace("！ ", "！") == " ".join(t.lower().split()).replace("！ ", "！")
        assert all(own[i][1] <= own[i + 1][0] for i in range(len(own) - 1))


@pytest.mark.parametrize("least,most", [(4, 9), (15, 24), (20, 40)])
def test_spans_find_passages_of_51_words(least, most):
    rng, rule = np.random.default_rng(least), span_dedup.Rule()
    words = np.array(["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(3000)])

    def prose(n):
        out = []
        while len(out) < n:
            out += [*rng.choice(words, rng.integers(least, most + 1)), ""]
            out[-2:] = [out[-2] + "."]
        return out

    missed = 0
    for _ in range(200):
        one, two = prose(300), prose(60)
        at = rng.integers(20, 200)
        passage = one[at : at + 51]
        wrapped = " ".join(passage).split(" ")
        wrapped[rng.integers(1, 50)] += "\n"  # wrapped at another column
        own = {h for h, _ in rule.spans(" ".join(one))[1]}
        missed += own.isdisjoint(h for h, _ in rule.spans(" ".join(two[:20] + wrapped + two[20:]))[1])
        assert own.isdisjoint(h for h, _ in rule.spans(" ".join(prose(300)))[1])
    assert missed <= 2


def test_spans_odd(odd, empty):
    out = span_dedup.remove_repeats(odd, removed="gone")
    assert out.columns == [*odd.columns, "gone"] and out.count() == odd.count()
    assert {(r.removed, r.place, r.row, r.doc) for r in out.collect()} == {(1, 2, "r", 7)}
    assert span_dedup.remove_repeats(odd).columns == [*[c for c in odd.columns if c != "removed"], "removed"]
    assert span_dedup.remove_repeats(empty).count() == 0


# contamination


def edit_distance_in(item, doc):
    prev = [0] * (len(doc) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(doc, 1):
            new.append(min(prev[j - 1] + (x != y), prev[j] + 1, new[j - 1] + 1))
        prev = new
    return min(prev)


def test_decontamination_finds_all_within_budget(spark):
    rng = np.random.default_rng(8)
    letters = list("abcdefghij     ")
    text = lambda n: " ".join("".join(rng.choice(letters, n)).split())
    items = [text(n) for n in (40, 90, 150, 220)] + ["tiny", ""]
    docs = []
    for k in range(60):
        t = items[k % 4]
        edits = int(rng.integers(0, 14))
        own = list(t)
        for at in rng.choice(len(own), min(edits, len(own)), replace=False):
            own[at] = {0: "", 1: "z", 2: own[at] + "q"}[int(rng.integers(3))]
        docs.append((k, text(150) + " " + "".join(own) + " " + text(100)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: {h.item_id: h for h in r.hits} for r in decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    index = decontaminate.Index(list(range(6)), [decontaminate.plain(t) for t in items])
    for k, t in docs:
        for i in range(4):
            best = edit_distance_in(decontaminate.plain(items[i]), decontaminate.plain(t))
            assert (i in got[k]) == (best <= index.budget[i])
            if i in got[k]:
                assert got[k][i].edits == best


def test_decontamination_of_repeated_words():
    """Time and memory stay bounded where nearly all q-grams are the same; the occurrence is found, exact or with edits."""
    import time
    import tracemalloc

    item = b" ".join([b"word"] * 150)
    edited = item[:300] + b"x" + item[301:]
    index = decontaminate.Index([1, 2], [item, edited])
    for n in (3_000, 12_000):
        begin = time.time()
        tracemalloc.start()
        found = {h[0]: h for h in index.search("word " * n)}
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found[1][3] == 0 and found[2][3] == 1
        assert peak < 120e6 and time.time() - begin < 30
    hidden = "other " * 2_000 + edited.decode() + " tail" * 2_000
    (hit,) = [h for h in index.search(hidden) if h[0] == 2]
    assert hidden[hit[1] : hit[2]] == edited.decode() and hit[3] == 0


@pytest.mark.parametrize("chunk", [1, 7, 1 << 18])
def test_decontamination_chunks_change_nothing(chunk, monkeypatch):
    """However few hits are counted at a time, and however narrow the parts of a stretch are, the hits are the same."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("ab"), rng.integers(1, 4))) for _ in range(12)]
    items = [" ".join(rng.choice(words, 60)).encode() for _ in range(4)]
    texts = []
    for _ in range(12):
        own = bytearray(items[rng.integers(4)])
        for _ in range(rng.integers(0, 9)):
            own[rng.integers(len(own))] = ord("c")
        texts.append(" ".join(rng.choice(words, 30)) + " " + own.decode() + " " + " ".join(rng.choice(words, 30)))
    index = decontaminate.Index(list(range(4)), items)
    want = [{h[0]: h[3] for h in index.search(t)} for t in texts]
    monkeypatch.setattr(decontaminate, "HITS_AT_ONCE", chunk)
    monkeypatch.setattr(decontaminate, "DIAGONALS", 16)
    assert [{h[0]: h[3] for h in index.search(t)} for t in texts] == want
    for t, own in zip(texts, want, strict=True):
        for i, item in enumerate(items):
            best = edit_distance_in(item, decontaminate.plain(t))
            assert own.get(i) == (best if best <= index.budget[i] else None)


def test_decontamination_data(spark, rows):
    bench = {r.item_id: decontaminate.plain(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    want = {(i, k) for i, r in rows.items() for k, t in bench.items() if t in decontaminate.plain(r.text)}
    got = {(r.doc_id, k) for r in queries.op10_decontaminate(spark, DATA).collect() for k in r.item_ids}
    assert want and want <= got


def test_decontamination_blocks_and_odd(spark, odd, empty, monkeypatch):
    bench = spark.createDataFrame([(1, "One two three four five six seven eight nine ten"), (None, None), (2, ""), (None, "eleven TWELVE thirteen, fourteen fifteen")], "item_id long, text string")
    whole = {r.doc_id: r.hits for r in decontaminate.find_contamination(odd, bench).collect()}
    assert len(whole[4]) == 2 and not whole[0] and not whole[1]
    assert len(list(decontaminate.blocks_of(bench, 30))) > 1
    some = decontaminate.find_contamination(odd, bench, block_bytes=30)
    assert some.columns == [*[c for c in odd.columns if c != "hits"], "hits", "contaminated"]
    assert {r.doc_id: sorted(r.hits, key=str) for r in some.collect()} == {k: sorted(v, key=str) for k, v in whole.items()}
    assert some.count() == odd.count()
    assert decontaminate.find_contamination(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_contamination(empty, bench).count() == 0
    built = spark.sparkContext.accumulator(0)

    class Counted(decontaminate.Index):
        def __post_init__(self):
            built.add(1)
            super().__post_init__()

    monkeypatch.setattr(decontaminate, "Index", Counted)
    one = odd.coalesce(1)
    for n in (4 << 20, 30):
        built.value = 0
        decontaminate.find_contamination(one, bench, block_bytes=n).count()
        # an index is built once for each block in a worker, not for each batch
        assert built.value <= 2 * len(list(decontaminate.blocks_of(bench, n)))
    out = decontaminate.find_contamination(odd, bench, block_bytes=30, hits="found", flag="bad")
    assert out.columns == [*odd.columns, "found", "bad"] and {(r.hits, r.k1, r.row) for r in out.collect()} == {("h", 5, "r")}


# pipeline


def similar_roots(texts):
    """Smallest id reachable over pairs that share eight tenths of their five-word shingles, by all pairs."""
    sets = {}
    for i, t in texts.items():
        own = [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w]
        sets[i] = {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()
    root = {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x == y or 10 * len(x & y) >= 8 * len(x | y):
            p, q = root[a], root[b]
            if p != q:
                root = {k: min(p, q) if v in (p, q) else v for k, v in root.items()}
    return root


def test_pipeline_stages(spark, docs, rows):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in kept.collect()}
        kept = common.written(stage(spark, kept, DATA), "stage")
        after = {r.doc_id: r for r in kept.collect()}
        assert kept.columns == docs.columns and set(after) <= set(before) and len(after) == kept.count()
        if name == "near_duplicates":
            assert set(after) == set(similar_roots({i: r.text for i, r in before.items()}).values())
        if name == "repeated_spans":
            assert all(r.text for r in after.values())
        if name == "decontaminated":
            bench = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert not any(t in decontaminate.plain(r.text) for r in after.values() for t in bench)
    out = corpus_pipeline.STAGES[-1][1](spark, kept, DATA).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in kept.collect()}
    check_packing(out, 4096)
    assert len(corpus_pipeline.run(spark, DATA).collect()) == len(out)


def test_pipeline_links_all_at_eight_tenths(spark):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(3000)])
    texts = {}
    for k in range(60):
        base = rng.choice(words, 300)
        other = base.copy()
        at = rng.choice(300, 1 + k % 12, replace=False)
        other[at] = rng.choice(words, len(at))
        texts |= {2 * k: " ".join(base), 2 * k + 1: " ".join(other)}
    sets = {i: set(zip(*[t.split()[j:] for j in range(5)], strict=False)) for i, t in texts.items()}
    want = {i for i in texts if i % 2 == 0 or 10 * len(sets[i] & sets[i - 1]) < 8 * len(sets[i] | sets[i - 1])}
    assert 60 < len(want) < 100
    made = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, made, DATA).collect()} == want


def near_copies(n, changed, seed=7):
    """``n`` texts of 100 words, each with ``changed`` words of one text replaced."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for k in range(n):
        own = list(base)
        for j, at in enumerate(rng.choice(100, changed, replace=False)):
            own[at] = f"x{k}y{j}"
        texts.append(" ".join(own))
    return texts


def test_near_copies_are_not_all_compared(spark, monkeypatch):
    """Copies on either side of the limit: most are apart, and pairs that can't be links don't leave a join."""
    seen, verify = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda pairs, *rest: seen.append(common.written(pairs, "p")) or verify(seen[-1], *rest))
    texts = near_copies(300, 2)
    got = {r.doc_id: r.component for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    roots = similar_roots(dict(enumerate(texts)))
    classes = lambda of: {frozenset(i for i in of if of[i] == r) for r in set(of.values())}
    assert classes(got) == classes(roots) and len(classes(got)) < 300
    assert sum(p.count() for p in seen) < 300 * 12


def test_fingerprints_propose_sets(spark, monkeypatch):
    """Without minima, sets whose fingerprints are within four bits are still met, and linked by their shingles alone."""
    monkeypatch.setattr(simhash, "bands", lambda own: np.empty(0, np.int64))
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base, "end"]), " ".join(["begin", *base]), "all by itself", None]
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts[:3]]
    assert all((simhash.fingerprint(sets[0]) ^ simhash.fingerprint(x)).bit_count() <= 4 for x in sets)
    got = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    classes = {r.doc_id: r.component for r in got}
    assert classes[0] == classes[1] == classes[2] and len(set(classes.values())) == 3


def test_pipeline_keeps_unique_text_of_shared_id(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in "ab")
    rows = [(1, one), (5, one + " end"), (5, two), (5, two), (6, two), (7, "all by itself"), (7, "another by itself")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect())
    assert kept == [(1, one), (5, two), (7, "all by itself"), (7, "another by itself")]


@pytest.mark.parametrize("k", range(5))
def test_pipeline_odd(spark, odd, empty, k):
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, odd, DATA)
    assert out.count() >= 0
    if k < 4:
        assert out.columns == odd.columns
        assert all((r.score, r.removed, r.hits, r.language, r.row, r.doc) == ("clash", 1, "h", "l", "r", 7) for r in out.collect())
    assert stage(spark, empty, DATA).count() == 0
