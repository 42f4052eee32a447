"""Unicode forms, unspaced scripts, running sums, trees, identity classes and bucketed sinks against plain Python."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from vigilis.functions import text, unicode
from vigilis.operators import dedup, lookup, prefix, scripts, textjobs, tree
from vigilis.streaming import buckets, jobs

TEXTS = ["plain", "España Cancún Curaçao Škoda", "e\u0301a\u0300", "ﬁne Ａ１", "한글 \u1112\u1161\u11ab", "Đà Nẵng Łódź øß", "กำ ไข้", "a\u0327\u0301", "\u00a0x\u3000y ", "", None, "①½ ǅ", "क़", "́leading"]


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
def test_normal_forms(spark, form):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    got = {r.id: r.t for r in df.select("id", unicode.normal_form(F.col("t"), form).alias("t")).collect()}
    assert got == {i: None if t is None else unicodedata.normalize(form, t) for i, t in enumerate(TEXTS)}


def test_most_texts_stay_in_the_engine():
    """The quick test passes ordinary texts and no text that a form changes."""
    import re

    for form in ("NFC", "NFKC"):
        own = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", unicode.unsettled(form)))
        assert not own.search("Ordinary text, señor: Größe über Straße 12,5 % – “quoted” 登革热 โรคไ")
        for p in range(0, 0x30000, 7):
            c = chr(p)
            if not 0xD800 <= p <= 0xDFFF and unicodedata.normalize(form, c) != c:
                assert own.search(c), hex(p)


def test_accents(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    got = {r.id: r.t for r in df.select("id", unicode.strip_marks(F.col("t")).alias("t")).collect()}
    assert got == {i: None if t is None else unicode.without_marks(t) for i, t in enumerate(TEXTS)}
    assert df.where("id = 1").select(text.fold_accents(F.col("t"))).first()[0] == "espana cancun curacao skoda"
    plain = df.where("id = 0").select(text.fold_accents(F.lit("úçñýšžőŕ")).alias("t")).first().t
    assert plain == "ucnyszor"


def test_hashes_are_of_nfkc(spark):
    df = spark.createDataFrame([("Ａ１\u3000ﬁ",), ("A1 fi",), (" ",)], "t string")
    a, b, c = [r[0] for r in df.select(text.content_hash(F.col("t"))).collect()]
    assert a == b and c is None


LEX = [("ไข้เลือดออก", "dengue"), ("โรคไข้เลือดออกรุนแรง", "severe"), ("登革热", "dengue"), ("登革", "short"), ("ໄຂ້ຍຸງລາຍ", "dengue"), ("គ្រុនឈាម", "dengue"), ("သွေးလွန်", "dengue"), ("b型肝炎", "hepatitis"), ("México", "mx"), ("x", "none")]


def brute_mentions(rows):
    key = lambda t: " ".join("".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in unicode.without_marks(t.lower())).split())
    import re

    unspaced = re.compile("[\u0e00-\u0e7f\u0e80-\u0eff\u1780-\u17ff\u1000-\u109f\u3040-\u30ff\u4e00-\u9fff]")
    out = []
    for i, t in rows:
        t, spans = key(t or ""), []
        for alias, concept in LEX:
            k = key(alias)
            if len(k) < 2 or not unspaced.search(k):
                continue
            for s in range(len(t) - len(k) + 1):
                edge = (t[s - 1] if s else " ") + (t[s + len(k)] if s + len(k) < len(t) else " ")
                if t[s : s + len(k)] == k and not re.search("[a-z0-9]", edge):
                    spans.append((s, s + len(k), concept))
        out += [(i, *x) for x in spans if not any(y[0] <= x[0] and y[1] >= x[1] and y[:2] != x[:2] for y in spans)]
    return sorted(out)


def test_unspaced_mentions(spark):
    rng = random.Random(4)
    parts = [x for x, _ in LEX] + ["ผู้ป่วย", "病例", " ", "a", "9", ", ", "เพิ่ม", "ຢູ່"]
    rows = [(i, "".join(rng.choices(parts, k=6))) for i in range(300)] + [(900, None), (901, ""), (902, "登革热" * 500), (903, "a登革热"), (904, "登革热9"), (905, "登")]
    lex = spark.createDataFrame(LEX, "alias string, concept string")
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    for q in (2, 3):
        got = sorted((r.doc_id, r.start, r.end, r.concept) for r in scripts.unspaced_mentions(docs, lex, q=q).collect())
        want = [r for r in brute_mentions(rows) if q == 2 or r[3] != "short"]
        if q == 3:  # an alias of two characters isn't found
            assert {r for r in got} >= {r for r in want if r[3] != "short"}
        else:
            assert got == want
    assert scripts.unspaced_mentions(docs.limit(0), lex).count() == 0


@pytest.mark.parametrize("few", [1000, 0])
def test_unspaced_mentions_send_no_texts_to_the_driver(spark, tmp_path, monkeypatch, few):
    """Texts made from ids look small to the planner; they are read once with a small lexicon and shuffled with a large one."""
    monkeypatch.setattr(scripts, "FEW", few)
    spark.range(300).write.parquet(str(tmp_path / "ids"))
    docs = spark.read.parquet(str(tmp_path / "ids")).select(F.col("id").alias("doc_id"), F.concat(F.lit("พบ"), F.element_at(F.array(*[F.lit(a) for a, _ in LEX]), (F.col("id") % len(LEX) + 1).cast("int"))).alias("text"))
    out = scripts.unspaced_mentions(docs, spark.createDataFrame(LEX, "alias string, concept string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("FileScan"), plan.count("BroadcastHashJoin")) == ((1, 1) if few else (2, 0))
    want = brute_mentions([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((r.doc_id, r.start, r.end, r.concept) for r in out.collect()) == sorted(want)


def test_index_takes_the_rarest(spark):
    lex = spark.createDataFrame([("甲乙丙", "a"), ("甲乙丁", "b"), ("丁甲乙", "c")], "alias string, concept string")
    got = {r.concept: (r.gram, r.k) for r in scripts.gram_index(lex, 2).collect()}
    assert got == {"a": ("乙丙", 1), "b": ("乙丁", 1), "c": ("丁甲", 0)}


def test_mentions_without_accents(spark):
    docs = spark.createDataFrame([(1, "En México y BOGOTÁ"), (2, "mexico")], "doc_id int, text string")
    lex = spark.createDataFrame([("Mexico", "mx"), ("Bogotá", "co")], "alias string, concept string")
    assert sorted((r.doc_id, r.concept) for r in textjobs.mentions(docs, lex).collect()) == [(1, "co"), (1, "mx"), (2, "mx")]


@pytest.mark.parametrize("ranges", [1, 2, 40])
def test_running_sums(spark, ranges):
    rng = random.Random(ranges)
    rows = [(i, rng.choice([5, 5, 5, rng.randrange(100), None]), rng.choice([None, rng.randrange(9)])) for i in range(800)]
    got = {r.id: r.s for r in prefix.running_sum(spark.createDataFrame(rows, "id long, v int, w int"), "v", "id", F.col("w"), "s", ranges).collect()}
    want, total = {}, 0
    for i, v, w in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        total += w or 0
        want[i] = total
    assert got == want
    empty = spark.createDataFrame([], "id long, v int, w int")
    assert prefix.running_sum(empty, "v", "id", F.col("w"), "s", ranges).count() == 0


def test_running_sums_have_no_single_task(spark):
    """Rows are in many partitions, also those of a value that a third of them has; only the totals meet in one."""
    df = spark.range(30_000).withColumn("v", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix.ranged(df, "v", "id", 32, "r").groupBy("r").count().collect()
        assert max(r["count"] for r in got) < 3 * 30_000 / 32
        plan = prefix.ranks(df, "v", "id", "n", 32)._jdf.queryExecution().toString()
        assert plan.count("hashpartitioning(__range") >= 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert prefix.ranks(df, "v", "id", "n", 32).agg(F.sum("n"), F.count_distinct("n")).first() == (30_000 * 29_999 // 2, 30_000)


def test_admin_tree(spark):
    rows = [(1, None, "Indonesia"), (2, 1, "Jawa Barat"), (3, 2, "Kota Bandung"), (4, 3, "Cicendo"), (5, 1, "Jawa Timur"), (6, None, "Thailand"), (7, 6, "Bangkok"), (8, 99, "orphan"), (9, 2, "Depok")]
    got = {r.place_id: r for r in tree.admin_tree(spark.createDataFrame(rows, "place_id long, parent_id long, name string")).collect()}
    assert 8 not in got and {i: r.level for i, r in got.items()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 1, 6: 0, 7: 1, 9: 2}
    assert (got[4].country, got[4].admin1, got[4].admin2) == ("Indonesia", "Jawa Barat", "Kota Bandung")
    assert (got[2].admin1, got[2].admin2, got[1].admin1) == ("Jawa Barat", None, None)
    parent = {i: p for i, p, _ in rows}

    def above(i):
        return set() if parent.get(i) is None else {parent[i]} | above(parent[i])

    for i, x in got.items():
        for j, y in got.items():
            assert (y.first < x.first <= y.last) == (j in above(i)), (i, j)
    assert sorted(r.first for r in got.values()) == list(range(8))
    assert tree.admin_tree(spark.createDataFrame([], "place_id long, parent_id long, name string")).count() == 0
    with pytest.raises(ValueError):
        tree.admin_tree(spark.createDataFrame([(i, i - 1 if i else None, "x") for i in range(12)], "place_id long, parent_id long, name string"))


def test_place_levels(spark):
    rows = [(1, None, "Indonesia"), (2, 1, "Jawa Barat"), (3, 2, "Bandung"), (6, None, "Việt Nam"), (7, 6, "Hà Nội"), (8, 6, "Bandung")]
    places = spark.createDataFrame(rows, "place_id long, parent_id long, name string")
    own = tree.admin_tree(places).join(places.drop("parent_id"), "place_id")
    asked = spark.createDataFrame([(1, "BANDUNG", "Indonesia"), (2, "bandung", "viet nam"), (3, "Ha Noi", "Indonesia"), (4, "nowhere", None), (5, None, "x"), (6, "Bandung", None)], "k int, place string, country string")
    got = {r.k: (r.found and r.found.place_id, r.found and r.found.level, r.needs_review) for r in tree.place_levels(asked, own, "place").collect()}
    assert got[1] == (3, 2, False) and got[2][:2] == (8, 1) and got[3] == (7, 1, True) and got[4][2] and got[5][2] and got[6] == (8, 1, False)


def test_identity_classes_are_linear(spark):
    new = spark.range(1000).select("id", F.lit("same").alias("a"), F.lit(None).cast("string").alias("b"))
    old = spark.range(1000).select("id", F.lit("same").alias("a"), F.lit("").alias("b"))
    got = lookup.identity_classes(new, old, ["a", "b"])
    assert got.count() == 2000
    assert got.select("class_id", "n_new", "n_old").distinct().collect() == [(0, 1000, 1000)]


def test_identity_chains(spark):
    new = spark.createDataFrame([(1, "p", None), (2, None, "q"), (3, "z", "z1"), (4, None, None)], "id long, a string, b string")
    old = spark.createDataFrame([(1, "p", "q"), (9, "y", "z2")], "id long, a string, b string")
    got = {(r.side, r.id): (r.class_id, r.n_new, r.n_old) for r in lookup.identity_classes(new, old, ["a", "b"]).collect()}
    assert got[("new", 1)] == got[("new", 2)] == got[("old", 1)] == (2, 2, 1)
    assert got[("new", 3)][1:] == (1, 0) and got[("new", 4)][1:] == (1, 0) and got[("old", 9)][1:] == (0, 1)


def folders(path):
    return {p.relative_to(path).as_posix() for p in path.glob("batch=*/bucket=*")}


def test_bucketed_sink_rewrites_what_it_touches(spark, tmp_path):
    merge = lambda old, new: jobs.replace_by_report(old, new, "k")
    table = buckets.BucketedTable(spark, str(tmp_path / "t"), "k", 16)
    write = buckets.bucketed_sink(table, merge)
    write(spark.range(200).select(F.col("id").alias("k"), F.lit(0).alias("v")), 0)
    first = folders(tmp_path / "t")
    assert len(first) == 16
    write(spark.createDataFrame([(5, 1), (5, 2)], "k long, v int"), 1)
    assert len(folders(tmp_path / "t") - first) == 1
    rows = sorted((r.k, r.v) for r in table.read().collect())
    assert rows == sorted([(k, 0) for k in range(200) if k != 5] + [(5, 1), (5, 2)])
    # delivered again: nothing is written
    before = folders(tmp_path / "t")
    write(spark.createDataFrame([(6, 9)], "k long, v int"), 1)
    assert folders(tmp_path / "t") == before and sorted((r.k, r.v) for r in table.read().collect()) == rows
    # stopped before its commit: nobody sees it, and the next attempt does it
    spark.createDataFrame([(5, 7)], "k long, v int").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "t/batch=2"))
    assert sorted((r.k, r.v) for r in table.read().collect()) == rows
    write(spark.createDataFrame([(5, 3)], "k long, v int"), 2)
    assert sorted((r.k, r.v) for r in table.read().where("k = 5").collect()) == [(5, 3)]
    assert table.clean() == 2 and table.read().count() == 200
    write(spark.createDataFrame([], "k long, v int"), 3)
    assert table.read().count() == 200


def test_capture_sink_is_bucketed(spark, tmp_path):
    table = buckets.BucketedTable(spark, str(tmp_path / "t"), "hash", 8)
    schema = "text string, language string, label string, type string, confidence double"
    write = buckets.bucketed_sink(table, jobs.capture_merge)
    write(spark.createDataFrame([("a", "en", "l", "t", 0.5), ("b", "en", "l", "t", 0.6)], schema).transform(jobs.hashed_examples), 0)
    write(spark.createDataFrame([("a", "en", "l", "t", 0.9), ("b", "en", "l", "t", 0.1)], schema).transform(jobs.hashed_examples), 1)
    assert sorted(r.confidence for r in table.read().collect()) == [0.6, 0.9]


def test_discovery_counts_only_runs_of_frequent_words(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{min(rng.randrange(1, 400), rng.randrange(1, 400))}" for _ in range(60))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    lex = spark.createDataFrame([("w1", "c"), ("w2 w3", "c")], "alias string, concept string")
    got = {r.term: (r.n, r.docs, r.first_doc) for r in textjobs.discover_terms(docs, lex, least=4, most=3).collect()}
    runs = {}
    for i, t in rows:
        ws = t.split()
        for n in (1, 2, 3):
            for k in range(len(ws) - n + 1):
                runs.setdefault(" ".join(ws[k : k + n]), []).append(i)
    want = {t: (len(x), len(set(x)), min(x)) for t, x in runs.items() if len(set(x)) >= 4 and t not in ("w1", "w2 w3")}
    assert got == want
    every = sum(59 for _ in rows)
    words = docs.select("doc_id", textjobs.words(F.col("text")).alias("ws"))
    one = textjobs.run_counts(textjobs.runs_of(words, 1, None), 30)
    assert textjobs.runs_of(words, 2, textjobs.compact_filter(one)).count() < every / 2


def test_dedup_keeps_chains(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", "z")], "id long, k1 string, k2 string")
    assert {r.id: r.survivor for r in dedup.dedup_identities(df, "id", ["k1", "k2"], [F.asc("id")]).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_requests_with_odd_rows(spark):
    """Nulls, blank and short terms, words next to letters with accents, signs, repeated rows."""
    from datetime import date

    from vigilis.operators import matching

    day = date(2024, 1, 10)
    reports = [(1, "ÉLA case", None, None, day, None), (2, "la case", None, "http://x", None, "Viet"), (3, None, None, None, day, None), (4, "dengue-la", "c-1 found", None, day, ""), (4, "dengue-la", "c-1 found", None, day, "")]
    reports = spark.createDataFrame(reports, "report_id long, title string, summary string, url string, published_at date, source_country string")
    requests = [(1, ["LA ", "", None], None, None, None), (2, ["dengue", "dengue"], day, day, ""), (3, ["c-1", "++"], None, day, None), (4, ["case"], day, None, "Viet Nam"), (5, None, None, None, None), (6, ["case"], date(2024, 2, 1), None, None)]
    requests = spark.createDataFrame(requests, "request_id long, terms array<string>, since date, until date, country string")
    got = sorted(map(tuple, matching.match_requests(reports, requests).collect()))
    assert got == [(2, 1), (2, 4), (2, 6), (4, 1), (4, 2), (4, 3)]
    assert matching.match_requests(reports.limit(0), requests).count() == 0 and matching.match_requests(reports, requests.limit(0)).count() == 0


def test_short_forms_of_places(spark):
    """Short forms bound by a unique place, a scope, a hint, cues; nulls, repeated rows and empty tables."""
    from vigilis.operators import abbreviations

    places = [
        (1, "Sumatera Selatan", "Indonesia", "Sumatera Selatan", None, 1, ["Sumsel"], None), (2, "Ogan Komering Ulu", "Indonesia", "Sumatera Selatan", "Ogan Komering Ulu", 2, ["OKU", "ulu"], ["Banyuasin"]),
        (3, "Ulu Langat", "Malaysia", "Selangor", None, 2, ["Ulu", "", None], ["Kajang"]), (4, None, None, None, None, None, None, None),
    ]
    places = spark.createDataFrame(places, "place_id long, canonical string, country string, admin1 string, admin2 string, level int, aliases array<string>, cues array<string>")
    docs = [
        (1, "Dinkes Sumsel catat 1.426 kasus", None), (2, "Kabupaten Banyuasin: 85 kasus; Ulu 80", None), (3, "Ulu and Kajang", None), (4, "Ulu", "MALAYSIA"), (5, "Ulu", None), (6, None, "x"), (7, "Sumselan", None),
        (8, "Dinkes Sumatera Selatan: Ulu", None), (8, "Dinkes Sumatera Selatan: Ulu", None), (None, "OKU", None),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string, country_hint string")
    found = abbreviations.resolve_abbreviations(docs, places)
    assert sorted(map(tuple, found.collect())) == [(1, "sumsel", 1), (2, "ulu", 2), (3, "ulu", 3), (4, "ulu", 3), (5, "ulu", None), (8, "ulu", 2)]
    rows = [(1, 5, None, ["Palembang"]), (2, None, 1, ["x / ogan komering ulu"]), (3, 0, 0, []), (5, 1, 0, ["Ulu"]), (6, 3, 0, None)]
    rows = spark.createDataFrame(rows, "doc_id long, cases int, deaths int, resolved array<string>")
    assert sorted(map(tuple, abbreviations.geo_uncertain(rows, found, places).collect())) == [(1, True), (2, False), (3, False), (5, True), (6, False)]
    assert abbreviations.resolve_abbreviations(docs.limit(0), places).count() == 0 and abbreviations.resolve_abbreviations(docs, places.limit(0)).count() == 0
