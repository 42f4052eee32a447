"""Texts are read, and patterns run over them, no more often than needed."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vigilis.functions import unicode
from vigilis.functions.text import fold_digits
from vigilis.operators import abbreviations, dedup, scoring, textjobs

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_digits_of_plain_texts_are_left_alone(spark):
    df = spark.createDataFrame([("12",), ("١٢",), ("é1",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(fold_digits(F.col("t"))).collect()] == ["12", "12", "é1", "", None]
    assert "octet_length" in plan(df.select(fold_digits(F.col("t"))))


@pytest.mark.parametrize("text", ["WHO confirmed it", "who\tconfirmed", "ŴHO wHo", "İn 2020", "whom", "swho", "NO NEW CASES", "\x1cno case\x1c", "KaſuS baru", "", None])
def test_phrases_of_plain_texts(spark, text):
    """The quick test of ASCII texts and the full one agree."""
    df = spark.createDataFrame([(text,)], "t string")
    every = [p for kinds in textjobs.PHRASES.values() for _, p in kinds]
    quick, full = ([f(p).alias(str(i)) for i, p in enumerate(every)] for f in (lambda p: textjobs.has_phrase(F.col("t"), p), lambda p: F.coalesce(F.col("t").rlike(textjobs.phrase_pattern(p)), F.lit(False))))
    assert df.select(*quick).first() == df.select(*full).first()


def test_dates_run_each_pattern_once(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id int, text string").withColumn("published_at", F.current_date())
    assert plan(textjobs.event_period(docs)).count("regexp_extract(text") == 5


def test_numbers_are_cut_once(spark):
    assert plan(entry.queries()["tx5_filter_counts"](spark, DATA)).count("regexp_extract_all(") == 1


def test_relations_read_the_lines_twice(spark):
    df = entry.queries()["tx6_relations"](spark, DATA)
    assert df._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet") == 2


@pytest.mark.parametrize("few", [1000, 0])
def test_mentions_broadcast_no_texts(spark, tmp_path, monkeypatch, few):
    """Texts made from ids look small to the planner; only a small lexicon is broadcast."""
    monkeypatch.setattr(textjobs, "FEW", few)
    spark.range(60).write.parquet(str(tmp_path / "ids"))
    docs = spark.read.parquet(str(tmp_path / "ids")).select(F.col("id").alias("doc_id"), F.concat(F.lit("of the "), F.col("id")).alias("text"))
    out = textjobs.mentions(docs, spark.createDataFrame([("the", "A"), ("of the", "B"), ("7", "C")], "alias string, concept string"))
    p = out._jdf.queryExecution().executedPlan().toString()
    broadcast = [b.split("FileScan")[0] for b in p.split("BroadcastExchange")[1:] if "FileScan" in b]
    assert all("Scan ExistingRDD" in b or "LocalTableScan" in b for b in broadcast)
    assert ("BroadcastExchange" in p) == (few > 0)
    assert sorted((r.doc_id, r.start, r.concept) for r in out.collect()) == sorted([*[(i, 0, "B") for i in range(60)], (7, 2, "C")])


def test_runs_are_counted_without_their_texts(spark):
    """Distinct texts of a run are told within a text, so runs and ids aren't shuffled together; ids that come twice count once."""
    docs = spark.createDataFrame([(1, "a b a b"), (2, "a b"), (3, "a b c"), (4, None), (5, "")], "doc_id int, text string")
    lex = spark.createDataFrame([("c", "C")], "alias string, concept string")
    out = textjobs.discover_terms(docs, lex, least=2)
    assert "distinct" not in plan(out)
    want = {"a": (4, 3, 1), "b": (4, 3, 1), "a b": (4, 3, 1)}
    assert {r.term: (r.n, r.docs, r.first_doc) for r in out.collect()} == want
    again = docs.union(spark.createDataFrame([(3, "c a b")], docs.schema))
    assert {r.term: (r.n, r.docs, r.first_doc) for r in textjobs.discover_terms(again, lex, least=2).collect()} == {"a": (5, 3, 1), "b": (5, 3, 1), "a b": (5, 3, 1)}


@pytest.mark.parametrize("text", ["It's A_b 12", "  ", "\tx\n", "Éa-ŉ Ǆ 東京", "K\u212a", ""])
def test_words_of_plain_texts(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    full = F.filter(F.split(textjobs.alias_key(F.col("t")), " "), lambda w: w != "")
    assert df.select(textjobs.words(F.col("t"))).first()[0] == df.select(full).first()[0]


def test_sentences_and_evidence_shuffle_no_texts(spark):
    texts = ["  A 7 cases in town.\n\n 12 deaths were seen there!  ", "", None, "x", " \t\n ", "In 3.5 weeks 9 cases; meanwhile 4 deaths came. Ok"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = textjobs.sentences(docs)
    one = textjobs.text_evidence(docs, "cases|deaths", 1)
    assert all(x not in plan(df) for df in (found, one) for x in ("Window", "Aggregate"))
    rows = found.collect()
    assert all(r.text == texts[r.doc_id][r.start : r.end] == r.text.strip(" \t\n\x0b\f\r") != "" for r in rows)
    assert [(r.doc_id, r.sentence) for r in rows] == [(0, 0), (0, 1), (3, 0), (5, 0), (5, 1), (5, 2)]
    assert sorted(map(tuple, one.collect())) == sorted(tuple(r) for r in textjobs.evidence(found, "cases|deaths", 1).collect())
    assert {r.doc_id for r in one.collect()} == {0, 5}


def test_labels_are_ranked_in_order(spark):
    """Neither labels nor groups of rows are held in tables of their own."""
    rows = [(1, "b", 5, False), (1, "b", 2, True), (1, "a", 2, False), (1, "n", 0, True), (1, "g", 1, False), (2, "g", 3, False), (2, "g", None, False), (None, "a", 1, False)]
    out = textjobs.rank_labels(spark.createDataFrame(rows, "doc_id int, label string, pos int, negated boolean"), ["g"])
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "a", 1), (1, "b", 2), (2, "g", 1), (None, "a", 1)], key=repr)
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_scopes_are_counted_in_order(spark):
    assert "Aggregate" not in entry.queries()["tr8_backfill_scope"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_alerts_keep_no_labels(spark):
    assert "distinct" not in plan(entry.queries()["fp26_decide_alert"](spark, DATA))


def test_keys_of_identities_are_made_once(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "b", "x"), (4, "", None)], "id int, t string, u string").withColumn("t", F.sha2("t", 256))
    links = dedup.identity_links(df, "id", ["t", "u"])
    assert "sha2" not in plan(links)
    assert sorted((r.a, r.b) for r in links.where("a <> b").collect()) == [(2, 1), (3, 1)]


def test_shapes_cut_a_text_once(spark):
    """Words and lines are columns of their own before the numbers of a text's build."""
    docs = spark.createDataFrame([(1, "It's é 12 x\n\n$ ab"), (2, None)], "doc_id int, text string")
    out = scoring._featured(docs, "doc_id")
    assert plan(out).count("lambdafunction(") == 2  # of words and of lines, each once
    found = out.select("doc_id", vector_to_array("__shape").alias("s")).collect()
    assert round(found[0].s[6] * 17) == 7 and found[1].s[6] == 0  # letters


def test_few_mentions_are_met_in_the_scan(spark):
    docs = spark.createDataFrame([(1, "Of the of"), (2, "de la Café the of"), (3, None), (4, "cafe")], "doc_id int, text string")
    lex = spark.createDataFrame([("of the", "A"), ("of", "B"), ("café", "C"), ("de la cafe", "D"), ("the of x", "E")], "alias string, concept string")
    out = textjobs.mentions(docs, lex)
    assert "Aggregate" not in plan(out) and plan(out).count("Join") == 1
    assert sorted((r.doc_id, r.start, r.end, r.concept) for r in out.collect()) == [(1, 0, 2, "A"), (1, 2, 3, "B"), (2, 0, 3, "D"), (2, 4, 5, "B"), (4, 0, 1, "C")]


def test_short_forms_are_told_within_rows(spark):
    """Texts are sorted for their duplicates alone, told without windows, and read four times, where each use of the short forms read them anew."""
    df = entry.queries()["tx15_geo_uncertain"](spark, DATA)
    assert "Window" not in plan(df)
    assert df._jdf.queryExecution().executedPlan().toString().count("customer.parquet") == 4


@pytest.mark.parametrize("few", [1000, 0])
def test_aliases_within_rows_are_those_of_mentions(spark, monkeypatch, few):
    rng = random.Random(5)
    aliases = sorted({" ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5))) for _ in range(12)})
    texts = [" ".join(rng.choice("abcdé,") for _ in range(rng.randrange(30))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (100, None), (101, "")], "doc_id int, text string")
    lex = spark.createDataFrame([(x, x) for x in [*aliases, ""]], "alias string, concept string")
    want = {}
    for r in textjobs.mentions(docs, lex).collect():
        want.setdefault(r.doc_id, []).append(r.concept)
    monkeypatch.setattr(textjobs, "FEW", few)
    rows = textjobs.with_mentions(docs, lex, "found").collect()
    assert len(rows) == 62 and {r.doc_id: sorted(r.found) for r in rows if r.found is not None} == {k: sorted(v) for k, v in want.items()}
    assert textjobs.with_mentions(docs, lex.limit(0), "found").where("found is not null").count() == 0


def test_many_aliases_of_a_text_take_time_in_proportion(spark):
    docs = spark.createDataFrame([(1, "of the " * 200_000)], "doc_id int, text string")
    lex = spark.createDataFrame([("of the of",), ("the",), ("of",)], "alias string")
    out = textjobs.with_mentions(docs, lex, "found").where("found is not null").select(F.size("found"))
    assert out.first()[0] == 200_000  # each "of the of", and the last "the"


def test_places_of_one_name_are_told_by_their_ids(spark):
    """Of two places with the name that a text has, the smaller place_id; forms that are one but for signs stand for both places."""
    places = [(7, "Ulu", "B", None, None, 1, ["x.y"], None), (3, "Ulu", "A", None, None, 1, ["x y"], None), (9, "Hilir", "A", None, None, 1, ["hl"], None), (9, "Hilir", "A", None, None, 1, ["hl"], None)]
    places = spark.createDataFrame(places, "place_id long, canonical string, country string, admin1 string, admin2 string, level int, aliases array<string>, cues array<string>")
    docs = spark.createDataFrame([(1, "Ulu: X-Y", None), (2, "Hilir, Ulu, Ulu", None)], "doc_id int, text string, country_hint string")
    assert {r.doc_id: r.scope.place_id for r in abbreviations.text_scope(docs, places).collect()} == {1: 3, 2: 3}
    assert sorted(map(tuple, abbreviations.resolve_abbreviations(docs, places).collect())) == [(1, "x y", 3), (1, "x.y", 7)]


def test_marks_of_each_text_of_an_array(spark):
    texts = ["É", "ｘ；ｙ", None, "ệ ½", "a\x01b", ""]
    df = spark.createDataFrame([(texts,), (["é"],), ([],), (None,)], "ts array<string>")
    one = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(unicode.strip_marks(F.col("t"))).collect()]
    assert [r[0] for r in df.select(unicode.strip_marks_each(F.col("ts"))).collect()] == [one, ["e"], [], None]
