"""Edge cases by hand: weeks, changes, padding, pages, windows, flags, periods, lineage, trends of semantics that are easy to get wrong."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from vigilis.functions import dates, predicates, text, values
from vigilis.operators import articles, dedup, kpi, lookup, ops, paging, textjobs, training


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize("day,year,week,iso", [("2024-12-29", 2025, 1, "2024-W52"), ("2025-01-04", 2025, 1, "2025-W01"), ("2021-01-02", 2020, 53, "2020-W53"), ("2021-01-03", 2021, 1, "2020-W53"), ("2023-01-01", 2023, 1, "2022-W52")])
def test_weeks(spark, day, year, week, iso):
    d = F.lit(day).cast("date")
    assert one(spark, dates.mmwr_year(d), dates.mmwr_week(d), dates.iso_week_label(d)) == (year, week, iso)


def test_week_windows(spark):
    assert dates.week_start(2025, 1) == date(2024, 12, 29)
    assert dates.resolve_window(date(2025, 1, 8), (2025, 1), (2025, 2)) == (date(2024, 12, 29), date(2025, 1, 11))
    assert dates.resolve_window(date(2025, 1, 8)) == (date(2024, 12, 15), date(2025, 1, 11))
    assert one(spark, dates.mmwr_weeks(F.lit(2020)), dates.mmwr_weeks(F.lit(2021))) == (53, 52)


def test_rates(spark):
    lit = lambda x: F.lit(x).cast("long")
    assert one(spark, *[values.pct_change(lit(a), lit(b)) for a, b in ((5, 0), (0, 0), (15, 10), (0, 3))]) == (100.0, 0.0, 50.0, -100.0)
    assert one(spark, values.cfr(lit(0), lit(3)), values.cfr(lit(8), lit(1)), values.fatality(lit(0), lit(3)), values.fatality(lit(2), lit(3))) == (None, 12.5, 0.0, 100.0)


def test_severity_rules_differ(spark):
    schema = "alert boolean, cases int, deaths int, confidence double, lat double, lon double, threshold int, place string"
    rows = [(True, 60, 0), (True, 100, 0), (True, 1, 1), (False, 500, 9), (False, 60, 0), (False, 1, 0), (True, 0, 0), (False, 0, 0)]
    df = spark.createDataFrame([(*r, 0.9, 1.0, 2.0, 50, "P") for r in rows] + [(True, 500, 5, 0.2, 1.0, 2.0, 50, "P"), (True, 500, 5, 0.9, None, 2.0, 50, "P"), (True, 500, 5, 0.9, 1.0, 2.0, 50, " "), (None, 500, None, 0.9, 1.0, 2.0, None, "P")], schema)
    got = [tuple(r) for r in df.select(predicates.severity_cluster(), predicates.severity_signal()).collect()]
    assert got == [
        ("high", "high"), ("critical", "critical"), ("critical", "critical"), ("info", "critical"), ("info", "high"), ("info", "warning"), ("high", "high"), ("info", "info"),
        ("info", "info"), ("info", "critical"), ("info", "critical"), ("info", "critical"),
    ]


def test_credibility_takes_the_higher(spark):
    rows = [(1, "https://moph.go.th/x", "rss"), (2, "https://a.bbc.com", "government"), (3, "https://x.org", "facebook"), (4, "https://x.org", "other"), (5, "https://dinkes.go.id/a", "web")]
    got = {r.source_id: (r.credibility, r.reason) for r in predicates.source_credibility(spark.createDataFrame(rows, "source_id long, url string, kind string")).collect()}
    assert got == {1: (0.98, "domain"), 2: (0.95, "heuristic"), 3: (0.35, "heuristic"), 4: (0.5, "heuristic"), 5: (0.95, "domain")}


def test_filter_stage(spark):
    rows = [("a", 1, None, "X", "p", 0.9, date(2024, 1, 1), 5), ("b", 1, None, "X", "p", 0.5, date(2024, 2, 1), 7)]
    df = spark.createDataFrame(rows, "fact_id string, report_id long, url string, label string, place string, confidence double, published_at date, cases long")
    df = df.withColumns({"is_relevant": F.lit(True), "source_type": F.lit("web"), "created_at": F.lit(datetime(2024, 3, 1)), "deaths": F.lit(0)})
    inside = lambda stage: [r.fact_id for r in kpi.valid_window(df, date(2024, 2, 1), date(2024, 2, 28), filter_stage=stage).collect()]
    assert inside("before") == ["b"] and inside("after") == []


def test_padding(spark):
    df = spark.createDataFrame([("A", 0), ("B", 3)], "country string, cases long")
    assert {r.country: r.cases for r in kpi.pad(df, "country", ["A", "C"], ["cases"]).collect()} == {"A": 0, "C": 0}
    assert {r.country: (r.cases, r.has_data) for r in kpi.pad_nodata(df, "country", ["A", "C"], ["cases"]).collect()} == {"A": (0, True), "C": (None, False)}


def test_pages(spark):
    empty = spark.range(0)
    rows, total, pages = paging.page(empty, 9, 500, [F.asc("id")])
    assert (rows.count(), total, pages) == (0, 0, 1)
    rows, total, pages = paging.page(spark.range(250), 3, 500, [F.asc("id")])
    assert (rows.count(), total, pages) == (50, 250, 3)


def test_urls(spark):
    cases = {
        "HTTP://Example.ORG:80/a/?utm_source=x&b=2&a=1#top": "http://example.org/a?a=1&b=2", "https://x.org": "https://x.org/", "ftp://x": None, " https://X.org/?ref=1 ": "https://x.org/?ref=1",
        "https://x.org/a/": "https://x.org/a/", "https://x.org/a/?_ga=1": "https://x.org/a", "https://x.org/a/./b/../c/": "https://x.org/a/c/", "https://x.org//a//b": "https://x.org/a/b", "https://u:p@x.org/a": None,
        "https://x.org:8443/a?source=rss&UTM_x=1&dclid=2&yclid=3": "https://x.org:8443/a?source=rss", "https://x.org/a b?q=a%20b&e": "https://x.org/a%20b?e=&q=a+b", "https://x.org:abc/": None, "https://x.org/%7Eme/é": "https://x.org/~me/%C3%A9",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.n for r in df.select("u", text.normalize_url(F.col("u")).alias("n")).collect()} == cases
    api, export = (lambda u, v=v: one(spark, text.normalize_url(F.lit(u), v))[0] for v in ("api", "export"))
    assert (api("https://x.org/a//b/?ref=1&_ga=2&gclid=3"), api("https://x.org/a/../b/."), api("https://u@x.org/")) == ("https://x.org/a//b/?_ga=2&ref=1", "https://x.org/b/", None)
    assert (export("https://u:p@x.org/a//?ref=1&oc=5&b=1&source=s#f"), export("https://x.org/?ref_src=t")) == ("https://x.org/a?b=1&source=s", "https://x.org/")


def test_counts_in_text(spark):
    cases = {"7.994": 7994, "218,356": 218356, "1,2 juta": 1_200_000, "3 ribu": 3000, "٤٢": 42, "none": None, "12.": 12}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in df.select("t", text.parse_count(F.col("t")).alias("n")).collect()} == cases
    assert {r.t: r.n[0] for r in df.select("t", text.parse_counts(F.array(text.fold_digits(F.col("t")))).alias("n")).collect()} == cases


def test_mojibake_and_markup(spark):
    assert one(spark, text.fix_mojibake(F.lit("Ã©tat")), text.fix_mojibake(F.lit("état")), text.strip_markup(F.lit("<style>x</style><p>a &amp; b</p><!-- c -->"))) == ("état", "état", "a & b")


def test_flags_and_places(spark):
    place = lambda x: predicates.place_or_null(F.lit(x))
    assert one(spark, place(" Unknown "), place("12"), place("--"), place(" Hanoi ")) == (None, None, None, "Hanoi")
    assert one(spark, predicates.focused_place(F.lit("Laos; Vientiane"), F.lit("laos")), predicates.focused_place(F.lit("Laos"), F.lit("laos"), True)) == ("Vientiane", "Laos")


def test_parents_drop_only_with_children(spark):
    rows = [("p", 1, None), ("c", 1, 1), ("q", 2, None)]
    df = spark.createDataFrame(rows, "fact_id string, report_id long, parent_id long")
    assert sorted(r.fact_id for r in articles.drop_parents(df).collect()) == ["c", "q"]


def test_articles_read_their_facts_once(spark):
    schema = "fact_id string, report_id long, parent_id long, label string, place string, country string, cases long, deaths long, confidence double, created_at int, alert boolean, needs_review boolean, is_relevant boolean, source_name string"
    rows = [
        ("p", 1, None, "x", "P", "C", 100, 9, 0.9, 1, True, True, True, "s"), ("a", 1, 1, None, "P", "C", 5, 1, 0.5, 1, False, True, True, "s"), ("b", 1, 1, "y", None, "C", None, 2, 0.5, 2, False, False, False, "t"),
        ("b", 1, 1, "y", "Q", "C", 7, 4, 0.1, 9, True, False, True, "t"), ("q", 2, None, None, None, None, None, None, None, 1, None, None, None, None), ("r", None, None, "z", "P", "C", 1, 0, 0.1, 1, False, False, True, "u"),
    ]
    out = articles.collapse_articles(spark.createDataFrame(rows, schema))
    got = {r.report_id: tuple(r) for r in out.select("report_id", "facts", "cases", "deaths", "alert", "needs_review", "worst", "lead_fact", "labels", "by_country", "by_place", "by_label", "by_source", "lead_label", "shown_by").collect()}
    assert got[1] == (1, 2, 5, 3, False, True, "noise", "b", 1, "C(5)", "P(5)", "", "s(5)", "y", "place")
    assert got[2] == (2, 1, None, None, None, None, "surveillance", "q", 0, "", "", "", "", None, "place")
    assert got[None][1:3] == (1, 1) and got[None][11] == "z(1)"
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # once more for the ids of parents


def test_roots_and_cycles(spark):
    edges = [(5, 4), (4, 3), (3, 1), (10, 11), (11, 12), (12, 10), (13, 12), (7, 7)]
    got = {r.node: r.root for r in dedup.resolve_roots(spark.createDataFrame(edges, "node long, parent long")).collect()}
    assert {k: got[k] for k in (5, 4, 3)} == {5: 1, 4: 1, 3: 1}
    assert {got[k] for k in (10, 11, 12, 13)} == {10}


def test_identities_through_shared_keys(spark):
    rows = [(1, "u1", "h1"), (2, "u1", "h2"), (3, None, "h2"), (4, "u9", "h9")]
    df = spark.createDataFrame(rows, "id long, url string, hash string")
    got = {r.id: r.survivor for r in dedup.dedup_identities(df, "id", ["url", "hash"], [F.desc("id")]).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 4}


def test_polygon_edges(spark):
    points = spark.createDataFrame([(1, 0.0, 0.5), (2, 0.5, 0.5), (3, 1.5, 0.5), (4, 1.0, 1.0)], "id long, lat double, lon double")
    square = spark.createDataFrame([("s", [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)])], "polygon string, ring array<struct<lat:double,lon:double>>")
    assert sorted(r.id for r in lookup.within_polygon(points, square, 0.3).collect()) == [1, 2, 4]


def test_due_and_retry(spark):
    now = datetime(2024, 1, 1, 12)
    sources = spark.createDataFrame([(1, "a", "interval:60"), (2, "b", "interval:60"), (3, "c", "interval:1")], "source_id long, name string, schedule string")
    runs = spark.createDataFrame([(1, 1, "SUCCESS", datetime(2024, 1, 1, 11, 30), datetime(2024, 1, 1, 11, 30)), (2, 3, "RUNNING", datetime(2024, 1, 1, 11, 50), None)], "run_id long, source_id long, status string, started_at timestamp, finished_at timestamp")
    assert [r.source_id for r in ops.due_sources(sources, runs, now).collect()] == [2]
    got = ops.retry_plan(spark.createDataFrame([(1,), (4,), (5,)], "attempts int")).collect()
    assert [(r.route, r.delay) for r in got] == [("retry", 30), ("retry", 240), ("dead", None)]


def test_periods(spark):
    rows = ["from 2024-01-02 to 2024-01-09", "epi week 2 of 2025", "in the last 3 weeks", "during March 2024", "on 2024-05-06", "nothing"]
    df = spark.createDataFrame([(i, t, date(2025, 1, 31)) for i, t in enumerate(rows)], "doc_id long, text string, published_at date")
    got = {r.doc_id: (r.first_day, r.last_day, r.source) for r in textjobs.event_period(df).collect()}
    assert got == {
        0: (date(2024, 1, 2), date(2024, 1, 9), "range"), 1: (date(2025, 1, 5), date(2025, 1, 11), "week"), 2: (date(2025, 1, 10), date(2025, 1, 31), "relative"),
        3: (date(2024, 3, 1), date(2024, 3, 31), "month"), 4: (date(2024, 5, 6), date(2024, 5, 6), "date"), 5: (None, None, "none"),
    }


def test_sentences_and_chunks(spark):
    t = "It rose 3.5 per cent. Then fell! New\nline here"
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    rows = textjobs.sentences(df).orderBy("sentence").collect()
    assert [r.text for r in rows] == ["It rose 3.5 per cent.", "Then fell!", "New", "line here"]
    assert all(t[r.start : r.end] == r.text for r in rows)
    parts = [r.text for r in textjobs.chunks(df, 25).orderBy("chunk").collect()]
    assert "".join(parts) == t and all(len(p) <= 25 for p in parts)


def test_sentence_rules(spark):
    cases = {
        "Malang had 2.001 cases, sedangkan Kediri had 215. Others none": ["Malang had 2.001 cases,", "sedangkan Kediri had 215.", "Others none"],
        "Meanwhile it rose by 5. 3 more. End in 2024.": ["Meanwhile it rose by 5. 3 more.", "End in 2024."],
        "第一句。第二句！第三句": ["第一句。", "第二句！", "第三句"],
        "See who.int now?! Yes...\n\n  Next": ["See who.int now?!", "Yes...", "Next"],
        "": [], " \n ": [], None: [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = textjobs.sentences(df).orderBy("doc_id", "sentence").collect()
    assert [[r.text for r in got if r.doc_id == i] for i in range(len(cases))] == list(cases.values())
    long = spark.createDataFrame([(1, "word " * 20_000)], "doc_id long, text string")
    assert [len(r.text) for r in textjobs.sentences(long).collect()] == [99_999]


def test_mentions_of_any_length(spark):
    lex = spark.createDataFrame([("of public", "C1"), ("Ministry of Public Health", "C2"), ("health", "C3"), ("the the", "C4")], "alias string, concept string")
    df = spark.createDataFrame([(1, "The ministry of public health and the the the health of public works")], "doc_id long, text string")
    got = {(r.start, r.end, r.concept) for r in textjobs.mentions(df, lex).collect()}
    assert got == {(1, 5, "C2"), (6, 8, "C4"), (7, 9, "C4"), (9, 10, "C3"), (10, 12, "C1")}


def test_nearest_mention(spark):
    m = spark.createDataFrame([(1, 0, 2, "a"), (1, 0, 6, "b"), (1, 0, 6, "c"), (2, 0, 9, "z")], "doc_id long, sentence int, pos int, mention string")
    n = spark.createDataFrame([(1, 0, 4, "x"), (1, 0, 5, "y"), (1, 0, 6, "w"), (1, 1, 3, "v"), (2, 0, 1, "u")], "doc_id long, sentence int, pos int, anchor string")
    assert {(r.anchor, r.mention) for r in dedup.nearest_mention(m, n).collect()} == {("x", "a"), ("y", "b"), ("w", "b"), ("u", "z")}


def test_evidence_sections_lede(spark):
    df = spark.createDataFrame([(1, "FIRST PART\nTen more were ill. In all 12 cases were found there.\n2. Next\nNo numbers of cases here at all.\nRelated: 9 cases in the other article.")], "doc_id long, text string")
    assert [r.text for r in textjobs.evidence(textjobs.sentences(df), "cases").orderBy("sentence").collect()] == ["In all 12 cases were found there.", "Related: 9 cases in the other article."]
    assert [(r.section, r.title) for r in textjobs.sections(df).orderBy("section").collect()] == [(1, "FIRST PART"), (2, "2. Next")]
    assert one(spark, F.lit(textjobs.lede(df, 9).first().lede))[0].endswith("at all.")


def test_relations_before_wins(spark):
    m = spark.createDataFrame([("d", 0, 2, "place", "far"), ("d", 0, 4, "place", "before"), ("d", 0, 8, "place", "after"), ("d", 1, 1, "label", "other")], "doc_id string, sentence int, pos int, kind string, name string")
    c = spark.createDataFrame([("d", 0, 6, "cases", 5), ("d", 0, 6, "cases", 9)], "doc_id string, sentence int, pos int, metric string, n long")
    assert [tuple(r) for r in textjobs.relations(m, c).collect()] == [("d", None, "before", "cases", 9, "0")]


def test_sampling(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(20)], "id long, label string")
    got = training.rebalance(df, "label", "id", 8).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"a": 8, "b": 8}
    split = df.select("id", values.hash_split(F.col("id").cast("string")).alias("p"))
    assert {tuple(r) for r in split.collect()} == {tuple(r) for r in split.repartition(5).collect()}


def test_quantile_classes(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 1, 1, 5, 9, None])], "id long, v long")
    got = {r.id: r.quantile_class for r in dedup.quantile_classes(df, "v", 4, "id").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 2, 4: 3, 5: None}


def test_llm_is_not_imported_elsewhere():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "vigilis"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text()
