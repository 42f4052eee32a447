"""Queries on texts: documents, pages, conversations, and articles written from order lines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilis.functions import dates, predicates, text, values
from vigilis.operators import dedup, lookup, textjobs, training
from vigilis.plans import query
from vigilis.sources import adapters as a
from vigilis.sources.adapters import ALIASES_SQL, FACTS_SQL, PLACES_SQL, RULES_SQL

MARKERS = [(w, lang) for lang, ws in {"en": "the of and in that", "fr": "la les et des une", "de": "der die und das ein", "es": "el los que para una"}.items() for w in ws.split()]
MARKERS_SQL = "markers AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{x}')" for w, x in MARKERS) + ") t(word, lang))"
WORDS_SQL = r"(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> ''))"


def articles_of(spark, d):
    """One short article for each fact: a sentence with counts, a status word and a date, and one on an epidemiological week."""
    f = a.facts(spark, d)
    status = F.when(F.col("needs_review"), "suspected").otherwise("confirmed")
    return f.select(
        F.col("fact_id").alias("doc_id"), "label", "place", "country", "cases", "deaths", "published_at",
        F.concat(
            F.lit("Health staff in "), "place", F.lit(" "), status, F.lit(" "), F.col("cases").cast("string"), F.lit(" cases and "), F.col("deaths").cast("string"), F.lit(" deaths of "), F.lower("label"),
            F.lit(" on "), F.date_format("published_at", "yyyy-MM-dd"), F.lit(". In epi week "), (F.col("cases") % 50 + 1).cast("string"), F.lit(" of 1996 there were 3 samples."),
        ).alias("text"),
    )


ARTICLES_SQL = f"""{FACTS_SQL}, arts AS (SELECT fact_id AS doc_id, label, place, country, cases, deaths, published_at, needs_review, 'Health staff in ' || place || ' ' || CASE WHEN needs_review THEN 'suspected' ELSE 'confirmed' END || ' ' || cases || ' cases and ' || deaths || ' deaths of ' || lower(label)
  || ' on ' || strftime(published_at, '%Y-%m-%d') || '. In epi week ' || (cases % 50 + 1) || ' of 1996 there were 3 samples.' AS text FROM facts)"""


@query(f"""WITH {MARKERS_SQL}, w AS (SELECT doc_id, unnest({WORDS_SQL}) AS word FROM documents), v AS (SELECT doc_id, lang, count(*) AS n FROM w JOIN markers USING (word) GROUP BY 1, 2),
  l AS (SELECT doc_id, arg_max(lang, (n, lang)) AS top, max(n) AS m, count(*) FILTER (WHERE n = mm) AS ties FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS mm FROM v) GROUP BY 1)
  SELECT d.doc_id, CASE WHEN m >= 2 AND ties = 1 THEN top ELSE 'unknown' END AS language FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id""")
def tx1_language_profile(spark, d):
    markers = spark.createDataFrame(MARKERS, "word string, lang string")
    return textjobs.language_profile(a.scan(spark, d, "documents", ["doc_id", "text"]), F.broadcast(markers))


WS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sentences_sql(source: str) -> str:
    """CTEs ending in sents (doc_id, sentence, start, end, text) of a relation (doc_id, text), cut at marks put in by replacement."""
    t, mark = "text", "' || chr(31) || '"
    clause = "sementara\\s+itu|sedangkan|meanwhile|in\\s+the\\s+meantime|by\\s+contrast|trong\\s+khi(?:\\s+đó)?|ขณะที่|samantala|enquanto\\s+isso|manakala"
    for pattern in (r"([!?。！？])([^.!?。！？]|$)", r"((?:^|[^0-9])\.)(\s|$)", r"([0-9]\.)(\s+[A-Z\"“''‘]|\s*$)", rf"([\s,;:])((?i:{clause})(?:\s|$))", r"(\n+)()"):
        t = rf"regexp_replace({t}, '{pattern}', '\1{mark}\2', 'g')"
    return f"""pieces AS (SELECT doc_id, string_split({t}, chr(31)) AS ps FROM {source}), raws AS (SELECT doc_id, unnest(ps) AS raw, generate_subscripts(ps, 1) AS i FROM pieces),
  placed AS (SELECT doc_id, raw, i, coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM raws),
  sents AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS sentence, CAST(before + length(raw) - length(ltrim(raw, {WS_SQL})) AS BIGINT) AS "start",
    CAST(before + length(rtrim(raw, {WS_SQL})) AS BIGINT) AS "end", trim(raw, {WS_SQL}) AS text FROM placed WHERE trim(raw, {WS_SQL}) <> '')"""


@query(f'WITH {sentences_sql("documents")} SELECT doc_id, sentence, "start", "end", text FROM sents')
def tx2_sentences(spark, d):
    return textjobs.sentences(a.scan(spark, d, "documents", ["doc_id", "text"]))


LEXICON = [("the", "C1"), ("of the", "C2"), ("und", "C3"), ("de la", "C4"), ("la", "C5")]


@query(f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents), u AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
  l AS (SELECT * FROM (VALUES ('the', 'C1', 1), ('of the', 'C2', 2), ('und', 'C3', 1), ('de la', 'C4', 2), ('la', 'C5', 1)) t(alias, concept, k)),
  h AS (SELECT doc_id, i - 1 AS s, i - 1 + k AS e, concept FROM u JOIN l ON array_to_string(ws[i:i + k - 1], ' ') = alias AND i + k - 1 <= len(ws)),
  m AS (SELECT * FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM h) WHERE far IS NULL OR e > far)
  SELECT doc_id, concept, count(*) AS n, CAST(min(s) AS INTEGER) AS first FROM m GROUP BY 1, 2""")
def tx3_mentions(spark, d):
    lex = spark.createDataFrame(LEXICON, "alias string, concept string")
    m = textjobs.mentions(a.scan(spark, d, "documents", ["doc_id", "text"]), lex)
    return m.groupBy("doc_id", "concept").agg(F.count("*").alias("n"), F.min("start").alias("first"))


@query(f"WITH {ARTICLES_SQL} SELECT doc_id, cases, deaths FROM arts")
def tx4_labelled_counts(spark, d):
    docs = articles_of(spark, d).select("doc_id", "text")
    return textjobs.labelled_counts(docs, {"cases": "cases?", "deaths": "deaths?"}).select("doc_id", "cases", "deaths")


@query(f"WITH {ARTICLES_SQL} SELECT doc_id, cases AS n FROM arts UNION ALL SELECT doc_id, deaths FROM arts UNION ALL SELECT doc_id, 1996 FROM arts WHERE cases % 3 = 0")
def tx5_filter_counts(spark, d):
    """Numbers with what stands left and right of them; dates, samples, weeks of a year and years go, but 1996 cases stay."""
    a_third = F.when(F.col("cases") % 3 == 0, " Another 1996 cases are known.").otherwise("")
    t = articles_of(spark, d).select("doc_id", F.concat(F.regexp_replace("text", r"\d{4}-\d\d-\d\d|week \d+ (?=of)", "day "), a_third).alias("text"))
    number = r"(?<![0-9A-Za-z_.-])[0-9]+(?![0-9-])"
    cut = t.select("doc_id", F.split("text", number).alias("parts"), F.regexp_extract_all("text", F.lit(number), 0).alias("ns"))
    # twelve characters on either side; what stands right of a number may hold the next ones
    rest = lambda i: F.array_join(F.flatten(F.transform(F.slice(F.arrays_zip(F.col("parts").alias("p"), F.col("ns").alias("n")), i + 2, 7), lambda z: F.array(z["p"], z["n"]))), "")
    own = F.transform("ns", lambda n, i: F.struct(n.cast("long").alias("n"), F.right(F.get("parts", i), F.lit(12)).alias("left"), F.left(rest(i), F.lit(12)).alias("right")))
    m = cut.select("doc_id", F.inline(own))
    return textjobs.filter_counts(m).select("doc_id", "n")


@query(f"WITH {ARTICLES_SQL} SELECT doc_id, lower(label) AS label, place, 'cases' AS metric, cases AS n, '0' AS evidence FROM arts UNION ALL SELECT doc_id, lower(label), place, 'deaths', deaths, '0' FROM arts")
def tx6_relations(spark, d):
    """Counts of a sentence with the nearest place and label in it."""
    s = articles_of(spark, d).select("doc_id", F.lit(0).alias("sentence"), F.lower(F.substring_index("text", ". ", 1)).alias("text"), F.col("place").alias("__place"), F.lower("label").alias("__label"))
    places, labels = "nation_[0-9]+", "small|standard|promo|large|economy|medium|unknown"
    at = lambda kind, p: F.struct(F.lit(kind).alias("kind"), F.regexp_extract("text", rf"\b({p})\b", 1).alias("name"))
    m = s.select("doc_id", "sentence", "text", F.inline(F.array(at("place", places), at("label", labels)))).where("name <> ''")
    m = m.select("doc_id", "sentence", F.expr("position(name, text)").alias("pos"), "kind", F.when(F.col("kind") == "place", F.upper("name")).otherwise(F.col("name")).alias("name"))
    said = lambda metric: F.struct(F.expr(f"position('{metric}', text)").alias("pos"), F.lit(metric).alias("metric"), F.regexp_extract("text", rf"([0-9]+) {metric}", 1).cast("long").alias("n"))
    c = s.select("doc_id", "sentence", F.inline(F.array(said("cases"), said("deaths"))))
    return textjobs.relations(m, c)


#: Sentences in several languages with their status and metric.
SAID = [
    ("Kabar bohong, bukan wabah.", "retracted", "cases"), ("Tin đồn lan truyền.", "rumor", "cases"), ("Diduga kolera; total kasus naik.", "suspected", "cumulative_cases"), ("ผู้ป่วยสงสัย รายใหม่", "suspected", "new_cases"), ("Tidak ada kasus yang dilaporkan.", "negative_surveillance", "cases"),
    ("Ca xác nhận, tích lũy 12.", "confirmed", "cumulative_cases"), ("Siaran pers: kasus aktif 3.", "official_report", "active_cases"), ("Three were ill, as previously.", "reported", "historical_cases"), ("No new measles cases were detected.", "negative_surveillance", "cases"), ("Laboratory-confirmed new cases.", "confirmed", "new_cases"),
]


@query(f"""WITH {ARTICLES_SQL} SELECT doc_id, [{", ".join(f"'{s}'" for _, s, _ in SAID)}][cases % 10 + 1] AS status, [{", ".join(f"'{m}'" for _, _, m in SAID)}][cases % 10 + 1] AS metric FROM arts""")
def tx7_status(spark, d):
    t = F.get(F.array(*[F.lit(s) for s, _, _ in SAID]), (F.col("cases") % 10).cast("int"))
    return articles_of(spark, d).select("doc_id", textjobs.epistemic_status(t).alias("status"), textjobs.metric_type(t).alias("metric"))


@query(f"""WITH {ARTICLES_SQL}, {sentences_sql("arts")} SELECT doc_id, sentence, "start", "end", text FROM sents
  WHERE length(text) BETWEEN 20 AND 800 AND regexp_matches(text, '[0-9]') AND regexp_matches(text, '(?i)\\b(cases|deaths|samples)\\b')""")
def tx9_evidence(spark, d):
    return textjobs.text_evidence(articles_of(spark, d).select("doc_id", "text"), "cases|deaths|samples")


TOPIC_WORDS = ["", "A study in a journal.", "Peneliti menulis jurnal.", "Farmers fear for livestock.", "Peternak khawatir.", "Parliament votes on the bill.", "Imunisasi massal dimulai.", "Declared free of it."]


@query(f"""WITH {ARTICLES_SQL}, t AS (SELECT doc_id, cases % 8 AS k FROM arts) SELECT doc_id, k IN (1, 2) AS academic, k IN (3, 4) AS agricultural, k = 5 AS policy, k = 6 AS vaccine, k = 7 AS disease_free, true AS outbreak FROM t""")
def tx10_topic_flags(spark, d):
    x = articles_of(spark, d)
    more = F.get(F.array(*map(F.lit, TOPIC_WORDS)), (F.col("cases") % 8).cast("int"))
    return textjobs.topic_flags(x.withColumn("text", F.concat_ws(" ", "text", more))).select("doc_id", "academic", "agricultural", "policy", "vaccine", "disease_free", "outbreak")


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM documents), c AS (SELECT doc_id, t, length(regexp_replace(t, '[^\p{L} ]', '', 'g')) AS letters FROM t)
  SELECT doc_id, array_to_string(list_filter([CASE WHEN length(t) = 0 THEN 'empty' END, CASE WHEN length(t) > 0 AND length(t) < 120 THEN 'short' END, CASE WHEN length(t) - length(replace(t, '|', '')) > len(string_split(t, ' ')) / 4.0 THEN 'navigation' END,
    CASE WHEN length(t) > 0 AND letters < length(t) * 0.8 THEN 'noisy' END], lambda x: x IS NOT NULL), ',') AS flags FROM c""")
def tx11_quality_flags(spark, d):
    return a.scan(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.array_join(textjobs.quality_flags(F.col("text")), ",").alias("flags"))


@query("""WITH x AS (SELECT l_orderkey AS k, count(DISTINCT CAST(l_quantity AS BIGINT)) AS distinct_figures, max(l_linenumber) AS deaths, max(CAST(l_quantity AS BIGINT)) AS m, min(l_returnflag) AS label, CASE WHEN min(l_linestatus) = 'F' THEN 'F' END AS place FROM lineitem GROUP BY 1)
  SELECT k, CAST(distinct_figures AS INTEGER) AS distinct_figures, place IS NULL OR distinct_figures > 2 OR deaths > m AS second_pass FROM x""")
def tx12_second_pass(spark, d):
    g = a.scan(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.collect_set(F.col("l_quantity").cast("long")).alias("figures"), F.max("l_linenumber").alias("deaths"), F.min("l_returnflag").alias("label"), F.when(F.min("l_linestatus") == "F", "F").alias("place"),
    )
    return textjobs.needs_second_pass(g).select("k", "distinct_figures", "second_pass")


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size > 10 THEN p_type END, CASE WHEN p_retailprice >= 1500 THEN 'PROMO' END, 'UNKNOWN') AS resolved, coalesce(CASE WHEN p_size > 10 THEN p_type END <> CASE WHEN p_retailprice >= 1500 THEN 'PROMO' END, false) AS conflict FROM part""")
def tx13_resolve_label(spark, d):
    p = a.scan(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_type")).alias("rule"), F.lit("PROMO").alias("model"), (F.col("p_retailprice") / 2500).alias("score"))
    return textjobs.resolve_label(p, "rule", "model", "score").select("p_partkey", "resolved", "conflict")


@query(f"""WITH {FACTS_SQL}, {PLACES_SQL}, c AS (SELECT f.*, p.country AS pc, 'A' || (p.place_id % 3) AS admin1, row_number() OVER (PARTITION BY fact_id, f.created_at, f.cases ORDER BY CASE WHEN p.country = f.country THEN 0 ELSE 1 END, place_id) AS rn FROM facts f LEFT JOIN places p ON lower(f.place) = lower(p.name))
  SELECT place, admin1, pc AS place_country, count(*) AS n FROM c WHERE rn = 1 GROUP BY 1, 2, 3""")
def tx14_hierarchy(spark, d):
    p = a.places(spark, d).withColumn("admin1", F.concat(F.lit("A"), F.col("place_id") % 3))
    one = dedup.best_per_key(a.facts(spark, d), ["fact_id", "created_at", "cases"], [F.asc("place")])
    return textjobs.hierarchy(one, p).groupBy("place", "admin1", "place_country").agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w)
  SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM u WHERE term NOT IN ('the', 'of the', 'und', 'de la', 'la') GROUP BY 1 HAVING count(DISTINCT doc_id) >= 20""")
def tx16_discover_terms(spark, d):
    lex = spark.createDataFrame(LEXICON, "alias string, concept string")
    return textjobs.discover_terms(a.scan(spark, d, "documents", ["doc_id", "text"]), lex, least=20)


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  h AS (SELECT *, regexp_matches(line, '^(?:[0-9]+\.|[A-Z][A-Z ]{3,}$)') AS head FROM l), s AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h)
  SELECT doc_id, CAST(section AS BIGINT) AS section, max(line) FILTER (WHERE head) AS title, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT head), '') AS body FROM s GROUP BY doc_id, section""")
def tx17_sections(spark, d):
    return textjobs.sections(a.scan(spark, d, "documents", ["doc_id", "text"]))


@query("SELECT l_orderkey AS doc_id, 'week ' || l_linenumber AS name, CAST(l_quantity AS BIGINT) AS n FROM lineitem")
def tx18_text_series(spark, d):
    g = a.scan(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.collect_list(F.concat(F.lit("week "), "l_linenumber", F.lit(": "), F.col("l_quantity").cast("long"))), "; ").alias("text"))
    return textjobs.text_series(g)


@query(r"""WITH RECURSIVE s AS (SELECT doc_id, regexp_extract_all(text, '([^.!?\n]+[.!?]*\s*|[.!?\n]+\s*)', 1) AS ps FROM documents), p AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM s), c AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM p),
  g(doc_id, chunk, a, before) AS (SELECT doc_id, 0, 1::BIGINT, 0::HUGEINT FROM c WHERE i = 1 UNION ALL SELECT g.doc_id, chunk + 1, c.i, c.upto - length(c.p) FROM g JOIN c ON c.doc_id = g.doc_id AND c.i > g.a AND c.upto - g.before > 2000 AND (c.upto - length(c.p) - g.before <= 2000 OR c.i = g.a + 1)),
  e AS (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM g) SELECT e.doc_id, e.chunk, string_agg(p, '' ORDER BY i) AS text FROM e JOIN c ON c.doc_id = e.doc_id AND c.i >= e.a AND (z IS NULL OR c.i < z) GROUP BY 1, 2""")
def tx19_chunks(spark, d):
    return textjobs.chunks(a.scan(spark, d, "documents", ["doc_id", "text"]), 2000)


@query(r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM c WHERE turn > 0 AND length(t) >= 20 AND regexp_matches(t, '\p{L}')),
  r AS (SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) AS rest FROM k WHERE k <= 6 GROUP BY 1) SELECT c.conv_id, concat_ws(chr(10), c.t, rest) AS digest FROM c LEFT JOIN r ON c.conv_id = r.conv_id WHERE turn = 0""")
def tx20_post_digest(spark, d):
    return textjobs.post_digest(a.scan(spark, d, "conversations"))


@query(r"""WITH o AS (SELECT doc_id, regexp_extract(text, '(?is)^(.*?)(?:\n\s*(?:related|read also|baca juga)\b.*)?$', 1) AS t FROM documents),
  s AS (SELECT doc_id, list_filter(regexp_extract_all(t, '([^.!?\n]+[.!?]*)', 1), lambda x: trim(x) <> '') AS s FROM o) SELECT doc_id, array_to_string(list_transform(s[1:2], lambda x: trim(x)), ' ') AS lede FROM s""")
def tx21_lede(spark, d):
    return textjobs.lede(a.scan(spark, d, "documents", ["doc_id", "text"]))


@query()
def tx22_score(spark, d):
    """Label 1's probability for every document: hashed words and logistic regression, trained on ``labels``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.functions import vector_to_array

    docs = a.scan(spark, d, "documents", ["doc_id", "text"]).select("doc_id", textjobs.words(F.col("text")).alias("words"))
    gold = docs.join(a.scan(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    steps = [HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 14), IDF(inputCol="tf", outputCol="x"), LogisticRegression(featuresCol="x", labelCol="label", maxIter=20, regParam=0.01)]
    model = Pipeline(stages=steps).fit(gold)
    return model.transform(docs).select("doc_id", F.round(vector_to_array("probability")[1], 4).alias("score"))


@query()
def tx22_targets(spark, d):
    """Relevance, tone and language of every document, by models learned from the documents that ``labels`` covers."""
    from vigilis.operators import scoring

    docs = a.scan(spark, d, "documents", ["doc_id", "text", "lang"])
    marks = a.scan(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "high").otherwise("low").alias("relevance"), F.when(F.col("toxic") == 1, "negative").otherwise("neutral").alias("tone"))
    found = scoring.fit_targets(docs.join(marks, "doc_id").withColumnRenamed("lang", "language"), ["relevance", "tone", "language"])
    return scoring.score_targets(docs, found)


@query(f"""WITH {ARTICLES_SQL}, w AS (SELECT doc_id, make_date(1996, 1, 4) - CAST(dayofweek(make_date(1996, 1, 4)) AS INTEGER) + CAST(cases % 50 AS INTEGER) * 7 AS f FROM arts) SELECT doc_id, f AS first_day, f + 6 AS last_day, 'week' AS source FROM w""")
def tx23_event_period(spark, d):
    return textjobs.event_period(articles_of(spark, d))


@query(f"""WITH w AS (SELECT doc_id, unnest(list_distinct({WORDS_SQL})) AS word FROM documents) SELECT doc_id, word AS concept FROM w WHERE word IN ('la', 'und', 'the')""")
def tx24_dictionary_terms(spark, d):
    lex = spark.createDataFrame([(w, w) for w in ("la", "und", "the")], "alias string, concept string")
    docs = a.scan(spark, d, "documents", ["doc_id", "text"])
    return textjobs.mentions(docs, lex).select("doc_id", "concept").distinct()


@query(f"""WITH {FACTS_SQL}, m AS (SELECT report_id AS doc_id, place AS country, sum(CASE WHEN cases > 45 THEN 0 WHEN deaths = 0 THEN 3 WHEN deaths < 3 THEN 2 ELSE 1 END) AS points FROM facts GROUP BY 1, 2)
  SELECT doc_id, arg_max(country, (points, country)) AS country, CAST(max(points) AS BIGINT) AS most FROM m WHERE points > 0 GROUP BY 1""")
def tx25_case_country(spark, d):
    m = a.facts(spark, d).select(F.col("report_id").alias("doc_id"), F.col("place").alias("country"), (F.col("deaths") == 0).alias("in_title"), (F.col("deaths") - 1).alias("sentence"), (F.col("cases") > 45).alias("publisher"), F.lit(False).alias("comparison"))
    return textjobs.case_country(m)


@query(f"""WITH {FACTS_SQL}, g AS (SELECT report_id AS doc_id, label, min(deaths) AS first FROM facts GROUP BY 1, 2 HAVING NOT bool_and(needs_review)), s AS (SELECT *, max(CASE WHEN label = 'PROMO' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id) AS sp FROM g)
  SELECT doc_id, label, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first, label) AS INTEGER) AS rank FROM s WHERE label <> 'PROMO' OR sp = 0""")
def tx26_rank_labels(spark, d):
    m = a.facts(spark, d).select(F.col("report_id").alias("doc_id"), "label", F.col("deaths").alias("pos"), F.col("needs_review").alias("negated"))
    return textjobs.rank_labels(m, ["PROMO"])


@query("""SELECT DISTINCT l_orderkey AS doc_id, coalesce(CASE WHEN l_partkey % 10 < 7 THEN 'concept ' || (l_partkey % 10 % 3) END, lower('Raw' || (l_partkey % 10))) AS identity, l_partkey % 10 >= 7 AS needs_review FROM lineitem""")
def tx27_project_labels(spark, d):
    m = a.scan(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 10).alias("concept_id"), F.concat(F.lit("Raw"), F.col("l_partkey") % 10).alias("name"))
    concepts = spark.range(7).select(F.col("id").alias("concept_id"), F.concat(F.lit("concept "), F.col("id") % 3).alias("canonical"))
    return textjobs.project_labels(m, concepts)


@query("SELECT o_orderkey, CASE WHEN abs(year(o_orderdate) - 1997) >= 2 THEN DATE '1997-12-31' ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def tx28_reconcile_date(spark, d):
    return a.scan(spark, d, "orders").select("o_orderkey", textjobs.reconcile_date(F.to_date("o_orderdate"), F.lit(1997)).alias("day"))


@query("""WITH x AS (SELECT sha256(text || '|' || lang || '|' || source || '|' || 'document') AS hash, max(n_chars / 1000.0) AS confidence FROM documents GROUP BY 1) SELECT hash, round(confidence, 4) AS confidence FROM x""")
def tr1_capture_examples(spark, d):
    docs = a.scan(spark, d, "documents").select("text", F.col("lang").alias("language"), F.col("source").alias("label"), F.lit("document").alias("type"), (F.col("n_chars") / 1000.0).alias("confidence"))
    return training.capture_examples(docs).select("hash", F.round("confidence", 4).alias("confidence"))


def _examples(spark, d):
    docs = a.scan(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"), F.col("n_chars"))
    return docs.join(a.scan(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic"), "id")


@query("""SELECT d.doc_id AS id, lang AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE (toxic = 1 OR (n_chars >= 1000 AND quality = 1)) AND lang IN ('en', 'de') AND d.doc_id % 9 <> 0""")
def tr2_select_training(spark, d):
    x = _examples(spark, d).withColumns({"human": F.col("toxic") == 1, "confidence": F.col("n_chars") / 1000, "needs_review": F.col("quality") == 0})
    return training.select_training(x, 1.0, ["en", "de"], x.where("id % 9 = 0").select("id")).select("id", "label")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT doc_id AS id, CASE WHEN n < 50 THEN 'OTHER' ELSE d.source END AS grouped, CASE WHEN CAST('0x' || sha256(CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) / 4294967295.0::DOUBLE < 0.8 THEN 'train' ELSE 'test' END AS part FROM documents d JOIN c ON d.source = c.source""")
def tr3_group_rare(spark, d):
    x = a.scan(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("label"))
    return training.group_rare(x, "label", 50).select("id", "grouped", "part")


@query("""SELECT doc_id AS id, lang AS label FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS n FROM documents) WHERE n <= 100""")
def tr4_cap_sample(spark, d):
    x = a.scan(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    return training.cap_sample(x, "label", "id", 100)


@query("""WITH r AS (SELECT doc_id AS id, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
  SELECT id, label, CAST(unnest(range(0, CAST(floor((250 - 1 - r) / n) AS BIGINT) + 1)) AS INTEGER) AS copy FROM r WHERE r < 250""")
def tr4_rebalance(spark, d):
    x = a.scan(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    return training.rebalance(x, "label", "id", 250)


@query("""WITH g AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 > 0 THEN lang END AS label, text, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE lang END AS language, 'gold' AS origin FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, lang, text, lang, 'queue' FROM documents WHERE doc_id % 2 = 0)
  SELECT id, origin, array_to_string(list_filter([CASE WHEN label IS NULL THEN 'no_label' END, CASE WHEN length(text) < 50 THEN 'short' END, CASE WHEN language = 'unknown' THEN 'no_language' END], lambda x: x IS NOT NULL), ',') AS tags, count(*) OVER (PARTITION BY id) > 1 AS duplicate FROM g""")
def tr5_review_manifest(spark, d):
    docs = a.scan(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text", F.col("lang").alias("language"))
    gold = docs.where("id % 3 = 0").withColumn("language", F.when(F.col("id") % 5 == 0, "unknown").otherwise(F.col("language"))).withColumn("label", F.when(F.col("id") % 7 > 0, F.col("label")))
    return training.review_manifest(gold, docs.where("id % 2 = 0")).select("id", "origin", "tags", "duplicate")


@query(f"""WITH {FACTS_SQL}, o AS (SELECT fact_id, any_value(label) AS label, max(cases) AS cases FROM facts GROUP BY 1), c AS (SELECT fact_id, cases FROM o WHERE cases % 5 = 0)
  SELECT o.fact_id, CASE WHEN c.fact_id IS NOT NULL THEN 'FIXED' ELSE label END AS label, CASE WHEN c.fact_id IS NOT NULL AND o.cases % 2 = 0 THEN o.cases + 1 ELSE o.cases END AS cases, c.fact_id IS NOT NULL AS human FROM o LEFT JOIN c ON o.fact_id = c.fact_id""")
def tr6_apply_corrections(spark, d):
    o = a.facts(spark, d).groupBy("fact_id").agg(F.min("label").alias("label"), F.max("cases").alias("cases"))
    c = o.where("cases % 5 = 0")
    fix = c.select("fact_id", F.lit("label").alias("field"), F.lit("WRONG").alias("value"), F.lit(1).alias("at")).unionByName(c.select("fact_id", F.lit("label").alias("field"), F.lit("FIXED").alias("value"), F.lit(2).alias("at")))
    fix = fix.unionByName(c.where("cases % 2 = 0").select("fact_id", F.lit("cases").alias("field"), (F.col("cases") + 1).cast("string").alias("value"), F.lit(1).alias("at")))
    return training.apply_corrections(o, fix, ["label", "cases"])


@query(f"""WITH {FACTS_SQL}, x AS (SELECT CASE WHEN cases % 4 = 0 THEN NULL ELSE country END AS country, is_relevant, lower(label) AS label FROM facts)
  SELECT 'before' AS stage, count(*) AS rows, count(*) FILTER (WHERE country IS NULL) AS no_country, count(*) FILTER (WHERE is_relevant) AS relevant, count(DISTINCT label) AS labels FROM x
  UNION ALL SELECT 'after', count(*), 0, count(*) FILTER (WHERE is_relevant AND label <> 'unknown'), count(DISTINCT label) FROM x""")
def tr7_repair_facts(spark, d):
    broken = a.facts(spark, d).withColumn("country", F.when(F.col("cases") % 4 != 0, F.col("country"))).withColumn("label", F.lower("label"))
    names = lookup.unambiguous_map(a.rules(spark, d), a.aliases(spark, d))
    places = a.places(spark, d).where("country <> 'OLD'")
    return training.repair_facts(broken, places, names)[1]


@query("""SELECT l_orderkey, l_linenumber, coalesce(nullif(trim(CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE l_returnflag END), ''), o_orderstatus) AS scope, coalesce(CASE WHEN l_linenumber > 3 THEN 'X' END, o_orderpriority) AS source_country, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def tr8_backfill_scope(spark, d):
    f = a.scan(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(F.col("l_returnflag")).alias("scope"), F.when(F.col("l_linenumber") > 3, "X").alias("source_country"))
    r = a.scan(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderstatus").alias("scope"), F.col("o_orderpriority").alias("source_country"))
    groups = ["report_id", "l_linenumber", "scope", "source_country"]
    # nearly every row is a group of its own: counted in order, in a stage of their own, which takes less memory than tables of all groups
    out = training.backfill_scope(f, r).repartition(*groups)
    group = Window.partitionBy(*groups).orderBy(F.lit(1))
    n = F.count("*").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    counted = out.withColumn("n", n).withColumn("__first", F.row_number().over(group)).where("__first = 1")
    return counted.select(F.col("report_id").alias("l_orderkey"), "l_linenumber", "scope", "source_country", "n")


@query("""WITH RECURSIVE w AS (SELECT CAST(p_partkey AS BIGINT) AS node, CAST(p_partkey AS BIGINT) AS up FROM part UNION ALL SELECT node, up // 4 FROM w WHERE up >= 16), r AS (SELECT node, min(up) AS root FROM w GROUP BY 1)
  SELECT root AS partkey, count(*) AS n FROM lineitem JOIN r ON l_partkey = node GROUP BY 1""")
def tr9_apply_redirects(spark, d):
    redirects = a.scan(spark, d, "part").where("p_partkey >= 16").select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 4).cast("long").alias("parent"))
    f = a.scan(spark, d, "lineitem").select(F.col("l_partkey").alias("partkey"))
    return training.apply_redirects(f, redirects, "partkey").groupBy("partkey").agg(F.count("*").alias("n"))


@query(f"WITH {FACTS_SQL} SELECT label, count(*) AS n, CAST(sum(cases * 2) AS BIGINT) AS twice FROM facts WHERE created_at <= TIMESTAMP '1997-06-30' GROUP BY 1")
def tr10_reanalyse(spark, d):
    out = training.reanalyse(a.facts(spark, d), datetime(1997, 6, 30), {"twice": F.col("cases") * 2})
    return out.groupBy("label").agg(F.count("*").alias("n"), F.sum("twice").alias("twice"))


@query(f"WITH {RULES_SQL}, {ALIASES_SQL} SELECT 'alias' AS kind, (SELECT count(*) FROM aliases) AS entries, CAST(2 AS BIGINT) AS found, false AS passed UNION ALL SELECT 'label', (SELECT count(*) FROM rules), 1, true")
def tr11_registry_audit(spark, d):
    lex = a.aliases(spark, d).select(F.lit("alias").alias("kind"), "alias").unionByName(a.rules(spark, d).select(F.lit("label").alias("kind"), F.col("label").alias("alias")))
    sentinels = spark.createDataFrame([("alias", "small"), ("alias", "promo-x"), ("alias", "nothing"), ("label", "SMALL")], "kind string, alias string")
    return training.registry_audit(lex, sentinels)


@query(f"WITH {ARTICLES_SQL} SELECT label, count(*) AS n, count(*) FILTER (WHERE label <> 'UNKNOWN') AS grounded FROM arts GROUP BY 1")
def tr12_ground_labels(spark, d):
    x = articles_of(spark, d).select(F.col("doc_id").alias("id"), "label", "text")
    return training.ground_labels(x, a.aliases(spark, d)).groupBy("label").agg(F.count("*").alias("n"), F.count_if("grounded").alias("grounded"))


@query(f"""WITH {PLACES_SQL} SELECT place_id, CASE WHEN lower(name) IN ('nation_1', 'nation_2') THEN NULL ELSE name END AS cleaned FROM places""")
def fp9_place_or_null(spark, d):
    name = F.when(F.lower("name") == "nation_1", "N/A").when(F.lower("name") == "nation_2", "12,5").otherwise(F.col("name"))
    return a.places(spark, d).select("place_id", predicates.place_or_null(name).alias("cleaned"))


@query(f"WITH {PLACES_SQL} SELECT place_id, name AS focused FROM places")
def fp10_focused_place(spark, d):
    return a.places(spark, d).select("place_id", predicates.focused_place(F.concat(F.lit("unknown; "), "country", F.lit("; "), "name"), F.col("country")).alias("focused"))


@query(f"WITH {PLACES_SQL} SELECT place_id, country || ' Province' AS province, 'Kota ' || name AS city FROM places")
def fp11_split_admin(spark, d):
    s = predicates.split_admin(F.concat(F.lit("Kota "), "name", F.lit(", "), "country", F.lit(" Province")))
    return a.places(spark, d).select("place_id", s["province"].alias("province"), s["city"].alias("city"))


@query(f"""WITH {FACTS_SQL} SELECT count(*) FILTER (WHERE alert) AS alerts, count(*) FILTER (WHERE alert AND NOT needs_review AND NOT (source_type = 'BUILDING' AND NOT is_relevant)) AS kept FROM facts""")
def fp20_calibrated_alert(spark, d):
    status = F.when(F.col("needs_review"), "rumor").otherwise("confirmed")
    channel = F.when(F.col("source_type") == "BUILDING", "social").otherwise("media")
    kept = predicates.calibrated_alert(F.col("alert"), status, channel, F.col("is_relevant"), F.array().cast("array<string>"))
    return a.facts(spark, d).agg(F.count_if("alert").alias("alerts"), F.count_if(kept).alias("kept"))


@query(f"WITH {ARTICLES_SQL} SELECT count(*) FILTER (WHERE deaths = 0) AS zeros, count(*) FILTER (WHERE deaths = 0 AND cases % 2 = 0) AS kept FROM arts")
def fp25_null_unknown_zero(spark, d):
    """Half of the articles say nothing of deaths: their zero is unknown."""
    x = articles_of(spark, d)
    said = F.when(F.col("cases") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", " and [0-9]+ deaths", ""))
    fixed = predicates.null_unknown_zero(F.col("deaths"), said)
    return x.agg(F.count_if(F.col("deaths") == 0).alias("zeros"), F.count_if(fixed == 0).alias("kept"))


@query(f"""WITH {FACTS_SQL}, g AS (SELECT report_id, max(cases) AS c, CAST(sum(deaths) AS BIGINT) AS x, count(DISTINCT CASE WHEN deaths > 0 THEN label END) AS k, bool_or(alert) AS o FROM facts GROUP BY 1)
  SELECT report_id, o OR k >= 2 OR (c >= 25 OR x > 0) AND o AS alert, CASE WHEN o THEN 'official' WHEN k >= 2 THEN 'spread' ELSE 'none' END AS signal FROM g""")
def fp26_decide_alert(spark, d):
    """An official advisory, or deaths under two labels, or an explicit outbreak with 25 cases or a death."""
    fatal = F.when(F.col("deaths") > 0, F.col("label"))
    # two labels at least: the first and the last differ, so no report's labels are kept
    several = F.coalesce(F.min(fatal) != F.max(fatal), F.lit(False))
    g = a.facts(spark, d).groupBy("report_id").agg(F.max("cases").alias("c"), F.sum("deaths").alias("x"), several.alias("k"), F.bool_or("alert").alias("o"))
    alert = F.col("o") | F.col("k") | (((F.col("c") >= 25) | (F.col("x") > 0)) & F.col("o"))
    return g.select("report_id", alert.alias("alert"), F.when(F.col("o"), "official").when(F.col("k"), "spread").otherwise("none").alias("signal"))


@query("""SELECT doc_id AS report_id, CASE WHEN regexp_matches(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' of the ') THEN 1 END AS request_id FROM documents WHERE contains(' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ', ' of the ')""")
def jn14_match_articles(spark, d):
    docs = a.scan(spark, d, "documents").select(F.col("doc_id").alias("report_id"), "text", F.lit("2024-01-10").cast("date").alias("published_at"))
    requests = spark.createDataFrame([(1, ["of the"], "2024-01-01", "2024-02-01"), (2, ["the"], "2023-01-01", "2023-02-01")], "request_id int, terms array<string>, since string, until string")
    return lookup.match_articles(docs, requests.withColumn("since", F.to_date("since")).withColumn("until", F.to_date("until")))


@query(f"""WITH {FACTS_SQL}, {PLACES_SQL} SELECT place, country, CASE WHEN place IN ('NATION_0', 'NATION_5') THEN 'curated' WHEN place = 'NATION_24' THEN 'centroid' ELSE 'gazetteer' END AS pin, count(*) AS n FROM facts GROUP BY 1, 2""")
def fn20_pin_place(spark, d):
    p = a.places(spark, d).where("country <> 'OLD'").select("name", "country", "lat", "lon")
    boxes = spark.createDataFrame([("MIDDLE EAST", -90.0, 90.0, 0.0, 135.0), ("AFRICA", -90.0, 90.0, -180.0, 180.0)], "country string, south double, north double, west double, east double")
    cent = p.groupBy("country").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    f = a.facts(spark, d).select("place", "country")
    return lookup.pin_place(f, p.where("name in ('NATION_0', 'NATION_5')"), p, cent, boxes).groupBy("place", "country", "pin").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS k, string_agg(l_returnflag || '(' || n || ')', '; ' ORDER BY n DESC, l_returnflag) AS t FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def fn13_format_counts(spark, d):
    g = a.scan(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    return g.groupBy(F.col("l_orderkey").alias("k")).agg(text.format_counts(F.collect_list(F.struct(F.col("l_returnflag").alias("label"), "n"))).alias("t"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM pages)
  SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS page FROM p""")
def fn14_strip_markup(spark, d):
    return a.scan(spark, d, "pages").select("page_id", F.sha2(text.strip_markup(F.col("html")), 256).alias("page"))


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS folded, strip_accents(lower(['ÉÀôü', 'Cancún', 'Curaçao', 'España', 'Škoda', 'Žďár'][c_custkey % 6 + 1] || c_name)) AS plain FROM customer")
def fn15_fold_digits(spark, d):
    arabic = F.translate(F.col("c_custkey").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    word = F.get(F.array(*map(F.lit, ["ÉÀôü", "Cancún", "Curaçao", "España", "Škoda", "Žďár"])), (F.col("c_custkey") % 6).cast("int"))
    return a.scan(spark, d, "customer").select("c_custkey", text.fold_digits(arabic).alias("folded"), text.fold_accents(F.concat(word, "c_name")).alias("plain"))


@query("SELECT l_orderkey AS k, round(avg(l_discount) FILTER (WHERE l_linenumber < 6), 6) AS m FROM (SELECT l_orderkey, l_linenumber, min(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def fn19_mean_valid(spark, d):
    one = a.scan(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_discount").alias("v"))
    value = F.when(F.col("l_linenumber") < 6, F.col("v")).otherwise(-999.0)
    g = one.groupBy(F.col("l_orderkey").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", value.alias("v")))).alias("m"))
    return g.select("k", F.round(values.mean_valid(F.col("m")), 6).alias("m"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'old,new' ELSE 'new' END AS flags, 'a,b,c' AS labels, 'x | y' || chr(10) || 'z' AS t FROM customer")
def fn22_flags(spark, d):
    old = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("old"), F.lit("new")))
    lists = values.union_labels(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))
    cells = F.array(F.array(F.lit("x "), F.lit("y")), F.array(F.lit("z")))
    return a.scan(spark, d, "customer").select("c_custkey", F.array_join(values.add_flag(old, "new"), ",").alias("flags"), F.array_join(lists, ",").alias("labels"), values.table_lines(cells).alias("t"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'weekly' WHEN o_orderstatus = 'O' THEN 'cumulative' ELSE 'unspecified' END AS bucket FROM orders")
def fn6_time_bucket(spark, d):
    t = F.when(F.col("o_orderstatus") == "F", "Cases per week").when(F.col("o_orderstatus") == "O", "cumulative total").otherwise("none")
    return a.scan(spark, d, "orders").select("o_orderkey", dates.time_bucket(t).alias("bucket"))


@query("""WITH e AS (SELECT l_orderkey AS id, l_linenumber AS i, l_returnflag AS name, CAST(l_quantity AS BIGINT) AS cases FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i, cases, name) AS k FROM e), o AS (SELECT id, name, min(k) AS k FROM r GROUP BY 1, 2)
  SELECT o.id, o.name, CASE WHEN o.k = 1 THEN 'primary' ELSE 'mentioned' END AS role, CASE WHEN o.k = 1 THEN r.cases END AS cases FROM o JOIN r ON o.id = r.id AND o.k = r.k""")
def fn23_relations(spark, d):
    rows = a.scan(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("cases"), F.col("l_returnflag").alias("name")).alias("m"))
    return bridge_rows(rows.groupBy("id").agg(F.array_sort(F.collect_list("m")).alias("mentions")))


def bridge_rows(df):
    """id, name, role, cases: the first mention is primary and alone has the counts; later ones of its name are the same row."""
    e = df.select("id", F.posexplode("mentions").alias("i", "m"))
    one = dedup.best_per_key(e.select("id", "i", "m.name", "m.cases"), ["id", "name"], [F.asc("i")])
    first = F.col("i") == 0
    return one.select("id", "name", F.when(first, "primary").otherwise("mentioned").alias("role"), F.when(first, F.col("cases")).alias("cases"))


@query("""WITH g AS (SELECT l_orderkey AS id, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS cases FROM lineitem GROUP BY 1) SELECT id, NULL::INTEGER AS child, CASE WHEN n >= 2 THEN NULL ELSE cases END AS cases FROM g
  UNION ALL SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey) - 1 AS INTEGER), CAST(l_quantity AS BIGINT) FROM lineitem""")
def fn24_children(spark, d):
    """Sub-events become child facts; a parent with two or more loses its counts, so that sums count once."""
    s = F.struct("l_linenumber", "l_quantity", "l_partkey")
    g = a.scan(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").cast("long").alias("cases"), F.array_sort(F.collect_list(s)).alias("events"))
    parents = g.select("id", F.lit(None).cast("int").alias("child"), F.when(F.size("events") < 2, F.col("cases")).alias("cases"))
    kids = g.select("id", F.posexplode("events").alias("child", "e")).select("id", "child", F.col("e.l_quantity").cast("long").alias("cases"))
    return parents.unionByName(kids)


@query(rf"""WITH {sentences_sql("documents")}, w AS (SELECT doc_id, sentence, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM sents),
  p AS (SELECT doc_id, sentence, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w), m AS (SELECT * FROM p WHERE word IN ('the', 'la', 'die')),
  c AS (SELECT p.doc_id, p.sentence, p.pos, p.word AS anchor, m.word AS mention, row_number() OVER (PARTITION BY p.doc_id, p.sentence, p.pos ORDER BY abs(p.pos - m.pos), m.pos) AS k
    FROM p JOIN m ON p.doc_id = m.doc_id AND p.sentence = m.sentence WHERE length(p.word) >= 12)
  SELECT doc_id, sentence, CAST(pos AS INTEGER) AS pos, anchor, mention FROM c WHERE k = 1""")
def wn12_nearest_mention(spark, d):
    s = textjobs.sentences(a.scan(spark, d, "documents", ["doc_id", "text"])).select("doc_id", "sentence", F.posexplode(textjobs.words(F.col("text"))).alias("pos", "word"))
    m = s.where("word in ('the', 'la', 'die')").withColumnRenamed("word", "mention")
    return dedup.nearest_mention(m, s.where("length(word) >= 12").withColumnRenamed("word", "anchor"))


