"""Text-corpus jobs: languages, sentences, mentions, counts and their relations, flags, periods, chunks.

Each is a job over a table of texts. Lexicons and patterns are tables or parameters; matching is an equi-join on words, so a
lexicon of any size is taken.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilis.functions.text import alias_key, collapse, fold_accents, fold_digits, is_ascii, parse_count, parse_counts
from vigilis.functions.unicode import latin_letters
from vigilis.operators.dedup import drop_nested, set_checkpoint_dir

#: Scripts and their languages.
SCRIPTS = {"th": "\\p{IsThai}", "my": "\\p{IsMyanmar}", "km": "\\p{IsKhmer}", "lo": "\\p{IsLao}", "zh": "\\p{IsHan}", "ar": "\\p{IsArabic}"}

#: Words up to which a lexicon is sent to the scan of the texts.
FEW = 1000


def plain_key(text: Column) -> Column:
    """``alias_key`` without the accents of Latin letters, by built-in functions alone."""
    return alias_key(F.translate(F.lower(text), *latin_letters()))


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case; in ASCII texts a plain class finds the same ones in less time."""
    low = F.lower(text)
    return F.filter(F.when(is_ascii(text), F.split(low, "[^a-z0-9]+")).otherwise(F.split(low, r"[^\p{L}\p{N}]+")), lambda w: w != "")


def language_profile(docs: DataFrame, markers: DataFrame, hint: str | None = None) -> DataFrame:
    """doc_id, language: a hint, else a script's share (three letters and a tenth), else marker words (two votes and a strict lead)."""
    size = F.greatest(F.length("text"), F.lit(1))
    script = F.lit(None).cast("string")
    for lang, block in SCRIPTS.items():
        n = F.regexp_count("text", F.lit(f"[{block}]"))
        script = F.when((n >= 3) & (n * 10 >= size), lang).otherwise(script)
    # the script is worked out before the join, so texts stay where they are
    known = docs.select("doc_id", F.coalesce(F.col(hint) if hint else F.lit(None).cast("string"), script).alias("known"))
    votes = docs.select("doc_id", F.explode(words(F.col("text"))).alias("word")).join(markers, "word").groupBy("doc_id", "lang").agg(F.count("*").alias("n"))
    lead = votes.groupBy("doc_id").agg(F.max_by("lang", F.struct("n", "lang")).alias("top"), F.max("n").alias("most"), F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    marked = F.when((F.col("most") >= 2) & (F.coalesce(F.get("ns", F.lit(1)), F.lit(0)) < F.col("most")), F.col("top"))
    return known.join(lead, "doc_id", "left").select("doc_id", F.coalesce("known", marked, F.lit("unknown")).alias("language"))


#: Connectives that begin a clause of their own.
CONTRASTIVE = ["sementara\\s+itu", "sedangkan", "meanwhile", "in\\s+the\\s+meantime", "by\\s+contrast", "trong\\s+khi(?:\\s+đó)?", "ขณะที่", "samantala", "enquanto\\s+isso", "manakala"]
#: Where a text is cut: places between two characters, so that no pattern runs over a long text.
# no text is cut but behind one of these signs, so the others are passed at the first look
CUTS = r"(?<=[\n!?。！？.\s,;:])(?:" + "|".join([
    r"(?<=\n)(?!\n)", r"(?<=[!?。！？])(?![.!?。！？])", r"(?<![0-9]\.)(?<=\.)(?=\s|\z)", r"(?<=[0-9]\.)(?=\s+[A-Z\"“'‘]|\s*\z)",
    r"(?<=[\s,;:])(?=(?iu:" + "|".join(CONTRASTIVE) + r")(?:\s|\z))",
]) + ")"


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sentence, start, end, text: cut after signs that end sentences, at lines' ends and before contrastive connectives.

    A full stop ends a sentence before white space; behind a digit only before a capital, a quotation mark or the text's end.
    Full-width signs need no white space. Offsets are in characters.
    """
    rows = sentence_arrays(docs).select("doc_id", F.posexplode("pieces").alias("sentence", "p"))
    return rows.select("doc_id", "sentence", "p.start", (F.col("p.start") + F.length("p.text")).alias("end"), "p.text")


#: White space that sentences don't begin or end with.
BLANK = " \t\n\x0b\f\r"


def sentence_arrays(docs: DataFrame) -> DataFrame:
    """doc_id, pieces: (start, text) of the sentences of a text, in order; made within the text, without a shuffle."""
    cut = docs.select("doc_id", F.split("text", CUTS).alias("raws"))
    step = lambda acc, raw: F.struct((acc["at"] + F.length(raw)).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts"))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    placed = cut.select("doc_id", "raws", F.aggregate("raws", none, step, lambda acc: acc["starts"]).alias("starts"))
    left = F.zip_with("starts", "raws", lambda at, raw: F.struct((at + F.length(raw)).alias("to"), F.ltrim(raw, F.lit(BLANK)).alias("left")))
    # what is cut off on the left is told by where the piece ends
    own = F.transform(F.filter(left, lambda p: p["left"] != ""), lambda p: F.struct((p["to"] - F.length(p["left"])).alias("start"), F.rtrim(p["left"], F.lit(BLANK)).alias("text")))
    return placed.select("doc_id", own.alias("pieces"))


def mentions(docs: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, start, end (words, end exclusive), alias, concept: aliases of any number of words, the longest where they nest.

    Words are compared in lower case without accents. They meet the lexicon's words; an alias of several words is found where all of
    its words stand one after another. Words of a small lexicon are told apart where the texts lie; of a large one, only its words
    leave the join. Aliases inside texts without spaces: ``scripts.unspaced_mentions``.
    """
    lex = lexicon.select(plain_key(F.col("alias")).alias("alias"), "concept").distinct().where("alias <> ''").withColumn("size", F.size(F.split("alias", " ")))
    few = [r.word for r in lex.select(F.explode(F.split("alias", " ")).alias("word")).distinct().limit(FEW + 1).collect()]
    # texts made from narrow rows look small to the planner: it may never choose them as the side that is broadcast
    known = lex.limit(FEW + 1).collect()
    if len(few) <= FEW and len(known) <= FEW:
        return drop_nested(_few_mentions(docs, known, lex, text))
    every = F.transform(F.split(plain_key(F.col(text)), " "), lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    rows = docs.select("doc_id", F.inline(F.filter(every, lambda x: x["word"].isin(few)) if len(few) <= FEW else every))
    parts = lex.select("alias", "concept", "size", F.posexplode(F.split("alias", " ")).alias("k", "word"))
    hit = rows.join(parts.hint("merge"), "word").select("doc_id", (F.col("at") - F.col("k")).alias("start"), "alias", "concept", "size")
    long = hit.where("size > 1").groupBy("doc_id", "start", "alias", "concept", "size").agg(F.count("*").alias("n")).where("n = size").drop("n")
    found = hit.where("size = 1").unionByName(long).select("doc_id", "start", (F.col("start") + F.col("size")).alias("end"), "alias", "concept")
    return drop_nested(found)


def _few_mentions(docs: DataFrame, known: Sequence, lex: DataFrame, text: str) -> DataFrame:
    """Mentions of a small lexicon (rows ``known`` of ``lex``): each place where an alias may begin, with as many words as the longest has, meets it in the scan."""
    first = sorted({r.alias.split(" ")[0] for r in known})
    most = max((r["size"] for r in known), default=1)
    cut = docs.select("doc_id", F.split(plain_key(F.col(text)), " ").alias("__ws"))
    places = F.filter(F.transform("__ws", lambda w, i: F.struct(i.alias("start"), w.alias("word"))), lambda x: x["word"].isin(first))
    run = F.transform(places, lambda x: F.struct(x["start"].alias("start"), x["word"].alias("word"), F.slice("__ws", x["start"] + 1, most).alias("run")))
    side = F.broadcast(docs.sparkSession.createDataFrame(known, lex.schema).withColumn("word", F.substring_index("alias", " ", 1)))
    hit = cut.select("doc_id", F.inline(run)).join(side, "word").where(F.array_join(F.slice("run", F.lit(1), F.col("size")), " ") == F.col("alias"))
    return hit.select("doc_id", "start", (F.col("start") + F.col("size")).alias("end"), "alias", "concept")


def with_mentions(docs: DataFrame, lexicon: DataFrame, column: str, text: str = "text") -> DataFrame:
    """``docs`` (a row for each doc_id) with the aliases of ``mentions`` in each text as an array, as often as they are found; null where there are none.

    lexicon: alias, as ``plain_key`` gives it. A small one is looked for within the rows, without windows or joins: what an alias may
    lie in begins at most as many words before it as the longest alias has.
    """
    lex = lexicon.select("alias").distinct().where("alias <> ''")
    known = [r.alias for r in lex.limit(FEW + 1).collect()]
    if len(known) > FEW:
        found = mentions(docs, lex.withColumn("concept", F.col("alias")), text).groupBy("doc_id").agg(F.collect_list("concept").alias(column))
        return docs.join(found, "doc_id", "left")
    sized: dict[int, list[str]] = {}
    for alias in known:
        sized.setdefault(alias.count(" ") + 1, []).append(alias)
    first, most = sorted({alias.split(" ")[0] for alias in known}), max(sized, default=1)

    def at(ws: Column) -> Column:
        """For each word the end and alias of the longest alias that begins there, else null."""
        run = lambda w, i, n: w if n == 1 else F.array_join(F.slice(ws, i + 1, n), " ")
        longest = lambda w, i: [F.when(run(w, i, n).isin(sized[n]), F.struct((i + n).alias("end"), run(w, i, n).alias("alias"))) for n in sorted(sized, reverse=True)]
        return F.transform(ws, lambda w, i: F.when(w.isin(first), F.coalesce(*longest(w, i))))

    def kept(ends: Column) -> Column:
        before = lambda i: F.array_max(F.transform(F.slice(ends, F.greatest(i - most + 2, F.lit(1)), F.least(i, F.lit(most - 1))), lambda x: x["end"]))
        own = F.filter(ends, lambda x, i: x.isNotNull() & (x["end"] > F.coalesce(before(i), F.lit(0))))
        return F.transform(own, lambda x: x["alias"])

    # names of lambdas hold words and ends: a filter on the column that is pushed below it makes neither anew for each word
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    found = once(F.split(plain_key(F.col(text)), " "), lambda ws: once(at(ws), kept)) if known else F.array().cast("array<string>")
    return docs.withColumn(column, once(found, lambda x: F.when(F.size(x) > 0, x)))


def labelled_counts(docs: DataFrame, terms: Mapping[str, str]) -> DataFrame:
    """``docs`` with, for each metric, the largest number next to its words (pattern), on either side."""
    number = r"([0-9][0-9.,]*(?:\s*(?:thousand|million|ribu|juta))?)"
    t = fold_digits(F.col("text"))
    out = docs
    for metric, words_ in terms.items():
        after = F.regexp_extract_all(t, F.lit(rf"(?i){number}\s+(?:new\s+)?(?:{words_})\b"), 1)
        before = F.regexp_extract_all(t, F.lit(rf"(?i)\b(?:{words_})\s*(?::|of|=)?\s*{number}"), 1)
        out = out.withColumn(metric, F.array_max(parse_counts(F.concat(after, before))))
    return out


def filter_counts(mentions_: DataFrame) -> DataFrame:
    """Number mentions (n, left, right: the text around) that aren't years, ages, days, samples, doses or beyond reason."""
    left, right = F.lower("left"), F.lower("right")
    year = F.col("n").between(1900, 2100) & (right.rlike(r"^\s*[,.)]?\s*$") | left.rlike(r"(^|\W)(in|of|since|year)\s*$"))
    age = right.rlike(r"^\s*-?(years?|yrs?)\b(?!.*cases)") | left.rlike(r"\baged?\s*$")
    day = left.rlike(r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\s*$")
    other = right.rlike(r"^\s*(samples?|doses?|tests?|people were (tested|vaccinated)|percent|%)")
    return mentions_.where(~(year | age | day | other) & (F.col("n") <= 50_000_000))


def relations(mentions_: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts (doc_id, sentence, pos, metric, n) with the nearest place and label mention (kind, name, pos) of their sentence.

    Before wins over after; equal relations are merged with their largest count, and the sentences are kept as evidence.
    """
    side = mentions_.select("doc_id", "sentence", F.col("pos").alias("mpos"), "kind", "name")
    pair = counts.join(side, ["doc_id", "sentence"], "left")
    rank = F.struct(F.abs(F.col("pos") - F.col("mpos")), F.col("mpos") > F.col("pos"), F.col("mpos"))
    pick = lambda k: F.min_by(F.when(F.col("kind") == k, F.col("name")), F.when(F.col("kind") == k, rank))
    one = pair.groupBy("doc_id", "sentence", "pos", "metric", "n").agg(pick("place").alias("place"), pick("label").alias("label"))
    return one.groupBy("doc_id", "label", "place", "metric").agg(F.max("n").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_set("sentence")), lambda s: s.cast("string")), ",").alias("evidence"))


#: Phrases by kind and language, in the order in which kinds win. ``any`` is for languages that aren't divided
#: by spaces, whose phrases are found anywhere; the others' are found as whole words. A space stands for any white space.
PHRASES: dict[str, list[tuple[str, dict[str, str]]]] = {
    "status": [
        ("retracted", {"id": "hoaks|bantah|membantah|salah diagnosis|bukan (?:kasus|wabah|penyakit|demam berdarah|antraks|rabies|kolera)|tidak benar|kabar bohong", "en": "hoax|disproven|false alarm|retracted", "vi": "bác bỏ|khẳng định sai"}),
        ("rumor", {"id": "kabar burung|isu beredar|belum terverifikasi|viral di medsos|viral di media sosial|isu liar", "en": "rumor|unverified", "vi": "tin đồn(?: thất thiệt)?"}),
        ("suspected", {"id": "diduga|suspek|dugaan|kemungkinan|gejala mirip|indikasi|tanda[- ]tanda|menyerupai|terindikasi", "en": "suspected|probable", "vi": "nghi ngờ|ca nghi", "any": "สงสัย"}),
        ("negative_surveillance", {"id": "tidak ada kasus|belum ada kasus", "en": r"no(?: new)?(?: [\w-]+){0,6} cases?|no case|zero cases?|not yet detected"}),
        ("confirmed", {"id": "terkonfirmasi|positif|hasil lab(?:oratorium)?|uji lab(?:oratorium)?|swab positif|pcr positif|positif terpapar", "en": "confirmed|laboratory[- ]confirmed", "vi": "xác nhận|ca xác nhận", "any": "ยืนยัน|ผลตรวจยืนยัน"}),
        ("official_report", {"id": "kemenkes(?:ri)?|dinkes|kementerian kesehatan|dinas kesehatan|pemerintah daerah|pemda|pejabat kesehatan|siaran pers|keterangan resmi|laporan resmi", "en": "who|cdc|moh|doh|press release"}),
    ],
    "metric": [
        ("historical_cases", {"id": "sebelumnya|tahun lalu|wabah sebelumnya|periode sebelumnya|pada tahun (?:19[0-9]{2}|20[01][0-9]|202[0-5])", "en": "in (?:19[0-9]{2}|20[01][0-9]|202[0-5])|historically|previously|past outbreak|prior outbreak|historical|in the same period last year|compared (?:with|to) last year|for the whole of 20[0-9]{2}|in all of 20[0-9]{2}"}),
        ("cumulative_cases", {"id": "sejak awal tahun|total akumulatif|akumulasi|sepanjang tahun|sepanjang 20[0-9]{2}|total kasus|secara keseluruhan", "en": "cumulative|to date|so far this year|year[- ]to[- ]date|ytd", "vi": "tổng số ca|tích lũy", "ms": "kes kumulatif", "any": "สะสม|ตั้งแต่ต้นปี|จนถึงปัจจุบัน|សរុប|ສະສົມ"}),
        ("new_cases", {"id": "kasus baru|penambahan(?: kasus)?|tambahan kasus|tercatat hari ini|dalam 24 jam terakhir", "en": "new cases?", "vi": "ca mắc mới|ca mới", "ms": "kes baharu", "tl": "kaso bago", "any": "รายใหม่|ผู้ป่วยใหม่"}),
        ("active_cases", {"id": "kasus aktif|masih dirawat|dalam perawatan|sedang dirawat", "en": "active cases?|currently hospitali[sz]ed", "vi": "đang điều trị"}),
    ],
    "deaths": [("deaths", {"id": "kematian|meninggal(?: dunia)?|korban jiwa|tewas", "en": "deaths?|fatalities", "vi": "tử vong", "any": "เสียชีวิต|ผู้เสียชีวิต|ស្លាប់|អ្នកស្លាប់|ເສຍຊີວິດ|သေဆုံး"})],
}
#: How many characters of a text say its status and its metric.
STATUS_WINDOW, METRIC_WINDOW = 3000, 1500


def phrase_pattern(by_language: Mapping[str, str], languages: Sequence[str] | None = None, flags: str = "iuU") -> str:
    """One pattern, without case, for the phrases of ``languages`` (all if None)."""
    chosen = {k: p.replace(" ", r"\s+") for k, p in by_language.items() if languages is None or k == "any" or k in languages}
    whole, inside = "|".join(p for k, p in chosen.items() if k != "any"), chosen.get("any")
    sides = [rf"(?<![\w])(?:{whole})(?![\w])"] if whole else []
    return f"(?{flags})" + "|".join([*sides, *([inside] if inside else [])])


def has_phrase(text: Column, by_language: Mapping[str, str], languages: Sequence[str] | None = None) -> Column:
    """Whether a phrase occurs; false for null. In ASCII texts classes and cases are the same without the flags for Unicode, which are slow."""
    own = F.when(is_ascii(text), text.rlike(phrase_pattern(by_language, languages, "i"))).otherwise(text.rlike(phrase_pattern(by_language, languages)))
    return F.coalesce(own, F.lit(False))


def first_match(text: Column, kinds: Sequence[tuple[str, Mapping[str, str]]], default: str, languages: Sequence[str] | None = None) -> Column:
    """The first of ``kinds`` with a phrase in ``text``; null texts have none."""
    out = F.lit(default)
    for name, by_language in reversed(kinds):
        out = F.when(has_phrase(text, by_language, languages), name).otherwise(out)
    return out


def epistemic_status(text: Column, evidence: Column | None = None, languages: Sequence[str] | None = None) -> Column:
    """retracted, rumor, suspected, negative_surveillance, confirmed, official_report, or else reported."""
    sample = F.concat_ws(" ", F.coalesce(evidence, F.lit("")), F.coalesce(text, F.lit(""))) if evidence is not None else text
    return first_match(F.substring(sample, 1, STATUS_WINDOW), PHRASES["status"], "reported", languages)


def metric_type(text: Column, has_cases: Column | None = None, period: Column | None = None, languages: Sequence[str] | None = None) -> Column:
    """What a count counts. Deaths only where there are no cases (``has_cases``, true if left out); a known ``period`` wins over the text's."""
    sample = F.substring(text, 1, METRIC_WINDOW)
    own = first_match(sample, PHRASES["metric"], "cases", languages)
    if period is not None:
        historical = own == "historical_cases"
        own = F.when(historical | (period == "historical"), "historical_cases").when(period == "cumulative", "cumulative_cases").otherwise(own)
    if has_cases is None:
        return own
    died = first_match(sample, PHRASES["deaths"], "", languages) == "deaths"
    return F.when(~has_cases & died, "deaths").when(~has_cases & (own == "historical_cases"), "historical_deaths").otherwise(own)


def is_evidence(text: Column, pattern: str) -> Column:
    return F.length(text).between(20, 800) & text.rlike("[0-9]") & text.rlike(rf"(?i)\b({pattern})\b")


def evidence(sentences_: DataFrame, pattern: str, most: int = 10) -> DataFrame:
    """The first ``most`` sentences of each document with 20 to 800 characters, a number and a word of ``pattern``."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("sentence"))
    return sentences_.where(is_evidence(F.col("text"), pattern)).withColumn("__n", rank).where(f"__n <= {most}").drop("__n")


def text_evidence(docs: DataFrame, pattern: str, most: int = 10) -> DataFrame:
    """``evidence`` of the ``sentences`` of ``docs``, chosen within each text; no doc_id may come twice."""
    numbered = F.transform("pieces", lambda p, i: F.struct(i.alias("sentence"), p["start"].alias("start"), (p["start"] + F.length(p["text"])).alias("end"), p["text"].alias("text")))
    chosen = F.filter(numbered, lambda x: is_evidence(x["text"], pattern))
    return sentence_arrays(docs).select("doc_id", F.inline(F.slice(chosen, 1, most)))


#: Words of topics that aren't outbreaks, and of outbreaks.
TOPICS: dict[str, dict[str, str]] = {
    "academic": {"en": "study|journal|researchers|peer-reviewed", "id": "jurnal|penelitian|peneliti|studi"},
    "agricultural": {"en": "crop|livestock|harvest|farmers", "id": "peternak|ternak|panen|petani"},
    "metaphor": {"en": "viral video|epidemic of (?:crime|loneliness)", "id": "video viral|wabah korupsi"},
    "prevention": {"en": "hand washing|prevention campaign|awareness", "id": "cuci tangan|kampanye pencegahan"},
    "vaccine": {"en": "vaccination campaign|immuni[sz]ation drive|vaccine rollout", "id": "vaksinasi massal|imunisasi massal"},
    "chronic": {"en": "diabetes|cancer|hypertension|stroke", "id": "kanker|hipertensi"},
    "policy": {"en": "regulation|bill|parliament|budget", "id": "peraturan|anggaran|parlemen"},
    "disease_free": {"en": "declared free|eradicated|end of the outbreak", "id": "bebas dari|dinyatakan bebas"},
    "outbreak": {"en": "outbreak|cluster|cases|surge", "id": "wabah|klaster|kasus|lonjakan", "vi": "ổ dịch|bùng phát", "any": "ระบาด|ការផ្ទុះ|ລະບາດ"},
}


def topic_flags(docs: DataFrame, topics: Mapping[str, Mapping[str, str]] = TOPICS, languages: Sequence[str] | None = None) -> DataFrame:
    """doc_id and a flag for each topic: a phrase of any (or of the given) languages occurs. Null texts have no topic."""
    return docs.select("doc_id", *[has_phrase(F.col("text"), p, languages).alias(k) for k, p in topics.items()])


def quality_flags(text: Column) -> Column:
    """Flags of a document, in a fixed order."""
    t = collapse(F.coalesce(text, F.lit("")))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\s]", ""))
    tests = [
        F.when(F.length(t) == 0, "empty"), F.when((F.length(t) > 0) & (F.length(t) < 120), "short"), F.when(F.regexp_count(t, F.lit(r"\|")) > F.size(F.split(t, " ")) / 4, "navigation"),
        F.when(t.rlike("(?i)enable javascript|captcha|are you a robot"), "challenge"), F.when(t.rlike(r"(\.\.\.|…|read more)$"), "truncated"), F.when((F.length(t) > 0) & (letters < F.length(t) * 0.8), "noisy"),
    ]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def needs_second_pass(df: DataFrame) -> DataFrame:
    """Documents that need a costly look: no label or place, several distinct case figures, or deaths over cases. Columns: label, place, figures (array), deaths."""
    figures = F.array_distinct(F.filter("figures", lambda x: x.isNotNull()))
    gate = F.col("label").isNull() | F.col("place").isNull() | (F.size(figures) > 2) | F.coalesce(F.col("deaths") > F.array_max(figures), F.lit(False))
    return df.withColumn("distinct_figures", F.size(figures)).withColumn("second_pass", gate)


def resolve_label(df: DataFrame, rule: str, model: str, score: str, least: float = 0.6) -> DataFrame:
    """The rule's label, else the model's if it is sure; ``conflict`` where they differ."""
    sure = F.when(F.col(score) >= least, F.col(model))
    return df.withColumn("resolved", F.coalesce(F.col(rule), sure, F.lit("UNKNOWN"))).withColumn("conflict", F.coalesce(F.col(rule) != sure, F.lit(False)))


def hierarchy(df: DataFrame, places: DataFrame, place: str = "place", hint: str = "country") -> DataFrame:
    """``df`` with admin1 and country of its place by folded name; of namesakes, the one in the hinted country, then the smallest id."""
    key = fold_accents(F.col(place))
    side = places.select(fold_accents(F.col("name")).alias("__k"), F.col("country").alias("__c"), F.col("admin1").alias("__a"), F.col("place_id").alias("__i")).alias("p")
    best = Window.partitionBy("__row").orderBy(F.when(F.col("__c") == F.col(hint), 0).otherwise(1), "__i")
    rows = df.withColumn("__key", key)
    names = rows.select("__key", hint).distinct().withColumn("__row", F.struct("__key", hint))
    one = names.join(side, F.col("__key") == F.col("__k")).withColumn("__n", F.row_number().over(best)).where("__n = 1").select(F.col("__key").alias("__x"), F.col(hint).alias("__y"), F.col("__a").alias("admin1"), F.col("__c").alias("place_country"))
    return rows.join(one, (F.col("__key") == F.col("__x")) & F.col(hint).eqNullSafe(F.col("__y")), "left").drop("__key", "__x", "__y")


def discover_terms(docs: DataFrame, lexicon: DataFrame, least: int = 3, most: int = 2) -> DataFrame:
    """Runs of up to ``most`` words that no alias is: occurrences, documents and the first document, at least ``least`` documents.

    Level by level: a longer run can't be in more documents than its parts, so it is counted only where both of its parts may
    have reached the limit. A filter of fixed size, which goes to the scan, tells most of the others.
    """
    set_checkpoint_dir(docs.sparkSession)
    own = docs.select("doc_id", words(F.col("text")).alias("ws"))
    # where no id comes twice, a text alone tells how often it has a run, and texts needn't meet their runs again
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    out = known = None
    for n in range(1, most + 1):
        found = run_counts(runs_of(own, n, known), least) if twice else text_run_counts(run_arrays(own, n, known), least)
        if n < most:
            found = found.checkpoint()
            known = compact_filter(found)
        out = found if out is None else out.unionByName(found)
    return out.join(lexicon.select(alias_key(F.col("alias")).alias("term")).distinct(), "term", "left_anti")


#: Bits of the filter of frequent runs, 64 to a word: 128 KB.
FILTER_WORDS = 1 << 14


def _filter_place(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FILTER_WORDS * 64))


def compact_filter(found: DataFrame) -> DataFrame:
    """One row, ``frequent``: an array of FILTER_WORDS numbers with a bit set for the hash of each ``term``."""
    at = _filter_place(F.col("term"))
    words_ = found.select(F.floor(at / 64).cast("int").alias("k"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit"))
    by_word = words_.groupBy("k").agg(F.bit_or("bit").alias("bits"))
    every = found.sparkSession.range(FILTER_WORDS).select(F.col("id").cast("int").alias("k")).join(by_word, "k", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("bits", F.lit(0)).cast("long").alias("bits")))), lambda x: x["bits"]).alias("frequent"))


def run_arrays(own: DataFrame, n: int, known: DataFrame | None) -> DataFrame:
    """doc_id, runs: runs of ``n`` words of ``own`` (doc_id, ws), those alone whose two parts of n - 1 words may be in ``known`` (a filter)."""
    # a run is its first part and the last word of the part that begins a word later; null where a part is missing
    join = lambda x: F.zip_with(x, F.slice(x, 2, F.greatest(F.size(x), F.lit(1))), lambda p, q: F.concat(p, F.lit(" "), F.substring_index(q, " ", -1)))
    runs = F.col("ws")
    for k in range(1, n):
        if k == n - 1 and known is not None:
            own = own.crossJoin(F.broadcast(known))  # one row of fixed size
            seen = F.transform(F.transform(runs, _filter_place), lambda p: F.getbit(F.get("frequent", F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1)
            own = own.select("doc_id", F.zip_with(runs, seen, lambda r, ok: F.when(ok, r)).alias("parts"))
            runs = F.col("parts")
        runs = join(runs)
    return own.select("doc_id", F.filter(runs, lambda r: r.isNotNull()).alias("runs"))


def runs_of(own: DataFrame, n: int, known: DataFrame | None) -> DataFrame:
    """doc_id, term: the runs of ``run_arrays``, a row for each."""
    return run_arrays(own, n, known).select("doc_id", F.explode("runs").alias("term"))


def run_counts(rows: DataFrame, least: int) -> DataFrame:
    counts = rows.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"))
    return counts.where(F.col("docs") >= least)


def text_run_counts(arrays: DataFrame, least: int) -> DataFrame:
    """``run_counts`` of ``arrays`` (doc_id, runs), where no doc_id comes twice."""
    ordered = arrays.select("doc_id", F.sort_array("runs").alias("s"))
    # in order, a text's last copy of a run is the one before another run
    rows = ordered.select("doc_id", F.inline(F.arrays_zip(F.col("s").alias("term"), F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))).alias("next"))))
    last = ~F.col("term").eqNullSafe(F.col("next")) & F.col("doc_id").isNotNull()
    counts = rows.groupBy("term").agg(F.count("*").alias("n"), F.count_if(last).alias("docs"), F.min("doc_id").alias("first_doc"))
    return counts.where(F.col("docs") >= least)


def sections(docs: DataFrame, heading: str = r"^(?:[0-9]+\.|[A-Z][A-Z ]{3,}$)") -> DataFrame:
    """doc_id, section, title, body: lines under each heading; what comes before the first is section 0."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    is_head = F.col("line").rlike(heading)
    n = F.sum(is_head.cast("int")).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    g = lines.withColumn("section", n).withColumn("head", is_head).groupBy("doc_id", "section")
    own = g.agg(F.max(F.when(F.col("head"), F.col("line"))).alias("title"), F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("i", "line")))).alias("rows"))
    return own.select("doc_id", "section", "title", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("body"))


def text_series(docs: DataFrame) -> DataFrame:
    """doc_id, name, n of all 'place: n' or 'week k: n' pairs that semicolons or commas divide."""
    t = F.col("text")
    names, numbers = (F.regexp_extract_all(t, F.lit(r"([\p{L}_][\p{L}0-9_ ]*?)\s*[:=]\s*([0-9][0-9.,]*)(?=\s*(?:[;,.\n]|$))"), g) for g in (1, 2))
    return docs.select("doc_id", F.explode(F.arrays_zip(names.alias("a"), numbers.alias("b"))).alias("z")).select("doc_id", F.trim("z.a").alias("name"), parse_count(F.col("z.b")).alias("n"))


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, chunk, text: whole sentences up to ``size`` characters; a longer sentence is a chunk of its own."""
    pieces = F.regexp_extract_all("text", F.lit(r"([^.!?\n]+[.!?]*\s*|[.!?\n]+\s*)"), 1)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    fits = lambda a, s: F.length(a["now"]) + F.length(s) <= size
    step = lambda a, s: F.when(fits(a, s) | (a["now"] == ""), F.struct(a["done"].alias("done"), F.concat(a["now"], s).alias("now"))).otherwise(F.struct(F.concat(a["done"], F.array(a["now"])).alias("done"), s.alias("now")))
    packed = F.aggregate(pieces, start, step, lambda a: F.filter(F.concat(a["done"], F.array(a["now"])), lambda x: x != ""))
    return docs.select("doc_id", F.posexplode(packed).alias("chunk", "text"))


def post_digest(conversations: DataFrame, most: int = 6, least: int = 20) -> DataFrame:
    """conv_id, digest: the first turn and the first ``most`` later ones that have ``least`` characters and a letter."""
    t = collapse(F.col("text"))
    rows = conversations.select("conv_id", "turn", t.alias("t"))
    main = rows.where("turn = 0").select("conv_id", F.col("t").alias("main"))
    ok = (F.length("t") >= least) & F.col("t").rlike(r"\p{L}")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    later = rows.where("turn > 0").where(ok).withColumn("k", rank).where(f"k <= {most}").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n").alias("rest"))
    return main.join(later, "conv_id", "left").select("conv_id", F.concat_ws("\n", "main", "rest").alias("digest"))


def lede(docs: DataFrame, n: int = 2) -> DataFrame:
    """doc_id, lede: the first ``n`` sentences; what follows a line of links or 'related' isn't part of the article."""
    own = F.regexp_extract("text", r"(?is)^(.*?)(?:\n\s*(?:related|read also|baca juga)\b.*)?$", 1)
    s = F.filter(F.regexp_extract_all(own, F.lit(r"([^.!?\n]+[.!?]*)"), 1), lambda x: F.trim(x) != "")
    return docs.select("doc_id", F.array_join(F.transform(F.slice(s, 1, n), lambda x: F.trim(x)), " ").alias("lede"))


def event_period(docs: DataFrame, at: str = "published_at") -> DataFrame:
    """doc_id, first_day, last_day, source of the period that a text names: a range of dates, an epidemiological week, 'last N weeks', a month and year, a date."""
    from vigilis.functions.dates import mmwr_start

    iso = r"(20\d\d-\d\d-\d\d|19\d\d-\d\d-\d\d)"
    patterns = {
        "range": rf"(?i)(?:from|between)\s+{iso}\s+(?:to|and|until)\s+{iso}", "week": r"(?i)\b(?:epi(?:demiological)?\s+)?week\s+(\d{1,2})\s*(?:of|,|/)\s*((?:19|20)\d\d)", "last": r"(?i)\b(?:last|past)\s+(\d{1,2})\s+(days|weeks|months)",
        "month": r"(?i)\b(january|february|march|april|may|june|july|august|september|october|november|december)\s+((?:19|20)\d\d)", "iso": iso,
    }
    # each pattern runs over a text once; its groups are read from the match
    found = docs.select("doc_id", F.col(at).alias("pub"), *[F.regexp_extract("text", p, 0).alias(k) for k, p in patterns.items()])
    part = lambda k, g: F.regexp_extract(k, patterns[k], g)
    # a text without a date isn't parsed: each failure would raise and catch an exception
    day = lambda x, form: F.when(x != "", F.to_date(F.try_to_timestamp(x, F.lit(form))))
    month = F.when(F.col("month") != "", F.concat_ws(" ", F.initcap(part("month", 1)), part("month", 2), F.lit("1")))
    w, y = part("week", 1).try_cast("int"), part("week", 2).try_cast("int")
    n, unit, pub = part("last", 1).try_cast("int"), F.lower(part("last", 2)), F.col("pub")
    ago = F.when(unit == "days", F.date_sub(pub, n)).when(unit == "weeks", F.date_sub(pub, n * 7)).when(unit == "months", F.add_months(pub, -n))
    dated = found.select(
        "doc_id", "pub", day(part("range", 1), "yyyy-MM-dd").alias("from"), day(part("range", 2), "yyyy-MM-dd").alias("to"), F.when(F.col("week") != "", F.date_add(mmwr_start(y), (w - 1) * 7)).alias("start_week"),
        F.when(F.col("last") != "", ago).alias("ago"), day(month, "MMMM yyyy d").alias("m"), day(F.col("iso"), "yyyy-MM-dd").alias("one"),
    )
    known = lambda c: F.col(c).isNotNull()
    source = F.when(known("to"), "range").when(known("start_week"), "week").when(known("ago"), "relative").when(known("m"), "month").when(known("one"), "date").otherwise("none")
    first = F.coalesce("from", "start_week", "ago", "m", "one")
    end = F.coalesce(F.col("to"), F.date_add("start_week", 6), F.when(known("ago"), pub), F.last_day("m"), F.col("one"))
    return dated.select("doc_id", first.alias("first_day"), end.alias("last_day"), source.alias("source"))


def case_country(mentions_: DataFrame) -> DataFrame:
    """doc_id, country of most points: 3 in the title, 2 in the first two sentences, 1 elsewhere; none for publisher and comparison mentions.

    mentions_: doc_id, country, in_title, sentence, publisher, comparison. Several leaders: 'GLOBAL'.
    """
    points = F.when(F.col("publisher") | F.col("comparison"), 0).when(F.col("in_title"), 3).when(F.col("sentence") < 2, 2).otherwise(1)
    g = mentions_.groupBy("doc_id", "country").agg(F.sum(points).alias("points")).where("points > 0")
    top = g.groupBy("doc_id").agg(F.max("points").alias("most"), F.count("*").alias("countries"), F.max_by("country", F.struct("points", "country")).alias("country"), F.sort_array(F.collect_list("points"), asc=False).alias("p"))
    tie = (F.col("countries") > 3) & (F.get("p", F.lit(1)) == F.col("most"))
    return top.select("doc_id", F.when(tie, "GLOBAL").otherwise(F.col("country")).alias("country"), "most")


def rank_labels(mentions_: DataFrame, generic: Sequence[str]) -> DataFrame:
    """doc_id, label, rank: by first place; labels only negated go, and generic ones where there is a specific one. mentions_: doc_id, label, pos, negated."""
    # dealt and sorted by document and label, then by document: no table of all labels, and no stage with both sorts, in memory
    dealt = mentions_.select("doc_id", "label", "pos", "negated").repartition("doc_id", "label")
    own = Window.partitionBy("doc_id", "label").orderBy("pos")
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    g = dealt.select("doc_id", "label", F.min("pos").over(whole(own)).alias("first"), F.bool_and("negated").over(whole(own)).alias("only_negated"), F.row_number().over(own).alias("__n")).where("__n = 1 and not only_negated")
    vague = F.col("label").isin(list(generic))
    order = Window.partitionBy("doc_id").orderBy("first", "label")
    kept = g.drop("only_negated", "__n").withColumn("__s", F.max((~vague).cast("int")).over(whole(order))).where(~vague | (F.col("__s") == 0))
    return kept.select("doc_id", "label", F.row_number().over(order).alias("rank"))


def project_labels(mentions_: DataFrame, concepts: DataFrame) -> DataFrame:
    """doc_id, identity, needs_review: mentions resolved by concept id, one for each identity; unresolved ones are kept under their name."""
    j = mentions_.join(concepts, "concept_id", "left")
    return j.select("doc_id", F.coalesce("canonical", F.lower("name")).alias("identity"), F.col("canonical").isNull().alias("needs_review")).distinct()


def reconcile_date(published: Column, stated_year: Column) -> Column:
    """The stated year's own last day where it is two years or more off the publication date, else that date."""
    off = F.abs(F.year(published) - stated_year) >= 2
    return F.when(off, F.make_date(stated_year, F.lit(12), F.lit(31))).otherwise(published)


def expand_abbreviations(lexicon: DataFrame, abbreviations: Mapping[str, str]) -> DataFrame:
    """The lexicon (alias, concept) and, for each abbreviation of a word, the aliases with the short form in its place."""
    out = lexicon
    for long, short in abbreviations.items():
        own = lexicon.where(F.lower("alias").rlike(rf"\b{long}\b"))
        out = out.unionByName(own.withColumn("alias", F.regexp_replace(F.lower("alias"), rf"\b{long}\b", short)))
    return out.distinct()
