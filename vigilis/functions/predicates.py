"""Predicates and classes over facts, sources and places, as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASE_CAP, DEATH_CAP = 2_000_000, 200_000


def is_valid(excluded: Sequence[str] = ("test",), min_confidence: float = 0.15) -> Column:
    """The shared predicate of all fact queries: relevant, named, confident enough, dated, not from an excluded source."""
    label = F.upper("label")
    return (
        F.col("is_relevant") & F.col("label").isNotNull() & (label != "UNKNOWN") & ~label.startswith("NEGATIVE")
        & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence) & F.col("published_at").isNotNull()
        & ~F.lower(F.coalesce("source_type", F.lit(""))).isin(list(excluded))
    )


def valid_facts(df: DataFrame, excluded: Sequence[str] = ("test",), min_confidence: float = 0.15) -> DataFrame:
    return df.where(is_valid(excluded, min_confidence))


def clamp(x: Column | str, low: int = 0, high: int | None = None) -> Column:
    """Null counts as zero; without ``high`` only a floor."""
    x = F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0))
    return F.greatest(x if high is None else F.least(x, F.lit(high)), F.lit(low)).cast("long")


def cases() -> Column:
    return clamp("cases", 0, CASE_CAP)


def deaths() -> Column:
    return clamp("deaths", 0, DEATH_CAP)


def fold_label(x: Column, mapping: Mapping[str, str], default: str | None = "OUTSIDE") -> Column:
    """Spellings to canonical names, without regard to case; others become ``default``, or stay if it is None."""
    out = None
    for spelling, name in mapping.items():
        test = F.lower(F.trim(x)) == spelling.lower()
        out = F.when(test, name) if out is None else out.when(test, name)
    other = x if default is None else F.lit(default)
    return other if out is None else out.otherwise(other)


def in_scope(x: Column, scope: str | None, members: Sequence[str]) -> Column:
    """None: all; 'MEMBERS' and 'OUTSIDE': by the member list; else equality."""
    if scope is None:
        return F.lit(True)
    if scope == "MEMBERS":
        return x.isin(list(members))
    if scope == "OUTSIDE":
        return ~F.coalesce(x, F.lit("")).isin(list(members))
    return x == scope


def search(df: DataFrame, text: str | None = None, columns: Sequence[str] = (), **equal) -> DataFrame:
    """Optional filters: ``text`` somewhere in one of ``columns`` without regard to case; equalities that are not None."""
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
        df = df.where(hit)
    for c, value in equal.items():
        if value is not None:
            df = df.where(F.col(c) == F.lit(value))
    return df


def quality_class() -> Column:
    """noise: irrelevant or hardly confident; review: flagged, or lacking a place; else surveillance."""
    return (
        F.when(~F.coalesce("is_relevant", F.lit(False)) | (F.coalesce("confidence", F.lit(0.0)) < 0.15), "noise")
        .when(F.coalesce("needs_review", F.lit(False)) | F.col("place").isNull(), "review")
        .otherwise("surveillance")
    )


#: Words that stand for no place.
NO_PLACE = ["", "-", "n/a", "none", "null", "unknown", "various", "multiple", "global"]


def place_or_null(x: Column) -> Column:
    """Null for stop words, names under three characters, numbers and separators alone."""
    t = F.trim(x)
    return F.when(F.lower(t).isin(NO_PLACE) | (F.length(t) < 3) | t.rlike(r"^[0-9.,]+$") | t.rlike(r"^[\s;,/|-]+$"), F.lit(None)).otherwise(t)


def focused_place(x: Column, country: Column, keep_country: bool = False) -> Column:
    """The first real part of a ';' list that isn't the country itself; the country is kept as a last resort if asked for."""
    parts = F.filter(F.transform(F.split(x, ";"), lambda x: F.trim(x)), lambda p: ~F.lower(p).isin(NO_PLACE))
    other = F.filter(parts, lambda p: F.lower(p) != F.lower(F.coalesce(country, F.lit(""))))
    first = F.get(other, F.lit(0))
    return F.coalesce(first, F.get(parts, F.lit(0))) if keep_country else first


#: Words that mark a province or a city.
PROVINCE_HINTS = "province|provinsi|state|prefecture|governorate"
CITY_HINTS = "city|kota|kabupaten|district|regency|municipality"


def split_admin(x: Column) -> Column:
    """A struct (province, city) from comma-separated parts, by the words that mark them."""
    parts = F.transform(F.split(x, ","), lambda x: F.trim(x))
    pick = lambda words: F.get(F.filter(parts, lambda p: F.lower(p).rlike(rf"\b({words})\b")), F.lit(0))
    return F.struct(pick(PROVINCE_HINTS).alias("province"), pick(CITY_HINTS).alias("city"))


def is_mappable(members: Sequence[str]) -> Column:
    return F.col("place").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.coalesce(F.col("country").isin(list(members)), F.lit(False))


def geo_needs_review() -> Column:
    return F.col("place").isNotNull() & (F.col("lat").isNull() | F.col("lon").isNull())


def in_bbox(df: DataFrame, boxes: DataFrame, country: str = "country") -> DataFrame:
    """``df`` with ``in_bbox``: false without coordinates, true for countries without a box. ``boxes``: one row for each country."""
    b = boxes.select(F.col(country).alias("__c"), "south", "north", "west", "east")
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    test = F.when(F.col("lat").isNull() | F.col("lon").isNull(), False).when(F.col("__c").isNull(), True).otherwise(inside)
    return df.join(b, F.col(country) == F.col("__c"), "left").select(*df.columns, test.alias("in_bbox"))


def channel_of(url: Column, kind: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(F.contains(u, F.lit(".gov")), "official").when(F.contains(u, F.lit("news")), "media")
        .when(F.contains(u, F.lit("blog")) | F.lower(kind).isin("csv", "social"), "social").otherwise("other")
    )


#: Other names of kinds of sources.
KIND_NAMES = {"official government sites": "government", "local news": "news", "google": "web", "facebook": "social_media", "html": "web", "chart": "web", "json": "api", "xml": "rss"}
#: Credibility by kind of source; 0.5 for others.
KIND_CREDIBILITY = {"government": 0.95, "who": 0.95, "hospital": 0.9, "research": 0.85, "news": 0.7, "rss": 0.65, "web": 0.5, "social_media": 0.35, "csv": 0.6, "api": 0.7}
#: Credibility by domain (patterns of a source's URL and name), the first that is found counts.
DOMAIN_CREDIBILITY = [
    (r"who\.int|kemenkes\.go\.id|kemkes\.go\.id|moh\.gov|moph\.go\.th|doh\.gov\.ph", 0.98),
    (r"cdc\.gov", 0.97),
    (r"\.(go\.id|gov\.vn|go\.th|gov\.sg|gov\.my|gov\.ph|gov\.bn|gov\.la|gov\.mm|gov\.kh|gov\.tl)([/:?]|$)", 0.95),
    (r"bbc\.com|bbc\.co\.uk|reuters\.com", 0.94),
    (r"cidrap|apnews\.com|dw\.com", 0.92),
    (r"reliefweb\.int|antaranews\.com|detik\.com", 0.9),
    (r"kompas\.com|cnnindonesia\.com|channelnewsasia\.com|vnexpress\.net|thestar\.com\.my|straitstimes\.com|bangkokpost\.com|nationthailand\.com|rappler\.com|phnompenhpost\.com|malaymail\.com|astroawani\.com", 0.88),
]


def source_credibility(sources: DataFrame, overrides: DataFrame | None = None, domains: Sequence[tuple[str, float]] = DOMAIN_CREDIBILITY) -> DataFrame:
    """``sources`` with credibility (0 to 1) and reason: an override, else the higher of the domain's and the kind's."""
    kind = F.lower(F.trim("kind"))
    for name, other in KIND_NAMES.items():
        kind = F.when(F.lower(F.trim("kind")) == name, F.lit(other)).otherwise(kind)
    base = F.lit(0.5)
    for name, value in KIND_CREDIBILITY.items():
        base = F.when(kind == name, F.lit(value)).otherwise(base)
    text = F.lower(F.concat_ws(" ", *[c for c in ("url", "name") if c in sources.columns]))
    domain = F.lit(None).cast("double")
    for pattern, value in reversed(domains):
        domain = F.when(text.rlike(pattern), F.lit(value)).otherwise(domain)
    out = sources.select(F.struct(*sources.columns).alias("__row"), base.alias("__base"), domain.alias("__domain"))
    given = F.lit(None).cast("double")
    if overrides is not None:
        out = out.join(overrides.select(F.col("source_id").alias("__s"), F.col("credibility").alias("__given")), F.col("__row.source_id") == F.col("__s"), "left")
        given = F.col("__given")
    score = F.coalesce(given, F.greatest("__domain", "__base"))
    reason = F.when(given.isNotNull(), "override").when(F.col("__domain") >= F.col("__base"), "domain").otherwise("heuristic")
    return out.select("__row.*", F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 4).alias("credibility"), reason.alias("reason"))


def coverage_class(country: Column, members: Sequence[str]) -> Column:
    return F.when(country.isin(list(members)), "member").when(F.lower(country).isin("global", "world", "international"), "global").otherwise("unclassified")


def severity_cluster() -> Column:
    """For clusters: only an alert has a severity, critical at twice the threshold or any death, else high; gated by confidence and place."""
    gate = (F.col("confidence") >= 0.35) & (F.trim("place") != "") & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    t = F.greatest(F.coalesce("threshold", F.lit(100)), F.lit(1))
    return (
        F.when(~F.coalesce(gate, F.lit(False)) | ~F.coalesce("alert", F.lit(False)), "info")
        .when((F.col("cases") >= 2 * t) | (F.col("deaths") > 0), "critical").otherwise("high")
    )


def severity_signal() -> Column:
    """For single signals: critical at twice the threshold or any death, high at the threshold or with an alert, any case is a
    warning; gated by confidence."""
    t = F.greatest(F.coalesce("threshold", F.lit(100)), F.lit(1))
    return (
        F.when(~F.coalesce(F.col("confidence") >= 0.35, F.lit(False)), "info").when((F.col("cases") >= 2 * t) | (F.col("deaths") > 0), "critical")
        .when((F.col("cases") >= t) | F.coalesce("alert", F.lit(False)), "high").when(F.col("cases") > 0, "warning").otherwise("info")
    )


SEVERITY_RANK = {"critical": 3, "high": 2, "warning": 1, "info": 0}


def rank_of(x: Column, ranks: Mapping[str, int]) -> Column:
    out = F.lit(0)
    for name, r in ranks.items():
        out = F.when(x == name, r).otherwise(out)
    return out


def priority_band(cases_: Column, alert: Column) -> Column:
    return F.when((cases_ >= 50_000) | alert, "TINGGI").when(cases_ >= 500, "SEDANG").otherwise("RENDAH")


def surge(recent: Column, previous: Column) -> Column:
    return (recent >= 2) & ((previous == 0) | (2 * recent >= 3 * previous))


def hot(recent: Column, previous: Column, cases_: Column, threshold: Column) -> Column:
    return (recent > 0) & (surge(recent, previous) | (cases_ >= 2 * threshold))


def calibrated_alert(alert: Column, status: Column, channel: Column, confirmed: Column, flags: Column) -> Column:
    """Never for historical, retracted or rumoured facts; social channels need confirmation; contradictions suppress."""
    bad = F.coalesce(status.isin("historical", "retracted", "rumor"), F.lit(False)) | ((channel == "social") & ~confirmed) | F.array_contains(flags, "contradiction")
    return alert & ~bad


def fact_flags() -> Column:
    """Validation flags of a fact, in a fixed order."""
    c, d = F.col("cases"), F.col("deaths")
    tests = [
        F.when(d > c, "deaths_exceed_cases"), F.when(c > CASE_CAP, "extreme_count"), F.when((c >= 10) & (d / c > 0.5), "abnormal_fatality"),
        F.when(F.col("label").isin("rumor", "retracted"), "unconfirmed"), F.when(F.col("published_at") < F.add_months("created_at", -12).cast("date"), "historical"),
    ]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def band(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """``labels[i]`` for x up to ``edges[i]``; the last label beyond; null stays null."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for e, name in zip(edges, labels, strict=False):
        out = out.when(x <= e, name)
    return out.otherwise(labels[-1])


#: Names too general to count as a label.
GENERIC = ["virus", "infection", "disease", "unknown", "outbreak", "illness", "fever", "epidemic"]


def drop_generic(df: DataFrame, label: str = "label", words: Sequence[str] = tuple(GENERIC)) -> DataFrame:
    return df.where(~F.trim(F.regexp_replace(F.lower(F.col(label)), "[^a-z0-9]+", " ")).isin(list(words)))


def null_unknown_zero(count: Column, text: Column) -> Column:
    """A zero that the text doesn't state becomes null."""
    return F.when((count == 0) & ~F.coalesce(text.rlike(r"(?i)\b(no|zero|0)\s+(new\s+)?(cases?|deaths?)\b"), F.lit(False)), F.lit(None)).otherwise(count)


def event_category(text: Column) -> Column:
    """By the first kind of words that occurs."""
    t = F.lower(text)
    kinds = [("outbreak", "outbreak|cluster"), ("alert", "alert|warning|error"), ("surveillance", "surveillance|signup|monitor"), ("response", "response|purchase")]
    out = None
    for name, words in kinds:
        out = F.when(t.rlike(words), name) if out is None else out.when(t.rlike(words), name)
    return out.otherwise("other")
