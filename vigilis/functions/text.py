"""URLs, hashes, names, digits and counts in text, as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilis.functions.unicode import normal_form, strip_marks

#: Query parameters that only track, by variant, beside all that begin with ``utm_``.
TRACKING = {
    "collector": ["_ga", "_gl", "dclid", "fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid", "yclid"],
    "api": ["dclid", "fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid", "yclid"],
    "export": ["fbclid", "gclid", "mc_cid", "mc_eid", "oc", "ref", "ref_src"],
}
#: Signs that a path keeps unescaped.
PATH_SIGNS = {"%2F": "/", "%3A": ":", "%40": "@", "%21": "!", "%24": "$", "%26": "&", "%27": "'", "%28": "(", "%29": ")", "%2B": "+", "%2C": ",", "%3B": ";", "%3D": "=", "%7E": "~", "%25": "%"}


def _form_encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _without_dots(path: Column, collapse_: bool) -> Column:
    """Dot segments are resolved; with ``collapse_`` empty segments go too. A final slash goes."""
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    idle = (lambda s: s.isin("", ".")) if collapse_ else (lambda s: s == ".")
    step = lambda acc, s: F.when(idle(s), acc).when(s == "..", up(acc)).otherwise(F.concat(acc, F.array(s)))
    parts = F.split(F.regexp_replace(path, "^/|/$", ""), "/")
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def normalize_url(url: Column, variant: str = "collector") -> Column:
    """Lower-case scheme and host without a default port, no fragment, no tracking parameters, sorted query. Null for what isn't an
    http URL. Parameters such as ``page``, ``ref`` and ``source`` stay, as they may name another article.

    ``collector``: dot segments and double slashes are resolved, escapes are made uniform, a final slash stays unless there is a
    query, and a URL with credentials is null. ``api``: as the collector's, but double slashes and a slash before a query stay.
    ``export``: a training set's identity; credentials, ``ref`` and any final slash go.
    """
    u = F.trim(url)
    scheme, rest = F.lower(F.regexp_extract(u, r"(?i)^(https?)://", 1)), F.regexp_extract(u, r"(?i)^https?://([^#]*)", 1)
    authority = F.regexp_extract(rest, r"^([^/?]*)", 1)
    login, place = F.regexp_extract(authority, r"^(.*@)", 1), F.regexp_replace(authority, "^.*@", "")
    host = F.rtrim(F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1)), F.lit("."))
    port = F.regexp_extract(place, r":([^:\]]*)$", 1)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    raw, query = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), F.regexp_extract(rest, r"\?(.*)$", 1)
    path = F.when(raw == "", "/").otherwise(raw)
    if variant == "export":
        path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    else:
        if variant == "collector":
            # only where something is escaped or to be escaped
            plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
            quoted = F.replace(F.url_encode(plain), F.lit("+"), F.lit("%20"))
            for code, sign in PATH_SIGNS.items():
                quoted = F.replace(quoted, F.lit(code), F.lit(sign))
            path = F.when(path.rlike("[^A-Za-z0-9/._~-]"), quoted).otherwise(path)
        dots = path.rlike(r"//|/\.\.?(/|$)" if variant == "collector" else r"/\.\.?(/|$)")
        clean = _without_dots(path, variant == "collector")
        ends = path.rlike(r"/$" if variant == "collector" else r"/(\.\.?)?$") & (clean != "/")
        path = F.when(dots, F.concat(clean, F.when(ends, "/").otherwise(""))).otherwise(path)
        if variant == "collector":
            path = F.when((query != "") & (path != "/"), F.regexp_replace(path, "/+$", "")).otherwise(path)
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    pair = lambda p: F.struct(F.lower(decoded(F.substring_index(p, "=", 1))).alias("low"), decoded(F.substring_index(p, "=", 1)).alias("key"), decoded(F.regexp_extract(p, "=(.*)$", 1)).alias("value"))
    pairs = F.filter(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair), lambda x: ~F.startswith(x["low"], F.lit("utm_")) & ~x["low"].isin(TRACKING[variant]))
    ordered = F.array_sort(F.transform(pairs, lambda x: F.struct(x["key"], x["value"])) if variant == "export" else pairs)
    kept = F.transform(ordered, lambda x: F.concat(_form_encoded(x["key"]), F.lit("="), _form_encoded(x["value"])))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    fine = (scheme != "") & (host != "") & port.rlike("^[0-9]*$")
    if variant != "export":
        fine &= login == ""
    return F.when(fine, F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, tail))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def url_hash(url: Column) -> Column:
    return F.sha2(normalize_url(url), 256)


def content_hash(text: Column) -> Column:
    """SHA-256 of the text in NFKC with collapsed white space of all kinds; null for texts without anything else."""
    t = F.trim(F.regexp_replace(normal_form(text, "NFKC"), r"[\x09-\x0D\x1C-\x20\x85\p{Z}]+", " "))
    return F.when(F.length(t) > 0, F.sha2(t, 256))


def article_key(url: Column, content: Column, ident: Column) -> Column:
    """The first of URL hash, content hash and id that there is."""
    return F.coalesce(F.concat(F.lit("url:"), url_hash(url)), F.concat(F.lit("text:"), content_hash(content)), F.concat(F.lit("id:"), ident.cast("string")))


def alias_key(x: Column) -> Column:
    """Letters and digits in lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def short_label(x: Column, names: Mapping[str, str]) -> Column:
    out = x
    for long, short in names.items():
        out = F.when(x == long, short).otherwise(out)
    return out


def label_code(x: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(x), r"[^A-Za-z0-9]+", "_"))


def format_counts(pairs: Column) -> Column:
    """'label(n); ...' from an array of (label, n), by n descending, then label; zero counts are left out."""
    own = F.filter(pairs, lambda p: p["n"] > 0)
    ordered = F.transform(F.array_sort(F.transform(own, lambda p: F.struct((-p["n"]).alias("k"), p["label"].alias("label"), p["n"].alias("n")))), lambda p: F.concat(p["label"], F.lit("("), p["n"].cast("string"), F.lit(")")))
    return F.array_join(ordered, "; ")


def strip_markup(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go; the usual entities are read; white space is collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return collapse(t)


def has_mojibake(text: Column) -> Column:
    return F.coalesce(text.rlike("Ã[\u0080-¿]|â€|Â[\u0080-¿]"), F.lit(False))


def fix_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again; left alone where that isn't possible."""
    return F.when(has_mojibake(text) & ~text.rlike("[^\u0000-ÿ]"), F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")).otherwise(text)


#: Decimal digits of other scripts, each run from zero to nine.
DIGIT_ZEROS = "٠۰०০๐໐០၀"


def fold_digits(text: Column) -> Column:
    """Digits of other scripts become ASCII digits."""
    other = "".join(chr(ord(z) + k) for z in DIGIT_ZEROS for k in range(10))
    return F.when(is_ascii(text), text).otherwise(F.translate(text, other, "0123456789" * len(DIGIT_ZEROS)))


def is_ascii(text: Column) -> Column:
    """As many bytes as characters: a test that takes a fraction of a pattern's or a translation's time."""
    return F.octet_length(text) == F.length(text)


def fold_accents(text: Column) -> Column:
    """Lower case in NFKD without combining marks: letters such as đ and ł, which no form takes apart, stay."""
    return strip_marks(F.lower(text))


#: Words that multiply a number.
MULTIPLIERS = {"hundred": 100, "thousand": 1000, "ribu": 1000, "juta": 1_000_000, "million": 1_000_000, "lakh": 100_000, "miliar": 1_000_000_000, "billion": 1_000_000_000}


def parse_count(text: Column) -> Column:
    """'7.994', '218,356', '1,2 juta': grouped by thousands if groups have three digits, else a decimal sign; null if no number."""
    t = F.lower(F.trim(fold_digits(text)))
    number = F.regexp_extract(t, r"^([0-9][0-9.,]*)", 1)
    word = F.regexp_extract(t, r"^[0-9][0-9.,]*\s*([a-z]+)", 1)
    grouped = number.rlike(r"^[0-9]{1,3}([.,][0-9]{3})+$")
    value = F.when(grouped & ~word.isin(list(MULTIPLIERS)), F.regexp_replace(number, "[.,]", "").try_cast("double")).otherwise(F.replace(F.rtrim(number, F.lit(".,")), F.lit(","), F.lit(".")).try_cast("double"))
    factor = F.lit(1)
    for w, n in MULTIPLIERS.items():
        factor = F.when(word == w, F.lit(n)).otherwise(factor)
    return F.round(value * factor).cast("long")


def parse_counts(texts: Column) -> Column:
    """``parse_count`` of each element of an array, step by step, so that no part is worked out twice."""
    plain = F.transform(texts, lambda x: F.lower(F.trim(x)))
    cut = F.transform(plain, lambda t: F.struct(F.regexp_extract(t, r"^([0-9][0-9.,]*)", 1).alias("n"), F.regexp_extract(t, r"^[0-9][0-9.,]*\s*([a-z]+)", 1).alias("w")))
    factors = F.create_map(*[F.lit(x) for w, n in MULTIPLIERS.items() for x in (w, n)])
    words_ = list(MULTIPLIERS)

    def value(x: Column) -> Column:
        n = x["n"]
        grouped = n.rlike(r"^[0-9]{1,3}([.,][0-9]{3})+$") & ~x["w"].isin(words_)
        number = F.when(grouped, F.regexp_replace(n, "[.,]", "")).otherwise(F.replace(F.rtrim(n, F.lit(".,")), F.lit(","), F.lit(".")))
        return F.round(number.try_cast("double") * F.coalesce(F.element_at(factors, x["w"]), F.lit(1))).cast("long")

    return F.transform(cut, value)


def ngrams(words: Column, most: int) -> Column:
    """Structs (gram, pos, size) of all runs of 1 to ``most`` words."""
    sizes = F.sequence(F.lit(1), F.lit(most))
    runs = F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(-1))), lambda i: F.struct(F.array_join(F.slice(words, i + 1, n), " ").alias("gram"), i.alias("pos"), n.alias("size"))))
    return F.flatten(F.transform(F.filter(F.transform(runs, lambda r, k: F.struct(r.alias("r"), k.alias("k"))), lambda x: F.size(words) > x["k"]), lambda x: x["r"]))


def any_of(words: Sequence[str]) -> str:
    """A pattern for any of the words, whole."""
    return r"(?i)\b(" + "|".join(sorted(words, key=len, reverse=True)) + r")\b"
