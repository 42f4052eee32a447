"""Unicode normal forms and texts without accents, as columns.

Spark has no built-in function for them. A pattern finds the texts that a form could change (code points that it changes, and those
that may combine with the one before); it follows from the Unicode tables by a rule. Those texts alone go through Arrow to
Python, all others stay where they are.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

COMPOSED = ("NFC", "NFKC")


def ranges(points: Iterable[int]) -> str:
    """A Java character class of ascending code points."""
    runs: list[list[int]] = []
    for p in points:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def seconds() -> set[str]:
    """Code points that can be the second of a canonical composition."""
    found = {chr(p) for p in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for p in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(p)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return found


@cache
def unsettled(form: str) -> str:
    """The class of code points that ``form`` changes or that may combine with what stands before them."""
    later = seconds() if form in COMPOSED else set()
    every = (p for p in range(0x80, sys.maxunicode + 1) if not 0xD800 <= p <= 0xDFFF)
    # a class of so many ranges is slow to test, so what can't be in it is passed over first
    plain = r"\x00-\x7F\xC0-\xFF" if form in COMPOSED else r"\x00-\x7F"
    return f"(?=[^{plain}])" + ranges(p for p in every if (c := chr(p)) in later or unicodedata.combining(c) or unicodedata.normalize(form, c) != c)


def without_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def normal_form(text: Column, form: str) -> Column:
    """``text`` in NFC, NFD, NFKC or NFKD; null stays null."""

    @F.pandas_udf("string")
    def change(own: pd.Series) -> pd.Series:
        return own.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    odd = text.rlike(unsettled(form))
    return F.when(odd, change(F.when(odd, text))).otherwise(text)


@cache
def latin_letters() -> tuple[str, str]:
    """Letters of the Latin blocks that are one letter with marks, and those letters; by the rule of ``without_marks``."""
    both = [(chr(p), without_marks(chr(p))) for p in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    kept = [(c, plain) for c, plain in both if c != plain and len(plain) == 1]
    return "".join(c for c, _ in kept), "".join(plain for _, plain in kept)


def strip_marks(text: Column) -> Column:
    """``text`` in NFKD without combining marks. Latin letters with marks are replaced by a built-in function."""

    @F.pandas_udf("string")
    def change(own: pd.Series) -> pd.Series:
        return own.map(lambda t: None if t is None else without_marks(t))

    plain = F.translate(text, *latin_letters())
    odd = plain.rlike(unsettled("NFKD"))
    return F.when(odd, change(F.when(odd, plain))).otherwise(plain)


def strip_marks_each(texts: Column) -> Column:
    """``strip_marks`` of each text of an array."""

    @F.pandas_udf("array<string>")
    def change(own: pd.Series) -> pd.Series:
        return own.map(lambda ts: None if ts is None else [None if t is None else without_marks(t) for t in ts])

    plain = F.transform(texts, lambda t: F.translate(t, *latin_letters()))
    odd = F.exists(plain, lambda t: F.coalesce(t.rlike(unsettled("NFKD")), F.lit(False)))
    return F.when(odd, change(F.when(odd, plain))).otherwise(plain)
