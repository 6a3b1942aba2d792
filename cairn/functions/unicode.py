"""What Spark has no built-in for: Unicode normalisation, diacritics, Porter stems. Arrow-batched, over distinct words where that pays."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffix tables of the published algorithm (Porter, 1980), longest match first.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def _shape(w: str) -> str:
    """c and v for each letter: y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _short(w: str) -> bool:
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


def porter(w: str) -> str:
    """Stem of a lower-case ASCII word."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for end, new in sorted(table, key=lambda p: -len(p[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]):
                    w = w[: -len(end)] + new
                break
    for end in STEP4:
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def fold(text: str) -> str:
    """Compatibility form without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _mapped(kind: str, make, c: Column) -> Column:
    """A column mapped value by value in Arrow batches; ``make`` gives the function for a batch."""

    def run(s: pd.Series) -> pd.Series:
        fn = make()
        return s.map(lambda x: None if x is None else fn(x))

    return F.pandas_udf(run, kind)(c)


def nfkc(text: Column) -> Column:
    return _mapped("string", lambda: lambda x: unicodedata.normalize("NFKC", x), text)


def fold_diacritics(text: Column) -> Column:
    return _mapped("string", lambda: fold, text)


def porter_stems(words: Column) -> Column:
    """Stems of an array of words; each is stemmed once to a batch."""

    def make():
        known: dict[str, str] = {}
        return lambda ws: [known[w] if w in known else known.setdefault(w, porter(w)) for w in ws]

    return _mapped("array<string>", make, words)
