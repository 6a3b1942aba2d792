"""How well-formed a claim is, from cheap structural signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The base, and what each signal adds.
BASE, LOWEST, HIGHEST = 0.62, 0.05, 0.98
HEDGE, QUESTION, UNCHECKED = -0.28, -0.30, -0.25
KEYED, DIGIT, MEASURE, SUBJECT, ATTRIBUTE = 0.14, 0.08, 0.07, 0.06, 0.04
INFLATED, SHORT_SOURCE, TWO_WORDS, THREE_WORDS, LABEL, NOTHING_SAID, BARE_VALUE, NO_SUBJECT = -0.12, -0.15, -0.34, -0.16, -0.20, -0.12, -0.30, -0.22
#: Words that hedge, verbs, and the patterns of a signal.
HEDGES = ("probably", "maybe", "might", "could be", "i think", "not sure", "unclear", "tbd", "todo", "approximately", "roughly", "around", "unconfirmed", "allegedly", "seems", "apparently", "possibly")
VERBS = ("is", "are", "was", "were", "has", "have", "had", "will", "can", "prefers", "lives", "costs", "expires", "renews", "includes", "owns", "uses", "works", "covers", "holds", "requires", "means", "pays", "runs", "starts", "ends", "contains", "supports", "allows")

KEY_CLAIM = r"^[A-Z][^:]{1,40}:\s*\S"
UNCHECKED_TASK = r"^\s*[-*]\s*\[ \]"
KEY_LINE = r"^\s*[-*]\s*\*?\*?[A-Z][^:]{1,40}:?\*?\*?\s*[:|]\s*\S"
MEASURED = r"(?i)\d{4}-\d{2}-\d{2}|[€$£]\s?\d|\b\d+(?:[.,]\d+)?\s?(?:%|eur|usd|gbp|kg|km|months?|years?)\b"
LABEL_ONLY = r"^[A-Z][A-Za-z]*$|^[A-Z][A-Z\s]+$"
VALUE_ONLY = r"^[\d\s,.:/–—-]+$"
BARE_DATE = r"(?i)^(\d{1,2}\s+)?(january|february|march|april|may|june|july|august|september|october|november|december)?\s*\d{0,4}$|^\d{4}-\d{2}-\d{2}$"


def confidence(source: Column, claim: Column, subject: Column, attribute: Column) -> Column:
    """Score of a claim against its source line, 0.05 to 0.98, to two decimals."""
    words = F.size(F.filter(F.split(F.trim(claim), r"\s+"), lambda w: w != ""))
    keyed = claim.rlike(KEY_CLAIM)
    verb = claim.rlike(r"(?i)\b(" + "|".join(VERBS) + r")\b")
    bare = claim.rlike(VALUE_ONLY) | claim.rlike(BARE_DATE)
    low = F.lower(source)
    hedged = F.lit(False)
    for h in HEDGES:
        hedged = hedged | low.contains(h)
    signals = [
        (hedged, HEDGE),
        (F.rtrim(source).endswith("?"), QUESTION),
        (source.rlike(UNCHECKED_TASK), UNCHECKED),
        (source.rlike(KEY_LINE), KEYED),
        (source.rlike(r"\d"), DIGIT),
        (source.rlike(MEASURED), MEASURE),
        (F.trim(F.coalesce(subject, F.lit(""))) != "", SUBJECT),
        (F.trim(F.coalesce(attribute, F.lit(""))) != "", ATTRIBUTE),
        (F.length(claim) > F.length(source) * 2.5 + 40, INFLATED),
        (F.length(F.trim(source)) < 12, SHORT_SOURCE),
        (~keyed & (words < 3), TWO_WORDS),
        (~keyed & (words == 3), THREE_WORDS),
        (F.trim(claim).rlike(LABEL_ONLY), LABEL),
        ((words < 6) & ~claim.rlike(r"\d") & ~verb, NOTHING_SAID),
        (~keyed & bare, BARE_VALUE),
        (~keyed & ~bare & claim.rlike(r"^[a-z]+\s") & F.split_part(F.trim(claim), F.lit(" "), F.lit(1)).isin(*VERBS), NO_SUBJECT),
    ]
    total = F.lit(BASE)
    for on, by in signals:
        total = total + F.when(on, by).otherwise(0.0)
    return F.round(F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), total)), 2)
