"""Column functions over text: tokens, terms, similarity, numbers, attributes, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens, and words that carry no content.
NOT_ALNUM = r"[^\p{L}\p{N}]+"
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "for", "with", "is", "are", "was", "were", "be", "been", "has", "have", "had", "this", "that", "these", "those", "it", "its", "as", "by", "from", "usually", "often", "always", "each", "every", "they", "them", "their", "we", "our", "us", "he", "she", "his", "her", "you", "your", "user", "users")
#: Words of a question that are no search terms.
QUERY_STOP_WORDS = ("the", "a", "an", "of", "for", "is", "are", "was", "were", "be", "what", "when", "which", "who", "whom", "how", "does", "do", "did", "in", "on", "at", "to", "and", "or", "with", "by", "from", "this", "that", "it", "its", "there", "their")
#: The forms of an attribute line and of a table row, and values that are links.
KEY_VALUE = r"^\s*(?:[-*+]\s*)?(?:\*\*|__)?([A-Za-z][\w\s'/-]{1,40}?)(?:\*\*|__)?\s*:\s*(.+?)\s*$"
TABLE_ROW = r"^\s*\|\s*(?:\*\*)?([A-Za-z][\w\s'/-]{1,40}?)(?:\*\*)?\s*\|\s*(.+?)\s*\|"
LINK_VALUE = r"^//|^https?:|^\[\["
#: A value that can conflict has a digit or one of these words.
DECISIVE = ("yes", "no", "true", "false", "none", "active", "inactive", "expired", "cancelled", "monthly", "weekly", "annual", "annually")


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-cased runs of letters and digits of ``least`` or more characters; null for null."""
    return F.filter(F.split(F.lower(text), NOT_ALNUM), lambda t: F.length(t) >= least)


def match_terms(query: str) -> list[str]:
    """Terms of a free-text query: lower case, letters, digits, ' and - kept, inner trimmed, one-letter ones dropped."""
    kept = "".join(c if c.isalnum() or c in "'-" or c.isspace() else " " for c in query.lower())
    return [t for t in (w.strip("-'") for w in kept.split()) if len(t) > 1]


def light_stem(word: Column) -> Column:
    """Plural endings: ies, es and s (but not ss), from words long enough."""
    n = F.length(word)
    return (
        F.when((n > 4) & word.endswith("ies"), F.left(word, n - 3))
        .when((n > 3) & word.endswith("es"), F.left(word, n - 2))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss"), F.left(word, n - 1))
        .otherwise(word)
    )


def term_overlap(line: Column, queries: list[str]) -> Column:
    """How many of the queries' terms, stop words aside and lightly stemmed, a line has."""
    terms = {light_stem_of(w) for q in queries for t in match_terms(q) for w in t.replace("'", " ").replace("-", " ").split() if len(w) > 1 and w not in QUERY_STOP_WORDS}
    if not terms:
        return F.lit(0)
    return F.size(F.array_intersect(F.transform(tokens(line), light_stem), F.array(*(F.lit(t) for t in sorted(terms)))))


def light_stem_of(word: str) -> str:
    """light_stem() of a plain string."""
    for least, end in ((4, "ies"), (3, "es"), (3, "s")):
        if len(word) > least and word.endswith(end) and not (end == "s" and word.endswith("ss")):
            return word[: -len(end)]
    return word


def content_words(text: Column) -> Column:
    """Distinct ASCII words of three or more characters that say what a sentence is about; [[links]] are addresses, not words."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"\[\[[^\]]*\]\]", " "), r"[^a-z0-9\s]", " ")
    return F.array_except(F.filter(F.split(bare, r"\s+"), lambda w: F.length(w) > 2), F.array(*(F.lit(w) for w in STOP_WORDS)))


def containment(x: Column, y: Column, least: int = 3) -> Column:
    """Shared share of the smaller word set; 0 where that has fewer than ``least`` words."""
    small = F.least(F.size(x), F.size(y))
    return F.when(small >= least, F.size(F.array_intersect(x, y)) / small).otherwise(0.0)


def numbers(value: Column) -> Column:
    """Numbers in reading order, thousands separators removed."""
    plain = F.regexp_replace(value, r"(\d),(\d{3})\b", "$1$2")
    return F.regexp_extract_all(plain, F.lit(r"\d+(?:[.]\d+)?"), F.lit(0))


def comparable(value: Column) -> Column:
    """A value without case, emphasis marks, white space, commas and a last full stop."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"[*_`\s,]", ""), r"\.$", "")


def conflicts(x: Column, y: Column) -> Column:
    """Whether two values differ in a way that matters: other cores, and both with numbers that differ."""
    nx, ny = numbers(x), numbers(y)
    return (comparable(x) != comparable(y)) & (F.size(nx) > 0) & (F.size(ny) > 0) & (F.array_join(nx, ",") != F.array_join(ny, ","))


def attribute_value(line: Column) -> Column:
    """(attribute, value) of a ``Key: value`` line or table row whose value is decisive; else null."""
    pick = lambda i: F.when(line.rlike(TABLE_ROW), F.regexp_extract(line, TABLE_ROW, i)).otherwise(F.regexp_extract(line, KEY_VALUE, i))
    name = F.trim(F.regexp_replace(F.regexp_replace(F.lower(pick(1)), "[*_`]", ""), r"\s+", " "))
    value = F.trim(pick(2))
    hard = value.rlike(r"(?i)\d|\b(" + "|".join(DECISIVE) + r")\b")
    plain = ~value.rlike(LINK_VALUE) & ~line.rlike(r"^\s*#{1,6}\s")
    return F.when((name != "") & (value != "") & hard & plain, F.struct(name.alias("attribute"), value.alias("value")))


def slug(text: Column) -> Column:
    """Lower-case words joined by hyphens."""
    return F.trim(F.regexp_replace(F.lower(text), NOT_ALNUM, "-"), F.lit("-"))


def entity_name(text: Column) -> Column:
    """A name for comparison: lower case, signs as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), NOT_ALNUM, " "))


def predicate(text: Column) -> Column:
    """A predicate as a snake-case name."""
    return F.trim(F.regexp_replace(F.lower(text), NOT_ALNUM, "_"), F.lit("_"))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up, and 24 for the frame."""
    return F.ceil(F.length(text) / 4) + 24


def stable_id(prefix: str, length: int, *parts: Column) -> Column:
    """``prefix`` and hex digits of the SHA-256 of the parts, NUL between them."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("\x00", *parts), 256), F.lit(length)))


def identity_codes(text: Column) -> Column:
    """Codes such as AB-12: up to eight letters, a separator or none, two digits or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b[A-Za-z]{1,8}[-/]?\d{2,}\b"), F.lit(0)), F.upper))


def claim_text(claim: Column) -> Column:
    """A claim as it is scored: trimmed, runs of white space as one."""
    return F.trim(F.regexp_replace(claim, r"\s+", " "))


#: Wording of a question that asks for a time or for a report.
INTENTS = {
    "current": r"(?i)\b(current|currently|active|now|today)\b|сейчас|сегодня|текущ|действующ",
    "future": r"(?i)\b(next|upcoming|future|due|overdue|schedule|scheduled|scheduling|deadline|plan|plans|planned|planning)\b|следующ|предстоящ|будущ|крайний срок|срок\p{L}* (?:оплаты|подачи|выполнения|осмотра)|просроч|расписани|план",
    "history": r"(?i)\b(past|history|historical|happened|occurred|previously|when did|cancelled|completed|superseded|rejected|resolved|former)\b|прошл|истори|произош|ранее|отмен|заверш|отклон|прежн",
    "source_report": r"(?i)\b(report|reported|said|according to)\b|сообщ|сказал|по словам",
}
#: A time that only the moment of writing explains.
DEICTIC = r"(?i)\b(?:today|tomorrow|yesterday|tonight|(?:next|last|this)\s+(?:day|week|month|year|morning|afternoon|evening|night|monday|tuesday|wednesday|thursday|friday|saturday|sunday))\b|сегодня|завтра|вчера|(?:следующ|прошл|эт[аоу]|нынешн)\p{L}*\s+(?:день|дня|дн[её]м|недел|месяц|год|году|утр|вечер)"
#: Words that a rewrite may add or drop.
GLUE_WORDS = ("and", "are", "been", "for", "from", "has", "have", "into", "is", "its", "of", "on", "the", "to", "was", "were", "with")


def query_intent(text: Column) -> Column:
    """current, future, history and source_report of a question, as a struct of booleans; matched in lower case."""
    return F.struct(*(F.lower(text).rlike(p).alias(n) for n, p in INTENTS.items()))


def deictic_time(text: Column) -> Column:
    """Whether a text names a time by today, next week and the like."""
    return F.lower(text).rlike(DEICTIC)


def quote_window(text: Column, offset: Column, lines: int) -> Column:
    """Up to ``lines`` lines around the one that holds an offset, without blank ones."""
    every, n = F.split(text, "\n"), max(1, lines)
    at = F.size(F.split(F.left(text, offset), "\n")) - 1
    return F.array_join(F.filter(F.slice(every, F.greatest(at - (n - 1) // 2, F.lit(0)) + 1, F.lit(n)), lambda x: x.rlike(r"\S")), "\n")


def lost_tokens(before: Column, after: Column) -> Column:
    """Words of three or more characters that a rewrite lost; GLUE_WORDS may go."""
    words = lambda c: tokens(c, 3)
    return F.array_except(words(before), F.concat(words(after), F.array(*(F.lit(w) for w in GLUE_WORDS))))


def root(word: Column) -> Column:
    """A word without its plural ending, as automatic recall compares words."""
    n = F.length(word)
    ends = F.when((n > 5) & word.endswith("ies"), 3).when((n > 4) & word.endswith("es"), 2).when((n > 3) & word.endswith("s") & ~word.endswith("ss"), 1).otherwise(0)
    return F.left(word, n - ends)


def overlap_ratio(roots: Column, evidence: Column) -> Column:
    """The share of a prompt's roots, repeats counted, that a text has; 0 without roots."""
    held = F.transform(tokens(evidence, 1), root)
    return F.when(F.size(roots) > 0, F.size(F.filter(roots, lambda r: F.array_contains(held, r))) / F.size(roots)).otherwise(0.0)


def stop_words(words: list[str]) -> str | None:
    """A pattern that finds any of the phrases as whole words, in any case, with blanks, _ or - between their words."""
    import re
    import unicodedata

    plain = dict.fromkeys(filter(None, (unicodedata.normalize("NFKC", w).strip() for w in words)))
    if not plain:
        return None
    each = "|".join(r"[\s_-]+".join(map(re.escape, p.split())) for p in plain)
    return rf"(?i)(^|[^\p{{L}}\p{{N}}])({each})($|[^\p{{L}}\p{{N}}])"
