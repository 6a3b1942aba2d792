"""Guards and small operators over claims, quotes, spans, event pages and link targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import numbers
from cairn.scratch import parts

#: Claims are this long, in characters.
CLAIM = (3, 500)


def clean_facts(candidates: DataFrame, lines: DataFrame, most: int = 40) -> DataFrame:
    """Candidates (page, line, claim, confidence) whose line may be mined, of a fit length, once for each (line, lower-cased claim), at most ``most`` a page. Tasks are as many as the rows ask for."""
    n = parts(candidates)
    on = lines.filter("eligible").select("page", "line").repartition(n, "page", "line")
    fit = candidates.select("page", "line", "claim", "confidence").filter(F.length(F.trim("claim")).between(*CLAIM)).repartition(n, "page", "line").join(on, ["page", "line"], "left_semi")
    once = fit.groupBy("page", "line", F.lower(F.trim("claim")).alias("_k")).agg(F.max_by(F.struct("claim", "confidence"), F.struct("confidence", "claim")).alias("x")).select("page", "line", "x.*")
    order = Window.partitionBy("page").orderBy(F.col("confidence").desc(), "line", "claim")
    return once.repartition(n, "page").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def protected_values(text: Column) -> Column:
    """Dates, times, amounts and numbers that a rewrite must keep."""
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}"), F.lit(0)), numbers(text))))


def unsupported_values(answer: Column, support: Column) -> Column:
    """Protected values of an answer that its support does not have."""
    return F.array_except(protected_values(answer), protected_values(support))


def quote_count(text: Column, quote: Column) -> Column:
    """Occurrences of a quote, without overlap; 0 for an empty one."""
    return F.when(F.length(quote) > 0, (F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).otherwise(0).cast("int")


def covered_spans(spans: DataFrame, frames: DataFrame) -> DataFrame:
    """(id, covered): spans (id, doc, start, end) that lie inside one frame (doc, start, end)."""
    f = frames.select("doc", F.col("start").alias("_s"), F.col("end").alias("_e"))
    inside = spans.join(f, "doc").filter((F.col("_s") <= F.col("start")) & (F.col("end") <= F.col("_e"))).select("id").distinct().withColumn("covered", F.lit(True))
    return spans.join(inside, "id", "left").select("id", F.coalesce("covered", F.lit(False)).alias("covered"))


def slug_candidates(targets: DataFrame, slugs: DataFrame, least: float = 0.75) -> DataFrame:
    """(target, slug): a one-word target needs a slug whose last part is that word; others share ``least`` of their words with it.

    Joined on words, so that only slugs with a word in common are looked at.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    t = targets.select("target", F.array_distinct(words(F.col("target"))).alias("_t"))
    s = slugs.select("slug", F.array_join(words(F.element_at(F.split("slug", "/"), -1)), "").alias("_last"), F.explode(F.array_distinct(words(F.col("slug")))).alias("_w"))
    many = t.filter(F.size("_t") > 1).select("target", F.size("_t").alias("_n"), F.explode("_t").alias("_w")).join(s, "_w").groupBy("target", "slug", "_n").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= F.col("_n") * least)
    single = t.filter(F.size("_t") == 1).select("target", F.col("_t")[0].alias("_last")).join(s.select("slug", "_last").distinct(), "_last")
    return many.select("target", "slug").unionByName(single.select("target", "slug"))


def repairs(broken: DataFrame, slugs: DataFrame) -> DataFrame:
    """(target, slug): broken targets with exactly one candidate."""
    c = slug_candidates(broken, slugs)
    return c.groupBy("target").agg(F.count(F.lit(1)).alias("_n"), F.min("slug").alias("slug")).filter("_n = 1").drop("_n")


def conflict_anchors(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(subject, attribute, anchor): of the facts in a conflict the first by page and line."""
    ids = pairs.select("subject", "attribute", F.col("id_a").alias("id")).unionByName(pairs.select("subject", "attribute", F.col("id_b").alias("id"))).distinct()
    return ids.join(facts.select("id", "page", "line"), "id").groupBy("subject", "attribute").agg(F.min_by("id", F.struct("page", "line", "id")).alias("anchor"))


def event_window(slug: Column, prose: Column, start: Column, end: Column) -> Column:
    """(start, end) of an event page: its header's, else a range in its prose, else a date in its slug."""
    day = r"\d{4}-\d{2}-\d{2}"
    pair = rf"({day})\s*(?:to|until|–|-)\s*({day})"
    from_prose = F.when(prose.rlike(pair), F.struct(F.regexp_extract(prose, pair, 1).alias("start"), F.regexp_extract(prose, pair, 2).alias("end")))
    named = F.regexp_extract(slug, r"(\d{4}-\d{2}(?:-\d{2})?)", 1)
    from_slug = F.when(named != "", F.struct(named.alias("start"), named.alias("end")))
    header = F.when(start.isNotNull(), F.struct(start.alias("start"), F.coalesce(end, start).alias("end")))
    return F.coalesce(header, from_prose, from_slug)


def phase(start: Column, end: Column, today: Column, soon: int = 30) -> Column:
    """past, current, upcoming (within ``soon`` days), scheduled or undated, of a day window."""
    a, b, now = F.try_to_date(start), F.try_to_date(end), today.cast("date")
    return F.when(a.isNull(), "undated").when(b < now, "past").when(a <= now, "current").when(F.date_diff(a, now) <= soon, "upcoming").otherwise("scheduled")


def recall_at(found: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(case, recall): the share of a case's expected items among its first k."""
    top = found.filter(F.col("rank") <= k).select("case", "item").distinct().withColumn("_hit", F.lit(1))
    return expected.join(top, ["case", "item"], "left").groupBy("case").agg(F.round(F.count("_hit") / F.count(F.lit(1)), 6).alias("recall"))


#: The keys of a memory marker in their order, and those that none may lack.
MARKER_KEYS = ("v", "supports", "level", "kind", "subject", "source-role", "speaker", "reports", "reporters", "commitment", "disposition", "polarity", "basis", "evidence", "links", "relation", "temporal", "precision", "start", "until", "timezone", "mentioned", "recurrence")
MARKER_NEEDS = ("v", "supports", "level", "kind", "subject", "source-role", "reports", "commitment", "disposition", "polarity", "basis")
#: Keys that tell a time, and those that a time needs.
MARKER_TIME, MARKER_TIME_NEEDS = MARKER_KEYS[15:], MARKER_KEYS[15:18]


def marker(line: Column, tag: str) -> Column:
    """(id, fields) of a marker line ``<!-- tag id key=value ... -->``, or null where a rule is broken.

    Keys are known, stand in their order and once each, and none that is needed lacks; the
    version is 2 and the level 1; a time has relation, temporal and precision; reports, 0 to 3, is
    the number of reporters. Values that are text (subject, speaker, bounds, zone) are
    percent-decoded in ``fields``.
    """
    head = rf"(?i)^\s*<!--\s*{tag}\s+([A-Za-z0-9_-]{{4,80}})\s+(.+?)\s*-->\s*$"
    every = F.split(F.regexp_extract(line, head, 2), r"\s+")
    keys = F.transform(every, lambda t: F.substring_index(t, "=", 1))
    order = F.array(*(F.lit(k) for k in MARKER_KEYS))
    places = F.transform(keys, lambda k: F.array_position(order, k))
    of = lambda names: F.array(*(F.lit(n) for n in names))
    plain = F.map_from_arrays(F.array_distinct(keys), F.transform(F.array_distinct(keys), lambda k: F.substring_index(F.element_at(every, F.array_position(keys, k).cast("int")), "=", -1)))
    timed = F.arrays_overlap(keys, of(MARKER_TIME))
    listed = F.when(F.coalesce(plain["reporters"], F.lit("")) == "", 0).otherwise(F.size(F.split(plain["reporters"], ",")))
    fit = (
        line.rlike(head)
        & F.forall(every, lambda t: t.contains("="))
        & (places == F.array_sort(F.array_distinct(places)))
        & ~F.array_contains(places, 0)
        & (F.size(F.array_except(of(MARKER_NEEDS), keys)) == 0)
        & (~timed | (F.size(F.array_except(of(MARKER_TIME_NEEDS), keys)) == 0))
        & (plain["v"] == "2")
        & (plain["level"] == "1")
        & plain["reports"].rlike("^[0-3]$")
        & (listed.cast("string") == plain["reports"])
    )
    words = of(("subject", "speaker", "start", "until", "timezone", "mentioned"))
    fields = F.transform_values(plain, lambda k, v: F.when(F.array_contains(words, k), F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B")))).otherwise(v))
    return F.when(F.coalesce(fit, F.lit(False)), F.struct(F.regexp_extract(line, head, 1).alias("id"), fields.alias("fields")))
