"""Temporal operators: clock relations, overlap, recurrence, timelines, dates in text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.filters import period_end, period_start

#: Occurrences that one query may expand over all its series; an anchor is free.
MAX_OCCURRENCES = 50_000
#: Weekdays of a series, and months of dates in prose.
WEEKDAYS = ("mo", "tu", "we", "th", "fr", "sa", "su")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def local(instant: Column, zone: Column, precision: Column) -> Column:
    """The instant in the zone, as text at a precision."""
    at = F.from_utc_timestamp(instant, zone)
    return F.when(precision == "year", F.date_format(at, "yyyy")).when(precision == "month", F.date_format(at, "yyyy-MM")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def point(start: str = "start", until: str = "until", relation: str = "relation") -> tuple[Column, Column]:
    """Both bounds; where the relation is not ``valid`` a missing one is the other."""
    open_ = F.col(relation) == "valid"
    return F.coalesce(F.col(start), F.when(~open_, F.col(until))), F.coalesce(F.col(until), F.when(~open_, F.col(start)))


def classify(as_of: Column, zone: str = "UTC") -> Column:
    """Relation of a row's time to the clock, at the row's own precision and in its zone.

    undated, overdue, future, past, current_period, today or ongoing. Reads start, until,
    precision, relation, disposition and timezone. A due row is overdue once its end has passed
    while it is active or accepted. Instants on the clock's own local day are today.
    """
    tz = F.coalesce(F.col("timezone"), F.lit(zone))
    start, until = point()
    due = (F.col("relation") == "due") & F.col("disposition").isin("active", "accepted")
    now = local(as_of, tz, F.col("precision"))
    period = (
        F.when(due & (until < now), "overdue")
        .when(start > now, "future")
        .when(until < now, "past")
        .when(F.col("precision").isin("month", "year"), "current_period")
        .when(start == until, "today")
        .otherwise("ongoing")
    )
    ts, tu = F.try_to_timestamp(start), F.try_to_timestamp(until)
    same_day = F.to_date(F.from_utc_timestamp(ts, tz)) == F.to_date(F.from_utc_timestamp(as_of, tz))
    instant = (
        F.when(due & (tu < as_of), "overdue")
        .when((ts == tu) & same_day, "today")
        .when(ts > as_of, "future")
        .when(tu < as_of, "past")
        .when(ts == tu, "future")
        .otherwise("ongoing")
    )
    none = (F.col("precision") == "unknown") | (F.col("start").isNull() & F.col("until").isNull())
    return F.when(none, "undated").when(F.col("precision") == "instant", instant).otherwise(period)


def source_kind(relation: Column) -> Column:
    return F.when(relation == "occurred", "event").when(relation == "valid", "state").when(relation == "due", "deadline").otherwise("plan")


def actionable() -> Column:
    """Dated, not tentative, active or accepted, and scheduled or due."""
    dated = (F.col("precision") != "unknown") & (F.col("start").isNotNull() | F.col("until").isNotNull())
    return F.coalesce(dated & (F.col("temporal_status") != "tentative") & F.col("disposition").isin("active", "accepted") & F.col("relation").isin("scheduled", "due"), F.lit(False))


def current_eligible(as_of: Column, zone: str = "UTC") -> Column:
    """Whether a row holds at the clock: a state that is active or accepted and valid now, or what occurred today or goes on.

    Only actual rows do; of those with a disposition (null: none) only active, accepted,
    completed and resolved ones.
    """
    now, disposition = classify(as_of, zone), F.col("disposition")
    live = disposition.isNull() | disposition.isin("active", "accepted")
    fit = (F.col("temporal_status") == "actual") & (live | disposition.isin("completed", "resolved"))
    holds = F.when(F.col("relation") == "valid", live & now.isin("today", "current_period", "ongoing")).otherwise((F.col("relation") == "occurred") & now.isin("today", "ongoing"))
    return F.coalesce(fit & holds, F.lit(False))


def day_bounds() -> tuple[Column, Column]:
    """First and last day of the row's time; null where open."""
    start, until = point()
    return period_start(start), period_end(until)


def overlaps(since: str | None, until: str | None) -> Column:
    """Whether the row's days touch the range of two partial dates; undated rows match the unbounded range only."""
    lo, hi = day_bounds()
    none = (F.col("precision") == "unknown") | (F.col("start").isNull() & F.col("until").isNull())
    on = F.lit(True)
    if since:
        on = on & (hi.isNull() | (hi >= period_start(F.lit(since))))
    if until:
        on = on & (lo.isNull() | (lo <= period_end(F.lit(until))))
    return F.when(none, F.lit(since is None and until is None)).otherwise(on)


def distance(as_of: Column) -> Column:
    """Seconds between the clock and the row's days, 0 inside; null for undated rows."""
    lo, hi = day_bounds()
    start = F.unix_timestamp(F.try_to_timestamp(lo))
    end = F.unix_timestamp(F.try_to_timestamp(hi)) + 86_399
    now = F.unix_timestamp(as_of)
    before, after = F.greatest(start - now, F.lit(0)), F.greatest(now - end, F.lit(0))
    return F.when(F.col("precision") != "unknown", F.greatest(F.coalesce(before, F.lit(0)), F.coalesce(after, F.lit(0))))


def expand(series: DataFrame, since: str, until: str, limit: int = MAX_OCCURRENCES) -> DataFrame:
    """Occurrences of recurring rows whose day lies in the range: series columns, occurrence and index.

    Reads id, start (a day), frequency daily, weekly, monthly or yearly, interval, weekdays (for
    weekly: names such as mo) and series_until. Days that a month lacks are skipped, never moved
    to another. A weekly series with weekdays takes them in blocks of seven days from its start,
    every ``interval``-th block. The index counts the series' occurrences from its start. All
    series share ``limit``, nearest day first.
    """
    first = F.to_date("start")
    end = F.least(F.lit(until).cast("date"), F.coalesce(F.to_date("series_until"), F.lit(until).cast("date")))
    every = F.coalesce(F.col("interval"), F.lit(1))
    gap = F.greatest(F.date_diff(F.lit(since).cast("date"), first), F.lit(0))
    months = F.sequence(F.lit(0), F.greatest(F.ceil(F.months_between(end, first)).cast("int") + 1, F.lit(-1)))
    byday = (F.col("frequency") == "weekly") & F.col("weekdays").isNotNull() & (F.size("weekdays") > 0)
    week = F.array(*(F.lit(d) for d in WEEKDAYS))
    # days go on from the last step before the range; the steps passed over are counted, not made
    stride = F.when(F.col("frequency") == "daily", every).otherwise(every * 7).cast("int")
    passed = F.floor(gap / stride).cast("int")
    last = F.date_diff(end, first)
    plain = F.when(last >= passed * stride, F.sequence(passed * stride, last, stride))
    blocks = F.filter(F.when(last >= passed * stride, F.sequence(passed * stride, last)), lambda n: (F.floor(n / 7) % every == 0) & F.array_contains("weekdays", F.element_at(week, F.weekday(F.date_add(first, n)) + 1)))
    in_days = F.transform(F.when(byday, blocks).otherwise(plain), lambda n: F.date_add(first, n))
    # a block of seven days has every weekday once
    before = passed * F.when(byday, F.size(F.array_intersect("weekdays", week))).otherwise(1)
    step = F.when(F.col("frequency") == "yearly", every * 12).otherwise(every)
    in_months = F.filter(F.transform(F.filter(months, lambda n: n % step == 0), lambda n: F.add_months(first, n.cast("int"))), lambda d: F.day(d) == F.day(first))
    every_day = F.filter(F.when(F.col("frequency").isin("daily", "weekly"), in_days).otherwise(in_months), lambda d: d <= end)
    skipped = F.when(F.col("frequency").isin("daily", "weekly"), before).otherwise(0)
    found = series.filter(F.date_diff(end, first) >= 0).select("*", skipped.cast("int").alias("_skipped"), F.posexplode(every_day).alias("index", "occurrence"))
    found = found.withColumn("index", F.col("index") + F.col("_skipped")).drop("_skipped")
    found = found.filter(F.col("occurrence") >= F.lit(since).cast("date"))
    return found.orderBy("occurrence", "id").limit(limit)


def dedupe_events(events: DataFrame, keys: Sequence[str], prefer: Sequence) -> DataFrame:
    """One row for each logical event, by preference."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*prefer))).filter("_n = 1").drop("_n")


def union_timeline(*sources: DataFrame) -> DataFrame:
    """Sources of different columns as one; what a source lacks is null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), sources)


def sort_key(order: str, as_of: Column | None = None) -> list[Column]:
    """Columns for newest, oldest or nearest first; undated last, ties by type and id."""
    lo, hi = day_bounds()
    at = F.coalesce(lo, hi)
    head = {"newest": at.desc_nulls_last(), "oldest": at.asc_nulls_last(), "nearest": distance(as_of).asc_nulls_last() if as_of is not None else at}[order]
    return [head, F.col("type"), F.col("id")]


def facets(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, value, n): counts over all matching rows in one pass."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def dates_in(text: Column) -> Column:
    """Calendar days named in prose as 2024-01-31, 31 January 2024 or January 31, 2024; impossible ones are dropped."""
    month = "(?i:" + "|".join(MONTHS) + ")"
    number = F.array(*(F.lit(m) for m in MONTHS))
    iso = F.transform(F.regexp_extract_all(text, F.lit(r"\b(?:19|20)\d{2}-\d{2}-\d{2}\b"), F.lit(0)), lambda s: F.try_to_date(s, "yyyy-MM-dd"))

    def named(pattern, d, m, y):
        def one(s):
            part = lambda i: F.regexp_extract(s, pattern, i)
            return F.try_to_date(F.concat(part(y), F.lit("-"), F.lpad(F.array_position(number, F.lower(part(m))).cast("string"), 2, "0"), F.lit("-"), F.lpad(part(d), 2, "0")), "yyyy-MM-dd")

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)

    day_first = named(rf"\b(\d{{1,2}}) ({month}) ((?:19|20)\d{{2}})\b", 1, 2, 3)
    month_first = named(rf"\b({month}) (\d{{1,2}}), ((?:19|20)\d{{2}})\b", 2, 1, 3)
    return F.array_sort(F.array_distinct(F.filter(F.concat(iso, day_first, month_first), lambda d: d.isNotNull())))


def bound_issues(rows: DataFrame) -> DataFrame:
    """(id, issue) of rows whose time breaks a rule: reversed bounds, a relation that its status does not allow, text that is no date."""
    start, until = point()
    bad_date = lambda c: c.isNotNull() & (F.col("precision") != "instant") & F.try_to_date(period_start(c)).isNull()
    issue = (
        F.when(bad_date(F.col("start")) | bad_date(F.col("until")), "not_a_date")
        .when(start > until, "reversed")
        .when((F.col("relation") == "occurred") & (F.col("temporal_status") != "actual"), "status")
        .when(F.col("relation").isin("scheduled", "due") & (F.col("temporal_status") == "actual"), "status")
    )
    return rows.select("id", issue.alias("issue")).filter("issue IS NOT NULL")


def owning_timeline(slugs: DataFrame, timelines: DataFrame, slug: str = "slug", folder: str = "folder") -> DataFrame:
    """(slug, timeline): the timeline of the longest folder that the slug lies in, by an equi-join on every prefix."""
    parts = F.split(slug, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = slugs.select(slug, F.explode(prefixes).alias(folder))
    return each.join(timelines, folder).groupBy(slug).agg(F.max_by("timeline", F.length(folder)).alias("timeline"))
