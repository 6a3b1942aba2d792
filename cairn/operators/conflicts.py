"""Disagreements by classes of equal values: linear in the facts, whatever the size of a subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import numbers

_KEY = ["subject", "attribute"]


def value_classes(facts: DataFrame, key: str = "id", page: str = "page", line: str = "line") -> DataFrame:
    """(subject, attribute, class, anchor, facts, pages): the facts of a subject's attribute by the numbers that their values tell.

    Two values conflict if both have numbers and these differ, so each class conflicts with every
    other one of its attribute; values without numbers are in none. ``anchor`` is the class's
    first fact by page and line. Classes that stand on one and the same page only are left out
    unless another one disagrees from elsewhere (disagreeing()).
    """
    f = facts.withColumn("class", F.array_join(numbers(F.col("value")), ",")).filter(F.col("class") != "")
    rows = f.groupBy(*_KEY, "class").agg(F.min_by(key, F.struct(page, line, key)).alias("anchor"), F.count(F.lit(1)).alias("facts"), F.count_distinct(page).alias("pages"), F.min(page).alias("_page"))
    several = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_n"), F.max("pages").alias("_most"), F.min("_page").alias("_lo"), F.max("_page").alias("_hi"))
    several = several.filter("_n > 1 AND (_most > 1 OR _lo <> _hi)")
    return rows.join(several.select(*_KEY), _KEY, "left_semi").drop("_page")


def disagreeing(facts: DataFrame, key: str = "id", page: str = "page") -> DataFrame:
    """facts that a fact of another page contradicts, with ``class``.

    A fact of class A on page p is contradicted if some (class, page) has another class and
    another page: all of them, less those of A, less those of p, plus the one of both.
    """
    f = facts.withColumn("class", F.array_join(numbers(F.col("value")), ",")).filter(F.col("class") != "")
    cells = f.select(*_KEY, "class", page).distinct()
    count = lambda by, name: cells.groupBy(*_KEY, *by).agg(F.count(F.lit(1)).alias(name))
    on = cells.join(count([], "_all"), _KEY).join(count(["class"], "_class"), [*_KEY, "class"]).join(count([page], "_page"), [*_KEY, page])
    against = on.filter(F.col("_all") - F.col("_class") - F.col("_page") + 1 > 0).select(*_KEY, "class", page)
    return f.join(against, [*_KEY, "class", page], "left_semi")


def anchors(facts: DataFrame, key: str = "id", page: str = "page", line: str = "line") -> DataFrame:
    """(subject, attribute, anchor, claims, classes): of the facts that disagree across pages the first by page and line, and how many there are."""
    return disagreeing(facts, key, page).groupBy(*_KEY).agg(F.min_by(key, F.struct(page, line, key)).alias("anchor"), F.count(F.lit(1)).alias("claims"), F.count_distinct("class").alias("classes"))


def same_event_counts(events: DataFrame, key: str, fields: list[str], subject: str = "subject") -> DataFrame:
    """(key, same): how many other events have equal fields, nulls too, and the same subject, where unresolved fits any.

    Events are counted by envelope and subject, and envelopes meet their classes: no pairs.
    """
    classes = events.groupBy(*fields, subject).agg(F.count(F.lit(1)).alias("_own"))
    whole = classes.groupBy(*fields).agg(F.sum("_own").alias("_all"), F.coalesce(F.sum(F.when(F.col(subject) == "unresolved", F.col("_own"))), F.lit(0)).alias("_open"))
    same = F.when(F.col("s") == "unresolved", F.col("_all")).otherwise(F.col("_own") + F.col("_open"))
    on = None
    for f in fields:
        e = F.col(f"c.{f}").eqNullSafe(F.col(f"w.{f}"))
        on = e if on is None else on & e
    known = classes.alias("c").join(whole.alias("w"), on).select(*(F.col(f"c.{f}").alias(f) for f in fields), F.col(f"c.{subject}").alias("s"), "_own", "_all", "_open")
    met = None
    for f in fields:
        e = F.col(f"e.{f}").eqNullSafe(F.col(f"k.{f}"))
        met = e if met is None else met & e
    met = met & F.col(f"e.{subject}").eqNullSafe(F.col("k.s"))
    return events.alias("e").join(known.alias("k"), met).select(F.col(f"e.{key}").alias(key), (same - 1).alias("same"))
