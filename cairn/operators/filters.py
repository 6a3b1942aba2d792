"""Filters: recall filters, page listing, view eligibility, folder rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_filter(df: DataFrame, folder: str | None = None, folder_col: str = "folder", types: Sequence[str] = (), type_col: str = "type", roles: Sequence[str] = (), role_col: str = "role", tags: Sequence[str] = (), tags_col: str = "tags", ranges: dict[str, tuple] | None = None) -> DataFrame:
    """Rows that a recall may rank: folder prefix, type, role, all tags (case-folded, exact), ranges.

    A null never matches. Prefixes are plain text, with no wildcards.
    """
    on: list[Column] = []
    if folder:
        on.append(F.col(folder_col).startswith(folder))
    if types:
        on.append(F.col(type_col).isin(*types))
    if roles:
        on.append(F.col(role_col).isin(*roles))
    if tags:
        low = F.transform(tags_col, F.lower)
        on += [F.array_contains(low, t.lower()) for t in tags]
    for c, (lo, hi) in (ranges or {}).items():
        if lo is not None:
            on.append(F.col(c) >= lo)
        if hi is not None:
            on.append(F.col(c) <= hi)
    return df.filter(reduce(lambda x, y: x & y, on)) if on else df


def period_end(prefix: Column) -> Column:
    """Last day of a YYYY, YYYY-MM or YYYY-MM-DD prefix."""
    n = F.length(prefix)
    return (
        F.when(n == 4, F.concat(prefix, F.lit("-12-31")))
        .when(n == 7, F.last_day(F.try_to_date(F.concat(prefix, F.lit("-01")))).cast("string"))
        .otherwise(F.left(prefix, F.lit(10)))
    )


def period_start(prefix: Column) -> Column:
    n = F.length(prefix)
    return F.when(n == 4, F.concat(prefix, F.lit("-01-01"))).when(n == 7, F.concat(prefix, F.lit("-01"))).otherwise(F.left(prefix, F.lit(10)))


def view_eligible(view: str) -> Column:
    """Whether a memory row belongs to a view; a current hold belongs to history alone (and to all).

    Reads kind, commitment, disposition, basis, temporal_status, temporal_relation,
    answer_eligible and current_hold.
    """
    kind, commitment, disposition = F.col("kind"), F.col("commitment"), F.col("disposition")
    status, relation = F.col("temporal_status"), F.col("temporal_relation")
    tentative_plan = kind.isin("claim", "event") & commitment.isin("asserted", "tentative") & (status == "tentative") & relation.isin("scheduled", "due")
    by_view = {
        "factual": F.col("answer_eligible"),
        "reports": F.col("basis") == "source_report",
        "questions": kind == "question",
        "planning": ((kind == "plan") | status.isin("planned", "scheduled") | tentative_plan) & disposition.isin("active", "proposed", "accepted"),
        "history": disposition.isin("rejected", "cancelled", "completed", "superseded", "resolved") | ((kind == "decision") & (disposition == "accepted")),
        "discussion": commitment.isin("tentative", "hypothetical", "counterfactual") | disposition.isin("proposed", "rejected"),
    }
    if view == "all":
        return F.lit(True)
    return F.coalesce(F.when(F.col("current_hold"), F.lit(view == "history")).otherwise(by_view[view]), F.lit(False))


def chunk_view(chunks: DataFrame, memories: DataFrame, view: str) -> DataFrame:
    """chunks with ``state`` for a view: excluded, eligible or contextual.

    Memories lie in a chunk by page and line. A chunk without memories is eligible for the
    factual view. Of those with memories, one with a duplicate id fails closed, one with an
    eligible memory only is eligible, and one that holds others too is contextual.
    """
    ids = memories.groupBy("memory_id").agg((F.count(F.lit(1)) > 1).alias("_twice"))
    m = memories.join(ids, "memory_id").select(F.col("page_id").alias("_p"), "line", view_eligible(view).alias("_ok"), "_twice")
    inside = chunks.join(m, (F.col("page_id") == F.col("_p")) & F.col("line").between(F.col("line_start"), F.col("line_end")), "left")
    by = inside.groupBy("chunk_id").agg(F.count("_p").alias("n"), F.count_if("_ok").alias("ok"), F.coalesce(F.bool_or("_twice"), F.lit(False)).alias("twice"))
    state = (
        F.when((F.col("n") == 0), F.lit("eligible" if view in ("factual", "all") else "excluded"))
        .when(F.col("twice"), "excluded")
        .when(F.col("ok") == F.col("n"), "eligible")
        .when(F.col("ok") > 0, "contextual")
        .otherwise("excluded")
    )
    return by.select("chunk_id", "n", "ok", state.alias("state"))


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ** over folders, * and ? within one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if not glob[i].isalnum() and glob[i] not in "/_-" else glob[i]), i + 1
    return f"^{out}$"


def specificity(glob: str) -> int:
    """Longer literal text and fewer wildcards make a rule more specific."""
    return sum(c not in "*?" for c in glob) * 4 - glob.count("*") - glob.count("?")


def apply_rules(pages: DataFrame, rules: Sequence[dict], path: str, fields: Sequence[str]) -> DataFrame:
    """pages with each field from the most specific rule that matches the path and declares it.

    The rules are configuration, a short list, and become one expression per field.
    """
    ordered = sorted(rules, key=lambda r: (-specificity(r["glob"]), r["glob"]))
    out = pages
    for f in fields:
        told = [F.when(F.col(path).rlike(glob_pattern(r["glob"])), F.lit(r[f])) for r in ordered if r.get(f) is not None]
        out = out.withColumn(f, F.coalesce(*told) if told else F.lit(None).cast("string"))
    return out


def edge_eligible(view: str, history: bool = False) -> Column:
    """Whether a graph edge may be walked in a view: an edge without a memory always, others by the memory's fields.

    Reads source_memory, kind, basis, commitment, disposition, temporal_status and
    answer_eligible. With ``history`` what answers factually is let through as well.
    """
    if view == "all":
        return F.lit(True)
    kind, disposition = F.col("kind"), F.col("disposition")
    factual = F.col("answer_eligible")
    selected = {
        "factual": factual,
        "reports": F.col("basis") == "source_report",
        "questions": kind == "question",
        "planning": ((kind == "plan") | F.col("temporal_status").isin("planned", "scheduled")) & disposition.isin("active", "proposed", "accepted"),
        "history": disposition.isin("rejected", "cancelled", "completed", "superseded", "resolved") | ((kind == "decision") & (disposition == "accepted")),
        "discussion": F.col("commitment").isin("tentative", "hypothetical", "counterfactual") | disposition.isin("proposed", "rejected"),
    }[view]
    return F.col("source_memory").isNull() | F.coalesce(selected | factual if history else selected, F.lit(False))
