"""Members of overview pages, and the evidence that a synthesis of a page may read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.retain import first_rows

#: The most members of an overview, the most types and excluded pages that it may name.
MEMBERS, TYPES, EXCLUDED = 30, 8, 30
#: Fixed values of evidence: characters in all, source pages, entries of a kind that are looked at and taken from a page, and characters of one.
BUDGET, SOURCES, LOOKED_AT, TAKEN, SPAN = 36_000, 30, 200, 50, 2_000


def scope_status(kind: Column, declared: Column, folder: Column, types: Column, exclude: Column) -> Column:
    """complete, invalid_scope, missing_scope (an overview page that declares none), or null: no overview.

    A folder is a relative path of plain parts; one to eight different types; at most thirty
    different pages to leave out, all below the folder.
    """
    plain = lambda p: p.rlike(r"^[^\\\x00:*?\[\]{}]+$") & ~p.rlike(r"(^|/)\.{0,2}(/|$)")
    fit = plain(folder) & (F.length(folder) <= 500) & F.size(types).between(1, TYPES) & (F.size(F.array_distinct(types)) == F.size(types))
    fit = fit & F.forall(types, lambda t: (F.trim(t) == t) & F.length(t).between(1, 100))
    left = F.coalesce(exclude, F.array().cast("array<string>"))
    fit = fit & (F.size(left) <= EXCLUDED) & (F.size(F.array_distinct(left)) == F.size(left)) & F.forall(left, lambda e: e.startswith(F.concat(folder, F.lit("/"))) & plain(e) & (F.length(e) <= 500))
    return F.when(declared, F.when(F.coalesce(fit, F.lit(False)), "complete").otherwise("invalid_scope")).when(kind == "overview", "missing_scope")


def overview_members(overviews: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, coverage) of overviews (slug, type, declared, folder, types, exclude) among pages (slug, type, role).

    Members are knowledge pages of one of the types below the folder, but for the overview and
    those it leaves out: the first MEMBERS by slug, letters of either case alike, with their
    rank. coverage: (overview, status, limit_reached), partial where there are more. A page
    meets overviews by the folders it is in; the first of a folder of any size are found in
    several tasks and merged.
    """
    scopes = overviews.select(F.col("slug").alias("overview"), scope_status(F.col("type"), F.col("declared"), F.col("folder"), F.col("types"), F.col("exclude")).alias("status"), "folder", "types", "exclude").filter("status IS NOT NULL")
    parts = F.split("slug", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    inside = pages.filter((F.col("role") == "knowledge") & F.contains("slug", F.lit("/"))).select("slug", F.col("type").alias("_type"), F.explode(above).alias("folder"))
    met = inside.join(scopes.filter("status = 'complete'"), "folder").filter(F.array_contains("types", F.col("_type")) & (F.col("slug") != F.col("overview")) & ~F.array_contains(F.coalesce("exclude", F.array().cast("array<string>")), F.col("slug")))
    first = first_rows(met.select("overview", "slug", F.lower("slug").alias("_l")), ["overview"], ["_l", "slug"], MEMBERS + 1, "rank")
    more = first.groupBy("overview").agg((F.max("rank") > MEMBERS).alias("limit_reached"))
    reached = F.coalesce("limit_reached", F.lit(False))
    coverage = scopes.join(more, "overview", "left").select("overview", F.when(reached, "partial").otherwise(F.col("status")).alias("status"), reached.alias("limit_reached"))
    return first.filter(F.col("rank") <= MEMBERS).select("overview", "slug", "rank"), coverage


def _fit(remaining: int, head: int, summary: int, facts: list[int], events: list[int]) -> tuple[int, int, int] | None:
    """How much of a page fits: its summary or not, facts and events; the last events go first, then facts, then the summary."""
    size = head + summary + sum(facts) + sum(events)
    n, m, s = len(facts), len(events), int(summary > 0)
    while size > remaining:
        if m:
            m -= 1
            size -= events[m]
        elif n:
            n -= 1
            size -= facts[n]
        elif s:
            s, size = 0, size - summary
        else:
            return None
    return s, n, m


def select_evidence(sources: DataFrame, entries: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, entries, exclusions) that a synthesis of each subject may read, within ``budget`` characters.

    sources: subject, source, slug, head and summary (characters of the page's frame and summary,
    0 for none). entries: subject, source, kind (fact or event), ord, length, issue (why it may
    not be used, or null). Of a subject the first SOURCES pages by slug; of a page and kind the
    first LOOKED_AT entries, of which those without issue and of at most SPAN characters, TAKEN at
    most. Pages are then fitted one after another into what the budget leaves, whole entries
    only; a page of which nothing fits is left out. exclusions count what was left out by
    reason. A subject's choice is made of at most SOURCES * 2 * TAKEN lengths, in one row;
    everything before is done in parallel for all subjects.
    """
    near = first_rows(sources.withColumn("_l", F.lower("slug")), ["subject"], ["_l", "slug", "source"], SOURCES, "_page")
    looked = first_rows(entries.join(near.select("subject", "source"), ["subject", "source"], "left_semi"), ["subject", "source", "kind"], ["ord"], LOOKED_AT + 1, "_nth")
    over = looked.filter(F.col("_nth") > LOOKED_AT).select("subject", "source", F.concat("kind", F.lit("_limit")).alias("reason"))
    reason = F.when(F.col("issue").isNotNull(), F.col("issue")).when(F.col("length") > SPAN, "span_limit")
    judged = looked.filter(F.col("_nth") <= LOOKED_AT).withColumn("reason", reason)
    w = Window.partitionBy("subject", "source", "kind").orderBy("ord")  # LOOKED_AT rows at most
    ranked = judged.filter("reason IS NULL").drop("reason").withColumn("rank", F.row_number().over(w))
    limited = ranked.filter(F.col("rank") > TAKEN).select("subject", "source", F.concat("kind", F.lit("_limit")).alias("reason"))
    good = ranked.filter(F.col("rank") <= TAKEN)
    lengths = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", "length")))), lambda x: x["length"].cast("long"))
    sums = good.groupBy("subject", "source").agg(lengths("fact").alias("facts"), lengths("event").alias("events"))
    none = F.array().cast("array<bigint>")
    rows = near.join(sums, ["subject", "source"], "left").select("subject", F.struct("_page", "source", F.col("head").cast("long").alias("head"), F.col("summary").cast("long").alias("summary"), F.coalesce("facts", none).alias("facts"), F.coalesce("events", none).alias("events")).alias("_p"))
    kind, own = rows.schema["subject"].dataType.simpleString(), sources.schema["source"].dataType

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            at, columns = [], [[] for _ in range(5)]
            for i, pages in enumerate(b.column(1).to_pylist()):
                remaining = budget
                for p in pages:
                    fits = _fit(remaining, p["head"], p["summary"], p["facts"], p["events"])
                    s, n, m = fits or (0, 0, 0)
                    if fits:
                        remaining -= p["head"] + s * p["summary"] + sum(p["facts"][:n]) + sum(p["events"][:m]) + 2
                    cut = len(p["facts"]) - n + len(p["events"]) - m + int(p["summary"] > 0) - s + (fits is None)
                    at.append(i)
                    for c, v in zip(columns, (p["source"], s if fits else None, n, m, cut), strict=True):
                        c.append(v)
            types = (to_arrow_type(own), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["subject", "source", "summary", "facts", "events", "cut"])

    chosen = rows.groupBy("subject").agg(F.array_sort(F.collect_list("_p")).alias("_ps")).mapInArrow(run, f"subject {kind}, source {own.simpleString()}, summary int, facts int, events int, cut int")
    pages = chosen.filter("summary IS NOT NULL").select("subject", "source", (F.col("summary") > 0).alias("summary"), "facts", "events")
    kept = good.join(chosen.select("subject", "source", "facts", "events"), ["subject", "source"]).filter(F.col("rank") <= F.when(F.col("kind") == "fact", F.col("facts")).otherwise(F.col("events")))
    left = over.unionByName(judged.filter("reason IS NOT NULL").select("subject", "source", "reason")).unionByName(limited).groupBy("subject", "source", "reason").agg(F.count(F.lit(1)).alias("n"))
    left = left.unionByName(chosen.filter("cut > 0").select("subject", "source", F.lit("prompt_limit").alias("reason"), F.col("cut").cast("long").alias("n")))
    return pages, kept.select("subject", "source", "kind", "ord", "length"), left
