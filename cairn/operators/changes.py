"""Changes to a table of files as plans: apply, undo, move, forget, adopt. Each returns tables; a sink writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.evidence import undoable


def apply(files: DataFrame, edits: DataFrame, change: str) -> tuple[DataFrame, DataFrame]:
    """Files after edits (path, mode, text), and journal rows (change, path, before, after, before_text).

    Modes: create (only where there is no file), append (a line below), replace, delete. An edit
    that its mode forbids changes nothing and is not journalled.
    """
    both = files.select("path", F.col("text").alias("_old")).join(edits.select("path", "mode", F.col("text").alias("_new")), "path", "full")
    new = (
        F.when(F.col("mode").isNull(), F.col("_old"))
        .when((F.col("mode") == "create") & F.col("_old").isNull(), F.col("_new"))
        .when((F.col("mode") == "append") & F.col("_old").isNotNull(), F.concat(F.rtrim("_old"), F.lit("\n"), F.col("_new"), F.lit("\n")))
        .when((F.col("mode") == "replace") & F.col("_old").isNotNull(), F.col("_new"))
        .when(F.col("mode") == "delete", F.lit(None))
        .otherwise(F.col("_old"))
    )
    done = both.withColumn("text", new)
    moved = ~F.col("_old").eqNullSafe(F.col("text"))
    journal = done.filter(moved).select(F.lit(change).alias("change"), "path", F.sha2("_old", 256).alias("before"), F.sha2("text", 256).alias("after"), F.col("_old").alias("before_text"))
    return done.filter("text IS NOT NULL").select("path", "text"), journal


def undo(files: DataFrame, journal: DataFrame) -> DataFrame:
    """Files with every journalled change undone whose files all still have the bytes it left."""
    now = files.select("path", F.sha2("text", 256).alias("hash"))
    valid = undoable(journal.select("change", "path", "after"), now).filter("valid").select("change")
    back = journal.join(valid, "change", "left_semi").select("path", "before_text", F.lit(True).alias("_back"))
    both = files.join(back, "path", "full")
    return both.select("path", F.when(F.col("_back"), F.col("before_text")).otherwise(F.col("text")).alias("text")).filter("text IS NOT NULL")


def move(files: DataFrame, links: DataFrame, old: str, new: str) -> DataFrame:
    """Files after a page moves: its own path, its attachments below it, and [[links]] to it on the pages that have one."""
    stem = lambda p: p.removesuffix(".md")
    below = F.col("path").startswith(stem(old) + "/")
    path = F.when(F.col("path") == old, F.lit(new)).when(below, F.concat(F.lit(stem(new)), F.substr("path", F.lit(len(stem(old)) + 1)))).otherwise(F.col("path"))
    from_pages = links.filter(F.col("to_slug") == stem(old)).select(F.col("from_page").alias("path")).distinct().withColumn("_link", F.lit(True))
    held = files.join(from_pages, "path", "left")
    text = F.col("text")
    for end in ("]]", "|", "#"):
        text = F.replace(text, F.lit(f"[[{stem(old)}{end}"), F.lit(f"[[{stem(new)}{end}"))
    return held.select(path.alias("path"), F.when(F.col("_link"), text).otherwise(F.col("text")).alias("text"))


def forget(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, tombstones) for ids to forget; what was never there leaves no tombstone."""
    gone = ids.select(key).distinct()
    return rows.join(gone, key, "left_anti"), rows.select(key).distinct().join(gone, key, "left_semi").withColumn("forgotten", F.lit(True))


def adopt(documents: DataFrame, pages: DataFrame, slug: str = "slug") -> DataFrame:
    """New pages for documents that no page owns: (slug, document), unless the slug is taken, and one document to a slug."""
    free = documents.filter("page_id IS NULL").join(pages.select(slug), slug, "left_anti")
    return free.groupBy(slug).agg(F.min("document").alias("document"))


def _per_page(pages: DataFrame, more: DataFrame, key: str, text: str, run, out: str) -> DataFrame:
    """mapInArrow(run) of (key, text, rows): each page with the rows of ``more`` that are for it, by ``nth``; pages without are left out."""
    rows = more.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", *(c for c in more.columns if c not in (key, "nth"))))).alias("_rows"))
    return rows.join(pages.select(F.col(key), F.col(text).alias("_text")), key, "left").select(key, "_text", "_rows").mapInArrow(run, out)


def edit(pages: DataFrame, edits: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, text, first_line, refused) of pages with edits (key, nth, mode, a, b), applied in the order of nth.

    Modes: patch (a: a unified diff), append (a below the section b, or at the end), swap (the
    one place that reads a becomes b), content (a is the whole body). The header of a page is
    never touched. If one edit of a page is refused, none of its edits is made: ``refused`` then
    says which and why, and first_line is null, as where nothing changed. A page that is not
    there refuses all edits. The edits of one page meet in one row.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        from cairn.functions.edits import edited, first_change

        for batch in batches:
            texts, first, refused = [], [], []
            for before, rows in zip(batch.column("_text").to_pylist(), batch.column("_rows").to_pylist(), strict=True):
                now, why = before, None if before is not None else "no such page"
                for r in rows if why is None else ():
                    now, why = edited(now, r["mode"], r["a"], r["b"])
                    if why:
                        why = f"{r['nth']}: {why}"
                        break
                texts.append(before if why else now)
                first.append(None if why else first_change(before, now))
                refused.append(why)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(first, pa.int32()), pa.array(refused, pa.string())], [key, "text", "first_line", "refused"])

    return _per_page(pages, edits, key, text, run, f"`{key}` {kind}, text string, first_line int, refused string")


def add_events(pages: DataFrame, events: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, text, lines) of ledgers with events (key, nth, date, summary, slug) added in the order of nth, by functions.ledger.inserted().

    ``lines`` has (nth, line) of each event, added or already there. A ledger that does not
    exist is made. All ledgers are merged in one job, each once; doing it again changes nothing.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        from cairn.functions.ledger import inserted

        for batch in batches:
            texts, lines = [], []
            for before, rows in zip(batch.column("_text").to_pylist(), batch.column("_rows").to_pylist(), strict=True):
                after, at = inserted(before, [(r["date"], r["summary"] or "", r["slug"]) for r in rows])
                texts.append(after)
                lines.append([{"nth": r["nth"], "line": n} for r, n in zip(rows, at, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.list_(pa.struct([("nth", pa.int64()), ("line", pa.int32())])))], [key, "text", "lines"])

    rows = events.select(key, F.col("nth").cast("long").alias("nth"), F.col("date").cast("string").alias("date"), "summary", "slug")
    return _per_page(pages, rows, key, text, run, f"`{key}` {kind}, text string, lines array<struct<nth: bigint, line: int>>")
