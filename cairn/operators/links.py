"""Links: extraction, resolution, backlinks, names inside longer subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The forms of a link in Markdown.
WIKILINK = r"(!?)\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"
MD_LINK = r"(?<!!)\[[^\]]*\]\(([^)\s]+\.md)(?:#[^)]*)?\)"


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(from_page, to_slug): distinct non-empty href values of each page."""
    found = pages.select(F.col(key).alias("from_page"), F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1)))).alias("to_slug"))
    return found.filter("to_slug <> ''").distinct()


def markdown_links(lines: DataFrame, page: str, folder: str, text: str = "text", line: str = "line") -> DataFrame:
    """(from_page, to_slug, kind, line) of wikilinks, embeds and relative .md links; the first line of each (target, kind).

    Relative targets are resolved against the page's folder: ``.`` is dropped and ``..`` takes
    the segment before it.
    """
    row = F.arrays_zip(F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1)).alias("bang"), F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(2)).alias("to"))
    wiki = lines.select(page, line, F.explode(row).alias("x")).select(F.col(page).alias("from_page"), F.trim("x.to").alias("to_slug"), F.when(F.col("x.bang") == "!", "embed").otherwise("wikilink").alias("kind"), F.col(line).alias("line"))
    md = lines.select(page, folder, line, F.explode(F.regexp_extract_all(text, F.lit(MD_LINK), F.lit(1))).alias("to"))
    full = F.when(F.col("to").startswith("/"), F.col("to")).otherwise(F.concat_ws("/", folder, "to"))
    parts = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    path = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    slug = F.regexp_replace(F.array_join(path, "/"), r"\.md$", "")
    rel = md.select(F.col(page).alias("from_page"), slug.alias("to_slug"), F.lit("markdown").alias("kind"), F.col(line).alias("line"))
    return wiki.unionByName(rel).groupBy("from_page", "to_slug", "kind").agg(F.min("line").alias("line"))


def resolve_links(links: DataFrame, pages: DataFrame, to: str, slug: str) -> DataFrame:
    """links with ``broken``: no page has the target's slug."""
    known = pages.select(F.col(slug).alias(to)).distinct().withColumn("_known", F.lit(True))
    return links.join(known, to, "left").withColumn("broken", F.col("_known").isNull()).drop("_known")


def backlinks(links: DataFrame, to: str, origin: str) -> DataFrame:
    return links.groupBy(to).agg(F.count_distinct(origin).alias("pages"))


def contained_names(subjects: DataFrame, key: str, subject: str, names: DataFrame) -> DataFrame:
    """(key, entity): subjects that hold one of the names (entity, name) only, in whole words, by an automaton of the names."""
    from cairn.operators.names import mentions

    known = names.select(F.col("name").alias("normalized"), "name").distinct()
    held = mentions(subjects, key, subject, known, every=True, least=1).select(key, "name").distinct().join(names, "name")
    return held.groupBy(key).agg(F.min("entity").alias("entity"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
