"""Indexing a folder: snapshot, difference, changed pages only, tables by version. A rebuild gives the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.evidence import diff_snapshot, renames
from cairn.operators.links import markdown_links, resolve_links
from cairn.sources import markdown

TABLES = ("files", "pages", "chunks", "events", "links")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def table(spark: SparkSession, target: str, version: int, name: str) -> DataFrame:
    return spark.read.parquet(f"{target}/v{version}/{name}")


def latest(spark: SparkSession, target: str) -> int | None:
    """The newest version of which every table is complete."""
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and _exists(spark, f"{target}/{n}/{TABLES[-1]}/_SUCCESS")]
    return max(done, default=None)


def stale(spark: SparkSession, root: str, target: str, version: int) -> bool:
    """Whether the folder differs from a version: a file was added, changed, moved or removed."""
    now = markdown.scan(spark, root).select("rel_path", "size", "modified", "sha256")
    change = diff_snapshot(table(spark, target, version, "files"), now, "rel_path", ["size", "modified"], "sha256")
    return not change.filter(~F.col("change").isin("same", "touched")).isEmpty()


def _links(pages: DataFrame) -> DataFrame:
    lines = pages.select("slug", F.regexp_extract("slug", "^(.*)/", 1).alias("folder"), F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("line", F.col("n") + 1)
    return markdown_links(lines, "slug", "folder")


def index(spark: SparkSession, root: str, target: str, version: int, before: int | None = None) -> DataFrame:
    """Write the tables of a version and return what changed: (rel_path, change).

    With an earlier version only added and changed pages are parsed; rows of the others are
    carried over. Links are resolved against all slugs of the new version. A version is written
    beside the old one, so readers never see half of it; a repeated run overwrites its own.
    """
    files = markdown.scan(spark, root)
    snap = files.select("rel_path", "kind", "size", "modified", "sha256")
    out = f"{target}/v{version}"
    snap.write.mode("overwrite").parquet(f"{out}/files")
    snap = table(spark, target, version, "files")
    if before is None or not _exists(spark, f"{target}/v{before}/files"):
        change = snap.select("rel_path", F.lit("added").alias("change"))
        kept = None
    else:
        change = diff_snapshot(table(spark, target, before, "files"), snap, "rel_path", ["size", "modified"], "sha256")
        kept = change.filter(F.col("change").isin("same", "touched")).select("rel_path")
    fresh = files.join(change.filter(F.col("change").isin("added", "changed")).select("rel_path"), "rel_path", "left_semi")
    pages = markdown.pages(fresh)
    if kept is not None:
        pages = pages.unionByName(table(spark, target, before, "pages").join(kept, "rel_path", "left_semi"))
    pages.write.mode("overwrite").parquet(f"{out}/pages")
    pages = table(spark, target, version, "pages")
    new = pages.join(fresh.select("rel_path"), "rel_path", "left_semi") if kept is not None else pages
    parts = {"chunks": markdown.chunks(new), "events": markdown.events(new), "links": _links(new)}
    for name, df in parts.items():
        key = "from_page" if name == "links" else "slug"
        if kept is not None:
            stay = pages.join(kept, "rel_path", "left_semi").select(F.col("slug").alias(key))
            df = df.unionByName(table(spark, target, before, name).drop("broken").join(stay, key, "left_semi"))
        if name == "links":
            df = resolve_links(df, pages, "to_slug", "slug").select("from_page", "to_slug", "kind", "line", "broken")
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    return change


def moved(spark: SparkSession, target: str, old: int, new: int) -> DataFrame:
    """(old, new): files of equal content and kind that changed their path between two versions."""
    a, b = (table(spark, target, v, "files").select("rel_path", "sha256", "kind") for v in (old, new))
    gone, come = a.join(b.select("rel_path"), "rel_path", "left_anti"), b.join(a.select("rel_path"), "rel_path", "left_anti")
    return renames(gone, come, "rel_path", ["sha256", "kind"])
