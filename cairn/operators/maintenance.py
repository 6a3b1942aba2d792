"""Maintenance analytics: folders, health, duplicates, similar pairs, rules, budgets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.scratch import parts

#: Rows of a block in one bucket: a task holds two buckets at a time.
BUCKET = 1024


def folder_counts(paths: DataFrame, path: str, parent: str = "") -> DataFrame:
    """(child, direct, deep, folders) below a parent folder: pages in the child, below it, and its distinct subfolders."""
    below = paths.filter(F.col(path).startswith(parent + "/")) if parent else paths
    rest = F.split(F.substr(path, F.lit(len(parent) + 2 if parent else 1)), "/")
    p = below.select(rest.alias("r")).filter(F.size("r") > 1).select(F.col("r")[0].alias("child"), F.size("r").alias("n"), F.get("r", F.lit(1)).alias("sub"))
    return p.groupBy("child").agg(F.count_if(F.col("n") == 2).alias("direct"), F.count(F.lit(1)).alias("deep"), F.count_distinct(F.when(F.col("n") > 2, F.col("sub"))).alias("folders"))


def tree(paths: DataFrame, path: str, depth: int) -> DataFrame:
    """(prefix, depth, n): pages under every folder down to a depth."""
    parts = F.split(path, "/")
    n = F.least(F.size(parts) - 1, F.lit(depth))
    ups = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("prefix"), k.alias("depth")))
    return paths.select(F.explode(ups).alias("x")).groupBy("x.prefix", "x.depth").agg(F.count(F.lit(1)).alias("n"))


def busiest(paths: DataFrame, path: str, top: int = 4) -> DataFrame:
    """The top-level folders with most pages."""
    return paths.filter(F.col(path).contains("/")).groupBy(F.split_part(path, F.lit("/"), F.lit(1)).alias("folder")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "folder").limit(top)


def undeclared(paths: DataFrame, path: str, declared: DataFrame) -> DataFrame:
    """(path, folder): the shallowest folder on each path that is not declared."""
    parts = F.split(path, "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    each = paths.filter(F.size(parts) > 1).select(path, F.explode(ups).alias("folder"))
    return each.join(declared, "folder", "left_anti").groupBy(path).agg(F.min_by("folder", F.length("folder")).alias("folder"))


def health(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(counter, n): how many rows of a table meet a condition, one scan a table."""
    return reduce(DataFrame.unionByName, (df.agg(F.count_if(on).alias("n")).select(F.lit(k).alias("counter"), "n") for k, (df, on) in checks.items()))


def routing(hits: DataFrame, folder: str = "folder", least: float = 0.5) -> DataFrame:
    """(folder, relevance): the best relevance of each folder that reaches the threshold."""
    return hits.groupBy(folder).agg(F.max("relevance").alias("relevance")).filter(F.col("relevance") >= least)


def _pairs_of(key: str, vec: str, least: float):
    """Pairs of one bucket pair with a cosine of at least about ``least``, by matrix products."""

    def run(group: pa.Table) -> pa.Table:
        i, j = group.column("_i")[0].as_py(), group.column("_j")[0].as_py()
        same: dict[int, list[int]] = {}
        found = group.column(vec).to_pylist()
        for at, v in enumerate(found):
            if v is not None and None not in v:
                same.setdefault(len(v), []).append(at)
        a, b, cos = [], [], []
        for at in same.values():
            own = group.take(at)
            ids, bucket = own.column(key), own.column("_b").to_numpy()
            x = np.array([found[n] for n in at], np.float64)
            norm = np.sqrt((x * x).sum(axis=1))
            left, right = np.flatnonzero(bucket == i), np.flatnonzero(bucket == j)
            norm = np.where(norm == 0, 1.0, norm)
            c = (x[left] @ x[right].T) / (norm[left, None] * norm[right])
            p, q = np.nonzero(~(c < least - 1e-5))
            a.append(ids.take(left[p]))
            b.append(ids.take(right[q]))
            cos.append(c[p, q])
        kind = group.schema.field(key).type
        chunks = lambda cols: pa.chunked_array([x for c in cols for x in c.chunks], kind)
        return pa.table({"x": chunks(a), "y": chunks(b), "c": pa.array(np.concatenate([*cos, np.zeros(0)]))}).append_column("s", pa.array([i == j] * sum(map(len, cos)), pa.bool_()))

    return run


def similar_pairs(vectors: DataFrame, key: str, block: str, vec: str = "embedding", least: float = 0.68, excluded: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity): pairs of a block whose cosine reaches ``least``, less excluded pairs.

    Every pair of a block is compared, in double precision; a zero norm counts as 1. Its rows are dealt into buckets of about BUCKET rows, and
    each pair of buckets is compared apart, so that a block of any size spreads over many tasks.
    """
    rows = vectors.select(F.col(block).alias("_block"), key, vec).filter(F.col("_block").isNotNull())
    n = F.ceil(F.col("_n") / F.lit(BUCKET)).cast("int")
    rows = rows.join(rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")), "_block").withColumn("_b", F.pmod(F.xxhash64(key), n).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.least(k, F.col("_b")).alias("i"), F.greatest(k, F.col("_b")).alias("j")))
    dealt = rows.withColumn("_pair", F.explode(pair)).select("_block", "_b", key, vec, F.col("_pair.i").alias("_i"), F.col("_pair.j").alias("_j"))
    kind = vectors.schema[key].dataType.simpleString()
    met = dealt.groupBy("_block", "_i", "_j").applyInArrow(_pairs_of(key, vec, least), f"x {kind}, y {kind}, c double, s boolean")
    met = met.filter((F.col("x") != F.col("y")) & (~F.col("s") | (F.col("x") < F.col("y"))))  # a bucket met itself in both orders
    out = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("c", 6).alias("similarity")).filter(F.col("similarity") >= least)
    return out.join(excluded, ["a", "b"], "left_anti") if excluded is not None else out


def rule_drift(pages: DataFrame) -> DataFrame:
    """(id, drift) for pages (id, type, slug, depth) against their rule (rule_type, slug_pattern, rule_depth)."""
    drift = F.when(F.col("type") != F.col("rule_type"), "type").when(~F.rlike("slug", F.col("slug_pattern")), "slug").when(F.col("depth") > F.col("rule_depth"), "depth")
    return pages.select("id", drift.alias("drift")).filter("drift IS NOT NULL")


def unsearchable(documents: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Documents without a chunk."""
    return documents.join(chunks.select(key), key, "left_anti")


def shared_paths(items: DataFrame, item: str, path: str) -> DataFrame:
    """(a, b, paths): work items that touch a path in common.

    An item counts once a path before pairs are made, so these are only counted; tasks are as
    many as the rows ask for, so that what one holds does not grow with them.
    """
    n = parts(items)
    once = items.select(path, item).repartition(n, path).distinct()
    x, y = (once.select(path, F.col(item).alias(c)) for c in ("a", "b"))
    return x.join(y, path).filter("a < b").select("a", "b").repartition(n, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("paths"))


def reserve(items: DataFrame, cost: str, budget: float, order: list) -> DataFrame:
    """Items with ``reserved``: the running cost in order is within the budget. A bounded work list."""
    run = F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("running", run).withColumn("reserved", F.col("running") <= budget)


def verify_run(before: DataFrame, after: DataFrame, attributed: DataFrame) -> DataFrame:
    """(path, change, attributed): file changes of a run, and whether the run recorded them."""
    from cairn.operators.evidence import diff_snapshot

    d = diff_snapshot(before, after, "path", [], "hash").filter("change <> 'same'")
    own = attributed.select("path").distinct().withColumn("_own", F.lit(True))
    return d.join(own, "path", "left").select("path", "change", F.coalesce("_own", F.lit(False)).alias("attributed"))


def neighbourhood(page: str | int, pages: DataFrame, links: DataFrame, slug: str, limit: int = 31) -> DataFrame:
    """(id, slug, outbound, backlink) of pages that a page links to, that link to it or are about its slug; by slug, at most ``limit``.

    pages has id, slug, role and about; links from_page and to_page. Ignored pages and the page itself are left out.
    """
    out = links.filter(F.col("from_page") == F.lit(page)).select(F.col("to_page").alias("id"), F.lit(True).alias("_out"), F.lit(False).alias("_back"))
    back = links.filter(F.col("to_page") == F.lit(page)).select(F.col("from_page").alias("id"), F.lit(False).alias("_out"), F.lit(True).alias("_back"))
    near = out.unionByName(back).groupBy("id").agg(F.bool_or("_out").alias("_out"), F.bool_or("_back").alias("_back"))
    kept = pages.filter((F.col("id") != F.lit(page)) & (F.col("role") != "ignored")).join(near, "id", "left")
    kept = kept.filter(F.col("_out").isNotNull() | F.contains("about", F.lit(slug)))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return kept.select("id", "slug", flag("_out").alias("outbound"), flag("_back").alias("backlink")).orderBy(F.lower("slug"), "id").limit(limit)
