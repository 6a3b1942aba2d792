"""Maintenance queries: folders, health, similar pairs, rules, work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.text import slug
from cairn.operators import maintenance as M
from cairn.registry import query
from cairn.sources.tables import read

_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


def paths(spark, sf_dir):
    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))


@query("folder_counts", f"""WITH p AS (SELECT string_split({_PATH}, '/') AS r FROM pages) SELECT r[1] AS child, count_if(len(r) = 2)::BIGINT AS direct, count(*)::BIGINT AS deep, count(DISTINCT CASE WHEN len(r) > 2 THEN r[2] END)::BIGINT AS folders FROM p WHERE len(r) > 1 GROUP BY 1""")
def folder_counts(spark, sf_dir):
    return M.folder_counts(paths(spark, sf_dir), "path")


@query("tree_rollup", f"""WITH p AS (SELECT string_split({_PATH}, '/') AS r FROM pages), k AS (SELECT r, unnest(range(1, least(len(r) - 1, 2) + 1)) AS k FROM p) SELECT array_to_string(r[1:k], '/') AS prefix, k::INT AS depth, count(*)::BIGINT AS n FROM k GROUP BY 1, 2""")
def tree_rollup(spark, sf_dir):
    return M.tree(paths(spark, sf_dir), "path", 2)


@query("busiest_folders", f"SELECT split_part({_PATH}, '/', 1) AS folder, count(*)::BIGINT AS n FROM pages GROUP BY 1 ORDER BY n DESC, folder LIMIT 4")
def busiest_folders(spark, sf_dir):
    return M.busiest(paths(spark, sf_dir), "path")


@query("undeclared_folders", f"""WITH p AS (SELECT {_PATH} AS path, split_part({_PATH}, '/', 1) AS h FROM pages), d AS (SELECT DISTINCT h FROM p WHERE h LIKE 'blog.%')
SELECT path, CASE WHEN d.h IS NULL THEN p.h ELSE p.h || '/' || split_part(path, '/', 2) END AS folder FROM p LEFT JOIN d USING (h) WHERE d.h IS NULL OR len(string_split(path, '/')) > 2 GROUP BY ALL""")
def undeclared_folders(spark, sf_dir):
    p = paths(spark, sf_dir).select("path").distinct()
    declared = p.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder")).filter("folder LIKE 'blog.%'").distinct()
    return M.undeclared(p, "path", declared)


@query("health_counts", """SELECT 'documents' AS counter, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'short', count_if(n_chars < 100)::BIGINT FROM documents UNION ALL SELECT 'toxic', count_if(toxic = 1)::BIGINT FROM labels UNION ALL SELECT 'system_turns', count_if(role = 'system')::BIGINT FROM conversations UNION ALL SELECT 'open_orders', count_if(o_orderstatus = 'O')::BIGINT FROM orders""")
def health_counts(spark, sf_dir):
    d, c = read(spark, sf_dir, "documents", "n_chars"), F.col
    return M.health({"documents": (d, F.lit(True)), "short": (d, c("n_chars") < 100), "toxic": (read(spark, sf_dir, "labels", "toxic"), c("toxic") == 1), "system_turns": (read(spark, sf_dir, "conversations", "role"), c("role") == "system"), "open_orders": (read(spark, sf_dir, "orders", "o_orderstatus"), c("o_orderstatus") == "O")})


@query("folder_routing", "SELECT source AS folder, max(n_chars / 20000.0) AS relevance FROM documents GROUP BY 1 HAVING max(n_chars / 20000.0) >= 0.5")
def folder_routing(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "source", "n_chars").select(F.col("source").alias("folder"), (F.col("n_chars") / 20000.0).alias("relevance"))
    return M.routing(d)


_D = "list_dot_product(list_transform({0}, lambda x: x::DOUBLE), list_transform({1}, lambda x: x::DOUBLE))"
_CS = f"round({_D.format('a.embedding', 'b.embedding')} / (sqrt({_D.format('a.embedding', 'a.embedding')}) * sqrt({_D.format('b.embedding', 'b.embedding')})), 6)"


@query("similar_pairs_cosine", f"SELECT a.vec_id AS a, b.vec_id AS b, {_CS} AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 7 = b.vec_id % 7 AND a.vec_id < b.vec_id WHERE {_CS} >= 0.2")
def similar_pairs_cosine(spark, sf_dir):
    """Folders are label and a seventh of the ids."""
    v = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").withColumn("folder", F.col("label") * 7 + F.col("vec_id") % 7)
    return M.similar_pairs(v, "vec_id", "folder", least=0.2)


@query("similar_pairs_label", f"SELECT a.vec_id AS a, b.vec_id AS b, {_CS} AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_CS} >= 0.2")
def similar_pairs_label(spark, sf_dir):
    """Folders are labels: every pair of a label."""
    return M.similar_pairs(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), "vec_id", "label", least=0.2)


@query("rule_drift", """SELECT p_partkey AS id, CASE WHEN split_part(p_type, ' ', 1) <> 'STANDARD' THEN 'type' WHEN NOT regexp_matches(trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '-', 'g'), '-'), '[0-4]$') THEN 'slug' WHEN p_size > 30 THEN 'depth' END AS drift FROM part
WHERE split_part(p_type, ' ', 1) <> 'STANDARD' OR NOT regexp_matches(trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '-', 'g'), '-'), '[0-4]$') OR p_size > 30""")
def rule_drift(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_type", "p_name", "p_size")
    return M.rule_drift(p.select(F.col("p_partkey").alias("id"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("type"), slug(F.col("p_name")).alias("slug"), F.col("p_size").alias("depth"), F.lit("STANDARD").alias("rule_type"), F.lit("[0-4]$").alias("slug_pattern"), F.lit(30).alias("rule_depth")))


@query("unsearchable", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def unsearchable(spark, sf_dir):
    return M.unsearchable(read(spark, sf_dir, "documents", "doc_id"), read(spark, sf_dir, "labels", "doc_id"), "doc_id")


@query("shared_paths", "SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(DISTINCT a.l_orderkey)::BIGINT AS paths FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def shared_paths(spark, sf_dir):
    return M.shared_paths(read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey"), "l_suppkey", "l_orderkey")


@query("budget_reserve", "SELECT s_suppkey, sum(1 + s_suppkey % 9) OVER (ORDER BY s_suppkey)::BIGINT AS running, sum(1 + s_suppkey % 9) OVER (ORDER BY s_suppkey) <= 200 AS reserved FROM supplier")
def budget_reserve(spark, sf_dir):
    s = read(spark, sf_dir, "supplier", "s_suppkey").withColumn("cost", 1 + F.col("s_suppkey") % 9)
    return M.reserve(s, "cost", 200, ["s_suppkey"]).select("s_suppkey", "running", "reserved")


@query("run_verification", """WITH b AS (SELECT o_orderkey AS path, o_custkey AS h FROM orders WHERE o_orderkey % 20 <> 0), a AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_custkey END AS h FROM orders WHERE o_orderkey % 20 <> 1)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change, coalesce(a.path, b.path) % 3 = 0 AS attributed FROM b FULL JOIN a ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.h <> b.h""")
def run_verification(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("hash"))
    after = o.filter("path % 20 <> 1").withColumn("hash", F.when(F.col("path") % 7 == 0, F.lit(-1).cast("long")).otherwise(F.col("hash")))
    return M.verify_run(o.filter("path % 20 <> 0"), after, o.filter("path % 3 = 0"))


@query("list_pages", f"SELECT page_id, {_PATH} AS slug, octet_length(encode(html))::BIGINT AS bytes FROM pages WHERE {_PATH} LIKE 'blog.%' ORDER BY bytes DESC, slug LIMIT 50")
def list_pages(spark, sf_dir):
    p = read(spark, sf_dir, "pages", "page_id", "url", "html").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("slug"), F.octet_length("html").cast("long").alias("bytes"))
    return p.filter(F.col("slug").startswith("blog.")).orderBy(F.col("bytes").desc(), "slug").limit(50)
