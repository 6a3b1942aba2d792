"""Queries over guards, link repair, phases and recall."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators import memory as M
from cairn.registry import query
from cairn.sources.tables import read


@query("clean_facts", """WITH f AS (SELECT l_orderkey AS page, l_linenumber AS line, CASE WHEN l_quantity < 3 THEN 'x' ELSE 'Part ' || l_partkey % 5 END AS claim, l_discount AS confidence FROM lineitem WHERE l_linenumber % 5 <> 4),
g AS (SELECT page, line, lower(trim(claim)) AS k, arg_max(claim, (confidence, claim)) AS claim, max(confidence) AS confidence FROM f WHERE length(trim(claim)) BETWEEN 3 AND 500 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY confidence DESC, line, claim) AS n FROM g) SELECT page, line, claim, confidence FROM r WHERE n <= 3""")
def clean_facts(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    c = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.when(F.col("l_quantity") < 3, "x").otherwise(F.concat(F.lit("Part "), (F.col("l_partkey") % 5).cast("string"))).alias("claim"), F.col("l_discount").alias("confidence"))
    lines = c.select("page", "line").withColumn("eligible", F.col("line") % 5 != 4)
    return M.clean_facts(c, lines, 3).select("page", "line", "claim", "confidence")


@query("unsupported_values", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS missing FROM orders")
def unsupported_values(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    answer = F.concat(F.lit("It was on "), day)
    support = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Seen in "), F.regexp_replace(day, "-", " "))).otherwise(F.concat(day, F.lit(" it was")))
    return o.select("o_orderkey", F.array_join(F.filter(M.unsupported_values(answer, support), lambda v: F.contains(v, F.lit("-"))), ",").alias("missing"))


@query("quote_count", "SELECT doc_id, ((length(text) - length(replace(text, ' the ', ''))) / 5)::INT AS n FROM documents")
def quote_count(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", M.quote_count(F.col("text"), F.lit(" the ")).alias("n"))


@query("covered_spans", """WITH s AS (SELECT event_id AS id, user_id AS doc, event_id % 50 AS a, event_id % 50 + 5 AS b FROM events), f AS (SELECT DISTINCT user_id AS doc, 10 * (user_id % 3) AS a, 10 * (user_id % 3) + 20 AS b FROM events)
SELECT s.id, bool_or(f.a <= s.a AND s.b <= f.b) AS covered FROM s JOIN f USING (doc) GROUP BY 1""")
def covered_spans(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "user_id")
    s = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("doc"), (F.col("event_id") % 50).alias("start"), (F.col("event_id") % 50 + 5).alias("end"))
    f = e.select(F.col("user_id").alias("doc"), (10 * (F.col("user_id") % 3)).alias("start"), (10 * (F.col("user_id") % 3) + 20).alias("end")).distinct()
    return M.covered_spans(s, f)


@query("link_repairs", """WITH t AS (SELECT DISTINCT p_brand AS target FROM part), s AS (SELECT DISTINCT lower(replace(p_brand, '#', '-')) || CASE WHEN p_size % 2 = 0 THEN '/one' ELSE '' END AS slug FROM part WHERE p_size < 3),
tw AS (SELECT target, list_distinct(list_filter(string_split_regex(lower(target), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM t), sw AS (SELECT slug, list_distinct(list_filter(string_split_regex(lower(slug), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM s),
c AS (SELECT target, slug FROM tw, sw WHERE len(tw.w) > 1 AND len(list_intersect(tw.w, sw.w)) >= 0.75 * len(tw.w)) SELECT target, min(slug) AS slug FROM c GROUP BY 1 HAVING count(*) = 1""")
def link_repairs(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_brand", "p_size")
    slugs = p.filter("p_size < 3").select(F.concat(F.lower(F.regexp_replace("p_brand", "#", "-")), F.when(F.col("p_size") % 2 == 0, "/one").otherwise("")).alias("slug")).distinct()
    return M.repairs(p.select(F.col("p_brand").alias("target")).distinct(), slugs)


@query("event_phases", """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS a, (o_orderdate + INTERVAL 20 DAY)::DATE AS b FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'undated' WHEN b < DATE '1996-06-15' THEN 'past' WHEN a <= DATE '1996-06-15' THEN 'current' WHEN a - DATE '1996-06-15' <= 30 THEN 'upcoming' ELSE 'scheduled' END AS phase FROM o""")
def event_phases(spark, sf_dir):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    prose = F.concat(F.lit("Runs "), day("o_orderdate"), F.lit(" to "), day(F.col("o_orderdate") + F.expr("INTERVAL 20 DAY")))
    w = o.select("o_orderkey", M.event_window(F.lit("x/page"), F.when(F.col("o_orderkey") % 10 == 0, "no dates").otherwise(prose), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("w"))
    return w.select("o_orderkey", M.phase(F.col("w.start"), F.col("w.end"), F.lit("1996-06-15")).alias("phase"))


@query("recall_at_k", """WITH f AS (SELECT o_custkey AS c, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), e AS (SELECT o_custkey AS c, o_orderkey AS item FROM orders WHERE o_orderkey % 3 = 0)
SELECT e.c AS "case", round(count(f.item) FILTER (rank <= 5) / count(*), 6) AS recall FROM e LEFT JOIN f USING (c, item) GROUP BY 1""")
def recall_at_k(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    found = o.select(F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("item"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")).alias("rank"))
    return M.recall_at(found, o.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("item")), 5)
