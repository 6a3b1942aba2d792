"""Queries over patches and ledgers of pages that are made of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import changes as C
from cairn.registry import query
from cairn.sources.tables import read


def _order_lists(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))


def _line(k):
    return F.concat(F.lit("- Order "), k.cast("string"), F.lit(" is open"))


@query("patch_pages", """WITH p AS (SELECT o_custkey, list('- Order ' || o_orderkey || ' is open' ORDER BY o_orderkey) AS l, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY 1),
m AS (SELECT *, len(l) // 2 + 1 AS m, '- Order ' || k[len(l) // 2 + 1] || ' is paid' AS paid FROM p)
SELECT o_custkey, '# Orders' || chr(10) || array_to_string(CASE o_custkey % 4 WHEN 2 THEN l WHEN 3 THEN list_concat(['- First'], list_concat(l[:m - 1], list_concat([paid, '- Late'], l[m + 1:]))) ELSE list_concat(l[:m - 1], list_concat([paid], l[m + 1:])) END, chr(10)) || chr(10) AS text,
 CASE o_custkey % 4 WHEN 2 THEN NULL WHEN 3 THEN 2 ELSE m + 1 END::INT AS first_line, CASE WHEN o_custkey % 4 = 2 THEN '1: context does not match' END AS refused FROM m""")
def patch_pages(spark, sf_dir):
    """A page of orders for each customer and a patch of its middle line: with a right hint, a wrong one, a context that is not there, or a second hunk."""
    p = _order_lists(spark, sf_dir).withColumn("m", (F.floor(F.size("k") / 2) + 1).cast("int"))
    page = F.concat(F.lit("# Orders\n"), F.array_join(F.transform("k", _line), "\n"), F.lit("\n"))
    middle = F.element_at("k", F.col("m"))
    case = F.col("o_custkey") % 4
    old = F.when(case == 2, F.concat(_line(middle), F.lit("!"))).otherwise(_line(middle))
    hint = (F.col("m") + 1 + F.when(case == 1, 700).otherwise(0)).cast("string")
    hunk = F.concat(F.lit("@@ -"), hint, F.lit(",1 +"), hint, F.lit(",1 @@\n-"), old, F.lit("\n+- Order "), middle.cast("string"), F.lit(" is paid"))
    more = F.when(case == 3, F.concat(F.lit("\n+- Late\n@@ -2,0 +2,1 @@\n+- First"))).otherwise("")
    edits = p.select("o_custkey", F.lit(1).alias("nth"), F.lit("patch").alias("mode"), F.concat(F.lit("--- a\n+++ b\n"), hunk, more).alias("a"), F.lit(None).cast("string").alias("b"))
    return C.edit(p.select("o_custkey", page.alias("text")), edits, "o_custkey")


@query("ledger_insert", """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS d, o_orderkey % 2 = 1 AS fresh, '- **' || strftime(o_orderdate::DATE, '%Y-%m-%d') || '** | Order number ' || (o_orderkey + 1000) || ' placed [[orders/' || o_orderkey || ']]' AS l FROM orders),
y AS (SELECT o_custkey, year(d) AS y, string_agg(l, chr(10) ORDER BY d DESC, fresh, o_orderkey) AS t FROM o GROUP BY 1, 2)
SELECT o_custkey, '# Ledger' || string_agg(chr(10) || chr(10) || '## ' || y || chr(10) || t, '' ORDER BY y DESC) || chr(10) AS text FROM y GROUP BY 1""")
def ledger_insert(spark, sf_dir):
    """Half of each customer's orders stand in its ledger; the other half, and the first half again in other words, are added."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    date, key = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    number, slug = (key + 1000).cast("string"), F.concat(F.lit("orders/"), key.cast("string"))
    line = F.concat(F.lit("- **"), date, F.lit("** | Order number "), number, F.lit(" placed [["), slug, F.lit("]]"))
    old = o.filter(key % 2 == 0).groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.array_sort(F.collect_list(F.struct((-F.unix_date(F.to_date("o_orderdate"))).alias("d"), "o_orderkey", line.alias("l")))).alias("r"))
    block = F.concat(F.lit("\n\n## "), F.col("y").cast("string"), F.lit("\n"), F.array_join(F.transform("r", lambda x: x["l"]), "\n"))
    old = old.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("y"), block.alias("b")))).alias("b"))
    pages = o.select("o_custkey").distinct().join(old, "o_custkey", "left")
    pages = pages.select("o_custkey", F.concat(F.lit("# Ledger"), F.coalesce(F.array_join(F.transform("b", lambda x: x["b"]), ""), F.lit("")), F.lit("\n")).alias("text"))
    summary = F.when(key % 2 == 0, F.concat(F.lit("The user placed\n order  number "), number)).otherwise(F.concat(F.lit("Order  number "), number, F.lit(" placed ")))
    events = o.select("o_custkey", key.alias("nth"), date.alias("date"), summary.alias("summary"), slug.alias("slug"))
    return C.add_events(pages, events, "o_custkey").select("o_custkey", "text")
