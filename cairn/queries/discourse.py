"""Queries over discourse scopes of pages that are made of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import prose as P
from cairn.registry import query
from cairn.sources.tables import read

#: Titles of the headings of derived pages with the view that each gives (null: none).
_TITLES = (("Plans", "planning"), ("Recorded details", None), ("Open questions", "questions"), ("Report 7 of the year", None), ("Assistant report", "reports"), ("Scenario", "discussion"), ("Sizes", None))


def order_pages(spark, sf_dir):
    """A Markdown page for each customer: its orders by key, every third one below a heading of its own, every fifth line in a list item."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    title = F.element_at(F.array(*(F.lit(t) for t, _ in _TITLES)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    head = F.concat(F.repeat(F.lit("#"), (F.col("o_orderkey") % 2 + 1).cast("int")), F.lit(" "), title, F.lit("\n"))
    bullet = F.when(F.col("o_orderkey") % 5 == 0, "- ").otherwise("")
    line = F.concat(F.when(F.col("o_orderkey") % 3 == 0, head).otherwise(""), bullet, F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" has state "), F.col("o_orderstatus"), F.lit("."))
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("t")))).alias("l"))
    return rows.select("o_custkey", F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("text"))


_VIEW = "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{v}'" for i, (_, v) in enumerate(_TITLES) if v) + " END"


@query("discourse_scopes", f"""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderkey % 3 = 0 AS head, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS depth, {_VIEW} AS view FROM orders),
e AS (SELECT b.o_custkey, b.o_orderkey AS pos, b.view, min(c.o_orderkey) AS upto FROM o b LEFT JOIN o c ON c.o_custkey = b.o_custkey AND c.head AND c.o_orderkey > b.o_orderkey AND c.depth <= b.depth WHERE b.head AND b.view IS NOT NULL GROUP BY 1, 2, 3),
h AS (SELECT a.o_custkey, a.o_orderkey, e.pos, e.view FROM o a JOIN e ON a.o_custkey = e.o_custkey AND a.o_orderkey >= e.pos AND (e.upto IS NULL OR a.o_orderkey < e.upto)),
v AS (SELECT o_custkey, o_orderkey, arg_max(view, pos) AS view FROM h GROUP BY 1, 2)
SELECT o.o_custkey, o.o_orderkey, coalesce(v.view, 'factual') AS view, CASE WHEN v.view IS NULL THEN 'asserted' ELSE 'heading_scope' END AS reason, v.view IS NULL OR v.view = 'planning' AS plans FROM o LEFT JOIN v USING (o_custkey, o_orderkey)""")
def discourse_scopes(spark, sf_dir):
    pages = order_pages(spark, sf_dir)
    lines = pages.select("o_custkey", F.posexplode(F.split("text", "\n")).alias("n", "t")).select("o_custkey", (F.col("n") + 1).alias("line"), F.regexp_extract("t", "Order (\\d+) has", 1).alias("k")).filter("k <> ''")
    found = P.discourse(pages, "o_custkey").filter("reason <> 'heading'")
    rows = found.join(lines, ["o_custkey", "line"])
    return rows.select("o_custkey", F.col("k").cast("long").alias("o_orderkey"), "view", "reason", P.answers(F.col("status"), F.col("view"), "planning").alias("plans"))
