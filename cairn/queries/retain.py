"""Queries over retention of candidates made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from cairn.operators import retain as RT
from cairn.registry import query
from cairn.scratch import keep
from cairn.sources.tables import read


def inputs(spark, sf_dir):
    """(state, sources, candidates): a source for each customer and a candidate for each order, against receipts and supports of some."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name")
    k, sid = F.col("c_custkey"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source_id")
    none = F.lit(None).cast("string")
    sources = c.select(sid, F.lit("r2").alias("revision"), F.col("c_name").alias("request"), none.alias("source_group"), F.when(k % 11 == 0, "r1").alias("retracts"), F.lit("2026-01-01").alias("at"))
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    n = F.col("o_orderkey")
    text = F.when(n % 9 == 0, " ").when(n % 10 == 3, F.concat(F.lit("Level: "), (n % 3).cast("string"))).otherwise(F.concat(F.lit("note "), (n % 4).cast("string"), F.lit("\n state "), "o_orderstatus"))
    prior = F.lag(F.concat(F.lit("o"), n.cast("string"))).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    candidates = o.withColumn("_p", prior).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_id"), F.lit("r2").alias("revision"), F.concat(F.lit("o"), n.cast("string")).alias("candidate"), n.alias("ord"),
        F.concat(F.lit("p/"), (F.col("o_custkey") % 50).cast("string")).alias("slug"), text.alias("text"), F.lit("state").alias("semantics"), F.lit("s").alias("subject"), F.when((n % 7 == 0) & F.col("_p").isNotNull(), F.array("_p")).alias("relations"),
    )
    old = c.filter((k % 22 == 0) | (k % 13 == 0)).withColumn("memory_id", F.concat(F.lit("old"), k.cast("string")))
    group = RT._hash(F.lit("proof"), F.concat(F.lit("c"), k.cast("string")))
    state = {
        "receipts": c.filter(k % 5 < 2).select(sid, F.lit("r2").alias("revision"), F.when(k % 5 == 0, F.col("c_name")).otherwise("other").alias("request"), F.lit("r").alias("receipt")),
        "memories": old.select("memory_id", F.concat(F.lit("old/"), k.cast("string")).alias("slug"), F.lit("Level: 9").alias("payload"), F.lit("state").alias("semantics")),
        "supports": old.select(sid, F.lit("r1").alias("revision"), F.lit("r").alias("receipt"), F.lit("k").alias("candidate"), group.alias("proof_group"), "memory_id", none.alias("retracted_by")),
    }
    return state, sources, candidates


def planned(spark, sf_dir):
    state, sources, candidates = inputs(spark, sf_dir)
    return state, RT.plan(state, sources, candidates, keep)


_PLAN = """s AS (SELECT c_custkey AS k, 'c' || c_custkey AS source_id, CASE c_custkey % 5 WHEN 0 THEN 'replay' WHEN 1 THEN 'conflict' ELSE 'accepted' END AS asked, c_custkey % 11 = 0 AS fixes, (c_custkey % 22 = 0 OR c_custkey % 143 = 0) AS found FROM customer),
c AS (SELECT s.*, o_orderkey AS n, 'p/' || (o_custkey % 50) AS slug, CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 10 = 3 THEN 'Level: ' || (o_orderkey % 3) ELSE 'note ' || (o_orderkey % 4) || ' state ' || o_orderstatus END AS payload,
  o_orderkey % 7 = 0 AND lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NOT NULL AS tied FROM orders JOIN s ON k = o_custkey WHERE asked = 'accepted'),
g AS (SELECT *, sum(CASE WHEN tied THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY n) AS chain FROM c),
a AS (SELECT *, sum(CASE WHEN payload = '' THEN 1 ELSE 0 END) OVER (PARTITION BY k, chain ORDER BY n) = 0 AS stays, payload LIKE 'Level%' AS lev FROM g),
f AS (SELECT slug, arg_min(payload, (source_id, n)) AS first FROM a WHERE stays AND lev GROUP BY 1),
x AS (SELECT a.*, stays AND lev AND payload <> first AS other FROM a LEFT JOIN f USING (slug)),
r AS (SELECT *, CASE WHEN stays AND NOT other THEN row_number() OVER (PARTITION BY slug, payload, stays AND NOT other ORDER BY source_id, n) END AS rank FROM x),
b AS (SELECT *, stays AND NOT coalesce(other, false) AND rank <= 8 AS fine FROM r),
e AS (SELECT *, sum(CASE WHEN fine THEN 0 ELSE 1 END) OVER (PARTITION BY k, chain ORDER BY n) = 0 AS kept FROM b),
w AS (SELECT slug, payload, min(rank) AS start FROM e WHERE kept GROUP BY 1, 2),
h AS (SELECT e.*, CASE WHEN kept THEN CASE WHEN rank = start THEN 'written' ELSE 'support_added' END ELSE 'held' END AS o1,
  CASE WHEN kept THEN NULL WHEN stays AND other THEN 'conflict' WHEN stays AND rank > 8 THEN 'support_limit' WHEN payload = '' THEN 'validation' ELSE 'relation' END AS r1 FROM e LEFT JOIN w USING (slug, payload)),
z AS (SELECT s.k, s.fixes AND (NOT s.found OR count(h.n) = 0 OR count(*) FILTER (h.o1 = 'held') > 0) AS failed FROM s LEFT JOIN h USING (k) WHERE s.asked = 'accepted' GROUP BY s.k, s.fixes, s.found),
j AS (SELECT h.*, failed, CASE WHEN failed THEN 'held' ELSE o1 END AS outcome, CASE WHEN failed AND o1 <> 'held' THEN 'correction' ELSE r1 END AS reason FROM h JOIN z USING (k))"""


@query("retain_results", f"WITH {_PLAN} SELECT source_id, 'o' || n AS candidate, outcome, reason FROM j")
def retain_results(spark, sf_dir):
    return RT.judge(*inputs(spark, sf_dir), keep)["results"].select("source_id", "candidate", "outcome", "reason")


@query("retain_state", f"""WITH {_PLAN}, m AS (SELECT slug, payload, count(*) AS n FROM j WHERE outcome <> 'held' GROUP BY 1, 2),
o AS (SELECT 'old/' || s.k AS slug, 'Level: 9' AS payload, CASE WHEN fixes AND NOT failed THEN 0 ELSE 1 END AS n FROM s LEFT JOIN z USING (k) WHERE s.k % 22 = 0 OR s.k % 13 = 0),
q AS (SELECT k, count(*) FILTER (outcome <> 'held') AS done, count(*) AS n FROM j GROUP BY 1)
SELECT 'supports' AS kind, slug AS a, payload AS b, n::BIGINT AS n FROM m UNION ALL SELECT 'supports', slug, payload, n::BIGINT FROM o
UNION ALL SELECT 'pending_correction', s.source_id, 'old' || k, 1 FROM s JOIN z USING (k) WHERE failed AND found
UNION ALL SELECT DISTINCT 'deciding', s.source_id, 'old' || s.k, 1 FROM s JOIN j ON s.k = j.k JOIN z ON z.k = s.k WHERE (s.k % 13 = 0 OR s.k % 22 = 0) AND j.outcome <> 'held' AND j.lev AND NOT (s.fixes AND NOT z.failed)
UNION ALL SELECT 'sources', source_id, CASE WHEN asked <> 'accepted' THEN asked WHEN failed THEN 'held' WHEN done > 0 THEN 'ok' WHEN n > 0 THEN 'held' ELSE 'noop' END, CASE WHEN asked = 'accepted' AND NOT coalesce(failed, false) AND (coalesce(done, 0) > 0 OR n IS NULL) THEN 1 ELSE 0 END FROM s LEFT JOIN z USING (k) LEFT JOIN q USING (k)""")
def retain_state(spark, sf_dir):
    """Memories with their active supports after retractions, holds, and sources with their outcome and whether they have a receipt."""
    state, new = planned(spark, sf_dir)
    memories = state["memories"].unionByName(new["memories"])
    supports = new["supports"].groupBy("memory_id").agg(F.count_if(F.col("retracted_by").isNull()).alias("n")).join(memories, "memory_id").select(F.lit("supports").alias("kind"), F.col("slug").alias("a"), F.col("payload").alias("b"), "n")
    holds = new["holds"].select("kind", F.col("source_id").alias("a"), F.col("earlier").alias("b"), F.lit(1).cast("long").alias("n"))
    made = new["receipts"].select("source_id", F.lit(1).cast("long").alias("_r"))
    asked = new["sources"].join(made, "source_id", "left").select(F.lit("sources").alias("kind"), F.col("source_id").alias("a"), F.col("outcome").alias("b"), F.coalesce("_r", F.lit(0)).cast("long").alias("n"))
    return supports.unionByName(holds).unionByName(asked)
