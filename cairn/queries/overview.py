"""Queries over overviews, evidence budgets and conflicts by class."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import conflicts as C
from cairn.operators import overview as O
from cairn.queries.evidence import _FV, _NUM, fact_values
from cairn.registry import query
from cairn.sources.tables import read

_CLASS = f"WITH {_FV}, f AS (SELECT *, array_to_string({_NUM.format('value')}, ',') AS c FROM fv), g AS (SELECT * FROM f WHERE c <> '')"


@query("conflict_anchors", f"""{_CLASS}, s AS (SELECT DISTINCT subject, attribute, c, page FROM g),
d AS (SELECT g.* FROM g WHERE EXISTS (SELECT 1 FROM s WHERE s.subject = g.subject AND s.attribute = g.attribute AND s.c <> g.c AND s.page <> g.page))
SELECT subject, attribute, arg_min(id, (page, id)) AS anchor, count(*)::BIGINT AS claims, count(DISTINCT c)::BIGINT AS classes FROM d GROUP BY 1, 2""")
def conflict_anchors(spark, sf_dir):
    return C.anchors(fact_values(spark, sf_dir).withColumn("line", F.lit(1)))


@query("same_event_counts", """WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 4 = 0 THEN 'unresolved' ELSE 's' || (event_id % 3) END AS subject, CASE WHEN event_id % 5 > 0 THEN strftime(ts, '%Y-%m') END AS month FROM events)
SELECT a.event_id, (count(*) - 1)::BIGINT AS same FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.month IS NOT DISTINCT FROM b.month AND (a.subject = b.subject OR a.subject = 'unresolved' OR b.subject = 'unresolved') GROUP BY 1""")
def same_event_counts(spark, sf_dir):
    k = F.col("event_id")
    e = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts").select("event_id", "user_id", "event_type", F.when(k % 4 == 0, "unresolved").otherwise(F.concat(F.lit("s"), (k % 3).cast("string"))).alias("subject"), F.when(k % 5 > 0, F.date_format("ts", "yyyy-MM")).alias("month"))
    return C.same_event_counts(e, "event_id", ["user_id", "event_type", "month"])


_OV = """p AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Seg' ELSE 'seg' END || '/' || c_mktsegment || '/' || c_custkey AS slug, 't' || c_custkey % 3 AS type, CASE WHEN c_custkey % 10 = 0 THEN 'source' ELSE 'knowledge' END AS role FROM customer),
o AS (SELECT 'seg/n' || n_nationkey AS slug, 'seg/' || ['BUILDING', 'AUTOMOBILE', 'MACHINERY', '../x', 'none'][n_nationkey % 5 + 1] AS folder, ['t0', 't' || n_nationkey % 2] AS types, n_nationkey % 3 AS kind, n_nationkey FROM nation),
m AS (SELECT o.slug AS overview, p.slug, row_number() OVER (PARTITION BY o.slug ORDER BY lower(p.slug), p.slug) AS rank FROM o JOIN p ON starts_with(p.slug, o.folder || '/') AND list_contains(o.types, p.type) AND p.role = 'knowledge' WHERE kind > 0 AND folder <> 'seg/../x' AND n_nationkey % 2 = 1)"""


def _overviews(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    pages = c.select(F.concat(F.when(k % 2 == 0, "Seg").otherwise("seg"), F.lit("/"), "c_mktsegment", F.lit("/"), k.cast("string")).alias("slug"), F.concat(F.lit("t"), (k % 3).cast("string")).alias("type"), F.when(k % 10 == 0, "source").otherwise("knowledge").alias("role"))
    n = F.col("n_nationkey")
    folder = F.concat(F.lit("seg/"), F.element_at(F.array(*(F.lit(x) for x in ("BUILDING", "AUTOMOBILE", "MACHINERY", "../x", "none"))), (n % 5 + 1).cast("int")))
    types = F.array(F.lit("t0"), F.concat(F.lit("t"), (n % 2).cast("string")))
    overviews = read(spark, sf_dir, "nation", "n_nationkey").select(F.concat(F.lit("seg/n"), n.cast("string")).alias("slug"), F.when(n % 6 == 0, "overview").otherwise("note").alias("type"), (n % 3 > 0).alias("declared"), folder.alias("folder"), types.alias("types"), F.lit(None).cast("array<string>").alias("exclude"))
    return O.overview_members(overviews, pages)


@query("overview_members", f"WITH {_OV} SELECT overview, slug, rank::INT AS rank FROM m WHERE rank <= 30")
def overview_members(spark, sf_dir):
    return _overviews(spark, sf_dir)[0]


@query("overview_coverage", f"""WITH {_OV}, n AS (SELECT overview, max(rank) > 30 AS r FROM m GROUP BY 1)
SELECT slug AS overview, CASE WHEN kind = 0 THEN 'missing_scope' WHEN folder = 'seg/../x' OR n_nationkey % 2 = 0 THEN 'invalid_scope' WHEN coalesce(r, false) THEN 'partial' ELSE 'complete' END AS status, coalesce(r, false) AS limit_reached FROM o LEFT JOIN n ON overview = slug WHERE kind > 0 OR n_nationkey % 6 = 0""")
def overview_coverage(spark, sf_dir):
    return _overviews(spark, sf_dir)[1]


_EV = """s AS (SELECT c_nationkey AS subject, c_custkey AS source, 40 + c_custkey % 30 AS head, CASE WHEN c_custkey % 3 = 0 THEN 500 ELSE 0 END AS summary, row_number() OVER (PARTITION BY c_nationkey ORDER BY 'p' || c_custkey) AS i FROM customer),
e AS (SELECT o_custkey AS source, CASE WHEN o_orderstatus = 'F' THEN 'fact' ELSE 'event' END AS kind, o_orderkey AS ord, o_orderkey * 7 % 2300 AS len FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey * 7 % 2300 <= 2000),
k AS (SELECT source, kind, sum(len) OVER (PARTITION BY source, kind ORDER BY ord) AS run, row_number() OVER (PARTITION BY source, kind ORDER BY ord) AS n FROM e),
l AS (SELECT source, coalesce(list(run ORDER BY n) FILTER (kind = 'fact' AND n <= 50), []) AS fs, coalesce(list(run ORDER BY n) FILTER (kind = 'event' AND n <= 50), []) AS es FROM k GROUP BY 1),
p AS (SELECT s.*, coalesce(fs, []) AS fs, coalesce(es, []) AS es, coalesce(fs[-1], 0) AS fa FROM s LEFT JOIN l USING (source) WHERE i <= 30)"""


@query("evidence_budget", f"""WITH RECURSIVE {_EV},
r AS (SELECT c_nationkey AS subject, 0::BIGINT AS i, 36000::BIGINT AS rem, NULL::BIGINT AS source, false AS there, false AS summary, 0::BIGINT AS facts, 0::BIGINT AS events FROM customer GROUP BY 1
UNION ALL SELECT subject, i, CASE WHEN head <= rem THEN rem - 2 - head - (CASE WHEN su THEN p.summary ELSE 0 END) - (CASE WHEN nf > 0 THEN fs[nf] ELSE 0 END) - (CASE WHEN ne > 0 THEN es[ne] ELSE 0 END) ELSE rem END, source, head <= rem, su AND p.summary > 0, nf, ne FROM (
  SELECT p.*, r.rem, p.head + p.summary <= r.rem AS su,
    CASE WHEN p.head + p.summary <= r.rem THEN len(list_filter(p.fs, lambda x: p.head + p.summary + x <= r.rem)) ELSE 0 END AS nf,
    CASE WHEN p.head + p.summary + p.fa <= r.rem THEN len(list_filter(p.es, lambda x: p.head + p.summary + p.fa + x <= r.rem)) ELSE 0 END AS ne
  FROM r JOIN p ON p.subject = r.subject AND p.i = r.i + 1) p)
SELECT subject, source, summary, facts::INT AS facts, events::INT AS events FROM r WHERE there""")
def evidence_budget(spark, sf_dir):
    """Nations as subjects, their customers as source pages, orders as facts and events of some length."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    k, n = F.col("c_custkey"), F.col("o_orderkey")
    sources = c.select(F.col("c_nationkey").alias("subject"), k.alias("source"), F.concat(F.lit("p"), k.cast("string")).alias("slug"), (40 + k % 30).alias("head"), F.when(k % 3 == 0, 500).otherwise(0).alias("summary"))
    entries = o.join(c, F.col("o_custkey") == k).select(F.col("c_nationkey").alias("subject"), k.alias("source"), F.when(F.col("o_orderstatus") == "F", "fact").otherwise("event").alias("kind"), n.alias("ord"), (n * 7 % 2300).alias("length"), F.when(n % 17 == 0, "ineligible").alias("issue"))
    return O.select_evidence(sources, entries)[0]
