"""Queries over what has to be made again, for pages, facts, vectors and verdicts made of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import invalidation as I
from cairn.registry import query
from cairn.sources.tables import read

_OLD = [{"glob": "seg/**", "role": "knowledge"}, {"glob": "seg/BUILDING/**", "type": "house"}, {"glob": "seg/FURNITURE/*1", "role": "ignored"}]
_NEW = [{"glob": "seg/**", "role": "knowledge"}, {"glob": "seg/BUILDING/*7", "type": "home"}, {"glob": "seg/BUILDING/**", "type": "house"}, {"glob": "seg/MACHINERY/**", "role": "source"}]


@query("stale_pages", """WITH p AS (SELECT c_custkey AS k, 'seg/' || c_mktsegment || '/' || c_custkey AS path, c_mktsegment AS s FROM customer),
r AS (SELECT path, (s = 'BUILDING' AND k % 10 = 7) OR s = 'MACHINERY' OR (s = 'FURNITURE' AND k % 10 = 1) AS rules, k % 3 = 0 AND k % 4 < 2 AND k % 11 <> 0 AS memory, k % 2 = 0 AND k % 5 = 0 AND k % 11 <> 0 AS temporal FROM p)
SELECT path, concat_ws(',', CASE WHEN rules THEN 'rules' END, CASE WHEN memory THEN 'memory' END, CASE WHEN temporal THEN 'temporal' END) AS reasons FROM r WHERE rules OR memory OR temporal""")
def stale_pages(spark, sf_dir):
    """After three rules and two versions changed: pages of customers by segment, some without rows, some made with old versions."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    path = F.concat(F.lit("seg/"), "c_mktsegment", F.lit("/"), k.cast("string"))
    holds = F.array_compact(F.array(F.when(k % 3 == 0, "memory"), F.when(k % 2 == 0, "temporal")))
    made = F.create_map(F.lit("memory"), F.when(k % 4 < 2, "v1").otherwise("v2"), F.lit("temporal"), F.when(k % 5 == 0, F.lit(None)).otherwise("v3"))
    pages = I.policies(c.select(path.alias("path"), holds.alias("holds"), made.alias("made_with"), (k % 11 != 0).alias("indexed")), _OLD, "path", ("role", "type"))
    return I.stale_pages(pages, _NEW, {"memory": "v2", "temporal": "v3"}).withColumn("reasons", F.array_join("reasons", ","))


@query("follow_facts", """WITH a AS (SELECT l_orderkey AS page, l_linenumber AS line, CASE WHEN l_partkey % 3 = 0 THEN 'm' || l_linenumber END AS item, l_quantity::INT % 5 AS h FROM lineitem),
b AS (SELECT page, line + CASE WHEN page % 2 = 0 THEN 10 ELSE 0 END AS line, item, CASE WHEN line % 4 = 1 THEN h + 100 ELSE h END AS h FROM a WHERE (page + line) % 6 <> 0),
ka AS (SELECT page, line, h, coalesce('item:' || item, 'line:' || h || ':' || row_number() OVER (PARTITION BY page, item, h ORDER BY line)) AS key FROM a),
kb AS (SELECT page, line, h, coalesce('item:' || item, 'line:' || h || ':' || row_number() OVER (PARTITION BY page, item, h ORDER BY line)) AS key FROM b)
SELECT coalesce(ka.page, kb.page) AS page, coalesce(ka.key, kb.key) AS key, CASE WHEN kb.line IS NULL THEN 'gone' WHEN ka.line IS NULL THEN 'added' WHEN ka.h <> kb.h THEN 'edited' WHEN ka.line <> kb.line THEN 'moved' ELSE 'same' END AS change FROM ka FULL JOIN kb ON ka.page = kb.page AND ka.key = kb.key""")
def follow_facts(spark, sf_dir):
    """Line items as facts, a third of them with a marker; half of the pages get ten lines in front, some lines change and some go."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    h = F.col("l_quantity").cast("int") % 5
    old = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("m"), F.col("l_linenumber").cast("string"))).alias("item_id"), h.alias("h"))
    shift = F.when(F.col("page") % 2 == 0, 10).otherwise(0)
    new = old.filter((F.col("page") + F.col("line")) % 6 != 0).withColumn("h", F.when(F.col("line") % 4 == 1, F.col("h") + 100).otherwise(F.col("h"))).withColumn("line", F.col("line") + shift)
    hashed = lambda df: df.withColumn("line_hash", F.col("h").cast("string"))
    return I.follow_facts(hashed(old), hashed(new)).select("page", "key", "change")


@query("vectors_to_make", """WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 4 = 0 THEN 'old' ELSE 'now' END AS model, CASE WHEN vec_id % 7 = 0 THEN 32 ELSE 64 END AS n, CASE WHEN vec_id % 5 = 0 THEN 'was' ELSE 'is' END AS d FROM embeddings)
SELECT vec_id FROM v WHERE model <> 'now' OR n <> 64 OR d <> 'is' OR vec_id % 9 = 0""")
def vectors_to_make(spark, sf_dir):
    """Rows whose vectors are of another model, length or text, or are not there; each has an older vector, too, that no longer counts."""
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    k = F.col("vec_id")
    vectors = e.filter(k % 9 != 0).select("vec_id", F.when(k % 7 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"), F.when(k % 4 == 0, "old").otherwise("now").alias("model"), F.when(k % 5 == 0, "was").otherwise("is").alias("digest"), F.lit(2).alias("made_at"))
    earlier = e.filter(k % 9 != 0).select("vec_id", "embedding", F.lit("now").alias("model"), F.when(k % 5 == 0, "was").otherwise("old").alias("digest"), F.lit(1).alias("made_at"))
    return I.usable_vectors(e.select("vec_id", F.lit("is").alias("digest")), vectors.unionByName(earlier), "vec_id", "now", 64, "digest")[1].select("vec_id")


@query("cached_verdicts", """WITH c AS (SELECT p_partkey AS k, sha256(p_brand || p_type || p_size) AS f FROM part), u AS (SELECT DISTINCT sha256(p_brand || p_type || p_size) AS f, p_size AS s FROM part),
x AS (SELECT f, CASE s % 5 WHEN 0 THEN 'conflict' WHEN 1 THEN 'unverified' WHEN 2 THEN 'qualified' WHEN 3 THEN 'qualified' ELSE 'none' END AS verdict, CASE WHEN s % 5 = 2 THEN 'by year' END AS q, s % 6 <> 0 AS there FROM u)
SELECT k AS p_partkey, CASE WHEN there AND verdict <> 'unverified' AND (verdict <> 'qualified' OR q IS NOT NULL) THEN verdict END AS verdict FROM c JOIN x USING (f)""")
def cached_verdicts(spark, sf_dir):
    """Parts as candidates whose digest covers brand, type and size; the cache has a later verdict of another prompt for all."""
    p = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
    f = F.sha2(F.concat("p_brand", "p_type", F.col("p_size").cast("string")), 256)
    s = F.col("p_size") % 5
    known = p.select(f.alias("fingerprint"), "p_size").distinct()
    verdict = F.when(s == 0, "conflict").when(s == 1, "unverified").when(s < 4, "qualified").otherwise("none")
    row = lambda model, prompt, v, at: known.select("fingerprint", F.lit(model).alias("model"), F.lit(prompt).alias("prompt"), v.alias("verdict"), F.when(s == 2, "by year").alias("qualification"), F.lit(None).cast("string").alias("reason"), F.lit(at).alias("at"), "p_size")
    cache = row("m", "2", verdict, 2).unionByName(row("m", "2", F.lit("conflict"), 1)).filter("p_size % 6 <> 0").unionByName(row("m", "1", F.lit("conflict"), 9)).unionByName(row("n", "2", F.lit("conflict"), 9)).drop("p_size")
    return I.with_verdicts(p.select("p_partkey", f.alias("fingerprint")), cache, "m", "2").select("p_partkey", "verdict")
