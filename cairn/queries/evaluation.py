"""Evaluation queries over labels, events and derived rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import metrics as E
from cairn.registry import query
from cairn.sources.tables import read

_RUN = "run AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, (o_orderkey * 7 % 4)::BIGINT AS grade FROM orders)"


def runs(spark, sf_dir):
    from pyspark.sql import Window

    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return o.select(F.col("o_custkey").alias("case"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"), (F.col("o_orderkey") * 7 % 4).alias("grade"))


@query("ndcg_mrr", f"""WITH {_RUN}, i AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY grade DESC, rank) AS ir, min(grade) OVER (PARTITION BY c ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM run),
g AS (SELECT c, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ir <= 10 THEN (pow(2, grade) - 1) / log2(ir + 1) ELSE 0 END) AS idcg, min(CASE WHEN grade = 3 AND rank <= 10 THEN rank END) AS f,
 count_if(rank <= 5 AND grade >= 2) AS g5, count_if(rank <= 10 AND low < grade) AS inv FROM i GROUP BY 1)
SELECT c AS "case", CASE WHEN idcg > 0 THEN round(dcg / idcg, 6) ELSE 0 END AS ndcg, coalesce(round(1.0::DOUBLE / f, 6), 0) AS mrr, coalesce((f <= 1)::INT, 0) AS success1, coalesce((f <= 3)::INT, 0) AS success3, round(g5 / 5.0::DOUBLE, 6) AS precision5, coalesce(inv, 0)::BIGINT AS inversions FROM g""")
def ndcg_mrr(spark, sf_dir):
    return E.ranking(runs(spark, sf_dir))


@query("qualification_rates", "SELECT lang, round(count_if(quality = 1 AND toxic = 0) / nullif(count_if(quality = 1), 0), 6) AS retention, round(count_if(quality = 0 AND toxic = 1) / nullif(count_if(quality = 0), 0), 6) AS rejection, count(*)::BIGINT AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def qualification_rates(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents", "doc_id", "lang"), "doc_id")
    return E.qualification(rows.select("lang", (F.col("quality") == 1).alias("r"), (F.col("toxic") == 0).alias("k")), "r", "k", ["lang"])


@query("top3_overlap", """WITH x AS (SELECT l_orderkey AS c, r AS run, l_partkey AS item, row_number() OVER (PARTITION BY l_orderkey, r ORDER BY (l_partkey * (r + 3)) % 101, l_linenumber, l_partkey) AS rank FROM lineitem, (VALUES (0), (1), (2)) v(r)),
t AS (SELECT c, run, list_distinct(list(item)) AS s FROM x WHERE rank <= 3 GROUP BY 1, 2), p AS (SELECT a.c, len(list_intersect(a.s, b.s)) / 3 AS o FROM t a JOIN t b ON a.c = b.c AND a.run < b.run) SELECT c AS "case", round(median(o), 6) AS overlap FROM p GROUP BY 1""")
def top3_overlap(spark, sf_dir):
    from pyspark.sql import Window

    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber").withColumn("run", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    order = Window.partitionBy("l_orderkey", "run").orderBy(F.col("l_partkey") * (F.col("run") + 3) % 101, "l_linenumber", "l_partkey")
    x = li.select(F.col("l_orderkey").alias("case"), "run", F.col("l_partkey").alias("item"), F.row_number().over(order).alias("rank"))
    return E.top_overlap(x, "case", "run", "item")


@query("threshold_sweep", """WITH p AS (SELECT n_chars / 20000.0 AS s, quality = 1 AS e FROM documents JOIN labels USING (doc_id)), t(threshold) AS (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.4::DOUBLE)),
g AS (SELECT threshold, count_if(s >= threshold AND e) AS tp, count_if(s >= threshold AND NOT e) AS fp, count_if(e) AS p FROM p, t GROUP BY 1) SELECT threshold, round(tp / nullif(p, 0), 6) AS recall, round(tp / nullif(tp + fp, 0), 6) AS precision, fp::BIGINT AS false_positives FROM g""")
def threshold_sweep(spark, sf_dir):
    p = read(spark, sf_dir, "documents", "doc_id", "n_chars").join(read(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id")
    return E.threshold_sweep(p.select((F.col("n_chars") / 20000.0).alias("s"), (F.col("quality") == 1).alias("e")), "s", "e", [0.05, 0.1, 0.2, 0.4])


@query("run_stability", "SELECT user_id AS \"case\", count(DISTINCT event_type) = 1 AS stable FROM events GROUP BY 1")
def run_stability(spark, sf_dir):
    return E.stability(read(spark, sf_dir, "events", "user_id", "event_type").withColumnRenamed("user_id", "case"), "case", "event_type")


@query("latency_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*)::BIGINT AS n FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return E.percentiles(read(spark, sf_dir, "events", "event_type", "value"), "value", ["event_type"])


@query("reranker_calibration", """WITH s AS (SELECT n_chars / 1000.0 AS s, quality = 1 AND toxic = 0 AND n_chars > 600 AS p FROM documents JOIN labels USING (doc_id)), l AS (SELECT min(s) FILTER (p) AS low FROM s),
g AS (SELECT any_value(low) AS low, max(s) FILTER (NOT p AND s < low) AS high, count_if(NOT p AND s >= low) AS fp, count_if(NOT p) AS neg FROM s, l) SELECT CASE WHEN fp * 2 <= neg THEN round((low + high) / 2, 6) END AS boundary FROM g""")
def reranker_calibration(spark, sf_dir):
    s = read(spark, sf_dir, "documents", "doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return E.calibration(s.select((F.col("n_chars") / 1000.0).alias("s"), ((F.col("quality") == 1) & (F.col("toxic") == 0) & (F.col("n_chars") > 600)).alias("p")), "s", "p")


@query("event_props", "SELECT (props ->> '$.k')::BIGINT AS k, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def event_props(spark, sf_dir):
    e = read(spark, sf_dir, "events", "props", "value")
    return e.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
