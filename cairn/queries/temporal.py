"""Temporal queries over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import temporal as T
from cairn.registry import query
from cairn.sources.tables import read

AS_OF = "2024-01-15 12:00:00"

#: orders as temporal entries: precision, relation, disposition and bounds follow from the key
_TE = """te AS (SELECT o_orderkey AS id, 'memory' AS type, CASE o_orderkey % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' ELSE 'unknown' END AS precision,
 CASE o_orderkey % 5 WHEN 0 THEN 'occurred' WHEN 1 THEN 'scheduled' WHEN 2 THEN 'due' ELSE 'valid' END AS relation, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'accepted' END AS disposition,
 CASE WHEN o_orderkey % 3 = 0 THEN 'actual' ELSE 'planned' END AS temporal_status,
 CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE left(strftime(o_orderdate, '%Y-%m-%d'), CASE o_orderkey % 4 WHEN 1 THEN 7 WHEN 2 THEN 4 ELSE 10 END) END AS start,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE left(strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d'), CASE o_orderkey % 4 WHEN 1 THEN 7 WHEN 2 THEN 4 ELSE 10 END) END AS until FROM orders)"""
_PT = """pt AS (SELECT *, coalesce(start, CASE WHEN relation <> 'valid' THEN until END) AS s, coalesce(until, CASE WHEN relation <> 'valid' THEN start END) AS u,
 precision = 'unknown' OR (start IS NULL AND until IS NULL) AS undated FROM te),
bd AS (SELECT *, CASE length(s) WHEN 4 THEN s || '-01-01' WHEN 7 THEN s || '-01' ELSE s END AS lo, CASE length(u) WHEN 4 THEN u || '-12-31' WHEN 7 THEN strftime(last_day((u || '-01')::DATE), '%Y-%m-%d') ELSE u END AS hi FROM pt)"""


def entries(spark, sf_dir, clock: str | None = None):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    k = F.col("o_orderkey")
    precision = F.element_at(F.array(*(F.lit(p) for p in ("day", "month", "year", "unknown"))), (k % 4 + 1).cast("int"))
    relation = F.when(k % 5 == 0, "occurred").when(k % 5 == 1, "scheduled").when(k % 5 == 2, "due").otherwise("valid")
    disposition = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "active").otherwise("accepted")
    at = lambda d: F.when(k % 4 == 1, F.date_format(d, "yyyy-MM")).when(k % 4 == 2, F.date_format(d, "yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    later = F.col("o_orderdate") + F.expr("INTERVAL 40 DAY")
    return o.select(k.alias("id"), F.lit("memory").alias("type"), precision.alias("precision"), relation.alias("relation"), disposition.alias("disposition"), F.when(k % 3 == 0, "actual").otherwise("planned").alias("temporal_status"), F.when(k % 9 != 0, at(F.col("o_orderdate"))).alias("start"), F.when(k % 6 != 0, at(later)).alias("until"), F.lit(None).cast("string").alias("timezone"))


_CLOCK = "1996-06-15 12:00:00"
_NOW = "CASE precision WHEN 'year' THEN '1996' WHEN 'month' THEN '1996-06' ELSE '1996-06-15' END"
_REL = f"""CASE WHEN undated THEN 'undated' WHEN relation = 'due' AND disposition IN ('active', 'accepted') AND u < {_NOW} THEN 'overdue' WHEN s > {_NOW} THEN 'future' WHEN u < {_NOW} THEN 'past'
 WHEN precision IN ('month', 'year') THEN 'current_period' WHEN s = u THEN 'today' ELSE 'ongoing' END"""


@query("clock_classify", f"WITH {_TE}, {_PT} SELECT id, {_REL} AS clock_relation, CASE relation WHEN 'occurred' THEN 'event' WHEN 'valid' THEN 'state' WHEN 'due' THEN 'deadline' ELSE 'plan' END AS source_kind, coalesce(NOT undated AND temporal_status <> 'tentative' AND disposition IN ('active', 'accepted') AND relation IN ('scheduled', 'due'), false) AS actionable FROM bd")
def clock_classify(spark, sf_dir):
    e = entries(spark, sf_dir)
    return e.select("id", T.classify(F.lit(_CLOCK).cast("timestamp")).alias("clock_relation"), T.source_kind(F.col("relation")).alias("source_kind"), T.actionable().alias("actionable"))


@query("interval_overlap", f"WITH {_TE}, {_PT} SELECT id FROM bd WHERE NOT undated AND (hi IS NULL OR hi >= '1995-03-01') AND (lo IS NULL OR lo <= '1995-12-31')")
def interval_overlap(spark, sf_dir):
    return entries(spark, sf_dir).filter(T.overlaps("1995-03", "1995")).select("id")


@query("nearest_sort", f"""WITH {_TE}, {_PT}, d AS (SELECT id, type, CASE WHEN precision <> 'unknown' THEN greatest(coalesce(greatest(epoch(lo::TIMESTAMP) - epoch(TIMESTAMP '{_CLOCK}'), 0), 0), coalesce(greatest(epoch(TIMESTAMP '{_CLOCK}') - epoch(hi::TIMESTAMP) - 86399, 0), 0)) END AS dist FROM bd)
SELECT id, dist::BIGINT AS distance FROM d ORDER BY dist NULLS LAST, type, id LIMIT 100""")
def nearest_sort(spark, sf_dir):
    at = F.lit(_CLOCK).cast("timestamp")
    return entries(spark, sf_dir).orderBy(*T.sort_key("nearest", at)).limit(100).select("id", T.distance(at).cast("long").alias("distance"))


@query("bound_issues", f"""WITH {_TE}, {_PT} SELECT id, CASE WHEN s > u THEN 'reversed' WHEN relation = 'occurred' AND temporal_status <> 'actual' THEN 'status' WHEN relation IN ('scheduled', 'due') AND temporal_status = 'actual' THEN 'status' END AS issue FROM bd
WHERE s > u OR (relation = 'occurred' AND temporal_status <> 'actual') OR (relation IN ('scheduled', 'due') AND temporal_status = 'actual')""")
def bound_issues(spark, sf_dir):
    return T.bound_issues(entries(spark, sf_dir))


@query("recurrence_expand", """WITH s AS (SELECT o_orderkey AS id, o_orderdate::DATE AS d0, CASE o_orderkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END AS frequency, 1 + o_orderkey % 4 AS every FROM orders),
n AS (SELECT *, unnest(range(0, 1 + greatest(-1, date_diff('day', d0, DATE '1998-08-31')))) AS k FROM s WHERE frequency <> 'monthly' AND d0 <= DATE '1998-08-31'),
m AS (SELECT *, unnest(range(0, 2 + date_diff('month', d0, DATE '1998-08-31'))) AS k FROM s WHERE frequency = 'monthly' AND d0 <= DATE '1998-08-31'),
o AS (SELECT id, (d0 + k::INT)::DATE AS occurrence FROM n WHERE k % CASE frequency WHEN 'daily' THEN every ELSE every * 7 END = 0
 UNION ALL SELECT id, (d0 + to_months(k::INT))::DATE FROM m WHERE k % every = 0 AND day((d0 + to_months(k::INT))::DATE) = day(d0)),
f AS (SELECT * FROM o WHERE occurrence <= DATE '1998-08-31'), i AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY occurrence) - 1)::INT AS idx FROM f)
SELECT id, occurrence::VARCHAR AS occurrence, idx AS "index" FROM i WHERE occurrence >= DATE '1998-08-25' ORDER BY occurrence, id LIMIT 50000""")
def recurrence_expand(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    series = o.select(k.alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"), F.when(k % 3 == 0, "daily").when(k % 3 == 1, "weekly").otherwise("monthly").alias("frequency"), (1 + k % 4).cast("int").alias("interval"), F.lit(None).cast("array<string>").alias("weekdays"), F.lit(None).cast("string").alias("series_until"))
    return T.expand(series, "1998-08-25", "1998-08-31").select("id", F.col("occurrence").cast("string").alias("occurrence"), "index")


_UN = """ev AS (SELECT 'event' AS type, event_id AS id, strftime(ts, '%Y-%m-%d') AS day, event_type AS summary FROM events),
om AS (SELECT 'memory' AS type, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS summary FROM orders), un AS (SELECT * FROM ev UNION ALL SELECT * FROM om)"""


def timeline(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "ts", "event_type").select(F.lit("event").alias("type"), F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("summary"))
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderpriority").select(F.lit("memory").alias("type"), F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("summary"))
    return T.union_timeline(e, o)


@query("timeline_union", f"WITH {_UN} SELECT type, id, day, summary FROM un WHERE day BETWEEN '1995-01-01' AND '2024-01-10'")
def timeline_union(spark, sf_dir):
    return timeline(spark, sf_dir).filter(F.col("day").between("1995-01-01", "2024-01-10"))


@query("timeline_facets", f"WITH {_UN} SELECT 'type' AS dimension, type AS value, count(*)::BIGINT AS n FROM un GROUP BY ALL UNION ALL SELECT 'summary', summary, count(*)::BIGINT FROM un GROUP BY ALL UNION ALL SELECT 'year', day[:4], count(*)::BIGINT FROM un GROUP BY ALL")
def timeline_facets(spark, sf_dir):
    return T.facets(timeline(spark, sf_dir).withColumn("year", F.left("day", F.lit(4))), ["type", "summary", "year"])


@query("event_dedupe", "SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, strftime(ts, '%Y-%m-%d') ORDER BY value DESC, event_id) = 1")
def event_dedupe(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts", "value").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return T.dedupe_events(e, ["user_id", "event_type", "day"], [F.col("value").desc(), F.col("event_id")]).select("event_id", "user_id", "event_type", "day")


@query("document_dates", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE o_orderkey % 4 WHEN 3 THEN 0 ELSE 1 END::INT AS n FROM orders""")
def document_dates(spark, sf_dir):
    """Dates written into prose in three styles, and one impossible day."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("Signed on "), F.date_format(d, "yyyy-MM-dd"), F.lit("."))).when(k % 4 == 1, F.concat(F.lit("On "), F.date_format(d, "d MMMM yyyy"), F.lit(" it was sent"))).when(k % 4 == 2, F.concat(F.lit("Due "), F.date_format(d, "MMMM d, yyyy"), F.lit("!"))).otherwise(F.lit("Not a day: 2023-02-30, 31 April 1999"))
    got = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", T.dates_in(text).alias("d"))
    return got.select("o_orderkey", F.get("d", F.lit(0)).cast("string").alias("day"), F.size("d").alias("n"))


@query("clock_zones", "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS tokyo_day, strftime(ts + INTERVAL 9 HOUR, '%Y-%m') AS tokyo_month FROM events")
def clock_zones(spark, sf_dir):
    zone = F.lit("Asia/Tokyo")
    return read(spark, sf_dir, "events", "event_id", "ts").select("event_id", T.local(F.col("ts"), zone, F.lit("day")).alias("tokyo_day"), T.local(F.col("ts"), zone, F.lit("month")).alias("tokyo_month"))


@query("owning_timeline", """WITH s AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS slug FROM pages), t AS (SELECT DISTINCT split_part(slug, '/', 1) AS folder FROM s UNION SELECT DISTINCT split_part(slug, '/', 1) || '/en' FROM s)
SELECT slug, arg_max(folder, length(folder)) AS timeline FROM s JOIN t ON slug = folder OR starts_with(slug, folder || '/') GROUP BY 1""")
def owning_timeline(spark, sf_dir):
    s = read(spark, sf_dir, "pages", "url").select(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("slug")).distinct()
    host = s.select(F.split_part("slug", F.lit("/"), F.lit(1)).alias("folder")).distinct()
    t = host.unionByName(host.select(F.concat("folder", F.lit("/en")).alias("folder"))).withColumn("timeline", F.col("folder"))
    return T.owning_timeline(s, t)
