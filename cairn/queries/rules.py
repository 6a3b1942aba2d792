"""Queries over views, wording, guards, ownership and markers built from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import evidence as E
from cairn.operators import graph as G
from cairn.operators import maintenance as M
from cairn.operators import memory as ME
from cairn.operators import prose as P
from cairn.operators import retrieval as R
from cairn.operators import temporal as T
from cairn.operators.filters import edge_eligible
from cairn.queries.evidence import _MEM, memories
from cairn.queries.temporal import _CLOCK, _PT, _REL, _TE, entries
from cairn.registry import query
from cairn.sources.tables import read

_ASKED = (" What is next?", " It was said today.", " They rejected it previously.", "", " Сделать план на следующий год", " by next  week")


def _asked(k):
    return F.element_at(F.array(*(F.lit(a) for a in _ASKED)), (k % len(_ASKED) + 1).cast("int"))


_ASK = "text || CASE turn % 6 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_ASKED)) + " END"


@query("query_intents", "WITH q AS (SELECT conv_id, turn, lower(" + _ASK + ") AS q FROM conversations) SELECT conv_id, turn, " + ", ".join(f"regexp_matches(q, '{p}') AS {n}" for n, p in X.INTENTS.items()) + f", regexp_matches(q, '{X.DEICTIC}') AS deictic FROM q")
def query_intents(spark, sf_dir):
    q = read(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("q", F.concat("text", _asked(F.col("turn"))))
    return q.select("conv_id", "turn", X.query_intent(F.col("q")).alias("i"), X.deictic_time(F.col("q")).alias("deictic")).select("conv_id", "turn", "i.*", "deictic")


@query("quote_windows", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS s, greatest(len(string_split(left(text, length(text) // 2), chr(10))) - 2, 0) AS f FROM documents)
SELECT doc_id, array_to_string(list_filter(s[f + 1 : f + 3], lambda t: regexp_matches(t, '\\S')), chr(10)) AS quote FROM l""")
def quote_windows(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", X.quote_window(F.col("text"), F.floor(F.length("text") / 2).cast("int"), 3).alias("quote"))


@query("card_lines", f"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda t: regexp_matches(t, '\\S') AND NOT regexp_matches(t, '{P.BARE_LINE}') AND NOT regexp_matches(t, '{P.EMBED_LINE}')))::INT AS kept FROM documents""")
def card_lines(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.size(F.filter(F.split("text", "\n"), P.card_line)).alias("kept"))


_LINE = """l AS (SELECT l_orderkey, l_linenumber, l_suppkey % 2 = 0 AS has_memory, CASE WHEN l_partkey % 11 = 0 THEN 'pending_correction' END AS hold, CASE WHEN l_partkey % 3 = 0 THEN 'qualified' ELSE 'issue' END AS status,
 l_quantity > 25 AS memory_eligible, CASE l_suppkey % 7 WHEN 1 THEN 'heading' WHEN 3 THEN 'claim' WHEN 5 THEN 'comment' END AS prose_reason, l_discount > 0.05 AS prose_eligible FROM lineitem)"""


def _picked(selection):
    on = "{}" if selection == "eligible" else "NOT {}"
    return f"""CASE WHEN has_memory THEN CASE WHEN hold IS NOT NULL THEN true WHEN status <> 'qualified' THEN {str(selection == 'contextual').lower()} ELSE {on.format('memory_eligible')} END
 WHEN prose_reason IS NOT NULL THEN CASE WHEN prose_reason IN ('heading', 'comment') THEN false ELSE {on.format('prose_eligible')} END ELSE {str(selection == 'eligible').lower()} END"""


@query("line_selection", f"WITH {_LINE} SELECT l_orderkey, l_linenumber, {_picked('eligible')} AS eligible, {_picked('contextual')} AS contextual FROM l")
def line_selection(spark, sf_dir):
    k, p = F.col("l_suppkey"), F.col("l_partkey")
    line = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_discount")
    line = line.select("l_orderkey", "l_linenumber", (k % 2 == 0).alias("has_memory"), F.when(p % 11 == 0, "pending_correction").alias("hold"), F.when(p % 3 == 0, "qualified").otherwise("issue").alias("status"), (F.col("l_quantity") > 25).alias("memory_eligible"), F.when(k % 7 == 1, "heading").when(k % 7 == 3, "claim").when(k % 7 == 5, "comment").alias("prose_reason"), (F.col("l_discount") > 0.05).alias("prose_eligible"))
    return line.select("l_orderkey", "l_linenumber", *(P.line_selected(s, "factual").alias(s) for s in ("eligible", "contextual")))


@query("prose_chunks", """WITH c AS (SELECT DISTINCT l_orderkey AS page, (l_linenumber - 1) // 3 AS part FROM lineitem), e AS (SELECT l_orderkey AS page, l_linenumber AS line, CASE l_returnflag WHEN 'A' THEN 'factual' WHEN 'R' THEN 'planning' ELSE 'reports' END AS view, l_quantity > 30 AS eligible FROM lineitem)
SELECT c.page, c.part::INT AS part, bool_or(eligible AND view IN ('factual', 'planning')) AS eligible FROM c JOIN e ON c.page = e.page AND e.line BETWEEN c.part * 3 + 1 AND c.part * 3 + 3 GROUP BY 1, 2""")
def prose_chunks(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    part = F.floor((F.col("l_linenumber") - 1) / 3).cast("int")
    c = li.select(F.col("l_orderkey").alias("page"), part.alias("part")).distinct()
    c = c.select(F.struct("page", "part").alias("id"), "page", (F.col("part") * 3 + 1).alias("start"), (F.col("part") * 3 + 3).alias("end"))
    e = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "A", "factual").when(F.col("l_returnflag") == "R", "planning").otherwise("reports").alias("view"), (F.col("l_quantity") > 30).alias("eligible"))
    return P.prose_chunks(c, e, "planning").select("id.*", "eligible")


_EDGE_VIEWS = {
    "factual": "answer_eligible",
    "reports": "basis = 'source_report'",
    "questions": "kind = 'question'",
    "planning": "(kind = 'plan' OR temporal_status IN ('planned', 'scheduled')) AND disposition IN ('active', 'proposed', 'accepted')",
    "history": "disposition IN ('rejected', 'cancelled', 'completed', 'superseded', 'resolved') OR (kind = 'decision' AND disposition = 'accepted')",
    "discussion": "commitment IN ('tentative', 'hypothetical', 'counterfactual') OR disposition IN ('proposed', 'rejected')",
}


@query("edge_views", f"WITH {_MEM}, e AS (SELECT *, CASE WHEN memory_id % 13 > 0 THEN memory_id END AS source_memory FROM mem) SELECT page_id, line, " + ", ".join(f"source_memory IS NULL OR ({c}) AS {v}, source_memory IS NULL OR ({c}) OR answer_eligible AS {v}_and_history" for v, c in _EDGE_VIEWS.items()) + " FROM e")
def edge_views(spark, sf_dir):
    """Edges that memories assert, by the view they may be walked in."""
    e = memories(spark, sf_dir).withColumn("source_memory", F.when(F.col("memory_id") % 13 > 0, F.col("memory_id")))
    return e.select("page_id", "line", *(edge_eligible(v, h).alias(v + "_and_history" * h) for v in _EDGE_VIEWS for h in (False, True)))


_TYPES = ("Person", "Company", " city ", "Gadget", "device", "TOPIC", "Organisation", "Event.")
_KINDS = ("person", "organization", "place", "other", "product", "concept", "organization", "event")


@query("entity_types", "SELECT p_partkey, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END AS entity_type FROM part")
def entity_types(spark, sf_dir):
    value = F.element_at(F.array(*(F.lit(t) for t in _TYPES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return read(spark, sf_dir, "part", "p_partkey").select("p_partkey", G.entity_type(value).alias("entity_type"))


@query("hydrate_nodes", """WITH n AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'supplier' ELSE 'other' END AS kind, o_custkey % 40 AS source_id FROM orders)
SELECT id, kind, CASE kind WHEN 'customer' THEN c_name WHEN 'supplier' THEN s_name END AS label FROM n LEFT JOIN customer ON kind = 'customer' AND c_custkey = source_id LEFT JOIN supplier ON kind = 'supplier' AND s_suppkey = source_id""")
def hydrate_nodes(spark, sf_dir):
    k = F.col("o_orderkey")
    n = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(k.alias("id"), F.when(k % 3 == 0, "customer").when(k % 3 == 1, "supplier").otherwise("other").alias("kind"), (F.col("o_custkey") % 40).alias("source_id"))
    tables = {"customer": read(spark, sf_dir, "customer", "c_custkey", "c_name").withColumnRenamed("c_custkey", "source_id"), "supplier": read(spark, sf_dir, "supplier", "s_suppkey", "s_name").withColumnRenamed("s_suppkey", "source_id")}
    return G.hydrate(n, tables).select("id", "kind", F.coalesce("customer.c_name", "supplier.s_name").alias("label"))


@query("current_rows", f"""WITH {_TE}, {_PT}, k AS (SELECT *, {_REL} AS now FROM bd)
SELECT id, coalesce(temporal_status = 'actual' AND CASE WHEN relation = 'valid' THEN disposition IN ('active', 'accepted') AND now IN ('today', 'current_period', 'ongoing') ELSE relation = 'occurred' AND now IN ('today', 'ongoing') END, false) AS holds FROM k""")
def current_rows(spark, sf_dir):
    return entries(spark, sf_dir).select("id", T.current_eligible(F.lit(_CLOCK).cast("timestamp")).alias("holds"))


@query("unindexed_files", "SELECT doc_id FROM documents WHERE lang = 'en' AND NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def unindexed_files(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "lang").withColumnRenamed("lang", "kind")
    return E.unindexed(d, read(spark, sf_dir, "labels", "doc_id"), "doc_id", "en")


@query("relation_targets", "SELECT l_orderkey AS memory_id, l_returnflag AS relation, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS targets FROM lineitem JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 GROUP BY 1, 2")
def relation_targets(spark, sf_dir):
    r = read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_suppkey").select(F.col("l_orderkey").alias("memory_id"), F.col("l_returnflag").alias("relation"), F.col("l_suppkey").cast("string").alias("target"))
    m = read(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("memory_id"))
    return E.relation_targets(r, m).select("memory_id", "relation", F.array_join("targets", ",").alias("targets"))


@query("same_events", """WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 4 = 0 THEN 'unresolved' ELSE 's' || (event_id % 3) END AS subject, CASE WHEN event_id % 5 > 0 THEN strftime(ts, '%Y-%m') END AS month FROM events)
SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type = b.event_type AND a.month IS NOT DISTINCT FROM b.month AND (a.subject = b.subject OR a.subject = 'unresolved' OR b.subject = 'unresolved')""")
def same_events(spark, sf_dir):
    """Pairs of a user's events, a group of a bounded size, that one envelope describes."""
    k = F.col("event_id")
    e = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts").select("user_id", F.struct(k, "event_type", F.when(k % 4 == 0, "unresolved").otherwise(F.concat(F.lit("s"), (k % 3).cast("string"))).alias("subject"), F.when(k % 5 > 0, F.date_format("ts", "yyyy-MM")).alias("month")).alias("x"))
    pairs = e.join(e.withColumnRenamed("x", "y"), "user_id").filter((F.col("x.event_id") < F.col("y.event_id")) & E.same_envelope("x", "y", ["event_type", "month"]))
    return pairs.select(F.col("x.event_id").alias("a"), F.col("y.event_id").alias("b"))


@query("attachment_owners", """SELECT 'd/' || CASE doc_id % 4 WHEN 0 THEN 'p' || (doc_id // 4) || '-' || left(md5(doc_id::VARCHAR), 8) || '.pdf' WHEN 1 THEN 'p' || (doc_id // 4) || '.jpg' WHEN 2 THEN 'x' || doc_id || '.png' ELSE 'y' || doc_id || '.png' END AS path,
 CASE WHEN doc_id % 4 < 2 AND doc_id // 4 IN (SELECT page_id FROM pages) THEN doc_id // 4 WHEN doc_id % 4 = 2 AND doc_id IN (SELECT page_id * 2 FROM pages) THEN doc_id // 2 END AS page FROM documents""")
def attachment_owners(spark, sf_dir):
    k = F.col("doc_id")
    owner = F.floor(k / 4).cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("p"), owner, F.lit("-"), F.left(F.md5(k.cast("string")), F.lit(8)), F.lit(".pdf"))).when(k % 4 == 1, F.concat(F.lit("p"), owner, F.lit(".jpg"))).when(k % 4 == 2, F.concat(F.lit("x"), k.cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("y"), k.cast("string"), F.lit(".png")))
    files = read(spark, sf_dir, "documents", "doc_id").select(F.concat(F.lit("d/"), name).alias("path"))
    p = read(spark, sf_dir, "pages", "page_id").select(F.col("page_id").alias("page"), F.concat(F.lit("d/p"), F.col("page_id").cast("string")).alias("slug"))
    embeds = p.select("page", F.lit("d").alias("folder"), F.concat(F.lit("x"), (F.col("page") * 2).cast("string"), F.lit(".png")).alias("target"))
    # y1.png is embedded in another folder, which gives it to nobody
    other = p.select("page", F.lit("e").alias("folder"), F.concat(F.lit("y"), F.col("page").cast("string"), F.lit(".png")).alias("target"))
    return E.owners(files, p, embeds.unionByName(other))


@query("journal_events", "SELECT l_orderkey AS seq, l_linenumber AS ord FROM lineitem WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey > 100 ORDER BY 1 LIMIT 500)")
def journal_events(spark, sf_dir):
    return E.journal_events(read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("ord")), 100)


@query("expired_plans", """SELECT o_orderkey, CASE WHEN date_diff('day', o_orderdate::DATE, DATE '1998-08-02') <= 30 THEN 'payload' WHEN date_diff('day', o_orderdate::DATE, DATE '1998-08-02') <= 180 THEN 'receipt' ELSE 'nothing' END AS "left" FROM orders""")
def expired_plans(spark, sf_dir):
    return E.expired(read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), "1998-08-02", "o_orderdate").select("o_orderkey", "left")


@query("neighbourhood", """WITH p AS (SELECT p_partkey AS id, p_name AS slug, CASE WHEN p_size = 1 THEN 'ignored' ELSE 'knowledge' END AS role, p_type AS about FROM part), l AS (SELECT l_partkey AS f, l_suppkey AS t FROM lineitem)
SELECT id, slug, EXISTS (SELECT 1 FROM l WHERE f = 5 AND t = p.id) AS outbound, EXISTS (SELECT 1 FROM l WHERE f = p.id AND t = 5) AS backlink FROM p
WHERE id <> 5 AND role <> 'ignored' AND (id IN (SELECT t FROM l WHERE f = 5) OR id IN (SELECT f FROM l WHERE t = 5) OR contains(about, 'BRASS')) ORDER BY lower(slug), id LIMIT 31""")
def neighbourhood(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_type").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("slug"), F.when(F.col("p_size") == 1, "ignored").otherwise("knowledge").alias("role"), F.col("p_type").alias("about"))
    links = read(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").select(F.col("l_partkey").alias("from_page"), F.col("l_suppkey").alias("to_page"))
    return M.neighbourhood(5, p, links, "BRASS")


_PRE = "'<!-- cairn:item memo-' || conv_id || '_' || turn || ' v=' || CASE WHEN turn % 7 = 6 THEN '1' ELSE '2' END || ' supports=s level=1 kind=' || role"
_MARK = f"{_PRE} || ' subject=Ann%20' || turn || '%2B source-role=user reports=' || turn % 2 || CASE WHEN turn % 4 = 1 THEN ' reporters=a' ELSE '' END || CASE WHEN conv_id % 5 = 0 THEN ' disposition=active commitment=asserted' ELSE ' commitment=asserted disposition=active' END || ' polarity=positive basis=direct' || CASE turn % 3 WHEN 0 THEN ' start=2024' WHEN 1 THEN ' relation=valid temporal=actual precision=year start=2024' ELSE '' END || ' -->'"


@query("memory_markers", "SELECT conv_id, turn, 'memo-' || conv_id || '_' || turn AS id, 'Ann ' || turn || '+' AS subject FROM conversations WHERE turn % 7 <> 6 AND conv_id % 5 <> 0 AND (turn % 2 = 0 OR turn % 4 = 1) AND turn % 3 <> 0")
def memory_markers(spark, sf_dir):
    """Marker lines, of which some break a rule: version, order, reporters, or a time without its relation."""
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "role").withColumn("line", F.expr(_MARK))
    got = c.select("conv_id", "turn", ME.marker(F.col("line"), "cairn:item").alias("m")).filter("m IS NOT NULL")
    return got.select("conv_id", "turn", "m.id", F.col("m.fields")["subject"].alias("subject"))


_WORDS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= {1})"
_GLUE = ", ".join(f"'{w}'" for w in X.GLUE_WORDS)


@query("lost_tokens", f"""WITH t AS (SELECT doc_id, text, left(text, length(text) // 2) AS half FROM documents)
SELECT doc_id, len(list_filter(list_distinct({_WORDS.format('text', 3)}), lambda w: NOT list_contains({_WORDS.format('half', 3)}, w) AND w NOT IN ({_GLUE})))::INT AS lost FROM t""")
def lost_tokens(spark, sf_dir):
    """What the first half of a text loses of the whole."""
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.size(X.lost_tokens(F.col("text"), F.left("text", F.floor(F.length("text") / 2).cast("int")))).alias("lost"))


@query("overlap_ratio", f"""WITH w AS (SELECT conv_id, turn, list_transform({_WORDS.format('text', 1)}, lambda w: CASE WHEN length(w) > 5 AND w LIKE '%ies' THEN w[:-4] WHEN length(w) > 4 AND w LIKE '%es' THEN w[:-3] WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END) AS h FROM conversations)
SELECT conv_id, turn, round(len(list_filter(['the', 'erth', 'erth', 'thbl'], lambda r: list_contains(h, r))) / 4.0, 6) AS ratio FROM w""")
def overlap_ratio(spark, sf_dir):
    roots = F.array(*(F.lit(w) for w in ("the", "erth", "erth", "thbl")))
    return read(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.round(X.overlap_ratio(roots, F.col("text")), 6).alias("ratio"))


_HELD = X.stop_words(["erth", "the thbles", "A+B"])


@query("stop_words", f"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}])(erth|the[\\s_-]+thbles|A\\+B)($|[^\\p{{L}}\\p{{N}}])')")
def stop_word_query(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").filter(F.col("text").rlike(_HELD)).select("doc_id")


@query("fact_fusion", """WITH a AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events), b AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS rank FROM events), u AS (SELECT * FROM a WHERE rank <= 60 UNION ALL SELECT * FROM b WHERE rank <= 60)
SELECT event_id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*)::BIGINT AS arms FROM u GROUP BY 1""")
def fact_fusion(spark, sf_dir):
    """Facts ranked in two halves as one list."""
    e = read(spark, sf_dir, "events", "event_id", "value", "ts")
    arms = [R.ranked(e.withColumn("s", F.col(c)), "s", "event_id", R.ARM_LIMIT).select("event_id", "rank") for c in ("value", "ts")]
    return R.fuse(arms, "event_id").select("event_id", "score", "arms")


@query("complete_rerank", """SELECT conv_id, count(*) = max(turn) + 1 AND count_if(length(text) % 9 > 0 AND turn >= 0) = max(turn) + 1 AND count(DISTINCT turn) = max(turn) + 1 AS complete FROM conversations GROUP BY 1""")
def complete_rerank(spark, sf_dir):
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    n = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("n"))
    score = F.when(F.length("text") % 9 > 0, F.length("text").cast("double"))
    return R.complete_rerank(c.join(n, "conv_id").select("conv_id", F.col("turn").alias("index"), score.alias("score"), "n"), "conv_id", "n")
