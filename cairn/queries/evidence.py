"""Queries over facts, memories, lineage and journals built from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.confidence import BASE, confidence
from cairn.functions.text import attribute_value, claim_text, conflicts
from cairn.operators import evidence as E
from cairn.operators.filters import apply_rules, chunk_view, view_eligible
from cairn.operators.prose import FAMILIES, classify_line
from cairn.registry import query
from cairn.sources.tables import read


def _pick(values, key):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (key % len(values) + 1).cast("int"))


def _case(values, key):
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


KINDS = ("claim", "plan", "question", "decision", "event", "preference")
COMMITMENTS = ("asserted", "tentative", "hypothetical", "counterfactual", "asserted")
DISPOSITIONS = ("active", "accepted", "proposed", "rejected", "completed", "superseded", "active")
STATUSES = ("actual", "planned", "scheduled", "tentative")
RELATIONS = ("occurred", "scheduled", "due", "valid", "occurred")
_ID = "(conv_id * 31 + turn)"
_MEM = f"""mem AS (SELECT {_ID} AS memory_id, conv_id AS page_id, turn AS line, {_case(KINDS, _ID)} AS kind, {_case(COMMITMENTS, _ID)} AS commitment, {_case(DISPOSITIONS, _ID)} AS disposition,
 CASE WHEN role = 'user' THEN 'source_report' ELSE 'direct' END AS basis, {_case(STATUSES, _ID)} AS temporal_status, {_case(RELATIONS, _ID)} AS temporal_relation, {_ID} % 3 = 0 AS answer_eligible, {_ID} % 17 = 0 AS current_hold FROM conversations)"""
_VIEW = {
    "factual": "answer_eligible",
    "reports": "basis = 'source_report'",
    "questions": "kind = 'question'",
    "planning": "(kind = 'plan' OR temporal_status IN ('planned', 'scheduled') OR (kind IN ('claim', 'event') AND commitment IN ('asserted', 'tentative') AND temporal_status = 'tentative' AND temporal_relation IN ('scheduled', 'due'))) AND disposition IN ('active', 'proposed', 'accepted')",
    "history": "disposition IN ('rejected', 'cancelled', 'completed', 'superseded', 'resolved') OR (kind = 'decision' AND disposition = 'accepted')",
    "discussion": "commitment IN ('tentative', 'hypothetical', 'counterfactual') OR disposition IN ('proposed', 'rejected')",
}


def memories(spark, sf_dir):
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    k = F.col("conv_id") * 31 + F.col("turn")
    return c.select(k.alias("memory_id"), F.col("conv_id").alias("page_id"), F.col("turn").alias("line"), _pick(KINDS, k).alias("kind"), _pick(COMMITMENTS, k).alias("commitment"), _pick(DISPOSITIONS, k).alias("disposition"), F.when(F.col("role") == "user", "source_report").otherwise("direct").alias("basis"), _pick(STATUSES, k).alias("temporal_status"), _pick(RELATIONS, k).alias("temporal_relation"), (k % 3 == 0).alias("answer_eligible"), (k % 17 == 0).alias("current_hold"))


@query("view_eligibility", f"WITH {_MEM} SELECT page_id, line, " + ", ".join(f"CASE WHEN current_hold THEN {'true' if v == 'history' else 'false'} ELSE {on} END AS {v}" for v, on in _VIEW.items()) + " FROM mem")
def view_eligibility(spark, sf_dir):
    return memories(spark, sf_dir).select("page_id", "line", *(view_eligible(v).alias(v) for v in _VIEW))


@query("chunk_view", f"""WITH {_MEM}, ch AS (SELECT DISTINCT conv_id AS page_id, turn // 4 AS o FROM conversations), k AS (SELECT page_id * 1000 + o AS chunk_id, page_id, o * 4 AS a, o * 4 + 3 AS b FROM ch UNION ALL SELECT page_id * 1000 + 999, page_id, 9000, 9001 FROM ch WHERE o = 0),
tw AS (SELECT memory_id, count(*) > 1 AS twice FROM mem GROUP BY 1), j AS (SELECT k.chunk_id, m.memory_id, CASE WHEN current_hold THEN false ELSE answer_eligible END AS ok, twice FROM k LEFT JOIN (mem m JOIN tw USING (memory_id)) ON m.page_id = k.page_id AND m.line BETWEEN k.a AND k.b),
g AS (SELECT chunk_id, count(memory_id)::BIGINT AS n, coalesce(count_if(ok), 0)::BIGINT AS ok, coalesce(bool_or(twice), false) AS twice FROM j GROUP BY 1)
SELECT chunk_id, n, ok, CASE WHEN n = 0 THEN 'eligible' WHEN twice THEN 'excluded' WHEN ok = n THEN 'eligible' WHEN ok > 0 THEN 'contextual' ELSE 'excluded' END AS state FROM g""")
def chunk_view_query(spark, sf_dir):
    c = read(spark, sf_dir, "conversations", "conv_id", "turn").select(F.col("conv_id").alias("page_id"), F.floor(F.col("turn") / 4).alias("o")).distinct()
    k = c.select((F.col("page_id") * 1000 + F.col("o")).alias("chunk_id"), "page_id", (F.col("o") * 4).alias("line_start"), (F.col("o") * 4 + 3).alias("line_end"))
    k = k.unionByName(c.filter("o = 0").select((F.col("page_id") * 1000 + 999).alias("chunk_id"), "page_id", F.lit(9000).cast("long").alias("line_start"), F.lit(9001).cast("long").alias("line_end")))
    return chunk_view(k, memories(spark, sf_dir), "factual")


@query("page_roles", """SELECT page_id, CASE WHEN regexp_replace(url, '^https?://', '') LIKE 'blog.%' THEN 'source' WHEN regexp_matches(regexp_replace(url, '^https?://', ''), '^[^/]*\\.org/.*$') THEN 'ignored' WHEN regexp_matches(regexp_replace(url, '^https?://', ''), '^[^/]*/fr/[^/]*$') THEN 'inference' ELSE 'knowledge' END AS role,
CASE WHEN regexp_matches(regexp_replace(url, '^https?://', ''), '^[^/]*/fr/[^/]*$') THEN 'fr' END AS locale FROM pages""")
def page_roles(spark, sf_dir):
    rules = [{"glob": "blog.**", "role": "source"}, {"glob": "*/fr/*", "role": "inference", "locale": "fr"}, {"glob": "*.org/**", "role": "ignored"}, {"glob": "**", "role": "knowledge"}]
    p = read(spark, sf_dir, "pages", "page_id", "url").withColumn("path", F.regexp_replace("url", "^https?://", ""))
    return apply_rules(p, rules, "path", ["role", "locale"]).select("page_id", "role", "locale")


_FV = """fv AS (SELECT 'p' || p_partkey AS page, p_brand AS subject, 'size' AS attribute, 'about ' || p_size || ' units' AS value, p_partkey AS id FROM part
UNION ALL SELECT 's' || s_suppkey, 'nation ' || s_nationkey, 'balance', 'EUR ' || (s_suppkey % 5) || ',000', 1000000 + s_suppkey FROM supplier)"""
_NUM = "regexp_extract_all(regexp_replace({0}, '(\\d),(\\d{{3}})\\b', '\\1\\2', 'g'), '\\d+(?:[.]\\d+)?')"


def _conf(a, b):
    core = lambda x: f"regexp_replace(regexp_replace(lower({x}), '[*_`\\s,]', '', 'g'), '\\.$', '')"
    return f"({core(a)} <> {core(b)} AND len({_NUM.format(a)}) > 0 AND len({_NUM.format(b)}) > 0 AND array_to_string({_NUM.format(a)}, ',') <> array_to_string({_NUM.format(b)}, ','))"


def fact_values(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size").select(F.concat(F.lit("p"), "p_partkey").alias("page"), F.col("p_brand").alias("subject"), F.lit("size").alias("attribute"), F.concat(F.lit("about "), "p_size", F.lit(" units")).alias("value"), F.col("p_partkey").alias("id"))
    s = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(F.concat(F.lit("s"), "s_suppkey").alias("page"), F.concat(F.lit("nation "), "s_nationkey").alias("subject"), F.lit("balance").alias("attribute"), F.concat(F.lit("EUR "), (F.col("s_suppkey") % 5).cast("string"), F.lit(",000")).alias("value"), (F.col("s_suppkey") + 1000000).alias("id"))
    return p.unionByName(s)


@query("cross_page_conflicts", f"WITH {_FV} SELECT a.subject, a.attribute, a.id AS id_a, b.id AS id_b FROM fv a JOIN fv b ON a.subject = b.subject AND a.attribute = b.attribute AND a.id < b.id AND a.page <> b.page AND {_conf('a.value', 'b.value')}")
def cross_page_conflicts(spark, sf_dir):
    return E.cross_page_conflicts(fact_values(spark, sf_dir))


@query("value_conflict", f"WITH x AS (SELECT o_orderkey AS id, 'EUR ' || round(o_totalprice)::BIGINT AS a, (round(o_totalprice)::BIGINT + o_orderkey % 2) || ' eur' AS b FROM orders) SELECT id, {_conf('a', 'b')} AS conflict FROM x")
def value_conflict(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    n = F.round("o_totalprice").cast("long")
    return o.select(F.col("o_orderkey").alias("id"), conflicts(F.concat(F.lit("EUR "), n.cast("string")), F.concat((n + F.col("o_orderkey") % 2).cast("string"), F.lit(" eur"))).alias("conflict"))


_KV = "'- **' || p_type || ':** ' || CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'inactive since May' WHEN 2 THEN 'plain words' ELSE 'https://x.example/1' END"


@query("attribute_values", f"SELECT p_partkey, regexp_replace(lower(p_type), '\\s+', ' ', 'g') AS attribute, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR ELSE 'inactive since May' END AS value FROM part WHERE p_partkey % 4 < 2")
def attribute_values(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_type", "p_size")
    k = F.col("p_partkey") % 4
    line = F.concat(F.lit("- **"), "p_type", F.lit("**: "), F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, "inactive since May").when(k == 2, "plain words").otherwise("https://x.example/1"))
    return p.select("p_partkey", attribute_value(line).alias("x")).filter("x IS NOT NULL").select("p_partkey", "x.attribute", "x.value")


@query("confidence_score", f"""SELECT o_orderkey, round(greatest(0.05, least(0.98, {BASE} + CASE WHEN o_orderkey % 5 = 0 THEN -0.28 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN -0.3 ELSE 0 END + 0.08 + CASE WHEN o_orderkey % 3 = 0 THEN 0.07 ELSE 0 END + 0.06 + CASE WHEN o_orderkey % 2 = 0 THEN 0.04 ELSE 0 END)), 2) AS confidence FROM orders""")
def confidence_score(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    source = F.concat(F.when(k % 5 == 0, "Possibly order ").otherwise("The order "), F.lit("was sent to customer "), "o_custkey", F.when(k % 3 == 0, " for 12 kg").otherwise(" in time"), F.when(k % 7 == 0, "?").otherwise("."))
    return o.select("o_orderkey", confidence(source, claim_text(F.lit("The order was sent to the customer in time")), F.lit("order"), F.when(k % 2 == 0, "customer")).alias("confidence"))


@query("fact_supersession", """WITH f AS (SELECT o_orderkey AS id, o_custkey AS line_hash, CASE WHEN o_orderkey % 11 = 0 THEN DATE '2020-01-01' END AS valid_to FROM orders WHERE o_orderkey % 10 < 8),
n AS (SELECT o_orderkey AS id, o_custkey AS line_hash FROM orders WHERE o_orderkey % 3 = 0), l AS (SELECT DISTINCT o_custkey AS line_hash FROM orders WHERE o_custkey % 4 <> 0)
SELECT f.id, CASE WHEN valid_to IS NOT NULL AND n.id IS NULL THEN 'keep' WHEN n.id IS NOT NULL THEN 'refresh' WHEN l.line_hash IS NULL THEN 'close' ELSE 'delete' END AS action,
 CASE WHEN valid_to IS NOT NULL AND n.id IS NULL THEN valid_to WHEN n.id IS NOT NULL THEN NULL WHEN l.line_hash IS NULL THEN DATE '2024-02-01' ELSE valid_to END::VARCHAR AS valid_to FROM f LEFT JOIN n USING (id) LEFT JOIN l ON f.line_hash = l.line_hash
UNION ALL SELECT n.id, 'insert', NULL FROM n ANTI JOIN f USING (id)""")
def fact_supersession(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("line_hash"), F.lit("c").alias("claim"))
    facts = o.filter("id % 10 < 8").withColumn("valid_to", F.when(F.col("id") % 11 == 0, F.lit("2020-01-01").cast("date")))
    out = E.supersede(facts, o.filter("id % 3 = 0"), o.filter("line_hash % 4 <> 0").select("line_hash"), "2024-02-01")
    return out.select("id", "action", F.col("valid_to").cast("string").alias("valid_to"))


@query("exact_duplicates", "SELECT sha256(text) AS content, count(*)::BIGINT AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return E.duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", F.sha2("text", 256))


@query("rename_detect", """WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), a AS (SELECT h, doc_id, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS n FROM h WHERE doc_id % 2 = 0), b AS (SELECT h, doc_id, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS n FROM h WHERE doc_id % 2 = 1)
SELECT a.doc_id AS old, b.doc_id AS new FROM a JOIN b USING (h, n)""")
def rename_detect(spark, sf_dir):
    """Even documents as vanished files, odd ones as arrived."""
    d = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("h"))
    return E.renames(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), "doc_id", ["h"])


@query("snapshot_diff", """WITH o AS (SELECT doc_id, n_chars AS size, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END AS size, sha256(CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 9)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.size = n.size THEN 'same' WHEN o.h = n.h THEN 'touched' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def snapshot_diff(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    k = F.col("doc_id")
    old = d.filter(k % 10 != 0).select("doc_id", F.col("n_chars").alias("size"), F.sha2("text", 256).alias("h"))
    new = d.filter(k % 10 != 9).select("doc_id", (F.col("n_chars") + F.when(k % 5 == 1, 1).otherwise(0)).alias("size"), F.sha2(F.when(k % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return E.diff_snapshot(old, new, "doc_id", ["size"], "h")


@query("page_quarantine", """WITH p AS (SELECT o_custkey % 9000 AS page_id, o_orderstatus AS sha FROM orders) SELECT page_id, count(*)::BIGINT AS files, CASE WHEN count(DISTINCT sha) = 1 THEN 'duplicate_same_bytes' ELSE 'duplicate_different_bytes' END AS reason FROM p GROUP BY 1 HAVING count(*) > 1""")
def page_quarantine(spark, sf_dir):
    p = read(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").select((F.col("o_custkey") % 9000).alias("page_id"), F.col("o_orderstatus").alias("sha"))
    return E.quarantine(p, "page_id", "sha")


@query("fact_chunk_range_join", """WITH c AS (SELECT l_orderkey AS page, l_linenumber AS line_start, l_linenumber + 1 AS line_end, l_orderkey * 10 + l_linenumber AS chunk FROM lineitem WHERE l_linenumber % 2 = 1)
SELECT l_orderkey * 10 + l_linenumber AS fact, chunk FROM lineitem JOIN c ON l_orderkey = page AND l_linenumber BETWEEN line_start AND line_end WHERE l_returnflag <> 'R'""")
def fact_chunk_range_join(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    facts = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), key.alias("fact"), F.when(F.col("l_returnflag") == "R", F.lit("2020-01-01")).alias("valid_to"))
    chunks = li.filter("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line_start"), (F.col("l_linenumber") + 1).alias("line_end"), key.alias("chunk"))
    return E.facts_in_chunks(facts, chunks)


@query("best_fact_per_line", "SELECT l_orderkey AS page, l_suppkey % 3 AS line, arg_min(l_linenumber, (-l_discount, l_linenumber)) AS fact FROM lineitem GROUP BY 1, 2")
def best_fact_per_line(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_discount")
    return E.best_fact_per_line(li.select(F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 3).alias("line"), F.col("l_linenumber").alias("fact"), F.col("l_discount").alias("confidence")))


@query("pending_vectors", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 5 = 0")
def pending_vectors(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("id"), F.lit("a").alias("claim_hash"))
    v = o.filter("id % 4 <> 0").select("id", F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("claim_hash"))
    return E.pending(o, v).select("id")


@query("idempotent_replay", """WITH r AS (SELECT event_id, user_id AS actor, event_type AS op, (value * 0 + event_id % 3)::BIGINT AS digest FROM events), l AS (SELECT DISTINCT actor, op, 1::BIGINT AS digest FROM r WHERE actor % 2 = 0),
b AS (SELECT actor, op, digest, NULL::BIGINT AS event_id, 0 AS th FROM l UNION ALL SELECT actor, op, digest, event_id, 1 FROM r), w AS (SELECT *, first_value(digest) OVER o AS f, row_number() OVER o AS n FROM b WINDOW o AS (PARTITION BY actor, op ORDER BY th, event_id))
SELECT actor, op, event_id, CASE WHEN n = 1 THEN 'accepted' WHEN digest = f THEN 'replay' ELSE 'conflict' END AS outcome FROM w WHERE th = 1""")
def idempotent_replay(spark, sf_dir):
    r = read(spark, sf_dir, "events", "event_id", "user_id", "event_type").select("event_id", F.col("user_id").alias("actor"), F.col("event_type").alias("op"), (F.col("event_id") % 3).alias("digest"))
    ledger = r.filter("actor % 2 = 0").select("actor", "op", F.lit(1).cast("long").alias("digest")).distinct()
    return E.replay(ledger, r, ["actor", "op"], "digest", "event_id")


@query("retract_support", """WITH s AS (SELECT event_id AS support, user_id AS source_id, event_id % 4 AS revision, event_id % 97 AS memory, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, event_id % 13 = 0 AS forgotten FROM events),
x AS (SELECT * FROM s WHERE NOT (source_id % 5 = 0 AND revision = 1) AND NOT forgotten) SELECT memory, arg_min(support, (created_at, support)) AS support, count(*)::BIGINT AS n FROM x GROUP BY 1""")
def retract_support(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "user_id", "ts")
    k = F.col("event_id")
    s = e.select(k.alias("support"), F.col("user_id").alias("source_id"), (k % 4).alias("revision"), (k % 97).alias("memory"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), (k % 13 == 0).alias("forgotten"), F.lit(None).cast("string").alias("retracted_by"))
    gone = s.filter("source_id % 5 = 0 AND revision = 1").select("source_id", "revision", F.lit("r1").alias("by"))
    return E.active_support(E.retract(s, gone))


@query("correction_restrictions", """WITH c AS (SELECT o_orderkey AS target, o_custkey AS replacement, CASE WHEN o_orderstatus = 'F' THEN 'decided' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'open' END AS state FROM orders), m AS (SELECT c_custkey AS memory FROM customer WHERE c_custkey % 3 <> 0)
SELECT target AS memory, 'superseded' AS restriction FROM c ANTI JOIN m ON replacement = memory WHERE state = 'decided' UNION SELECT target, 'pending' FROM c WHERE state = 'pending' UNION SELECT replacement, 'deciding' FROM c SEMI JOIN m ON replacement = memory WHERE state = 'pending'""")
def correction_restrictions(spark, sf_dir):
    c = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").select(F.col("o_orderkey").alias("target"), F.col("o_custkey").alias("replacement"), F.when(F.col("o_orderstatus") == "F", "decided").when(F.col("o_orderstatus") == "O", "pending").otherwise("open").alias("state"))
    m = read(spark, sf_dir, "customer", "c_custkey").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("memory"))
    return E.restrictions(c, m)


_OB = """ob AS (SELECT l_suppkey AS observation, CASE WHEN l_linenumber < 7 THEN l_orderkey END AS fact, l_partkey AS page, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS proof_group, CASE WHEN l_tax > 0.075 THEN 'low_confidence' ELSE 'eligible' END AS status, l_orderkey * 10 + l_linenumber AS ord FROM lineitem WHERE l_discount > 0.09)"""


def observations(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_tax", "l_discount").filter("l_discount > 0.09")
    return li.select(F.col("l_suppkey").alias("observation"), F.when(F.col("l_linenumber") < 7, F.col("l_orderkey")).alias("fact"), F.col("l_partkey").cast("string").alias("page"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("proof_group"), F.when(F.col("l_tax") > 0.075, "low_confidence").otherwise("eligible").alias("status"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


@query("proof_groups", f"WITH {_OB} SELECT observation, count(DISTINCT fact)::BIGINT AS facts, count(DISTINCT coalesce(proof_group, page::VARCHAR))::BIGINT AS proofs FROM ob GROUP BY 1")
def proof_groups(spark, sf_dir):
    return E.proof_groups(observations(spark, sf_dir))


@query("observation_states", f"""WITH {_OB}, r AS (SELECT *, CASE WHEN fact IS NULL THEN 'missing_fact' WHEN page IS NULL THEN 'missing_page' WHEN status <> 'eligible' THEN 'ineligible_fact' END AS r FROM ob),
g AS (SELECT observation, arg_min(r, ord) FILTER (r IS NOT NULL) AS reason, count(DISTINCT coalesce(proof_group, page::VARCHAR)) AS p FROM r GROUP BY 1) SELECT observation, CASE WHEN reason IS NOT NULL THEN reason WHEN p < 2 THEN 'too_few_proofs' ELSE 'qualified' END AS state FROM g""")
def observation_states(spark, sf_dir):
    return E.qualify_observations(observations(spark, sf_dir))


@query("journal_transitions", """WITH j AS (SELECT l_partkey AS file, l_orderkey AS seq, l_linenumber AS ord, CASE WHEN l_returnflag = 'R' THEN 'undo' ELSE 'apply' END AS kind, l_suppkey AS b, l_suppkey + 1 AS a FROM lineitem)
SELECT file, seq, ord, kind, CASE WHEN kind = 'undo' THEN a ELSE b END AS before, CASE WHEN kind = 'undo' THEN b ELSE a END AS after, row_number() OVER (PARTITION BY file ORDER BY seq, CASE WHEN kind = 'undo' THEN -ord ELSE ord END, b)::INT AS step FROM j""")
def journal_transitions(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey")
    j = li.select(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_returnflag") == "R", "undo").otherwise("apply").alias("kind"), F.col("l_suppkey").alias("before"), (F.col("l_suppkey") + 1).alias("after"))
    return E.transitions(j, "file")


@query("journal_page", "SELECT l_orderkey AS seq, l_linenumber AS ord FROM lineitem WHERE l_orderkey > 100 ORDER BY 1, 2 LIMIT 500")
def journal_page(spark, sf_dir):
    return E.journal_page(read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("ord")), 100)


@query("undo_valid", "SELECT l_orderkey AS change, bool_and(l_suppkey IS NOT DISTINCT FROM CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_suppkey END) AS valid FROM lineitem GROUP BY 1")
def undo_valid(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select(F.col("l_orderkey").alias("change"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("path"), F.col("l_suppkey").alias("after"), "l_partkey")
    return E.undoable(li.drop("l_partkey"), li.filter("l_partkey % 10 <> 0").select("path", F.col("after").alias("hash")).distinct())


@query("prune_evidence", "SELECT event_id AS id FROM events WHERE strftime(ts, '%Y-%m-%d') < '2024-01-10' AND event_id % 3 <> 0")
def prune_evidence(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "ts").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("created_at"))
    return E.prune(e, e.filter("id % 3 = 0").select("id"), "2024-01-10").select("id")


_PROSE = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{v}'" for v, p in FAMILIES)


@query("prose_views", f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), v AS (SELECT doc_id, CASE {_PROSE} ELSE 'factual' END AS view FROM l) SELECT doc_id, view, count(*)::BIGINT AS lines FROM v GROUP BY 1, 2")
def prose_views(spark, sf_dir):
    lines = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    return lines.groupBy("doc_id", classify_line(F.col("t")).alias("view")).agg(F.count(F.lit(1)).alias("lines"))


@query("document_parts", """WITH f AS (SELECT p_brand || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END || CASE p_size % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN 'a-2.pdf' WHEN 2 THEN 'a.pdf' ELSE 'a-03.pdf' END AS path FROM part), d AS (SELECT DISTINCT path FROM f),
m AS (SELECT path, regexp_extract(path, '^(.*[^0-9-])-([1-9][0-9]*)(\\.[^./]+)$', 1) AS s, regexp_extract(path, '^(.*[^0-9-])-([1-9][0-9]*)(\\.[^./]+)$', 2) AS n, regexp_extract(path, '^(.*[^0-9-])-([1-9][0-9]*)(\\.[^./]+)$', 3) AS e FROM d)
SELECT m.path, CASE WHEN x.path IS NOT NULL THEN m.s || m.e ELSE m.path END AS group_key, CASE WHEN x.path IS NOT NULL THEN m.n::INT ELSE 1 END AS part FROM m LEFT JOIN d x ON m.n NOT IN ('', '1') AND x.path = m.s || m.e""")
def document_parts(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    tail = F.when(F.col("p_size") % 4 == 0, ".pdf").when(F.col("p_size") % 4 == 1, "a-2.pdf").when(F.col("p_size") % 4 == 2, "a.pdf").otherwise("a-03.pdf")
    return E.parts(p.select(F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(""), tail).alias("path")).distinct(), "path")


@query("availability", "SELECT l_orderkey AS g, CASE WHEN count_if(l_returnflag <> 'R') = count(*) THEN 'available' WHEN count_if(l_returnflag <> 'R') > 0 OR bool_or(l_linestatus = 'O') THEN 'partial' ELSE 'missing' END AS status, sum(CASE WHEN l_linenumber <> 2 THEN l_linenumber END)::BIGINT AS pages FROM lineitem GROUP BY 1")
def availability(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return E.availability(li.select(F.col("l_orderkey").alias("g"), (F.col("l_returnflag") != "R").alias("present"), F.when(F.col("l_linenumber") != 2, F.col("l_linenumber")).alias("pages"), (F.col("l_linestatus") == "O").alias("rendition")), "g")
