"""Queries over further arms, changes to files, and Unicode functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.text import tokens
from cairn.functions.unicode import fold_diacritics, porter_stems
from cairn.operators import arms as A
from cairn.operators import changes as C
from cairn.registry import query
from cairn.sources.tables import read

_LI = "f AS (SELECT l_orderkey * 10 + l_linenumber AS fact, l_orderkey AS page, l_linenumber AS line, min(row_number) AS rank FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS row_number FROM lineitem ORDER BY row_number LIMIT 200) GROUP BY ALL)"
_CH = "c AS (SELECT DISTINCT l_orderkey AS page, l_orderkey * 10 + (l_linenumber - 1) // 3 AS chunk, (l_linenumber - 1) // 3 AS ord, (l_linenumber - 1) // 3 * 3 + 1 AS a, (l_linenumber - 1) // 3 * 3 + 3 AS b FROM lineitem)"
_LO = "lo AS (SELECT chunk, fact, rank, line FROM f JOIN c ON f.page = c.page AND line BETWEEN a AND b ORDER BY rank, fact, chunk LIMIT 60)"


def top_facts(spark, sf_dir):
    from cairn.operators.retrieval import ranked

    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), "l_extendedprice", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("k"))
    return ranked(rows, "l_extendedprice", "k", 200).groupBy("fact", "page", "line").agg(F.min("rank").alias("rank"))


def line_chunks(spark, sf_dir):
    o = F.floor((F.col("l_linenumber") - 1) / 3).cast("int")
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    return li.select(F.col("l_orderkey").alias("page"), (F.col("l_orderkey") * 10 + o).alias("chunk"), o.alias("ord"), (o * 3 + 1).alias("line_start"), (o * 3 + 3).alias("line_end")).distinct()


@query("fact_arm", f"WITH {_LI}, {_CH}, {_LO} SELECT chunk, fact, rank, line FROM lo")
def fact_arm(spark, sf_dir):
    return A.locate(top_facts(spark, sf_dir), line_chunks(spark, sf_dir))


@query("fact_chunk_ranks", f"WITH {_LI}, {_CH}, {_LO} SELECT chunk, row_number() OVER (ORDER BY min(rank), chunk)::INT AS rank, array_to_string(list_sort(list_distinct(list(line))), ',') AS lines FROM lo GROUP BY chunk")
def fact_chunk_ranks(spark, sf_dir):
    return A.fact_chunks(fact_arm(spark, sf_dir)).withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))


@query("fact_list", f"""WITH {_LI}, {_CH}, {_LO}, r AS (SELECT chunk, row_number() OVER (ORDER BY min(rank), chunk) AS rank FROM lo GROUP BY chunk), w AS (SELECT fact, min(rank) AS rank FROM lo GROUP BY 1),
a AS (SELECT DISTINCT c.chunk, l_orderkey * 10 + l_linenumber AS fact, max(l_discount) AS conf FROM lineitem JOIN c ON l_orderkey = page AND l_linenumber BETWEEN a AND b GROUP BY 1, 2), i AS (SELECT a.chunk, a.fact, conf, r.rank AS cr, w.fact IS NOT NULL AS m FROM a JOIN r USING (chunk) LEFT JOIN w ON a.fact = w.fact),
n AS (SELECT *, row_number() OVER (PARTITION BY chunk, m ORDER BY conf DESC, fact) AS k FROM i), v AS (SELECT fact, 1.0::DOUBLE / (60 + min(cr)) AS s FROM n WHERE m OR k <= 3 GROUP BY 1), u AS (SELECT fact, 1.0::DOUBLE / (60 + rank) AS s FROM w UNION ALL SELECT * FROM v) SELECT fact, round(sum(s), 9) AS score FROM u GROUP BY 1""")
def fact_list(spark, sf_dir):
    located, chunks = fact_arm(spark, sf_dir), line_chunks(spark, sf_dir)
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_discount")
    inside = li.join(chunks, (F.col("l_orderkey") == F.col("page")) & F.col("l_linenumber").between(F.col("line_start"), F.col("line_end")))
    inside = inside.groupBy("chunk", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact")).agg(F.max("l_discount").alias("confidence"))
    return A.fact_list(located.groupBy("fact").agg(F.min("rank").alias("rank")), A.fact_chunks(located), inside)


@query("graph_arm")
def graph_arm(spark, sf_dir):
    """Customers reached from two nations, as retrieval items."""
    from cairn.operators.graph import node_id
    from cairn.queries.graph import star

    edges = star(spark, sf_dir)[1]
    seeds = read(spark, sf_dir, "nation", "n_nationkey").filter("n_nationkey IN (1, 2)").select(node_id("nation", F.col("n_nationkey")).alias("seed"))
    targets = read(spark, sf_dir, "customer", "c_custkey").select(node_id("customer", F.col("c_custkey")).alias("node"), F.col("c_custkey").alias("item"))
    return A.graph_arm(edges, seeds, targets)


_ED = """fi AS (SELECT o_orderkey || '.md' AS path, 'order ' || o_custkey AS text FROM orders WHERE o_orderkey % 4 <> 0),
ed AS (SELECT o_orderkey || '.md' AS path, CASE o_orderkey % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'append' WHEN 2 THEN 'replace' ELSE 'delete' END AS mode, 'new ' || o_orderstatus AS text FROM orders WHERE o_orderkey % 3 = 0),
bo AS (SELECT coalesce(fi.path, ed.path) AS path, fi.text AS o, mode, ed.text AS n FROM fi FULL JOIN ed ON fi.path = ed.path),
af AS (SELECT path, o, CASE WHEN mode IS NULL THEN o WHEN mode = 'create' AND o IS NULL THEN n WHEN mode = 'append' AND o IS NOT NULL THEN rtrim(o) || chr(10) || n || chr(10) WHEN mode = 'replace' AND o IS NOT NULL THEN n WHEN mode = 'delete' THEN NULL ELSE o END AS text FROM bo)"""


def edits(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    k = F.col("o_orderkey")
    path = F.concat(k.cast("string"), F.lit(".md")).alias("path")
    mode = F.when(k % 5 == 0, "create").when(k % 5 == 1, "append").when(k % 5 == 2, "replace").otherwise("delete")
    return o.filter(k % 4 != 0).select(path, F.concat(F.lit("order "), "o_custkey").alias("text")), o.filter(k % 3 == 0).select(path, mode.alias("mode"), F.concat(F.lit("new "), "o_orderstatus").alias("text"))


@query("apply_edits", f"WITH {_ED} SELECT path, text FROM af WHERE text IS NOT NULL")
def apply_edits(spark, sf_dir):
    return C.apply(*edits(spark, sf_dir), "c1")[0]


@query("edit_journal", f"WITH {_ED} SELECT path, sha256(o) AS before, sha256(text) AS after FROM af WHERE o IS DISTINCT FROM text")
def edit_journal(spark, sf_dir):
    return C.apply(*edits(spark, sf_dir), "c1")[1].select("path", "before", "after")


@query("undo_edits", f"WITH {_ED} SELECT path, text FROM fi")
def undo_edits(spark, sf_dir):
    """Applying and undoing gives the first files."""
    files, journal = C.apply(*edits(spark, sf_dir), "c1")
    return C.undo(files, journal)


@query("forget_rows", "SELECT event_id FROM events WHERE user_id % 7 <> 0")
def forget_rows(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "user_id")
    return C.forget(e, e.filter("user_id % 7 = 0"), "event_id")[0].select("event_id")


@query("fold_diacritics", "SELECT doc_id, strip_accents(text) AS folded FROM documents")
def fold_query(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", fold_diacritics(F.col("text")).alias("folded"))


@query("porter_stems", "WITH t AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 1)) AS w FROM documents) SELECT count(*)::BIGINT AS words FROM t")
def porter_query(spark, sf_dir):
    """Every distinct word is stemmed once; the count shows that none is lost."""
    w = read(spark, sf_dir, "documents", "text").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("w")).distinct()
    return w.select(F.explode(porter_stems(F.array("w"))).alias("s")).agg(F.count(F.lit(1)).alias("words"))
