"""Graph queries over the star schema and over page links."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.text import entity_name, predicate
from cairn.operators import graph as G
from cairn.operators import links as L
from cairn.registry import query
from cairn.sources.tables import read

_NID = "'gnd_' || substr(sha256({0} || chr(0) || ({1})::VARCHAR), 1, 24)"


def _nid(kind: str, key: str) -> str:
    return _NID.format(f"'{kind}'", key)


_NODES = f"""SELECT {_nid('nation', 'n_nationkey')} AS id, 'nation' AS kind, n_nationkey::VARCHAR AS source_id FROM nation
UNION ALL SELECT {_nid('region', 'r_regionkey')}, 'region', r_regionkey::VARCHAR FROM region
UNION ALL SELECT {_nid('customer', 'c_custkey')}, 'customer', c_custkey::VARCHAR FROM customer
UNION ALL SELECT {_nid('supplier', 's_suppkey')}, 'supplier', s_suppkey::VARCHAR FROM supplier
UNION ALL SELECT {_nid('order', 'o_orderkey')}, 'order', o_orderkey::VARCHAR FROM orders"""
_EDGES0 = f"""SELECT {_nid('nation', 'n_nationkey')} AS f, {_nid('region', 'n_regionkey')} AS t, 'about' AS relation, 1.0::DOUBLE AS confidence FROM nation
UNION ALL SELECT {_nid('customer', 'c_custkey')}, {_nid('nation', 'c_nationkey')}, 'about', 0.9 FROM customer
UNION ALL SELECT {_nid('supplier', 's_suppkey')}, {_nid('nation', 's_nationkey')}, 'about', 0.8 FROM supplier
UNION ALL SELECT {_nid('order', 'o_orderkey')}, {_nid('customer', 'o_custkey')}, 'participates_in', 0.7 FROM orders"""
_EDGES = f"SELECT DISTINCT 'ged_' || substr(sha256(f || chr(0) || t || chr(0) || relation), 1, 24) AS id, f AS from_node, t AS to_node, relation, confidence FROM ({_EDGES0})"


def star(spark, sf_dir):
    """Nodes and edges of the star schema: regions, nations, customers, suppliers, orders."""
    nation = read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    region = read(spark, sf_dir, "region", "r_regionkey")
    customer = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    supplier = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    one = lambda df, kind, key: df.select(G.node_id(kind, F.col(key)).alias("id"), F.lit(kind).alias("kind"), F.col(key).cast("string").alias("source_id"))
    nodes = [one(nation, "nation", "n_nationkey"), one(region, "region", "r_regionkey"), one(customer, "customer", "c_custkey"), one(supplier, "supplier", "s_suppkey"), one(orders, "order", "o_orderkey")]
    to = lambda df, k1, c1, k2, c2, rel, sure: G.edges_of(df, G.node_id(k1, F.col(c1)), G.node_id(k2, F.col(c2)), rel, sure)
    edges = [to(nation, "nation", "n_nationkey", "region", "n_regionkey", "about", 1.0), to(customer, "customer", "c_custkey", "nation", "c_nationkey", "about", 0.9), to(supplier, "supplier", "s_suppkey", "nation", "s_nationkey", "about", 0.8), to(orders, "order", "o_orderkey", "customer", "o_custkey", "participates_in", 0.7)]
    return G.build(nodes, edges)


@query("graph_nodes", f"SELECT DISTINCT id, kind, source_id FROM ({_NODES})")
def graph_nodes(spark, sf_dir):
    return star(spark, sf_dir)[0]


@query("graph_edges", _EDGES)
def graph_edges(spark, sf_dir):
    return star(spark, sf_dir)[1]


@query("graph_hubs", f"""WITH e AS ({_EDGES}), n AS (SELECT from_node AS node, id FROM e UNION ALL SELECT to_node, id FROM e WHERE from_node <> to_node)
SELECT node, count(DISTINCT id)::BIGINT AS degree FROM n GROUP BY 1 HAVING count(DISTINCT id) > 50""")
def graph_hubs(spark, sf_dir):
    return G.hubs(star(spark, sf_dir)[1], built=True)


def _bfs(hops: int, fan: int = 50, limit: int = 30) -> str:
    sql = f"""WITH e AS ({_EDGES}), b AS (SELECT from_node AS node, to_node AS nxt, id, relation, confidence FROM e UNION SELECT to_node, from_node, id, relation, confidence FROM e),
a0 AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, relation, id) AS n FROM b), a AS (SELECT * FROM a0 WHERE n <= {fan}),
l0 AS (SELECT {_nid('region', 'r_regionkey')} AS seed, {_nid('region', 'r_regionkey')} AS node, 1.0::DOUBLE AS confidence, {_nid('region', 'r_regionkey')} AS path, 0 AS pos FROM region WHERE r_regionkey < 2)"""
    for h in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT seed, node FROM l{i}" for i in range(h))
        sql += f""",
x{h} AS (SELECT l.seed, a.nxt, round(l.confidence * a.confidence, 4) AS confidence, l.path || '>' || a.nxt AS path, l.pos AS ppos, a.n AS n FROM l{h - 1} l JOIN a ON a.node = l.node ANTI JOIN ({seen}) z ON z.seed = l.seed AND z.node = a.nxt),
f{h} AS (SELECT *, row_number() OVER (PARTITION BY seed, nxt ORDER BY ppos, n) AS k FROM x{h}),
g{h} AS (SELECT seed, nxt AS node, confidence, path, row_number() OVER (PARTITION BY seed ORDER BY ppos, n) AS pos FROM f{h} WHERE k = 1), l{h} AS (SELECT * FROM g{h} WHERE pos <= {limit})"""
    every = " UNION ALL ".join(f"SELECT seed, node, {h} AS hop, confidence, path, pos FROM l{h}" for h in range(1, hops + 1))
    return sql + f" SELECT seed, node, hop, confidence, path FROM ({every}) ORDER BY seed, hop, pos LIMIT {limit}"


@query("graph_bfs_3hop", _bfs(3))
def graph_bfs_3hop(spark, sf_dir):
    edges = star(spark, sf_dir)[1]
    seeds = read(spark, sf_dir, "region", "r_regionkey").filter("r_regionkey < 2").select(G.node_id("region", F.col("r_regionkey")).alias("seed"))
    return G.traverse(edges, seeds, hops=3).withColumn("path", F.array_join("path", ">"))


@query("graph_completeness", """SELECT 'customer' AS kind, count(*)::BIGINT AS rows, (SELECT count(DISTINCT c_custkey) FROM customer)::BIGINT AS nodes, true AS complete FROM customer
UNION ALL SELECT 'order', count(*)::BIGINT, count(DISTINCT o_orderkey)::BIGINT, true FROM orders UNION ALL SELECT 'part', count(*)::BIGINT, 0::BIGINT, false FROM part""")
def graph_completeness(spark, sf_dir):
    nodes = star(spark, sf_dir)[0]
    return G.completeness(nodes, {"customer": read(spark, sf_dir, "customer", "c_custkey"), "order": read(spark, sf_dir, "orders", "o_orderkey"), "part": read(spark, sf_dir, "part", "p_partkey")})


_NAMES = """SELECT DISTINCT entity, priority, trim(regexp_replace(lower(raw), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS name FROM (
SELECT 's' || s_suppkey AS entity, 0 AS priority, s_name AS raw FROM supplier UNION ALL SELECT 'n' || n_nationkey, 2, n_name FROM nation UNION ALL SELECT 'p' || p_partkey, 1, p_brand FROM part UNION ALL SELECT 'p' || p_partkey, 3, p_name FROM part)"""


def entity_names(spark, sf_dir):
    s = G.names(read(spark, sf_dir, "supplier", "s_suppkey", "s_name").withColumn("e", F.concat(F.lit("s"), "s_suppkey")), "e", canonical_slug="s_name")
    n = G.names(read(spark, sf_dir, "nation", "n_nationkey", "n_name").withColumn("e", F.concat(F.lit("n"), "n_nationkey")), "e", title="n_name")
    p = G.names(read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name").withColumn("e", F.concat(F.lit("p"), "p_partkey")), "e", alias="p_brand", basename="p_name")
    return s.unionByName(n).unionByName(p)


@query("entity_names", f"SELECT entity, priority, name FROM ({_NAMES}) WHERE name <> ''")
def entity_names_query(spark, sf_dir):
    return entity_names(spark, sf_dir).select("entity", "priority", "name")


@query("entity_resolve", f"""WITH n AS (SELECT * FROM ({_NAMES}) WHERE name <> ''), b AS (SELECT name, entity, min(priority) AS p FROM n GROUP BY 1, 2), t AS (SELECT name, min(p) AS p FROM b GROUP BY 1),
s AS (SELECT b.name, count(*) AS k, min(entity) AS e FROM b JOIN t USING (name, p) GROUP BY 1),
m AS (SELECT 'n' || n_nationkey AS id, n_name AS mention FROM nation UNION ALL SELECT 'p' || p_partkey, p_brand FROM part UNION ALL SELECT 'c' || c_custkey, c_name FROM customer),
x AS (SELECT *, trim(regexp_replace(lower(mention), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS name FROM m)
SELECT id, CASE WHEN k IS NULL THEN 'unresolved' WHEN k > 1 THEN 'ambiguous' ELSE 'exact' END AS resolution, CASE WHEN k = 1 THEN e END AS entity FROM x LEFT JOIN s USING (name)""")
def entity_resolve(spark, sf_dir):
    m = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("mention"))
    m = m.unionByName(read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_brand").alias("mention")))
    m = m.unionByName(read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("mention")))
    return G.resolve(m, entity_names(spark, sf_dir), "mention").select("id", "resolution", "entity")


@query("identity_collisions", f"""WITH n AS (SELECT * FROM ({_NAMES}) WHERE name <> ''), t AS (SELECT name, min(priority) AS priority FROM n GROUP BY 1)
SELECT name, count(DISTINCT entity)::BIGINT AS entities FROM n JOIN t USING (name, priority) GROUP BY 1 HAVING count(DISTINCT entity) > 1""")
def identity_collisions(spark, sf_dir):
    return G.collisions(entity_names(spark, sf_dir))


@query("mention_counts", f"""WITH n AS (SELECT * FROM ({_NAMES}) WHERE name <> '') SELECT name, count_if(priority = 0)::BIGINT AS canonical, count_if(priority = 1)::BIGINT AS alias, count_if(priority = 2)::BIGINT AS title, count_if(priority = 3)::BIGINT AS basename FROM n GROUP BY 1""")
def mention_counts(spark, sf_dir):
    return entity_names(spark, sf_dir).groupBy("name").agg(*(F.count_if(F.col("priority") == i).alias(n) for i, n in enumerate(("canonical", "alias", "title", "basename"))))


_LINKS = """SELECT DISTINCT page_id AS from_page, h AS to_slug FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages) WHERE h <> ''"""


@query("link_extract", _LINKS)
def link_extract(spark, sf_dir):
    return L.html_links(read(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html")


_TARGETS = """SELECT DISTINCT '/' || t AS slug FROM (SELECT unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 1)) AS t FROM documents)"""


def resolved(spark, sf_dir):
    from cairn.functions.text import tokens

    targets = read(spark, sf_dir, "documents", "text").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("t")).distinct().select(F.concat(F.lit("/"), "t").alias("slug"))
    return L.resolve_links(link_extract(spark, sf_dir), targets, "to_slug", "slug")


@query("broken_links", f"SELECT l.from_page, l.to_slug, t.slug IS NULL AS broken FROM ({_LINKS}) l LEFT JOIN ({_TARGETS}) t ON l.to_slug = t.slug")
def broken_links(spark, sf_dir):
    return resolved(spark, sf_dir).select("from_page", "to_slug", "broken")


@query("backlinks", f"SELECT l.to_slug, count(DISTINCT from_page)::BIGINT AS pages FROM ({_LINKS}) l JOIN ({_TARGETS}) t ON l.to_slug = t.slug GROUP BY 1")
def backlinks(spark, sf_dir):
    return L.backlinks(resolved(spark, sf_dir).filter("NOT broken"), "to_slug", "from_page")


@query("fact_status", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'superseded' WHEN least(1, o_totalprice / 100000) < 0.5 THEN 'low_confidence' WHEN o_orderkey % 7 = 0 THEN 'conflict' ELSE 'eligible' END AS status,
 o_orderstatus <> 'F' AND least(1, o_totalprice / 100000) >= 0.5 AND o_orderkey % 7 <> 0 AS traversable FROM orders""")
def fact_status(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_custkey", "o_orderpriority")
    f = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("valid_to"), F.least(F.lit(1.0), F.col("o_totalprice") / 100000).alias("confidence"), (F.col("o_orderkey") % 7 == 0).alias("conflict"), F.col("o_custkey").alias("subject"), predicate(F.col("o_orderpriority")).alias("predicate"))
    return G.fact_status(f).select("o_orderkey", "status", "traversable")


@query("subject_containment", """WITH n AS (SELECT trim(regexp_replace(lower(n_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS name, n_nationkey AS entity FROM nation),
s AS (SELECT c_custkey, trim(regexp_replace(lower(c_name || ' of ' || n_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS subject FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, min(entity) AS entity FROM s JOIN n ON contains(' ' || subject || ' ', ' ' || name || ' ') GROUP BY 1 HAVING count(*) = 1""")
def subject_containment(spark, sf_dir):
    """Longer subjects that hold exactly one entity's name at word boundaries, through a join on the name's words."""
    nation = read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    subjects = c.select("c_custkey", entity_name(F.concat_ws(" of ", "c_name", "n_name")).alias("subject"))
    return L.contained_names(subjects, "c_custkey", "subject", nation.select(F.col("n_nationkey").alias("entity"), entity_name(F.col("n_name")).alias("name")))
