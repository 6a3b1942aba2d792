"""Evidence graph: nodes and edges, exact entity resolution, bounded traversal, hubs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import entity_name, stable_id

#: Fan-out of one node, paths of one answer, hops at most.
FAN_OUT, PATHS, HOPS = 50, 30, 3
#: Signals of a name, strongest first.
SIGNALS = ("canonical_slug", "alias", "title", "basename")


def node_id(kind: str | Column, source: Column) -> Column:
    return stable_id("gnd_", 24, F.lit(kind) if isinstance(kind, str) else kind, source.cast("string"))


def edge_id(start: Column, end: Column, relation: Column, *locator: Column) -> Column:
    return stable_id("ged_", 24, start, end, relation, *locator)


def edges_of(df: DataFrame, start: Column, end: Column, relation: str, confidence: Column | float = 1.0) -> DataFrame:
    """(id, from_node, to_node, relation, confidence): one edge a row; equal edges have equal ids."""
    c = F.lit(confidence) if isinstance(confidence, float) else confidence
    e = df.select(start.alias("from_node"), end.alias("to_node"), F.lit(relation).alias("relation"), c.cast("double").alias("confidence"))
    return e.select(edge_id(F.col("from_node"), F.col("to_node"), F.col("relation")).alias("id"), "*")


def build(nodes: Sequence[DataFrame], edges: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes by id, and edges by id with both ends among the nodes; of equal edges the surest stays."""
    from functools import reduce

    n = reduce(DataFrame.unionByName, nodes).dropDuplicates(["id"])
    e = reduce(DataFrame.unionByName, edges).groupBy("id", "from_node", "to_node", "relation").agg(F.max("confidence").alias("confidence"))
    ids = n.select("id")
    for end in ("from_node", "to_node"):
        e = e.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return n, e.select("id", "from_node", "to_node", "relation", "confidence")


def degrees(edges: DataFrame, built: bool = False) -> DataFrame:
    """(node, degree): incident edges, each counted once. Those that build() gives have each id once, and are counted where they are."""
    if built:
        both = F.when(F.col("from_node") == F.col("to_node"), F.array("from_node")).otherwise(F.array("from_node", "to_node"))
        return edges.select(F.explode(both).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    ends = edges.select(F.col("from_node").alias("node"), "id").unionByName(edges.filter("from_node <> to_node").select(F.col("to_node").alias("node"), "id"))
    return ends.groupBy("node").agg(F.count_distinct("id").alias("degree"))


def hubs(edges: DataFrame, more_than: int = FAN_OUT, built: bool = False) -> DataFrame:
    return degrees(edges, built).filter(F.col("degree") > more_than)


def _adjacent(frontier: DataFrame, edges: DataFrame, direction: str, fan_out: int) -> DataFrame:
    """Edges at the frontier's nodes, per node the ``fan_out`` surest (then by relation and id)."""
    out = edges.select(F.col("from_node").alias("node"), F.col("to_node").alias("next"), "id", "relation", "confidence")
    back = edges.select(F.col("to_node").alias("node"), F.col("from_node").alias("next"), "id", "relation", "confidence")
    both = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    # the frontier is bounded by PATHS rows of each seed; only edges that touch it are numbered
    near = both.join(F.broadcast(frontier.select("node").distinct()), "node", "left_semi").dropDuplicates(["node", "id"])
    order = Window.partitionBy("node").orderBy(F.col("confidence").desc(), "relation", "id")
    return near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= fan_out)


def traverse(edges: DataFrame, seeds: DataFrame, hops: int = 2, direction: str = "both", relations: Sequence[str] = (), limit: int = PATHS, fan_out: int = FAN_OUT) -> DataFrame:
    """(seed, node, hop, confidence, path): bounded breadth-first discovery from each seed node.

    A node is reached once per seed, by the first that comes in the order of its parent's
    discovery and then of the edge's confidence, relation and id. A path's confidence is the
    product of its edges', to four decimals at each step. At most ``limit`` paths are returned,
    in the order of seeds, hops and discovery. Seeds are a short list.
    """
    spark = edges.sparkSession
    if relations:
        edges = edges.filter(F.col("relation").isin(*relations))
    # every hop reads the edges: kept in memory, or on disk where they do not fit
    held = edges.select("id", "from_node", "to_node", "relation", "confidence").persist()
    try:
        return _levels(spark, held, seeds, hops, direction, limit, fan_out)
    finally:
        held.unpersist()


def _levels(spark, edges: DataFrame, seeds: DataFrame, hops: int, direction: str, limit: int, fan_out: int) -> DataFrame:
    kind = "seed string, node string, confidence double, path array<string>, _at long"
    level = [(r["seed"], r["seed"], 1.0, [r["seed"]], 0) for r in seeds.select("seed").distinct().collect()]
    seen = {(s, n) for s, n, *_ in level}
    found = []
    for hop in range(1, hops + 1):
        # a level holds at most ``limit`` rows of each seed, so it may come to the driver
        frontier = spark.createDataFrame(level, kind)
        near = _adjacent(frontier, edges, direction, fan_out)
        step = near.join(F.broadcast(frontier.withColumnRenamed("confidence", "_sure")), "node")
        known = spark.createDataFrame(sorted(seen), "seed string, next string")
        fresh = step.join(F.broadcast(known), ["seed", "next"], "left_anti")
        fresh = fresh.withColumn("_f", F.row_number().over(Window.partitionBy("seed", "next").orderBy("_at", "_n"))).filter("_f = 1")
        level_ = fresh.withColumn("_o", F.row_number().over(Window.partitionBy("seed").orderBy("_at", "_n")).cast("long")).filter(F.col("_o") <= limit)
        got = level_.select("seed", F.col("next").alias("node"), F.round(F.col("_sure") * F.col("confidence"), 4).alias("confidence"), F.array_append("path", F.col("next")).alias("path"), "_o").collect()
        level = [tuple(r) for r in got]
        found += [(s, n, hop, c, p, o) for s, n, c, p, o in level]
        seen |= {(s, n) for s, n, *_ in level}
        if not level:
            break
    out = sorted(found, key=lambda r: (r[0], r[2], r[5]))[:limit]
    return spark.createDataFrame([r[:5] for r in out], "seed string, node string, hop int, confidence double, path array<string>")


def names(pages: DataFrame, entity: str, **signals: str) -> DataFrame:
    """(name, entity, signal, priority) of each entity's names by signal; empty ones are dropped."""
    pairs = F.array(*(F.struct(F.lit(s).alias("signal"), F.lit(SIGNALS.index(s)).alias("priority"), entity_name(F.col(c)).alias("name")) for s, c in signals.items()))
    rows = pages.select(F.col(entity).alias("entity"), F.explode(pairs).alias("x")).select("entity", "x.*")
    return rows.filter(F.col("name") != "").distinct()


def resolve(mentions: DataFrame, name_table: DataFrame, mention: str) -> DataFrame:
    """Mentions with ``resolution`` exact, ambiguous or unresolved, and the entity where exact.

    Among the entities of a name those with the strongest signal count; more than one of those
    is ambiguous, and then no entity is named.
    """
    best = name_table.groupBy("name", "entity").agg(F.min("priority").alias("priority"))
    top = best.groupBy("name").agg(F.min("priority").alias("_p"))
    strong = best.join(top, "name").filter(F.col("priority") == F.col("_p")).groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("entity").alias("_e"))
    out = mentions.withColumn("name", entity_name(F.col(mention))).join(strong, "name", "left")
    kind = F.when(F.col("_n").isNull(), "unresolved").when(F.col("_n") > 1, "ambiguous").otherwise("exact")
    return out.withColumn("resolution", kind).withColumn("entity", F.when(F.col("_n") == 1, F.col("_e"))).drop("_n", "_e")


def collisions(name_table: DataFrame) -> DataFrame:
    """Names whose strongest signal names more than one entity."""
    order = Window.partitionBy("name")
    best = name_table.withColumn("_p", F.min("priority").over(order)).filter("priority = _p")
    return best.groupBy("name").agg(F.count_distinct("entity").alias("entities")).filter("entities > 1")


def fact_status(facts: DataFrame) -> DataFrame:
    """facts with status and traversable: superseded, low_confidence, conflict, eligible."""
    status = F.when(F.col("valid_to").isNotNull(), "superseded").when(F.col("confidence") < 0.5, "low_confidence").when(F.col("conflict"), "conflict").otherwise("eligible")
    return facts.withColumn("status", status).withColumn("traversable", (F.col("status") == "eligible") & F.col("subject").isNotNull() & F.col("predicate").isNotNull())


def completeness(nodes: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """(kind, rows, nodes, complete): base rows against graph nodes by kind."""
    from functools import reduce

    base = reduce(DataFrame.unionByName, (d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("kind"), "rows") for k, d in sources.items()))
    have = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"))
    out = base.join(have, "kind", "left").select("kind", "rows", F.coalesce("nodes", F.lit(0)).cast("long").alias("nodes"))
    return out.withColumn("complete", F.col("rows") == F.col("nodes"))


#: What an authored type means for an entity; all else is other.
ENTITY_TYPES = {"person": ("person",), "organization": ("organization", "organisation", "company", "business"), "place": ("place", "location", "city", "country"), "product": ("product", "device"), "event": ("event",), "concept": ("concept", "topic")}


def entity_type(value: Column) -> Column:
    """The entity type that an authored type stands for."""
    name, out = entity_name(F.coalesce(value, F.lit(""))), F.lit("other")
    for kind, words in ENTITY_TYPES.items():
        out = F.when(name.isin(*words), kind).otherwise(out)
    return out


def hydrate(nodes: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """nodes (id, kind, source_id) with what they stand for: one left join for each kind's table, keyed by ``source_id``.

    The tables' other columns become one struct named by the kind, null on nodes of other kinds
    and where the row is gone. Each join carries the kind in its key, so that it meets only its own nodes.
    """
    out = nodes
    for kind, table in sources.items():
        rest = F.struct(*(c for c in table.columns if c != "source_id")).alias(kind)
        own = table.select(F.col("source_id").alias("_id"), rest)
        out = out.join(own, (F.col("kind") == kind) & (F.col("source_id") == F.col("_id")), "left").drop("_id")
    return out


def names_in(query: str, names: DataFrame, least: int = 3) -> list[tuple[str, int, int]]:
    """(name, start, end) of entity names inside a query: whole words, longest first, none over another.

    names has name and normalized. The cluster keeps only names that are runs of the query's own
    words, so the driver gets at most as many as the query has such runs.
    """
    text = " ".join("".join(c if c.isalnum() else " " for c in query.lower()).split())
    words = text.split()
    runs = sorted({" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)})
    if not runs:
        return []
    found = names.filter(F.col("normalized").isin(*runs) & (F.length("normalized") >= least)).groupBy("normalized").agg(F.min("name").alias("name")).collect()
    taken: set[int] = set()
    out = []
    for r in sorted(found, key=lambda r: (-len(r["normalized"]), r["normalized"])):
        n = len(r["normalized"].split())
        # places in words: a run of words cannot begin or end inside one
        at = next((i for i in range(len(words) - n + 1) if words[i : i + n] == r["normalized"].split() and taken.isdisjoint(range(i, i + n))), None)
        if at is not None:
            taken.update(range(at, at + n))
            start = len(" ".join(words[:at])) + (at > 0)
            out.append((r["name"], start, start + len(r["normalized"])))
    return sorted(out, key=lambda x: x[1:])
