"""Further retrieval arms: facts located in chunks, and pages reached over the evidence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import graph as G
from cairn.operators.retrieval import RRF_K

#: Facts that one chunk may add unmatched, page seeds, targets of the graph arm.
UNMATCHED, SEEDS, TARGETS = 3, 3, 30


def locate(facts: DataFrame, chunks: DataFrame, limit: int = 60) -> DataFrame:
    """(chunk, fact, rank, line): ranked facts (fact, page, line, rank) in the chunks that hold their line, best first, up to a limit."""
    c = chunks.select("page", "chunk", "line_start", "line_end")
    inside = facts.join(c, "page").filter(F.col("line").between(F.col("line_start"), F.col("line_end")))
    return inside.orderBy("rank", "fact", "chunk").limit(limit).select("chunk", "fact", "rank", "line")


def fact_chunks(located: DataFrame) -> DataFrame:
    """(chunk, rank, lines): chunks in the order of their best fact, with the lines of all of them."""
    by = located.groupBy("chunk").agg(F.min("rank").alias("best"), F.sort_array(F.collect_set("line")).alias("lines"))
    return by.withColumn("rank", F.row_number().over(Window.orderBy("best", "chunk"))).select("chunk", "rank", "lines")


def target_lines(hits: DataFrame, located: DataFrame, most: int = 3) -> DataFrame:
    """hits in their order with ``lines``: matched lines of the chunk, best fact first. Membership is unchanged."""
    order = Window.partitionBy("chunk").orderBy("rank", "line")
    top = located.groupBy("chunk", "line").agg(F.min("rank").alias("rank")).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    lines = top.groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]).alias("lines"))
    return hits.join(lines, "chunk", "left")


def fact_list(facts: DataFrame, chunk_ranks: DataFrame, facts_of_chunk: DataFrame, k: int = RRF_K) -> DataFrame:
    """(fact, score): a fact earns 1 / (k + rank) once from its own rank and once from its best chunk's.

    A chunk passes credit to its matched facts and to at most UNMATCHED others, the surest first.
    """
    matched = facts.select("fact", F.lit(True).alias("_m"))
    inside = facts_of_chunk.join(chunk_ranks.select("chunk", F.col("rank").alias("_c")), "chunk").join(matched, "fact", "left")
    order = Window.partitionBy("chunk").orderBy(F.col("confidence").desc(), "fact")
    rest = inside.filter("_m IS NULL").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= UNMATCHED).drop("_n")
    via = inside.filter("_m").unionByName(rest).groupBy("fact").agg((F.lit(1.0) / (k + F.min("_c"))).alias("s"))
    own = facts.select("fact", (F.lit(1.0) / (k + F.col("rank"))).alias("s"))
    return own.unionByName(via).groupBy("fact").agg(F.round(F.sum("s"), 9).alias("score"))


def qualified_seeds(hits: DataFrame, terms: list[str], words: str = "words", most: int = SEEDS) -> DataFrame:
    """Lexical hits fit to start a walk from: relevance 0.5 or more where there is one, and two of the query's terms (or its only one)."""
    held = F.size(F.array_intersect(words, F.array(*(F.lit(t) for t in terms))))
    fit = hits.filter((F.col("relevance").isNull() | (F.col("relevance") >= 0.5)) & (held >= min(2, len(terms))))
    return fit.orderBy("rank").limit(most)


def graph_arm(edges: DataFrame, seeds: DataFrame, targets: DataFrame, hops: int = 2, limit: int = TARGETS) -> DataFrame:
    """(item, score, rank): retrieval items at the nodes that a bounded walk reaches, by the surest path. targets: (node, item)."""
    reached = G.traverse(edges, seeds, hops=hops)
    best = reached.join(targets, "node").groupBy("item").agg(F.max("confidence").alias("score"))
    top = best.orderBy(F.col("score").desc(), "item").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "item")))


def page_chunk(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(page, line, chunk): the chunk that holds the line, else the page's first."""
    c = chunks.select("page", "chunk", "ord", "line_start", "line_end")
    away = F.when(F.col("line").between(F.col("line_start"), F.col("line_end")), 0).otherwise(1)
    return targets.join(c, "page").groupBy("page", "line").agg(F.min_by("chunk", F.struct(away.alias("a"), F.col("ord").alias("o"))).alias("chunk"))
