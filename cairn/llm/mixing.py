"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import drop, n_words, number_rows, packed, prefix_sums, save

SEED = 20_240_611


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Targets of (_null, _src, source_size) rows by filling up to a common level.

    Sources by code point, null last, get the weights in turn and share ``share`` times all
    sizes in proportion. A target stops at ``cap`` times its source's size; what is over goes to
    the others by weight until no target is above. Equivalently every target is
    min(cap * size, level * weight), and the level follows from sums over the sources in the
    order of cap * size / weight.
    """
    n = len(weights)
    ranked = number_rows(sizes, [], ["_null", "_src"], "_pos")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("_pos") - 1, F.lit(n)) + 1).cast("int"))
    capped = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    run = save(prefix_sums(capped.withColumn("_ratio", F.col("_cap") / F.col("_w")), [], ["_ratio", "_pos"], {"_caps": "_cap", "_ws": "_w"}))
    total, w = run.agg(F.sum("source_size"), F.sum("_w")).first()
    if not total:
        return run.select("_null", "_src", "source_size", F.lit(0.0).alias("target"))
    at = (F.lit(total * share) - F.col("_caps")) / (F.lit(w) - F.col("_ws"))
    level = run.agg(F.min(F.when(F.col("_cap") > at * F.col("_w"), F.struct("_ratio", "_pos", at.alias("level"))))["level"]).first()[0]
    target = F.col("_cap") if level is None else F.least(F.col("_cap"), F.lit(level) * F.col("_w"))
    return run.select("_null", "_src", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id", carry: Sequence[str] | None = None) -> DataFrame:
    """Every row of docs, or its columns ``carry``, with __size, __source_size, __target, __copies and __taken.

    A document's expected copies are its source's target over its source's size, at most
    ``cap``. The prefix sum of these within the source, from the largest document down, plus
    one random offset of the source (a hash of the seed) crosses an integer boundary once for
    each copy. In that order the words taken from a source differ from its target by less than
    its largest document. Rates are equal within a source, so the prefix sum is the document's
    rank times the rate: exact, and the same in every run.

    Null and empty texts have size 0 and are copied like others, at 0 words; a null source is a
    source of its own, after the others; ties in size go by doc_id, then by the text's hash;
    repeated rows are separate documents; no rows give no rows; a source of size 0 is not taken;
    columns of docs that are named like those added are replaced.
    """
    planned = _planned(docs, weights, share, cap, seed, text, source, doc_id, carry)
    own = ["__size", "__source_size", "__target", "__copies", "__taken"]
    kept = [c for c in (docs.columns if carry is None else carry) if c not in own]
    return planned.select(*(F.col(f"_doc.`{c}`") for c in kept), *own)


def _planned(docs: DataFrame, weights, share, cap, seed, text, source, doc_id, carry) -> DataFrame:
    """plan_mix() with the carried columns in one struct, _doc."""
    some = docs if carry is None else docs.select(*(f"`{c}`" for c in carry))
    c = lambda name: F.col(f"`{name}`")
    body = c(text).cast("string")
    keyed = docs.select(packed(some).alias("_doc"), c(doc_id).alias("_id"), c(source).isNull().alias("_null"), F.coalesce(c(source).cast("string"), F.lit("")).alias("_src"), n_words(body).alias("__size"), F.md5(F.coalesce(body, F.lit(""))).alias("_hash"))
    if carry is not None:
        keyed = save(keyed)  # texts are read once
    sizes = save(keyed.groupBy("_null", "_src").agg(F.sum("__size").alias("source_size")))
    targets = source_targets(sizes, weights, share, cap)
    ranked = number_rows(keyed, ["_null", "_src"], [F.col("__size").desc(), F.col("_id").asc_nulls_last(), F.col("_hash")], "_rank")
    placed = ranked.join(targets.withColumnsRenamed({"source_size": "__source_size", "target": "__target"}), ["_null", "_src"])
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.when(F.col("_null"), "n").otherwise("s"), F.col("_src"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    copies = F.floor(F.col("_rank") * rate + offset) - F.floor((F.col("_rank") - 1) * rate + offset)
    drop(sizes, keyed)
    return placed.withColumn("__copies", copies.cast("long")).withColumn("__taken", F.col("__copies") * F.col("__size"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mixed corpus: docs' own columns, whatever their names, each row as often as plan_mix() takes it."""
    planned = _planned(docs, weights, share, cap, seed, text, source, doc_id, None)
    return planned.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("_doc.*")
