"""K-d tree sharding: weighted medians along the widest metadata dimension. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import drop, number_rows, prefix_sums, save

_DIMS = ("_d0", "_d1", "_d2", "_d3")
#: An item over this share of a leaf is heavy; there are at most leaves / HEAVY of them.
HEAVY = 1 / 8
#: Tasks that share the rows of a value or text that may be hot.
SALTS = 16


def _places(items: DataFrame, c: str, name: str) -> DataFrame:
    """items with the place of the whole string c among its different values, null and '' first."""
    values = items.select(F.coalesce(c, F.lit("")).alias("_v")).distinct()
    places = save(number_rows(values, [], ["_v"], "_n")).select("_v", F.col("_n").cast("double").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = items.withColumns({"_v": F.coalesce(c, F.lit("")), "_salt": F.pmod(F.xxhash64("_h", "_piece"), F.lit(SALTS)).cast("int")})
    return salted.join(places, ["_v", "_salt"]).drop("_v", "_salt", c)


def _split(items: DataFrame, span: list[float], leaf: float) -> tuple[DataFrame, DataFrame]:
    """One level down: every node of k leaves parts at a weighted median along its widest dimension.

    A heavy item goes left if it ends before the median and right if it begins behind it; the one
    that the median cuts goes where it fits, or fits best. Light items then fill the left side up
    to its due weight, in order, so nodes are as even as light items allow.
    """
    # one row for each node of the level, at most as many as leaves: a proven bound
    nodes = items.groupBy("_leaf").agg(F.sum("_w").alias("_total"), F.first("_k").alias("_kk"), *((F.max(d) - F.min(d)).alias(f"_s{d}") for d in _DIMS))
    widths = F.array(*(F.col(f"_s{d}") / F.lit(s) for d, s in zip(_DIMS, span, strict=True)))
    half = F.ceil(F.col("_kk") / 2)
    nodes = nodes.select("_leaf", F.array_position(widths, F.array_max(widths)).cast("int").alias("_dim"), (F.col("_total") * half / F.col("_kk")).alias("_due"), "_total")
    along = items.join(F.broadcast(nodes), "_leaf").withColumns({"_at": F.element_at(F.array(*_DIMS), F.col("_dim")), "_light": F.when(F.col("_w") <= leaf * HEAVY, F.col("_w")).otherwise(0)})
    run = prefix_sums(along, ["_leaf"], ["_at", "_h", "_piece"], {"_before": "_w", "_lights": "_light"})
    heavy = F.col("_light") == 0
    ends, begins = F.col("_before") + F.col("_w") <= F.col("_due"), F.col("_before") >= F.col("_due")
    sum_of = lambda on: F.coalesce(F.sum(F.when(on, F.col("_w"))), F.lit(0))
    cut = run.filter(heavy).groupBy("_leaf").agg(sum_of(ends).alias("_l"), sum_of(begins).alias("_r"), sum_of(~ends & ~begins).alias("_c"), F.first("_due").alias("_d"), F.first("_total").alias("_t"), F.min(F.when(~ends & ~begins, F.col("_before") + F.col("_w") / 2)).alias("_mid"))
    over_left, over_right = F.col("_l") + F.col("_c") - F.col("_d"), F.col("_r") + F.col("_c") - (F.col("_t") - F.col("_d"))
    goes_left = F.when((over_left <= 0) & (over_right <= 0), F.col("_mid") <= F.col("_d")).otherwise(over_left <= over_right)
    cut = cut.select("_leaf", F.coalesce(goes_left, F.lit(False)).alias("_cl"), (F.col("_l") + F.when(goes_left, F.col("_c")).otherwise(0)).alias("_heavies"))
    placed = run.join(F.broadcast(cut), "_leaf", "left")  # at most one row a node
    left = F.ceil(F.col("_k") / 2).cast("int")
    light_left = F.col("_lights") + F.col("_w") / 2 <= F.col("_due") - F.coalesce("_heavies", F.lit(0))
    is_left = (F.col("_k") == 1) | F.when(heavy, ends | (~begins & F.col("_cl"))).otherwise(light_left)
    return run, placed.select("_h", "_piece", "_w", *_DIMS, F.when(is_left, F.col("_leaf")).otherwise(F.col("_leaf") + left).alias("_leaf"), F.when(F.col("_k") == 1, 1).when(is_left, left).otherwise(F.col("_k") - left).cast("int").alias("_k"))


def shard(docs: DataFrame, target_bytes: int | None = None, n_shards: int | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source", lang: str = "lang") -> DataFrame:
    """One row per document: _row, doc_id, size, text_crc32, source, lang, shard and slot.

    Size is the text's UTF-8 bytes plus 1. The number of leaves is n_shards, or all bytes over
    target_bytes. From the root down, a node of k leaves is split where its weight divides as
    ceil(k/2) : floor(k/2), at a weighted median along the dimension of (first doc_id, log2 size,
    source, language) whose spread in the node is widest against the root's (_split()); sources
    and languages lie in the order of their whole strings, and ties along a dimension go by text hash.
    Equal texts move as one item and so share a shard, unless they outweigh a whole leaf, which
    none can hold: such a group, of which there are fewer than leaves, is dealt into pieces of
    half a leaf. Weights before an item come from range-partitioned prefix sums, so no node
    meets in one task, and the written levels survive lost executors.

    Null texts have size 1 and checksum 0, like empty ones; null metadata are smallest; repeated
    rows count each; no rows give no rows; other columns are ignored.
    """
    c = lambda name: F.col(f"`{name}`")
    body = F.coalesce(c(text).cast("string"), F.lit(""))
    base = save(docs.select(F.monotonically_increasing_id().alias("_row"), c(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("_h"), c(source).cast("string").alias("source"), c(lang).cast("string").alias("lang")))
    total = base.agg(F.sum("size")).first()[0] or 0
    leaves = n_shards or max(1, math.ceil(total / target_bytes))
    leaf = max(1.0, total / leaves)
    # fewer than leaves groups weigh over a leaf: a proven bound
    big = base.groupBy("_h").agg(F.sum("size").alias("_w")).filter(F.col("_w") > leaf).select("_h", F.ceil(F.col("_w") / F.lit(leaf / 2)).alias("_pieces"))
    pieced = base.join(F.broadcast(big), "_h", "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_pieces")), F.lit(0)).cast("int"))
    items = save(pieced.groupBy("_h", "_piece").agg(F.sum("size").alias("_w"), F.coalesce(F.min("doc_id").cast("double"), F.lit(0.0)).alias("_d0"), F.log2(F.max("size").cast("double")).alias("_d1"), F.min("source").alias("_source"), F.min("lang").alias("_lang")))
    raw, items = items, save(_places(_places(items, "_source", "_d2"), "_lang", "_d3").withColumns({"_leaf": F.lit(0), "_k": F.lit(leaves)}))
    drop(raw)
    root = items.agg(*(f(d) for d in _DIMS for f in (F.min, F.max))).first()
    span = [max(1e-9, (root[2 * i + 1] or 0.0) - (root[2 * i] or 0.0)) for i in range(len(_DIMS))]
    for _ in range(max(0, math.ceil(math.log2(leaves)))):
        run, split = _split(items, span, leaf)
        old, items = items, save(split)
        drop(old, run)
    # documents whose text is a frequent one bring their shard along by broadcast; there are at most SALTS * leaves such items
    home = items.select("_h", "_piece", F.col("_leaf").alias("shard"), "_w")
    frequent = home.filter(F.col("_w") > leaf / SALTS).drop("_w")
    near = pieced.join(F.broadcast(frequent), ["_h", "_piece"])
    far = pieced.join(F.broadcast(frequent.select("_h", "_piece")), ["_h", "_piece"], "left_anti").join(home.drop("_w"), ["_h", "_piece"])
    kept = ["_row", "doc_id", "size", "text_crc32", "source", "lang", "shard", "_h"]
    out = number_rows(near.select(kept).unionByName(far.select(kept)), ["shard"], [F.col("doc_id").asc_nulls_last(), "_h", "_row"], "_n")
    return out.withColumn("slot", F.col("_n") - 1).drop("_n", "_h")
