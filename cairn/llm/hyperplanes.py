"""Embedding near-duplicates: random-hyperplane sign tables, exact cosine, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import blocks
from cairn.llm.common import bound_batches, drop, save
from cairn.llm.components import components

COSINE, RECALL, SEED = 0.9, 0.995, 11
SIGMAS = 5.5


def table_plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits to a table, so that unlike vectors share buckets of about eight, and tables for the recall at the threshold."""
    bits = max(8, math.ceil(math.log2(max(2, n))) - 3)
    p = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p))


def _matrix(column) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _signer(bits: int, tables: int, dim: int):
    """Packed sign bits of all tables, and each table's bucket."""

    def run(batches):
        planes = np.random.default_rng(SEED).standard_normal((dim, bits * tables))
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("_v"))
            on = x / np.abs(x).max(axis=1, keepdims=True) @ planes > 0
            key = on.reshape(len(x), tables, bits) @ powers + (np.arange(tables, dtype=np.int64) << 40)
            packed = np.packbits(on, axis=1)
            at = np.arange(len(x) + 1, dtype=np.int32) * tables
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(key.ravel(), pa.int64())), pa.array([r.tobytes() for r in packed], pa.binary())], ["node", "keys", "signs"])

    return run


def _pairs(bits: int, tables: int, cosine: float):
    """Pairs of a bucket whose signs agree enough, each in the first table that holds both."""

    def run(batches):
        p = math.acos(cosine) / math.pi
        most = (p + SIGMAS * (p * (1 - p) / (bits * tables)) ** 0.5) * bits * tables
        for t in blocks.groups(batches, ["k", "_i", "_j"]):
            if len(t) < 2:
                continue
            node, b = t.column("node").to_numpy(), t.column("_b").to_numpy()
            signs = np.frombuffer(b"".join(t.column("signs").to_pylist()), np.uint8).reshape(len(node), -1)
            table = t.column("k")[0].as_py() >> 40
            i, j = t.column("_i")[0].as_py(), t.column("_j")[0].as_py()
            rows, cols = np.flatnonzero(b == i), np.flatnonzero(b == j)
            us, vs = [], []
            for r in rows:
                c = cols[node[cols] > node[r]] if i == j else cols
                d = signs[c] ^ signs[r]
                near = np.bitwise_count(d).sum(axis=1, dtype=np.int64) <= most
                c, d = c[near], d[near]
                if len(c) and table:
                    differ = np.unpackbits(d, axis=1, count=bits * tables)[:, : table * bits].reshape(len(c), table, bits).any(axis=2)
                    c = c[differ.all(axis=1)]
                us.append(np.maximum(node[c], node[r]))
                vs.append(np.minimum(node[c], node[r]))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], ["u", "v"])

    return run


def _cosine(cosine: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column("vx")), _matrix(batch.column("vy"))
            x, y = (m / np.abs(m).max(axis=1, keepdims=True) for m in (x, y))
            c = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(c >= cosine))

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Rows link where the cosine of their vectors, in double precision, is at least ``cosine``.
    Equal vectors become one node that counts as often as it occurs. Each node falls into a
    bucket of every sign table; the pairs of a bucket are compared in blocks of bounded size by
    all their signs, a pair is passed on by the first table only that holds both, and its
    cosine is then taken from the vectors. At the threshold the tables find a pair with
    probability ``recall``, above it with more; no pair below is linked.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors
    of different lengths never link; null vec_ids take part in links, and alone they have a
    null component and are kept; repeated rows count each; no rows give no rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    fine = F.col("_v").isNotNull() & (F.size("_v") > 0) & F.coalesce(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("_v", lambda x: x != 0), F.lit(False))
    rows = save(vectors.select(F.monotonically_increasing_id().alias("_row"), F.col(vec_id).cast("long").alias("vec_id"), v.alias("_v")).withColumn("_ok", fine))
    keyed = rows.withColumn("_key", F.when(F.col("_ok"), F.sha2(F.concat_ws(",", F.transform("_v", lambda x: (x + 0.0).cast("string"))), 256)))
    nodes = save(keyed.filter("_ok").groupBy("_key").agg(F.min("_row").alias("node"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("_v").alias("_v")))
    sizes = nodes.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each length of vectors
    links = None
    for d, n in ((r["d"], r["n"]) for r in sizes):
        bits, tables = table_plan(n, cosine, recall)
        same = nodes.filter(F.size("_v") == d)
        signed = save(same.select("node", "_v").mapInArrow(_signer(bits, tables, d), "node long, keys array<long>, signs binary"))
        placed = signed.select("node", "signs", F.explode("keys").alias("k"))
        counts = placed.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        near = blocks.deal(placed.join(counts, "k"), "k", "c", "node").select("k", "_i", "_j", "_b", "node", "signs").mapInArrow(_pairs(bits, tables, cosine), "u long, v long")
        x, y = (same.select(F.col("node").alias(a), F.col("_v").alias(b)) for a, b in (("u", "vx"), ("v", "vy")))
        got = save(near.join(x, "u").join(y, "v").mapInArrow(_cosine(cosine), "u long, v long"))
        drop(signed)
        links = got if links is None else links.unionByName(got)
    if links is None:
        links = spark.createDataFrame([], "u long, v long")
    found = components(links)
    times = nodes.select("node", "n")
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = both.join(times.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("_deg"))
    known = nodes.select("_key", "node", "n", "low").join(found, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = known.groupBy("component").agg(F.min("low").alias("_low"))
    known = known.join(lows, "component").select("_key", "_low", (F.col("n") - 1 + F.coalesce("_deg", F.lit(0))).alias("n_links"))
    out = keyed.select("vec_id", "_key").join(known, "_key", "left")
    least = F.when(F.col("_key").isNotNull(), F.col("_low")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"), F.col("vec_id").eqNullSafe(least).alias("kept"))
