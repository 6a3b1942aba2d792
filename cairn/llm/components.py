"""Connected components by rounds of parent jumps and of forests found inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import drop, save

#: Links that a task joins at a time.
CHUNK = 1 << 18


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links that is not the least of its component, in ascending order, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(x):
        a, b = root[x], root[y]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        on = root[x] != root[y]
        x, y = x[on], y[on]
    on = root != np.arange(len(nodes))
    return nodes[on], nodes[root[on]]


def _forests(batches):
    """Links with the same components, fewer than there are nodes in a chunk; the last u of a chunk goes on into the next."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        n += batch.num_rows
        if n >= CHUNK:
            last = held[-1][0][-1]
            u, v = forest(*map(np.concatenate, zip(*held, strict=True)))
            on = u == last
            yield pa.RecordBatch.from_arrays([pa.array(u[~on]), pa.array(v[~on])], ["u", "v"])
            held, n = [(u[on], v[on])], int(on.sum())
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held, strict=True)))], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in links (u, v): component is the least node that can be reached.

    Each task first replaces its links by a forest with the same components, in which every node
    but the least of a tree points to that one, so that a node has at most one link for each task.
    While a node still has two links, or is pointed to and points on, a round replaces every link
    to a node by one to the least node that this one points to, deals the links out by the node
    they start from and takes forests again. No round makes links more, each ends with smaller
    ones, and about log2 of the longest path are needed. Each is written to the shared folder.
    The join of a round is between written tables, so Spark can split the links to a hub.
    Loops and repeated links are harmless; no links give no rows.
    """
    now = save(edges.filter("u IS NOT NULL AND v IS NOT NULL").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(_forests, "u long, v long"))
    while True:
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("_up"), F.lit(0).alias("_down")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("_up"), F.lit(1).alias("_down")))
        if not ends.groupBy("node").agg(F.sum("_up").alias("_up"), F.max("_down").alias("_down")).filter("_up > 1 OR _up = 1 AND _down = 1").count():
            break
        least = save(now.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("v"), "_m"))
        old, jumped = now, now.join(least, "v", "left").select("u", F.coalesce("_m", "v").alias("v"))
        now = save(jumped.repartition("u").sortWithinPartitions("u").mapInArrow(_forests, "u long, v long"))
        drop(old, least)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
