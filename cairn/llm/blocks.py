"""Groups of any size compared in bounded blocks inside Arrow tasks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group in one block: a task holds two blocks at a time.
BLOCK = 1024


def deal(rows: DataFrame, key: str, count: str, node: str) -> DataFrame:
    """Rows of groups of ``count``, dealt so that any two rows of a group meet in one block pair (_i, _j)."""
    n = F.ceil(F.col(count) / F.lit(BLOCK)).cast("int")
    b = F.pmod(F.xxhash64(node), n).cast("int")
    pair = F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.struct(F.least(x, b).alias("i"), F.greatest(x, b).alias("j")))
    dealt = rows.withColumn("_b", b).withColumn("_pair", F.explode(pair)).withColumns({"_i": F.col("_pair.i"), "_j": F.col("_pair.j")}).drop("_pair")
    spread = dealt.repartition(key, "_i", "_j")
    return spread.sortWithinPartitions(key, "_i", "_j")


def groups(batches, keys: list[str]):
    """Tables of equal keys from sorted record batches; a group may span batches."""
    held = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        at = list(zip(*cols, strict=True))
        start = 0
        for end in range(1, len(at) + 1):
            if end == len(at) or at[end] != at[start]:
                if held and last != at[start]:
                    yield pa.Table.from_batches(held)
                    held = []
                last = at[start]
                held.append(batch.slice(start, end - start))
                start = end
    if held:
        yield pa.Table.from_batches(held)
