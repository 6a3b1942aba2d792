"""Shared tools: tables in the cluster's shared folder, and ranks and prefix sums without one task per group."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the filter that goes before joins of texts.
FILTER_BITS = 1 << 26
#: Bytes of an Arrow batch, where the session has only Spark's default.
BATCH = "4m"
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    It is what ``spark.checkpoint.dir`` names, or the folder set by setCheckpointDir(). Where both
    are unset, a local master gets a temporary folder, which is set as the checkpoint folder, and
    a cluster a folder in its warehouse if that is in a store that all machines see.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        if found := sc.getCheckpointDir():
            return found.rstrip("/")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if "://" not in found or found.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return found + "/_scratch"
    if sc.applicationId not in _LOCAL:
        made = _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="cairn-")
        sc.setCheckpointDir(made)
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return "file://" + _LOCAL[sc.applicationId]


def save(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables made by save() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_cairn_path", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _members(bitmaps):
    def run(batches):
        for batch in batches:
            h = batch.column("_h").to_numpy()
            on = np.ones(len(h), bool)
            for shared, wanted in bitmaps:
                on &= ((np.frombuffer(shared.value, np.int64)[h >> 6] >> (h & 63)) & 1) == wanted
            yield batch.filter(pa.array(on))

    return run


def _place(c: str) -> Column:
    return F.pmod(F.xxhash64(F.col(c)), F.lit(FILTER_BITS))


def _bitmap(ids: DataFrame, key: str):
    """Broadcast bits of the ids' hashes: FILTER_BITS / 8 bytes, whatever their number."""
    bits = ids.select(_place(key).alias("_h")).groupBy(F.shiftright("_h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(_h & 63))")).alias("b")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[bits.column("w").to_numpy()] = bits.column("b").to_numpy()
    return ids.sparkSession.sparkContext.broadcast(words.tobytes())


def _passed(rows: DataFrame, key: str, bitmaps: list) -> DataFrame:
    bound_batches(rows.sparkSession)
    marked = rows.withColumn("_h", _place(key))
    return marked.mapInArrow(_members(bitmaps), marked.schema).drop("_h")


def likely(rows: DataFrame, ids: DataFrame, key: str, other: str) -> DataFrame:
    """rows whose key may be among ids: a bitmap of FILTER_BITS hashes drops most others before a join deals long rows out.

    None that belongs is dropped; the exact join is the caller's. Rows are those of a name of this subpackage.
    """
    return _passed(rows, key, [(_bitmap(ids, other), 1)])


def among(rows: DataFrame, ids: DataFrame, key: str, other: str, run, schema: str) -> DataFrame:
    """mapInArrow(run, schema) of the rows whose key is among the distinct ids; only doubtful rows are dealt out for a join.

    One bitmap holds the ids, a second the keys of rows that pass it wrongly: a row that the
    first passes and the second does not belongs for sure. At any number of ids the result is
    exact; the fuller the bitmaps, the more rows go through the join. Batches are filtered in
    the worker that runs ``run``.
    """
    first = _bitmap(ids, other)
    wrong = _passed(rows.select(key), key, [(first, 1)]).join(ids, F.col(key) == F.col(other), "left_anti")
    second = _bitmap(wrong, key)
    doubtful = _passed(rows, key, [(first, 1), (second, 1)]).join(ids, F.col(key) == F.col(other), "left_semi").mapInArrow(run, schema)
    members = _members([(first, 1), (second, 0)])
    return rows.filter(F.col(key).isNotNull()).withColumn("_h", _place(key)).mapInArrow(lambda batches: run(members(batches)), schema).unionByName(doubtful)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound_batches(spark: SparkSession) -> None:
    """Texts are long: Arrow batches of at most BATCH bytes bound the memory of Python workers.

    Spark's own default, and nothing else, is lowered; a bound that the session's owner set stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def kept(key, make):
    """What make() gives for the key, once in the life of a Python worker (functions sent to it are new for each task)."""
    held = sys.modules.setdefault("_cairn_kept", types.ModuleType("_cairn_kept")).__dict__.setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(df: DataFrame) -> Column:
    """All columns of df in one struct, so that none clashes with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def _ordered(df: DataFrame, keys: list) -> DataFrame:
    """Range-partitioned by keys and written, with _m: rises with the order; _p: its partition."""
    out = df.repartitionByRange(parts(df.sparkSession), *keys).sortWithinPartitions(*keys)
    out = save(out.withColumn("_m", F.monotonically_increasing_id()))
    path, out = out._cairn_path, out.withColumn("_p", F.shiftright("_m", 33).cast("int"))
    out._cairn_path = path
    return out


def number_rows(df: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """``name``: the row's number from 1 within its group, by order. Group columns hold no nulls.

    The rows are dealt by range over group and order, so a group of any size spreads over many
    tasks; only one row for each group and partition is gathered to add up offsets.
    """
    rows = _ordered(df, [*group, *order])
    first = rows.groupBy(*group, "_p").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select(*group, "_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    out = rows.join(first, [*group, "_p"]).withColumn(name, F.col("_m") + F.col("_shift")).drop("_m", "_p", "_shift")
    out._cairn_path = rows._cairn_path
    return out


def prefix_sums(df: DataFrame, group: list[str], order: list, sums: dict[str, str]) -> DataFrame:
    """For each ``new: old`` of sums, the sum of old over the rows before this one in its group."""
    rows = _ordered(df, [*group, *order])
    part = rows.groupBy(*group, "_p").agg(*(F.sum(old).alias(f"_s{i}") for i, old in enumerate(sums.values())))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*group, "_p", *(F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))))
    within = Window.partitionBy(*group, "_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(part, [*group, "_p"]).withColumns({new: F.col(f"_b{i}") + F.coalesce(F.sum(old).over(within), F.lit(0)) for i, (new, old) in enumerate(sums.items())})
    out = out.drop("_m", "_p", *(f"_b{i}" for i in range(len(sums))))
    out._cairn_path = rows._cairn_path
    return out
