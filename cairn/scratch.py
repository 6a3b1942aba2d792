"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names, or the checkpoint folder that is set; where both are unset, a temporary one of a local master."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    sc = spark.sparkContext
    if found := sc.getCheckpointDir():
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL:
        made = _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return "file://" + _LOCAL[sc.applicationId]


def keep(df: DataFrame) -> DataFrame:
    """df written there and read again: later steps neither repeat nor replan it, and lost executors cost a reread."""
    path = f"{folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows to a task, about, where memory must not grow with the input.
ROWS = 1 << 20


def parts(rows: DataFrame, each: int = ROWS) -> int:
    """Partitions of about ``each`` rows, and no fewer than the session's: given as a number they are not put together by their bytes."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))
