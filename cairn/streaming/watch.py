"""Continuous input: a watched folder, and a replay-safe ledger of requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, root: str, index: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """New files below root, in micro-batches, to ``index``; what was handled is in the checkpoint.

    A path is read once; follow() also sees files that change, move or go.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    writer = files.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def follow(spark: SparkSession, root: str, target: str, checkpoint: str, every: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Keep the tables of ``target`` like the folder: at each tick the tree is compared with the last complete version.

    Where a file was added, changed, moved or removed a new version is written from the old one
    and the changed pages only (plans.index); otherwise nothing is. A version counts once its
    last table is complete, so a tick that was cut short is simply done again.
    """
    from cairn.plans import index as I

    def tick(_: DataFrame, number: int) -> None:
        before = I.latest(spark, target)
        if before is None or I.stale(spark, root, target, before):
            I.index(spark, root, target, (before or 0) + 1, before)

    # one row a trigger; the source rate has none within its first second, and then no batch is run
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _decide(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    first = state.get[0] if state.exists else None
    # the order of arrival within a micro-batch is chance: requests are taken by number
    rows = pd.concat([b[["request", "digest"]] for b in batches]).sort_values(["request", "digest"])
    out = []
    for request, digest in zip(rows["request"], rows["digest"], strict=True):
        if first is None:
            first, outcome = digest, "accepted"
        else:
            outcome = "replay" if digest == first else "conflict"
        out.append((*key, request, outcome))
    yield pd.DataFrame(out, columns=["actor", "op", "key", "request", "outcome"])
    if first is not None:
        state.update((first,))


def replay_stream(requests: DataFrame) -> DataFrame:
    """(actor, op, key, request, outcome) of a stream of (actor, op, key, request, digest): exact, and without expiry.

    The first request of a key, by number within a micro-batch, is accepted; one with the same digest replays it, another
    conflicts. The state holds one digest for each key; a watermark would forget it.
    """
    out = "actor string, op string, key string, request long, outcome string"
    return requests.groupBy("actor", "op", "key").applyInPandasWithState(_decide, out, "digest string", "append", "NoTimeout")


def index_batches(target: str, root: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that parses pages and replaces the batch's own folder, so that a repeated batch changes nothing.

    With ``root`` pages are named by their path below it, else by their file name.
    """
    from pyspark.sql import functions as F

    from cairn.sources import markdown

    def run(batch: DataFrame, number: int) -> None:
        name = F.regexp_replace("path", "^.*/", "") if root is None else markdown.below(root)
        files = batch.select("path", name.alias("rel_path"), F.lit("page").alias("kind"), "content").filter(F.lower("path").endswith(".md"))
        markdown.chunks(markdown.pages(files)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return run
