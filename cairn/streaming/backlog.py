"""A queue of deferred work as a stream: keyed state with timers, retries and growing pauses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the queue says of a key: done, failed (and when it is tried again), or given up.
OUT = "key string, revision long, tries int, outcome string, result string, due_ms long"


class Backlog(StatefulProcessor):
    """Work for each key: the newest revision that was asked for, tried until it is done or ``most`` tries failed.

    A revision that comes in starts the count anew and is tried at once; an older one or the one
    at hand changes nothing, so two requests for one page are one. A failure sets a timer of
    ``pause_ms`` times two to the number of tries before. All is state of the stream, so a
    restart goes on where the last one stopped.
    """

    def __init__(self, work: Callable[[str, int], str], most: int, pause_ms: int):
        self.work, self.most, self.pause = work, most, pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("work", "revision long, tries int, due_ms long, outcome string")

    def _try(self, key: str, revision: int, tries: int, now: int) -> pd.DataFrame:
        try:
            result, outcome, due = self.work(key, revision), "done", None
        except Exception as e:  # any fault of the model means the same: try again later
            result = str(e)[:200]
            outcome, due = ("failed", now + (self.pause << tries)) if tries + 1 < self.most else ("given_up", None)
        self.state.update((revision, tries + 1, due if due is not None else -1, outcome))
        if due is not None:
            self.handle.registerTimer(due)
        return pd.DataFrame([(key, revision, tries + 1, outcome, result, due)], columns=[c.split()[0] for c in OUT.split(", ")]).astype({"due_ms": "Int64"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        asked = max(int(r["revision"].max()) for r in rows)
        held = self.state.get() if self.state.exists() else None
        if held is not None and asked <= held[0]:
            return
        if held is not None and held[2] >= 0:
            self.handle.deleteTimer(held[2])
        yield self._try(key[0], asked, 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        revision, tries, due, outcome = self.state.get()
        if outcome == "failed" and due == expiredTimerInfo.getExpiryTimeInMs():
            yield self._try(key[0], revision, tries, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def backlog(requests: DataFrame, work: Callable[[str, int], str], most: int = 5, pause_ms: int = 1000) -> DataFrame:
    """OUT of a stream of (key, revision): what Backlog does with each. The function runs on the executors.

    The session needs a state store with timers:
    ``spark.sql.streaming.stateStore.providerClass`` set to Spark's RocksDBStateStoreProvider.
    """
    slim = requests.selectExpr("cast(key as string) AS key", "cast(revision as long) AS revision").filter("key IS NOT NULL AND revision IS NOT NULL")
    return slim.groupBy("key").transformWithStateInPandas(Backlog(work, most, pause_ms), OUT, "Append", "ProcessingTime")
