"""A quiet period on a stream of events: a burst of them gives one row, once no more have come for so long.

The state of a key (a folder) is the set of its paths, with the newest time of each, and a timer; every batch with events
of the key moves the timer. It is state on the cluster, so a restart from the checkpoint loses no burst. Events of one
path are one; null keys are a key. Needs the RocksDB state store (`prepared`)."""

from __future__ import annotations

import contextlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.shipping import by_value

BURST = "folder string, paths array<string>, times array<timestamp>, events bigint"


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def prepared(spark: SparkSession):
    """Queries that start in this block have the state store that timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield spark
    finally:
        spark.conf.set(PROVIDER, before)


class Quiet(StatefulProcessor):
    def __init__(self, seconds: float):
        self.milliseconds = int(1000 * seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "modified timestamp, events bigint")

    def handleInputRows(self, key, rows, timerValues):
        for batch in rows:
            for path, own in batch.groupby("path", sort=False):
                known, newest = self.paths.getValue((path,)) if self.paths.containsKey((path,)) else None, own["modified"].max().to_pydatetime()
                self.paths.updateValue((path,), (max(newest, known[0]) if known else newest, len(own) + (known[1] if known else 0)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.milliseconds)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        found = sorted((p[0], *v) for p, v in self.paths.iterator())
        self.paths.clear()
        if found:
            yield pd.DataFrame({"folder": [key[0]], "paths": [[p for p, *_ in found]], "times": [[t for _, t, _ in found]], "events": [sum(n for *_, n in found)]})

    def close(self) -> None:
        pass


def bursts(events: DataFrame, seconds: float) -> DataFrame:
    """(folder, paths, times, events) of a stream of events(folder, path, modified, ...): a row for each burst of a
    folder, with the newest time of each path, when none of its files has changed for so many seconds."""
    with by_value(__name__):
        return events.select("folder", "path", "modified").groupBy("folder").transformWithStateInPandas(Quiet(seconds), BURST, "Append", "ProcessingTime")
