"""State of a change stream: a buffer with timers that is flushed path by path, and an outbox of deletions that is drained later.

`flush` keeps the events of each path until none has come for `quiet`, by event time: list state for the events, a timer at the end of the
run. Events out of order find their place as long as the watermark has not passed them; a restarted stream goes on from its state.
`Outbox` writes the deletions of a micro-batch under the batch's number, so a batch that comes again changes nothing, and drains all
that is pending in one change of the table: ids that are alive again by then are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrymill.operators.keyed import KeyedTable
from quarrymill.session import list_files, stage

FLUSHED = "path string, first timestamp, last timestamp, events long, action string"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Buffer(StatefulProcessor):
    """Events of one path until it has been quiet; what comes out is the run's last action."""

    def __init__(self, quiet: timedelta):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "ts timestamp, event_id long, action string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.events.appendList([(r.ts, int(r.event_id), r.action) for r in frame.itertuples()])
        self._wait(self._runs())
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        runs = self._runs()
        done = [r for r in runs if self._end(r) <= now]
        left = [r for r in runs if self._end(r) > now]
        if left:
            self.events.put([tuple(e) for r in left for e in r])
        else:
            self.events.clear()
        self._wait(left)
        yield pd.DataFrame([(key[0], r[0][0], r[-1][0], len(r), r[-1][2]) for r in done], columns=["path", "first", "last", "events", "action"])

    def _runs(self) -> list[list[tuple]]:
        out: list[list[tuple]] = []
        for event in sorted((pd.Timestamp(e[0]), e[1], e[2]) for e in self.events.get()):
            if out and event[0] - out[-1][-1][0] < self.quiet:
                out[-1].append(event)
            else:
                out.append([event])
        return out

    def _end(self, run: list[tuple]) -> int:
        return int((run[-1][0] + self.quiet).timestamp() * 1000)

    def _wait(self, runs: list[list[tuple]]) -> None:
        """One timer: the end of the earliest run."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, (tuple, list)) else old)
        if runs:
            self.handle.registerTimer(self._end(runs[0]))

    def close(self) -> None:
        pass


@contextmanager
def timers(spark: SparkSession):
    """While streams with timers are started: the state store that they need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def flush(events: DataFrame, quiet: timedelta, delay: str) -> DataFrame:
    """(path, first, last, events, action) of each run of a streaming (path, ts, event_id, action), when the watermark has passed its end."""
    timed = events.withWatermark("ts", delay)
    return timed.groupBy("path").transformWithStateInPandas(Buffer(quiet), FLUSHED, "Append", "EventTime")


class Outbox:
    """Pending deletions in a folder: `pending/batch=N` as they come, `drained/batch=N` when they are done."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def take(self, keys: DataFrame, batch: int) -> None:
        """Sink of a micro-batch: the same batch again writes the same folder."""
        keys.distinct().write.mode("overwrite").parquet(f"{self.path}/pending/batch={batch}")

    def waiting(self) -> list[int]:
        numbers = [{int(n.partition("=")[2]) for n in list_files(self.spark, f"{self.path}/{kind}") if n.startswith("batch=")} for kind in ("pending", "drained")]
        return sorted(numbers[0] - numbers[1])

    def drain(self, table: KeyedTable, live: DataFrame) -> DataFrame | None:
        """Delete what is pending and not alive; the rows that went. If it fails half-way, draining again gives the same table."""
        batches = self.waiting()
        if not batches:
            return None
        pending = self.spark.read.parquet(*[f"{self.path}/pending/batch={b}" for b in batches]).distinct()
        wanted = stage(pending.join(live.select(*pending.columns), pending.columns, "left_anti"), "wanted")
        gone = table.delete(wanted)
        for b in batches:
            self.spark.range(1).select(F.lit(b).alias("done")).write.mode("overwrite").parquet(f"{self.path}/drained/batch={b}")
        return gone
