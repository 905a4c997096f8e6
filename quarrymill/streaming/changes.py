"""Change events: debounce by session windows, windowed counts, stateful reference polling, table updates.

Each function takes a batch or a streaming DataFrame; `run_once` drives a stream over the files
that are there and returns what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def debounce(events: DataFrame, gap: str, key: str = "path", ts: str = "ts", action: str = "action", delay: str | None = None) -> DataFrame:
    """(key, start, end, n, action): the last action of each run of events less than `gap` apart.

    Event time stands in for a timer: a run is closed when the watermark passes its end.
    """
    timed = events.withWatermark(ts, delay) if delay else events
    runs = timed.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max_by(action, F.struct(ts, action)).alias("action"))
    return runs.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "action")


def windowed_counts(events: DataFrame, width: str, ts: str = "ts", action: str = "action", delay: str | None = None) -> DataFrame:
    timed = events.withWatermark(ts, delay) if delay else events
    return timed.groupBy(F.window(ts, width).alias("w"), action).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), action, "n")


POLL = "repo long, commit long, branch string, decision string"


def poll_refs(refs: DataFrame) -> DataFrame:
    """Decision for each ref event (repo, seq, commit, branch, tracked) from the repository's last commit.

    State by repository: the last synced commit. A wrong branch is skipped, an equal commit is
    unchanged, a later commit is a fast-forward and an earlier one a forced push with a full sync.
    """

    def step(key, frames, state):
        last = state.get[0] if state.exists else None
        out = []
        pieces = list(frames)  # a group comes in Arrow pieces; its order runs over all of them
        if pieces:
            for row in pd.concat(pieces).sort_values("seq").itertuples():
                if row.branch != row.tracked:
                    decision = "skip"
                elif last is None or row.commit < last:
                    decision = "full"
                else:
                    decision = "unchanged" if row.commit == last else "sync"
                if decision in ("sync", "full"):
                    last = int(row.commit)
                out.append((key[0], row.commit, row.branch, decision))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["repo", "commit", "branch", "decision"])

    return refs.groupBy("repo").applyInPandasWithState(step, POLL, "last long", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Takes all that is available and hands each micro-batch to the sink; a repeated batch has the same id."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Current rows without the changed keys, and the changes that are not deletions."""
    kept = current.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.where("action <> 'deleted'").select(*current.columns))


def latest(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of each key, by partial maximum rather than by a sort."""
    whole = F.struct(*order, *[c for c in changes.columns if c not in order])
    return changes.groupBy(key).agg(F.max(whole).alias("m")).select("m.*")


def changed_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of change records from parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def on_timer(spark: SparkSession, step: Callable[[], DataFrame], base: str, period: str | None = None) -> DataFrame:
    """Writes step()'s rows at each tick of a timer stream and gives what was written; without a period one tick, as a sweep by hand."""
    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = source.writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(lambda batch, number: step().write.mode("overwrite").parquet(f"{base}/out/tick={number}"))
    writer = writer.trigger(processingTime=period) if period else writer.trigger(once=True)
    writer.start().awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("tick")
