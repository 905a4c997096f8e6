"""Writes that can fail half-way: staged publication, checkpointed loops, migrations, a task queue."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.session import list_files, read_small, remove, write_small


def two_phase(primary: Callable[[], None], shadow: Callable[[], None], rollback: Callable[[], None]) -> str:
    """Runs the primary write, then the shadow; a failing shadow takes the primary back and is raised again."""
    primary()
    try:
        shadow()
    except Exception:
        rollback()
        raise
    return "committed"


class Published:
    """A table whose readers see whole generations: a write goes beside the live one and counts once it is named."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def generation(self) -> int:
        return max((int(n.split(".")[0]) for n in list_files(self.spark, f"{self.path}/live") if n.endswith(".json")), default=0)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/{self.generation()}")

    def publish(self, frame: DataFrame, shadow: Callable[[DataFrame], None] = lambda f: None) -> int:
        """The shadow writer (another store) sees the new rows before they count; if it fails, readers keep the old ones."""
        number = self.generation() + 1
        place = f"{self.path}/data/{number}"

        def name_it():
            shadow(self.spark.read.parquet(place))
            write_small(self.spark, f"{self.path}/live/{number}.json", json.dumps({"generation": number}).encode())

        two_phase(lambda: frame.write.mode("overwrite").parquet(place), name_it, lambda: remove(self.spark, place))
        return number


class Checkpoint:
    """The rest of an interrupted loop, as a small file: done paths count once, the first failure freezes what is left."""

    def __init__(self, spark: SparkSession, path: str, owner: str):
        self.spark, self.path, self.owner = spark, path, owner

    def load(self) -> dict | None:
        names = sorted(n for n in list_files(self.spark, self.path) if n.endswith(".json"))
        return json.loads(read_small(self.spark, f"{self.path}/{names[-1]}")) if names else None

    def clear(self) -> None:
        remove(self.spark, self.path)

    def run(self, batches: Iterable[str], work: Callable[[str], str]) -> list[tuple[str, str]]:
        """work gives 'indexed' or 'skipped', or raises. A fresh call resumes at the first batch that failed before;
        if all succeed the checkpoint goes. (batch, status) of this call's batches."""
        every = list(batches)
        known = self.load()
        if known and known["owner"] == self.owner and known["remaining"] and known["remaining"][0] in every:
            every = every[every.index(known["remaining"][0]) :]
        out, frozen = [], False
        for i, batch in enumerate(every):
            try:
                out.append((batch, work(batch)))
            except Exception as error:  # noqa: BLE001  one batch's failure does not end the loop
                out.append((batch, "error"))
                if not frozen:
                    frozen = True
                    self.clear()
                    write_small(self.spark, f"{self.path}/{i:09d}.json", json.dumps({"owner": self.owner, "remaining": every[i:], "error": str(error)[:200]}).encode())
        if not frozen:
            self.clear()
        return out


class Migrations:
    """Numbered steps on the tables of a schema; each is applied once, in order."""

    def __init__(self, spark: SparkSession, path: str, steps: dict[int, Callable[[DataFrame], DataFrame]]):
        self.table, self.spark, self.path, self.steps = Published(spark, f"{path}/table"), spark, path, steps

    def version(self) -> int:
        return max((int(n.split(".")[0]) for n in list_files(self.spark, f"{self.path}/versions") if n.endswith(".json")), default=0)

    def run(self, start: DataFrame | None = None) -> list[int]:
        """The versions applied now; start: the table at version 0, where there is none yet."""
        if start is not None and not self.table.generation():
            self.table.publish(start)
        done = []
        for number in sorted(n for n in self.steps if n > self.version()):
            self.table.publish(self.steps[number](self.table.read()))
            write_small(self.spark, f"{self.path}/versions/{number:04d}.json", b"{}")
            done.append(number)
        return done


def add_column(name: str, kind: str, value: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """A migration step; a column that is there already stays as it is."""
    return lambda f: f if name in f.columns else f.withColumn(name, (F.lit(None) if value is None else value).cast(kind))


def live_after(rows: DataFrame, deleted_at: str, now: Column, days: int) -> DataFrame:
    """Rows that are not deleted, or not longer ago than the time to live."""
    return rows.where(F.col(deleted_at).isNull() | (F.unix_micros(F.col(deleted_at).cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - F.lit(days * 86_400_000_000)))


def queue_order(tasks: DataFrame, priority: str, key: str) -> DataFrame:
    """Pending tasks with their position: higher priority first, then the key. Positions come from counts of each priority,
    so no task sorts all rows."""
    pending = tasks.where("status = 'pending'")
    sizes = pending.groupBy(priority).agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.select(priority, F.coalesce(F.sum("n").over(W.orderBy(F.desc(priority)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row a priority
    inside = W.partitionBy(priority).orderBy(key)
    return pending.join(F.broadcast(ahead), priority).select(key, priority, (F.col("ahead") + F.row_number().over(inside)).alias("position"))


def progress(tasks: DataFrame, elapsed_s: float) -> DataFrame:
    """One row: tasks by state, throughput a second and estimated seconds left (null before the first is done)."""
    count = lambda s: F.count_if(F.col("status") == s)
    done, total = count("done"), F.count_if(F.col("status") != "cancelled")
    rate = done / F.lit(float(elapsed_s))
    return tasks.agg(done.alias("done"), count("running").alias("running"), count("pending").alias("pending"), count("cancelled").alias("cancelled"), F.round(rate, 6).alias("throughput"), F.round(F.when(rate > 0, (total - done) / rate), 6).alias("left_s"))


def upsert_files(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table after, moves): files by (repo, path); a live file whose hash comes in under another path, while its own path does not come in, has moved.

    stored: repo, path, hash, is_deleted; incoming: repo, path, hash, one row a (repo, path).
    """
    live = stored.where("NOT is_deleted").select("repo", F.col("path").alias("old_path"), "hash")
    gone = live.join(incoming.select("repo", F.col("path").alias("old_path")), ["repo", "old_path"], "left_anti")
    new = incoming.join(stored.select("repo", "path"), ["repo", "path"], "left_anti")
    first_old = gone.groupBy("repo", "hash").agg(F.min("old_path").alias("old_path"))
    first_new = new.groupBy("repo", "hash").agg(F.min("path").alias("path"))
    moves = first_new.join(first_old, ["repo", "hash"])
    left = stored.join(incoming.select("repo", "path"), ["repo", "path"], "left_anti")
    left = left.join(moves.select("repo", F.col("old_path").alias("path")), ["repo", "path"], "left_anti")
    after = left.select("repo", "path", "hash", "is_deleted").unionByName(incoming.select("repo", "path", "hash", F.lit(False).alias("is_deleted")))
    return after, moves.select("repo", "old_path", "path", "hash")
