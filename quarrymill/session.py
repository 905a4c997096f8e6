"""Session construction for local runs; on a cluster the caller passes its own session. Files of the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarrymill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode alone one of our own where the setting is absent."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quarrymill-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path as readers of its store give it."""
    where, store = _place(spark, path)
    return store.makeQualified(where).toString()


def write_small(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file in any store that Spark reaches: written beside its place, then renamed into it."""
    part, store = _place(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = store.create(part)
    for start in range(0, len(data), 1 << 20):
        out.write(bytearray(data[start : start + (1 << 20)]))
    out.close()
    if not store.rename(part, _place(spark, path)[0]):
        store.delete(part, False)
        raise FileExistsError(path)


def read_small(spark: SparkSession, path: str) -> bytes:
    where, store = _place(spark, path)
    stream = store.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; empty if it is not there."""
    where, store = _place(spark, folder)
    return [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []


def stamps(spark: SparkSession, files: list[str]) -> tuple:
    """(name, length, time of change) of every file: one listing a folder."""
    held = {_place(spark, f)[0].toUri().getPath() for f in files}
    out = []
    for folder in sorted({f.rpartition("/")[0] for f in files}):
        where, store = _place(spark, folder)
        found = ((s.getPath().toUri().getPath(), s.getLen(), s.getModificationTime()) for s in store.listStatus(where))
        out += [f for f in found if f[0] in held]
    return tuple(sorted(out))


def remove(spark: SparkSession, path: str) -> None:
    where, store = _place(spark, path)
    store.delete(where, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """A folder or file to another place of its store, where nothing is yet; folders above it are made."""
    (where, store), to = _place(spark, source), _place(spark, target)[0]
    store.mkdirs(to.getParent())
    if not store.rename(where, to):
        raise FileNotFoundError(source)


def at_most(spark: SparkSession, key: str, limit: int) -> str:
    """Lower a setting in bytes to `limit` where it is greater; what it was."""
    before = spark.conf.get(key)
    now = before.lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    digits = now.rstrip("kmg")
    if not digits.isdigit() or int(digits) * unit > limit:
        spark.conf.set(key, str(limit))
    return before


def small_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Lower this session's Arrow batches to `limit` bytes, for rows that carry large binaries.

    The setting bounds memory outside the heap on both sides of a worker's pipe and changes no result.
    """
    at_most(spark, "spark.sql.execution.arrow.maxBytesPerBatch", limit)


#: Folders that one task writes side by side.
OPEN_FILES = 64


def write_parts(rows: DataFrame, path: str, *by: str) -> None:
    """Rows by folders of some columns. A task writes up to OPEN_FILES folders side by side, in the order of its rows; only those of further ones are sorted by folder."""
    conf, key = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(OPEN_FILES))
    try:
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        conf.set(key, before)


def stage(frame: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The frame written as a table of the shared folder and read again: computed once, its lineage cut."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path, compression=compression)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
