"""Tables written to the shared folder, to cut lineage and to be read more than once."""

from __future__ import annotations

import gc
import os
import time

from pyspark.sql import DataFrame, SparkSession

from quarrymill.session import scratch, small_batches

__all__ = ["Staging", "put_file", "small_batches"]


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a small file into the shared folder; its path."""
    path = f"{scratch(spark, 'file')}/{name}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    for start in range(0, len(data), 1 << 20):
        out.write(bytearray(data[start : start + (1 << 20)]))
    out.close()
    return path


class Staging:
    """Writes intermediate tables under one folder and removes those that are used up."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch(spark, name)
        self.count = 0

    def write(self, frame: DataFrame) -> DataFrame:
        self.count += 1
        path = os.path.join(self.root, str(self.count))
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out.staged_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete staged tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(frame.staged_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Lets go of the shuffle files of plans that nothing refers to any more, which else stay until the driver's next
        collection, and waits until the cleaner has no more of them to remove."""
        jvm = self.spark.sparkContext._jvm
        self.spark.range(1).collect()  # the scheduler refers to its last job, so let that be a small one
        gc.collect()
        jvm.System.gc()
        tracker = jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
        known, same = -1, 0
        for _ in range(40):
            now = tracker.shuffleStatuses().size()
            same = same + 1 if now == known else 0
            if same == 4:
                break
            known = now
            time.sleep(0.25)
