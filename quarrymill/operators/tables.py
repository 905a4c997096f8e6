"""Polymorphic table functions for SQL: their columns come from their arguments, their rows from tables partitioned by the caller.

    SELECT * FROM runs(TABLE(events) PARTITION BY user_id ORDER BY (ts), 'ts', 1800, 'user_id')
    SELECT * FROM leaders(TABLE(documents) PARTITION BY source ORDER BY (n_chars DESC), 3, 'n_chars')
    SELECT * FROM windows(TABLE(documents), 'text', 'doc_id', 100, 20)

Spark partitions and sorts the rows; a function keeps a bounded state for one partition at a time.

Defined cases: rows without a time belong to no run; equal values share a rank; texts without words have no windows.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _constant(argument: AnalyzeArgument, what: str):
    if argument.value is None:
        raise ValueError(f"{what} must be a constant")
    return argument.value


class Runs:
    """(key, start, end, rows): rows of a partition that follow each other by less than `gap` seconds, in the order of a time column."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, ts: AnalyzeArgument, gap: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
        for name in (_constant(ts, "the time column"), _constant(key, "the key column")):
            if not rows.isTable or name not in rows.dataType.names:
                raise ValueError(f"the table has no column {name}")
        if _constant(gap, "the gap") <= 0:
            raise ValueError("the gap must be above 0")
        kind = rows.dataType[ts.value].dataType
        fields = [StructField(key.value, rows.dataType[key.value].dataType), StructField("start", kind), StructField("end", kind), StructField("rows", LongType())]
        return AnalyzeResult(StructType(fields))

    def __init__(self):
        self.first = self.last = self.key = None
        self.count = 0

    def eval(self, row, ts: str, gap: int, key: str):
        at, self.key = row[ts], row[key]
        if at is None:
            return
        away = None if self.last is None else at - self.last
        if away is not None and (away.total_seconds() if hasattr(away, "total_seconds") else away) >= gap:
            yield self.key, self.first, self.last, self.count
            self.first, self.count = at, 0
        self.first = at if self.first is None else self.first
        self.last, self.count = at, self.count + 1

    def terminate(self):
        if self.count:
            yield self.key, self.first, self.last, self.count


class Leaders:
    """The table's columns and `place`: a partition's first rows, all that share the n-th value included, in the caller's order."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, n: AnalyzeArgument, by: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or _constant(by, "the column") not in rows.dataType.names:
            raise ValueError(f"the table has no column {by.value}")
        if _constant(n, "n") < 1:
            raise ValueError("n must be 1 at least")
        return AnalyzeResult(StructType([*rows.dataType.fields, StructField("place", IntegerType())]))

    def __init__(self):
        self.seen = self.place = 0
        self.value = object()

    def eval(self, row, n: int, by: str):
        self.seen += 1
        if row[by] != self.value:
            self.value, self.place = row[by], self.seen
        if self.place <= n:
            yield (*row, self.place)


class Windows:
    """(key, number, first_word, words, content): windows of `size` words that share `overlap` with the one before."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, key: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        for name in (_constant(text, "the text column"), _constant(key, "the key column")):
            if not rows.isTable or name not in rows.dataType.names:
                raise ValueError(f"the table has no column {name}")
        if not 0 <= _constant(overlap, "the overlap") < _constant(size, "the size"):
            raise ValueError("the overlap must be below the size")
        kind = rows.dataType[key.value].dataType
        fields = [StructField(key.value, kind), StructField("number", IntegerType()), StructField("first_word", IntegerType()), StructField("words", IntegerType()), StructField("content", StringType())]
        return AnalyzeResult(StructType(fields))

    def eval(self, row, text: str, key: str, size: int, overlap: int):
        whole = row[text] or ""
        spans = [m.span() for m in WORD.finditer(whole)]
        for number, first in enumerate(range(0, len(spans), size - overlap)):
            held = spans[first : first + size]
            yield row[key], number, first, len(held), whole[held[0][0] : held[-1][1]]
            if first + size >= len(spans):
                break


def register(spark: SparkSession) -> None:
    for name, kind in (("runs", Runs), ("leaders", Leaders), ("windows", Windows)):
        spark.udtf.register(name, udtf(kind))


