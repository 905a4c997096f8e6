"""Stored tables that change in place: rows lie in numbered parts, and a change rewrites only the parts that it touches.

`Parts` keeps rows by a given number; `KeyedTable` numbers them by a hash of key columns. A change is written once, beside the
table, and its parts are then moved into the places of those it touched, so files of other parts keep their names and times;
readers that know the keys they want prune to their parts. The list of touched parts has at most one number a part. Rows with a
key are dealt by it into lots of about ROWS_PER_LOT before anything groups them: a task's memory does not grow with the table,
and a part number with very many rows under it, as a file with its chunks, is no single task.

Defined cases: a key that is null is a key; of several changes to one key the greatest by `latest` holds, without `latest` the
greatest row; deleting what is not there changes nothing; a part that loses its last row loses its folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quarrymill.session import list_files, move, remove, write_parts

ROWS_PER_PART = 1_000_000
#: Rows that one task groups by their keys.
ROWS_PER_LOT = 250_000
#: Keys to delete, up to this number, are broadcast.
FEW_KEYS = 100_000


class Parts:
    """Rows of one schema by the column `part`."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = StructType([f for f in schema if f.name != "part"])

    def read(self, numbers: list[int] | None = None) -> DataFrame:
        """All rows, or those of some parts, found by their folders."""
        schema = StructType([StructField(f.name, f.dataType, True) for f in self.schema] + [StructField("part", IntegerType())])
        rows = self.spark.read.schema(schema).parquet(self.path)
        return rows if numbers is None else rows.where(F.col("part").isin(numbers))

    def create(self, rows: DataFrame) -> None:
        self._write(self._even(rows), self.path)

    def replace(self, rows: DataFrame, touched: list[int]) -> None:
        """`rows` become the whole of the touched parts, and of others that they fall into."""
        if not touched:
            return
        beside = self.beside()
        self._write(self._even(rows), beside)
        self.swap(beside, sorted({*touched, *self.found(beside)}))

    def beside(self) -> str:
        """A fresh path in the folder of the table."""
        return f"{self.path}-{uuid.uuid4().hex}"

    def found(self, path: str) -> list[int]:
        """The parts that were written to a path."""
        return sorted(int(n.removeprefix("part=")) for n in list_files(self.spark, path) if n.startswith("part="))

    def swap(self, path: str, touched: list[int]) -> None:
        """Parts written beside the table take the places of the touched ones; a part that is not there any more loses its folder."""
        filled = set(self.found(path))
        for number in touched:
            remove(self.spark, f"{self.path}/part={number}")
            if number in filled:
                move(self.spark, f"{path}/part={number}", f"{self.path}/part={number}")
        remove(self.spark, path)

    def _even(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names, F.col("part").cast("int").alias("part")).hint("rebalance", "part")

    def _write(self, rows: DataFrame, path: str, *above: str) -> None:
        write_parts(rows.select(*above, *self.schema.names, F.col("part").cast("int").alias("part")), path, *above, "part")


def numbers_of(rows: DataFrame) -> list[int]:
    """The distinct part numbers of some rows: one small integer a part."""
    return sorted(r.part for r in rows.select("part").distinct().collect())


class KeyedTable:
    """keys: columns that name a row; by: those of them whose hash gives the part (a parent's key, so that children lie together)."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], schema: StructType, parts: int, by: tuple[str, ...] | None = None):
        self.keys, self.by, self.count = keys, by or keys, parts
        self.parts = Parts(spark, path, schema)
        self.columns = self.parts.schema.names

    @classmethod
    def store(cls, rows: DataFrame, path: str, keys: tuple[str, ...], by: tuple[str, ...] | None = None, parts: int | None = None) -> KeyedTable:
        """A new table of these rows, one for each key; about ROWS_PER_PART rows a part unless `parts` says otherwise."""
        n = rows.count()
        parts = parts or max(1, -(-n // ROWS_PER_PART))
        table = cls(rows.sparkSession, path, keys, rows.schema, parts, by)
        table.parts._write(table.single(rows, n=n), path)
        return table

    def placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", F.pmod(F.xxhash64(*self.by), F.lit(self.count)).cast("int"))

    def dealt(self, rows: DataFrame, n: int) -> DataFrame:
        """n rows with their part, and a number `lot` by their part and key: a lot is one task, and no task has two."""
        lots = max(1, -(-n // (ROWS_PER_LOT * self.count)))
        lot = F.col("part") * lots + F.pmod(F.hash(*self.keys), F.lit(lots)).cast("int")
        return self.placed(rows).withColumn("lot", lot).repartitionById(self.count * lots, F.col("lot"))

    def single(self, rows: DataFrame, latest: str | None = None, n: int | None = None) -> DataFrame:
        """One row a key with its part: the last by `latest`, then by the other columns."""
        others = [c for c in self.columns if c not in self.keys]
        first = [F.col(latest).alias("_latest")] if latest else []
        best = F.max(F.struct(*first, *others)) if first or others else F.count(F.lit(1))
        grouped = self.dealt(rows, rows.count() if n is None else n).groupBy("part", "lot", *self.keys).agg(best.alias("_best"))
        return grouped.select(*[F.col(c) if c in self.keys else F.col("_best")[c].alias(c) for c in self.columns], "part")

    def read(self, wanted: DataFrame | None = None) -> DataFrame:
        """All rows, or those in the parts where `wanted`'s keys would lie."""
        numbers = None if wanted is None else numbers_of(self.placed(wanted))
        return self.parts.read(numbers).drop("part")

    def upsert(self, changes: DataFrame, latest: str | None = None, combine: dict[str, Column] | None = None) -> list[int]:
        """Insert or replace rows by key; the parts that were rewritten.

        combine: for some columns the value of a row that was there, of columns `old.x` and `new.x`; other columns take the new one.
        """
        changes = changes.select(*self.columns)
        per_part = {r.part: r.n for r in self.placed(changes).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        touched, n = sorted(per_part), sum(per_part.values())
        others = [c for c in self.columns if c not in self.keys]
        best = F.struct(*([F.col(latest).alias("_latest")] if latest else []), *self.columns)

        def value(c):
            chosen = F.col(f"new.{c}")
            if combine and c in combine:
                chosen = F.when(F.col("old").isNotNull(), combine[c]).otherwise(chosen)
            return F.when(F.col("new").isNotNull(), chosen).otherwise(F.col(f"old.{c}")).alias(c)

        while touched:
            old = self.parts.read(touched).select(*self.columns)
            # What was there and what comes meet by one shuffle; a table has one row a key.
            both = old.withColumn("_new", F.lit(False)).unionByName(changes.withColumn("_new", F.lit(True)))
            met = self.dealt(both, n + old.count()).groupBy("part", "lot", *self.keys)
            met = met.agg(F.max(F.when(F.col("_new"), best)).alias("new"), F.first(F.when(~F.col("_new"), F.struct(*self.columns)), ignorenulls=True).alias("old"))
            beside = self.parts.beside()
            self.parts._write(met.select(*self.keys, *[value(c) for c in others], "part"), beside)
            missed = set(self.parts.found(beside)) - set(touched)
            if not missed:
                self.parts.swap(beside, touched)
                break
            # Changes that came out otherwise when they were read again: their parts are read too.
            remove(self.parts.spark, beside)
            touched = sorted({*touched, *missed})
        return touched

    def delete(self, keys: DataFrame) -> DataFrame:
        """Take out the rows that agree with `keys` on all its columns; the rows that went, as a stored table.

        Columns that do not hold `by` leave no way to prune: then every part is looked through, and those that hold a row are rewritten.
        """
        names, spark = keys.columns, self.parts.spark
        known = set(self.by) <= set(names)
        if known:
            per_part = {r.part: r.n for r in self.placed(keys).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
            n, numbers = sum(per_part.values()), sorted(per_part)
        else:
            n, numbers = keys.count(), None
        # A struct of nulls equals another, so a null key is a key; made distinct by it, the keys are dealt as the join wants them.
        wanted = keys.select(F.struct(*names).alias("_key"))
        rows = self.parts.read(numbers).select(F.struct(*names).alias("_key"), *[c for c in [*self.columns, "part"] if c not in names])
        if n > FEW_KEYS:
            # As many tasks as there are lots, so that the keys that one holds do not grow with the table.
            lots = -(-max(n, rows.count()) // ROWS_PER_LOT)
            kind = rows.schema["_key"].dataType
            if wanted.schema["_key"].dataType.simpleString() == kind.simpleString():
                wanted = wanted.select(F.col("_key").cast(kind).alias("_key"))  # else the join would cast it, and deal it again
            rows, wanted = rows.repartition(lots, "_key"), wanted.repartition(lots, "_key")
        wanted = wanted.distinct().withColumn("_gone", F.lit(True))
        flagged = rows.join(F.broadcast(wanted) if n <= FEW_KEYS else wanted.hint("shuffle_hash"), "_key", "left")
        beside = self.parts.beside()
        # One pass gives both what goes and what stays.
        out = flagged.select(F.coalesce("_gone", F.lit(False)).alias("gone"), *[F.col(f"_key.{c}").alias(c) if c in names else F.col(c) for c in self.columns], "part")
        self.parts._write(out, beside, "gone")
        touched = self.parts.found(f"{beside}/gone=true")
        self.parts.swap(f"{beside}/gone=false", touched)
        if not touched:
            return spark.createDataFrame([], self.parts.schema)
        schema = StructType([*self.parts.schema, StructField("part", IntegerType())])
        return spark.read.schema(schema).parquet(f"{beside}/gone=true").drop("part")

    def rekey(self, columns: dict[str, Column]) -> None:
        """New values of some columns in every row, keys among them but not `by`: rows stay in their parts, so nothing is shuffled. Different keys must stay different."""
        if set(columns) & set(self.by):
            raise ValueError("columns that give the part cannot change in place")
        rows = self.parts.read()
        beside = self.parts.beside()
        self.parts._write(rows.select(*[columns.get(c, F.col(c)).alias(c) for c in self.columns], "part"), beside)
        self.parts.swap(beside, self.parts.found(beside))


def cascade(root: KeyedTable, keys: DataFrame, children: list[tuple[KeyedTable, KeyedTable, dict[str, str]]]) -> dict[int, DataFrame]:
    """Delete rows of `root` and what hangs on them.

    children: (table, parent, {column of the table: column of the parent}), parents before children. The rows that went, by id() of the table.
    """
    gone = {id(root): root.delete(keys)}
    for table, parent, columns in children:
        lost = gone[id(parent)].select(*[F.col(p).alias(c) for c, p in columns.items()])
        gone[id(table)] = table.delete(lost.where(" AND ".join(f"{c} IS NOT NULL" for c in columns)))
    return gone
