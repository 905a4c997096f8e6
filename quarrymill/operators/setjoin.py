"""A stored trigram index of names, rarest trigram first, for look-ups and for a similarity join.

Folder: `sets` (id, name, n, grams in global order) and `postings` (gram, id, n, pos) in ranges of (gram, id). The order is by how many
names hold a trigram, then by the trigram. Names of similarity `least` or more share a trigram within their first
n - ceil(least * n) + 1, have sizes within a factor of `least`, and at the place where they first meet have enough trigrams left to
reach the overlap that both sizes ask for; only pairs that pass all three are compared.

Equal names are one row of the index: `members` has the ids of each. The join gives pairs of different names.

Defined cases: null names are left out; an empty name has the trigrams of its padding; a query that shares nothing finds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.text import trigrams
from quarrymill.session import stage

#: Thousandths, so that a bound of exactly `least` is kept.
UNIT = 1000


def prefix_of(n, thousandths: int):
    return n - F.ceil(n * thousandths / UNIT) + 1


class TrigramIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def sets(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sets")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def members(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/members")

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str, name: str) -> TrigramIndex:
        index = cls(rows.sparkSession, path)
        named = stage(rows.where(F.col(name).isNotNull()).select(F.col(key).alias("key"), F.col(name).alias("name")), "names")
        named.groupBy("name").agg(F.min("key").alias("id")).join(named, "name").select("id", "key").write.parquet(f"{index.path}/members")
        single = stage(named.groupBy("name").agg(F.min("key").alias("id")).select("id", "name", trigrams(F.col("name")).alias("grams")), "sets")
        held = single.select("id", F.explode("grams").alias("gram"))
        df = held.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
        # A name's trigrams are few, so its list is short.
        ordered = held.join(df, "gram").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
        sets = single.join(ordered, "id").select("id", "name", F.size("g").alias("n"), F.col("g.gram").alias("grams"))
        sets.write.parquet(f"{index.path}/sets")
        at = index.sets.select("id", "n", F.posexplode("grams").alias("pos", "gram")).select("gram", "id", "n", (F.col("pos") + 1).alias("pos"))
        at.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{index.path}/postings")
        return index

    def look_up(self, query: str, least: float = 0.0) -> DataFrame:
        """(key, name, score) of the names of similarity above 0, or of `least` or more, to a query; reads the row groups of its trigrams."""
        grams = sorted(self.spark.range(1).select(trigrams(F.lit(query)).alias("g")).first().g)
        q, floor = len(grams), round(least * UNIT)
        rows = self.postings.where(F.col("gram").isin(grams))
        if floor:
            rows = rows.where((F.col("n") * UNIT >= floor * q) & (F.col("n") * floor <= q * UNIT))
        shared = rows.groupBy("id").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
        score = F.col("m") / (F.col("n") + q - F.col("m"))
        found = shared.where(F.col("m") * UNIT >= floor * (F.col("n") + q - F.col("m"))).select("id", score.alias("score"))
        return found.join(self.sets.select("id", "name"), "id").join(self.members, "id").select("key", "name", F.round("score", 6).alias("score"))

    def candidates(self, least: float) -> DataFrame:
        """(a, b): pairs of names, a < b, that pass the prefix, size and place bounds."""
        floor = round(least * UNIT)
        early = self.postings.where(F.col("pos") <= prefix_of(F.col("n"), floor))
        a = early.select("gram", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
        b = early.select("gram", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
        wanted = F.ceil((F.col("na") + F.col("nb")) * floor / (UNIT + floor))
        left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
        met = a.join(b, "gram").where("a < b").where((F.col("na") * UNIT >= floor * F.col("nb")) & (F.col("nb") * UNIT >= floor * F.col("na")))
        # What pairs share before a later common trigram counts too: only the first meeting is bounded by what is left.
        first = met.groupBy("a", "b").agg(F.min_by(F.struct("na", "nb", "pa", "pb"), "pa").alias("f"), F.count(F.lit(1)).alias("met")).select("a", "b", "f.*")
        return first.where(left + 1 >= wanted).select("a", "b")

    def join(self, least: float) -> DataFrame:
        """(a, b, score) of all pairs of different names of similarity `least` or more."""
        sets = self.sets.select("id", "grams")
        pairs = self.candidates(least)
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
        shared = F.size(F.array_intersect("ga", "gb"))
        every = F.size("ga") + F.size("gb") - shared
        return both.where(shared * UNIT >= round(least * UNIT) * every).select("a", "b", F.round(shared / every, 6).alias("score"))
