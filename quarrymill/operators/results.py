"""A cache of query results as a table: entries with tags and times, changed by whole-table steps.

Columns: key, kind, value, created, ttl_s, tags array, hits, used (last access), bytes. Times are passed in, so that
reruns agree. A null key is never stored; putting a key again replaces its entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COLUMNS = "key string, kind string, value string, created timestamp, ttl_s long, tags array<string>, hits long, used timestamp, bytes long"


def key_of(kind: Column, parameters: Column) -> Column:
    """Hash of the kind and of the parameters (a map) in the order of their names."""
    pairs = F.array_sort(F.map_entries(parameters))
    return F.sha2(F.concat_ws("\x1f", kind, F.transform(pairs, lambda p: F.concat_ws("=", p["key"], F.coalesce(p["value"], F.lit("\x1e"))))), 256)


def expired(now: Column) -> Column:
    return F.unix_micros(F.col("created")) + F.col("ttl_s") * 1_000_000 <= F.unix_micros(now.cast("timestamp"))


def put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """new: key, kind, value, created, ttl_s, files (on which the result depends); of one key the latest, then the largest value, counts."""
    tags = F.array_union(F.array(F.concat(F.lit("query_type:"), "kind")), F.transform(F.coalesce("files", F.array().cast("array<string>")), lambda f: F.concat(F.lit("file:"), f)))
    latest = W.partitionBy("key").orderBy(F.desc("created"), F.desc("value"))
    rows = new.withColumn("created", F.col("created").cast("timestamp")).where("key IS NOT NULL AND value IS NOT NULL").withColumn("r", F.row_number().over(latest)).where("r = 1")
    rows = rows.select("key", "kind", "value", "created", "ttl_s", tags.alias("tags"), F.lit(0).cast("long").alias("hits"), F.col("created").alias("used"), F.octet_length("value").cast("long").alias("bytes"))
    return cache.join(rows.select("key"), "key", "left_anti").select(*rows.columns).unionByName(rows)


def get(cache: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked: key, at. (each request with its value or null, the cache with hits and last use)."""
    live = cache.select("key", "value", "created", "ttl_s")
    answers = asked.join(live, "key", "left").select("key", "at", F.when(~expired(F.col("at")) & (F.col("created") <= F.col("at").cast("timestamp")), F.col("value")).alias("value"))
    uses = answers.where("value IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("at").cast("timestamp")).alias("last"))
    touched = cache.join(uses, "key", "left").select(
        "key", "kind", "value", "created", "ttl_s", "tags", (F.col("hits") + F.coalesce("n", F.lit(0))).alias("hits"), F.greatest("used", "last").alias("used"), "bytes"
    )
    return answers, touched


def invalidate(cache: DataFrame, tags: DataFrame) -> DataFrame:
    """The cache without the entries that carry any of the tags (one column)."""
    marked = cache.select("key", F.explode("tags").alias("tag")).join(tags.toDF("tag").distinct(), "tag", "left_semi").select("key").distinct()
    return cache.join(marked, "key", "left_anti")


def purge(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(~expired(now))


def fit_into(cache: DataFrame, most_entries: int, most_bytes: int, ranges: int = 64) -> DataFrame:
    """The most recently used entries that fit both bounds, by last use and key.

    Running sums in two levels: last uses are dealt into ranges by time, ranges are summed, and windows run inside them.
    """
    ends = cache.agg(F.unix_micros(F.min("used")).alias("lo"), F.unix_micros(F.max("used")).alias("hi"))  # one row
    place = F.coalesce(F.floor((F.col("hi") - F.unix_micros("used")) * ranges / (F.col("hi") - F.col("lo") + 1)), F.lit(0))
    dealt = cache.join(F.broadcast(ends)).withColumn("part", place).drop("lo", "hi")
    sums = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a range: at most `ranges`
    offsets = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    inside = W.partitionBy("part").orderBy(F.desc("used"), "key").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = dealt.join(F.broadcast(offsets), "part").withColumn("at", F.col("n0") + F.count(F.lit(1)).over(inside)).withColumn("total", F.col("b0") + F.sum("bytes").over(inside))
    return ranked.where((F.col("at") <= most_entries) & (F.col("total") <= most_bytes)).drop("part", "n0", "b0", "at", "total")


def tiered_get(near: DataFrame, far: DataFrame, asked: DataFrame, most_near: int) -> tuple[DataFrame, DataFrame]:
    """(answers with the tier that gave them, the near tier after): the near table first, then the far one, whose hits move near."""
    first, near_used = get(near, asked)
    missed = first.where("value IS NULL").select("key", "at")
    second, far_used = get(far, missed)
    answers = first.where("value IS NOT NULL").withColumn("tier", F.lit("near")).unionByName(second.withColumn("tier", F.when(F.col("value").isNotNull(), "far").otherwise("none")))
    moved = far_used.join(second.where("value IS NOT NULL").select("key").distinct(), "key", "left_semi")
    both = near_used.join(moved.select("key"), "key", "left_anti").unionByName(moved.select(*near_used.columns))
    return answers, fit_into(both, most_near, 1 << 62)
