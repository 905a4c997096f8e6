"""Trigram matching of names and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import trigrams


def trigram_index(frame: DataFrame, key: str, name: str) -> DataFrame:
    """(key, trigram): one row for each distinct trigram of a name."""
    return frame.select(key, F.explode(trigrams(F.col(name))).alias("trigram"))


def similar(frame: DataFrame, key: str, name: str, query: str) -> DataFrame:
    """(key, name, score) of names that share a trigram with the query, by Jaccard; row-local, no shuffle."""
    own, wanted = trigrams(F.col(name)), trigrams(F.lit(query))
    measured = frame.select(key, name, F.size(F.array_intersect(own, wanted)).alias("m"), F.size(own).alias("t"), F.size(wanted).alias("q"))
    return measured.where("m > 0").select(key, name, F.round(F.col("m") / (F.col("q") + F.col("t") - F.col("m")), 6).alias("score"))


def similar_by_index(index: DataFrame, names: DataFrame, key: str, name: str, query: str) -> DataFrame:
    """The same from the stored index: counts of shared and of all trigrams by key."""
    wanted = trigrams(F.lit(query))
    spark = index.sparkSession
    asked = spark.range(1).select(F.explode(wanted).alias("trigram"))  # a few rows
    hits = index.join(F.broadcast(asked), "trigram").groupBy(key).agg(F.count_distinct("trigram").alias("m"))
    totals = index.join(hits, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("t"))
    q = spark.range(1).select(F.size(wanted).alias("q"))
    joined = hits.join(totals, key).join(names.select(key, name), key).join(F.broadcast(q))
    return joined.select(key, name, F.round(F.col("m") / (F.col("q") + F.col("t") - F.col("m")), 6).alias("score"))


def best_of(*branches: DataFrame, key: str) -> DataFrame:
    """Union of (key, score) branches with each key's best score."""
    merged = branches[0].select(key, "score")
    for branch in branches[1:]:
        merged = merged.unionByName(branch.select(key, "score"))
    return merged.groupBy(key).agg(F.max("score").alias("score"))
