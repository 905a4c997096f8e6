"""Retrieval metrics over ranked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gain(rel, rank):
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)


def ndcg(ranked: DataFrame, judged: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(query, ndcg) with ranks from 1; ranked: query, doc, rank; judged: query, doc, rel."""
    ideal = judged.withColumn("best", F.row_number().over(W.partitionBy(query).orderBy(F.desc("rel"), doc))).where(F.col("best") <= k)
    most = ideal.groupBy(query).agg(F.sum(gain(F.col("rel"), F.col("best"))).alias("idcg"))
    got = ranked.where(F.col("rank") <= k).join(judged, [query, doc]).groupBy(query).agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"))
    return most.join(got, query, "left").select(query, F.round(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"))


def reciprocal_rank(ranked: DataFrame, relevant: DataFrame, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    first = ranked.join(relevant, [query, doc], "left_semi").groupBy(query).agg(F.min("rank").alias("first"))
    return ranked.select(query).distinct().join(first, query, "left").select(query, F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def recall(ranked: DataFrame, relevant: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    hits = ranked.where(F.col("rank") <= k).join(relevant, [query, doc], "left_semi").groupBy(query).agg(F.count(F.lit(1)).alias("hits"))
    sizes = relevant.groupBy(query).agg(F.count_distinct(doc).alias("n"))
    return sizes.join(hits, query, "left").select(query, F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"))


def measure(grid: DataFrame, run: DataFrame, judged: DataFrame) -> DataFrame:
    """(arm, depth, query_id, failed, ndcg, recall, rr) for every row of the grid (arm, depth, query_id).

    run: arm, query_id, doc_id, rank from 1; an arm without rows for a query failed there and scores 0.
    """
    kept = grid.join(run, ["arm", "query_id"]).where(F.col("rank") <= F.col("depth")).join(judged, ["query_id", "doc_id"], "left")
    got = kept.groupBy("arm", "depth", "query_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(gain(F.coalesce("rel", F.lit(0)), F.col("rank"))).alias("dcg"),
        F.count_if(F.col("rel") == 1).alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
    )
    depths = grid.select("depth").distinct()  # a handful
    best = judged.withColumn("best", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id"))).join(F.broadcast(depths), F.col("best") <= F.col("depth"))
    ideal = best.groupBy("query_id", "depth").agg(F.sum(gain(F.col("rel"), F.col("best"))).alias("idcg"))
    relevant = judged.groupBy("query_id").agg(F.count_if(F.col("rel") == 1).alias("relevant"))
    every = grid.join(got, ["arm", "depth", "query_id"], "left").join(ideal, ["query_id", "depth"], "left").join(relevant, "query_id", "left")
    part = lambda a, b: F.round(F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0)), 6)
    return every.select("arm", "depth", "query_id", F.col("n").isNull().alias("failed"), part("dcg", "idcg").alias("ndcg"), part("hits", "relevant").alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def normal_rankings(rows: DataFrame, arm: str, raw: str) -> DataFrame:
    """(arm, rank, doc_id, score) from JSON rankings: ids, [id, score] pairs or {doc_id, score} records; scores may be missing."""
    items = rows.select(arm, F.posexplode(F.from_json(raw, "array<string>")).alias("at", "item"))
    record, pair = F.startswith("item", F.lit("{")), F.startswith("item", F.lit("["))
    doc = F.when(record, F.get_json_object("item", "$.doc_id")).when(pair, F.get_json_object("item", "$[0]")).otherwise(F.col("item"))
    score = F.when(record, F.get_json_object("item", "$.score")).when(pair, F.get_json_object("item", "$[1]"))
    return items.select(arm, (F.col("at") + 1).alias("rank"), doc.alias("doc_id"), score.try_cast("double").alias("score"))


def split(queries: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """(key, split): holdout for listed ids and for rows whose own flag is set, else main."""
    marks = listed.select(key).distinct().withColumn("listed", F.lit(True))
    held = F.coalesce("listed", F.lit(False)) | F.coalesce("holdout", F.lit(False))
    return queries.join(marks, key, "left").select(key, F.when(held, "holdout").otherwise("main").alias("split"))


def regressions(samples: DataFrame, percent: float) -> DataFrame:
    """(metric, change, verdict) of metrics whose 95th percentile moved more than `percent` against the run before the last; samples: metric, run, value."""
    p95 = samples.groupBy("metric", "run").agg(F.percentile("value", 0.95).alias("p95"))
    order = W.partitionBy("metric").orderBy("run")
    steps = p95.withColumn("before", F.lag("p95").over(order)).withColumn("k", F.row_number().over(W.partitionBy("metric").orderBy(F.desc("run"))))
    change = 100 * (F.col("p95") - F.col("before")) / F.col("before")
    moved = steps.where((F.col("k") == 1) & (F.col("before") > 0) & (F.abs(change) > percent))
    return moved.select("metric", F.round(change, 4).alias("change"), F.when(change > 0, "regression").otherwise("improvement").alias("verdict"))
