"""Fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.session import stage


def ranked(frame: DataFrame, key: str, order: list[Column], branch: str, position: int) -> DataFrame:
    """(key, branch, branch_pos, rank from 0) of a short result list."""
    at = F.row_number().over(W.orderBy(*order)) - 1
    return frame.select(key, at.alias("rank"), F.lit(branch).alias("branch"), F.lit(position).alias("branch_pos"))


def reciprocal_rank(lists: list[DataFrame], weights: dict[str, float], key: str, k: int = 60) -> DataFrame:
    """(key, score, best_branch, n_branches): sum of weight / (k + rank + 1)."""
    every = lists[0]
    for other in lists[1:]:
        every = every.unionByName(other)
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    part = F.element_at(weight, F.col("branch")) / (k + F.col("rank") + 1)
    return every.groupBy(key).agg(
        F.round(F.sum(part), 8).alias("score"),
        F.min_by("branch", F.struct("rank", "branch_pos")).alias("best_branch"),
        F.count_distinct("branch").alias("n_branches"),
    )


def normal_weights(values: dict[str, float]) -> dict[str, float]:
    """Weights clamped to [0, 1] and divided by their sum."""
    clamped = {k: min(max(v, 0.0), 1.0) for k, v in values.items()}
    total = sum(clamped.values())
    return {k: v / total for k, v in clamped.items()} if total > 0 else values


def normal_weight_columns(values: dict[str, Column]) -> dict[str, Column]:
    """As `normal_weights`, for a row a setting; a null stays what it is without the others."""
    clamped = {k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) for k, v in values.items()}
    total = sum(F.coalesce(c, F.lit(0.0)) for c in clamped.values())
    return {k: F.when(total > 0, c / total).otherwise(c) for k, c in clamped.items()}


def first_per(frame: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an explicit order."""
    return frame.withColumn("first_rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where("first_rank = 1").drop("first_rank")


def quota_fill(frame: DataFrame, kind: str, order: list[Column], limit: int) -> DataFrame:
    """Code rows first up to the limit less the prose quota, then prose up to a quarter, then others, then more code."""
    place = F.row_number().over(W.partitionBy(kind).orderBy(*order))
    sized = frame.withColumn("k", place).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(kind)))
    prose = F.max(F.when(F.col(kind) == "prose", F.col("n"))).over(W.partitionBy())
    prose_cap = F.least(F.coalesce(prose, F.lit(0)), F.lit(max(1, limit // 4)))
    code_cap = limit - prose_cap
    tier = (
        F.when((F.col(kind) == "code") & (F.col("k") <= code_cap), 0)
        .when((F.col(kind) == "prose") & (F.col("k") <= prose_cap), 1)
        .when(F.col(kind) == "other", 2)
        .when(F.col(kind) == "code", 3)
    )
    kept = sized.where(F.col("k") <= limit).withColumn("tier", tier).where("tier IS NOT NULL")
    final = F.row_number().over(W.orderBy("tier", "k"))
    return kept.withColumn("position", final).where(F.col("position") <= limit).drop("n", "k")


def tfidf_scores(texts: DataFrame, key: str, text: str, query: int) -> DataFrame:
    """(key, score): cosine of each text with the query's row, by term frequency and smoothed rarity; for the few candidates of one query."""
    terms = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit("([a-z0-9_]{2,})"), 1)).alias("term"))
    tf = stage(terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")), "terms")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = texts.agg(F.count(F.lit(1)).alias("n"))  # one row
    v = tf.join(df, "term").join(F.broadcast(n)).select(key, "term", (F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("v"))
    asked = v.where(F.col(key) == query).select("term", F.col("v").alias("qv"))
    length = asked.agg(F.sqrt(F.sum(F.col("qv") * F.col("qv"))).alias("qlen"))  # one row
    both = v.where(F.col(key) != query).join(asked, "term", "left").groupBy(key).agg(F.sum(F.col("v") * F.col("qv")).alias("dot"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("len"))
    return both.where("dot IS NOT NULL").join(F.broadcast(length)).select(key, F.round(F.col("dot") / (F.col("len") * F.col("qlen")), 6).alias("score"))


#: Weights of the smart score's terms, ranges of scores by source, and the boosts of groups.
SMART_WEIGHTS = {"relevance": 0.4, "confidence": 0.3, "frequency": 0.2, "recency": 0.1}
SCORE_RANGES = {"bm25": (0.0, 15.0), "semantic": (0.0, 1.0), "fuzzy": (0.0, 1.0)}


def normal_score(score: Column, source: Column, default: float = 0.5) -> Column:
    """A score brought to [0, 1] by its source's range; of unknown sources above 1.5 as lexical, else as similarity; the default without a score."""
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (a, b) in SCORE_RANGES.items():
        low, high = F.when(source == name, F.lit(a)).otherwise(low), F.when(source == name, F.lit(b)).otherwise(high)
    guessed = F.when(score > 1.5, F.lit(SCORE_RANGES["bm25"][1])).otherwise(1.0)
    low, high = F.coalesce(low, F.lit(0.0)), F.coalesce(high, guessed)
    # least and greatest skip nulls, so a missing score is asked for first.
    return F.when(score.isNull(), F.lit(default)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - low) / (high - low))))


def smart_score(results: DataFrame, group: str, order: list[Column], default: float = 0.5) -> DataFrame:
    """(group, size, files, score) of groups of results (file, line, snippet, score, source): relevance of the first by `order`, confidence
    and frequency by the group's size, recency as the default, then boosts for several results, for lines close together in one file, for a
    short snippet of one line, for a high lexical score, for a very high similarity. Partial aggregation, no group is gathered."""
    first = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("score"), F.col("source"))).alias("first")
    short = F.max((F.length("snippet") < 100) & ~F.contains("snippet", F.lit("\n"))).alias("short")
    # The number of files matters up to two.
    found = results.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.min("file").alias("a"), F.max("file").alias("b"), (F.max("line") - F.min("line")).alias("span"), short, first)
    score, source = F.col("first.score"), F.col("first.source")
    relevance, several = normal_score(score, source, default), F.col("size") > 1
    files = F.col("a") != F.col("b")
    confidence = F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("size") / 3) + F.when(several, 0.1).otherwise(0.0))
    frequency = F.least(F.lit(1.0), F.col("size") / 5) * F.when(files, 1.2).otherwise(1.0)
    base = relevance * SMART_WEIGHTS["relevance"] + confidence * SMART_WEIGHTS["confidence"] + frequency * SMART_WEIGHTS["frequency"] + default * SMART_WEIGHTS["recency"]
    near = F.when(several & ~files & (F.col("span") <= 5), 1.1).when(several & ~files & (F.col("span") <= 10), 1.05).otherwise(1.0)
    boost = F.when(several, 1.1).otherwise(1.0) * near * F.when(F.col("short"), 1.05).otherwise(1.0)
    boost = boost * F.when((source == "bm25") & (score > 10), 1.05).otherwise(1.0) * F.when((source == "semantic") & (relevance > 0.9), 1.03).otherwise(1.0)
    return found.select(group, "size", F.when(files, 2).otherwise(1).alias("files"), F.round(F.least(F.lit(1.0), base * boost), 6).alias("score"))
