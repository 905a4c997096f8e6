"""Vector similarity without an index: matrices of an Arrow batch against blocks of queries, then top k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.session import stage

#: Queries of one block: gathered on the driver and broadcast, 4 MB at 64 numbers each.
BLOCK_QUERIES = 8192
#: Scores are rounded to five digits after the cut, so what is this close to the last one kept stays.
MARGIN = 3e-5
#: Scores that a task holds at a time.
BLOCK_SCORES = 1 << 22


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of numbers from a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def similarity(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of every row of a with every row of b; unknown metrics count as cosine. Distances are given as they are."""
    if metric == "dot":
        return a @ b.T
    if metric in ("euclid", "manhattan"):
        out = np.empty((len(a), len(b)))
        for j, row in enumerate(b):
            out[:, j] = np.sqrt(((a - row) ** 2).sum(axis=1)) if metric == "euclid" else np.abs(a - row).sum(axis=1)
        return out
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
    with np.errstate(invalid="ignore", divide="ignore"):
        return (a @ b.T) / norms


def nearest(points: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", weight: str | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k best points of each query; weight: a column that scores are multiplied by.

    Any number of queries: they go in blocks, each broadcast in turn, and with several blocks each one's result is
    stored. A task keeps its batches' k best rows of each query (and ties), so few rows are shuffled.
    """
    n = queries.count()
    blocks = max(-(-n // BLOCK_QUERIES), 1)
    best = W.partitionBy("query_id").orderBy(F.desc("score") if metric not in ("euclid", "manhattan") else F.asc("score"), key)
    out = None
    for number in range(blocks):
        asked = queries.where(F.col(vector).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(blocks)) == number))
        rows = _scored(points, asked.select(key, vector).collect(), k, metric, key, vector, weight)
        found = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = stage(found, "nearest") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def _scored(points: DataFrame, asked: list, k: int, metric: str, key: str, vector: str, weight: str | None) -> DataFrame:
    kind = points.schema[key].dataType.simpleString()
    ids = [r[0] for r in asked]
    wanted = np.array([r[1] for r in asked], np.float64).reshape(len(ids), len(asked[0][1]) if asked else 0)
    shipped = points.sparkSession.sparkContext.broadcast((ids, wanted))  # BLOCK_QUERIES rows at most, about
    sign = -1 if metric in ("euclid", "manhattan") else 1

    def run(batches):
        names, b = shipped.value
        for batch in batches if names else ():
            step = max(BLOCK_SCORES // max(len(names), 1), 1)
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                scores = similarity(metric, matrix(part.column(1)), b)
                weights = part.column(2).to_numpy(zero_copy_only=False) if weight else np.ones(len(part))
                ranked = sign * np.where(np.isnan(scores), -sign * np.inf, scores * weights[:, None])
                if k < len(ranked):
                    least = np.partition(ranked, len(ranked) - k, axis=0)[len(ranked) - k]
                    row, col = np.nonzero(ranked >= least - MARGIN * max(np.abs(weights).max(), 1))
                else:
                    row, col = np.nonzero(np.ones_like(ranked, bool))
                picked = part.column(0).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in col.tolist()], part.schema.field(0).type), picked, pa.array(scores[row, col]), pa.array(weights[row])], ["query_id", "key", "score", "weight"])

    columns = [F.col(key).alias("key"), F.col(vector).alias("v"), *([F.col(weight).cast("double").alias("w")] if weight else [])]
    picked = points.where(F.col(vector).isNotNull()).select(*columns)
    rows = picked.mapInArrow(run, f"query_id {kind}, key {kind}, score double, weight double")
    score = F.round("score", 5)
    return rows.select("query_id", F.col("key").alias(key), (F.round(score * F.col("weight"), 5) if weight else score).alias("score"))
