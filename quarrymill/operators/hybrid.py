"""A hybrid search as one run: branches side by side under a deadline, fusion of those that answer, a rerank, the final shape, a cache.

Each branch is a plan of (key, order columns) that is written as its ranked rows by a job of its own tag. A branch that fails, or has not
ended when the deadline comes, is reported and cancelled, and the others are fused. Results of a finished run are kept under a hash of
the query and its settings until they are older than `ttl`; a run with a lost branch is not kept.

Defined cases: no branch that answers gives no rows; an empty branch is one that answers; a reranker that fails leaves the fused order.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.operators import fusion
from quarrymill.session import list_files, read_small, scratch, shared_folder, stage, write_small


@dataclass
class Branch:
    """build: gives the branch's rows; order: their order, best first; weight: its part in the fusion."""

    build: Callable[[], DataFrame]
    order: list[Column]
    weight: float = 1.0


@dataclass
class Answer:
    rows: DataFrame
    #: (status, hits) of every branch: ok, failed, late.
    branches: dict[str, tuple[str, int]]
    reranked: bool
    from_cache: bool = False


def run_branches(spark: SparkSession, branches: dict[str, Branch], key: str, limit: int, seconds: float) -> tuple[list[DataFrame], dict[str, tuple[str, int]]]:
    """The ranked rows (key, rank, branch, branch_pos) of the branches that ended in time, and each one's status."""
    group, root = uuid.uuid4().hex, scratch(spark, "hybrid")

    def job(position: int, name: str, branch: Branch) -> DataFrame:
        spark.addTag(f"{group}-{name}")
        try:
            best = branch.build().orderBy(*branch.order).limit(limit)
            fusion.ranked(best, key, branch.order, name, position).write.parquet(f"{root}/{position}")
            return spark.read.parquet(f"{root}/{position}")
        finally:
            spark.removeTag(f"{group}-{name}")

    found, status, end = [], {}, time.monotonic() + seconds
    pool = ThreadPoolExecutor(max(len(branches), 1))
    try:
        running = {name: pool.submit(job, i, name, b) for i, (name, b) in enumerate(branches.items())}
        for name, future in running.items():
            try:
                rows = future.result(max(end - time.monotonic(), 0))
                found.append(rows)
                status[name] = ("ok", rows.count())
            except Late:
                spark.interruptTag(f"{group}-{name}")
                status[name] = ("late", 0)
            except Exception:  # noqa: BLE001  the branch is lost, not the search
                status[name] = ("failed", 0)
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    return found, status


def search(
    spark: SparkSession, query: str, branches: dict[str, Branch], key: str, limit: int = 20, pool: int = 50, seconds: float = 600.0, k: int = 60,
    rerank: Callable[[DataFrame], DataFrame] | None = None, finish: Callable[[DataFrame], DataFrame] | None = None, settings: dict | None = None, ttl: float = 0.0,
) -> Answer:
    """Fused rows (key, score, best_branch, n_branches), reranked, finished and cut to `limit`.

    pool: rows of each branch that are fused; rerank: gives (key, rerank_score) of fused rows, which then order by it; finish: the rows' final
    columns, with `score` and the key among them; settings: what else names the result in the cache; ttl: seconds that it is kept, 0 for not at all.
    """
    name = hashlib.sha256(json.dumps([query, sorted(branches), key, limit, pool, k, settings or {}], sort_keys=True).encode()).hexdigest()
    cache = f"{shared_folder(spark)}/hybrid-cache/{spark.sparkContext.applicationId}"
    if ttl:
        kept = [n for n in list_files(spark, cache) if n.startswith(name) and n.endswith(".json")]
        for entry in sorted((json.loads(read_small(spark, f"{cache}/{n}")) for n in kept), key=lambda e: -e["at"]):
            if time.time() - entry["at"] < ttl:
                return Answer(spark.read.parquet(entry["rows"]), {b: tuple(s) for b, s in entry["branches"].items()}, entry["reranked"], True)
    lists, status = run_branches(spark, branches, key, pool, seconds)
    if not lists:
        empty = next(iter(branches.values())).build().select(key).limit(0) if branches else spark.createDataFrame([], f"{key} string")
        return Answer(empty.withColumn("score", F.lit(0.0)), status, False)
    rows = stage(fusion.reciprocal_rank(lists, {b: branches[b].weight for b in branches}, key, k), "fused")
    order, reranked = [F.desc("score"), F.asc(key)], False
    if rerank:
        try:
            scored = stage(rerank(rows).select(key, F.col("rerank_score").cast("double").alias("rerank_score")), "reranked")
            rows, reranked = rows.join(scored, key, "left"), True
            order = [F.desc_nulls_last("rerank_score"), *order]
        except Exception:  # noqa: BLE001  the fused order stays
            reranked = False
    rows = rows.withColumn("place", F.row_number().over(W.orderBy(*order)))  # a few rows a branch
    if finish:
        rows = finish(rows).orderBy(F.desc("score"), key)
    else:
        rows = rows.orderBy("place")
    rows = stage(rows.limit(limit), "hybrid")
    if ttl and all(s == "ok" for s, _ in status.values()):
        entry = {"at": time.time(), "rows": rows.inputFiles()[0].rpartition("/")[0] if rows.inputFiles() else "", "branches": status, "reranked": reranked}
        if entry["rows"]:
            write_small(spark, f"{cache}/{name}-{uuid.uuid4().hex}.json", json.dumps(entry).encode())
    return Answer(rows, status, reranked)
