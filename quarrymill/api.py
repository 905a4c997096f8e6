"""A session facade: search, look-up, indexing and the registries of extensions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import ranking, text
from quarrymill.operators import fusion, fuzzy, index, lexical, states
from quarrymill.session import stage
from quarrymill.sources import code

Strategy = Callable[[DataFrame], DataFrame]


class Registry:
    """Named callables: rerankers, search strategies, aggregation strategies."""

    def __init__(self):
        self.entries: dict[str, Callable] = {}

    def register(self, name: str, entry: Callable) -> None:
        self.entries[name] = entry

    def run(self, names: list[str], frame: DataFrame) -> DataFrame:
        """The first named entry that does not raise; entries build plans, so a failure shows at once."""
        problem: Exception | None = None
        for name in names:
            try:
                return self.entries[name](frame)
            except Exception as error:  # noqa: BLE001  any failing plan falls back to the next
                problem = error
        raise LookupError(f"no entry of {names} works") from problem


RERANKERS, STRATEGIES, AGGREGATORS = Registry(), Registry(), Registry()
STRATEGIES.register("best_first", lambda f: f.orderBy(F.desc("score"), "file_id"))
AGGREGATORS.register("first_per_file", lambda f: fusion.first_per(f, ["file_id"], [F.desc("score"), F.asc("line")]))


def pair_scorer(score: Callable[[list[str]], list[float]]) -> Callable[[DataFrame], DataFrame]:
    """A reranker from a model's batch scoring function, shipped to workers as an Arrow-batched function."""

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(score(texts.fillna("").tolist()), dtype="float64")

    return lambda frame: frame.withColumn("rerank_score", scored(F.col("content")))


def plain_tokens(text: str | None) -> list[str]:
    return index.terms_of(text)


def apply_reranker(candidates: DataFrame, name: str | None, limit: int, order: list[Column], fallback: str | None = None) -> tuple[DataFrame, dict]:
    """(rows, outcome): the candidates of one query by a registered reranker.

    Candidates whose path is noise (penalty 1 and more) go, unless all are. They are scored in one stored step, so a
    reranker that fails in its tasks is seen: then the fallback scores, or the given order stays. outcome names what
    happened, as `states.rerank_outcome` has it, with counts and providers.
    """
    few = stage(candidates, "candidates")  # the candidates of one query, so this and the scored rows are small
    n = few.count()
    facts = {"configured": name is not None, "semantic": False, "skips_semantic": False, "raised": False, "fallback": False, "last_error": None, "reordered": False}
    kept = few.where(ranking.path_penalty(F.col("path")) < 1.0)
    if kept.isEmpty():
        kept = few
    found = None
    for entry in [x for x in (name, fallback) if x]:
        try:
            found = stage(RERANKERS.entries[entry](kept), "reranked")
            facts["fallback"] = entry != name
            break
        except Exception as error:  # noqa: BLE001  a failing provider hands over to the next
            facts["last_error"] = type(error).__name__
    if found is None:
        facts["raised"] = name is not None
        rows = few.orderBy(*order).limit(limit).withColumn("rerank_score", F.lit(None).cast("double"))
    else:
        if not facts["fallback"]:
            facts["last_error"] = None
        rows = found.orderBy(F.desc("rerank_score"), *order).limit(limit)
        before = [r[0] for r in kept.orderBy(*order).limit(limit).select(few.columns[0]).collect()]
        facts["reordered"] = before != [r[0] for r in rows.select(few.columns[0]).collect()]
    spark = candidates.sparkSession
    schema = "configured boolean, semantic boolean, skips_semantic boolean, raised boolean, fallback boolean, last_error string, reordered boolean"
    verdict = spark.createDataFrame([tuple(facts.values())], schema).select(states.rerank_outcome().alias("o")).first().o
    return rows, {"outcome": verdict, "provider": fallback if facts["fallback"] else name, "failed_provider": name if facts["fallback"] else None, "candidates": n, "returned": min(n, limit)}


def run_branches(spark: SparkSession, branches: dict[str, Callable[[], DataFrame]], seconds: float = 3600.0) -> DataFrame:
    """(branch, status, hits): search branches as jobs side by side; one that fails or takes longer than `seconds` is
    reported and cancelled, and the others' results count."""
    from concurrent.futures import ThreadPoolExecutor
    from concurrent.futures import TimeoutError as Late

    group = uuid.uuid4().hex

    def job(name: str, build: Callable[[], DataFrame]) -> int:
        spark.addTag(f"{group}-{name}")
        try:
            counted = Observation()
            build().observe(counted, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()  # all columns are computed, nothing is kept
            return counted.get["n"]
        finally:
            spark.removeTag(f"{group}-{name}")

    out = []
    with ThreadPoolExecutor(len(branches)) as pool:
        running = {name: pool.submit(job, name, build) for name, build in branches.items()}
        for name, future in running.items():
            try:
                out.append((name, "ok", future.result(seconds)))
            except Late:
                spark.interruptTag(f"{group}-{name}")
                out.append((name, "late", 0))
            except Exception:  # noqa: BLE001  the branch is lost, not the search
                out.append((name, "failed", 0))
    return spark.createDataFrame(out, "branch string, status string, hits long")


#: Tables of the engine's catalog.
TABLES = {
    "repositories": "repo_id bigint, name string, path string, tracked_branch string, priority int, active boolean",
    "files": "file_id bigint, repo_id bigint, path string, language string, hash string, size bigint, is_deleted boolean, deleted_at timestamp",
    "symbols": "symbol_id bigint, file_id bigint, name string, kind string, line_start int, line_end int, signature string",
    "refs": "symbol_id bigint, file_id bigint, line_number int, reference_kind string",
    "chunks": "chunk_id string, file_id bigint, content string, line_start int, line_end int, parent_chunk_id string",
    "summaries": "chunk_id string, profile string, summary string",
}


def create_tables(spark: SparkSession, database: str, location: str) -> None:
    """The catalog's database and tables where they are not there yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def hashed_vector(content: Column, dimensions: int = 64) -> Column:
    """A vector without a model: counts of tokens by hash."""
    buckets = F.transform(lexical.tokens(content), lambda t: F.pmod(F.xxhash64(t), F.lit(dimensions)))
    # One fold, so that the tokens are found once for a text and not once for a dimension.
    empty = F.array_repeat(F.lit(0.0).cast("float"), dimensions)
    return F.aggregate(buckets, empty, lambda v, b: F.transform(v, lambda x, i: F.when(i == b, x + F.lit(1.0).cast("float")).otherwise(x)))


class Engine:
    """Files and symbols of one session, searched by any mode."""

    def __init__(self, spark: SparkSession, files: DataFrame, symbols: DataFrame):
        self.spark, self.files, self.symbols = spark, files, symbols

    def symbols_of(self, language: str = "language") -> DataFrame:
        """Symbols parsed from the files."""
        return code.extract(self.files, "file_id", language, "content")

    def lookup(self, name: str, limit: int = 20) -> DataFrame:
        """Symbols of that name first, then names that hold it."""
        hits = self.symbols.where(F.contains(F.lower("name"), F.lit(name.lower())))
        return hits.orderBy(F.when(F.col("name") == name, 0).otherwise(1), "name", "symbol_id").limit(limit)

    def search(self, query: str, mode: str = "auto", limit: int = 20) -> DataFrame:
        """(file_id, score), higher is better, by lexical, fuzzy, symbol or fused search."""
        if mode == "auto":
            asked = self.spark.range(1).select(text.intent(F.lit(query)).alias("i")).first().i
            mode = "symbol" if asked["intent"] == "symbol" else "lexical"
        terms = [t for t in query.lower().split() if t.isalnum()] or [query.lower()]
        if mode == "symbol":
            found = fuzzy.similar(self.symbols, "symbol_id", "name", query).join(self.symbols.select("symbol_id", "file_id"), "symbol_id")
            return found.groupBy("file_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "file_id").limit(limit)
        if mode == "fuzzy":
            return fuzzy.similar(self.files, "file_id", "path", query).select("file_id", "score").orderBy(F.desc("score"), "file_id").limit(limit)
        ranked = index.stored(self.files, "file_id", ("content",)).top(" ".join(terms), limit).withColumnRenamed("key", "file_id")
        if mode == "lexical":
            return ranked.select("file_id", (-F.col("score")).alias("score"))
        other = fuzzy.similar(self.files, "file_id", "path", query).orderBy(F.desc("score"), "file_id").limit(limit)
        lists = [fusion.ranked(ranked, "file_id", [F.asc("score"), F.asc("file_id")], "bm25", 0), fusion.ranked(other, "file_id", [F.desc("score"), F.asc("file_id")], "fuzzy", 1)]
        return fusion.reciprocal_rank(lists, {"bm25": 0.7, "fuzzy": 0.3}, "file_id").select("file_id", "score").orderBy(F.desc("score"), "file_id").limit(limit)
