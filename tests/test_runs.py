"""Hybrid runs with lost branches, callers of references, ranks, smart scores and typed metadata, against plain Python."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import callgraph, fusion, hybrid, metadata


def branch(spark, ids, weight=1.0, build=None):
    rows = [(i, float(n)) for n, i in enumerate(ids)]
    return hybrid.Branch(build or (lambda: spark.createDataFrame(rows, "id long, s double")), [F.asc("s"), F.asc("id")], weight)


def fused(lists, k=60):
    out = {}
    for ids, weight in lists:
        for n, i in enumerate(ids):
            out[i] = out.get(i, 0) + weight / (k + n + 1)
    return sorted(((round(s, 8), i) for i, s in out.items()), key=lambda x: (-x[0], x[1]))


def test_a_failing_and_a_slow_branch_leave_the_others(spark):
    broken = F.udf(lambda x: x // 0, "bigint")
    sleepy = F.udf(lambda x: time.sleep(90) or x, "bigint")
    a, b = [5, 3, 8, 1], [3, 9, 5]
    base = spark.range(1).select("id", F.lit(1.0).alias("s"))
    every = {
        "a": branch(spark, a, 0.7), "failed": branch(spark, [], build=lambda: base.select(broken("id").alias("id"), "s")), "b": branch(spark, b, 0.3),
        "slow": branch(spark, [], build=lambda: base.select(sleepy("id").alias("id"), "s")), "none": branch(spark, [], build=lambda: base.where("id > 5")),
    }
    began = time.time()
    answer = hybrid.search(spark, "q", every, "id", seconds=25)
    assert time.time() - began < 80
    assert answer.branches == {"a": ("ok", 4), "failed": ("failed", 0), "b": ("ok", 3), "slow": ("late", 0), "none": ("ok", 0)}
    assert [(r.score, r.id) for r in answer.rows.orderBy(F.desc("score"), "id").collect()] == fused([(a, 0.7), (b, 0.3)])


def test_rerank_cache_and_nothing(spark):
    made = []

    def counted(ids):
        def build():
            made.append(1)
            return spark.createDataFrame([(i, float(n)) for n, i in enumerate(ids)], "id long, s double")

        return branch(spark, ids, build=build)

    every = {"a": counted([1, 2, 3]), "b": counted([3, 4])}
    answer = hybrid.search(spark, "q", every, "id", limit=2, rerank=lambda rows: rows.select("id", (F.col("id") * 1.0).alias("rerank_score")), ttl=60, settings={"run": time.time_ns()})
    assert answer.reranked and [r.id for r in answer.rows.orderBy("place").collect()] == [4, 3]
    settings = {"run": 1, "at": time.time_ns()}
    first = hybrid.search(spark, "q", every, "id", ttl=60, settings=settings)
    n = len(made)
    again = hybrid.search(spark, "q", every, "id", ttl=60, settings=settings)
    assert again.from_cache and not first.from_cache and len(made) == n and again.rows.collect() == first.rows.collect()
    assert not hybrid.search(spark, "other", every, "id", ttl=60, settings=settings).from_cache
    broken = hybrid.search(spark, "q", every, "id", rerank=lambda rows: rows.select("id", F.raise_error(F.lit("no")).alias("rerank_score")))
    assert not broken.reranked and broken.rows.count() == 4
    lost = hybrid.search(spark, "q", {"x": branch(spark, [], build=lambda: spark.range(1).select("id", F.raise_error(F.lit("no")).cast("double").alias("s")))}, "id")
    assert lost.rows.count() == 0 and lost.branches == {"x": ("failed", 0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_callers_against_all_intervals(spark, seed):
    rng = random.Random(seed)
    symbols = [(i, rng.randint(0, 2), s, s + rng.choice([0, 1, 5, 40, 700, -3])) for i, s in enumerate(rng.choices(range(1200), k=150))] + [(900, 0, None, 5)]
    refs = [(n, rng.randint(0, 2), rng.randint(0, 1300)) for n in range(400)]
    got = callgraph.callers(spark.createDataFrame(refs, "ref_id long, file_id long, line long"), spark.createDataFrame(symbols, "symbol_id long, file_id long, line_start int, line_end int"))
    best = {}
    for n, file, line in refs:
        around = [(s, -e, -i) for i, f, s, e in symbols if f == file and s is not None and s <= line <= e]
        best[n] = -max(around)[2] if around else None
    assert {r.ref_id: r.caller for r in got.collect()} == best and sum(v is not None for v in best.values()) > 100


def test_ranks_and_selection(spark):
    edges = [(1, 2, 1), (1, 3, 3), (2, 3, 1), (3, 1, 1), (4, 1, 5), (3, 5, 1)]
    frame = spark.createDataFrame(edges, "src long, dst long, n long")
    seeds = spark.createDataFrame([(1,)], "node long")
    rank = {1: 1.0}
    for _ in range(6):
        new = {}
        for s, d, n in edges:
            new[d] = new.get(d, 0) + 0.85 * rank.get(s, 0) * n / sum(m for a, _, m in edges if a == s)
        new[1] = new.get(1, 0) + 1 - sum(new.values())
        rank = new
    got = {r.node: r.rank for r in callgraph.ranks(frame, seeds, rounds=6).collect()}
    assert got.keys() == {k for k, v in rank.items() if v} and all(abs(got[k] - rank[k]) < 1e-9 for k in got) and abs(sum(got.values()) - 1) < 1e-9
    nodes, inside = callgraph.select_context(frame, seeds, 2)
    kept = {r.node for r in nodes.collect()}
    assert len(kept) == 2 and {(r.src, r.dst) for r in inside.collect()} == {(s, d) for s, d, _ in edges if s in kept and d in kept}
    assert callgraph.ranks(frame, seeds.limit(0)).count() == 0


def test_smart_score_terms(spark):
    rows = [("one", 0, "f", 3, "short", 12.0, "bm25"), ("near", 0, "f", 3, "x" * 120, 0.95, "semantic"), ("near", 1, "f", 7, "x" * 120, 0.1, "semantic"), ("far", 0, "f", 3, "a\nb", 2.0, "odd"), ("far", 1, "g", 90, None, None, "odd"), ("none", 0, "f", 1, None, None, "bm25")]
    frame = spark.createDataFrame(rows, "k string, o int, file string, line int, snippet string, score double, source string")
    got = {r.k: (r.size, r.files, r.score) for r in fusion.smart_score(frame, "k", [F.col("o")]).collect()}
    third = 1 / 3
    expected = {
        "one": (1, 1, (0.8 * 0.4 + third * 0.3 + 0.2 * 0.2 + 0.05) * 1.05 * 1.05), "near": (2, 1, (0.95 * 0.4 + (2 * third + 0.1) * 0.3 + 0.4 * 0.2 + 0.05) * 1.1 * 1.1 * 1.03),
        "far": (2, 2, (2 / 15 * 0.4 + (2 * third + 0.1) * 0.3 + 0.4 * 1.2 * 0.2 + 0.05) * 1.1), "none": (1, 1, 0.5 * 0.4 + third * 0.3 + 0.2 * 0.2 + 0.05),
    }
    assert got == {k: (n, f, round(min(1, s), 6)) for k, (n, f, s) in expected.items()}


def test_envelopes_of_any_shape(spark):
    texts = [None, "", "nope", "[1]", "3", "{}", json.dumps({"version": 2, "type": "t2", "fields": {"k": 5, "note": None}}), json.dumps({"version": "7", "fields": {"k": "8"}}), json.dumps({"version": 9, "fields": {"k": [1]}}), json.dumps({"version": 1, "type": "t1", "fields": {"k": 1, "note": "old"}})]
    frame = spark.createDataFrame([("a", t) for t in texts] + [("b", None)], "key string, raw string")
    got = {r.key: tuple(r)[1:] for r in metadata.merge(frame, "key", "raw", {"k": "int", "note": "string"}).collect()}
    assert got == {"a": (9, None, 8, "old", 10), "b": (0, None, None, None, 1)}
    shape = metadata.shapes(frame, "raw").first()
    assert shape.malformed == 4 and shape.records == 11
