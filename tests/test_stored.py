"""Stored tables that change in place: index bounds and ranges, vector cells, keyed parts."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import index, vector
from quarrymill.operators.keyed import KeyedTable, cascade
from quarrymill.operators.vector_index import CollectionMismatch, VectorIndex, misfits
from quarrymill.session import list_files, scratch

DATA = "/root/testdata/sf0.01"


def local(path):
    return path.removeprefix("file://")


def times(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(local(path)) for f in files if f.endswith(".parquet")}


# -- inverted index ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.choice([1, 2, 4, 20, 60])))) for i in range(900)]
    return spark.createDataFrame(rows, "id long, body string").coalesce(2)


def test_bounds_give_the_same_rows_and_fewer_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_DOCS", 16)
    monkeypatch.setattr(index, "FREQUENT", 80)
    monkeypatch.setattr(index, "PART_POSTINGS", 150)
    made = index.StoredIndex(spark, scratch(spark, "bounds"), "id", ("body",))
    for i in range(2):
        made.add(corpus.where(F.col("id") % 2 == i))
    head = made.head()
    assert len(head["segments"]) == 2 and not head["gone"]
    # The most frequent term lies in several parts, so no task holds it whole.
    assert len(made._parts(head["segments"][0], ["w0"])) > 1
    rng, saved = random.Random(1), 0
    for _ in range(3):
        query = " ".join(f"w{min(int(rng.expovariate(0.1)), 59)}" for _ in range(rng.randint(1, 4)))
        plain = made.top(query, 10, skip=False).collect()
        found, read, every = made._top_by_bounds(query, 10, 1.0)
        assert found.collect() == plain == made.top(query, 10, skip=True).collect(), query
        assert read <= every
        saved += every - read
    assert saved > 0
    # Bounds do not hold while tombstones wait for a merge, and do again afterwards.
    made.remove(spark.range(0, 900, 7).toDF("id"))
    assert made._top_by_bounds("w1 w2", 10, 1.0) is None
    before = made.top("w1 w2", 10).collect()
    made.optimize()
    assert made._top_by_bounds("w1 w2", 10, 1.0)[0].collect() == before and all(r.key % 7 for r in before)


def test_what_an_index_derives_from_its_postings_is_stored_with_them(spark, monkeypatch):
    """Lengths, bounds and counts of documents come with the sorted postings: nothing is grouped by row or by block any more."""
    monkeypatch.setattr(index, "BLOCK_DOCS", 4)
    docs = spark.createDataFrame([(1, "a b a", "b c"), (2, "a", None), (3, None, "a a"), (4, None, None)] + [(i, "b d", "d") for i in range(5, 40)], "id long, one string, two string")
    made = index.StoredIndex(spark, scratch(spark, "derived"), "id", ("one", "two"))
    assert {r.decision for r in made.add(docs).collect()} == {"add"}
    assert {(r.key, r.total) for r in made.documents().where("key < 6").collect()} == {(1, 5), (2, 1), (3, 2), (4, 0), (5, 3)}
    found = made.postings()
    per_block = found.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("tf"), F.min("total").alias("total"))
    stored = found.where("block_n IS NOT NULL").select("term", "block", F.col("block_n").cast("long").alias("n"), F.col("block_tf").alias("tf"), F.col("block_total").alias("total"))
    assert sorted(per_block.collect()) == sorted(stored.collect())
    assert {tuple(r) for r in made.vocabulary().collect()} == {("a", 3, 5), ("b", 36, 37), ("c", 1, 1), ("d", 35, 70)}
    assert made.vocabulary()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    # Tombstones, few or many, take out whole rows.
    for most in (index.GONE_ROWS, 0):
        monkeypatch.setattr(index, "GONE_ROWS", most)
        made.remove(spark.createDataFrame([(1 if most else 2,)], "id long"))
        assert {tuple(r) for r in made.vocabulary().where("term = 'a'").collect()} == {("a", 2, 3) if most else ("a", 1, 2)}
    made.optimize()
    assert {tuple(r) for r in made.vocabulary().collect()} == {("a", 1, 2), ("b", 35, 35), ("d", 35, 70)}


def test_segments_merge_by_size(spark):
    made = index.StoredIndex(spark, scratch(spark, "tiers"), "id", ("body",))
    made.add(spark.range(100).select("id", F.lit("large segment of many rows").alias("body")))
    for i in range(4):
        made.add(spark.createDataFrame([(1000 + i, f"small one {i}")], "id long, body string"))
    head = made.head()
    # The large segment was not written again when four small ones became one.
    assert head["segments"][0] == 1 and len(head["segments"]) == 2 and head["documents"] == 104
    made.add(spark.createDataFrame([(5, "changed"), (1001, "changed")], "id long, body string"))
    assert {r.key for r in made.scores("changed").collect()} == {5, 1001} and made.scores("large").count() == 99
    made.vacuum()
    assert made.scores("small").count() == 3 and made.head()["documents"] == 104


def test_files_written_anew_are_indexed_anew(spark, tmp_path):
    path = str(tmp_path / "docs")
    one = spark.createDataFrame([(1, "first words")], "id long, body string").coalesce(1)
    one.write.parquet(path)
    name = next(f for f in os.listdir(path) if f.endswith(".parquet"))
    read = lambda: spark.read.schema("id long, body string").parquet(path)
    assert index.stored(read(), "id", ("body",)).scores("first").count() == 1
    assert index.stored(read(), "id", ("body",)) is index.stored(read(), "id", ("body",))
    other = str(tmp_path / "other")
    spark.createDataFrame([(1, "second words, and more of them")], "id long, body string").coalesce(1).write.parquet(other)
    os.remove(os.path.join(path, f".{name}.crc"))
    os.replace(os.path.join(other, next(f for f in os.listdir(other) if f.endswith(".parquet"))), os.path.join(path, name))
    assert index.stored(read(), "id", ("body",)).scores("second").count() == 1


# -- vectors -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def points(spark):
    return spark.read.parquet(f"{DATA}/embeddings.parquet")


def pairs(frame):
    return {(r.query_id, r.vec_id, r.rank, r.score) for r in frame.collect()}


def test_vector_index_recall_and_bounds(spark, points):
    made = VectorIndex.build(points, scratch(spark, "vectors"), 64)
    queries = points.where("vec_id % 20 = 0")
    whole = pairs(vector.nearest(points, queries, 10))
    assert pairs(made.exact(queries, 10)) == whole
    probes = made.probes_for(points.where("vec_id % 20 = 10"), 10)
    some = pairs(made.search(queries, 10, probes))
    held = {(q, v) for q, v, _, _ in whole}
    assert len(held & {(q, v) for q, v, _, _ in some}) >= 0.9 * len(held) and probes < len(made.centres)
    plan = made.search(queries.limit(1), 10, 1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan)


def test_vector_index_by_distance(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(i % 5 * 20, 1, 6).tolist(), "x") for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, note string")
    made = VectorIndex.build(frame, scratch(spark, "vectors"), 6, "euclid", cells=5)
    queries = frame.where("vec_id % 37 = 0")
    assert pairs(made.exact(queries, 7)) == pairs(vector.nearest(frame, queries, 7, "euclid"))
    assert len(pairs(made.search(queries, 7, 1)) & pairs(vector.nearest(frame, queries, 7, "euclid"))) > 50


def test_vector_index_refuses_and_changes(spark, points):
    small = points.where("vec_id < 200")
    path = scratch(spark, "vectors")
    made = VectorIndex.build(small, path, 64, cells=12)
    with pytest.raises(CollectionMismatch):
        VectorIndex(spark, path, 32)
    with pytest.raises(CollectionMismatch):
        VectorIndex(spark, path, 64, "euclid")
    with pytest.raises(CollectionMismatch):
        VectorIndex.build(small, scratch(spark, "vectors"), 64, "dot")
    short = small.select("vec_id", F.slice("embedding", 1, 5).alias("embedding"), "label")
    for refused in (lambda: made.upsert(short), lambda: made.search(short, 3, 1).collect()):
        with pytest.raises(Exception, match="CollectionMismatch"):
            refused()
    assert {r.reason: r.rows for r in misfits(short.union(small), "embedding", 64).collect()} == {"dimension": 200, "fits": 200}
    before = times(f"{path}/vectors")
    touched = made.upsert(small.where("vec_id = 3").withColumn("label", F.lit(77)))
    after = times(f"{path}/vectors")
    still = {f for f in before if not any(f"part={c}/" in f for c in touched)}
    assert 1 <= len(touched) < 12 and still and all(after.get(f) == before[f] for f in still)
    made.upsert(points.where("vec_id = 300"))
    made.delete(spark.createDataFrame([(5,), (9999,)], "vec_id long"))
    rows = {r.vec_id: r.label for r in made.rows().collect()}
    assert len(rows) == 200 and rows[3] == 77 and 300 in rows and 5 not in rows
    made.delete_stale(small.where("vec_id >= 100"))
    assert {r.vec_id for r in made.rows().collect()} == set(range(100, 200))
    again = VectorIndex(spark, path, 64)
    assert again.search(small.where("vec_id = 150"), 1, 1).first().vec_id == 150


def test_vector_index_of_nothing(spark, points):
    made = VectorIndex.build(points.limit(0), scratch(spark, "vectors"), 64)
    assert made.rows().count() == 0 if list_files(spark, f"{made.path}/vectors") else True
    assert len(made.centres) == 0


# -- keyed tables ------------------------------------------------------------------------------


def test_keyed_changes_touch_their_parts_only(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10).alias("v"), F.lit("a").alias("note"))
    path = scratch(spark, "keyed")
    table = KeyedTable.store(rows, path, ("k",), parts=20)
    before = times(path)
    touched = table.upsert(spark.createDataFrame([(5, 100, "b"), (5, 200, "a"), (5000, 1, "c"), (None, 7, "n")], "k long, v long, note string"), combine={"v": F.col("old.v") + F.col("new.v")})
    after = times(path)
    still = {f for f in before if not any(f"part={p}/" in f for p in touched)}
    assert len(touched) <= 3 and still and all(after.get(f) == before[f] for f in still)
    got = {r.k: (r.v, r.note) for r in table.read().collect()}
    assert len(got) == 1002 and got[5] == (205, "a") and got[5000] == (1, "c") and got[None] == (7, "n")
    table.upsert(spark.createDataFrame([(None, 8, "z"), (6, 1, "late"), (6, 9, "early")], "k long, v long, note string"), latest="note")
    got = {r.k: (r.v, r.note) for r in table.read().collect()}
    assert len(got) == 1002 and got[None] == (8, "z") and got[6] == (1, "late")
    gone = table.delete(spark.range(0, 990).toDF("k"))
    assert gone.count() == 990 and sorted(r.k for r in table.read().where("k IS NOT NULL").collect()) == [*range(990, 1000), 5000]
    assert table.delete(spark.range(0, 990).toDF("k")).count() == 0
    plan = table.read(spark.createDataFrame([(995,)], "k long"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan)


def test_cascade(spark):
    files = KeyedTable.store(spark.range(10).toDF("f"), scratch(spark, "f"), ("f",), parts=3)
    chunks = KeyedTable.store(spark.range(40).select((F.col("id") % 10).alias("f"), F.col("id").alias("c")), scratch(spark, "c"), ("f", "c"), ("f",), parts=4)
    points = KeyedTable.store(spark.range(40).select(F.col("id").alias("c")), scratch(spark, "p"), ("c",), parts=4)
    gone = cascade(files, spark.createDataFrame([(2,), (77,)], "f long"), [(chunks, files, {"f": "f"}), (points, chunks, {"c": "c"})])
    assert sorted(r.c for r in gone[id(points)].collect()) == [2, 12, 22, 32] and points.read().count() == 36 and chunks.read().count() == 36 and files.read().count() == 9
