"""Steps that once grew faster than their input: chunkers' batches, closures of paths, distances to centres."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import chunking, graph, index, keyed, vector_index
from quarrymill.session import scratch


def test_chunks_go_out_in_bounded_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(1 << 28))
    try:
        docs = spark.createDataFrame([(i, None if i == 3 else "One two. Three four. " * i + "\n\nFive.") for i in range(40)], "doc_id long, text string").coalesce(1)
        monkeypatch.setattr(chunking, "ROUND_CHARS", 50)
        found = {(r.doc_id, r.chunk_index, r.content) for r in chunking.chunk(docs, "sliding").collect()}
        assert found == {(r.doc_id, i, c) for r in docs.collect() for i, c in enumerate(chunking.sliding(r.text or ""))}
        # A text is a row of the worker's batch, so a batch is held to megabytes however long texts are.
        assert int(spark.conf.get(key)) <= 8 << 20
    finally:
        spark.conf.set(key, before)


def pairs_of(edges):
    after, out = {}, set()
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for src in after:
        level, seen, d = after[src], set(), 0
        while level:
            d += 1
            out |= {(src, x, d) for x in level}
            seen |= level
            level = {y for x in level for y in after.get(x, ())} - seen
    return out


@pytest.mark.parametrize("kind", ["paths", "many"])
def test_closure_by_brute_force(spark, kind):
    rng = random.Random(5)
    if kind == "paths":
        # Chains into a loop of one, of two and of five, and a tree without one.
        edges = [(1, 1), (2, 1), (3, 2), (10, 11), (11, 10), (12, 11), (13, 12), *[(20 + i, 20 + (i + 1) % 5) for i in range(5)], (30, 22), (31, 30), *[(i, i // 2) for i in range(101, 140)]]
        edges += [(i, rng.choice(range(200, i))) for i in range(201, 220)]
    else:
        edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(20)]
    frame = spark.createDataFrame([*edges, edges[0]], "src long, dst long")
    found = [tuple(r) for r in graph.closure(frame).select("src", "dst", "distance").collect()]
    assert len(found) == len(set(found)) and set(found) == pairs_of(edges)


def test_a_level_of_paths_reads_no_earlier_level(spark, monkeypatch):
    plans = []
    kept = graph.stage
    monkeypatch.setattr(graph, "stage", lambda frame, name: plans.append((name, frame._jdf.queryExecution().optimizedPlan().toString())) or kept(frame, name))
    graph.closure(spark.createDataFrame([(i, i // 2) for i in range(1, 20)], "src long, dst long")).count()
    levels = [p for name, p in plans if name == "closure"]
    assert len(levels) > 4 and not any("LeftAnti" in p or "Aggregate" in p for p in levels[1:])


def test_nearest_centres_hold_few_distances(monkeypatch):
    rng = np.random.default_rng(2)
    rows, centres, most = rng.normal(size=(50, 4)), rng.normal(size=(7, 4)), []
    whole = vector_index.distances(rows, centres).argmin(axis=1)
    kept = vector_index.distances
    monkeypatch.setattr(vector_index, "distances", lambda a, b: most.append(len(a) * len(b)) or kept(a, b))
    monkeypatch.setattr(vector_index, "BLOCK_SCORES", 21)
    assert (vector_index.nearest(rows, centres) == whole).all() and max(most) <= 21


def test_scores_of_a_cell_come_in_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(120)], "vec_id long, embedding array<float>")
    made = vector_index.VectorIndex.build(points, scratch(spark, "vectors"), 4, cells=3)
    asked = points.where(F.col("vec_id") % 4 == 0)
    whole = {tuple(r) for r in made.search(asked, 5, 2).collect()}
    monkeypatch.setattr(vector_index, "BLOCK_SCORES", 64)
    assert {tuple(r) for r in made.search(asked, 5, 2).collect()} == whole and len(whole) == 150


def exchanges(spark, act):
    """Shuffles of the plans that an action runs."""
    seen, write = [], keyed.Parts._write

    def kept(self, rows, path, *above):
        seen.append(rows._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return write(self, rows, path, *above)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(keyed.Parts, "_write", kept)
        act()
    return seen


@pytest.mark.parametrize("few", [0, 1000])
def test_keyed_changes_shuffle_and_write_their_rows_once(spark, monkeypatch, few):
    monkeypatch.setattr(keyed, "ROWS_PER_LOT", 20)
    monkeypatch.setattr(keyed, "FEW_KEYS", few)
    rows = spark.range(600).select((F.col("id") % 50).alias("f"), F.when(F.col("id") % 50 != 7, F.col("id")).alias("c"), F.lit(None).cast("string").alias("was"))
    held = []
    assert exchanges(spark, lambda: held.append(keyed.KeyedTable.store(rows, scratch(spark, "t"), ("f", "c"), ("f",), parts=3))) == [1]
    table = held[0]
    assert table.read().count() == 600 - 11
    # Two sides meet, or one of them is broadcast; keys are made distinct by the same shuffle. A null is a key.
    keys = spark.createDataFrame([(7, None), (8, 8), (8, 8), (9, None), (999, 1)], "f long, c long")
    assert exchanges(spark, lambda: held.append(table.delete(keys))) == [2] if few == 0 else exchanges(spark, lambda: held.append(table.delete(keys)))
    assert sorted((r.f, r.c) for r in held[1].collect()) == [(7, None), (8, 8)] and table.read().count() == 587
    assert exchanges(spark, lambda: table.upsert(spark.createDataFrame([(8, 8, "x"), (8, 58, "y"), (8, 58, "z")], "f long, c long, was string"))) == [1]
    assert {r.c: r.was for r in table.read().where("f = 8 AND c < 100").collect()} == {8: "x", 58: "z"} and table.read().count() == 588
    before = {(r.f, r.c) for r in table.read().collect()}
    assert exchanges(spark, lambda: table.rekey({"c": -F.col("c"), "was": F.col("c").cast("string")})) == [0]
    assert {(r.f, r.was and int(r.was)) for r in table.read().collect()} == before
    with pytest.raises(ValueError):
        table.rekey({"f": F.lit(1)})
    assert table.delete(spark.range(0).toDF("f")).count() == 0
    assert table.delete(spark.range(50).toDF("f")).count() == 588 and table.read().count() == 0


def test_a_task_groups_a_lot_of_the_rows(spark, monkeypatch):
    """Rows that come of few, small files, as trigrams of names, are dealt before they are grouped."""
    monkeypatch.setattr(keyed, "ROWS_PER_LOT", 50)
    rows = spark.range(0, 40, 1, 1).select(F.explode(F.sequence(F.lit(0), F.lit(29))).alias("t"), F.col("id").alias("s"))
    table = keyed.KeyedTable.store(rows, scratch(spark, "t"), ("s", "t"), ("s",), parts=2)
    grouped = table.single(rows)
    sizes = [r.n for r in grouped.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 1200 and len(sizes) > 8 and max(sizes) < 300
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Exchange") and "Aggregate" not in plan[plan.index("Exchange") :]


def test_postings_are_shuffled_without_what_is_made_of_them(spark, monkeypatch):
    monkeypatch.setattr(index, "LEAST_POSTINGS", 50)
    plans, write = [], index.write_parts
    monkeypatch.setattr(index, "write_parts", lambda rows, *to: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(rows, *to))
    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i % 3} a") for i in range(60)], "id long, body string")
    made = index.StoredIndex(spark, scratch(spark, "narrow"), "id", ("body",))
    made.add(docs)
    made.remove(docs.where("id % 7 = 0").select("id"))
    made.optimize()
    assert len(plans) == 2
    for plan in plans:
        # One shuffle by range, of rows without frequency, block and part; the sort behind it begins with the term.
        above, below = plan.split("Exchange rangepartitioning")
        assert "size(positions" in above and "size(positions" not in below
        assert "Sort [term" in above and "Sort [part" not in plan
    assert {tuple(r) for r in made.vocabulary().where("term = 'a'").collect()} == {("a", 51, 102)}
    assert {r.tf for r in made.postings(["a"]).collect()} == {2} and made.scores("c1").count() == 17


@pytest.mark.parametrize("few", [1000, 0])
def test_texts_of_a_later_segment_are_not_shuffled_for_few_keys(spark, monkeypatch, few):
    monkeypatch.setattr(index, "GONE_ROWS", few)
    plans, write = [], index.StoredIndex._write_segment
    monkeypatch.setattr(index.StoredIndex, "_write_segment", lambda self, docs, n: plans.append(docs._jdf.queryExecution().executedPlan().toString()) or write(self, docs, n))
    made = index.StoredIndex(spark, scratch(spark, "later"), "id", ("body",))
    made.add(spark.createDataFrame([(i, "old") for i in range(20)], "id long, body string"))
    decided = made.add(spark.createDataFrame([(i, "old" if i < 10 else "new") for i in range(30)], "id long, body string"))
    assert sorted((r.decision, r.key) for r in decided.collect()) == [("add", i) for i in range(20, 30)] + [("skip", i) for i in range(10)] + [("update", i) for i in range(10, 20)]
    assert ("BroadcastHashJoin" in plans[1]) == (few > 0) and made.scores("new").count() == 20 and made.scores("old").count() == 10


def test_postings_of_a_term_are_gathered_before_the_shuffle(spark, monkeypatch):
    """What a round of text holds of a term is one row of the shuffle, and opens as postings with their columns, leads and bounds."""
    monkeypatch.setattr(index, "BLOCK_DOCS", 8)
    dealt, stage = [], index.stage
    monkeypatch.setattr(index, "stage", lambda rows, *to: dealt.append(stage(rows, *to)) or dealt[-1])
    rows = [(i, "a b a " * (i % 4), f"b c{i}" if i % 3 else None) for i in range(100)] + [(None, "a z", "z z")]
    docs = spark.createDataFrame(rows, "id long, one string, two string").coalesce(1)
    made = index.StoredIndex(spark, scratch(spark, "gathered"), "id", ("one", "two"))
    made.add(docs)
    wanted = []
    for key, *texts in rows:
        total, seen = sum(len(index.terms_of(t)) for t in texts), set()
        for col, text in enumerate(texts):
            words = index.terms_of(text)
            for term in dict.fromkeys(words):
                at = [i for i, w in enumerate(words) if w == term]
                wanted.append((term, key, col, len(at), at, total, term not in seen))
                seen.add(term)
    found = made.postings()
    order = lambda r: (r[0], r[1] is None, r[1] or 0, r[2])
    assert sorted(map(tuple, found.select("term", "key", "col", "tf", "positions", "total", "lead").collect()), key=order) == sorted(wanted, key=order)
    assert dealt[0].where("term IS NOT NULL").count() < len(wanted) / 2
    blocks = found.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("tf"), F.min("total").alias("low"), F.count("block_n").alias("given"), F.max("block_n").alias("bn"), F.max("block_tf").alias("bt"), F.max("block_total").alias("bl"))
    assert blocks.where("given <> 1 OR n <> bn OR tf <> bt OR low <> bl").count() == 0
    assert 8 <= found.where("term = 'a'").select("block").distinct().count() <= 13 and made.vocabulary().where("term = 'b'").first().docs == 91


def test_no_task_has_two_lots(spark, monkeypatch):
    """Each lot is a task of its own, and rows that are held against many keys are dealt into as many tasks as there are lots."""
    monkeypatch.setattr(keyed, "ROWS_PER_LOT", 40)
    monkeypatch.setattr(keyed, "FEW_KEYS", 10)
    rows = spark.range(1600).select("id", (F.col("id") % 7).alias("v"))
    table = keyed.KeyedTable.store(rows, scratch(spark, "t"), ("id",), parts=2)
    dealt = table.dealt(rows, 1600).select("lot", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(dealt) == 40 == len({r.lot for r in dealt}) == len({r.task for r in dealt})
    plans, write = [], keyed.Parts._write
    monkeypatch.setattr(keyed.Parts, "_write", lambda self, out, *to: plans.append(out._jdf.queryExecution().executedPlan().toString()) or write(self, out, *to))
    gone = table.delete(spark.range(0, 1600, 2).toDF("id"))
    assert plans[0].count("Exchange") == 2 == plans[0].count(", 40), REPARTITION_BY_NUM")
    assert gone.count() == 800 == table.read().where("id % 2 = 1").count() == table.read().count()


def test_postings_are_shuffled_as_packed_bytes(spark):
    """About as many bytes a posting as its key and its small numbers take, for terms of many postings and of one."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30_000)]
    rows = [(i * 1_000_003, " ".join(rng.choices(words[:400], k=150) + rng.choices(words, k=50))) for i in range(2000)]
    made = index.StoredIndex(spark, scratch(spark, "packed"), "id", ("body",))
    sc = spark.sparkContext
    sc.setJobGroup("packed", "")
    try:
        made.add(spark.createDataFrame(rows, "id long, body string").coalesce(2))
    finally:
        sc._jsc.clearJobGroup()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("packed") for s in sc.statusTracker().getJobInfo(j).stageIds}
    shuffled = sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    found = made.postings()
    assert found.count() == sum(len(set(t.split())) for _, t in rows) and found.agg(F.sum("tf")).first()[0] == 400_000
    assert 0 < shuffled < 19 * found.count(), shuffled / found.count()


def test_terms_of_a_round_are_those_of_its_texts():
    rng = random.Random(7)
    marks = lambda: chr(rng.choice([32, 95, 10, rng.randrange(128), rng.randrange(0x300), rng.randrange(0x300, 0xD800), rng.randrange(0xE000, 0x110000)]))
    rounds = [[None], ["", None, "a_b  c\n\nd"], ["İstanbul ½ x² 中文 áb \U0001d400z \x00q ß–x running"], ["plain words", "only, here"]]
    rounds += [["".join(marks() for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 6))] for _ in range(100)]
    for texts in rounds:
        for porter in (False, True):
            codes, terms, sizes = index.words_of(texts, porter)
            words, found = iter(terms.take(codes).to_pylist()), []
            for n in sizes:
                found.append([next(words) for _ in range(n)])
            assert found == [index.terms_of(t, porter) for t in texts] and not list(words) and len(set(terms.to_pylist())) == len(terms)


def test_packed_postings_open_as_they_were():
    rng = np.random.default_rng(8)
    numbers = np.array([0, 1, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, 1 << 28, (1 << 31) - 1, (1 << 35) - 1])
    data, at = index.varints(numbers)
    found, behind = index.numbers_of(data)
    assert found.tolist() == numbers.tolist() and behind.tolist() == at[1:].tolist() and not len(index.numbers_of(index.varints(numbers[:0])[0])[0])
    rows = rng.integers(1, 33, 200)
    n = rows.sum()
    tf, total, col, after = rng.integers(1, 6, n), rng.integers(1, 1 << 31, n), rng.integers(0, 3, n), rng.integers(0, 4, n)
    opens = rng.random(n) < 0.5
    given, lead = opens & (rng.random(n) < 0.5), opens | (rng.random(n) < 0.3)
    at = [np.sort(rng.choice(1 << 30, k)) for k in tf]
    bounds = rng.integers(1, 1000, (given.sum(), 3))
    keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rows)).astype(np.int32)), pa.array(np.arange(n) * 7))
    blobs = index.packed(rows, (after * 3 + col) << 3 | given << 2 | opens << 1 | lead, total, tf, given, bounds, np.concatenate(at))
    batch = pa.RecordBatch.from_arrays([pa.array([f"t{i}" for i in range(200)]), pa.array(np.arange(200) * 10), keys, blobs], ["term", "block", "keys", "packed"])
    wanted, held = [], iter(bounds.tolist())
    for i, row in enumerate(np.repeat(np.arange(200), rows).tolist()):
        bound = next(held) if given[i] else [1, tf[i], total[i]] if opens[i] else [None] * 3
        wanted.append((f"t{row}", i * 7, col[i], at[i].tolist(), total[i], row * 10 + after[i], lead[i], *bound))
    for start in (0, 71):
        assert [tuple(r.values()) for r in index.opened(3, batch.slice(start)).to_pylist()] == wanted[rows[:start].sum() :]


def test_a_worker_packs_and_opens_few_rows_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b{i % 7} a c{i} a", f"b{i % 3}" if i % 2 else None) for i in range(80)], "id long, one string, two string").coalesce(1)
    found = []
    for rows in (index.GATHERED_ROWS, 7):
        monkeypatch.setattr(index, "GATHERED_ROWS", rows)
        made = index.StoredIndex(spark, scratch(spark, "few"), "id", ("one", "two"))
        made.add(docs)
        found.append(sorted(map(tuple, made.postings().drop("part").collect()), key=str))
    assert found[0] == found[1] and len(found[0]) == 80 * 3 + 40
    assert index.GATHERED_ROWS == 7 and {r[4][0] for r in found[0] if r[0] == "a"} == {0}
