"""The data source, table functions, stream state and the stored trigram index, on small and odd inputs."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import tables
from quarrymill.operators.keyed import KeyedTable
from quarrymill.operators.setjoin import TrigramIndex
from quarrymill.session import scratch
from quarrymill.sources import datasource
from quarrymill.streaming import buffer
from quarrymill.streaming import changes as stream


def local(path):
    return path.removeprefix("file://")


# -- data source -------------------------------------------------------------------------------

ROWS = [(1, "a/b", "x\ny", 1.5), (2, None, None, None), (3, "ü", "", 0.0), (4, "a/b", "é", -1.0)]
SCHEMA = "id long, label string, text string, weight double"


def load(spark, folder):
    return spark.read.format("records").schema(SCHEMA).option("label", "label").load(folder)


def test_records_round_trip_and_push_down(spark):
    datasource.register(spark)
    folder = scratch(spark, "records")
    rows = spark.createDataFrame(ROWS, SCHEMA)
    assert load(spark, folder).count() == 0
    rows.write.format("records").option("label", "label").mode("append").save(folder)
    assert sorted(map(tuple, load(spark, folder).collect())) == sorted(ROWS)
    chosen = load(spark, folder).where("label = 'a/b' AND id > 1")
    assert [tuple(r) for r in chosen.collect()] == [ROWS[3]]
    reader = datasource.RecordsReader(rows.schema, {"path": folder, "label": "label"})
    every = reader.partitions()
    left = list(reader.pushFilters([datasource.EqualTo(("label",), "a/b"), datasource.EqualTo(("id",), 1)]))
    assert left == [datasource.EqualTo(("id",), 1)] and 0 < len(reader.partitions()) < len(every)
    assert {p.label for p in reader.partitions()} == {"a/b"}
    rows.limit(1).write.format("records").option("label", "label").mode("overwrite").save(folder)
    assert load(spark, folder).count() == 1


def test_failed_write_leaves_nothing(spark):
    datasource.register(spark)
    folder = scratch(spark, "records")
    good = spark.createDataFrame(ROWS, SCHEMA)
    good.write.format("records").option("label", "label").mode("append").save(folder)
    broken = good.withColumn("text", F.when(F.col("id") == 4, F.raise_error(F.lit("no more"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no more"):
        broken.write.format("records").option("label", "label").mode("append").save(folder)
    assert load(spark, folder).count() == 4
    assert not [f for _, _, files in os.walk(os.path.join(local(folder), "_tasks")) for f in files]
    with open(os.path.join(local(folder), "label=x.jsonl"), "w") as f:
        f.write("{broken\n")
    with pytest.raises(Exception, match="line 1 is no JSON"):
        load(spark, folder).collect()


# -- table functions ---------------------------------------------------------------------------


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([(1, 10), (1, 15), (1, None), (1, 40), (2, 5), (None, 7)], "k int, t int").createOrReplaceTempView("test_ticks")
    got = spark.sql("SELECT * FROM runs(TABLE(test_ticks) PARTITION BY k ORDER BY (t), 't', 20, 'k')")
    assert got.columns == ["k", "start", "end", "rows"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 10, 15, 2), (1, 40, 40, 1), (2, 5, 5, 1), (None, 7, 7, 1)], key=str)
    spark.createDataFrame([("a", 5), ("a", 5), ("a", 4), ("a", 3), ("b", 1)], "g string, v int").createOrReplaceTempView("test_scores")
    got = spark.sql("SELECT g, v, place FROM leaders(TABLE(test_scores) PARTITION BY g ORDER BY (v DESC), 2, 'v')")
    assert sorted(map(tuple, got.collect())) == [("a", 5, 1), ("a", 5, 1), ("b", 1, 1)]
    spark.createDataFrame([(1, "a b c d e"), (2, None), (3, "  "), (4, "one")], "i long, s string").createOrReplaceTempView("test_texts")
    got = spark.sql("SELECT * FROM windows(TABLE(test_texts), 's', 'i', 3, 1)")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, 3, "a b c"), (1, 1, 2, 3, "c d e"), (4, 0, 0, 1, "one")]
    for bad in ("runs(TABLE(test_ticks), 'nope', 20, 'k')", "leaders(TABLE(test_scores), 0, 'v')", "windows(TABLE(test_texts), 's', 'i', 3, 3)"):
        with pytest.raises(Exception, match="no column|must be"):
            spark.sql(f"SELECT * FROM {bad}").collect()


# -- trigrams ----------------------------------------------------------------------------------


def grams(name):
    padded = f"  {name.lower()}  "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


@pytest.mark.parametrize("least", [0.8, 0.5])
def test_trigram_join_against_all_pairs(spark, least):
    rng = random.Random(6)
    bases = ["read_file_names", "write_file", "ReadFileName", "x", "", "öffne_datei", "open_socket_stream"]
    names = [*bases, *("".join(rng.choice([c, c, c, c, "z"]) for c in rng.choice(bases)) for _ in range(120))]
    rows = [(i, n) for i, n in enumerate(names)] + [(500, "write_file"), (501, None)]
    made = TrigramIndex.build(spark.createDataFrame(rows, "id long, name string"), scratch(spark, "trigrams"), "id", "name")
    least_id = {}
    for i, n in rows:
        if n is not None:
            least_id.setdefault(n, i)
    expected = {}
    for a, i in least_id.items():
        for b, j in least_id.items():
            both = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
            if i < j and both >= least - 1e-12:
                expected[i, j] = round(both, 6)
    assert {(r.a, r.b): r.score for r in made.join(least).collect()} == expected
    assert made.candidates(least).count() < len(least_id) * (len(least_id) - 1) / 2 / (3 if least == 0.8 else 1)
    assert {(r.id, r.key) for r in made.members.collect()} == {(least_id[n], i) for i, n in rows if n is not None}
    for query in ("read_file", "WRITE_FILE", "qqq"):
        got = {r.key: r.score for r in made.look_up(query, least).collect()}
        want = {i: round(len(grams(query) & grams(n)) / len(grams(query) | grams(n)), 6) for i, n in rows if n is not None}
        assert got == {i: s for i, s in want.items() if s >= least}


# -- state -------------------------------------------------------------------------------------


def test_flush_over_restarts_and_disorder(spark):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    events = sorted((start + timedelta(minutes=rng.randint(0, 6000)), i, f"p{rng.randint(0, 3)}", rng.choice("amd")) for i in range(400))
    end = datetime(2024, 1, 9)
    base = scratch(spark, "flush")
    schema = "ts timestamp, event_id long, path string, action string"
    got = []

    def sink(batch, number):
        got.extend((r.path, r.first, r.last, r.events, r.action) for r in batch.collect())

    # Three runs of the stream, each a restart; within a run events come in any order. The last event lets the watermark pass.
    for k, part in enumerate((events[:150], events[150:300], [*events[300:], (end, 999, "last", "m")])):
        shuffled = rng.sample(part, len(part))
        spark.createDataFrame(shuffled, schema).coalesce(1).write.parquet(f"{base}/in/{k}")
        flow = buffer.flush(spark.readStream.schema(schema).parquet(f"{base}/in/*"), timedelta(minutes=30), "2 hours")
        with buffer.timers(spark):
            stream.run_once(flow, f"{base}/state", sink)
    expected = []
    for path in {e[2] for e in events}:
        run = []
        for e in [*(e for e in events if e[2] == path), (datetime(2099, 1, 1), 0, path, "")]:
            if run and e[0] - run[-1][0] >= timedelta(minutes=30):
                expected.append((path, run[0][0], run[-1][0], len(run), run[-1][3]))
                run = []
            run.append(e)
    assert sorted(got) == sorted(expected)


def test_outbox_is_drained_once(spark):
    base = scratch(spark, "outbox")
    table = KeyedTable.store(spark.range(20).toDF("k"), f"{base}/t", ("k",), parts=4)
    box = buffer.Outbox(spark, f"{base}/box")
    assert box.drain(table, spark.range(0).toDF("k")) is None
    for _ in range(2):  # the batch comes again
        box.take(spark.range(0, 6).toDF("k"), 0)
    box.take(spark.range(4, 8).toDF("k"), 1)
    assert box.waiting() == [0, 1]
    gone = box.drain(table, spark.createDataFrame([(2,), (7,)], "k long"))
    assert sorted(r.k for r in gone.collect()) == [0, 1, 3, 4, 5, 6] and table.read().count() == 14
    assert box.waiting() == [] and box.drain(table, spark.range(0).toDF("k")) is None
    box.take(spark.range(9, 10).toDF("k"), 2)
    box.drain(table, spark.range(0).toDF("k"))
    assert table.read().count() == 13
