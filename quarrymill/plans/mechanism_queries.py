"""Queries on Spark's own extension points: a data source, table functions, state with timers; and the stored trigram index."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from quarrymill.operators import tables
from quarrymill.operators.keyed import KeyedTable
from quarrymill.operators.setjoin import TrigramIndex
from quarrymill.session import scratch
from quarrymill.sources import datasource
from quarrymill.streaming import buffer
from quarrymill.streaming import changes as stream

from .bindings import Queries
from .search_queries import ASK_GRAMS, NAME_GRAMS

Q = Queries()

# -- trigrams ----------------------------------------------------------------------------------


def names(get):
    symbols = get("symbols")
    return TrigramIndex.build(symbols, scratch(symbols.sparkSession, "trigrams"), "symbol_id", "name")


SETS = f"s AS (SELECT min(symbol_id) AS id, {NAME_GRAMS} AS g FROM {{symbols}} WHERE name IS NOT NULL GROUP BY name)"


@Q.plan("F5_trigram_join", f"WITH {SETS}, p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g)) AS m, len(a.g) + len(b.g) AS t FROM s a JOIN s b ON a.id < b.id AND len(a.g) * 10 >= len(b.g) * 8 AND len(b.g) * 10 >= len(a.g) * 8) SELECT a, b, round(m / (t - m), 6) AS score FROM p WHERE 10 * m >= 8 * (t - m)")
def trigram_join(get):
    """All pairs of different symbol names of similarity 0.8 or more."""
    return names(get).join(0.8)


@Q.plan("F5_stored_look_up", f"SELECT symbol_id, name, round(m / (q + t - m), 6) AS score FROM (SELECT symbol_id, name, len(list_intersect({NAME_GRAMS}, {ASK_GRAMS})) AS m, len({NAME_GRAMS}) AS t, len({ASK_GRAMS}) AS q FROM {{symbols}}) WHERE 10 * m >= 3 * (q + t - m)")
def stored_look_up(get):
    return names(get).look_up("red_wigdet_1", 0.3).withColumnRenamed("key", "symbol_id")


# -- a data source -----------------------------------------------------------------------------

RECORD = "doc_id long, lang string, source string, n_chars long"


def exported(get):
    docs = get("documents")
    spark = docs.sparkSession
    datasource.register(spark)
    folder = scratch(spark, "records")
    docs.select("doc_id", "lang", "source", "n_chars").write.format("records").option("label", "lang").mode("append").save(folder)
    return spark.read.format("records").schema(RECORD).option("label", "lang").load(folder)


@Q.plan("A16_record_source", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('de', 'fr') AND n_chars > 100")
def record_source(get):
    """Documents written by the source's own writer and read back: the label decides the files, the length is left to Spark."""
    return exported(get).where("lang IN ('de', 'fr') AND n_chars > 100")


@Q.plan("A1_record_partitions", "SELECT lang, count(*) AS records, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def record_partitions(get):
    return exported(get).groupBy("lang").agg(F.count(F.lit(1)).alias("records"), F.sum("n_chars").alias("chars"))


# -- table functions ---------------------------------------------------------------------------


@Q.plan("U8_table_runs", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM e) SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS rows FROM r GROUP BY user_id, run""")
def table_runs(get):
    events = get("events")
    spark = events.sparkSession
    tables.register(spark)
    events.createOrReplaceTempView("quarry_events")
    return spark.sql("SELECT * FROM runs(TABLE(SELECT user_id, ts FROM quarry_events) PARTITION BY user_id ORDER BY (ts), 'ts', 1800, 'user_id')")


@Q.plan("U10_table_leaders", "SELECT source, doc_id, n_chars, place::INT AS place FROM (SELECT source, doc_id, n_chars, rank() OVER (PARTITION BY source ORDER BY n_chars DESC) AS place FROM documents) WHERE place <= 3")
def table_leaders(get):
    docs = get("documents")
    spark = docs.sparkSession
    tables.register(spark)
    docs.createOrReplaceTempView("quarry_documents")
    return spark.sql("SELECT * FROM leaders(TABLE(SELECT source, doc_id, n_chars FROM quarry_documents) PARTITION BY source ORDER BY (n_chars DESC), 3, 'n_chars')")


@Q.plan("U8_table_windows", r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents), n AS (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 80)) AS first FROM w WHERE len(w) > 0)
SELECT doc_id, (first / 80)::INT AS number, first::INT AS first_word, least(100, len(w) - first)::INT AS words FROM n WHERE first = 0 OR first + 20 < len(w)""")
def table_windows(get):
    docs = get("documents")
    spark = docs.sparkSession
    tables.register(spark)
    docs.createOrReplaceTempView("quarry_documents")
    return spark.sql("SELECT doc_id, number, first_word, words FROM windows(TABLE(SELECT doc_id, text FROM quarry_documents), 'text', 'doc_id', 100, 20)")


# -- state -------------------------------------------------------------------------------------


@Q.plan("P3_stateful_flush", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {changes}),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id) AS run FROM g),
o AS (SELECT path, min(ts) AS first, max(ts) AS last, count(*) AS events, arg_max(action, [epoch_us(ts), event_id]) AS action FROM r GROUP BY path, run)
SELECT * FROM o WHERE date_trunc('millisecond', last + INTERVAL 30 MINUTE) <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def stateful_flush(get):
    """Changes by path, flushed when a path has been quiet for half an hour; what is still open at the end stays in the buffer."""
    changes = get("changes").select("event_id", "ts", "path", "action")
    spark = changes.sparkSession
    base = scratch(spark, "flush")
    changes.write.parquet(f"{base}/in")
    flow = buffer.flush(spark.readStream.schema("event_id long, ts timestamp, path string, action string").parquet(f"{base}/in"), timedelta(minutes=30), "1 hour")
    with buffer.timers(spark):
        stream.run_once(flow, f"{base}/state", lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    return spark.read.parquet(f"{base}/out").drop("batch")


@Q.plan("P16_outbox_drain", """WITH d AS (SELECT DISTINCT chunk_id, profile_id FROM {points} WHERE collection = 'c2'), l AS (SELECT DISTINCT chunk_hash FROM {summaries})
SELECT DISTINCT chunk_id, profile_id FROM {points} p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.chunk_id = p.chunk_id AND d.profile_id = p.profile_id) OR EXISTS (SELECT 1 FROM l WHERE l.chunk_hash = p.chunk_id)""")
def outbox_drain(get):
    """Vectors of a collection are marked for deletion by a stream, one batch comes twice, and what is alive by its summary stays."""
    points = get("points").select("chunk_id", "profile_id", "collection")
    spark = points.sparkSession
    base = scratch(spark, "outbox")
    table = KeyedTable.store(points.select("chunk_id", "profile_id"), f"{base}/points", ("chunk_id", "profile_id"), parts=8)
    points.where("collection = 'c2'").select("chunk_id", "profile_id").write.parquet(f"{base}/in")
    outbox = buffer.Outbox(spark, f"{base}/box")

    def sink(batch, number):
        outbox.take(batch, number)
        outbox.take(batch, number)

    stream.run_once(spark.readStream.schema("chunk_id string, profile_id string").parquet(f"{base}/in"), f"{base}/state", sink)
    live = get("summaries").select(F.col("chunk_hash").alias("chunk_id")).distinct()
    outbox.drain(table, table.read().join(live, "chunk_id", "left_semi"))
    return table.read()


QUERIES, ORACLES = Q.queries, Q.oracles
