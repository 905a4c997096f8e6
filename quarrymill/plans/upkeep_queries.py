"""Change data, table maintenance, caches, artifacts and the extension surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.session import scratch
from quarrymill.sources import code
from quarrymill.streaming import changes as stream

from .bindings import Queries

Q = Queries()

# -- change data and streams -------------------------------------------------------------------

RUNS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {changes}),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts) AS run FROM g)
SELECT path, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, arg_max(action, [epoch_us(ts)::VARCHAR, action]) AS action FROM r GROUP BY path, run"""


@Q.plan("P2_debounce", RUNS)
def debounce(get):
    return stream.debounce(get("changes"), "30 minutes")


def streamed(get, build, keep):
    """Runs a plan as a stream over the events' files and returns the rows that it wrote."""
    events = get("events")
    spark = events.sparkSession
    base = scratch(spark, "stream")
    source = f"{base}/in"
    events.select("event_id", "ts", F.concat(F.lit("p"), "user_id").alias("path"), F.col("event_type").alias("action")).write.parquet(source)
    flow = build(stream.changed_files(spark, source, "event_id long, ts timestamp, path string, action string"))
    stream.run_once(flow, f"{base}/state", lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}"), "complete" if keep else "append")
    return spark.read.parquet(f"{base}/out").drop("batch")


@Q.plan("P1_event_stream", "SELECT event_id, 'p' || user_id AS path, event_type AS action FROM events WHERE event_type <> 'view'")
def event_stream(get):
    return streamed(get, lambda s: s.where("action <> 'view'").select("event_id", "path", "action"), keep=False)


@Q.plan("P18_windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2")
def windowed(get):
    return streamed(get, lambda s: stream.windowed_counts(s, "1 day", delay="1 hour"), keep=True)


Q.sql("P3_flush_pending", "SELECT path, action, ts FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS k FROM {changes}) WHERE k = 1")


@Q.plan("P4_apply_changes", "WITH l AS (SELECT user_id, action, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {changes}) WHERE k = 1), c AS (SELECT file_id AS user_id, hash FROM {files}) SELECT user_id, hash FROM c WHERE user_id NOT IN (SELECT user_id FROM l) UNION ALL SELECT user_id, 'new' FROM l WHERE action <> 'deleted'")
def apply_changes(get):
    last = stream.latest(get("changes").select("user_id", "ts", "event_id", "action"), "user_id", ["ts", "event_id"]).withColumn("hash", F.lit("new"))
    return stream.upsert(get("files").select(F.col("file_id").alias("user_id"), "hash"), last, "user_id")


PAIRS = "WITH c AS (SELECT path, hash FROM (SELECT 'moved/' || path AS path, hash FROM {files}) n), d AS (SELECT path, hash FROM {files}), a AS (SELECT hash, min(path) AS new_path FROM c GROUP BY hash HAVING count(*) = 1), b AS (SELECT hash, min(path) AS old_path FROM d GROUP BY hash HAVING count(*) = 1) SELECT old_path, new_path, a.hash FROM a JOIN b ON a.hash = b.hash"
Q.sql("P6_rename_pairing", PAIRS)
Q.sql("P9_change_set_normalise", "SELECT event_id, CASE WHEN action = 'renamed' AND user_id % 3 = 0 THEN 'deleted' WHEN action = 'renamed' AND user_id % 3 = 1 THEN 'added' ELSE action END AS action FROM {changes}")
Q.sql("P13_needs_reindex", "SELECT a.file_id FROM {files} a LEFT JOIN (SELECT file_id, CASE WHEN file_id % 6 = 0 THEN 'old' ELSE hash END AS hash FROM {files} WHERE file_id % 5 <> 0) b ON a.file_id = b.file_id AND a.hash = b.hash WHERE b.file_id IS NULL")
Q.sql("P16_pending_deletions", "SELECT DISTINCT p.chunk_id, p.profile_id FROM {points} p WHERE p.collection = 'c2' AND NOT EXISTS (SELECT 1 FROM {summaries} s WHERE s.chunk_hash = p.chunk_id)")

# -- table maintenance -------------------------------------------------------------------------

Q.sql("Q1_upsert_repository", "SELECT coalesce(n.repo_id, o.repo_id) AS repo_id, coalesce(n.name, o.name) AS name FROM (SELECT repo_id, name FROM {repositories}) o FULL OUTER JOIN (SELECT repo_id + 20 AS repo_id, name || '_new' AS name FROM {repositories} WHERE repo_id % 2 = 0) n ON o.repo_id = n.repo_id")
Q.sql("Q4_upsert_chunks", "SELECT chunk_id, max(line_end) AS line_end, count(*) AS writes FROM {chunks} GROUP BY chunk_id")
Q.sql("Q5_delete_chunks", "SELECT count(*) AS kept FROM {chunks} c LEFT ANTI JOIN {symbols} s ON s.symbol_id = c.file_id", "SELECT count(*) AS kept FROM {chunks} c WHERE c.file_id NOT IN (SELECT symbol_id FROM {symbols})")
Q.sql("Q6_persist_shard", "SELECT symbol_id, file_id, name FROM {symbols} WHERE file_id <> 12 UNION ALL SELECT symbol_id + 100000, 12, name || '_v2' FROM {symbols} WHERE file_id = 12")
Q.sql("Q7_store_reference", "SELECT symbol_id, count(*) AS n FROM (SELECT symbol_id FROM {refs} UNION ALL SELECT symbol_id FROM {symbols} WHERE kind = 'promo') GROUP BY symbol_id")
Q.sql("Q8_soft_delete", "SELECT file_id, CASE WHEN path LIKE 'tests/%' THEN true ELSE is_deleted END AS is_deleted FROM {files}")
Q.sql("Q10_move_file", "SELECT file_id, CASE WHEN path LIKE 'lib/%' THEN 'core/' || substr(path, 5) ELSE path END AS path, CASE WHEN path LIKE 'lib/%' THEN 'relocate' END AS move_type FROM {files}")
Q.sql("Q12_token_count_update", "SELECT chunk_id, CASE WHEN file_id = 33 THEN line_end - line_start ELSE 0 END AS token_count FROM {chunks}")
Q.sql("Q13_point_map", "SELECT profile_id, chunk_id, max(collection) AS collection FROM {points} GROUP BY profile_id, chunk_id")
Q.sql("Q14_summary_upsert", "SELECT chunk_hash, min(profile) AS profile, count(*) AS n FROM {summaries} GROUP BY chunk_hash")
Q.sql("Q17_scheme_rebuild", "SELECT md5(chunk_id || ':v2') AS chunk_id, file_id FROM {chunks}")


@Q.plan("Q3_symbol_with_trigrams", "SELECT symbol_id, len(list_distinct(list_transform(range(1, length(name) + 3), lambda i: substr('  ' || lower(name) || '  ', i, 3))))::INT AS trigrams FROM {symbols}")
def symbol_trigrams(get):
    from quarrymill.functions.text import trigrams

    return get("symbols").select("symbol_id", F.size(trigrams(F.col("name"))).alias("trigrams"))


Q.sql("Q19_derived_recompute", "SELECT s.file_id, count(*) AS terms FROM {symbols} s JOIN (SELECT DISTINCT file_id FROM {files} WHERE version = 3) t ON t.file_id = s.file_id GROUP BY s.file_id")

# -- cache -------------------------------------------------------------------------------------

Q.sql("S7_popular_queries", "SELECT user_id, event_type, count(*) AS hits FROM {events} GROUP BY user_id, event_type HAVING count(*) >= 5")

# -- artifacts ---------------------------------------------------------------------------------

Q.sql("T2_manifest_validate", "SELECT file_id, path LIKE '/%' OR path LIKE '%..%' OR path = '' AS unsafe FROM {files}")
Q.sql("T4_best_target", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM {orders}) WHERE k = 1")
Q.sql("T8_artifact_id", "SELECT repo_id, 'index-' || replace(name, '_', '-') || '-main-' || substr(md5(name), 1, 8) || '-full' AS artifact FROM {repositories}")

# -- extension surface -------------------------------------------------------------------------

SOURCE = "(SELECT p_partkey AS file_id, CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'other' END AS language, CASE p_partkey % 3 WHEN 0 THEN 'class ' || replace(p_name, ' ', '_') || ':' || chr(10) || '    def run(self):' || chr(10) || '        return 1' WHEN 1 THEN 'func ' || replace(p_name, ' ', '_') || '(x int) ' || chr(123) || chr(10) || chr(125) ELSE 'def ' || replace(p_name, ' ', '_') || '(a)' END AS text FROM {part})"


def sources(get):
    part = get("part")
    return part.sparkSession.sql(f"SELECT * FROM {SOURCE}", part=part)


@Q.plan("U1_parser_registry", f"SELECT file_id, regexp_extract(text, '(?:class|func|def) (\\w+)', 1) AS name, CASE language WHEN 'python' THEN 'class' ELSE 'function' END AS kind, 1 AS line FROM {SOURCE} UNION ALL SELECT file_id, 'run', 'function', 2 FROM {SOURCE} WHERE language = 'python'")
def parsers(get):
    return code.extract(sources(get), "file_id", "language", "text")


@Q.plan("U2_generic_symbols", f"SELECT file_id, line::INT AS line, name, keyword FROM (SELECT file_id, line, regexp_extract(s, '^\\s*(?:def|class|function|func)\\s+([^\\s(:{{]+)', 1) AS name, regexp_extract(s, '^\\s*(def|class|function|func)\\s', 1) AS keyword FROM (SELECT file_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS s FROM (SELECT file_id, string_split(text, chr(10)) AS l FROM {SOURCE}))) WHERE name <> ''")
def generic(get):
    return code.generic_symbols(sources(get), "file_id", "text")


@Q.plan("U3_python_parser", f"SELECT file_id, count(*) AS symbols FROM (SELECT file_id FROM {SOURCE} WHERE language = 'python' UNION ALL SELECT file_id FROM {SOURCE} WHERE language = 'python') GROUP BY file_id")
def python_parser(get):
    return code.extract(sources(get).where("language = 'python'"), "file_id", "language", "text").groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols"))


Q.sql("U4_find_references", "SELECT DISTINCT file_id, line_number FROM {refs} WHERE symbol_id = 77")
Q.sql("U5_get_definition", "SELECT symbol_id, name FROM {symbols} WHERE name = 'blue_gear_3' ORDER BY symbol_id LIMIT 1")
Q.sql("U6_text_search", "SELECT file_id FROM {files} WHERE lower(content) LIKE '%licensed under%' ORDER BY file_id LIMIT 20")


@Q.plan("U7_type_analyzers", f"SELECT file_id, regexp_extract(text, 'func (\\w+)', 1) AS name FROM {SOURCE} WHERE language = 'go'")
def analyzers(get):
    return code.extract(sources(get).where("language = 'go'"), "file_id", "language", "text").select("file_id", "name")


@Q.plan("L15_manifest_packages", "SELECT p_partkey AS file_id, replace(p_name, ' ', '-') AS package FROM part")
def manifests(get):
    kinds = F.element_at(F.array(*map(F.lit, ["requirements", "npm", "gomod", "cargo"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    name = F.translate("p_name", " ", "-")
    line = F.when(kinds == "requirements", F.concat(name, F.lit(">=1.0"))).when(kinds == "npm", F.concat(F.lit('  "'), name, F.lit('": "^1.2"'))).when(kinds == "gomod", F.concat(F.lit("require "), name, F.lit(" v1.0"))).otherwise(F.concat(name, F.lit(' = "1"')))
    return code.manifest_packages(get("part").select(F.col("p_partkey").alias("file_id"), kinds.alias("kind"), line.alias("text")), "file_id", "kind", "text")


Q.sql("U14_store_health", "SELECT 'files' AS name, count(*) > 0 AS present FROM {files} UNION ALL SELECT 'symbols', count(*) > 0 FROM {symbols} UNION ALL SELECT 'points', count(*) > 0 FROM {points}")

QUERIES, ORACLES = Q.queries, Q.oracles
