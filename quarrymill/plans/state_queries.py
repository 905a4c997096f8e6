"""Guards, reranking, the result cache, maintenance, and sources beside tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from quarrymill import api
from quarrymill.operators import maintenance, results, states
from quarrymill.session import scratch, write_small
from quarrymill.sources import code, external
from quarrymill.streaming import changes as stream

from .bindings import Queries

Q = Queries()


def expected(key: str, column: str, rows: dict) -> str:
    """The check of a state machine: every case with its verdict."""
    return f"SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in rows.items())}) AS t({key}, {column})"


# -- repositories ------------------------------------------------------------------------------

@Q.plan("P19_tracked_branch_guard", """SELECT e.event_id FROM events e WHERE CASE WHEN e.event_type = 'error' THEN 'topic' WHEN e.event_type <> 'signup' THEN 'main' END = CASE WHEN e.user_id % 7 = 0 THEN 'dev' ELSE 'main' END""")
def tracked_branch(get):
    """Pushes pass if they are on the branch that their repository tracks; a push without a branch never passes."""
    branch = F.when(F.col("event_type") == "error", "topic").when(F.col("event_type") != "signup", "main")
    tracked = F.when(F.col("user_id") % 7 == 0, "dev").otherwise("main")
    return get("events").where(states.on_tracked_branch(branch, tracked)).select("event_id")


# -- rerank ------------------------------------------------------------------------------------

NOT_NOISE = "path NOT LIKE '%htmlcov/%' AND path NOT LIKE '%docs/benchmarks/%'"


@Q.plan("H14_rerank_apply", "SELECT file_id, round(cast(len(list_distinct(tokens_of(content))) AS DOUBLE) / (1 + len(tokens_of(content))), 6) AS rerank_score FROM (SELECT * FROM {files} WHERE file_id % 5 <> 0 ORDER BY size DESC, file_id LIMIT 50) ORDER BY rerank_score DESC, file_id LIMIT 20")
def rerank_apply(get):
    """Candidates in noise folders go (unless all are there); the rest is scored by the registered reranker, outcome beside it."""
    rows = get("files").where("file_id % 5 <> 0").orderBy(F.desc("size"), "file_id").limit(50).select("file_id", "content", F.col("path"), "size")
    api.RERANKERS.register("variety", api.pair_scorer(lambda texts: [round(len(set(t)) / (1 + len(t)), 6) for t in map(api.plain_tokens, texts)]))
    found, outcome = api.apply_reranker(rows, "variety", 20, order=[F.desc("size"), F.asc("file_id")])
    assert outcome["outcome"] in ("succeeded", "attempted"), outcome
    return found.select("file_id", "rerank_score")


@Q.plan("U11_reranker_registry", "SELECT file_id, size::DOUBLE AS rerank_score FROM {files} ORDER BY size DESC, file_id LIMIT 15")
def reranker_registry(get):
    """A reranker that fails in its tasks, not while it is planned: the next named one takes its place."""
    api.RERANKERS.register("fails", api.pair_scorer(lambda texts: 1 / 0))
    api.RERANKERS.register("by_length", api.pair_scorer(lambda texts: [float(len(t)) for t in texts]))
    rows = get("files").select("file_id", "content", "path", "size")
    found, outcome = api.apply_reranker(rows, "fails", 15, order=[F.asc("file_id")], fallback="by_length")
    assert outcome["outcome"] == "fallback_applied" and outcome["failed_provider"] == "fails", outcome
    return found.select("file_id", "rerank_score")


@Q.plan("M10_cross_repo_rerank", "SELECT repo, file_id, row_number() OVER (PARTITION BY repo ORDER BY len(list_filter(tokens_of(content), lambda x: x = 'the')) DESC, file_id)::INT AS new_rank FROM {files}")
def cross_repo_rerank(get):
    """Every repository's results by a registered scorer of their text, each repository's order its own."""
    api.RERANKERS.register("the_count", api.pair_scorer(lambda texts: [float(api.plain_tokens(t).count("the")) for t in texts]))
    scored = api.RERANKERS.entries["the_count"](get("files").select("file_id", "repo", "content"))
    from pyspark.sql import Window as W

    return scored.select("repo", "file_id", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("rerank_score"), "file_id")).alias("new_rank"))


@Q.plan("H3_branch_execution", "SELECT 'symbols' AS branch, 'ok' AS status, count(*) AS hits FROM {symbols} WHERE name LIKE 'red%' UNION ALL SELECT 'files', 'ok', count(*) FROM {files} WHERE contains(content, 'only') UNION ALL SELECT 'vectors', 'failed', 0")
def branches(get):
    """Branches run side by side; one that fails is reported and the others' rows stay."""
    broken = F.udf(lambda x: 1 // 0, "int")
    return api.run_branches(
        get("region").sparkSession,
        {
            "symbols": lambda: get("symbols").where("name LIKE 'red%'").select("symbol_id"),
            "files": lambda: get("files").where(F.contains("content", F.lit("only"))).select("file_id"),
            "vectors": lambda: get("embeddings").select(broken("label").alias("x")),
        },
    )


# -- result cache ------------------------------------------------------------------------------

TTL = {"view": 300, "click": 3600, "signup": 7200, "purchase": 86_400, "error": 60}
CACHED = """(SELECT event_id, event_type, user_id, ts, 'u' || user_id AS k, CASE event_type WHEN 'view' THEN 300 WHEN 'click' THEN 3600 WHEN 'signup' THEN 7200 WHEN 'purchase' THEN 86400 ELSE 60 END AS ttl,
  'p' || (event_id % 9) AS file FROM events WHERE event_type <> 'view')"""
ENTRIES = f"(SELECT * FROM (SELECT *, event_type || ':' || k AS key, row_number() OVER (PARTITION BY event_type, k ORDER BY ts DESC, event_id::VARCHAR DESC) AS r FROM {CACHED}) WHERE r = 1)"


def cache_entries(get):
    """Results of every event but views, keyed by kind and user, depending on one file each."""
    spark = get("events").sparkSession
    new = get("events").where("event_type <> 'view'").select(
        F.concat_ws(":", "event_type", F.concat(F.lit("u"), "user_id")).alias("key"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("value"), F.col("ts").alias("created"),
        F.element_at(F.create_map(*[F.lit(x) for p in TTL.items() for x in p]), F.col("event_type")).cast("long").alias("ttl_s"), F.array(F.concat(F.lit("p"), F.col("event_id") % 9)).alias("files"),
    )
    return results.put(spark.createDataFrame([], results.COLUMNS), new)


@Q.plan("S1_cache_key", "SELECT user_id, event_type, sha256(event_type || chr(31) || 'limit=20' || chr(31) || 'user=' || user_id) AS key FROM (SELECT DISTINCT user_id, event_type FROM events)")
def cache_key(get):
    rows = get("events").select("user_id", "event_type").distinct()
    parameters = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("limit"), F.lit("20"))
    return rows.select("user_id", "event_type", results.key_of(F.col("event_type"), parameters).alias("key"))


@Q.plan("S2_cached_results", f"SELECT v.event_id, CASE WHEN e.ts <= v.ts AND epoch_us(e.ts) + 3600000000 > epoch_us(v.ts) THEN e.event_id::VARCHAR END AS value FROM events v LEFT JOIN {ENTRIES} e ON e.key = 'click:u' || v.user_id WHERE v.event_type = 'view'")
def cached_results(get):
    """Every view asks for its user's click result: a hit if that was stored before and has not expired."""
    asked = get("events").where("event_type = 'view'").select(F.concat(F.lit("click:u"), "user_id").alias("key"), F.col("ts").alias("at"), "event_id")
    answers, _ = results.get(cache_entries(get), asked.select("key", "at").distinct())
    return asked.join(answers, ["key", "at"]).select("event_id", "value")


@Q.plan("S3_invalidate", f"SELECT key FROM {ENTRIES} WHERE event_type <> 'error' AND file <> 'p4'")
def invalidated(get):
    """Entries that depend on a changed file, and all of one kind, go."""
    tags = get("events").sparkSession.createDataFrame([("file:p4",), ("query_type:error",)], "tag string")
    return results.invalidate(cache_entries(get), tags).select("key")


@Q.plan("S4_lru_keep", f"SELECT key FROM (SELECT key, row_number() OVER (ORDER BY ts DESC, key) AS n, sum(strlen(event_id::VARCHAR)) OVER (ORDER BY ts DESC, key ROWS UNBOUNDED PRECEDING) AS b FROM {ENTRIES}) WHERE n <= 200 AND b <= 900")
def lru(get):
    return results.fit_into(cache_entries(get), 200, 900).select("key")


@Q.plan("S6_expired_purge", f"SELECT key FROM {ENTRIES} WHERE epoch_us(ts) + ttl::BIGINT * 1000000 > epoch_us(TIMESTAMP '2024-01-20 00:00:00')")
def purged(get):
    return results.purge(cache_entries(get), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("key")


# -- writes that may fail ----------------------------------------------------------------------


@Q.plan("P15_staged_write", "SELECT symbol_id, name, 'second' AS written FROM {symbols}")
def staged_write(get):
    """Three writes: one publishes, one's shadow fails and is taken back, one publishes again; readers see the last good one."""
    symbols = get("symbols").select("symbol_id", "name")
    table = maintenance.Published(symbols.sparkSession, scratch(symbols.sparkSession, "published"))
    table.publish(symbols.withColumn("written", F.lit("first")))

    def fails(frame):
        raise OSError("the shadow store is away")

    try:
        table.publish(symbols.withColumn("written", F.lit("lost")), fails)
    except OSError:
        pass
    assert table.generation() == 1
    table.publish(symbols.withColumn("written", F.lit("second")), lambda f: f.limit(1).collect())
    return table.read()


@Q.plan("P12_resumed_checkpoint", "SELECT language AS batch, count(*) AS files, CASE WHEN language < 'es' THEN 1 ELSE 2 END AS runs FROM {files} GROUP BY language")
def resumed(get):
    """Files are indexed language by language; the third batch fails once, and the second call starts there."""
    files = get("files")
    spark = files.sparkSession
    base = scratch(spark, "resume")
    kinds = [r.language for r in files.select("language").distinct().orderBy("language").collect()]  # a row a language
    checkpoint = maintenance.Checkpoint(spark, f"{base}/checkpoint", "repo")
    broken = {"es"}
    done: dict[str, int] = {}

    def work(kind: str) -> str:
        done[kind] = done.get(kind, 0) + 1
        if kind in broken:
            broken.discard(kind)
            raise OSError("disk full")
        files.where(F.col("language") == kind).select("file_id", "language").write.mode("overwrite").parquet(f"{base}/out/batch={kind}")
        return "indexed"

    checkpoint.run(kinds, work)
    assert checkpoint.load()["remaining"][0] == "es"
    checkpoint.run(kinds, work)
    assert checkpoint.load() is None
    runs = spark.createDataFrame(list(done.items()), "batch string, runs int")
    return spark.read.parquet(f"{base}/out").groupBy("batch").agg(F.count(F.lit(1)).alias("files")).join(runs, "batch").select("batch", "files", "runs")


@Q.plan("Q18_migrated_columns", "SELECT file_id, path, 'main' AS branch, CAST(NULL AS VARCHAR) AS deleted_at, 3 AS version FROM {files}")
def migrated(get):
    """Three numbered steps, of which two are known at first; running again applies only the new one."""
    files = get("files").select("file_id", "path")
    spark = files.sparkSession
    base = scratch(spark, "migrate")
    steps = {1: maintenance.add_column("branch", "string", F.lit("main")), 2: maintenance.add_column("deleted_at", "string")}
    assert maintenance.Migrations(spark, base, steps).run(files) == [1, 2]
    later = maintenance.Migrations(spark, base, steps | {3: maintenance.add_column("branch", "string", F.lit("other"))})
    assert later.run() == [3] and later.run() == []
    return later.table.read().withColumn("version", F.lit(later.version()))


@Q.plan("Q11_ttl_cleanup", "SELECT event_id FROM events WHERE NOT (event_type IN ('error', 'purchase') AND epoch_us(ts) < epoch_us(TIMESTAMP '2024-01-25 00:00:00') - 10 * 86400000000)")
def ttl_cleanup(get):
    rows = get("events").withColumn("deleted_at", F.when(F.col("event_type").isin("error", "purchase"), F.col("ts")))
    return maintenance.live_after(rows, "deleted_at", F.lit("2024-01-25 00:00:00").cast("timestamp"), 10).select("event_id")


TASKS = "(SELECT file_id AS task, version % 4 AS priority, CASE WHEN file_id % 3 = 0 THEN 'pending' WHEN file_id % 3 = 1 THEN 'done' WHEN file_id % 2 = 0 THEN 'running' ELSE 'cancelled' END AS status FROM {files})"


def tasks(get):
    status = F.when(F.col("file_id") % 3 == 0, "pending").when(F.col("file_id") % 3 == 1, "done").when(F.col("file_id") % 2 == 0, "running").otherwise("cancelled")
    return get("files").select(F.col("file_id").alias("task"), (F.col("version") % 4).alias("priority"), status.alias("status"))


@Q.plan("Q20_task_queue", f"SELECT task, priority, row_number() OVER (ORDER BY priority DESC, task)::BIGINT AS position FROM {TASKS} WHERE status = 'pending'")
def task_queue(get):
    return maintenance.queue_order(tasks(get), "priority", "task")


@Q.plan("Q20_task_progress", f"WITH c AS (SELECT count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'cancelled') AS cancelled FROM {TASKS}) SELECT *, round(done / 40.0::DOUBLE, 6) AS throughput, round((running + pending) / (done / 40.0::DOUBLE), 6) AS left_s FROM c")
def task_progress(get):
    return maintenance.progress(tasks(get), 40.0)


# -- sources -----------------------------------------------------------------------------------


def nation_tree(get) -> str:
    """A folder with a source file for each nation, and files that a scan leaves out."""
    nation = get("nation")
    spark = nation.sparkSession
    root = scratch(spark, "tree")
    for r in nation.orderBy("n_nationkey").collect():  # 25 rows
        write_small(spark, f"{root}/area{r.n_regionkey}/{r.n_name.lower()}.py", f"def {r.n_name.lower()}():\n    return {r.n_nationkey}\n".encode())
    for path in ("node_modules/x.py", "area0/notes.tmp", "area0/data.unknown", "logs/old/run.py"):
        write_small(spark, f"{root}/{path}", b"x = 1\n")
    return root


TREE = """(SELECT 'area' || n_regionkey || '/' || lower(n_name) || '.py' AS path, 'def ' || lower(n_name) || '():' || chr(10) || '    return ' || n_nationkey || chr(10) AS content, n_nationkey FROM nation)"""


@Q.plan("A1_file_tree", f"SELECT path, strlen(content)::BIGINT AS size, 'python' AS language, 'ok' AS status FROM {TREE} UNION ALL SELECT * FROM (VALUES ('node_modules/x.py', 6, 'python', 'excluded'), ('area0/notes.tmp', 6, NULL, 'ignored'), ('area0/data.unknown', 6, NULL, 'no_parser'), ('logs/old/run.py', 6, 'python', 'ignored')) AS t(path, size, language, status)")
def file_tree(get):
    return external.file_tree(get("nation").sparkSession, nation_tree(get), ignore=("*.tmp", "logs/")).select("path", "size", "language", "status")


@Q.plan("A2_index_directory", f"SELECT 'ok' AS status, count(*) AS files, count(*) AS symbols FROM {TREE} UNION ALL SELECT * FROM (VALUES ('excluded', 1, 0), ('ignored', 2, 0), ('no_parser', 1, 0)) AS t(status, files, symbols)")
def index_directory(get):
    """A folder is scanned, its files parsed, and what became of them counted."""
    tree = external.file_tree(get("nation").sparkSession, nation_tree(get), ignore=("*.tmp", "logs/"))
    found = code.extract(tree.where("status = 'ok'"), "path", "language", "content").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return tree.join(found, "path", "left").groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"))


@Q.plan("P5_sweep", "SELECT 'area' || n_regionkey || '/' || lower(n_name) || '.py' AS path, CASE n_nationkey % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'renamed' END AS action, CASE WHEN n_nationkey % 5 = 2 THEN 'old/' || lower(n_name) || '.py' END AS old_path FROM nation WHERE n_nationkey % 5 < 3 UNION ALL SELECT 'gone.py', 'deleted', NULL")
def sweep(get):
    """A timed sweep as a stream: each trigger compares the folder with the index and writes what differs."""
    spark = get("nation").sparkSession
    tree = external.file_tree(spark, nation_tree(get), ignore=("*.tmp", "logs/")).where("status = 'ok'").select("path", F.sha2("content", 256).alias("hash"))
    number = F.regexp_extract("content", r"return (\d+)", 1).cast("int") % 5
    rows = external.file_tree(spark, nation_tree(get), ignore=("*.tmp", "logs/")).where("status = 'ok'").withColumn("n", number)
    indexed = rows.where("n > 0").select(F.when(F.col("n") == 2, F.concat(F.lit("old/"), F.element_at(F.split("path", "/"), -1))).otherwise(F.col("path")).alias("path"), F.when(F.col("n") == 1, "stale").otherwise(F.sha2("content", 256)).alias("hash"))
    indexed = indexed.unionByName(spark.createDataFrame([("gone.py", "h")], "path string, hash string"))
    return stream.on_timer(spark, lambda: external.sweep(tree, indexed), scratch(spark, "sweep"))


@Q.plan("P8_new_commits", "SELECT DISTINCT 'r' || (user_id % 25) AS repo, CAST(floor(value) AS BIGINT) AS commit FROM events")
def new_commits(get):
    """A monitor over many repositories' heads: each (repository, commit) is handed on once, whatever the number of polls."""
    events = get("events")
    spark = events.sparkSession
    base = scratch(spark, "monitor")
    heads = events.select(F.concat(F.lit("r"), F.col("user_id") % 25).alias("repo"), F.floor("value").alias("commit"))
    for i in range(2):  # two polls see the same heads
        heads.write.parquet(f"{base}/in/poll={i}")
    flow = spark.readStream.schema(heads.schema).option("recursiveFileLookup", "true").parquet(f"{base}/in").dropDuplicates(["repo", "commit"])
    stream.run_once(flow, f"{base}/state", lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    return spark.read.parquet(f"{base}/out").select("repo", "commit")


def evaluation_folder(get, change=None) -> str:
    """A signed set made of the benchmark's rows; change: edits the manifest or the files after signing."""
    spark = get("benchmark").sparkSession
    base = scratch(spark, "evaluation")
    rows = get("benchmark").orderBy("item_id").collect()  # the queries of one evaluation set
    queries = "".join(json.dumps({"id": f"q{r.item_id}", "query": r.text, "category": "text", "relevant_doc_ids": [str(r.item_id)], "hard_negative_doc_ids": []}) + "\n" for r in rows).encode()
    limits = b'{"min_quality": {}}'
    manifest = {"review": {"signed": True}, "dataset_sha256": hashlib.sha256(queries).hexdigest(), "thresholds_sha256": hashlib.sha256(limits).hexdigest(), "holdout_query_ids": [f"q{r.item_id}" for r in rows if r.item_id % 4 == 0]}
    files = {"queries.jsonl": queries, "thresholds.json": limits, "MANIFEST.json": manifest}
    if change:
        change(files)
    for name, data in files.items():
        write_small(spark, f"{base}/{name}", data if isinstance(data, bytes) else json.dumps(data).encode())
    return base


@Q.plan("A16_frozen_set", "SELECT 'q' || item_id AS id, text AS query, item_id % 4 = 0 AS holdout FROM benchmark")
def frozen_set(get):
    return external.frozen_set(get("benchmark").sparkSession, evaluation_folder(get)).select("id", "query", "holdout")


REFUSALS = {
    "unsigned": (lambda f: f["MANIFEST.json"].update(review={"signed": "yes"}), "the manifest is not signed"),
    "changed": (lambda f: f.update({"queries.jsonl": f["queries.jsonl"] + b"\n"}), "queries.jsonl has changed"),
    "no thresholds": (lambda f: f.pop("thresholds.json"), "no file thresholds.json"),
    "no checksum": (lambda f: f["MANIFEST.json"].pop("dataset_sha256"), "no checksum dataset_sha256"),
    "no manifest": (lambda f: f.pop("MANIFEST.json"), "no manifest"),
    "good": (None, "accepted"),
}


@Q.plan("R8_freeze_gate", expected("name", "verdict", {k: v for k, (_, v) in REFUSALS.items()}))
def freeze_gate(get):
    spark = get("benchmark").sparkSession
    out = []
    for name, (change, _) in REFUSALS.items():
        try:
            external.frozen_set(spark, evaluation_folder(get, change))
            out.append((name, "accepted"))
        except external.NotFrozen as error:
            out.append((name, str(error)))
    return spark.createDataFrame(out, "name string, verdict string")


@Q.plan("A21_artifact_round_trip", "SELECT symbol_id, name, kind, 'changed file refused' AS note FROM {symbols}")
def artifact(get):
    """A table leaves as an artifact and comes back; after a file is changed the import is refused."""
    symbols = get("symbols").select("symbol_id", "name", "kind")
    spark = symbols.sparkSession
    path, bad = scratch(spark, "artifact"), scratch(spark, "artifact")
    external.export_artifact(symbols, path)
    external.export_artifact(symbols, bad)
    write_small(spark, f"{bad}/data/part-extra.parquet", b"not a table")
    try:
        external.import_artifact(spark, bad)
        note = "accepted"
    except ValueError:
        note = "changed file refused"
    return external.import_artifact(spark, path).withColumn("note", F.lit(note))


QUERIES, ORACLES = Q.queries, Q.oracles
