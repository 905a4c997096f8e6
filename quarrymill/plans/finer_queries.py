"""Queries of change records, envelopes, scores, sections and tiers, with real forms of their inputs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions import text
from quarrymill.operators import chunking, fusion, maintenance, markers, prose, results
from quarrymill.session import scratch
from quarrymill.sources import git
from quarrymill.streaming import changes as stream

from .bindings import Queries
from .lexical_queries import ASKED_SQL, asked
from .state_queries import ENTRIES, cache_entries

Q = Queries()
SUFFIXES = ("py", "md", "json", "go")
TAB = "chr(9)"

# -- git ---------------------------------------------------------------------------------------

DIFF = f"""(SELECT file_id, path, CASE file_id % 7 WHEN 0 THEN 'A' || {TAB} || path WHEN 1 THEN 'M' || {TAB} || path WHEN 2 THEN 'D' || {TAB} || path WHEN 3 THEN 'R087' || {TAB} || 'old/' || path || {TAB} || path
  WHEN 4 THEN 'C100' || {TAB} || path || {TAB} || 'copy/' || path WHEN 5 THEN 'T' || {TAB} || path ELSE 'M' || {TAB} || '"' || path || '"' END AS line FROM {{files}})"""


def diff_lines(get):
    n, p, t = F.col("file_id") % 7, F.col("path"), F.lit("\t")
    line = (
        F.when(n == 0, F.concat(F.lit("A"), t, p)).when(n == 1, F.concat(F.lit("M"), t, p)).when(n == 2, F.concat(F.lit("D"), t, p)).when(n == 3, F.concat(F.lit("R087"), t, F.lit("old/"), p, t, p))
        .when(n == 4, F.concat(F.lit("C100"), t, p, t, F.lit("copy/"), p)).when(n == 5, F.concat(F.lit("T"), t, p)).otherwise(F.concat(F.lit("M"), t, F.lit('"'), p, F.lit('"')))
    )
    return get("files").select("file_id", line.alias("line"))


KEPT = "regexp_matches(path, '[.](py|md|json|go)$')"


@Q.plan("A14_name_status_parser", f"SELECT file_id, path, CASE file_id % 7 WHEN 0 THEN 'added' WHEN 2 THEN 'deleted' WHEN 3 THEN 'renamed' ELSE 'modified' END AS action, CASE WHEN file_id % 7 = 3 THEN 'old/' || path END AS old_path FROM {{files}} WHERE file_id % 7 NOT IN (4, 5) AND {KEPT}")
def name_status(get):
    return git.name_status(diff_lines(get), "line", SUFFIXES).select("file_id", "path", "action", "old_path")


@Q.plan("A12_git_diff_source", f"SELECT action, count(*) AS n FROM (SELECT CASE file_id % 7 WHEN 0 THEN 'added' WHEN 2 THEN 'deleted' WHEN 3 THEN 'renamed' ELSE 'modified' END AS action, path FROM {{files}} WHERE file_id % 7 NOT IN (4, 5)) WHERE {KEPT} GROUP BY action")
def diff_source(get):
    """A diff saved as text, read back as a source of changes."""
    lines = diff_lines(get)
    place = scratch(lines.sparkSession, "diff")
    lines.select("line").write.text(place)
    return git.name_status(lines.sparkSession.read.text(place).withColumnRenamed("value", "line"), "line", SUFFIXES).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@Q.plan("A13_working_tree", f"SELECT path, action, state FROM (SELECT path, 'modified' AS action, 'staged' AS state FROM {{files}} WHERE file_id % 3 = 0 UNION ALL SELECT path, 'deleted', 'unstaged' FROM {{files}} WHERE file_id % 2 = 0 UNION ALL SELECT path, 'added', 'untracked' FROM {{files}} WHERE file_id % 5 = 1) WHERE {KEPT}")
def working_tree(get):
    files = get("files")
    form = lambda letter: F.concat(F.lit(f"{letter}\t"), "path").alias("line")
    staged, unstaged, untracked = files.where("file_id % 3 = 0").select(form("M")), files.where("file_id % 2 = 0").select(form("D")), files.where("file_id % 5 = 1").select(F.col("path").alias("line"))
    return git.working_tree(staged, unstaged, untracked, "line", SUFFIXES).select("path", "action", "state")


# -- envelopes and issues ----------------------------------------------------------------------

BODIES = "(SELECT p_partkey AS number, 'Text' || chr(10) || 'Learnings: ' || p_type || chr(10) || 'no learning here' || chr(10) || 'Key learnings:' || chr(10) || '- ' || p_brand || chr(10) || '* ' || p_name || chr(10) || '-' || chr(10) || 'end' || chr(10) || '- not this' || chr(10) || 'learning: ' || p_brand AS body FROM part)"


@Q.plan("O4_issue_learnings", "SELECT p_partkey AS number, array_to_string(list_transform(list_sort(list_transform(list_distinct([p_type, p_brand, p_name]), lambda x: [lower(x), x])), lambda x: x[2]), '|') AS learnings FROM part")
def issue_learnings(get):
    """Lines that say so, and the bullets under a heading until a line that is none; distinct, in alphabetical order."""
    part = get("part")
    rows = part.sparkSession.sql(f"SELECT * FROM {BODIES.replace('FROM part', 'FROM {part}')}", part=part)
    return prose.table(rows, lambda t: [("|".join(markers.issue_learnings(t)),)], "learnings string", "number", "body")


# -- scores ------------------------------------------------------------------------------------


@Q.plan("H4_weight_normalise", "SELECT p_partkey, round(least(greatest(p_size / 25 - 0.5, 0), 1) / total, 6)::DOUBLE AS bm25, round(0.3 / total, 6)::DOUBLE AS semantic FROM (SELECT *, least(greatest(p_size / 25 - 0.5, 0), 1) + 0.3 + least(greatest(p_size / 10 - 3, 0), 1) AS total FROM part)")
def weight_normalise(get):
    """Weights held in [0, 1] and divided by their sum; a row a setting."""
    size = F.col("p_size").cast("double")
    w = fusion.normal_weight_columns({"bm25": size / 25 - 0.5, "semantic": F.lit(0.3), "fuzzy": size / 10 - 3})
    return get("part").select("p_partkey", F.round(w["bm25"], 6).alias("bm25"), F.round(w["semantic"], 6).alias("semantic"))


@Q.plan("D20_source_weights", """WITH f AS (SELECT event_type, value + 1 AS rank FROM events ORDER BY event_id DESC LIMIT 100), g AS (SELECT event_type, count(*) AS n, avg(rank) AS avg_rank FROM f GROUP BY event_type),
w AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, n / 100 * (1 + 0.2::DOUBLE / avg_rank))) AS w FROM g) SELECT event_type, n, round(avg_rank, 6) AS avg_rank, round(w / sum(w) OVER (), 6) AS weight FROM w""")
def source_weights(get):
    """From the last hundred selections: each source's share and mean rank, as weights that are held in [0, 1] and sum to one."""
    last = get("events").orderBy(F.desc("event_id")).limit(100).select("event_type", (F.col("value") + 1).alias("rank"))
    g = last.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("rank").alias("avg_rank"))
    w = g.withColumn("w", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("n") / 100 * (1 + 0.2 / F.col("avg_rank"))))) 
    return w.select("event_type", "n", F.round("avg_rank", 6).alias("avg_rank"), F.round(F.col("w") / F.sum("w").over(W.partitionBy()), 6).alias("weight"))  # a row a source


@Q.plan("D7_cross_repo_statistics", """SELECT repo, count(*) AS files, sum(CASE WHEN is_deleted THEN 0 ELSE 1 END)::BIGINT AS live, string_agg(DISTINCT language, ',' ORDER BY language) AS languages,
 (SELECT count(DISTINCT repo) FROM {files}) AS repositories, (SELECT string_agg(DISTINCT language, ',' ORDER BY language) FROM {files}) AS all_languages FROM {files} GROUP BY repo""")
def cross_repo_statistics(get):
    files = get("files")
    by_repo = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("is_deleted")).alias("live"), F.array_sort(F.collect_set("language")).alias("ls"))
    total = by_repo.agg(F.count(F.lit(1)).alias("repositories"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ls")))), ",").alias("all_languages"))  # of a row a repository
    return by_repo.join(F.broadcast(total)).select("repo", "files", "live", F.array_join("ls", ",").alias("languages"), "repositories", "all_languages")


@Q.plan("N42_relevance", """WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), p AS (SELECT doc_id, t, instr(t, 'from') AS a, instr(t, 'with') AS b FROM d)
SELECT doc_id, least(2.0, (contains(t, 'from with'))::INT + 0.5 * ((a > 0)::INT + (b > 0)::INT) + CASE WHEN a > 0 AND b > 0 AND abs(a - b) < 100 THEN 0.5 ELSE 0 END)::DOUBLE AS relevance FROM p""")
def relevance(get):
    """The whole query, each keyword, and keywords whose first places are near, two at most."""
    t = F.lower("text")
    a, b = F.instr(t, "from"), F.instr(t, "with")
    score = F.contains(t, F.lit("from with")).cast("int") + 0.5 * ((a > 0).cast("int") + (b > 0).cast("int")) + F.when((a > 0) & (b > 0) & (F.abs(a - b) < 100), 0.5).otherwise(0.0)
    return get("documents").select("doc_id", F.least(F.lit(2.0), score).alias("relevance"))


@Q.plan("N43_contextual_snippet", """WITH p AS (SELECT doc_id, text, instr(lower(text), 'from') AS a FROM documents WHERE contains(lower(text), 'from'))
SELECT doc_id, CASE WHEN a > 101 THEN '...' ELSE '' END || substr(text, greatest(a - 100, 1), least(a + 103, length(text)) - greatest(a - 100, 1) + 1) || CASE WHEN a + 103 < length(text) THEN '...' ELSE '' END AS snippet FROM p""")
def contextual_snippet(get):
    """A hundred characters before and after the first hit, with dots where text was left out."""
    a = F.instr(F.lower("text"), "from")
    start, end = F.greatest(a - 100, F.lit(1)), F.least(a + 103, F.length("text"))
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substr("text", start, end - start + 1), F.when(end < F.length("text"), "...").otherwise(""))
    return get("documents").where(F.contains(F.lower("text"), F.lit("from"))).select("doc_id", cut.alias("snippet"))


ODD = "“”‘’–—… ​﻿"
EVEN = "\"\"''--. "


@Q.plan("N45_encoding_repair", f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(translate(text || ' “x” ‘y’ a–b—c d​e', '{ODD}', '\"\"''''--. '), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS fixed FROM documents")
def encoding_repair(get):
    """Typographic quotes and dashes to plain ones, hard and zero-width spaces to spaces or nothing, runs of spaces and blank lines to one."""
    t = F.translate(F.concat("text", F.lit(" “x” ‘y’ a–b—c d​e")), ODD, EVEN)
    fixed = F.btrim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"), F.lit(" \t\n\r"))
    return get("documents").select("doc_id", F.md5(fixed).alias("fixed"))


@Q.plan("N24_markdown_sections", """WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split('# Top' || chr(10) || replace(text, chr(10), chr(10) || '## Part' || chr(10)), chr(10)) AS ls FROM documents)),
h AS (SELECT doc_id, i, length(regexp_extract(line, '^(#{1,6})\\s', 1)) AS level, trim(regexp_extract(line, '^#{1,6}\\s+(.*\\S)', 1)) AS title FROM l WHERE regexp_matches(line, '^#{1,6}\\s+.*\\S')),
n AS (SELECT *, (SELECT count(*) FROM l WHERE l.doc_id = h.doc_id) AS total FROM h)
SELECT doc_id, i AS first, level, title, coalesce((SELECT min(b.i) - 1 FROM h b WHERE b.doc_id = n.doc_id AND b.i > n.i AND b.level <= n.level), total) AS last,
  (SELECT max(b.i) FROM h b WHERE b.doc_id = n.doc_id AND b.i < n.i AND b.level < n.level) AS parent FROM n""")
def markdown_sections(get):
    """Headings with level, span and the heading above them."""
    docs = get("documents").select("doc_id", F.concat(F.lit("# Top\n"), F.replace("text", F.lit("\n"), F.lit("\n## Part\n"))).alias("text"))

    def rows(t: str):
        found = chunking.sections(t)
        return [(s["start"], s["level"], s["title"], s["end"], found[s["parent"]]["start"] if s["parent"] >= 0 else None) for s in found]

    return prose.table(docs, rows, "first long, level long, title string, last long, parent long")


@Q.plan("K4_symbol_candidates", f"""SELECT query_id, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ' ') AS candidates FROM (SELECT query_id,
 list_concat(list_filter([regexp_extract(query, '\\b(?:class|def|function|method|symbol)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1)], lambda x: x <> ''),
 list_filter(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: regexp_matches(x, '[A-Z]') OR contains(x, '_'))) AS c FROM {ASKED_SQL})""")
def candidates(get):
    return asked(get).select("query_id", F.array_join(text.symbol_candidates(F.col("query")), " ").alias("candidates"))


@Q.plan("H19_similarity_groups", """WITH RECURSIVE r AS (SELECT DISTINCT file_id, line_number FROM {refs}), g(file_id, leader) AS (SELECT file_id, min(line_number) FROM r GROUP BY file_id
 UNION ALL SELECT g.file_id, (SELECT min(r.line_number) FROM r WHERE r.file_id = g.file_id AND r.line_number > g.leader + 2) FROM g WHERE g.leader IS NOT NULL)
SELECT r.file_id, r.line_number, max(g.leader) AS leader FROM r JOIN g ON g.file_id = r.file_id AND g.leader <= r.line_number GROUP BY 1, 2""")
def similar_groups(get):
    """Lines of one file within two lines of a group's first line join it."""
    rows = get("refs").select("file_id", "line_number").distinct()

    def group(pdf):
        leader, out = None, []
        for line in sorted(pdf["line_number"]):
            if leader is None or line - leader > 2:
                leader = line
            out.append(leader)
        return pdf.sort_values("line_number").assign(leader=out)

    return rows.groupBy("file_id").applyInPandas(group, "file_id long, line_number int, leader int")


# -- state and tables --------------------------------------------------------------------------


@Q.plan("P7_ref_poller", """WITH RECURSIVE e AS (SELECT user_id % 25 AS repo, event_id, CAST(floor(value) AS BIGINT) AS commit, event_type = 'error' AS off, row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id) AS k FROM events),
s(repo, k, last, commit, decision) AS (SELECT repo, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR FROM e WHERE k = 1 UNION ALL
 SELECT e.repo, e.k, CASE WHEN e.off OR e.commit = s.last THEN s.last ELSE e.commit END, e.commit, CASE WHEN e.off THEN 'skip' WHEN s.last IS NULL OR e.commit < s.last THEN 'full' WHEN e.commit = s.last THEN 'unchanged' ELSE 'sync' END FROM s JOIN e ON e.repo = s.repo AND e.k = s.k + 1)
SELECT repo, commit, CASE WHEN decision = 'skip' THEN 'topic' ELSE 'main' END AS branch, decision FROM s WHERE k > 0""")
def poller(get):
    events = get("events")
    spark = events.sparkSession
    base = scratch(spark, "poll")
    refs = events.select((F.col("user_id") % 25).alias("repo"), F.col("event_id").alias("seq"), F.floor("value").alias("commit"), F.when(F.col("event_type") == "error", "topic").otherwise("main").alias("branch"), F.lit("main").alias("tracked"))
    refs.write.parquet(f"{base}/in")
    flow = stream.poll_refs(spark.readStream.schema(refs.schema).parquet(f"{base}/in"))
    stream.run_once(flow, f"{base}/state", lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    return spark.read.parquet(f"{base}/out").drop("batch")


@Q.plan("Q2_upsert_file", """WITH s AS (SELECT repo, path, hash, is_deleted FROM {files} WHERE file_id % 3 <> 0), i AS (SELECT repo, CASE WHEN file_id % 4 = 1 THEN 'moved/' || path ELSE path END AS path, CASE WHEN file_id % 4 = 2 THEN 'x' || hash ELSE hash END AS hash FROM {files} WHERE file_id % 5 <> 0),
g AS (SELECT s.repo, s.hash, min(s.path) AS old_path FROM s WHERE NOT is_deleted AND NOT EXISTS (SELECT 1 FROM i WHERE i.repo = s.repo AND i.path = s.path) GROUP BY 1, 2),
n AS (SELECT i.repo, i.hash, min(i.path) AS path FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.repo = i.repo AND s.path = i.path) GROUP BY 1, 2), m AS (SELECT * FROM g JOIN n USING (repo, hash))
SELECT repo, path, hash, is_deleted, 'file' AS kind FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.repo = s.repo AND i.path = s.path) AND NOT EXISTS (SELECT 1 FROM m WHERE m.repo = s.repo AND m.old_path = s.path)
UNION ALL SELECT repo, path, hash, false, 'file' FROM i UNION ALL SELECT repo, old_path || ' > ' || path, hash, false, 'move' FROM m""")
def upsert_file(get):
    """Files by repository and path; a known text under a new path, whose old path is gone, is a move, with its audit row."""
    files = get("files")
    stored = files.where("file_id % 3 <> 0").select("repo", "path", "hash", "is_deleted")
    n = F.col("file_id") % 4
    incoming = files.where("file_id % 5 <> 0").select("repo", F.when(n == 1, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), F.when(n == 2, F.concat(F.lit("x"), "hash")).otherwise(F.col("hash")).alias("hash"))
    after, moves = maintenance.upsert_files(stored, incoming)
    audit = moves.select("repo", F.concat_ws(" > ", "old_path", "path").alias("path"), "hash", F.lit(False).alias("is_deleted"), F.lit("move").alias("kind"))
    return after.withColumn("kind", F.lit("file")).unionByName(audit)


@Q.plan("S5_tiered_cache", f"""WITH e AS (SELECT * FROM {ENTRIES}), a AS (SELECT 'click:u' || user_id AS key, max(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1),
h AS (SELECT a.key, e.event_id, e.event_id % 2 = 0 AS near FROM a LEFT JOIN e ON e.key = a.key AND e.ts <= a.t AND epoch_us(e.ts) + e.ttl::BIGINT * 1000000 > epoch_us(a.t))
SELECT key, event_id::VARCHAR AS value, CASE WHEN event_id IS NULL THEN 'none' WHEN near THEN 'near' ELSE 'far' END AS tier FROM h""")
def tiered(get):
    """Entries in a near and a far table; each key is answered by the first that holds it, and far hits move near."""
    entries = cache_entries(get)
    near, far = entries.where("cast(value AS long) % 2 = 0"), entries.where("cast(value AS long) % 2 <> 0")
    asked_for = get("events").where("event_type = 'view'").groupBy(F.concat(F.lit("click:u"), "user_id").alias("key")).agg(F.max("ts").alias("at"))
    answers, _ = results.tiered_get(near, far, asked_for, 50)
    return answers.select("key", "value", "tier")


QUERIES, ORACLES = Q.queries, Q.oracles
