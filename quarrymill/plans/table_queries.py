"""Scans, predicates, joins, aggregates, set operations and orderings over the engine's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions.text import glob_regex
from quarrymill.operators import fusion

from .bindings import Queries

Q = Queries()

# -- scans -------------------------------------------------------------------------------------


IGNORED = ("docs/*", "*.json", "*/__init__.*")


@Q.plan("A3_ignore_patterns", "SELECT file_id, path FROM {files} WHERE NOT (path LIKE 'docs/%' OR path LIKE '%.json' OR path LIKE '%/@_@_init@_@_.%' ESCAPE '@')")
def ignore(get):
    """Globs become one regular expression each, so the test stays inside the scan's stage."""
    return get("files").where(~F.col("path").rlike("|".join(f"({glob_regex(p)})" for p in IGNORED))).select("file_id", "path")


@Q.plan("A4_extension_language", "SELECT file_id, CASE regexp_extract(path, '[.]([^.]+)$', 1) WHEN 'py' THEN 'python' WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'json' WHEN 'go' THEN 'go' ELSE 'plaintext' END AS code_language FROM {files}")
def languages(get):
    names = {"py": "python", "md": "markdown", "json": "json", "go": "go", "txt": "plaintext"}
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return get("files").select("file_id", F.element_at(lookup, F.element_at(F.split("path", r"\."), -1)).alias("code_language"))


Q.sql("A5_scan_repository", "SELECT file_id, path, language FROM {files} WHERE repo = 'src3'")
Q.sql("A6_file_by_path", "SELECT file_id, CASE WHEN path = 'lib/src5/file_5.py' THEN 0 ELSE 1 END AS tier FROM {files} WHERE path = 'lib/src5/file_5.py' OR path LIKE '%file_5.py' ORDER BY tier, file_id LIMIT 1")
Q.sql("A7_file_by_hash", "SELECT file_id, version FROM {files} WHERE NOT is_deleted AND hash = (SELECT min(hash) FROM {files} WHERE NOT is_deleted) ORDER BY version DESC, file_id LIMIT 1")
Q.sql("A8_chunk_by_id", "SELECT * FROM {chunks} WHERE chunk_id IN (SELECT max(chunk_id) FROM {chunks})")
Q.sql("A9_chunks_of_file", "SELECT chunk_index, chunk_id, line_start FROM {chunks} WHERE file_id = 7 ORDER BY chunk_index, chunk_id")


@Q.plan("A10_regex_scan", "SELECT file_id, line_number::INT AS line_number, line FROM (SELECT file_id, unnest(range(1, len(ls) + 1)) AS line_number, unnest(ls) AS line FROM (SELECT file_id, string_split(content, chr(10)) AS ls FROM {files})) WHERE regexp_matches(line, 'thin[a-z]+ of')")
def regex_scan(get):
    lines = get("files").where(F.col("content").rlike("thin[a-z]+ of")).select("file_id", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    return lines.where(F.col("line").rlike("thin[a-z]+ of")).select("file_id", (F.col("at") + 1).alias("line_number"), "line")


@Q.plan("A11_line_scan", "SELECT file_id, line_number::INT AS line_number FROM (SELECT file_id, unnest(range(1, len(ls) + 1)) AS line_number, unnest(ls) AS line FROM (SELECT file_id, string_split(content, chr(10)) AS ls FROM {files})) WHERE contains(lower(line), 'licensed') ORDER BY file_id, line_number LIMIT 50")
def line_scan(get):
    hits = get("files").where(F.contains(F.lower("content"), F.lit("licensed"))).select("file_id", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    return hits.where(F.contains(F.lower("line"), F.lit("licensed"))).select("file_id", (F.col("at") + 1).alias("line_number")).orderBy("file_id", "line_number").limit(50)


Q.sql("A17_keyed_upsert", "SELECT coalesce(n.vec_id, o.vec_id) AS vec_id, coalesce(n.label, o.label) AS label FROM (SELECT vec_id, label FROM {embeddings} WHERE vec_id % 3 <> 0) o FULL OUTER JOIN (SELECT vec_id, label + 100 AS label FROM {embeddings} WHERE vec_id % 2 = 0) n ON o.vec_id = n.vec_id")

# -- predicates and projections ----------------------------------------------------------------

Q.sql("B1_symbol_like", "SELECT symbol_id, name FROM {symbols} WHERE lower(name) LIKE '%old%bolt%' ORDER BY name, symbol_id LIMIT 20")
Q.sql("B2_exact_symbol", "SELECT s.symbol_id, f.path FROM {symbols} s JOIN {files} f ON s.file_id = f.file_id WHERE s.name = 'red_widget_17' AND s.kind = 'economy'")
Q.sql("B3_escaped_like", "SELECT symbol_id FROM {symbols} WHERE name LIKE '%@_widget@_1%' ESCAPE '@'")
Q.sql("B4_json_predicate", "SELECT event_id, cast(get_json_object(props, '$.k') AS int) AS k FROM {events} WHERE props LIKE '%\"k\"%' AND cast(get_json_object(props, '$.k') AS int) > 90 ORDER BY event_id LIMIT 100", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM {events} WHERE json_extract_string(props, '$.k')::INT > 90 ORDER BY event_id LIMIT 100")


STAB = "SELECT file_id, line_number, chunk_id FROM (SELECT q.file_id, q.line_number, c.chunk_id, row_number() OVER (PARTITION BY q.file_id, q.line_number ORDER BY c.line_end - c.line_start, c.line_start, c.chunk_id) AS k FROM (SELECT DISTINCT file_id, line_number * 11 AS line_number FROM {refs}) q JOIN {chunks} c ON c.file_id = q.file_id AND q.line_number BETWEEN c.line_start AND c.line_end) WHERE k = 1"
Q.sql("B6_chunk_at_line", STAB)
Q.sql("C12_interval_join", STAB)
Q.sql("B7_language_filter", "SELECT file_id FROM {files} WHERE language = 'fr' AND path LIKE '%src1%'")
Q.sql("B8_kind_filter", "SELECT symbol_id, name FROM {symbols} WHERE kind = 'promo' AND name LIKE 'hot%'")


@Q.plan("B9_pattern_filter", "SELECT file_id FROM {files} WHERE language IN ('en', 'de') AND regexp_matches(path, '^src/.*file_[0-9]*[369]0[.]py')")
def pattern_filter(get):
    return get("files").where(F.col("language").isin("en", "de") & F.col("path").rlike("^src/.*file_[0-9]*[369]0[.]py")).select("file_id")


Q.sql("B10_suffix_after_limit", "SELECT file_id, path FROM (SELECT file_id, path, row_number() OVER (ORDER BY size DESC, file_id) AS k FROM {files}) WHERE k <= 50 AND path LIKE '%.py'")
Q.sql("B11_score_thresholds", "SELECT event_id, value FROM {events} WHERE (event_type = 'view' AND value >= 10.0) OR (event_type = 'click' AND value >= 50.0) OR (event_type = 'error' AND value >= 30.0)")
Q.sql("B13_live_files", "SELECT file_id, path FROM {files} WHERE NOT is_deleted AND path NOT LIKE '%/@_@_init@_@_.json' ESCAPE '@'")
Q.sql("B14_supported_paths", "SELECT file_id FROM {files} WHERE regexp_extract(path, '[.]([a-z]+)$', 1) IN ('py', 'go', 'md')")
Q.sql("B15_excluded_parts", "SELECT file_id FROM {files} WHERE arrays_overlap(split(path, '/'), array('tests', 'plans', 'src7'))", "SELECT file_id FROM {files} WHERE list_has_any(string_split(path, '/'), ['tests', 'plans', 'src7'])")
Q.sql("B16_path_selectors", "SELECT path LIKE '%/%' OR path LIKE '.%' AS looks_like_path, count(*) AS n FROM {files} GROUP BY path LIKE '%/%' OR path LIKE '.%'")
Q.sql("B17_result_normaliser", "SELECT coalesce(nullif(path, ''), 'unknown') AS file, coalesce(line_start, line_end, 1) AS line, name AS symbol, kind FROM {symbols} s JOIN {files} f ON s.file_id = f.file_id")
Q.sql("B18_symbol_normaliser", "SELECT name AS symbol, kind AS type, file_id, line_start AS line FROM {symbols} WHERE name IS NOT NULL AND file_id IS NOT NULL")
Q.sql("B19_gateway_projection", "SELECT symbol_id, concat_ws('|', name, kind, CASE WHEN line_start > 25 THEN cast(line_start AS string) END) AS kept FROM {symbols}")

# -- joins -------------------------------------------------------------------------------------

Q.sql("C1_symbols_files", "SELECT s.symbol_id, s.name, f.path FROM {symbols} s JOIN {files} f ON s.file_id = f.file_id")
Q.sql("C2_symbols_files_text", "SELECT s.symbol_id, f.path FROM {symbols} s JOIN {files} f ON s.file_id = f.file_id WHERE s.name LIKE '%anvil%' AND f.language = 'en' ORDER BY s.symbol_id LIMIT 20")
Q.sql("C3_polymorphic_key_join", """SELECT k.key, coalesce(a.file_id, b.file_id) AS file_id FROM (SELECT CASE WHEN file_id % 2 = 0 THEN cast(file_id AS string) ELSE path END AS key FROM {files}) k
 LEFT JOIN {files} a ON cast(a.file_id AS string) = k.key LEFT JOIN {files} b ON b.path = k.key""")
Q.sql("C5_semi_join", "SELECT symbol_id, count(*) AS n FROM {refs} WHERE symbol_id IN (SELECT symbol_id FROM {symbols} WHERE kind = 'standard') GROUP BY symbol_id")
Q.sql("C6_chunks_left_symbols", "SELECT c.chunk_id, s.name FROM {chunks} c LEFT JOIN {symbols} s ON c.symbol_id = s.symbol_id AND s.line_start > 20")
Q.sql("C7_missing_summaries", "SELECT c.chunk_id FROM {chunks} c LEFT ANTI JOIN {summaries} s ON s.chunk_hash = c.chunk_id ORDER BY c.chunk_id LIMIT 100", "SELECT c.chunk_id FROM {chunks} c WHERE c.chunk_id NOT IN (SELECT chunk_hash FROM {summaries}) ORDER BY c.chunk_id LIMIT 100")
Q.sql("C8_missing_vectors", "SELECT count(*) AS missing FROM {chunks} c LEFT ANTI JOIN (SELECT chunk_id FROM {points} WHERE profile_id = 'p1') p ON p.chunk_id = c.chunk_id", "SELECT count(*) AS missing FROM {chunks} c WHERE c.chunk_id NOT IN (SELECT chunk_id FROM {points} WHERE profile_id = 'p1')")
Q.sql("C9_references_of_symbol", "SELECT r.line_number, f.path FROM {refs} r JOIN {files} f ON r.file_id = f.file_id WHERE r.symbol_id = 12")
Q.sql("C10_name_map", "SELECT name, count(*) AS n, min(s.symbol_id) AS first, min(f.path) AS path FROM {symbols} s JOIN {files} f ON s.file_id = f.file_id GROUP BY name")
Q.sql("C11_unsummarised_by_path", "SELECT c.chunk_id, f.path FROM {files} f JOIN {chunks} c ON c.file_id = f.file_id LEFT JOIN {summaries} s ON s.chunk_hash = c.chunk_id WHERE s.chunk_hash IS NULL AND f.path LIKE 'src/%'")
Q.sql("C16_issue_upsert", "SELECT conv_id, role, turn, n FROM (SELECT conv_id, role, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS k FROM {conversations}) WHERE k = 1")
SNAPSHOT = "(SELECT path, hash FROM {files} WHERE file_id % 10 <> 0) a FULL OUTER JOIN (SELECT CASE WHEN file_id % 8 = 0 THEN 'moved/' || path ELSE path END AS path, CASE WHEN file_id % 7 = 0 THEN 'x' || hash ELSE hash END AS hash FROM {files} WHERE file_id % 9 <> 0) b ON a.path = b.path"
Q.sql("C17_snapshot_differences", f"SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'created' ELSE 'deleted' END AS change FROM {SNAPSHOT} WHERE a.path IS NULL OR b.path IS NULL")
Q.sql("C18_snapshot_diff", f"SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'add' WHEN b.path IS NULL THEN 'delete' ELSE 'modify' END AS operation, b.hash AS checksum FROM {SNAPSHOT} WHERE a.hash IS DISTINCT FROM b.hash")

# -- aggregates --------------------------------------------------------------------------------

Q.sql("D1_table_counts", "SELECT (SELECT count(*) FROM {files}) AS files, (SELECT count(*) FROM {symbols}) AS symbols, (SELECT count(*) FROM {refs}) AS refs, (SELECT count(*) FROM {repositories}) AS repositories")
Q.sql("D2_symbols_of_file", "SELECT count(*) AS n FROM {symbols} WHERE file_id = 12")
Q.sql("D3_distinct_by_symbol", "SELECT symbol_id, count(DISTINCT file_id) AS files FROM {refs} GROUP BY symbol_id")
Q.sql("D4_language_counts", "SELECT language, count(*) AS n FROM {files} WHERE language <> '' GROUP BY language ORDER BY n DESC, language")
Q.sql("D5_repository_languages", "SELECT repo, language, count(*) AS files, sum(CASE WHEN is_deleted THEN 0 ELSE 1 END) AS live FROM {files} GROUP BY repo, language")
Q.sql("D8_semantic_readiness", """SELECT count(*) AS chunks, sum(CASE WHEN s.chunk_hash IS NULL THEN 1 ELSE 0 END) AS missing_summaries, sum(CASE WHEN p.chunk_id IS NULL THEN 1 ELSE 0 END) AS missing_vectors,
 sum(CASE WHEN p.collection = 'c1' THEN 1 ELSE 0 END) AS matched, sum(CASE WHEN p.collection <> 'c1' THEN 1 ELSE 0 END) AS mismatched
 FROM (SELECT DISTINCT chunk_id FROM {chunks}) c LEFT JOIN (SELECT DISTINCT chunk_hash FROM {summaries}) s ON s.chunk_hash = c.chunk_id LEFT JOIN (SELECT chunk_id, min(collection) AS collection FROM {points} WHERE profile_id = 'p1' GROUP BY chunk_id) p ON p.chunk_id = c.chunk_id""")
Q.sql("D10_store_term_statistics", "SELECT n, df, round(avg_chars, 4) AS avg_chars, round(ln((n - df + 0.5D) / (df + 0.5D)), 6) AS idf FROM (SELECT count(*) AS n, sum(CASE WHEN content LIKE '%only%' THEN 1 ELSE 0 END) AS df, avg(length(content)) AS avg_chars FROM {files})",
      "SELECT n, df, round(avg_chars, 4) AS avg_chars, round(ln((n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT count(*) AS n, sum(CASE WHEN content LIKE '%only%' THEN 1 ELSE 0 END) AS df, avg(length(content)) AS avg_chars FROM {files})")


@Q.plan("D14_group_by_file_line", "SELECT file_id, line_number, count(*) AS n, min(symbol_id) AS primary_symbol, round(least(1.0, count(*) / 3.0), 6)::DOUBLE AS confidence FROM {refs} GROUP BY file_id, line_number")
def grouped(get):
    return get("refs").groupBy("file_id", "line_number").agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("primary_symbol")).withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("n") / 3.0), 6))


Q.sql("D18_reindex_cost", "SELECT sum(CASE WHEN action IN ('added', 'modified') THEN 1 ELSE 0 END) AS to_index, sum(CASE WHEN action = 'deleted' THEN 1 ELSE 0 END) AS to_remove, sum(CASE WHEN action = 'renamed' THEN 1 ELSE 0 END) AS to_move, cast(round(sum(CASE WHEN action IN ('added', 'modified') THEN 10 WHEN action = 'deleted' THEN 1 ELSE 2 END) / 100, 2) AS double) AS seconds FROM {changes}")
Q.sql("D19_affected_directories", "SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM {files} WHERE path LIKE '%/%'")
Q.sql("D21_feedback_report", "SELECT event_type, count(*) AS selections, round(avg(value), 4) AS avg_rank FROM {events} GROUP BY event_type")
Q.sql("D22_latency_percentiles", "SELECT event_type, round(avg(value), 4) AS mean, round(percentile(value, 0.5), 4) AS median, round(percentile(value, 0.95), 4) AS p95, round(percentile(value, 0.99), 4) AS p99, min(value) AS least, max(value) AS most FROM {events} GROUP BY event_type",
      "SELECT event_type, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, min(value) AS least, max(value) AS most FROM {events} GROUP BY event_type")


Q.sql("D24_running_mean", "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {events}")


Q.sql("D27_type_token_ratio", "SELECT doc_id, round(size(array_distinct(w)) / size(w), 6) AS ratio FROM (SELECT doc_id, split(trim(lower(text)), '[ \\n]+') AS w FROM {documents})", "SELECT doc_id, round(len(list_distinct(w)) / len(w), 6) AS ratio FROM (SELECT doc_id, string_split_regex(trim(lower(text)), '[ \\n]+') AS w FROM {documents})")
Q.sql("D28_index_integrity", f"SELECT sum(CASE WHEN b.path IS NULL THEN 1 ELSE 0 END) AS missing, sum(CASE WHEN a.path IS NOT NULL AND b.path IS NOT NULL AND a.hash <> b.hash THEN 1 ELSE 0 END) AS stale, sum(CASE WHEN a.hash = b.hash THEN 1 ELSE 0 END) AS indexed FROM {SNAPSHOT}")

# -- rank, sort, limit -------------------------------------------------------------------------

Q.sql("I1_branch_rank", "SELECT language, file_id, row_number() OVER (PARTITION BY language ORDER BY size DESC, file_id) - 1 AS rank FROM {files}")
Q.sql("I2_best_occurrence", "SELECT symbol_id, file_id, line_number FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY line_number, file_id, reference_kind) AS k FROM {refs}) WHERE k = 1")


@Q.plan("I3_first_per_path", "SELECT hash, file_id FROM (SELECT hash, file_id, row_number() OVER (PARTITION BY hash ORDER BY file_id) AS k FROM {files}) WHERE k = 1")
def first_per_path(get):
    return fusion.first_per(get("files").select("hash", "file_id"), ["hash"], [F.asc("file_id")])


Q.sql("I4_rank_bookkeeping", "SELECT file_id, original_rank, row_number() OVER (ORDER BY file_id % 7, original_rank) AS new_rank FROM (SELECT file_id, row_number() OVER (ORDER BY size DESC, file_id) AS original_rank FROM {files}) WHERE original_rank <= 40")
Q.sql("I6_symbol_route", "SELECT s.symbol_id, f.path FROM {symbols} s JOIN {files} f ON s.file_id = f.file_id WHERE s.name LIKE 'red_anvil%' ORDER BY CASE WHEN f.path LIKE '%@_@_init@_@_%' ESCAPE '@' THEN 1 ELSE 0 END, s.line_start, s.symbol_id LIMIT 10")
Q.sql("I7_exact_first", "SELECT symbol_id, name FROM {symbols} WHERE name LIKE 'red_gear%' ORDER BY CASE WHEN name = 'red_gear_2' THEN 0 ELSE 1 END, name, symbol_id LIMIT 1")
Q.sql("I8_adjusted_top_k", "SELECT file_id, adjusted FROM (SELECT file_id, size * CASE WHEN path LIKE 'tests/%' THEN 0.5 ELSE 1.0 END AS adjusted FROM (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY size DESC, file_id) AS k FROM {files}) WHERE k <= 80)) ORDER BY adjusted DESC, file_id LIMIT 20")
Q.sql("I9_penalised_top_k", "SELECT file_id, size, CASE WHEN path LIKE '%.json' THEN 500 ELSE 0 END AS penalty FROM {files} ORDER BY size - CASE WHEN path LIKE '%.json' THEN 500 ELSE 0 END DESC, file_id LIMIT 50")
Q.sql("I13_pagination", "SELECT file_id, path FROM {files} ORDER BY path, file_id LIMIT 20 OFFSET 40")


@Q.plan("I14_summary_sentences", """WITH s AS (SELECT doc_id, i, s FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS s FROM (SELECT doc_id, string_split(text, '.') AS l FROM documents))),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (contains(s, 'the')::INT + contains(s, 'from')::INT + contains(s, 'que')::INT) * least(length(s), 200) DESC, i) AS k FROM s)
SELECT doc_id, i::INT AS i, md5(s) AS sentence FROM r WHERE k <= 5""")
def summary_sentences(get):
    s = get("documents").select("doc_id", F.posexplode(F.split("text", r"\.")).alias("i", "s"))
    hits = sum((F.contains("s", F.lit(k)).cast("int") for k in ("the", "from", "que")), F.lit(0))
    k = F.row_number().over(W.partitionBy("doc_id").orderBy((hits * F.least(F.length("s"), F.lit(200))).desc(), "i"))
    return s.withColumn("k", k).where("k <= 5").select("doc_id", "i", F.md5("s").alias("sentence"))


# -- sets --------------------------------------------------------------------------------------

Q.sql("J1_and_then_or", "SELECT path, 0 AS tier FROM {files} WHERE content LIKE '%only%' AND content LIKE '%from%' UNION ALL SELECT path, 1 FROM {files} WHERE (content LIKE '%only%' OR content LIKE '%from%') AND NOT (content LIKE '%only%' AND content LIKE '%from%')")
Q.sql("J2_symbols_then_content", "SELECT file_id, min(tier) AS tier FROM (SELECT file_id, 0 AS tier FROM {symbols} WHERE name LIKE 'hot%' UNION ALL SELECT file_id, 1 FROM {files} WHERE language = 'es') GROUP BY file_id")
Q.sql("J4_distinct_file_line", "SELECT file_id, line_number, min(symbol_id) AS symbol_id FROM {refs} GROUP BY file_id, line_number")
Q.sql(
    "J5_context_then_results", "SELECT s.file_id, 'context' AS kind FROM {symbols} s LEFT ANTI JOIN (SELECT file_id FROM {files} WHERE language = 'en') r ON r.file_id = s.file_id WHERE s.kind LIKE 'promo%' UNION SELECT file_id, 'result' FROM {files} WHERE language = 'en'",
    "SELECT file_id, 'context' AS kind FROM {symbols} WHERE kind LIKE 'promo%' AND file_id NOT IN (SELECT file_id FROM {files} WHERE language = 'en') UNION SELECT file_id, 'result' FROM {files} WHERE language = 'en'",
)


@Q.plan("J7_keyword_jaccard", "SELECT a.doc_id, round(len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))), 6) AS score FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS k FROM documents) a JOIN (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS k FROM documents) b ON b.doc_id = a.doc_id + 1 WHERE len(a.k) + len(b.k) > 0")
def keyword_jaccard(get):
    k = get("documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1)).alias("k"))
    pair = k.select("doc_id", F.col("k").alias("a"), (F.col("doc_id") + 1).alias("next")).join(k.select(F.col("doc_id").alias("next"), F.col("k").alias("b")), "next")
    return pair.where(F.size("a") + F.size("b") > 0).select("doc_id", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("score"))


Q.sql("J8_word_coherence", "SELECT doc_id, round(size(array_intersect(a, b)) / size(array_union(a, b)), 6) AS score FROM (SELECT doc_id, array_distinct(split(lower(left(text, 200)), ' ')) AS a, array_distinct(split(lower(right(text, 200)), ' ')) AS b FROM {documents})",
      "SELECT doc_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS score FROM (SELECT doc_id, list_distinct(string_split(lower(left(text, 200)), ' ')) AS a, list_distinct(string_split(lower(right(text, 200)), ' ')) AS b FROM {documents})")
Q.sql("J9_path_set_digest", "SELECT repo, sha2(array_join(array_sort(collect_set(path)), '\\n'), 256) AS digest FROM {files} GROUP BY repo", "SELECT repo, sha256(string_agg(DISTINCT path, chr(10) ORDER BY path)) AS digest FROM {files} GROUP BY repo")
Q.sql("J10_holdout_disjoint", "SELECT count(*) AS shared FROM (SELECT doc_id FROM {documents} WHERE doc_id % 5 = 0 INTERSECT SELECT doc_id FROM {documents} WHERE doc_id % 5 <> 0)")


@Q.plan("J12_string_list_normalise", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(lower(text), ' '), lambda s: trim(s)), lambda s: s <> ''))), ',') AS labels FROM documents")
def string_list(get):
    parts = F.transform(F.split(F.lower("text"), " "), lambda s: F.btrim(s, F.lit(" ")))
    clean = F.array_sort(F.array_distinct(F.filter(parts, lambda s: s != "")))
    return get("documents").select("doc_id", F.array_join(clean, ",").alias("labels"))


Q.sql("J13_set_operations", "SELECT language FROM {files} WHERE repo = 'src1' UNION SELECT language FROM {files} WHERE repo = 'src2' EXCEPT SELECT language FROM {files} WHERE repo = 'nothing'")

QUERIES, ORACLES = Q.queries, Q.oracles
