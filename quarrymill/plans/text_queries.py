"""Document processing, metadata and retrieval-metric queries."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions import text
from quarrymill.operators import chunking, evaluation, markers, prose

from .bindings import Queries

Q = Queries()
CODE = "def|function|class|import|from|return|if|else|for|while|try|except|catch|throw|public|private|protected|static|const|let|var|async|await"
TOKENS_SQL = f"""floor(length(t) * 0.75::DOUBLE * CASE WHEN len(regexp_extract_all(t, '\\b({CODE})\\b')) >= 3 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END
 * CASE WHEN (length(t) - length(translate(t, '.,;:()[]{{}}', ''))) / greatest(length(t), 1) > 0.1 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END)::BIGINT"""


@Q.plan("N1_token_estimate", f"SELECT doc_id, {TOKENS_SQL} AS tokens FROM (SELECT doc_id, text AS t FROM documents)")
def estimate(get):
    return get("documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@Q.plan("N2_token_count", "SELECT doc_id, greatest(1, length(text) // 4 + (length(text) - length(regexp_replace(text, '[ \\t\\r\\n\\x0B\\f]', '', 'g'))) // 10)::BIGINT AS tokens FROM documents")
def count(get):
    return get("documents").select("doc_id", text.count_tokens(F.col("text")).alias("tokens"))


def chunk_query(key, strategy):
    Q.plan(key)(lambda get: chunking.chunk(get("documents"), strategy))


for _key, _strategy in (("N13_sentence_chunks", "sentence"), ("N14_paragraph_chunks", "paragraph"), ("N15_semantic_chunks", "topic"), ("N16_hybrid_chunks", "hybrid"), ("N17_sliding_chunks", "sliding"), ("N10_balanced_chunks", "balanced"), ("U12_chunk_strategies", "paragraph")):
    chunk_query(_key, _strategy)


@Q.plan("N5_sentence_offsets", "SELECT doc_id, i::INT AS i, s, (sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(s) - 1)::BIGINT AS start FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS s FROM (SELECT doc_id, string_split(text, '.') AS l FROM documents))")
def offsets(get):
    s = get("documents").select("doc_id", F.posexplode(F.split("text", r"\.")).alias("i", "s"))
    return s.withColumn("start", F.sum(F.length("s") + 1).over(W.partitionBy("doc_id").orderBy("i")) - F.length("s") - 1)


@Q.plan("N6_paragraph_split", "SELECT doc_id, len(list_filter(string_split_regex(text, '\\n'), lambda p: trim(p) <> ''))::INT AS paragraphs FROM documents")
def paragraph_split(get):
    return get("documents").select("doc_id", F.size(F.filter(F.split("text", r"\n"), lambda p: F.btrim(p) != "")).alias("paragraphs"))


@Q.plan("N7_topic_boundaries")
def topics(get):
    docs = get("documents").select("doc_id", "text")
    return docs.mapInPandas(lambda it: (p.assign(boundaries=[len(chunking.topic_starts(t)) for t in p["text"]])[["doc_id", "boundaries"]] for p in it), "doc_id long, boundaries int")


@Q.plan("N8_optimal_chunk_size", f"SELECT doc_id, CASE WHEN k < 1500 THEN k WHEN k / n BETWEEN 100 AND 1500 THEN floor(k / n)::BIGINT ELSE 1500 END AS size FROM (SELECT doc_id, {TOKENS_SQL} AS k, len(string_split(t, chr(10))) AS n FROM (SELECT doc_id, text AS t FROM documents))")
def optimal(get):
    k, n = text.estimate_tokens(F.col("text")), F.size(F.split("text", "\n"))
    return get("documents").select("doc_id", F.when(k < 1500, k).when((k / n).between(100, 1500), F.floor(k / n)).otherwise(1500).cast("long").alias("size"))


@Q.plan("N9_split_points")
def points(get):
    docs = get("documents").select("doc_id", "text")
    return docs.mapInPandas(lambda it: (p.assign(points=[len(chunking.split_points(t, 1000)) for t in p["text"]])[["doc_id", "points"]] for p in it), "doc_id long, points int")


@Q.plan("N12_fixed_chunks", "SELECT doc_id, start::INT AS start, content FROM (SELECT doc_id, start, substr(text, start + 1, 2000) AS content, length(text) AS n FROM (SELECT doc_id, text, unnest(range(0, length(text), 1800)) AS start FROM documents)) WHERE (start = 0 OR start - 1800 + 2000 < n) AND trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def fixed(get):
    return chunking.fixed(get("documents")).select("doc_id", "start", "content")


@Q.plan("N18_hierarchical_sections")
def section_tree(get):
    """Pages' texts stand in for Markdown: each line of benchmark and documents with a heading mark."""
    docs = get("documents").select("doc_id", F.concat(F.lit("# T\n"), F.regexp_replace("text", r"\n", "\n## ")).alias("text"))

    def run(batches):
        for p in batches:
            rows = [(d, i, s["title"], s["level"], s["parent"], s["start"], s["end"]) for d, t in zip(p["doc_id"], p["text"]) for i, s in enumerate(chunking.sections(t))]
            yield type(p)(rows, columns=["doc_id", "section", "title", "level", "parent", "start", "end"])

    return docs.mapInPandas(run, "doc_id long, section int, title string, level int, parent int, start int, end int")


@Q.plan("N19_document_type", "SELECT doc_id, CASE WHEN a >= b AND a >= c THEN 'legal' WHEN b >= c THEN 'data' ELSE 'prose' END AS kind FROM (SELECT doc_id, len(regexp_extract_all(left(text, 2000), '(?i)licen[sc]e|rights|reserved')) * 3 AS a, len(regexp_extract_all(left(text, 2000), '[|#$%&*]')) AS b, len(regexp_extract_all(left(text, 2000), '[.!?]')) AS c FROM documents)")
def document_type(get):
    head = F.left("text", F.lit(2000))
    a, b, c = F.regexp_count(head, F.lit("(?i)licen[sc]e|rights|reserved")) * 3, F.regexp_count(head, F.lit("[|#$%&*]")), F.regexp_count(head, F.lit("[.!?]"))
    return get("documents").select("doc_id", F.when((a >= b) & (a >= c), "legal").when(b >= c, "data").otherwise("prose").alias("kind"))


@Q.plan("N22_context_windows")
def windows(get):
    return chunking.with_neighbours(chunking.chunk(get("documents"), "sliding"))


READ = "206.835 - 1.015 * (w / s) - 84.6 * (y / w)"


@Q.plan("N32_readability", f"""SELECT doc_id, round(greatest(0, least(100, {READ})), 4)::DOUBLE AS score FROM (SELECT doc_id, len(ws)::DOUBLE AS w, greatest(len(regexp_extract_all(text, '[.!?]')), 1)::DOUBLE AS s,
 list_sum(list_transform(ws, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouAEIOU]')))))::DOUBLE AS y FROM (SELECT doc_id, text, regexp_extract_all(text, '[^ \\n]+') AS ws FROM documents))""")
def readability(get):
    words = get("documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"([^ \n]+)"), 1).alias("ws"), F.greatest(F.regexp_count("text", F.lit("[.!?]")), F.lit(1)).cast("double").alias("s"))
    y = F.aggregate("ws", F.lit(0), lambda a, x: a + F.greatest(F.lit(1), F.length(x) - F.length(F.translate(x, "aeiouAEIOU", "")))).cast("double")
    w = F.size("ws").cast("double")
    # A text without words (empty, blank or null) has no quotient, which least and greatest pass over. Scaled before rounding, as the SQL's engine rounds, so halves agree.
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * (w / F.col("s")) - 84.6 * F.try_divide(y, w)))
    return words.select("doc_id", (F.round(score * 10000) / 10000).alias("score"))


Q.sql("N33_average_sentence_length", "SELECT doc_id, round(size(split(trim(text), '[ \\n]+')) / greatest(length(text) - length(replace(text, '.', '')), 1), 5) AS words FROM {documents}", "SELECT doc_id, round(len(string_split_regex(trim(text), '[ \\n]+')) / greatest(length(text) - length(replace(text, '.', '')), 1), 5) AS words FROM {documents}")


@Q.plan("N31_text_type", "SELECT doc_id, CASE WHEN q > 0.2 * s THEN 'conversational' WHEN d > 0.3 * s THEN 'technical' ELSE 'narrative' END AS kind FROM (SELECT doc_id, len(regexp_extract_all(text, '\\?')) AS q, len(regexp_extract_all(text, '[0-9_#$]+')) AS d, len(regexp_extract_all(text, '[.!?]')) AS s FROM documents)")
def text_type(get):
    q, d, s = (F.regexp_count("text", F.lit(p)) for p in (r"\?", "[0-9_#$]+", "[.!?]"))
    return get("documents").select("doc_id", F.when(q > 0.2 * s, "conversational").when(d > 0.3 * s, "technical").otherwise("narrative").alias("kind"))


#: Words too common to be keywords.
STOP = "the of and to in that is for with this are was from una que los las des les der die das und mit".split()
ENDING = re.compile(".{4}(tion|ment|ize|ise|ify|ate|able|ible)$")


def half_up(x: float, digits: int) -> float:
    """Rounded as the engines round doubles."""
    return math.floor(x * 10**digits + 0.5) / 10**digits


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


@Q.plan("N36_keywords", f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), f AS (SELECT doc_id, w, count(*) AS c FROM w WHERE length(w) > 2 AND NOT list_contains({STOP_SQL}, w) GROUP BY 1, 2),
t AS (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS total FROM f), s AS (SELECT doc_id, w, round(c / total * ln(1 + total / c) * CASE WHEN regexp_matches(w, '.{{4}}(tion|ment|ize|ise|ify|ate|able|ible)$') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM t)
SELECT doc_id, w AS term, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, w) AS k FROM s) WHERE k <= 20""")
def keywords(get):
    """Words by frequency and length of text, those with a technical ending half as much again; counted row by row, without a shuffle."""
    stop = frozenset(STOP)

    def best(t: str):
        counts = Counter(w for w in re.findall("[a-z]+", t.lower()) if len(w) > 2 and w not in stop)
        total = sum(counts.values())
        scored = [(w, half_up(c / total * math.log(1 + total / c) * (1.5 if ENDING.search(w) else 1.0), 6)) for w, c in counts.items()]
        return sorted(scored, key=lambda x: (-x[1], x[0]))[:20]

    return prose.table(get("documents"), best, "term string, score double")


@Q.plan("N39_special_terms", "SELECT symbol_id, len(list_distinct(list_concat(regexp_extract_all(name, '[a-z]+(?:_[a-z]+)+'), regexp_extract_all(signature, '\\b[A-Z]{2,}\\b'))))::INT AS terms FROM {symbols}")
def special(get):
    found = F.array_distinct(F.concat(F.regexp_extract_all("name", F.lit("([a-z]+(?:_[a-z]+)+)"), 1), F.regexp_extract_all("signature", F.lit(r"\b([A-Z]{2,})\b"), 1)))
    return get("symbols").select("symbol_id", F.size(found).alias("terms"))


Q.sql("N40_technical_term", "SELECT symbol_id, name RLIKE '[0-9_-]|....(tion|ment|ize|able)$' AS technical FROM {symbols}", "SELECT symbol_id, regexp_matches(name, '[0-9_-]|....(tion|ment|ize|able)$') AS technical FROM {symbols}")


Q.sql("N44_text_search", "SELECT doc_id, CASE WHEN lower(text) LIKE '%of the%' THEN 2 ELSE 1 END AS score FROM {documents} WHERE lower(text) LIKE '%of the%' OR lower(text) LIKE '%from%' ORDER BY score DESC, doc_id LIMIT 50")


@Q.plan("N46_language_markers", "SELECT doc_id, CASE WHEN len(list_intersect(list_distinct(string_split(lower(text), ' ')), ['the', 'of', 'and', 'to', 'in', 'that', 'is', 'for', 'with'])) > 5 THEN 'en' ELSE 'unknown' END AS language FROM documents")
def markers_language(get):
    marks = F.array(*map(F.lit, ["the", "of", "and", "to", "in", "that", "is", "for", "with"]))
    return get("documents").select("doc_id", F.when(F.size(F.array_intersect(F.split(F.lower("text"), " "), marks)) > 5, "en").otherwise("unknown").alias("language"))


@Q.plan("N47_page_metadata", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS language, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages")
def page_metadata(get):
    return get("pages").select("page_id", *[F.regexp_extract("html", p, 1).alias(n) for n, p in (("title", "<title>([^<]*)</title>"), ("language", 'lang="([a-z]+)"'), ("heading", "<h1>([^<]*)</h1>"))])


Q.sql("N48_title", "SELECT doc_id, coalesce(nullif(regexp_extract(text, '^#+ (.*)', 1), ''), left(text, 40)) AS title FROM {documents}")
Q.sql("N49_content_language", "SELECT doc_id, CASE WHEN py >= md AND py > 0 THEN 'python' WHEN md > 0 THEN 'markdown' END AS language FROM (SELECT doc_id, regexp_count(text, '(import|def|from) [a-z]') AS py, regexp_count(text, '[*#][*#][*#]') AS md FROM {documents})", "SELECT doc_id, CASE WHEN py >= md AND py > 0 THEN 'python' WHEN md > 0 THEN 'markdown' END AS language FROM (SELECT doc_id, len(regexp_extract_all(text, '(import|def|from) [a-z]')) AS py, len(regexp_extract_all(text, '[*#][*#][*#]')) AS md FROM {documents})")


@Q.plan("N50_metadata_keywords", f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS w FROM documents), f AS (SELECT doc_id, w, count(*) AS c FROM w WHERE NOT list_contains({STOP_SQL}, w) GROUP BY 1, 2)
SELECT doc_id, w AS term, score FROM (SELECT doc_id, w, round(c * (1 + 0.1::DOUBLE * (length(w) - 3)), 4) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(c * (1 + 0.1::DOUBLE * (length(w) - 3)), 4) DESC, w) AS k FROM f) WHERE k <= 10""")
def metadata_keywords(get):
    stop = frozenset(STOP)

    def best(t: str):
        counts = Counter(w for w in re.findall("[a-z]{3,}", t.lower()) if w not in stop)
        scored = [(w, half_up(c * (1 + 0.1 * (len(w) - 3)), 4)) for w, c in counts.items()]
        return sorted(scored, key=lambda x: (-x[1], x[0]))[:10]

    return prose.table(get("documents"), best, "term string, score double")


@Q.plan("N51_extractive_summary", "SELECT doc_id, left(list_filter(string_split(text, chr(10)), lambda p: length(p) > 60)[1], 200) AS summary FROM documents")
def summary(get):
    return get("documents").select("doc_id", F.left(F.get(F.filter(F.split("text", "\n"), lambda p: F.length(p) > 60), F.lit(0)), F.lit(200)).alias("summary"))


Q.sql("N52_code_metadata", "SELECT doc_id, size(regexp_extract_all(text, '(import|from) ([a-z]+)', 2)) AS imports, size(regexp_extract_all(text, 'class ([A-Za-z]+)', 1)) AS classes FROM {documents}", "SELECT doc_id, len(regexp_extract_all(text, '(import|from) ([a-z]+)', 2))::INT AS imports, len(regexp_extract_all(text, 'class ([A-Za-z]+)', 1))::INT AS classes FROM {documents}")
Q.sql("N53_inline_metadata", "SELECT doc_id, regexp_extract(text, 'License, (?:V|v)ersion ([0-9.]+)', 1) AS version, regexp_extract(text, '(MIT|Apache|GNU|CC BY[-A-Z]*)', 1) AS licence FROM {documents}")
Q.sql("N54_document_category", "SELECT file_id, CASE WHEN path LIKE 'docs/%' OR path LIKE '%.md' THEN 'documentation' WHEN path LIKE 'tests/%' THEN 'test' WHEN path LIKE '%.json' THEN 'configuration' ELSE 'code' END AS category FROM {files}")
Q.sql("N58_merge_sections", "SELECT a.file_id, a.language FROM {files} a WHERE a.file_id % 2 = 0 UNION ALL SELECT b.file_id, b.repo FROM {files} b WHERE b.file_id % 3 = 0 AND b.file_id % 2 <> 0")


@Q.plan("N59_section_slug", "SELECT symbol_id, regexp_replace(regexp_replace(regexp_replace(lower(signature || ' / ' || name), '[^a-z0-9_\\s-]', '', 'g'), '[\\s-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM {symbols}")
def slugs(get):
    return get("symbols").select("symbol_id", text.slug(F.concat("signature", F.lit(" / "), "name")).alias("slug"))


Q.sql("N60_chunk_search_text", "SELECT s.symbol_id, concat_ws(' > ', f.repo, f.language, s.name) AS context FROM {symbols} s JOIN {files} f ON s.file_id = f.file_id")
Q.sql("N63_metadata_propagation", "SELECT c.chunk_id, f.language AS doc_language, f.repo AS doc_repo FROM {chunks} c JOIN {files} f ON c.file_id = f.file_id")
Q.sql("N64_chunk_validity", "SELECT doc_id, length(text) BETWEEN 100 AND 2000 AND trim(text) RLIKE '[.!?]$' AS valid FROM {documents}", "SELECT doc_id, length(text) BETWEEN 100 AND 2000 AND regexp_matches(trim(text), '[.!?]$') AS valid FROM {documents}")

# -- markers and issues ------------------------------------------------------------------------

CODE_LINES = "(SELECT p_partkey AS file_id, CASE p_partkey % 7 WHEN 0 THEN '# TODO: rename ' || p_name || ' #' || p_size WHEN 1 THEN '// FIXME ' || p_name WHEN 2 THEN '* hack - see https://x.org/' || p_partkey WHEN 3 THEN '- [ ] work around ABC-' || p_size WHEN 4 THEN 'x = 1' WHEN 5 THEN '<!-- wish: ' || p_type || ' -->' ELSE '; extraction hint' END AS text FROM {part})"


@Q.plan("O1_friction_markers", f"""WITH s AS (SELECT file_id, trim(regexp_replace(text, '^\\s*(?:(?:<!--|-->|#|//|/\\*|\\*/|\\*|;|- \\[[ x]\\]|-)\\s*)*', '')) AS s FROM {CODE_LINES}),
m AS (SELECT file_id, s, CASE WHEN regexp_matches(s, '(?i)\\bhack\\b') THEN 'hack' WHEN regexp_matches(s, '(?i)\\btodo\\b') THEN 'todo' WHEN regexp_matches(s, '(?i)\\bfixme\\b') THEN 'fixme' WHEN regexp_matches(s, '(?i)\\bwish\\b') THEN 'wish' WHEN regexp_matches(s, '(?i)\\bextraction hint\\b') THEN 'extraction_hint' WHEN regexp_matches(s, '(?i)\\bwork[- ]?around\\b') THEN 'workaround' END AS category FROM s),
d AS (SELECT file_id, category, trim(regexp_extract(s, '(?i)\\b(?:hack|todo|fixme|wish|extraction hint|work[- ]?around)\\b(?:\\s*[:\\-]\\s*|\\s+)?(.*)$', 1)) AS description FROM m WHERE category IS NOT NULL)
SELECT file_id, 1 AS line, category, upper(category) AS pattern, CASE WHEN description = '' THEN upper(category) ELSE description END AS description,
 nullif(regexp_extract(CASE WHEN description = '' THEN upper(category) ELSE description END, '(https?://\\S+|#[0-9]+|\\b[A-Z]{{2,}}-[0-9]+\\b)', 1), '') AS reference FROM d""")
def friction(get):
    part = get("part")
    return markers.markers(part.sparkSession.sql(f"SELECT * FROM {CODE_LINES}", part=part), "file_id", "text")


Q.sql("O2_marker_lines", "SELECT c.chunk_id, c.line_start + c.chunk_index - 1 AS line FROM {chunks} c")


@Q.plan("O3_envelope", "SELECT conv_id, string_agg(role || ':' || turn, ',' ORDER BY turn, role) AS records FROM conversations GROUP BY conv_id")
def envelope(get):
    records = get("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return records.select("conv_id", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["role"], x["turn"])), ",").alias("records"))


ISSUES = "(SELECT p_partkey AS number, CASE p_partkey % 5 WHEN 0 THEN 'Phase complete: ' || p_name WHEN 1 THEN 'Reflection on ' || p_name ELSE p_name END AS title, CASE p_partkey % 4 WHEN 0 THEN 'retrospective' ELSE 'bug' END AS label, 'Text' || chr(10) || 'Learnings: ' || p_type || chr(10) || 'learning: ' || p_brand AS body FROM {part})"


@Q.plan("O5_issue_type", f"SELECT number, CASE WHEN contains(lower(title), 'phase complete') THEN 'phase_complete' WHEN contains(lower(title), 'reflection') THEN 'reflection' WHEN label = 'retrospective' THEN 'retrospective' ELSE 'issue' END AS type FROM {ISSUES}")
def issue_types(get):
    part = get("part")
    return part.sparkSession.sql(f"SELECT * FROM {ISSUES}", part=part).select("number", markers.issue_type(F.array("label"), F.col("title")).alias("type"))


Q.sql("O6_issue_key", f"SELECT number, 'repo#' || cast(number AS string) || ':' || label || ':' || substr(sha2(body, 256), 1, 16) AS key FROM {ISSUES}", f"SELECT number, 'repo#' || cast(number AS string) || ':' || label || ':' || substr(sha256(body), 1, 16) AS key FROM {ISSUES}")
Q.sql("O7_issue_document", f"SELECT number, concat_ws(chr(10), '# Issue #' || cast(number AS string) || ': ' || title, 'Labels: ' || label, '', 'Summary: ' || title) AS document FROM {ISSUES}")
Q.sql("O8_filtered_search", f"SELECT number, title FROM {ISSUES} WHERE label = 'retrospective' AND lower(title) LIKE '%anvil%' ORDER BY number LIMIT 20")

# -- retrieval metrics -------------------------------------------------------------------------

RANKED = "(SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM {documents})"
JUDGED = "(SELECT lang AS query_id, doc_id, quality AS rel FROM {documents} JOIN {labels} USING (doc_id))"


def ranked(get):
    docs = get("documents")
    return docs.sparkSession.sql(f"SELECT * FROM {RANKED}", documents=docs)


def judged(get):
    docs, labels = get("documents"), get("labels")
    return docs.sparkSession.sql(f"SELECT * FROM {JUDGED}", documents=docs, labels=labels)


@Q.plan("R1_ndcg", f"""WITH i AS (SELECT query_id, sum((2.0::DOUBLE ** rel - 1) / log2(b + 1)) AS idcg FROM (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS b FROM {JUDGED}) WHERE b <= 50 GROUP BY query_id),
g AS (SELECT r.query_id, sum((2.0::DOUBLE ** rel - 1) / log2(rank + 1)) AS dcg FROM {RANKED} r JOIN {JUDGED} j ON r.query_id = j.query_id AND r.doc_id = j.doc_id WHERE rank <= 50 GROUP BY r.query_id)
SELECT i.query_id, round(CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END, 6) AS ndcg FROM i LEFT JOIN g ON i.query_id = g.query_id""")
def ndcg(get):
    return evaluation.ndcg(ranked(get), judged(get), 50)


@Q.plan("R2_reciprocal_rank", f"SELECT r.query_id, round(coalesce(1.0::DOUBLE / min(CASE WHEN j.doc_id IS NOT NULL THEN rank END), 0), 6) AS rr FROM {RANKED} r LEFT JOIN (SELECT * FROM {JUDGED} WHERE rel = 1) j ON r.query_id = j.query_id AND r.doc_id = j.doc_id GROUP BY r.query_id")
def rr(get):
    return evaluation.reciprocal_rank(ranked(get), judged(get).where("rel = 1"))


@Q.plan("R3_recall", f"SELECT j.query_id, round(count(*) FILTER (WHERE rank <= 50) / count(*), 6) AS recall FROM {JUDGED} j JOIN {RANKED} r ON r.query_id = j.query_id AND r.doc_id = j.doc_id WHERE rel = 1 GROUP BY j.query_id")
def recall(get):
    return evaluation.recall(ranked(get), judged(get).where("rel = 1"), 50)


Q.sql("R4_percentile", "SELECT lang, round(percentile(n_chars, 0.95), 4) AS p95 FROM {documents} GROUP BY lang", "SELECT lang, round(quantile_cont(n_chars, 0.95), 4) AS p95 FROM {documents} GROUP BY lang")
Q.sql("R10_slow_queries", "SELECT event_id, value FROM {events} WHERE value > 95 ORDER BY value DESC, event_id")

QUERIES, ORACLES = Q.queries, Q.oracles
