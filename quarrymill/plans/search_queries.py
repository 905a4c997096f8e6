"""Fuzzy, vector, fusion, graph and cross-repository queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions import ranking
from quarrymill.functions.text import code_intent, jaccard, point_id, trigrams
from quarrymill.operators import fusion, fuzzy, graph, lexical, vector
from quarrymill.operators.index import stored
from quarrymill.session import stage

from .bindings import Queries
from .lexical_queries import bm25_sql

Q = Queries()

# -- fuzzy -------------------------------------------------------------------------------------

GRAMS = "list_distinct(list_transform(range(1, length({0}) + 3), lambda i: substr('  ' || lower({0}) || '  ', i, 3)))"
NAME_GRAMS, PATH_GRAMS, ASK_GRAMS = GRAMS.format("name"), GRAMS.format("path"), GRAMS.format("'red_wigdet_1'")


@Q.plan("F1_trigrams", f"SELECT symbol_id, unnest({NAME_GRAMS}) AS trigram FROM {{symbols}}")
def trigram_rows(get):
    return fuzzy.trigram_index(get("symbols"), "symbol_id", "name")


FUZZY_SQL = f"""SELECT symbol_id, name, round(m / (q + t - m), 6) AS score FROM (SELECT symbol_id, name, len(list_intersect({NAME_GRAMS}, {ASK_GRAMS})) AS m, len({NAME_GRAMS}) AS t, len({ASK_GRAMS}) AS q FROM {{symbols}}) WHERE m > 0"""


@Q.plan("F2_symbol_trigram_jaccard", f"SELECT * FROM ({FUZZY_SQL}) ORDER BY score DESC, name, symbol_id LIMIT 20")
def symbol_fuzzy(get):
    return fuzzy.similar(get("symbols"), "symbol_id", "name", "red_wigdet_1").orderBy(F.desc("score"), "name", "symbol_id").limit(20)


@Q.plan("C4_trigram_index_join", FUZZY_SQL)
def symbol_fuzzy_index(get):
    symbols = get("symbols")
    return fuzzy.similar_by_index(fuzzy.trigram_index(symbols, "symbol_id", "name"), symbols, "symbol_id", "name", "red_wigdet_1")


@Q.plan("F3_path_trigram_jaccard", f"""SELECT file_id, path, round(m / (q + t - m), 6) AS score FROM (SELECT file_id, path, len(list_intersect({PATH_GRAMS}, {ASK_GRAMS.replace('red_wigdet_1', 'src/src3/fiel_12.py')})) AS m,
 len({PATH_GRAMS}) AS t, len({ASK_GRAMS.replace('red_wigdet_1', 'src/src3/fiel_12.py')}) AS q FROM {{files}}) WHERE m > 0 ORDER BY score DESC, file_id LIMIT 15""")
def path_fuzzy(get):
    return fuzzy.similar(get("files"), "file_id", "path", "src/src3/fiel_12.py").orderBy(F.desc("score"), "file_id").limit(15)


@Q.plan("F4_substring_symbols", "SELECT symbol_id, name FROM {symbols} WHERE contains(lower(name), lower('Anvil_1'))")
def substring(get):
    return get("symbols").where(F.contains(F.lower("name"), F.lower(F.lit("Anvil_1")))).select("symbol_id", "name")


@Q.plan("F5_trigram_postings", f"WITH g AS (SELECT symbol_id, unnest({NAME_GRAMS}) AS trigram FROM {{symbols}}) SELECT trigram, count(*) AS symbols, min(symbol_id) AS first FROM g GROUP BY trigram")
def trigram_postings(get):
    index = fuzzy.trigram_index(get("symbols"), "symbol_id", "name")
    return index.groupBy("trigram").agg(F.count(F.lit(1)).alias("symbols"), F.min("symbol_id").alias("first"))


@Q.plan("F6_merged_fuzzy", f"""WITH s AS (SELECT s.file_id, score FROM ({FUZZY_SQL}) h JOIN {{symbols}} s USING (symbol_id)),
p AS (SELECT file_id, round(m / (q + t - m), 6) AS score FROM (SELECT file_id, len(list_intersect({PATH_GRAMS}, {ASK_GRAMS})) AS m, len({PATH_GRAMS}) AS t, len({ASK_GRAMS}) AS q FROM {{files}}) WHERE m > 0)
SELECT file_id, max(score) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM p) GROUP BY file_id ORDER BY max(score) DESC, file_id LIMIT 25""")
def merged_fuzzy(get):
    symbols, files = get("symbols"), get("files")
    by_symbol = fuzzy.similar(symbols, "symbol_id", "name", "red_wigdet_1").join(symbols.select("symbol_id", "file_id"), "symbol_id")
    by_path = fuzzy.similar(files, "file_id", "path", "red_wigdet_1")
    return fuzzy.best_of(by_symbol, by_path, key="file_id").orderBy(F.desc("score"), "file_id").limit(25)


Q.sql("J3_fuzzy_max_merge", "SELECT file_id, max(score) AS score FROM (SELECT file_id, cast(line_start AS double) / 50 AS score FROM {symbols} UNION ALL SELECT file_id, cast(size AS double) / 40000 FROM {files}) GROUP BY file_id")


@Q.plan("J6_trigram_set_algebra", f"""SELECT a.symbol_id AS a, b.symbol_id AS b, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS score
FROM (SELECT symbol_id, {NAME_GRAMS} AS g FROM {{symbols}}) a JOIN (SELECT symbol_id, {NAME_GRAMS} AS g FROM {{symbols}}) b ON b.symbol_id = a.symbol_id + 1""")
def set_algebra(get):
    g = get("symbols").select("symbol_id", trigrams(F.col("name")).alias("g"))
    pair = g.select(F.col("symbol_id").alias("a"), F.col("g").alias("ga"), (F.col("symbol_id") + 1).alias("b")).join(g.select(F.col("symbol_id").alias("b"), F.col("g").alias("gb")), "b")
    return pair.select("a", "b", F.round(jaccard(F.col("ga"), F.col("gb")), 6).alias("score"))


# -- vectors -----------------------------------------------------------------------------------

DUCK_METRIC = {"cosine": "list_cosine_similarity", "dot": "list_dot_product", "euclid": "list_distance"}


def nearest_sql(metric: str, k: int) -> str:
    a, b = "a.embedding::DOUBLE[]", "b.embedding::DOUBLE[]"
    score = f"{DUCK_METRIC[metric]}({a}, {b})" if metric in DUCK_METRIC else f"list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))"
    down = "DESC" if metric in ("cosine", "dot") else "ASC"
    return f"""SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {down}, vec_id) AS rank
FROM (SELECT b.vec_id AS query_id, a.vec_id, round({score}, 5) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0)) WHERE rank <= {k}"""


def nearest_plan(metric, k):
    def build(get):
        points = get("embeddings")
        return vector.nearest(points, points.where("vec_id % 20 = 0"), k, metric)

    return build


for _metric in ("cosine", "dot", "euclid", "manhattan"):
    Q.plan(f"G2_metric_{_metric}", nearest_sql(_metric, 5))(nearest_plan(_metric, 5))
Q.plan("G1_knn_query", nearest_sql("cosine", 10))(nearest_plan("cosine", 10))


@Q.plan("G4_type_weighted", """WITH s AS (SELECT a.vec_id, a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 3 AND a.label IN (1, 2, 5))
SELECT vec_id, label, round(round(score, 5) * CASE label WHEN 1 THEN 1.2 WHEN 2 THEN 0.9 ELSE 1.0 END, 5)::DOUBLE AS weighted FROM s ORDER BY round(round(score, 5) * CASE label WHEN 1 THEN 1.2 WHEN 2 THEN 0.9 ELSE 1.0 END, 5)::DOUBLE DESC, vec_id LIMIT 20""")
def type_weighted(get):
    weight = F.when(F.col("label") == 1, 1.2).when(F.col("label") == 2, 0.9).otherwise(1.0)
    points = get("embeddings").where("label IN (1, 2, 5)").withColumn("weight", weight)
    best = vector.nearest(points, get("embeddings").where("vec_id = 3"), 20, weight="weight")
    return best.join(points.select("vec_id", "label"), "vec_id").select("vec_id", "label", F.col("score").alias("weighted"))


@Q.plan("G5_point_id", "SELECT symbol_id, ('0x' || substr(sha1(name || ':' || kind || ':' || line_start), 1, 16))::UBIGINT::DECIMAL(20,0) AS point FROM {symbols}")
def point_ids(get):
    return get("symbols").select("symbol_id", point_id(F.col("name"), F.col("kind"), F.col("line_start")).alias("point"))


Q.sql("G10_embedding_text", "SELECT symbol_id, md5(substr('File: ' || path || chr(10) || 'Symbol: ' || name || chr(10) || 'Kind: ' || kind || chr(10) || content, 1, 6000)) AS unit FROM {symbols} s JOIN {files} f ON s.file_id = f.file_id")
Q.sql("G13_stale_vectors", "SELECT p.chunk_id, p.profile_id FROM {points} p LEFT JOIN {chunks} c ON c.chunk_id = p.chunk_id AND c.line_end > 30 WHERE c.chunk_id IS NULL")
Q.sql("G14_move_vectors", "SELECT chunk_id, CASE WHEN collection = 'c1' THEN 'moved/' || chunk_id ELSE chunk_id END AS path, profile_id, collection FROM {points}")
Q.sql("G15_compatibility", "SELECT sha2(profile_id || ':' || collection, 256) AS hash, count(*) AS points FROM {points} GROUP BY profile_id, collection", "SELECT sha256(profile_id || ':' || collection) AS hash, count(*) AS points FROM {points} GROUP BY profile_id, collection")
Q.sql("A18_collection_shape", "SELECT size(embedding) AS dimension, count(*) AS points FROM {embeddings} GROUP BY size(embedding)", "SELECT len(embedding)::INT AS dimension, count(*) AS points FROM {embeddings} GROUP BY len(embedding)")
Q.sql("B12_payload_filter", "SELECT file_id, hash FROM {files} WHERE hash IN (SELECT hash FROM {files} WHERE file_id = 5) ORDER BY file_id LIMIT 1000")

ASK = "where is file_42 implemented"
MULT_SQL = """({prior}) * CASE WHEN starts_with(path, 'src/') THEN {impl} WHEN starts_with(path, 'scripts/') THEN 1.1 ELSE 1.0 END * CASE WHEN regexp_matches(path, '(^|/)tests/') THEN 0.55 ELSE 1.0 END
 * CASE WHEN regexp_matches(path, '^(docs|ai_docs|architecture)/') THEN 0.35 ELSE 1.0 END"""
PRIOR_HYBRID = "CASE WHEN starts_with(path, 'src/') THEN 1.15 WHEN starts_with(path, 'scripts/') THEN 1.05 WHEN starts_with(path, 'tests/') THEN 0.75 WHEN starts_with(path, 'docs/') THEN 0.7 ELSE 1.0 END"
PRIOR_SEMANTIC = "CASE WHEN starts_with(path, 'src/') THEN 1.15 WHEN starts_with(path, 'scripts/') THEN 1.05 WHEN starts_with(path, 'plans/') THEN 0.45 WHEN starts_with(path, 'tests/') THEN 0.75 WHEN starts_with(path, 'docs/') THEN 0.7 ELSE 1.0 END"


@Q.plan("H6_hybrid_path_multiplier", f"SELECT file_id, round({MULT_SQL.format(prior=PRIOR_HYBRID, impl=1.2)}, 6)::DOUBLE AS multiplier FROM {{files}}")
def hybrid_multiplier(get):
    return get("files").select("file_id", F.round(ranking.path_multiplier(F.col("path"), code_intent(F.lit(ASK)), ranking.CODE_FACTORS_HYBRID, False), 6).alias("multiplier"))


@Q.plan("G7_semantic_path_prior", f"SELECT file_id, round({MULT_SQL.format(prior=PRIOR_SEMANTIC, impl=1.25)} * CASE WHEN starts_with(path, 'plans/') THEN 0.2 ELSE 1.0 END, 6)::DOUBLE AS prior FROM {{files}}")
def semantic_prior(get):
    return get("files").select("file_id", F.round(ranking.path_multiplier(F.col("path"), code_intent(F.lit(ASK)), ranking.CODE_FACTORS_SEMANTIC, True), 6).alias("prior"))


OVERLAP_SQL = """round(1.0 + least(len(list_filter(['the', 'file', 'from', 'src3'], lambda t: contains(lower(content), t))), 5) * {0}
 + least(len(list_filter(['the', 'file', 'from', 'src3'], lambda t: contains(trim(regexp_replace(lower(path), '[^a-z0-9]+', ' ', 'g')), t))), 4) * 0.08, 6)::DOUBLE"""


@Q.plan("H7_hybrid_overlap", f"SELECT file_id, {OVERLAP_SQL.format(0.03)} AS multiplier FROM {{files}}")
def hybrid_overlap(get):
    return get("files").select("file_id", F.round(ranking.overlap_multiplier(F.lit("the file from src3"), F.col("path"), F.col("content"), 0.03), 6).alias("multiplier"))


@Q.plan("G6_semantic_overlap", f"SELECT file_id, {OVERLAP_SQL.format(0.04)} AS bonus FROM {{files}}")
def semantic_overlap(get):
    return get("files").select("file_id", F.round(ranking.overlap_multiplier(F.lit("the file from src3"), F.col("path"), F.col("content"), 0.04), 6).alias("bonus"))


# -- fusion ------------------------------------------------------------------------------------

LISTS_SQL = f"""{bm25_sql('documents', ['the', 'from'], 'doc_id', 'text')},
b AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6), doc_id) - 1 AS rank FROM w ORDER BY rank LIMIT 50),
v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS rank FROM (SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS s FROM embeddings a, embeddings q WHERE q.vec_id = 0) ORDER BY rank LIMIT 50),
z AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents ORDER BY rank LIMIT 50),
u AS (SELECT *, 'bm25' AS branch, 0 AS pos, 0.5 AS weight FROM b UNION ALL SELECT *, 'semantic', 1, 0.3 FROM v UNION ALL SELECT *, 'fuzzy', 2, 0.2 FROM z)"""
WEIGHTS = {"bm25": 0.5, "semantic": 0.3, "fuzzy": 0.2}


def three_lists(get):
    docs, points = get("documents"), get("embeddings")
    b = stored(docs, "doc_id", ("text",)).top("the from", 50).withColumnRenamed("key", "doc_id")
    v = vector.nearest(points, points.where("vec_id = 0"), 50).select(F.col("vec_id").alias("doc_id"), "score")
    z = docs.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    return [
        fusion.ranked(b, "doc_id", [F.asc("score"), F.asc("doc_id")], "bm25", 0),
        fusion.ranked(v, "doc_id", [F.desc("score"), F.asc("doc_id")], "semantic", 1),
        fusion.ranked(z, "doc_id", [F.desc("n_chars"), F.asc("doc_id")], "fuzzy", 2),
    ]


@Q.plan("H1_reciprocal_rank_fusion", f"WITH {LISTS_SQL} SELECT doc_id, round(sum(weight::DOUBLE / (60 + rank + 1)), 8) AS score, arg_min(branch, [rank, pos]) AS best_branch, count(DISTINCT branch) AS n_branches FROM u GROUP BY doc_id")
def rrf(get):
    return fusion.reciprocal_rank(three_lists(get), WEIGHTS, "doc_id")


@Q.plan("D13_rrf_sum", f"WITH {LISTS_SQL} SELECT doc_id, round(sum(1.0::DOUBLE / (10 + rank + 1)), 8) AS score, arg_min(branch, [rank, pos]) AS best_branch, count(DISTINCT branch) AS n_branches FROM u GROUP BY doc_id")
def rrf_sum(get):
    return fusion.reciprocal_rank(three_lists(get), dict.fromkeys(WEIGHTS, 1.0), "doc_id", k=10)


@Q.plan("I5_channel_attribution", f"WITH {LISTS_SQL} SELECT doc_id, max(rank) FILTER (WHERE branch = 'bm25') AS lexical_rank, max(rank) FILTER (WHERE branch = 'semantic') AS dense_rank FROM u GROUP BY doc_id")
def attribution(get):
    every = three_lists(get)
    union = every[0].unionByName(every[1]).unionByName(every[2])
    return union.groupBy("doc_id").agg(F.max(F.when(F.col("branch") == "bm25", F.col("rank"))).cast("long").alias("lexical_rank"), F.max(F.when(F.col("branch") == "semantic", F.col("rank"))).cast("long").alias("dense_rank"))


@Q.plan("H2_hybrid_search", f"""WITH {LISTS_SQL}, fused AS (SELECT doc_id, round(sum(weight::DOUBLE / (60 + rank + 1)), 8) AS score FROM u GROUP BY doc_id),
m AS (SELECT file_id, path, round(score * CASE WHEN regexp_matches(path, '[.](py|go)$') THEN 1.2 WHEN regexp_matches(path, '[.](md|txt)$') THEN 0.5 ELSE 0.8 END, 8)::DOUBLE AS score FROM fused JOIN {{files}} f ON f.file_id = fused.doc_id)
SELECT file_id, path, score FROM m ORDER BY score DESC, file_id LIMIT 20""")
def hybrid(get):
    fused = fusion.reciprocal_rank(three_lists(get), WEIGHTS, "doc_id")
    joined = fused.join(get("files").select("file_id", "path"), F.col("doc_id") == F.col("file_id"))
    out = joined.select("file_id", "path", F.round(F.col("score") * ranking.extension_multiplier(F.col("path")), 8).alias("score"))
    return out.orderBy(F.desc("score"), "file_id").limit(20)


Q.sql("H5_extension_multiplier", "SELECT file_id, CASE WHEN path LIKE '%.py' OR path LIKE '%.go' THEN 1.2D WHEN path LIKE '%.md' OR path LIKE '%.txt' THEN 0.5D ELSE 0.8D END AS multiplier FROM {files}", "SELECT file_id, CASE WHEN path LIKE '%.py' OR path LIKE '%.go' THEN 1.2 WHEN path LIKE '%.md' OR path LIKE '%.txt' THEN 0.5 ELSE 0.8 END::DOUBLE AS multiplier FROM {files}")


@Q.plan("I10_quota_fill", """WITH r AS (SELECT file_id, CASE WHEN regexp_matches(path, '[.](py|go)$') THEN 'code' WHEN regexp_matches(path, '[.](md|txt)$') THEN 'prose' ELSE 'other' END AS kind, size FROM {files}),
k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY size DESC, file_id) AS k FROM r),
c AS (SELECT least((SELECT count(*) FROM r WHERE kind = 'prose'), 5) AS pc),
t AS (SELECT file_id, kind, size, k, CASE WHEN kind = 'code' AND k <= 20 - pc THEN 0 WHEN kind = 'prose' AND k <= pc THEN 1 WHEN kind = 'other' THEN 2 WHEN kind = 'code' THEN 3 END AS tier FROM k, c)
SELECT file_id, kind, size, tier::INT AS tier, position::INT AS position FROM (SELECT *, row_number() OVER (ORDER BY tier, k) AS position FROM t WHERE tier IS NOT NULL) WHERE position <= 20""")
def quota(get):
    rows = get("files").select("file_id", ranking.file_class(F.col("path")).alias("kind"), "size")
    return fusion.quota_fill(rows, "kind", [F.desc("size"), F.asc("file_id")], 20)


@Q.plan("H9_tfidf_rerank", f"""WITH {bm25_sql('documents', ['only', 'from'], 'doc_id', 'text').replace('d AS', 'd0 AS').replace('FROM d,', 'FROM d0,').replace('FROM d)', 'FROM d0)').replace('f AS', 'f0 AS').replace('JOIN f ', 'JOIN f0 ')}, best AS (SELECT doc_id FROM w ORDER BY round(score, 6), doc_id LIMIT 50),
c AS (SELECT doc_id, lower(text) AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM best) UNION ALL SELECT -1, 'the that from with only'),
words AS (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z0-9_]{{2,}}')) AS term FROM c),
f AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM c), df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
x AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS v FROM f JOIN df USING (term), n),
l AS (SELECT doc_id, sqrt(sum(v * v)) AS len FROM x GROUP BY doc_id)
SELECT a.doc_id, round(sum(a.v * b.v) / (max(l.len) * max(q.len)), 6) AS score FROM x a JOIN x b ON a.term = b.term AND b.doc_id = -1 JOIN l ON l.doc_id = a.doc_id JOIN l q ON q.doc_id = -1 WHERE a.doc_id >= 0 GROUP BY a.doc_id""")
def tfidf(get):
    """Candidates of one query, weighed by term frequency and rarity among query and candidates; cosine with the query."""
    docs = get("documents")
    best = stored(docs, "doc_id", ("text",)).top("only from", 50).withColumnRenamed("key", "doc_id")
    # At most 51 rows go on: as one stored table they are read once by all that follows.
    candidates = stage(docs.join(F.broadcast(best), "doc_id", "left_semi").select("doc_id", F.lower("text").alias("t")), "candidates")
    asked = docs.sparkSession.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("the that from with only").alias("t"))
    return fusion.tfidf_scores(candidates.unionByName(asked), "doc_id", "t", -1)


Q.sql("H12_endpoint_rerank_order", "SELECT doc_id, row_number() OVER (ORDER BY s DESC NULLS LAST, doc_id) AS new_rank FROM (SELECT doc_id, CASE WHEN quality = 1 THEN n_chars END AS s FROM {documents} JOIN {labels} USING (doc_id) ORDER BY s DESC NULLS LAST, doc_id LIMIT 40)",
    "SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN quality = 1 THEN n_chars END DESC NULLS LAST, doc_id) AS new_rank FROM {documents} JOIN {labels} USING (doc_id) ORDER BY new_rank LIMIT 40")
Q.sql("H15_min_max_normalise", "SELECT event_id, round((greatest(0.0D, least(15.0D, value)) - 0.0D) / 15.0D, 6) AS score FROM {events}", "SELECT event_id, round((greatest(0.0, least(15.0, value)) - 0.0) / 15.0, 6) AS score FROM {events}")
Q.sql("H16_score_source", "SELECT event_id, CASE WHEN props LIKE '%7%' THEN 'fuzzy' WHEN value > 1.5 THEN 'bm25' WHEN value >= 0 AND value <= 1.0 THEN 'semantic' ELSE 'unknown' END AS source FROM {events}")
GROUPS = "SELECT user_id, event_type, count(*) AS n, max(value) AS best FROM {events} GROUP BY user_id, event_type"
RANK = "least(1.0, (least(best / 15.0, 1.0) * 0.4 + least(1.0, n / 3.0) * 0.3 + least(1.0, n / 5.0) * 0.2 + 0.05) * CASE WHEN n > 1 THEN 1.1 ELSE 1.0 END * CASE WHEN best > 10.0 THEN 1.05 ELSE 1.0 END)"
Q.sql("H17_simple_rank_score", f"SELECT user_id, event_type, cast(round(cast({RANK} AS double), 6) AS double) AS score FROM ({GROUPS})")
Q.sql("H18_smart_rank_score", f"SELECT user_id, event_type, cast(round(cast(least(1.0, {RANK} * CASE WHEN n >= 3 THEN 1.2 ELSE 1.0 END * CASE WHEN event_type = 'view' THEN 1.05 ELSE 1.0 END) AS double), 6) AS double) AS score FROM ({GROUPS})")
Q.sql("H20_context_merge", """WITH g AS (SELECT file_id, line_number, CASE WHEN line_number - lag(line_number) OVER (PARTITION BY file_id ORDER BY line_number) <= 3 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT file_id, line_number FROM {refs})),
i AS (SELECT file_id, line_number, sum(fresh) OVER (PARTITION BY file_id ORDER BY line_number) AS island FROM g) SELECT file_id, island, min(line_number) AS first, max(line_number) AS last, count(*) AS n FROM i GROUP BY file_id, island""")
Q.sql("H21_most_complete_definition", "WITH r AS (SELECT name, symbol_id, length(signature) AS filled, row_number() OVER (PARTITION BY name ORDER BY length(signature) DESC, symbol_id) AS k FROM {symbols}) SELECT name, symbol_id, filled FROM r WHERE k = 1")
Q.sql("H22_references", "WITH r AS (SELECT file_id, line_number, symbol_id, row_number() OVER (PARTITION BY file_id, line_number ORDER BY symbol_id) AS k FROM {refs}) SELECT file_id, line_number, symbol_id FROM r WHERE k = 1")
Q.sql("H23_documents_first", "SELECT file_id, path, row_number() OVER (ORDER BY late, weight DESC, file_id) AS position FROM (SELECT file_id, path, CASE WHEN path LIKE '%.md' THEN 0 ELSE 1 END AS late, size * CASE WHEN path LIKE '%.md' THEN 1.5 ELSE 1.0 END AS weight FROM {files} ORDER BY late, weight DESC, file_id LIMIT 30)",
    "SELECT file_id, path, row_number() OVER (ORDER BY CASE WHEN path LIKE '%.md' THEN 0 ELSE 1 END, size * CASE WHEN path LIKE '%.md' THEN 1.5 ELSE 1.0 END DESC, file_id) AS position FROM {files} ORDER BY position LIMIT 30")
Q.sql("H24_aggregate_statistics", "SELECT count(*) AS total, count(DISTINCT file_id) AS kept, count(*) - count(DISTINCT file_id) AS duplicates_removed FROM {refs}")


# -- graph -------------------------------------------------------------------------------------

REACH_SQL = """WITH RECURSIVE e AS (SELECT * FROM {{edges}}), b(node, d) AS (SELECT {seed}, 0 UNION SELECT {to}, d + 1 FROM b JOIN e ON {frm} = node WHERE d < {depth})
SELECT node, min(d)::INT AS distance FROM b GROUP BY node"""


def seeded(get, *nodes):
    return get("edges").sparkSession.createDataFrame([(n,) for n in nodes], "node string")


@Q.plan("L2_dependencies", REACH_SQL.format(seed="'c1'", to="dst", frm="src", depth=3) + " HAVING min(d) > 0")
def dependencies(get):
    return graph.reach(get("edges"), seeded(get, "c1"), 3).where("distance > 0")


@Q.plan("L3_dependents", REACH_SQL.format(seed="'r0'", to="src", frm="dst", depth=3) + " HAVING min(d) > 0")
def dependents(get):
    return graph.reach(graph.reverse(get("edges")), seeded(get, "r0"), 3).where("distance > 0")


@Q.plan("L4_shortest_path", """WITH RECURSIVE e AS (SELECT * FROM {edges}), p(node, path) AS (SELECT 'c1', ['c1'] UNION ALL SELECT dst, list_append(path, dst) FROM p JOIN e ON src = node WHERE NOT list_contains(path, dst) AND len(path) <= 5)
SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INT AS length FROM p WHERE node = (SELECT 'n' || (n_regionkey + 7) FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_custkey = 1) ORDER BY len(path), path LIMIT 1""")
def path(get):
    row = get("customer").where("c_custkey = 1").join(get("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey").first()
    return graph.shortest_path(get("edges"), "c1", f"n{row.n_regionkey + 7}", 5)


@Q.plan("L5_hotspots", "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {edges} UNION ALL SELECT dst FROM {edges}) GROUP BY node ORDER BY count(*) DESC, node LIMIT 10")
def hotspots(get):
    return graph.degrees(get("edges")).orderBy(F.desc("degree"), "node").limit(10)


Q.sql("D17_degree_centrality", "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {edges} UNION ALL SELECT dst FROM {edges}) GROUP BY node")


@Q.plan("L6_context_selection", REACH_SQL.format(seed="'c5'", to="dst", frm="src", depth=2).replace("SELECT node, min(d)::INT AS distance FROM b GROUP BY node", """, m AS (SELECT node, min(d)::INT AS distance FROM b GROUP BY node), o AS (SELECT src AS node, count(*) AS k FROM e GROUP BY src)
SELECT m.node, distance, round(1.0 / greatest(distance, 1) + 0.1 * coalesce(k, 0), 6)::DOUBLE AS score FROM m LEFT JOIN o ON m.node = o.node ORDER BY round(1.0 / greatest(distance, 1) + 0.1 * coalesce(k, 0), 6)::DOUBLE DESC, m.node LIMIT 5"""))
def selection(get):
    return graph.context(get("edges"), seeded(get, "c5"), 2, 5)


@Q.plan("L8_induced_edges", REACH_SQL.format(seed="'r1'", to="src", frm="dst", depth=1).replace("SELECT node, min(d)::INT AS distance FROM b GROUP BY node", ", m AS (SELECT DISTINCT node FROM b) SELECT src, dst FROM e WHERE src IN (SELECT node FROM m) AND dst IN (SELECT node FROM m)"))
def induced_edges(get):
    return graph.induced(get("edges"), graph.reach(graph.reverse(get("edges")), seeded(get, "r1"), 1))


Q.sql("L9_graph_search", """SELECT node, 'context' AS source FROM (SELECT DISTINCT dst AS node FROM {edges} WHERE src IN ('c1', 'c2', 'c3')) WHERE node NOT IN ('c1', 'c2', 'c3') UNION ALL SELECT node, 'result' FROM (SELECT DISTINCT src AS node FROM {edges} WHERE src IN ('c1', 'c2', 'c3'))""")


@Q.plan("L10_symbol_dependents", REACH_SQL.format(seed="'s3'", to="dst", frm="src", depth=3) + " HAVING min(d) > 0")
def symbol_dependents(get):
    return graph.reach(get("edges"), seeded(get, "s3"), 3).where("distance > 0")


@Q.plan("L11_topological_levels", """WITH RECURSIVE c AS (SELECT chunk, CASE WHEN parent IN (SELECT chunk FROM {chunk_tree}) THEN parent END AS parent FROM {chunk_tree}),
b(chunk, level) AS (SELECT chunk, 0 FROM c WHERE parent IS NULL UNION ALL SELECT c.chunk, level + 1 FROM b JOIN c ON c.parent = b.chunk)
SELECT c.chunk, level, level IS NULL AS in_cycle FROM c LEFT JOIN b ON b.chunk = c.chunk""")
def topological(get):
    return graph.levels(get("chunk_tree"), "chunk", "parent")


@Q.plan("L13_hierarchy_closure", """WITH RECURSIVE b(node, anc, d) AS (SELECT chunk, parent, 1 FROM {chunk_tree} WHERE parent IS NOT NULL UNION SELECT b.node, t.parent, d + 1 FROM b JOIN {chunk_tree} t ON t.chunk = b.anc WHERE t.parent IS NOT NULL AND d < 40)
SELECT node, anc, min(d)::INT AS distance FROM b GROUP BY node, anc""")
def hierarchy(get):
    tree = get("chunk_tree").where("parent IS NOT NULL")
    return graph.closure(tree.select(F.col("chunk").alias("src"), F.col("parent").alias("dst"))).withColumnsRenamed({"src": "node", "dst": "anc"})


Q.sql("L14_adjacency_sets", "SELECT src, count(DISTINCT dst) AS n, min(dst) AS least FROM {edges} GROUP BY src")
Q.sql("C13_graph_seed_join", "SELECT DISTINCT src FROM {edges} WHERE src IN (SELECT 'c' || cast(file_id AS string) FROM {files} WHERE language = 'de')")
Q.sql("C14_symbol_seeds", "SELECT src, dst FROM {edges} WHERE src IN ('n1', 'n2', 's7')")

# -- cross-repository --------------------------------------------------------------------------


@Q.plan("M1_cross_repo_symbols", "SELECT repo_id, name, symbol_id, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY name, symbol_id) AS k FROM {repo_symbols} WHERE contains(lower(name), '00')) WHERE k <= 5")
def cross_repo(get):
    hits = get("repo_symbols").where(F.contains(F.lower("name"), F.lit("00")))
    ranked = hits.withColumn("k", F.row_number().over(W.partitionBy("repo_id").orderBy("name", "symbol_id")))
    return ranked.where("k <= 5").select("repo_id", "name", "symbol_id", "k")


@Q.plan("M2_cross_repo_code", """WITH d AS (SELECT file_id, repo, tokens_of(content) AS t FROM {files}), s AS (SELECT repo, count(*) AS n, avg(len(t)) AS avgdl FROM d GROUP BY repo),
p AS (SELECT file_id, repo, len(t) AS dl, len(list_filter(t, lambda x: x = 'only')) AS tf FROM d), f AS (SELECT repo, count(*) AS df FROM p WHERE tf > 0 GROUP BY repo),
w AS (SELECT file_id, repo, round(-CASE WHEN ln((n-df+0.5)/(df+0.5)) > 0 THEN ln((n-df+0.5)/(df+0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM p JOIN s USING (repo) JOIN f USING (repo) WHERE tf > 0)
SELECT repo, file_id, score, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score, file_id) AS k FROM w) WHERE k <= 3""")
def cross_code(get):
    """Each repository ranks by its own statistics."""
    t = get("files").select("file_id", "repo", lexical.tokens(F.col("content")).alias("t"))
    counted = t.select("file_id", "repo", F.size("t").alias("dl"), lexical.term_frequency("t", "only").alias("tf"))
    stats = counted.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), F.count_if(F.col("tf") > 0).alias("df"))
    part = lexical.idf(F.col("n"), F.col("df")) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    scored = counted.where("tf > 0").join(stats, "repo").select("repo", "file_id", F.round(-part, 6).alias("score"))
    return scored.withColumn("k", F.row_number().over(W.partitionBy("repo").orderBy("score", "file_id"))).where("k <= 3")


SYMBOL_SCORE = "CASE WHEN lower(name) = 'customer_000000012' THEN 10.0 WHEN lower(name) LIKE 'customer_00000001%' THEN 7.0 WHEN contains(lower(name), '12') THEN 5.0 ELSE 0.0 END + CASE WHEN kind IN ('machinery', 'building') THEN 2.0 WHEN kind = 'household' THEN 1.5 ELSE 0.0 END"
Q.sql("M4_symbol_scorer", f"SELECT symbol_id, cast({SYMBOL_SCORE} AS double) AS score FROM {{repo_symbols}}")
Q.sql("M5_code_scorer", "SELECT file_id, cast((length(lower(content)) - length(replace(lower(content), 'the', ''))) / 3 * 2.0 + CASE WHEN path LIKE 'src/%' THEN 3.0 ELSE 0.0 END AS double) AS score FROM {files}")
Q.sql("M6_occurrence_boost", "SELECT kind, n, cast(round(n * CASE WHEN n > 1 THEN 1 + 0.1 * (n - 1) ELSE 1 END, 4) AS double) AS score FROM (SELECT kind, count(DISTINCT repo_id) AS n FROM {repo_symbols} GROUP BY kind)")
Q.sql("M7_dedup_key", "SELECT symbol_id, md5(name || ':' || kind) AS key FROM {symbols}")
Q.sql("D15_content_hash_groups", "SELECT md5(name || ':' || kind) AS key, count(*) AS occurrences, min(symbol_id) AS first, count(DISTINCT file_id) AS files FROM {symbols} GROUP BY md5(name || ':' || kind)")
Q.sql("M8_relative_key", "SELECT file_id, md5(substr(path, instr(path, '/') + 1)) AS key FROM {files}")
Q.sql("M3_coordinated_search", f"WITH s AS (SELECT name, kind, min(repo_id) AS repo_id, count(DISTINCT repo_id) AS n, cast(max({SYMBOL_SCORE}) AS double) AS score FROM {{repo_symbols}} WHERE contains(name, '1') GROUP BY name, kind) SELECT name, kind, repo_id, cast(round(score * CASE WHEN n > 1 THEN 1 + 0.1 * (n - 1) ELSE 1 END, 4) AS double) AS score FROM s ORDER BY score DESC, name LIMIT 25")
Q.sql("M9_code_best_first", "SELECT repo, file_id, size FROM (SELECT repo, file_id, size, row_number() OVER (PARTITION BY md5(substr(path, instr(path, '/') + 1)) ORDER BY size DESC, file_id) AS k FROM {files}) WHERE k = 1 ORDER BY size DESC, file_id LIMIT 40")
Q.sql("M13_repository_listing", "SELECT repo_id, name, priority FROM {repositories} WHERE active ORDER BY priority DESC, name")
Q.sql("M14_repository_identity", "SELECT repo_id, substr(sha2(coalesce(nullif(name, 'NATION_3'), 'path/' || cast(repo_id AS string)), 256), 1, 16) AS identity FROM {repositories}", "SELECT repo_id, substr(sha256(coalesce(nullif(name, 'NATION_3'), 'path/' || cast(repo_id AS string))), 1, 16) AS identity FROM {repositories}")
Q.sql("I12_scope_top_repositories", "SELECT repo_id, priority FROM {repositories} WHERE active AND repo_id < 20 ORDER BY priority DESC, repo_id LIMIT 6")
Q.sql("D6_repository_rollup", "SELECT language, count(DISTINCT repo) AS repositories, count(*) AS files, sum(size) AS bytes FROM {files} GROUP BY language")
Q.sql("D16_dedup_statistics", "SELECT repo, count(*) AS original, count(DISTINCT hash) AS kept, count(*) - count(DISTINCT hash) AS duplicates FROM {files} GROUP BY repo")

QUERIES, ORACLES = Q.queries, Q.oracles
