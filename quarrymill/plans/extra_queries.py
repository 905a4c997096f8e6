"""Sequential text operators, semantic re-ranking, and the session facade."""

from __future__ import annotations

import difflib

from pyspark.sql import functions as F

from quarrymill import api
from quarrymill.functions import ranking
from quarrymill.functions.text import code_intent
from quarrymill.operators import chunking, lexical, prose, vector

from .bindings import VIEWS, Queries
from .lexical_queries import bm25_sql, snippet_sql

Q = Queries()


def per_text(key, rows, schema):
    Q.plan(key)(lambda get: prose.table(get("documents"), rows, schema))


per_text("N4_abbreviation_sentences", lambda t: list(enumerate(prose.sentences(t))), "i int, sentence string")
per_text("N11_coherent_chunks", lambda t: list(enumerate(prose.coherent(chunking.by_sentence(t, 200, 0)))), "i int, content string")
per_text("N20_boundaries", prose.boundaries, "at int, strength double")
per_text("N23_merged_chunks", lambda t: list(enumerate(prose.merged(chunking.by_paragraph(t), 600))), "i int, content string")
per_text("N25_block_parser", prose.blocks, "kind string, first int, last int")
per_text("N26_markdown_chunks", lambda t: [(s["title"], s["start"], s["end"]) for s in chunking.sections("# Text\n" + t)], "title string, first int, last int")
per_text("N28_paragraph_detector", lambda t: [b for b in prose.blocks(t) if b[0] == "paragraph"], "kind string, first int, last int")
per_text("N29_merged_paragraphs", lambda t: list(enumerate(prose.merged(chunking.paragraphs(t), 300, "\n\n"))), "i int, content string")
per_text("N30_text_analysis", lambda t: [tuple(prose.analyse(t).values())], "sentences int, words int, distinct_words int, paragraphs int, headings int, lists int, questions int, topics int")
per_text("N34_semantic_text_chunks", lambda t: list(enumerate(prose.semantic_chunks(t))), "i int, content string")
per_text("N35_structured_content", lambda t: [(k, sum(b[0] == k for b in prose.blocks(t))) for k in ("heading", "list", "code", "quote", "paragraph")], "kind string, n int")
per_text("N37_topics", lambda t: [(i, " ".join(w)) for i, w in enumerate(prose.topics(t))], "i int, words string")
per_text("N55_section_tree", lambda t: [(s["title"][:40], s["level"], s["parent"], s["end"] - s["start"]) for s in chunking.sections("# All\n## " + t.replace("\n", "\n## "))], "title string, level int, parent int, lines int")
per_text("N61_merge_small_chunks", lambda t: list(enumerate(prose.merged(chunking.sliding(t, 200, 0), 200))), "i int, content string")
per_text("N62_optimised_chunks", lambda t: list(enumerate(prose.coherent(chunking.balanced(chunking.by_paragraph(t), 800)))), "i int, content string")
per_text("G11_embedding_units", lambda t: [(i, len(c)) for i, c in enumerate(chunking.by_sentence(t, 400, 0))], "part int, chars int")
per_text("G12_symbol_chunk_splitter", lambda t: [(i, len(c)) for i, c in enumerate(prose.merged(chunking.paragraphs(t), 250, "\n\n"))], "part int, chars int")

SECTIONS = "WITH RECURSIVE s AS (SELECT n_nationkey AS id, n_name AS title, n_regionkey + 100 AS parent FROM {nation} UNION ALL SELECT r_regionkey + 100, r_name, cast(NULL AS int) FROM {region}), t(id, path, depth) AS (SELECT id, title, 1 FROM s WHERE parent IS NULL UNION ALL SELECT s.id, t.path || '/' || s.title, depth + 1 FROM t JOIN s ON s.parent = t.id) "
Q.sql("N56_flat_sections", SECTIONS + "SELECT id, path, depth FROM t WHERE depth <= 3")
Q.sql("N57_section_by_heading", SECTIONS + "SELECT id, path FROM t WHERE lower(path) LIKE '%/nation@_1' ESCAPE '@'")


@Q.plan("E3_search_facade", f"WITH {bm25_sql('{files}', ['from', 'only'])} SELECT file_id, round(-score, 6) AS score FROM w ORDER BY round(score, 6), file_id LIMIT 20")
def facade(get):
    files = get("files")
    return api.Engine(files.sparkSession, files, get("symbols")).search("from only", "lexical").withColumn("score", F.round("score", 6))


@Q.plan("U15_client_api", "SELECT symbol_id, name FROM {symbols} WHERE contains(lower(name), 'red_gear_2') ORDER BY CASE WHEN name = 'red_gear_2' THEN 0 ELSE 1 END, name, symbol_id LIMIT 20")
def client(get):
    files = get("files")
    return api.Engine(files.sparkSession, files, get("symbols")).lookup("red_gear_2").select("symbol_id", "name")


@Q.plan("E20_marked_search", snippet_sql("file_id", "content", "{files}", "only", 10, "**", "**"))
def marked(get):
    hits = get("files").where(F.lower("content").rlike(r"\bonly\b"))
    return hits.select("file_id", lexical.snippet(F.col("content"), ["only"], 10, "**", "**").alias("snippet"))


@Q.plan("F7_snippet_similarity")
def ratio(get):
    """Neighbouring messages of a conversation by the matching share of their texts."""
    m = get("conversations").select("conv_id", "turn", F.col("text").alias("a"))
    pair = m.join(m.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])

    @F.pandas_udf("double")
    def measured(a, b):
        import pandas as pd

        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    return pair.select("conv_id", "turn", F.round(measured("a", "b"), 4).alias("ratio"))


#: Rules that raise or lower files by query word and path part: configuration, not code.
RULES = (("deploy", "scripts/", 1.2), ("deploy", "docs/", 0.9), ("test", "tests/", 1.3))


def responsibility(query: str):
    out = F.lit(1.0)
    for word, part, factor in RULES:
        if word in query.split():
            out = out * F.when(F.contains("path", F.lit(part)), factor).otherwise(1.0)
    return out


for _key in ("G8_responsibility_bonus", "H8_hybrid_responsibility"):
    Q.plan(_key, "SELECT file_id, round(CASE WHEN contains(path, 'scripts/') THEN 1.2 ELSE 1.0 END * CASE WHEN contains(path, 'docs/') THEN 0.9 ELSE 1.0 END, 6)::DOUBLE AS factor FROM {files}")(lambda get: get("files").select("file_id", F.round(responsibility("how to deploy"), 6).alias("factor")))


@Q.plan("G9_semantic_rerank")
def semantic_rerank(get):
    points, files = get("embeddings"), get("files")
    best = vector.nearest(points, points.where("vec_id = 4"), 50).join(files, F.col("vec_id") == F.col("file_id"))
    query = F.lit("where is deploy implemented")
    score = F.col("score") * ranking.path_multiplier(F.col("path"), code_intent(query), ranking.CODE_FACTORS_SEMANTIC, True) * ranking.overlap_multiplier(query, F.col("path"), F.col("content"), 0.04) * responsibility("where is deploy")
    return best.select("file_id", F.round(score, 5).alias("score")).orderBy(F.desc("score"), "file_id").limit(10)


@Q.plan("G3_semantic_facade", "SELECT vec_id, score FROM (SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 9) ORDER BY score DESC, vec_id LIMIT 20")
def semantic_facade(get):
    points = get("embeddings")
    return vector.nearest(points, points.where("vec_id = 9"), 20).select("vec_id", "score")


@Q.plan("G17_hashed_vectors")
def hashed(get):
    return get("symbols").select("symbol_id", api.hashed_vector(F.translate("name", "_", " "), 16).alias("v"))


@Q.plan("G18_indexed_vectors", "SELECT file_id, len(tokens_of(content))::DOUBLE AS mass FROM {files}")
def indexed(get):
    """Vectors of every file; the mass of a vector is its number of tokens."""
    vectors = get("files").select("file_id", api.hashed_vector(F.col("content"), 16).alias("v"))
    return vectors.select("file_id", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("mass"))


@Q.plan("H10_pair_scorer")
def pair_scores(get):
    rerank = api.pair_scorer(lambda texts: [float(len(set(t.split()))) for t in texts])
    return rerank(get("files")).select("file_id", "rerank_score")


@Q.plan("H13_fallback_reranker", "SELECT file_id, size AS score FROM {files}")
def fallback(get):
    registry = api.Registry()
    registry.register("broken", lambda f: f.select("no_such_column"))
    registry.register("best_first", api.STRATEGIES.entries["best_first"])
    return registry.run(["broken", "best_first"], get("files").select("file_id", F.col("size").alias("score")))


for _key, _entry in (("U9_aggregation_strategy", "first_per_file"),):
    Q.plan(_key, "SELECT file_id, line, score FROM (SELECT file_id, line_start AS line, symbol_id AS score, row_number() OVER (PARTITION BY file_id ORDER BY symbol_id DESC, line_start) AS k FROM {symbols}) WHERE k = 1")(
        lambda get: api.AGGREGATORS.run([_entry], get("symbols").select("file_id", F.col("line_start").alias("line"), F.col("symbol_id").alias("score")))
    )


@Q.plan("U10_search_strategy", "SELECT file_id, size AS score FROM {files}")
def strategy(get):
    return api.STRATEGIES.run(["best_first"], get("files").select("file_id", F.col("size").alias("score")))


Q.sql("L1_graph_build", "SELECT 'f' || cast(r.file_id AS string) AS src, 's' || cast(r.symbol_id AS string) AS dst, CASE r.reference_kind WHEN 'A' THEN 'calls' WHEN 'R' THEN 'imports' ELSE 'references' END AS kind, count(*) AS n FROM {refs} r GROUP BY r.file_id, r.symbol_id, r.reference_kind")

QUERIES, ORACLES = Q.queries, Q.oracles
