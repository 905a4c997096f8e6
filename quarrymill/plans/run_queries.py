"""Whole runs: hybrid search with a lost branch, the call graph, the smart score, typed metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import ranking
from quarrymill.operators import callgraph, fusion, hybrid, metadata, vector
from quarrymill.operators.index import stored
from quarrymill.session import stage

from .bindings import Queries
from .search_queries import LISTS_SQL, WEIGHTS

Q = Queries()

# -- hybrid ------------------------------------------------------------------------------------

FINISHED = """m AS (SELECT file_id, path, round(score * CASE WHEN regexp_matches(path, '[.](py|go)$') THEN 1.2 WHEN regexp_matches(path, '[.](md|txt)$') THEN 0.5 ELSE 0.8 END, 8)::DOUBLE AS score, best_branch, n_branches FROM fused JOIN {files} f ON f.file_id = fused.doc_id)
SELECT file_id, path, score, best_branch, n_branches FROM m ORDER BY score DESC, file_id LIMIT 20"""


def branches(get):
    docs, points = get("documents"), get("embeddings")
    index = stored(docs, "doc_id", ("text",))
    broken = F.udf(lambda x: x // 0, "bigint")
    return {
        "bm25": hybrid.Branch(lambda: index.top("the from", 50).withColumnRenamed("key", "doc_id"), [F.asc("score"), F.asc("doc_id")], WEIGHTS["bm25"]),
        "semantic": hybrid.Branch(lambda: points.select(broken("vec_id").alias("doc_id")), [F.asc("doc_id")], WEIGHTS["semantic"]),
        "fuzzy": hybrid.Branch(lambda: docs.select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], WEIGHTS["fuzzy"]),
    }


def finish(get):
    def shape(rows):
        joined = rows.join(get("files").select("file_id", "path"), F.col("doc_id") == F.col("file_id"))
        return joined.select("file_id", "doc_id", "path", F.round(F.col("score") * ranking.extension_multiplier(F.col("path")), 8).alias("score"), "best_branch", "n_branches")

    return shape


@Q.plan("H2_hybrid_partial", f"WITH {LISTS_SQL}, fused AS (SELECT doc_id, round(sum(weight::DOUBLE / (60 + rank + 1)), 8) AS score, arg_min(branch, [rank, pos]) AS best_branch, count(DISTINCT branch) AS n_branches FROM u WHERE branch <> 'semantic' GROUP BY doc_id), {FINISHED}")
def hybrid_partial(get):
    """A run whose semantic branch fails in its tasks: the others are fused, weighted by path, cut and cached-free."""
    answer = hybrid.search(get("documents").sparkSession, "the from", branches(get), "doc_id", finish=finish(get))
    assert answer.branches["semantic"] == ("failed", 0), answer.branches
    return answer.rows.drop("doc_id")


@Q.plan("H2_hybrid_run", f"WITH {LISTS_SQL}, fused AS (SELECT doc_id, round(sum(weight::DOUBLE / (60 + rank + 1)), 8) AS score, arg_min(branch, [rank, pos]) AS best_branch, count(DISTINCT branch) AS n_branches FROM u GROUP BY doc_id), {FINISHED}")
def hybrid_run(get):
    """All branches answer; the second run comes from the cache with the same rows."""
    points, spark = get("embeddings"), get("documents").sparkSession
    every = branches(get) | {"semantic": hybrid.Branch(lambda: vector.nearest(points, points.where("vec_id = 0"), 50).select(F.col("vec_id").alias("doc_id"), "score"), [F.desc("score"), F.asc("doc_id")], WEIGHTS["semantic"])}
    where = {"files": sorted(points.inputFiles())}
    hybrid.search(spark, "the from", every, "doc_id", finish=finish(get), settings=where, ttl=600)
    answer = hybrid.search(spark, "the from", every, "doc_id", finish=finish(get), settings=where, ttl=600)
    assert answer.from_cache and all(s == "ok" for s, _ in answer.branches.values()), answer.branches
    return answer.rows.drop("doc_id")


# -- the call graph ----------------------------------------------------------------------------

REFS = "(SELECT row_number() OVER () AS ref_id, l_partkey % 997 AS file_id, (l_orderkey + l_linenumber * 7) % 70 AS line, l_partkey AS symbol_id, l_returnflag AS kind FROM lineitem)"
CALLED = f"c AS (SELECT r.*, arg_max(s.symbol_id, [s.line_start, -s.line_end, -s.symbol_id]) AS caller FROM {REFS} r JOIN {{symbols}} s ON s.file_id = r.file_id AND r.line BETWEEN s.line_start AND s.line_end GROUP BY ALL), e AS (SELECT caller AS src, symbol_id AS dst, kind, count(*) AS n FROM c GROUP BY ALL)"


def graph_of(get):
    refs = get("lineitem").select(
        (F.col("l_partkey") % 997).alias("file_id"),
        ((F.col("l_orderkey") + F.col("l_linenumber") * 7) % 70).alias("line"), F.col("l_partkey").alias("symbol_id"), F.col("l_returnflag").alias("kind"),
    )
    return callgraph.call_edges(callgraph.callers(refs, get("symbols").select("symbol_id", "file_id", "line_start", "line_end")))


@Q.plan("L1_call_graph", f"WITH {CALLED} SELECT * FROM e")
def call_graph(get):
    return graph_of(get)


ROUND = "r{i} AS (SELECT node, sum(rank) AS rank FROM (SELECT w.dst AS node, sum(r.rank * w.share) * 0.85 AS rank FROM r{j} r JOIN w ON w.src = r.node GROUP BY w.dst UNION ALL SELECT node, (1 - (SELECT coalesce(sum(r.rank * w.share), 0) * 0.85 FROM r{j} r JOIN w ON w.src = r.node)) / (SELECT count(*) FROM s) FROM s) GROUP BY node)"
SELECTED = f"""{CALLED}, t AS (SELECT src, sum(n) AS total FROM e GROUP BY src), w AS (SELECT e.src, dst, sum(n) / any_value(total) AS share FROM e JOIN t ON t.src = e.src GROUP BY e.src, dst),
s AS (SELECT symbol_id AS node FROM {{symbols}} WHERE symbol_id <= 3), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM s) AS rank FROM s), {', '.join(ROUND.format(i=i + 1, j=i) for i in range(4))},
b AS (SELECT node, round(rank, 9) AS rank FROM r4 ORDER BY round(rank, 9) DESC, node LIMIT 40)"""


@Q.plan("L6_ranked_context", f"WITH {SELECTED} SELECT node, round(rank, 7) AS rank FROM b")
def ranked_context(get):
    """Forty symbols around three by rank of random walks that return to them."""
    nodes, _ = callgraph.select_context(stage(graph_of(get), "calls"), get("symbols").where("symbol_id <= 3").select(F.col("symbol_id").alias("node")), 40, rounds=4)
    return nodes.select("node", F.round("rank", 7).alias("rank"))


@Q.plan("L8_context_edges", f"WITH {SELECTED} SELECT e.* FROM e WHERE src IN (SELECT node FROM b) AND dst IN (SELECT node FROM b)")
def context_edges(get):
    _, inside = callgraph.select_context(stage(graph_of(get), "calls"), get("symbols").where("symbol_id <= 3").select(F.col("symbol_id").alias("node")), 40, rounds=4)
    return inside


# -- ranking -----------------------------------------------------------------------------------

RESULTS = """(SELECT l_partkey AS symbol, l_suppkey AS file, (l_orderkey % 40)::INT AS line, CASE WHEN l_quantity > 45 THEN NULL WHEN l_returnflag = 'A' THEN l_quantity / 3 WHEN l_returnflag = 'N' THEN l_discount * 10 + 0.05 ELSE l_quantity / 20 END AS score,
 CASE l_returnflag WHEN 'A' THEN 'bm25' WHEN 'N' THEN 'semantic' ELSE 'other' END AS source, repeat('word ', (l_quantity::INT % 30)) || CASE WHEN l_linenumber % 2 = 0 THEN chr(10) ELSE '' END AS snippet, l_orderkey * 10 + l_linenumber AS result_id FROM {lineitem})"""


@Q.plan("H18_smart_score", f"""WITH g AS (SELECT symbol, count(*) AS size, least(count(DISTINCT file), 2) AS files, max(line) - min(line) AS span, bool_or(length(snippet) < 100 AND NOT contains(snippet, chr(10))) AS short,
  arg_min({{{{'s': score, 'k': source}}}}, result_id) AS f FROM {RESULTS} GROUP BY symbol),
n AS (SELECT *, CASE WHEN f.s IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, f.s / CASE f.k WHEN 'bm25' THEN 15.0 WHEN 'semantic' THEN 1.0 ELSE CASE WHEN f.s > 1.5 THEN 15.0 ELSE 1.0 END END)) END AS rel FROM g)
SELECT symbol, size, files::INT AS files, round(least(1.0, (rel * 0.4 + least(1.0, least(1.0, size / 3) + CASE WHEN size > 1 THEN 0.1 ELSE 0 END) * 0.3 + least(1.0, size / 5) * CASE WHEN files > 1 THEN 1.2 ELSE 1.0 END * 0.2 + 0.5 * 0.1)
  * CASE WHEN size > 1 THEN 1.1 ELSE 1.0 END * CASE WHEN size > 1 AND files = 1 AND span <= 5 THEN 1.1 WHEN size > 1 AND files = 1 AND span <= 10 THEN 1.05 ELSE 1.0 END * CASE WHEN short THEN 1.05 ELSE 1.0 END
  * CASE WHEN f.k = 'bm25' AND f.s > 10 THEN 1.05 ELSE 1.0 END * CASE WHEN f.k = 'semantic' AND rel > 0.9 THEN 1.03 ELSE 1.0 END)::DOUBLE, 6) AS score FROM n""".replace("{{", "{").replace("}}", "}"))
def smart_score(get):
    """Groups of results by symbol: every term and boost of the score."""
    item = get("lineitem")
    flag, quantity = F.col("l_returnflag"), F.col("l_quantity")
    score = F.when(quantity > 45, None).when(flag == "A", quantity / 3).when(flag == "N", F.col("l_discount") * 10 + 0.05).otherwise(quantity / 20)
    results = item.select(
        F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("file"), (F.col("l_orderkey") % 40).cast("int").alias("line"), score.alias("score"),
        F.when(flag == "A", "bm25").when(flag == "N", "semantic").otherwise("other").alias("source"),
        F.concat(F.repeat(F.lit("word "), quantity.cast("int") % 30), F.when(F.col("l_linenumber") % 2 == 0, "\n").otherwise("")).alias("snippet"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("result_id"),
    )
    return fusion.smart_score(results, "symbol", [F.col("result_id")])


# -- metadata ----------------------------------------------------------------------------------

#: Envelopes made of the events' own properties: malformed and mistyped ones among them.
ENVELOPES = """(SELECT user_id, CASE event_id % 7 WHEN 0 THEN 'no json ' || props WHEN 1 THEN '[' || event_id || ']' WHEN 2 THEN '{"version": "x' || event_id || '", "fields": ' || props || '}'
  ELSE '{"version": ' || (event_id % 50) || ', "type": "' || event_type || '", "fields": {"k": ' || CASE WHEN event_id % 5 = 0 THEN '"text"' WHEN event_id % 5 = 1 THEN 'null' ELSE (event_id % 90)::VARCHAR END || ', "note": "' || event_type || event_id || '"}}' END AS raw FROM {events})"""


def envelopes(get):
    e, i = get("events"), F.col("event_id")
    k = F.when(i % 5 == 0, '"text"').when(i % 5 == 1, "null").otherwise((i % 90).cast("string"))
    full = F.concat(F.lit('{"version": '), i % 50, F.lit(', "type": "'), "event_type", F.lit('", "fields": {"k": '), k, F.lit(', "note": "'), "event_type", i, F.lit('"}}'))
    raw = F.when(i % 7 == 0, F.concat(F.lit("no json "), "props")).when(i % 7 == 1, F.concat(F.lit("["), i, F.lit("]"))).when(i % 7 == 2, F.concat(F.lit('{"version": "x'), i, F.lit('", "fields": '), "props", F.lit("}"))).otherwise(full)
    return e.select("user_id", raw.alias("raw"))


@Q.plan("O3_envelope_merge", f"""WITH r AS (SELECT user_id, raw, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM {ENVELOPES}),
p AS (SELECT user_id, raw, coalesce(TRY_CAST(j->>'$.version' AS INT), 0) AS version, j->>'$.type' AS type, TRY_CAST(j->>'$.fields.k' AS INT) AS k, j->>'$.fields.note' AS note FROM r)
SELECT user_id, max(version)::INT AS version, arg_max_null(type, [lpad(version::VARCHAR, 9, '0'), raw]) AS type, arg_max(k, [lpad(version::VARCHAR, 9, '0'), raw]) FILTER (WHERE k IS NOT NULL) AS k,
  arg_max(note, [lpad(version::VARCHAR, 9, '0'), raw]) FILTER (WHERE note IS NOT NULL) AS note, count(*) AS records FROM p GROUP BY user_id""")
def envelope_merge(get):
    return metadata.merge(envelopes(get), "user_id", "raw", {"k": "int", "note": "string"})


@Q.plan("B4_variant_predicate", "SELECT event_id, (props::JSON->>'$.k')::INT AS k FROM {events} WHERE json_valid(props) AND TRY_CAST(props::JSON->>'$.k' AS INT) > 5")
def variant_predicate(get):
    value = metadata.typed(metadata.parsed(F.col("props")), "$.k", "int")
    return get("events").select("event_id", value.alias("k")).where("k > 5")


QUERIES, ORACLES = Q.queries, Q.oracles
