"""Queries of routing, typed chunking, evaluation runs and table steps."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions import text
from quarrymill.operators import chunking, evaluation, order, prose, routing, typed_chunks  # noqa: F401  typed_chunks registers its chunkers
from quarrymill.sources import code

from .bindings import Queries
from .lexical_queries import ASKED_SQL, asked
from .text_queries import RANKED, STOP, STOP_SQL, judged, ranked

Q = Queries()

# -- sentences, phrases, typed chunks ----------------------------------------------------------


@Q.plan("N3_sentence_split")
def sentence_split(get):
    """Sentences of every document, those with code spans, brackets and blank lines included; checked in tests."""
    return prose.table(get("documents"), lambda t: [(len(chunking.sentences(t)),)], "sentences long")


@Q.plan("N38_key_phrases", f"""WITH s AS (SELECT doc_id, unnest(string_split(lower(text), '.')) AS s FROM documents), d AS (SELECT doc_id, regexp_extract_all(s, '[a-z]+') AS w FROM s),
g AS (SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM d, unnest([2, 3]) AS k(n), unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(i) WHERE len(list_filter(w[i:i + n - 1], lambda x: list_contains({STOP_SQL}, x))) <= n // 2),
c AS (SELECT doc_id, phrase, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) > 1)
SELECT doc_id, phrase, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, phrase) AS k FROM c) WHERE k <= 10""")
def phrases(get):
    """Two and three words inside a sentence that come more than once, half of them stop words at most; counted row by row."""
    stop = frozenset(STOP)

    def best(t: str):
        found: dict = {}
        for sentence in t.lower().split("."):
            w = code.re.findall("[a-z]+", sentence)
            for n in (2, 3):
                for i in range(len(w) - n + 1):
                    if sum(x in stop for x in w[i : i + n]) <= n // 2:
                        phrase = " ".join(w[i : i + n])
                        found[phrase] = found.get(phrase, 0) + 1
        return sorted(((p, n) for p, n in found.items() if n > 1), key=lambda x: (-x[1], x[0]))[:10]

    return prose.table(get("documents"), best, "phrase string, n long")


PARTS_SQL = "SELECT doc_id, (i - 1)::INT AS chunk_index, content FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS content FROM (SELECT doc_id, list_filter(list_transform(p, lambda x: trim('{mark}' || x, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') AS p FROM (SELECT doc_id, string_split(chr(10) || t, chr(10) || '{mark}')[2:] AS p FROM {source})))"
MARKED = "(SELECT doc_id, 'intro' || chr(10) || '{mark}' || replace(regexp_replace(text, '[^A-Za-z.\\n ]', '', 'g'), chr(10), chr(10) || '{mark}') AS t FROM documents)"


def marked_texts(get, mark: str):
    """Documents with every line made an opening of the wanted kind, after a line that is none."""
    bare = F.replace(F.regexp_replace("text", "[^A-Za-z.\n ]", ""), F.lit("\n"), F.lit(f"\n{mark}"))
    return get("documents").select("doc_id", F.concat(F.lit(f"intro\n{mark}"), bare).alias("text"))


for _key, _mark, _kind in (("N21_api_chunks", "GET /item ", "api"), ("N21_tutorial_chunks", "Step 1: ", "tutorial")):
    _sql = PARTS_SQL.replace("{source}", MARKED).replace("{mark}", _mark)
    Q.plan(_key, _sql)(lambda get, mark=_mark, kind=_kind: chunking.chunk(marked_texts(get, mark), f"{kind}_whole"))
chunking.register("api_whole", lambda t: typed_chunks.by_endpoint(t, 1 << 40))
chunking.register("tutorial_whole", lambda t: typed_chunks.by_step(t, 1 << 40))


@Q.plan("N21_readme_chunks")
def readme_chunks(get):
    docs = get("documents").select("doc_id", F.concat(F.lit("# Project\n## Usage\n"), F.replace("text", F.lit("\n"), F.lit("\n### Part\n"))).alias("text"))
    return chunking.chunk(docs, "readme")


NEAR = "list_sort(list_filter(list_distinct(list_concat({}, {})), lambda w: length(w) > 2 AND NOT list_contains(" + STOP_SQL + ", w) AND w NOT IN ('paper', 'water')))[:10]"


@Q.plan("N41_related_terms", "SELECT doc_id, array_to_string(" + NEAR.format("list_concat(regexp_extract_all(t, '([a-z0-9_]+)[ \\n\\t]+paper', 1), regexp_extract_all(t, 'paper[ \\n\\t]+([a-z0-9_]+)', 1))", "list_concat(regexp_extract_all(t, '([a-z0-9_]+)[ \\n\\t]+water', 1), regexp_extract_all(t, 'water[ \\n\\t]+([a-z0-9_]+)', 1))") + ", ' ') AS terms FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def related(get):
    """Words beside a keyword in each text, the first ten in order."""
    words = []
    for k in ("paper", "water"):
        words += [F.regexp_extract_all(F.lower("text"), F.lit(rf"([a-z0-9_]+)[ \n\t]+{k}"), 1), F.regexp_extract_all(F.lower("text"), F.lit(rf"{k}[ \n\t]+([a-z0-9_]+)"), 1)]
    kept = F.filter(F.array_distinct(F.concat(*words)), lambda w: (F.length(w) > 2) & ~w.isin(*STOP, "paper", "water"))
    return get("documents").select("doc_id", F.array_join(F.slice(F.array_sort(kept), 1, 10), " ").alias("terms"))


@Q.plan("N27_front_matter", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'lang=' || lang || ';source=' || source WHEN 1 THEN 'lang=' || lang ELSE '' END AS fields, md5(CASE WHEN doc_id % 3 = 2 THEN '---' || chr(10) || text ELSE text END) AS body FROM documents")
def front_matter(get):
    """YAML and TOML heads as maps, and the text without them; a head that is not closed is text."""
    n = F.col("doc_id") % 3
    yaml = F.concat(F.lit("---\nlang: "), "lang", F.lit("\nsource: '"), "source", F.lit("'\n---\n"), "text")
    toml = F.concat(F.lit('+++\nlang = "'), "lang", F.lit('"\n+++\n'), "text")
    docs = get("documents").select("doc_id", F.when(n == 0, yaml).when(n == 1, toml).otherwise(F.concat(F.lit("---\n"), "text")).alias("t"))
    head = F.regexp_extract("t", r"^(---\n(?:[^\n]*\n)*?---\n|\+\+\+\n(?:[^\n]*\n)*?\+\+\+\n)", 1)
    closed = (head != "") & ~head.rlike(r"(?s)^---\n(?![\w-]+:)")
    pairs = F.filter(F.transform(F.split(head, "\n"), lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+)\s*[:=]", 1).alias("k"), F.btrim(F.regexp_extract(x, r"^[\w-]+\s*[:=]\s*(.*)$", 1), F.lit("\"'")).alias("v"))), lambda p: p["k"] != "")
    fields = F.when(closed, F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat_ws("=", p["k"], p["v"])), ";")).otherwise("")
    return docs.select("doc_id", fields.alias("fields"), F.md5(F.when(closed, F.substr("t", F.length(head) + 1)).otherwise(F.col("t"))).alias("body"))


# -- routing -----------------------------------------------------------------------------------

_REPLACED = ", ".join(f"('{t}', {i}, {j}, '{r}')" for i, (t, rs) in enumerate(routing.EXPANSIONS.items()) for j, r in enumerate(rs))


@Q.plan("K7_document_expansion", f"""WITH q AS (SELECT query_id, query, lower(query) AS l, string_split(trim(regexp_replace(lower(query), '\\s+', ' ', 'g')), ' ') AS ws FROM {ASKED_SQL}),
r(term, i, j, related) AS (VALUES {_REPLACED}),
v AS (SELECT query_id, query AS variant, -1 AS i, 0 AS k, 0 AS j FROM q UNION ALL SELECT query_id, replace(l, term, related), i, 0, j FROM q, r WHERE contains(l, term) AND replace(l, term, related) <> l
  UNION ALL SELECT query_id, query || ' ' || related, i, 1, j FROM q, r WHERE contains(l, term) AND j < 2
  UNION ALL SELECT query_id, replace(form, '%s', array_to_string(list_filter(ws, lambda w: w NOT IN ('how','to','the','a','an','is','are','what','where','when','')) [1:2], ' ')), 99, 0, j
    FROM q, (VALUES ('README %s', 0), ('%s documentation', 1), ('%s docs', 2), ('%s guide', 3)) AS f(form, j)
    WHERE list_contains(['how','what','where','when','why','can','is','does','should'], ws[1]) AND len(list_filter(ws, lambda w: w NOT IN ('how','to','the','a','an','is','are','what','where','when',''))) > 0),
d AS (SELECT query_id, variant, min([i, k, j]) AS place FROM v GROUP BY 1, 2)
SELECT query_id, variant, n::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM d) WHERE n <= 10""")
def document_expansion(get):
    first = F.get(F.split(F.btrim(F.regexp_replace(F.lower("query"), r"\s+", " ")), " "), F.lit(0))
    rows = asked(get).select("query_id", F.posexplode(routing.expansions(F.col("query"), F.coalesce(first.isin("how", "what", "where", "when", "why", "can", "is", "does", "should"), F.lit(False)))).alias("n", "variant"))
    return rows.select("query_id", "variant", (F.col("n") + 1).alias("n"))


BRANCH_ASKED = "(SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'how does artifact push/pull delta resolution work' WHEN 1 THEN 'Delta artifact push and pull' ELSE 'artifact push pull DELTA resolution' END AS query, CASE o_orderkey % 4 WHEN 0 THEN 'bm25' WHEN 1 THEN 'semantic' WHEN 2 THEN 'fuzzy' END AS branch FROM orders)"


@Q.plan("K8_branch_expansion", f"SELECT id, CASE WHEN id % 3 <> 1 AND branch IN ('bm25', 'semantic') THEN query || ' resolve resolver delta chain base_commit target_commit full artifact' ELSE query END AS asked FROM {BRANCH_ASKED}")
def branch_expansion(get):
    n = F.col("o_orderkey")
    query = F.when(n % 3 == 0, "how does artifact push/pull delta resolution work").when(n % 3 == 1, "Delta artifact push and pull").otherwise("artifact push pull DELTA resolution")
    branch = F.when(n % 4 == 0, "bm25").when(n % 4 == 1, "semantic").when(n % 4 == 2, "fuzzy")
    return get("orders").select(n.alias("id"), routing.branch_query(query, F.coalesce(branch, F.lit(""))).alias("asked"))


@Q.plan("K13_parser_routing", """WITH f AS (SELECT file_id, regexp_extract(path, '[.]([^.]*)$', 1) AS x FROM {files}),
c AS (SELECT file_id, CASE x WHEN 'py' THEN ['python', 'fast_python'] WHEN 'go' THEN ['golang'] ELSE ['plain'] END AS ps, x FROM f), p AS (SELECT file_id, x, unnest(ps) AS parser FROM c),
s AS (SELECT file_id, parser, round(least(1.0, CASE parser WHEN 'python' THEN 0.3 + 0.5 + 0.2 + 0.05 - 0.1 WHEN 'fast_python' THEN 0.3 + 0.5 + 0.0 + 0.19 WHEN 'golang' THEN 0.3 + 0.3 * 0 + 0.5 * 1 + 0.2 ELSE 0.3 - 0.019 END), 6)::DOUBLE AS confidence FROM p)
SELECT file_id, parser, confidence, row_number() OVER (PARTITION BY file_id ORDER BY confidence DESC, parser)::INT AS choice FROM s""")
def parser_routing(get):
    """Two parsers share Python, one of them used heavily; one speaks Go; one takes what no other does."""
    spark = get("region").sparkSession
    parsers = spark.createDataFrame([("python", "python", ["py"], 1.5, 900), ("fast_python", "python", [], 0.1, 5), ("golang", "go", ["go"], 0.0, 0), ("plain", None, [], 0.0, 95)], "parser string, language string, suffixes array<string>, seconds double, uses long")
    suffix = F.regexp_extract("path", r"\.([^.]*)$", 1)
    files = get("files").select("file_id", suffix.alias("suffix"), F.when(suffix == "py", "python").when(suffix == "go", "go").alias("language"))
    return routing.route_files(files, parsers)


@Q.plan("K12_search_mode", f"""SELECT query_id, CASE query_id % 5 WHEN 0 THEN 'semantic' WHEN 1 THEN 'bm25' WHEN 2 THEN 'fuzzy' ELSE CASE WHEN regexp_matches(query, '\\b(class|def|function|method|symbol)\\s+[A-Za-z_][A-Za-z0-9_]*') OR regexp_matches(query, '\\b[A-Z][A-Za-z0-9_]{{2,}}\\b') OR regexp_matches(query, '\\b[a-z]+_[a-z0-9_]+\\b') THEN 'classic' ELSE 'hybrid' END END AS mode FROM {ASKED_SQL}""")
def search_mode(get):
    """A named mode is taken; auto goes to the symbol search for precise queries and to the hybrid search for others."""
    n = F.col("query_id") % 5
    named = F.when(n == 0, "semantic").when(n == 1, "bm25").when(n == 2, "fuzzy").otherwise("auto")
    return asked(get).select("query_id", F.when(named != "auto", named).when(text.symbol_precise(F.col("query")), "classic").otherwise("hybrid").alias("mode"))


@Q.plan("U8_language_extractors", "SELECT language, kind, count(*) AS n FROM (SELECT unnest([['javascript','function'],['javascript','class'],['typescript','interface'],['typescript','class'],['java','class'],['java','interface'],['rust','function'],['rust','struct'],['rust','trait'],['kotlin','function'],['kotlin','class'],['swift','function'],['swift','class'],['csharp','class'],['csharp','interface'],['dart','class'],['go','function'],['go','type'],['c','struct']]) AS p, p[1] AS language, p[2] AS kind FROM nation) GROUP BY 1, 2")
def extractors(get):
    """A source of each language, with a definition of each kind for every nation, through the registry of extractors."""
    forms = {
        "javascript": "export async function {n}() {{\nclass {n} {{", "typescript": "export interface {n} {{\nexport class {n} {{", "java": "public class {n} {{\npublic interface {n} {{", "rust": "pub fn {n}() {{\nstruct {n};\npub trait {n} {{",
        "kotlin": "fun {n}() = 1\nclass {n}", "swift": "func {n}() {{\nstruct {n} {{", "csharp": "class {n} {{\ninterface {n} {{", "dart": "class {n} {{", "go": "func (r *R) {n}() {{\ntype {n} struct {{", "c": "struct {n} {{",
    }
    kinds = get("region").sparkSession.createDataFrame([(k, v.replace("{{", "{").replace("{n}", "%n%")) for k, v in forms.items()], "language string, form string")
    rows = get("nation").crossJoin(F.broadcast(kinds)).select("n_nationkey", "language", F.replace("form", F.lit("%n%"), F.concat(F.lit("N"), "n_nationkey")).alias("source"))  # ten forms
    found = code.extract(rows.withColumn("key", F.concat_ws(":", "language", "n_nationkey")), "key", "language", "source")
    return found.groupBy(F.substring_index("key", ":", 1).alias("language"), "kind").agg(F.count(F.lit(1)).alias("n"))


@Q.plan("M12_language_scope", "SELECT repo, file_id FROM (SELECT repo, file_id, row_number() OVER (PARTITION BY repo ORDER BY hits DESC, file_id) AS k FROM (SELECT repo, file_id, len(list_filter(tokens_of(content), lambda x: x = 'de')) AS hits FROM {files} WHERE language IN ('en', 'fr') AND repo IN (SELECT repo FROM {files} GROUP BY repo ORDER BY count(*) DESC, repo LIMIT 3)) WHERE hits > 0) WHERE k <= 5")
def language_scope(get):
    """A search over the three largest repositories in two languages, five results of each."""
    from quarrymill.operators import lexical

    files = get("files")
    scope = files.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "repo").limit(3)
    hits = files.where(F.col("language").isin("en", "fr")).join(F.broadcast(scope), "repo", "left_semi").select("repo", "file_id", F.size(F.filter(lexical.tokens(F.col("content")), lambda t: t == "de")).alias("hits"))
    best = hits.where("hits > 0").withColumn("k", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("hits"), "file_id")))
    return best.where("k <= 5").select("repo", "file_id")


# -- statistics and evaluation -----------------------------------------------------------------

BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, float("inf"))


@Q.plan("D23_histogram_buckets", "SELECT event_type, bound, count(*) FILTER (WHERE value <= bound) AS n, round(sum(value), 4) AS total, count(value) AS observed FROM events, (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 'inf'::DOUBLE])::DOUBLE AS bound) GROUP BY event_type, bound")
def histogram(get):
    """Cumulative counts by bucket, with sum and count, of every metric in one pass."""
    one = get("events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count("value").alias("observed"), *[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)])
    return one.select("event_type", "total", "observed", F.explode(F.array(*[F.struct(F.lit(b).alias("bound"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BOUNDS)])).alias("x")).select("event_type", "x.*", "total", "observed")


RUN = f"(SELECT 'by_length' AS arm, query_id, doc_id, rank FROM {RANKED} UNION ALL SELECT 'by_id', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) FROM {RANKED} WHERE query_id <> 'es')"


def arms(get):
    """Two arms' rankings; one of them fails on a query."""
    by_length = ranked(get).withColumn("arm", F.lit("by_length"))
    by_id = ranked(get).where("query_id <> 'es'").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("doc_id"))).withColumn("arm", F.lit("by_id"))
    return by_length.unionByName(by_id)


METRICS_SQL = f"""WITH q AS (SELECT DISTINCT arm, depth, query_id FROM (VALUES ('by_length'), ('by_id')) AS a(arm), (VALUES (10), (50)) AS d(depth), (SELECT DISTINCT query_id FROM {RANKED})),
j AS (SELECT lang AS query_id, doc_id, quality AS rel FROM documents JOIN labels USING (doc_id)),
h AS (SELECT q.arm, q.depth, q.query_id, r.rank, j.rel FROM q JOIN {RUN} r ON r.arm = q.arm AND r.query_id = q.query_id AND r.rank <= q.depth LEFT JOIN j ON j.query_id = r.query_id AND j.doc_id = r.doc_id),
p AS (SELECT arm, depth, query_id, count(*) AS n, sum((2.0::DOUBLE ** coalesce(rel, 0) - 1) / log2(rank + 1)) AS dcg, count(*) FILTER (WHERE rel = 1) AS hit, min(rank) FILTER (WHERE rel = 1) AS first FROM h GROUP BY 1, 2, 3),
i AS (SELECT query_id, depth, sum((2.0::DOUBLE ** rel - 1) / log2(b + 1)) AS best FROM (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS b FROM j), (VALUES (10), (50)) AS d(depth) WHERE b <= depth GROUP BY 1, 2),
r AS (SELECT query_id, count(*) FILTER (WHERE rel = 1) AS relevant FROM j GROUP BY 1),
e AS (SELECT q.arm, q.depth, q.query_id, p.n IS NULL AS failed, coalesce(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 0) AS ndcg, coalesce(CASE WHEN relevant > 0 THEN hit / relevant ELSE 0 END, 0) AS recall, coalesce(1.0::DOUBLE / first, 0) AS rr
  FROM q LEFT JOIN p ON p.arm = q.arm AND p.depth = q.depth AND p.query_id = q.query_id LEFT JOIN i ON i.query_id = q.query_id AND i.depth = q.depth LEFT JOIN r ON r.query_id = q.query_id)"""


def measured(get):
    """One row for each arm, depth and query."""
    run, rel = arms(get), judged(get)
    queries = ranked(get).select("query_id").distinct()
    spark = queries.sparkSession
    grid = queries.crossJoin(F.broadcast(spark.createDataFrame([(a, d) for a in ("by_length", "by_id") for d in (10, 50)], "arm string, depth int")))  # arms by depths
    return evaluation.measure(grid, run, rel)


@Q.plan("R5_arm_depth_runs", METRICS_SQL + " SELECT arm, depth, query_id, failed, round(ndcg, 6)::DOUBLE AS ndcg, round(recall, 6)::DOUBLE AS recall, round(rr, 6)::DOUBLE AS rr FROM e")
def arm_depth(get):
    return measured(get)


@Q.plan("D25_metric_means", METRICS_SQL + " SELECT arm, depth, count(*) AS queries, round(avg(ndcg), 5)::DOUBLE AS ndcg, round(avg(recall), 5)::DOUBLE AS recall, round(avg(rr), 5)::DOUBLE AS mrr, round(avg(failed::INT), 5)::DOUBLE AS error_rate FROM e GROUP BY arm, depth")
def metric_means(get):
    means = [F.round(F.avg(c), 5).alias(n) for c, n in (("ndcg", "ndcg"), ("recall", "recall"), ("rr", "mrr"))]
    return measured(get).groupBy("arm", "depth").agg(F.count(F.lit(1)).alias("queries"), *means, F.round(F.avg(F.col("failed").cast("int")), 5).alias("error_rate"))


@Q.plan("R7_query_split", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR quality = 0 THEN 'holdout' ELSE 'main' END AS split FROM labels")
def query_split(get):
    """A query is held out if its id is listed or its own flag says so."""
    labels = get("labels")
    listed = labels.where("doc_id % 7 = 0").select("doc_id")
    return evaluation.split(labels.withColumn("holdout", F.col("quality") == 0), listed, "doc_id")


HISTORY = "(SELECT event_type || '_' || user_id % 5 AS metric, CAST(floor(event_id / 500) AS BIGINT) AS run, value FROM events)"


@Q.plan("R9_regressions", f"""WITH p AS (SELECT metric, run, quantile_cont(value, 0.95) AS p95 FROM {HISTORY} GROUP BY 1, 2), l AS (SELECT *, lag(p95) OVER (PARTITION BY metric ORDER BY run) AS before, row_number() OVER (PARTITION BY metric ORDER BY run DESC) AS k FROM p)
SELECT metric, round(100 * (p95 - before) / before, 4) AS change, CASE WHEN 100 * (p95 - before) / before > 10 THEN 'regression' ELSE 'improvement' END AS verdict FROM l WHERE k = 1 AND before > 0 AND abs(100 * (p95 - before) / before) > 10""")
def regressions(get):
    rows = get("events").select(F.concat_ws("_", "event_type", F.col("user_id") % 5).alias("metric"), F.floor(F.col("event_id") / 500).alias("run"), "value")
    return evaluation.regressions(rows, 10.0)


# -- decisions and tables ----------------------------------------------------------------------


@Q.plan("D26_best_chunk", """WITH c AS (SELECT doc_id AS file_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
s AS (SELECT *, list_sum(list_transform(['from', 'que', 'water'], lambda w: contains(lower(content), w)::INT)) AS hits FROM c)
SELECT file_id, 'words' AS query, line::INT AS line FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY hits DESC, line) AS k FROM s) WHERE k = 1
UNION ALL SELECT file_id, 'none', line::INT FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY length(content) DESC, line) AS k FROM c) WHERE k = 1""")
def best_chunk(get):
    """The chunk that holds most of a query's words, the first of equals; without words the longest one. By aggregates, without a sort."""
    chunks = get("documents").where("text IS NOT NULL").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("at", "content")).withColumn("line", F.col("at") + 1)
    hits = sum(F.contains(F.lower("content"), F.lit(w)).cast("int") for w in ("from", "que", "water"))
    best = chunks.groupBy("file_id").agg(F.min_by("line", F.struct(-hits, F.col("line"))).alias("words"), F.min_by("line", F.struct(-F.length("content"), F.col("line"))).alias("none"))
    return best.select("file_id", F.stack(F.lit(2), F.lit("words"), F.col("words"), F.lit("none"), F.col("none")).alias("query", "line"))


@Q.plan("P11_full_or_incremental", """SELECT c.repo, CASE WHEN n >= 0.5 * tracked OR n > 1000 OR (core AND n > 500) THEN 'full' ELSE 'incremental' END AS mode
FROM (SELECT user_id % 20 AS repo, count(*) AS n, bool_or(event_type = 'error') AS core FROM events GROUP BY 1) c JOIN (SELECT file_id % 20 AS repo, count(*) * 20 AS tracked FROM {files} GROUP BY 1) t ON t.repo = c.repo""")
def full_or_incremental(get):
    """Full when half of the tracked files changed, over a thousand did, or over five hundred with a core folder among them."""
    changed = get("changes").groupBy((F.col("user_id") % 20).alias("repo")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("action") == "deleted").alias("core"))
    tracked = get("files").groupBy((F.col("file_id") % 20).alias("repo")).agg((F.count(F.lit(1)) * 20).alias("tracked"))
    rule = (F.col("n") >= 0.5 * F.col("tracked")) | (F.col("n") > 1000) | (F.col("core") & (F.col("n") > 500))
    return changed.join(tracked, "repo").select("repo", F.when(rule, "full").otherwise("incremental").alias("mode"))


@Q.plan("T5_full_or_delta", "SELECT o_orderkey, CASE WHEN o_totalprice * 4000 <= 500 * 1024 * 1024 THEN 'full' WHEN o_custkey % 3 = 0 THEN 'full' ELSE 'delta' END AS strategy, CASE WHEN o_totalprice * 4000 <= 500 * 1024 * 1024 THEN 'small' WHEN o_custkey % 3 = 0 THEN 'no base' ELSE 'large, with a base' END AS reason FROM orders")
def full_or_delta(get):
    """A small artifact goes whole, a large one as a delta if there is one to build on."""
    size, base = F.col("o_totalprice") * 4000, F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey"))
    small = size <= 500 * 1024 * 1024
    return get("orders").select("o_orderkey", F.when(small | base.isNull(), "full").otherwise("delta").alias("strategy"), F.when(small, "small").when(base.isNull(), "no base").otherwise("large, with a base").alias("reason"))


@Q.plan("T7_retention", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k, max(o_orderdate) OVER () AS now FROM orders) WHERE k > 3 AND epoch_us(o_orderdate) < epoch_us(now) - 365 * 86400000000")
def retention(get):
    """What a prune takes: older than a year before the last release, and not among the latest three of its line."""
    orders = get("orders")
    last = orders.agg(F.max("o_orderdate").alias("now"))  # one row
    latest = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    rows = orders.withColumn("k", F.row_number().over(latest)).join(F.broadcast(last))
    return rows.where((F.col("k") > 3) & (F.unix_micros(F.col("o_orderdate").cast("timestamp")) < F.unix_micros(F.col("now").cast("timestamp")) - 365 * 86_400_000_000)).select("o_custkey", "o_orderkey")


@Q.plan("P10_apply_order", "SELECT event_id, row_number() OVER (ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, event_id) AS position FROM events")
def apply_order(get):
    """Deletions first, then renames, then the rest, each in order of arrival."""
    rows = get("changes").select("event_id", F.when(F.col("action") == "deleted", 0).when(F.col("action") == "renamed", 1).otherwise(2).alias("stage"))
    return order.positions(rows, [F.col("stage"), F.col("event_id")]).select("event_id", "position")


@Q.plan("I11_priority_sort", "SELECT r.repo_id, s.symbol_id, row_number() OVER (ORDER BY priority DESC, r.repo_id, s.symbol_id) AS position FROM {repositories} r JOIN {repo_symbols} s ON s.repo_id = r.repo_id")
def priority_sort(get):
    rows = get("repositories").select("repo_id", "priority").join(get("repo_symbols").select("repo_id", "symbol_id"), "repo_id")
    return order.positions(rows, [F.desc("priority"), F.col("repo_id"), F.col("symbol_id")]).select("repo_id", "symbol_id", "position")


@Q.plan("T1_delta_manifest", """WITH a AS (SELECT path, hash FROM {files} WHERE file_id % 10 <> 0), b AS (SELECT path, CASE WHEN file_id % 7 = 0 THEN 'x' || hash ELSE hash END AS hash FROM {files} WHERE file_id % 9 <> 0),
o AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'add' WHEN b.path IS NULL THEN 'delete' ELSE 'modify' END AS operation, b.hash FROM a FULL JOIN b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash)
SELECT path, operation, hash, row_number() OVER (ORDER BY (operation = 'delete')::INT, path, hash) AS position FROM o""")
def delta_manifest(get):
    """What turns one snapshot of an artifact into the next: files to carry first, then files to delete, each by path."""
    files = get("files")
    a = files.where("file_id % 10 <> 0").select("path", F.col("hash").alias("was"))
    b = files.where("file_id % 9 <> 0").select("path", F.when(F.col("file_id") % 7 == 0, F.concat(F.lit("x"), "hash")).otherwise(F.col("hash")).alias("hash"))
    changed = a.join(b, "path", "full").where("NOT was <=> hash").withColumn("operation", F.when(F.col("was").isNull(), "add").when(F.col("hash").isNull(), "delete").otherwise("modify"))
    return order.positions(changed, [(F.col("operation") == "delete").cast("int").asc(), F.col("path").asc(), F.col("hash").asc()]).select("path", "operation", "hash", "position")


@Q.plan("Q9_delete_cascade", "SELECT 'symbols' AS t, count(*) AS n FROM {symbols} WHERE file_id NOT IN (SELECT file_id FROM {files} WHERE is_deleted) UNION ALL SELECT 'refs', count(*) FROM {refs} WHERE file_id NOT IN (SELECT file_id FROM {files} WHERE is_deleted) UNION ALL SELECT 'chunks', count(*) FROM {chunks} WHERE file_id NOT IN (SELECT file_id FROM {files} WHERE is_deleted) UNION ALL SELECT 'points', count(*) FROM {points} p WHERE p.chunk_id NOT IN (SELECT chunk_id FROM {chunks} WHERE file_id IN (SELECT file_id FROM {files} WHERE is_deleted)) UNION ALL SELECT 'files', count(*) FROM {files} WHERE NOT is_deleted")
def delete_cascade(get):
    """Rows that are left in each table when deleted files go, with what hangs on them; anti joins, no null-aware ones."""
    gone = get("files").where("is_deleted").select("file_id")
    chunks_gone = get("chunks").join(gone, "file_id", "left_semi").select("chunk_id").distinct()
    left = {n: get(n).join(gone, "file_id", "left_anti") for n in ("symbols", "refs", "chunks")} | {"points": get("points").join(chunks_gone, "chunk_id", "left_anti"), "files": get("files").where("NOT is_deleted")}
    counts = [f.agg(F.lit(n).alias("t"), F.count(F.lit(1)).alias("n")) for n, f in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


POINTS_AND_PARTS = "SELECT chunk_id AS owner, collection, false AS is_part FROM {points} UNION ALL SELECT chunk_id, collection, true FROM {points} WHERE collection = 'c2'"


@Q.plan("Q15_invalidation_plan", f"SELECT s.chunk_hash, CASE WHEN s.profile = 'A' THEN 'preserve' ELSE 'delete' END AS decision, p.collection, p.is_part FROM {{summaries}} s JOIN ({POINTS_AND_PARTS}) p ON p.owner = s.chunk_hash")
def invalidation_plan(get):
    """Vectors of a summarised chunk and of its parts, and what becomes of them: one equi-join on the chunk that a part belongs to."""
    points = get("points").select("chunk_id", "collection")
    every = points.unionByName(points.where("collection = 'c2'").withColumn("chunk_id", F.concat("chunk_id", F.lit(":part:1"))))
    owned = every.select("collection", F.regexp_replace("chunk_id", ":part:1$", "").alias("chunk_hash"), F.endswith("chunk_id", F.lit(":part:1")).alias("is_part"))
    return get("summaries").join(owned, "chunk_hash").select("chunk_hash", F.when(F.col("profile") == "A", "preserve").otherwise("delete").alias("decision"), "collection", "is_part")


QUERIES, ORACLES = Q.queries, Q.oracles
