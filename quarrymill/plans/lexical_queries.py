"""Lexical search over files: BM25 and its query forms, term statistics, routing of queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions import ranking, text
from quarrymill.operators import lexical
from quarrymill.operators.index import fresh, stored

from .bindings import Queries

Q = Queries()
TERMS = ["the", "that", "une"]


def bm25_sql(docs: str, terms: list[str], key: str = "file_id", content: str | tuple = "content", where: str = "true", weights: tuple = ()) -> str:
    """The closed form of the ranking, for checks: relation w (key, score, matched)."""
    quoted = ", ".join(f"'{t}'" for t in terms)
    columns = (content,) if isinstance(content, str) else content
    lists = ", ".join(f"coalesce(tokens_of({c}), []) AS t{i}" for i, c in enumerate(columns))
    length = " + ".join(f"len(t{i})" for i in range(len(columns)))
    tf = " + ".join(f"{(weights or (1,) * len(columns))[i]}::DOUBLE * len(list_filter(t{i}, lambda x: x = term))" for i in range(len(columns)))
    return f"""d AS (SELECT {key}, {lists} FROM {docs} WHERE {where}),
s AS (SELECT count(*) AS n, avg({length}) AS avgdl FROM d),
p AS (SELECT {key}, {length} AS dl, term, {tf} AS tf FROM d, (SELECT unnest([{quoted}]) AS term)),
h AS (SELECT * FROM p WHERE tf > 0),
f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
w AS (SELECT {key}, -sum(CASE WHEN ln((n-df+0.5)/(df+0.5)) > 0 THEN ln((n-df+0.5)/(df+0.5)) ELSE 1e-6 END
        * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS matched FROM h JOIN f USING (term), s GROUP BY {key})"""


def vocabulary_sql(rows: str, columns: tuple = ("text",)) -> str:
    """(term, docs, hits) of a relation with the column k and text columns."""
    parts = " UNION ALL ".join(f"SELECT k, unnest(tokens_of({c})) AS term FROM {rows}" for c in columns)
    return f"SELECT term, count(DISTINCT k) AS docs, count(*)::BIGINT AS hits FROM ({parts}) GROUP BY term"


def documents_index(get):
    return stored(get("documents"), "doc_id", ("text",))


@Q.plan("E2_bm25_match", f"WITH {bm25_sql('documents', TERMS, 'doc_id', 'text')} SELECT doc_id, round(score, 6) AS score FROM w ORDER BY round(score, 6), doc_id LIMIT 20")
def bm25_match(get):
    return documents_index(get).top(TERMS, 20).withColumnRenamed("key", "doc_id")


@Q.plan("E1_postings", f"WITH r AS (SELECT doc_id AS k, text FROM documents) {vocabulary_sql('r')}")
def postings(get):
    return documents_index(get).vocabulary()


@Q.plan("E4_content_bm25", f"""WITH {bm25_sql('{files}', ['der', 'und', 'fur'], where="language = 'de'")}, t AS (SELECT * FROM w ORDER BY round(score, 6), file_id LIMIT 30)
SELECT file_id, path, round(round(score, 6) + CASE WHEN regexp_matches(path, '(^|/)__init__[.]py$') THEN 1.2 ELSE 0 END, 6) AS score FROM t JOIN {{files}} USING (file_id)""")
def content_bm25(get):
    files = get("files").where("language = 'de'")
    best = stored(files, "file_id", ("content",)).top("der und für", 30).withColumnRenamed("key", "file_id")
    out = best.join(files.select("file_id", "path"), "file_id")
    return out.select("file_id", "path", F.round(F.col("score") + ranking.path_adjustment(F.lit("der und"), F.col("path"), ranking.CONTENT_INDEX), 6).alias("score"))


#: Columns of the symbol table's index, and their weights in a query that prefers names.
SYMBOL_COLUMNS = ("name", "kind", "signature", "documentation", "filepath")
SYMBOL_ROWS = "(SELECT s.symbol_id, s.name, s.kind, s.signature, f.language AS documentation, f.path AS filepath FROM {symbols} s LEFT JOIN {files} f ON f.file_id = s.file_id)"


def symbol_index(get):
    rows = get("symbols").join(get("files").select("file_id", F.col("language").alias("documentation"), F.col("path").alias("filepath")), "file_id", "left")
    return stored(rows.select("symbol_id", *SYMBOL_COLUMNS), "symbol_id", SYMBOL_COLUMNS)


@Q.plan("E5_symbol_bm25", f"""WITH {bm25_sql(SYMBOL_ROWS, ['red', 'economy', 'src'], 'symbol_id', SYMBOL_COLUMNS, weights=(3, 1, 1, 1, 0.5))}
SELECT symbol_id, regexp_replace(name, '(red)', '<b>\\1</b>', 'g') AS marked, round(score, 6) AS score FROM w JOIN {{symbols}} USING (symbol_id) ORDER BY round(score, 6), symbol_id LIMIT 15""")
def symbol_bm25(get):
    best = symbol_index(get).top("red economy src", 15, (3, 1, 1, 1, 0.5)).withColumnRenamed("key", "symbol_id")
    return best.join(get("symbols"), "symbol_id").select("symbol_id", F.regexp_replace("name", "(red)", "<b>$1</b>").alias("marked"), "score")


#: Parts of a page as text columns: title, whole markup, headings, links.
PAGE_COLUMNS = ("title", "html", "sections", "metadata")
PAGE_ROWS = """(SELECT page_id, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, array_to_string(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)', 1), ' ') AS sections,
  array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), ' ') AS metadata FROM pages)"""


@Q.plan("E6_document_bm25", f"WITH {bm25_sql(PAGE_ROWS, ['example', 'nav', 'title'], 'page_id', PAGE_COLUMNS, weights=(2, 1, 1.5, 1))} SELECT page_id, round(score, 6) AS score FROM w ORDER BY round(score, 6), page_id LIMIT 10")
def document_bm25(get):
    every = lambda pattern: F.array_join(F.regexp_extract_all("html", F.lit(pattern), 1), " ")
    rows = get("pages").select("page_id", "html", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), every("<h[1-6][^>]*>([^<]*)").alias("sections"), every('href="([^"]*)"').alias("metadata"))
    return stored(rows, "page_id", PAGE_COLUMNS).top("example nav title", 10, (2, 1, 1.5, 1)).withColumnRenamed("key", "page_id")


@Q.plan("E7_symbol_definition_search", """WITH c AS (SELECT 'red_gear' AS cand, 0 AS o UNION ALL SELECT 'Bolt_1', 1),
h AS (SELECT s.symbol_id, s.name, CASE WHEN lower(s.name) = lower(cand) THEN 0.0 ELSE 0.25 END AS score, o FROM {symbols} s, c WHERE contains(lower(s.name), lower(cand))),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score, o, symbol_id) AS k FROM h)
SELECT symbol_id, name, cast(score AS DOUBLE) AS score FROM r WHERE k = 1""")
def symbol_definitions(get):
    query = F.lit("class red_gear Bolt_1")
    wanted = get("symbols").select("symbol_id", "name", F.posexplode(text.symbol_candidates(query)).alias("o", "cand"))
    hits = wanted.where(F.contains(F.lower("name"), F.lower("cand"))).withColumn("score", F.when(F.lower("name") == F.lower("cand"), 0.0).otherwise(0.25))
    first = F.row_number().over(W.partitionBy("name").orderBy("score", "o", "symbol_id"))
    return hits.withColumn("k", first).where("k = 1").select("symbol_id", "name", "score")


LISTED = "(SELECT doc_id, tokens_of(text) AS t FROM documents)"


@Q.plan("E8_phrase_query", f"SELECT doc_id FROM (SELECT doc_id, array_to_string(t, ' ') AS s FROM {LISTED}) WHERE contains(' ' || s || ' ', ' of the ')")
def phrase(get):
    return documents_index(get).match('"of the"').select(F.col("key").alias("doc_id"))


@Q.plan("E9_near_query", f"""WITH x AS (SELECT doc_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM {LISTED})
SELECT DISTINCT doc_id, 'two' AS query FROM (SELECT a.doc_id FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.term = 'with' AND b.term = 'from' AND abs(a.pos - b.pos) <= 6)
UNION ALL SELECT DISTINCT a.doc_id, 'three' FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.term = 'with' AND b.term = 'from' JOIN x c ON a.doc_id = c.doc_id AND c.term = 'only'
WHERE greatest(a.pos, b.pos, c.pos) - least(a.pos, b.pos, c.pos) <= 22""")
def near_query(get):
    index = documents_index(get)
    two = index.match("NEAR(with from, 5)").select(F.col("key").alias("doc_id"), F.lit("two").alias("query"))
    return two.unionByName(index.match("NEAR(with from only, 20)").select(F.col("key").alias("doc_id"), F.lit("three").alias("query")))


@Q.plan("E10_prefix_query", f"""WITH x AS (SELECT doc_id, list_filter(t, lambda x: starts_with(x, 'thin')) AS h FROM {LISTED})
SELECT doc_id, len(h) AS hits, len(list_distinct(h)) AS terms FROM x WHERE len(h) > 0""")
def prefix(get):
    hit = documents_index(get).postings(prefix="thin").groupBy(F.col("key").alias("doc_id"))
    return hit.agg(F.sum("tf").alias("hits"), F.count_distinct("term").alias("terms"))


@Q.plan("E11_boolean_query", f"""SELECT doc_id, list_has_all(t, ['the', 'with', 'from']) AS is_and, list_has_any(t, ['only', 'from']) AND NOT list_contains(t, 'the') AS is_not FROM {LISTED} WHERE list_has_any(t, ['the', 'with', 'from', 'only'])""")
def boolean(get):
    index = documents_index(get)
    every = index.match("the OR with OR from OR only").withColumnRenamed("key", "doc_id")
    both = index.match("the AND with from").select(F.col("key").alias("doc_id"), F.lit(True).alias("a"))
    less = index.match("(only OR from) NOT the").select(F.col("key").alias("doc_id"), F.lit(True).alias("n"))
    out = every.join(both, "doc_id", "left").join(less, "doc_id", "left")
    return out.select("doc_id", F.coalesce("a", F.lit(False)).alias("is_and"), F.coalesce("n", F.lit(False)).alias("is_not"))


def snippet_sql(key: str, text: str, source: str, term: str, width: int, opening: str, closing: str) -> str:
    bare = "regexp_replace(lower(x), '[^a-z0-9_]', '', 'g')"
    return f"""WITH x AS (SELECT {key}, string_split_regex(trim({text}), '\\s+') AS ws FROM {source} WHERE regexp_matches({text}, '(?i)\\b{term}\\b')),
a AS (SELECT *, greatest(coalesce(list_position(list_transform(ws, lambda x: {bare}), '{term}'), 1) - 1 - {width // 2}, 0) AS s FROM x)
SELECT {key}, CASE WHEN s > 0 THEN '...' ELSE '' END || array_to_string(list_transform(ws[s + 1:s + {width}], lambda x: CASE WHEN {bare} = '{term}' THEN '{opening}' || x || '{closing}' ELSE x END), ' ')
  || CASE WHEN len(ws) > s + {width} THEN '...' ELSE '' END AS snippet FROM a"""


@Q.plan("E12_snippet", snippet_sql("doc_id", "text", "documents", "from", 32, "<mark>", "</mark>"))
def snippets(get):
    hit = get("documents").where(F.col("text").rlike(r"(?i)\bfrom\b"))
    return hit.select("doc_id", lexical.snippet(F.col("text"), ["from"], 32).alias("snippet"))


@Q.plan("E13_highlight", "SELECT doc_id, md5(regexp_replace(text, '(?i)\\b(from|only)\\b', '<b>\\1</b>', 'g')) AS marked FROM documents")
def highlights(get):
    return get("documents").select("doc_id", F.md5(lexical.highlight(F.col("text"), ["from", "only"], "<b>", "</b>")).alias("marked"))


@Q.plan("E14_symbol_text_search", f"""WITH {bm25_sql("(SELECT symbol_id, name, signature AS documentation FROM {symbols})", ['widget', 'gear'], 'symbol_id', ('name', 'documentation'))}
SELECT symbol_id, round(score, 6) AS score FROM w ORDER BY round(score, 6), symbol_id LIMIT 20""")
def symbol_text(get):
    rows = get("symbols").select("symbol_id", "name", F.col("signature").alias("documentation"))
    return stored(rows, "symbol_id", ("name", "documentation")).top("widget gear", 20).withColumnRenamed("key", "symbol_id")


ADJUST_SQL = """(CASE WHEN regexp_matches(p, '(^|/)__init__[.]py$') THEN {0} ELSE 0 END + CASE WHEN regexp_matches(p, '(^|/)tests/') THEN {1} ELSE 0 END
  - least(len(list_filter(['class', 'my_file', 'src3'], lambda t: contains(st, t))), 3) * {2}
  - least(len(list_filter(['class', 'my_file', 'src3'], lambda t: list_contains(regexp_extract_all(p, '[a-z0-9_]+'), t))), 4) * {3})"""
PATHS_SQL = "(SELECT file_id, lower(path) AS p, regexp_extract(lower(path), '([^/]+)[.][^./]*$', 1) AS st FROM {files})"


@Q.plan("E15_code_rank_adjustment", f"SELECT file_id, round({ADJUST_SQL.format(0.45, 0.7, 0.22, 0.08)}, 6)::DOUBLE AS adjustment FROM {PATHS_SQL}")
def code_adjustment(get):
    return get("files").select("file_id", F.round(ranking.path_adjustment(F.lit("class my_file src3"), F.col("path"), ranking.CODE_INDEX), 6).alias("adjustment"))


@Q.plan("E16_content_path_adjustment", f"SELECT file_id, round({ADJUST_SQL.format(1.2, 1.4, 0.45, 0.16)}, 6)::DOUBLE AS adjustment FROM {PATHS_SQL}")
def content_adjustment(get):
    return get("files").select("file_id", F.round(ranking.path_adjustment(F.lit("class my_file src3"), F.col("path"), ranking.CONTENT_INDEX), 6).alias("adjustment"))


@Q.plan("E17_path_penalty", """SELECT file_id, CASE WHEN contains(p, 'htmlcov/') OR contains(p, 'docs/benchmarks/') THEN 10.0 WHEN contains(p, '/tests/') THEN 0.3
  WHEN contains(p, 'makefile') THEN 0.5 WHEN ends_with(p, '.json') THEN 0.5 ELSE 0.0 END::DOUBLE AS penalty FROM (SELECT file_id, lower(CASE WHEN file_id % 9 = 0 THEN '/x/' || path ELSE path END) AS p FROM {files})""")
def penalty(get):
    path = F.when(F.col("file_id") % 9 == 0, F.concat(F.lit("/x/"), "path")).otherwise(F.col("path"))
    return get("files").select("file_id", ranking.path_penalty(path).alias("penalty"))


@Q.plan("E18_filename_boost", """SELECT file_id, round(-0.6 * least(len(list_intersect(['file', 'init', '42', '7'], list_distinct(regexp_extract_all(regexp_extract(lower(path), '([^/]+)[.][^./]*$', 1), '[a-z0-9]+')))), 3), 6)::DOUBLE AS boost FROM {files}""")
def boost(get):
    return get("files").select("file_id", F.round(ranking.stem_boost(F.lit("file init 42 7"), F.col("path")), 6).alias("boost"))


@Q.plan("E19_lexical_search", f"""WITH {bm25_sql('{files}', ['from', 'only', 'with'])}, t AS (SELECT *, matched = 3 AS strict FROM w),
r AS (SELECT file_id, strict, row_number() OVER (ORDER BY strict DESC, round(score, 6), file_id) AS k, score FROM t),
c AS (SELECT * FROM r WHERE k <= 80),
o AS (SELECT file_id, strict, path, language, content, round(round(score, 6) + CASE WHEN ends_with(path, '.json') THEN 0.5 ELSE 0.0 END, 6) AS score FROM c JOIN {{files}} USING (file_id) ORDER BY score, file_id LIMIT 10),
n AS (SELECT *, string_split(content, chr(10)) AS ls FROM o)
SELECT file_id, strict, path, language, score, list_position(list_transform(ls, lambda x: list_has_any(tokens_of(x), ['from', 'only', 'with'])), true)::INT AS line,
  substr(trim(ls[list_position(list_transform(ls, lambda x: list_has_any(tokens_of(x), ['from', 'only', 'with'])), true)]), 1, 200) AS matched_line FROM n""")
def lexical_search(get):
    """Strict matches first, filled up with any-term matches; oversampled, adjusted by path, cut to ten, with the first line that holds a term."""
    terms = ["from", "only", "with"]
    files = get("files")
    scored = stored(files, "file_id", ("content",)).scores(terms)
    found = scored.select(F.col("key").alias("file_id"), F.round("score", 6).alias("score"), (F.col("matched") == len(terms)).alias("strict"))
    best = found.orderBy(F.col("strict").desc(), "score", "file_id").limit(80)
    adjusted = F.broadcast(best).join(files.select("file_id", "path", "language", "content"), "file_id").withColumn("score", F.round(F.col("score") + ranking.path_penalty(F.col("path")), 6))
    top = adjusted.orderBy("score", "file_id").limit(10)
    numbered = F.transform(F.split("content", "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.substring(F.btrim(x), 1, 200).alias("text"), F.arrays_overlap(lexical.tokens(x), F.array(*map(F.lit, terms))).alias("hit")))
    first = F.get(F.filter(numbered, lambda x: x["hit"]), F.lit(0))
    return top.withColumn("f", first).select("file_id", "strict", "path", "language", "score", F.col("f.line").alias("line"), F.col("f.text").alias("matched_line"))


@Q.plan("E25_documentation_search", """WITH v AS (SELECT unnest(['readme', 'guide', 'docs']) AS kind, unnest(['the of', 'que de', 'der die']) AS q),
h AS (SELECT v.kind, f.file_id, f.path, len(list_filter(tokens_of(content), lambda t: list_contains(string_split(q, ' '), t))) AS hits FROM v, {files} f
      WHERE starts_with(f.path, 'docs/') OR ends_with(f.path, '.md')),
b AS (SELECT file_id, path, max(hits) AS hits FROM h WHERE hits > 0 GROUP BY 1, 2) SELECT file_id, path, hits FROM b ORDER BY hits DESC, file_id LIMIT 20""")
def documentation(get):
    variants = {"readme": ["the", "of"], "guide": ["que", "de"], "docs": ["der", "die"]}
    docs = get("files").where(F.col("path").rlike(r"^docs/|\.md$")).select("file_id", "path", lexical.tokens(F.col("content")).alias("t"))
    hits = F.greatest(*[count_of(q) for q in variants.values()])
    return docs.select("file_id", "path", hits.cast("long").alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "file_id").limit(20)


def count_of(terms):
    return F.size(F.filter("t", lambda x: x.isin(terms)))


STATS = ["the", "que", "zu", "zzzz"]


@Q.plan("D9_term_statistics", """WITH d AS (SELECT tokens_of(text) AS t, length(text) AS c FROM documents), n AS (SELECT count(*) AS n, avg(c) AS a FROM d),
q AS (SELECT unnest(['the', 'que', 'zu', 'zzzz']) AS term), f AS (SELECT term, count(*) FILTER (WHERE list_contains(t, term)) AS df FROM q, d GROUP BY term)
SELECT term, df, n, round(CASE WHEN df > 0 THEN ln((n + 1) / (df + 1)) ELSE 0.0 END, 6) AS smooth_idf, round(CASE WHEN df > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 0.0 END, 6) AS okapi_idf,
  round(100.0 * df / n, 6) AS percent, round(a, 6) AS avg_chars FROM f, n""")
def term_stats(get):
    return lexical.term_statistics(get("documents"), "text", STATS)


@Q.plan("D11_document_frequency", "WITH x AS (SELECT DISTINCT doc_id, unnest(tokens_of(text)) AS term FROM documents) SELECT term, count(*) AS df FROM x GROUP BY term HAVING count(*) > 5")
def document_frequency(get):
    return documents_index(get).vocabulary().select("term", F.col("docs").alias("df")).where("df > 5")


@Q.plan("D12_bm25_all_scores", f"WITH {bm25_sql('documents', TERMS, 'doc_id', 'text')} SELECT doc_id, round(score, 5) + 0.0::DOUBLE AS score FROM w")
def bm25_all(get):
    return documents_index(get).scores(TERMS).select(F.col("key").alias("doc_id"), F.round("score", 5).alias("score"))


# -- a changing index --------------------------------------------------------------------------

FIELDS = ("filepath", "filename", "content", "language", "symbols", "imports", "comments")
BEFORE = "(SELECT file_id, CASE WHEN file_id % 4 = 2 THEN content || ' before' ELSE content END AS content FROM {files} WHERE file_id % 4 <> 1)"


FIELD_ROWS = r"""(SELECT *, regexp_extract(path, '[^/]+$') AS name,
  array_to_string(regexp_extract_all(content, '(?m)^[ \t]*(?:def|class|function|func|fn|struct|interface)[ \t]+(\w+)', 1), ' ') AS symbols,
  array_to_string(regexp_extract_all(content, '(?m)^[ \t]*(?:import|from|use|require|#include)[ \t]+([\w./<>"]+)', 1), ' ') AS imports,
  array_to_string(regexp_extract_all(content, '(?m)(?:^|[ \t])(?:#|//)[ \t]*([^\n]+)$', 1), ' ') AS comments FROM {files})"""


@Q.plan("E21_add_documents", f"""SELECT f.file_id, CASE WHEN b.file_id IS NULL THEN 'add' WHEN b.content IS NOT DISTINCT FROM f.content THEN 'skip' ELSE 'update' END AS decision,
  ({' + '.join(f'len(tokens_of(f.{c}))' for c in ('path', 'content', 'language', 'name', 'symbols', 'imports', 'comments'))})::BIGINT AS total
FROM {FIELD_ROWS} f LEFT JOIN {BEFORE} b ON b.file_id = f.file_id""")
def add_documents(get):
    """An index of an earlier state takes in the files of today: unchanged ones are skipped."""
    files = lexical.file_fields(get("files"))
    index = fresh(files, "file_id", FIELDS)
    earlier = files.where("file_id % 4 <> 1").withColumn("content", F.when(F.col("file_id") % 4 == 2, F.concat("content", F.lit(" before"))).otherwise(F.col("content")))
    index.add(earlier)
    decided = index.add(files)
    return decided.join(index.documents().select("key", "total"), "key").select(F.col("key").alias("file_id"), "decision", "total")


@Q.plan("E22_remove_document", f"WITH r AS (SELECT doc_id AS k, CASE WHEN doc_id % 10 = 0 THEN 'the document came back' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 10 = 0) {vocabulary_sql('r')}")
def remove_documents(get):
    """Documents leave the index, and some come back with another text."""
    docs = get("documents")
    index = fresh(docs, "doc_id", ("text",))
    index.add(docs)
    index.remove(docs.where("doc_id % 5 = 0").select("doc_id"))
    index.add(docs.where("doc_id % 10 = 0").withColumn("text", F.lit("the document came back")))
    return index.vocabulary()


def index_figures(index):
    head = index.head()
    row = index.vocabulary().agg(F.count(F.lit(1)).alias("terms"), F.sum("hits").alias("hits"))
    return row.select(F.lit(len(head["segments"])).cast("long").alias("segments"), F.lit(head["documents"]).cast("long").alias("documents"), F.lit(head["tokens"]).cast("long").alias("tokens"), "terms", "hits")


FIGURES = "SELECT 1::BIGINT AS segments, (SELECT count(*) FROM r) AS documents, (SELECT coalesce(sum(len(tokens_of(text))), 0) FROM r)::BIGINT AS tokens, count(*) AS terms, sum(hits)::BIGINT AS hits FROM v"


@Q.plan("E23_rebuild_live", f"WITH r AS (SELECT file_id AS k, content AS text FROM {{files}} WHERE NOT is_deleted), v AS ({vocabulary_sql('r')}) {FIGURES}")
def rebuild(get):
    files = get("files").where("NOT is_deleted")
    index = fresh(files, "file_id", ("content",))
    index.add(files)
    return index_figures(index)


@Q.plan("E24_compact", f"WITH r AS (SELECT doc_id AS k, text FROM documents WHERE doc_id % 7 <> 0), v AS ({vocabulary_sql('r')}) {FIGURES}")
def compact(get):
    """Three segments and their tombstones become one segment; the old files go."""
    docs = get("documents")
    index = fresh(docs, "doc_id", ("text",))
    for i in range(3):
        index.add(docs.where(F.col("doc_id") % 3 == i))
    index.remove(docs.where("doc_id % 7 = 0").select("doc_id"))
    index.optimize()
    index.vacuum()
    return index_figures(index)


# -- queries as rows ---------------------------------------------------------------------------

#: Queries to route, made from names in the data.
ASKED_SQL = """(SELECT p_partkey AS query_id, CASE p_partkey % 12 WHEN 0 THEN 'class ' || replace(p_name, ' ', '_') WHEN 1 THEN 'def ' || replace(p_name, ' ', '_') WHEN 2 THEN upper(replace(p_name, ' ', '_'))
  WHEN 3 THEN replace(p_name, ' ', '_') WHEN 4 THEN 'Red' || 'Widget' WHEN 5 THEN replace(p_name, ' ', '.') WHEN 6 THEN 'how to install ' || p_name WHEN 7 THEN 'const ' || replace(p_name, ' ', '_')
  WHEN 8 THEN 'where is ' || p_name || ' implemented in main.py' WHEN 9 THEN '  ' WHEN 10 THEN 'enum Kind of ' || p_name ELSE p_name || '; foo()' END AS query FROM {part})"""
KINDS = [("class", "class"), ("def", "function"), ("function", "function"), ("func", "function"), ("interface", "interface"), ("struct", "struct"), ("type", "type"), ("enum", "enum"), ("(?:const|var|let)", None)]
WHENS = "\n".join(f"WHEN regexp_matches(q, '(?i)^{w}\\s+([A-Za-z_][A-Za-z0-9_]*)') THEN ['symbol', regexp_extract(q, '(?i)^{w}\\s+([A-Za-z_][A-Za-z0-9_]*)', 1), {repr(k) if k else 'NULL'}]" for w, k in KINDS)


def asked(get):
    part = get("part")
    return part.sparkSession.sql("SELECT * FROM " + ASKED_SQL, part=part)


@Q.plan("K1_query_intent", f"""SELECT query_id, r[1] AS intent, r[2] AS name, r[3] AS kind FROM (SELECT query_id, CASE {WHENS}
WHEN regexp_matches(q, '^[A-Z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*$') THEN ['symbol', q, 'class'] WHEN regexp_matches(q, '^[A-Z][A-Z0-9_]{{2,}}$') THEN ['symbol', q, NULL]
WHEN regexp_matches(q, '^[a-z_][a-z0-9_]*$') AND contains(q, '_') AND length(q) > 3 THEN ['symbol', q, 'function']
WHEN regexp_matches(q, '^[A-Za-z_]\\w*\\.[A-Za-z_]\\w*$') THEN ['symbol', string_split(q, '.')[-1], NULL] ELSE ['lexical', q, NULL] END AS r FROM (SELECT query_id, trim(query) AS q FROM {ASKED_SQL}))""")
def intents(get):
    return asked(get).select("query_id", text.intent(F.col("query")).alias("r")).select("query_id", "r.*")


@Q.plan("K2_symbol_precise", rf"""SELECT query_id, regexp_matches(query, '\b(class|def|function|method|symbol)\s+[A-Za-z_][A-Za-z0-9_]*') OR regexp_matches(query, '\b[A-Z][A-Za-z0-9_]{{2,}}\b') OR regexp_matches(query, '\b[a-z]+_[a-z0-9_]+\b') AS precise FROM {ASKED_SQL}""")
def precise(get):
    return asked(get).select("query_id", text.symbol_precise(F.col("query")).alias("precise"))


@Q.plan("K3_query_terms", rf"""SELECT query_id, array_to_string(list_filter(regexp_extract_all(lower(regexp_replace(query, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9_]+'), lambda t: length(t) >= 3), ' ') AS terms FROM {ASKED_SQL}""")
def terms_of(get):
    return asked(get).select("query_id", F.array_join(text.query_terms(F.col("query")), " ").alias("terms"))


@Q.plan("K5_code_intent", rf"""SELECT query_id, regexp_matches(q, '\b(class|def|function|method|symbol|module|file|filepath)\b') OR regexp_matches(q, '\b(py|python|js|ts|typescript|javascript|treesitter|tree-sitter)\b')
 OR regexp_matches(q, '\b(where is|how does|how do|implemented|implementation|extract|validate)\b') OR regexp_matches(q, '\.[a-z0-9]{{1,6}}\b') AS code FROM (SELECT query_id, lower(query) AS q FROM {ASKED_SQL})""")
def code_queries(get):
    return asked(get).select("query_id", text.code_intent(F.col("query")).alias("code"))


#: Words that open a question.
QUESTION_WORDS = ("how", "what", "where", "when", "why", "can", "is", "does", "should")


@Q.plan("K6_document_query", f"SELECT query_id, list_contains(['how','what','where','when','why','can','is','does','should'], string_split(trim(lower(query)), ' ')[1]) AS is_document FROM {ASKED_SQL}")
def document_queries(get):
    return asked(get).select("query_id", F.coalesce(F.get(F.split(F.btrim(F.lower("query")), " "), F.lit(0)).isin(*QUESTION_WORDS), F.lit(False)).alias("is_document"))




@Q.plan("K9_keyword_expansion", f"""SELECT query_id, array_to_string(list_concat([query], list_filter(['main', 'install', 'index'], lambda k: NOT contains(lower(query), k))), ' ') AS expanded FROM {ASKED_SQL}""")
def keyword_expansion(get):
    extra = F.filter(F.array(*map(F.lit, ["main", "install", "index"])), lambda k: ~F.contains(F.lower("query"), k))
    return asked(get).select("query_id", F.array_join(F.concat(F.array("query"), extra), " ").alias("expanded"))


@Q.plan("K10_query_strategy", rf"""SELECT query_id, CASE WHEN regexp_matches(lower(query), 'how to|example|implement|usage') THEN 'semantic' WHEN regexp_matches(query, '[{{}}();]') THEN 'code' ELSE 'symbol' END AS strategy,
 regexp_matches(query, '\*\.\w+|\w+\.\w+') AS has_file FROM {ASKED_SQL}""")
def strategy(get):
    q = F.col("query")
    kind = F.when(F.lower(q).rlike("how to|example|implement|usage"), "semantic").when(q.rlike("[{}();]"), "code").otherwise("symbol")
    return asked(get).select("query_id", kind.alias("strategy"), q.rlike(r"\*\.\w+|\w+\.\w+").alias("has_file"))


@Q.plan("K11_documentation_file", r"SELECT file_id, regexp_matches(lower(path), '\.(md|rst|txt|adoc)$|(^|/)(docs?|documentation)/|readme|changelog|contributing|license') AS is_doc FROM {files}")
def documentation_files(get):
    return get("files").select("file_id", F.lower("path").rlike(r"\.(md|rst|txt|adoc)$|(^|/)(docs?|documentation)/|readme|changelog|contributing|license").alias("is_doc"))


QUERIES, ORACLES = Q.queries, Q.oracles
