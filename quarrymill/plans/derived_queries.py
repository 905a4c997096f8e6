"""State machines, provenance, dependencies and source records over facts that are derived from the given tables.

Facts are one SQL text that both engines read; the library's column rules decide on them, the checks decide by a CASE of their own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill import api
from quarrymill.operators import evaluation, graph, lexical, markers, states
from quarrymill.session import scratch
from quarrymill.sources import code, external

from .bindings import BASE, VIEWS, Queries

Q = Queries()
HEX = "repeat('{}', 40)"
MAIN, OLD = HEX.format("a"), HEX.format("b")


def facts(get, sql: str):
    """The rows of a facts text."""
    names = [n for n in [*VIEWS, *BASE] if "{" + n + "}" in sql]
    frames = {n: get(n) for n in names}
    return next(iter(frames.values())).sparkSession.sql(sql, **frames)


# -- states ------------------------------------------------------------------------------------

REGISTRY = f"""SELECT o_orderkey AS id, o_orderkey % 5 <> 0 AS git_managed, CASE WHEN o_orderkey % 11 <> 3 THEN CASE WHEN o_custkey % 6 = 0 THEN 'topic' ELSE 'main' END END AS live_branch,
 CASE WHEN o_orderkey % 13 <> 4 THEN CASE WHEN o_custkey % 7 = 0 THEN {OLD} ELSE {MAIN} END END AS live_commit, CASE WHEN o_custkey % 4 <> 1 THEN 'main' END AS branch,
 CASE o_orderkey % 9 WHEN 0 THEN 'short' WHEN 1 THEN NULL ELSE {MAIN} END AS "commit", CASE WHEN o_custkey % 8 <> 2 THEN 'main' END AS tracked,
 CASE o_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN {OLD} ELSE {MAIN} END AS indexed_commit,
 CASE o_orderkey % 17 WHEN 0 THEN 'index_building' WHEN 1 THEN 'partial_index_failure' WHEN 2 THEN 'index_publication_pending' WHEN 3 THEN 'old' END AS staleness,
 CASE WHEN o_orderkey % 19 = 5 THEN true WHEN o_orderkey % 19 <> 6 THEN false END AS indexing,
 CASE o_orderkey % 23 WHEN 0 THEN NULL WHEN 1 THEN 'index_locked' WHEN 2 THEN 'corrupt_sqlite' WHEN 3 THEN 'missing_schema' WHEN 4 THEN 'index_rebuilding' WHEN 5 THEN 'scheme_mismatch' WHEN 6 THEN 'index_empty' ELSE 'ok' END AS index_state FROM {{orders}}"""


def spark_text(sql: str) -> str:
    """Spark quotes names with back-ticks."""
    return sql.replace('"', "`")


@Q.plan("U16_readiness", f"""WITH r AS ({REGISTRY}), m AS (SELECT *, coalesce(git_managed AND regexp_matches("commit", '^[0-9a-fA-F]{{{{40}}}}$'), false) AS whole FROM r),
b AS (SELECT *, CASE WHEN whole THEN live_branch ELSE coalesce(branch, live_branch) END AS b, CASE WHEN whole THEN live_commit ELSE coalesce("commit", live_commit) END AS c FROM m)
SELECT id, CASE WHEN whole AND (live_branch IS NULL OR live_commit IS NULL) THEN 'unregistered_repository' WHEN indexing OR staleness = 'index_building' THEN 'index_building' WHEN tracked <> b THEN 'wrong_branch'
 WHEN index_state IS NULL THEN 'missing_index' WHEN index_state IN ('index_locked', 'corrupt_sqlite', 'missing_schema', 'index_rebuilding', 'scheme_mismatch') THEN index_state
 WHEN staleness IN ('index_publication_pending', 'partial_index_failure') THEN 'missing_provenance' WHEN index_state = 'index_empty' THEN 'index_empty'
 WHEN trim(coalesce(indexed_commit, '')) = '' THEN 'missing_provenance' WHEN c <> indexed_commit THEN 'stale_commit' ELSE 'ready' END AS state FROM b""".replace("{{{{40}}}}", "{40}").replace("{{40}}", "{40}"))
def readiness(get):
    """The state of a registered repository's index, for every order's facts."""
    return facts(get, spark_text(REGISTRY)).select("id", states.readiness().alias("state"))


SYNC = f"""SELECT o_orderkey AS id, o_orderkey % 29 <> 7 AS known, CASE o_orderkey % 13 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE {MAIN} END AS "commit", CASE WHEN o_custkey % 5 = 0 THEN 'topic' ELSE 'main' END AS branch,
 CASE WHEN o_custkey % 9 <> 3 THEN 'main' END AS tracked, CASE o_orderkey % 4 WHEN 0 THEN {MAIN} WHEN 1 THEN NULL ELSE {OLD} END AS indexed_commit, CASE WHEN o_custkey % 7 = 0 THEN true WHEN o_custkey % 7 <> 1 THEN false END AS force_full,
 o_orderkey % 6 = 0 AS artifacts_on, CASE WHEN o_orderkey % 5 = 0 THEN {MAIN} ELSE {OLD} END AS artifact_commit, o_orderkey % 17 <> 2 AS context_ok, CAST(floor(o_totalprice) % 1400 AS INT) AS changed, CAST(o_orderkey % 5000 AS INT) AS tracked_files FROM {{orders}}"""


@Q.plan("P14_sync_states", f"""WITH r AS ({SYNC}) SELECT id, CASE WHEN NOT known OR trim(coalesce("commit", '')) = '' THEN 'failed' WHEN branch <> tracked THEN 'wrong_branch' WHEN tracked IS NULL THEN 'up_to_date'
 WHEN "commit" = indexed_commit AND NOT coalesce(force_full, false) THEN 'up_to_date' WHEN artifacts_on AND NOT coalesce(force_full, false) AND artifact_commit = "commit" THEN 'downloaded' WHEN NOT context_ok THEN 'failed'
 WHEN coalesce(force_full, false) OR indexed_commit IS NULL THEN 'full' WHEN changed = 0 THEN 'up_to_date' WHEN changed > 1000 OR changed >= 0.5 * tracked_files THEN 'full' ELSE 'incremental' END AS action FROM r""")
def sync_states(get):
    """What a synchronisation does, for every order's facts."""
    return facts(get, spark_text(SYNC)).select("id", states.sync_action().alias("action"))


STAMPS = f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 12 <> 5 THEN {MAIN} END AS "commit", CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'yesterday' WHEN 2 THEN NULL
 ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T06:30:00' || CASE WHEN o_custkey % 2 = 0 THEN 'Z' ELSE '' END END AS stamp, o_custkey % 3 <> 0 AS ancestor FROM {{orders}}"""
NOW, MOST_DAYS = "1998-01-01 00:00:00", 900


@Q.plan("T6_freshness", f"""WITH r AS ({STAMPS}), a AS (SELECT *, TRY_CAST(rtrim(stamp, 'Z') AS TIMESTAMP) AS moment FROM r) SELECT id, CASE WHEN "commit" IS NULL OR trim(coalesce(stamp, '')) = '' OR moment IS NULL THEN 'invalid'
 WHEN NOT ancestor THEN 'stale_commit' WHEN epoch(TIMESTAMP '{NOW}') - epoch(moment) > {MOST_DAYS} * 86400 THEN 'stale_age' ELSE 'fresh' END AS verdict FROM a""")
def freshness(get):
    """Verdicts on artifacts that carry the orders' dates."""
    rows = facts(get, spark_text(STAMPS))
    return rows.select("id", states.freshness(F.col("commit"), F.col("stamp"), F.col("ancestor"), F.lit(NOW).cast("timestamp"), MOST_DAYS).alias("verdict"))


SCHEMES = f"SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 's4' END AS rebuild_target, CASE p_size % 3 WHEN 0 THEN 's4' WHEN 1 THEN 's3' END AS marker, CASE WHEN p_partkey % 5 = 0 THEN '{states.LEGACY_SCHEME}' ELSE 's4' END AS target, CAST(p_partkey % 4 AS INT) AS chunk_rows FROM {{part}}"


@Q.plan("Q16_scheme_guard", f"""WITH r AS ({SCHEMES}), s AS (SELECT id, CASE WHEN rebuild_target IS NOT NULL THEN 'rebuilding' WHEN marker = target THEN 'compatible' WHEN marker IS NOT NULL THEN 'mismatch' WHEN chunk_rows > 0 AND target = '{states.LEGACY_SCHEME}' THEN 'compatible_legacy'
 WHEN chunk_rows > 0 THEN 'missing_marker' ELSE 'empty' END AS state FROM r) SELECT id, state, state IN ('compatible', 'compatible_legacy', 'empty') AS readable FROM s""")
def scheme_guard(get):
    """Whether the chunk ids of an index are those of its target scheme, for every part's facts."""
    return facts(get, SCHEMES).select("id", states.chunk_scheme().alias("state")).withColumn("readable", states.readable(F.col("state")))


MANIFESTS = f"""SELECT s_suppkey * 1000 + p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'v0' ELSE 'v1' END AS version, CASE WHEN p_partkey % 9 = 0 OR p_partkey % 31 = 2 THEN NULL ELSE 'c' || (p_partkey % 3) END AS collection,
 CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN {OLD} ELSE {MAIN} END AS indexed_commit, CASE p_size % 8 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE 'corpus' END AS corpus_sha256, CASE WHEN p_partkey % 37 = 3 THEN '' ELSE p_brand END AS profile,
 'p' || (p_size % 4) AS provider, CAST(s_suppkey % 3 AS STRING) AS revision, 'set' || (p_partkey % 5) AS point_set, CASE WHEN s_suppkey % 4 = 0 THEN 'c0' END AS want_collection, {MAIN} AS want_indexed_commit,
 CASE WHEN p_size % 8 <> 0 THEN 'corpus' END AS want_corpus_sha256, CASE WHEN s_suppkey % 5 = 0 THEN 'Brand#1' END AS want_profile, CASE WHEN s_suppkey % 6 = 1 THEN 'p1' END AS want_provider, CASE WHEN s_suppkey % 8 = 1 THEN '1' END AS want_revision,
 CASE WHEN s_suppkey % 3 = 2 THEN 'set1' END AS want_point_set FROM {{part}} JOIN {{supplier}} ON p_partkey % 10 = s_suppkey % 10 AND s_suppkey < 60"""


@Q.plan("G16_collection_provenance", f"""WITH r AS ({MANIFESTS}) SELECT id, CASE WHEN version IS NULL AND collection IS NULL AND indexed_commit IS NULL THEN 'missing'
 WHEN version IS DISTINCT FROM 'v1' OR trim(coalesce(collection, '')) = '' OR trim(coalesce(indexed_commit, '')) = '' OR trim(coalesce(profile, '')) = '' OR trim(coalesce(revision, '')) = '' THEN 'tampered'
 WHEN indexed_commit <> want_indexed_commit OR corpus_sha256 <> want_corpus_sha256 THEN 'stale' WHEN corpus_sha256 IS NULL THEN 'corpus_unbound' WHEN want_collection IS NOT NULL AND collection <> want_collection THEN 'collection_mismatch'
 WHEN want_profile IS NOT NULL AND profile <> want_profile THEN 'profile_mismatch' WHEN (want_provider IS NOT NULL AND provider <> want_provider) OR (want_revision IS NOT NULL AND revision <> want_revision) THEN 'provider_mismatch'
 WHEN want_point_set IS NOT NULL AND point_set <> want_point_set THEN 'mixed_run' ELSE 'verified' END AS verdict FROM r""")
def provenance(get):
    """Whether a collection's manifest binds it to the corpus, for every pair of a part and its suppliers."""
    return facts(get, MANIFESTS).select("id", states.provenance().alias("verdict"))


CALLS = """SELECT event_id AS id, event_type <> 'signup' AS configured, user_id % 3 = 0 AS semantic, event_id % 4 = 0 AS skips_semantic, event_id % 13 = 0 AS raised, event_id % 7 = 1 AS fallback,
 CASE WHEN event_id % 11 = 2 THEN 'timeout' END AS last_error, CASE WHEN event_id % 6 <> 5 THEN value > 50 END AS reordered FROM {events}"""


@Q.plan("H14_rerank_outcomes", f"""WITH r AS ({CALLS}) SELECT id, CASE WHEN NOT configured THEN 'not_configured' WHEN semantic AND skips_semantic THEN 'skipped_policy' WHEN raised THEN 'failed' WHEN fallback THEN 'fallback_applied'
 WHEN last_error IS NOT NULL THEN 'failed' WHEN reordered THEN 'succeeded' ELSE 'attempted' END AS outcome FROM r""")
def rerank_outcomes(get):
    return facts(get, CALLS).select("id", states.rerank_outcome().alias("outcome"))


#: Orders as artifacts: every order is a delta on the one of a third of its number, some are full, some name no base or one that is not there, and some turn in circles.
ARTIFACTS = """SELECT CASE WHEN o_orderkey % 40 = 9 THEN 'full' ELSE 'delta' END AS kind, 'c' || o_orderkey AS "commit", CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_orderkey % 60 = 11 THEN 'c' || (o_orderkey + 1) WHEN o_orderkey % 60 = 12 THEN 'c' || (o_orderkey - 1)
 ELSE 'c' || CAST(floor(o_orderkey / 3) AS BIGINT) END AS base FROM {orders}"""


@Q.plan("T3_delta_chain", f"""WITH RECURSIVE a AS (SELECT DISTINCT * FROM ({ARTIFACTS})), f AS (SELECT "commit" AS c FROM a WHERE kind = 'full'), d AS (SELECT "commit" AS c, base FROM a WHERE kind = 'delta'),
w(target, cursor, deltas) AS (SELECT "commit", "commit", []::VARCHAR[] FROM a UNION ALL SELECT w.target, d.base, list_append(w.deltas, w.cursor) FROM w JOIN d ON d.c = w.cursor WHERE w.cursor NOT IN (SELECT c FROM f) AND NOT list_contains(w.deltas, w.cursor) AND d.base IS NOT NULL),
e AS (SELECT target, cursor, deltas, row_number() OVER (PARTITION BY target ORDER BY len(deltas) DESC) AS k FROM w)
SELECT target, f.c AS "full", array_to_string(list_reverse(deltas), '>') AS deltas, CASE WHEN f.c IS NOT NULL THEN NULL WHEN list_contains(deltas, cursor) THEN 'cycle' WHEN d.c IS NULL THEN 'missing delta ' || cursor ELSE 'missing base' END AS problem
FROM e LEFT JOIN f ON f.c = cursor LEFT JOIN d ON d.c = cursor WHERE k = 1""")
def delta_chain(get):
    """Every artifact's way back to the full one that its deltas stand on."""
    return states.delta_chains(facts(get, spark_text(ARTIFACTS)).distinct()).withColumn("deltas", F.array_join("deltas", ">"))


# -- dependencies between repositories ---------------------------------------------------------

#: Suppliers as repositories, each with a manifest of its kind that names two others and one package of nobody; several repositories bear one name.
REPOS = """SELECT 'r' || s_suppkey AS repo, 'pkg-' || (s_suppkey % 61) AS name, CASE s_suppkey % 4 WHEN 0 THEN 'requirements' WHEN 1 THEN 'npm' WHEN 2 THEN 'gomod' ELSE 'cargo' END AS kind, 'pkg-' || (s_suppkey * 7 % 67) AS a, 'pkg-' || (s_nationkey * 3 % 61) AS b, 'alone-' || s_suppkey AS c FROM {supplier}"""
NAMED = f"(SELECT repo, name, unnest([a, b, c]) AS package FROM ({REPOS}))"
DEPENDS = f"SELECT DISTINCT n.repo, o.dependency FROM {NAMED} n JOIN (SELECT name, max(repo) AS dependency FROM ({REPOS}) GROUP BY name) o ON o.name = n.package AND o.dependency <> n.repo"


def dependency_edges(get):
    """(repo, dependency): manifest packages that are registered repositories; of one name the last counts, a repository is not its own."""
    rows = facts(get, REPOS)
    line = {"requirements": lambda c: F.concat(c, F.lit(">=1.0")), "npm": lambda c: F.concat(F.lit('  "'), c, F.lit('": "^1.2",')), "gomod": lambda c: F.concat(F.lit("require "), c, F.lit(" v1.0")), "cargo": lambda c: F.concat(c, F.lit(' = "1"'))}
    text = F.lit(None).cast("string")
    for kind, written in line.items():
        text = F.when(F.col("kind") == kind, F.concat_ws("\n", *[written(F.col(c)) for c in "abc"])).otherwise(text)
    rows = rows.withColumn("text", text)
    owner = rows.groupBy(F.col("name").alias("package")).agg(F.max("repo").alias("dependency"))
    wanted = code.manifest_packages(rows, "repo", "kind", "text").distinct()
    return wanted.join(owner, "package").where("repo <> dependency").select("repo", "dependency").distinct()


@Q.plan("C15_package_repositories", DEPENDS)
def package_repositories(get):
    return dependency_edges(get)


ASKED = "SELECT 'r' || s_suppkey AS repo FROM {supplier} WHERE s_nationkey < 5"


@Q.plan("J11_dependency_closure", f"WITH d AS ({DEPENDS}), q AS ({ASKED}) SELECT repo, false AS from_dependency FROM q UNION SELECT dependency, true FROM d WHERE repo IN (SELECT repo FROM q) AND dependency NOT IN (SELECT repo FROM q)")
def dependency_closure(get):
    """The repositories of five nations and those that they depend on directly, which are marked."""
    asked = facts(get, ASKED)
    direct = dependency_edges(get).join(asked, "repo", "left_semi").select(F.col("dependency").alias("repo")).distinct().join(asked, "repo", "left_anti")
    return asked.withColumn("from_dependency", F.lit(False)).unionByName(direct.withColumn("from_dependency", F.lit(True)))


@Q.plan("M11_dependency_search", f"""WITH d AS ({DEPENDS}), q AS ({ASKED}), s AS (SELECT repo, false AS dep FROM q UNION SELECT dependency, true FROM d WHERE repo IN (SELECT repo FROM q) AND dependency NOT IN (SELECT repo FROM q)),
h AS (SELECT file_id, 'r' || substr(repo, 4) AS repo, len(list_filter(tokens_of(content), lambda x: x = 'only')) AS hits FROM {{files}}) SELECT h.file_id, s.repo, s.dep AS from_dependency, hits FROM h JOIN s ON h.repo = s.repo WHERE hits > 0""")
def dependency_search(get):
    """A search over some repositories and their direct dependencies; hits of the latter are marked."""
    hits = get("files").select("file_id", F.concat(F.lit("r"), F.substr("repo", F.lit(4))).alias("repo"), F.size(F.filter(lexical.tokens(F.col("content")), lambda t: t == "only")).cast("long").alias("hits"))
    return hits.where("hits > 0").join(dependency_closure(get), "repo").select("file_id", "repo", "from_dependency", "hits")


@Q.plan("L9_transitive_dependencies", f"WITH RECURSIVE d AS ({DEPENDS}), b AS (SELECT repo, dependency FROM d UNION SELECT b.repo, d.dependency FROM b JOIN d ON d.repo = b.dependency) SELECT repo, count(*) AS reach FROM b GROUP BY repo")
def transitive(get):
    pairs = graph.closure(dependency_edges(get).toDF("src", "dst"))
    return pairs.groupBy(F.col("src").alias("repo")).agg(F.count(F.lit(1)).alias("reach"))


#: Suppliers as types with a method for each part they deliver, small groups of parts as interfaces.
HAVE = "SELECT DISTINCT l_suppkey % 40 AS type, 'M' || (l_partkey % 60) AS method, '(' || (l_linenumber % 2) || ')' AS signature FROM {lineitem} WHERE l_quantity > 30"
WANT = "SELECT DISTINCT p_size AS interface, 'M' || (p_partkey % 60) AS method, '(' || (p_partkey % 2) || ')' AS signature FROM {part} WHERE p_partkey % 9 = 0 AND p_partkey < 700"


@Q.plan("L12_interface_satisfaction", f"WITH h AS ({HAVE}), w AS ({WANT}) SELECT t.type, i.interface FROM (SELECT DISTINCT type FROM h) t, (SELECT DISTINCT interface FROM w) i WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.interface = i.interface AND NOT EXISTS (SELECT 1 FROM h WHERE h.type = t.type AND h.method = w.method AND h.signature = w.signature))")
def satisfaction(get):
    """Types that have every method of an interface with its signature: relational division by counts."""
    have, wanted = facts(get, HAVE), facts(get, WANT)
    needs = wanted.groupBy("interface").agg(F.count(F.lit(1)).alias("needs"))
    met = have.join(wanted, ["method", "signature"]).groupBy("type", "interface").agg(F.count(F.lit(1)).alias("met"))
    return met.join(needs, "interface").where("met = needs").select("type", "interface")


# -- source records ----------------------------------------------------------------------------


@Q.plan("A15_issues", """SELECT c_custkey AS number, 'Issue of ' || c_name AS title, CASE c_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'bug' WHEN 2 THEN 'bug,p1' ELSE 'docs' END AS labels, CASE WHEN c_acctbal < 0 THEN 'closed' ELSE 'open' END AS state,
 CASE WHEN c_acctbal < 0 THEN '2026-01-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' END AS closed_at, c_nationkey % 4 IN (1, 2) AND c_custkey % 28 + 1 <= 15 AS asked FROM customer WHERE c_custkey % 17 <> 0""")
def issue_source(get):
    """An issue export of the customers, written as JSON and read back normalised; `asked` marks what a search for a label updated until a day gives."""
    customers, key = get("customer"), F.col("c_custkey")
    spark = customers.sparkSession
    day = F.concat(F.lit("2026-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))
    label = lambda *names: F.array(*[F.struct(F.lit(n).alias("name")) for n in names])
    labels = F.when(F.col("c_nationkey") % 4 == 1, label("Bug", " bug ")).when(F.col("c_nationkey") % 4 == 2, label("P1", "bug")).when(F.col("c_nationkey") % 4 == 3, label("docs", ""))
    closed = F.col("c_acctbal") < 0
    rows = customers.select(
        F.when(key % 17 != 0, key).alias("number"), F.concat(F.lit(" Issue of "), "c_name").alias("title"), F.when(closed, "CLOSED").otherwise("open").alias("state"), labels.alias("labels"),
        day.alias("createdAt"), day.alias("updatedAt"), F.when(closed, day).otherwise("").alias("closedAt"), F.lit("u").alias("url"), F.col("c_mktsegment").alias("body"),
    )
    base = scratch(spark, "issues")
    rows.write.json(base)
    every = external.issues(spark, base, " Owner/Repo ")
    asked = external.issues(spark, base, "owner/repo", labels=("bug",), until="2026-01-15").select("number", F.lit(True).alias("asked"))
    return every.join(asked, "number", "left").select("number", "title", F.array_join("labels", ",").alias("labels"), "state", "closed_at", F.coalesce("asked", F.lit(False)).alias("asked"))


#: Of every event an envelope with a marker, an issue and an odd record.
RECORDS = """SELECT 'e' || event_id AS chunk_id, CASE event_id % 5 WHEN 0 THEN '0' WHEN 1 THEN NULL ELSE '1' END AS version, CASE WHEN user_id % 3 <> 0 THEN event_type END AS category, event_id % 4 AS kind, user_id % 6 AS repo FROM {events}"""
_HISTORY = "CASE kind WHEN 0 THEN '' WHEN 1 THEN 'bug' WHEN 2 THEN 'bug,p1' ELSE 'docs' END"


@Q.plan("B5_source_matcher", f"""WITH r AS ({RECORDS}), v AS (SELECT *, CASE WHEN category IS NOT NULL THEN 'friction:' || category END AS f, CASE WHEN repo <> 5 THEN 'history:' || {_HISTORY} || ':owner/' || repo END AS h FROM r WHERE version = '1')
SELECT 'history of bugs' AS asked, chunk_id, h AS records FROM v WHERE h IS NOT NULL AND kind IN (1, 2) UNION ALL SELECT 'friction', chunk_id, f FROM v WHERE category IN ('view', 'click')
UNION ALL SELECT 'in one repository', chunk_id, concat_ws('|', f, CASE WHEN repo = 2 THEN h END) FROM v WHERE f IS NOT NULL OR repo = 2""")
def source_matcher(get):
    """Envelopes of one version whose records fit what is asked for; envelopes without any are left out."""
    rows = facts(get, RECORDS)
    kind, none = F.col("kind"), F.lit(None)
    names = F.when(kind == 1, F.array(F.lit(" Bug"))).when(kind == 2, F.array(F.lit("P1 "), F.lit("bug"), F.lit("BUG"))).when(kind == 3, F.array(F.lit("docs"))).otherwise(F.array().cast("array<string>"))
    record = lambda t, c, n, r: F.struct(F.lit(t).alias("type"), c.cast("string").alias("category"), n.cast("array<string>").alias("labels"), r.cast("string").alias("repo"))
    repo = F.when(F.col("repo") != 5, F.concat(F.lit("Owner/"), "repo"))
    made = rows.select("chunk_id", "version", F.array(record("friction", F.concat(F.upper("category"), F.lit(" ")), none, none), record("history", none, names, repo), record("odd", none, none, none)).alias("records"))
    out = None
    for name, wanted in (("history of bugs", {"source_type": "history", "labels": ["BUG "]}), ("friction", {"categories": ["view", "CLICK"], "source_type": "friction"}), ("in one repository", {"repos": ["OWNER/2"]})):
        found = markers.matching(made, "1", **wanted).select(F.lit(name).alias("asked"), "chunk_id", F.array_join("records", "|").alias("records"))
        out = found if out is None else out.unionByName(found)
    return out


@Q.plan("R6_ranking_normaliser", """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders)
SELECT o_custkey AS arm, rank::INT AS rank, 'd' || o_orderkey AS doc_id, CASE WHEN o_custkey % 3 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE floor(o_totalprice)::DOUBLE END AS score FROM r""")
def normaliser(get):
    """Every customer's orders as a ranking, written as ids, as pairs or as records, and read alike."""
    rows = get("orders").select("o_custkey", "o_orderkey", F.concat(F.lit("d"), "o_orderkey").alias("d"), F.when(F.col("o_orderkey") % 7 != 0, F.floor("o_totalprice")).alias("s"))
    listed = rows.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "d", "s"))).alias("r"))  # one ranking a row, as its JSON
    ids = F.to_json(F.transform("r", lambda x: x["d"]))
    pairs = F.concat(F.lit("["), F.concat_ws(",", F.transform("r", lambda x: F.concat(F.lit('["'), x["d"], F.lit('",'), F.coalesce(x["s"].cast("string"), F.lit("null")), F.lit("]")))), F.lit("]"))
    records = F.to_json(F.transform("r", lambda x: F.struct(x["d"].alias("doc_id"), x["s"].alias("score"))))
    raw = F.when(F.col("o_custkey") % 3 == 0, ids).when(F.col("o_custkey") % 3 == 1, pairs).otherwise(records)
    return evaluation.normal_rankings(listed.select(F.col("o_custkey").alias("arm"), raw.alias("raw")), "arm", "raw")


@Q.plan("A19_schema_bootstrap", "SELECT 'files' AS name, count(*) AS rows FROM {files} UNION ALL SELECT 'symbols', count(*) FROM {symbols} UNION ALL SELECT 'chunks', 0 UNION ALL SELECT 'refs', 0 UNION ALL SELECT 'repositories', 0 UNION ALL SELECT 'summaries', 0")
def bootstrap(get):
    """The catalog's tables are created where they are not there; what was filled stays when they are created again."""
    files = get("files")
    spark = files.sparkSession
    place = scratch(spark, "catalog")
    name = f"quarry_{place[-12:]}"
    api.create_tables(spark, name, place)
    for table in ("files", "symbols"):
        kinds = {f.name: f.dataType for f in spark.table(f"{name}.{table}").schema}
        rows = get(table)
        rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]).write.insertInto(f"{name}.{table}")
    api.create_tables(spark, name, place)
    counts = [spark.table(f"{name}.{t}").agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("rows")) for t in api.TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@Q.plan("P17_writer_turns", """WITH r AS (SELECT event_id, user_id % 25 AS repo, user_id AS writer, time_bucket(INTERVAL 2 HOUR, ts) AS turn FROM events), g AS (SELECT repo, turn, arg_min(writer, event_id) AS holder FROM r GROUP BY repo, turn)
SELECT event_id, r.repo, writer = holder AS granted FROM r JOIN g ON g.repo = r.repo AND g.turn = r.turn""")
def writer_turns(get):
    """One writer a repository and turn: the first to ask holds it, and asks again with success; by partial minimum, not by a lock."""
    asked = get("events").select("event_id", (F.col("user_id") % 25).alias("repo"), F.col("user_id").alias("writer"), F.window(F.col("ts").cast("timestamp"), "2 hours").alias("turn"))
    held = asked.groupBy("repo", "turn").agg(F.min_by("writer", "event_id").alias("holder"))
    return asked.join(held, ["repo", "turn"]).select("event_id", "repo", (F.col("writer") == F.col("holder")).alias("granted"))


QUERIES, ORACLES = Q.queries, Q.oracles
