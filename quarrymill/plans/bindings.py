"""The engine's tables as views of the available data, in SQL that both engines read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrymill.sources.tables import table

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Table name: SELECT over the base tables.
VIEWS = {
    "files": """SELECT doc_id AS file_id, source AS repo, lang AS language, text AS content, n_chars AS size,
        CASE doc_id % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'docs/' WHEN 3 THEN 'scripts/' WHEN 4 THEN 'plans/' ELSE 'lib/' END || source || '/'
        || CASE WHEN doc_id % 11 = 0 THEN '__init__' ELSE 'file_' || cast(doc_id AS string) END
        || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.json' WHEN 3 THEN '.go' ELSE '.txt' END AS path,
        md5(text) AS hash, doc_id % 13 = 0 AS is_deleted, doc_id % 17 AS version FROM {documents}""",
    "symbols": """SELECT p_partkey AS symbol_id, p_partkey % 997 AS file_id, replace(p_name, ' ', '_') || '_' || replace(p_brand, 'Brand#', '') AS name,
        lower(p_type) AS kind, p_size AS line_start, p_size + 10 AS line_end, p_brand || ' ' || p_type AS signature FROM {part}""",
    "refs": "SELECT l_partkey AS symbol_id, l_orderkey % 997 AS file_id, l_linenumber AS line_number, l_returnflag AS reference_kind FROM {lineitem}",
    "edges": """SELECT 'c' || cast(c_custkey AS string) AS src, 'n' || cast(c_nationkey AS string) AS dst FROM {customer}
        UNION ALL SELECT 's' || cast(s_suppkey AS string), 'n' || cast(s_nationkey AS string) FROM {supplier}
        UNION ALL SELECT 'n' || cast(n_nationkey AS string), 'r' || cast(n_regionkey AS string) FROM {nation}
        UNION ALL SELECT 'r' || cast(r_regionkey AS string), 'n' || cast(r_regionkey + 7 AS string) FROM {region}""",
    "changes": """SELECT event_id, ts, 'p' || cast(user_id AS string) AS path, user_id,
        CASE event_type WHEN 'view' THEN 'modified' WHEN 'click' THEN 'modified' WHEN 'signup' THEN 'added' WHEN 'purchase' THEN 'renamed' ELSE 'deleted' END AS action,
        value FROM {events}""",
    "chunks": """SELECT l_orderkey AS file_id, l_linenumber AS chunk_index, 'ch' || cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) || '-' || cast(l_partkey AS string) AS chunk_id,
        l_partkey AS symbol_id, l_linenumber * 10 AS line_start, l_linenumber * 10 + cast(l_quantity AS int) AS line_end FROM {lineitem}""",
    "points": """SELECT 'ch' || cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) || '-' || cast(l_partkey AS string) AS chunk_id,
        CASE WHEN l_returnflag = 'A' THEN 'p1' ELSE 'p2' END AS profile_id, CASE WHEN l_linestatus = 'F' THEN 'c1' ELSE 'c2' END AS collection FROM {lineitem} WHERE l_suppkey % 3 <> 0""",
    "summaries": """SELECT DISTINCT 'ch' || cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) || '-' || cast(l_partkey AS string) AS chunk_hash,
        l_returnflag AS profile FROM {lineitem} WHERE l_suppkey % 5 <> 0""",
    "chunk_tree": """SELECT o_orderkey AS chunk, CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey - 25 WHEN o_orderkey % 50 = 25 AND o_orderkey % 3 = 0 THEN o_orderkey + 25
        WHEN o_orderkey > 3 THEN cast(floor(o_orderkey / 2) AS bigint) END AS parent FROM {orders}""",
    "repositories": """SELECT n_nationkey AS repo_id, n_name AS name, n_nationkey % 4 AS priority, n_nationkey % 7 <> 0 AS active, n_regionkey AS region FROM {nation}""",
    "repo_symbols": """SELECT s.c_nationkey AS repo_id, replace(s.c_name, '#', '_') AS name, lower(s.c_mktsegment) AS kind, s.c_custkey AS symbol_id, s.c_acctbal AS weight FROM {customer} s""",
}


#: In a check, tokens_of(column) stands for the tokens of a text by the checking engine's own functions.
TOKENS_OF = re.compile(r"tokens_of\(([\w.]+)\)")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or view as a DataFrame."""
    if name in BASE:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in BASE if "{" + t + "}" in sql})


def duck(sql: str) -> str:
    """The text with {names} of views and base tables resolved for the checking engine."""
    for name, text in VIEWS.items():
        sql = sql.replace("{" + name + "}", f"({text})")
    for name in BASE:
        sql = sql.replace("{" + name + "}", name)
    return TOKENS_OF.sub(r"regexp_extract_all(strip_accents(lower(\1)), '[\\p{L}\\p{N}]+')", sql)


class Queries:
    """Collects queries with their checks."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def sql(self, key: str, text: str, check: str | None = None) -> None:
        """A declarative query in SQL over {views}; check: the same in the other dialect, if it differs."""
        names = [n for n in [*VIEWS, *BASE] if "{" + n + "}" in text]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(text, **{n: frame(spark, sf_dir, n) for n in names})

        self.queries[key] = run
        self.oracles[key] = duck(check or text)

    def plan(self, key: str, check: str | None = None):
        """Registers a function of (frame getter) that gives a DataFrame."""

        def add(build: Callable) -> Callable:
            self.queries[key] = lambda spark, sf_dir: build(lambda name: frame(spark, sf_dir, name))
            if check:
                self.oracles[key] = duck(check)
            return build

        return add
