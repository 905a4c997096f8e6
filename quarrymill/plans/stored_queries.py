"""Stored tables that change in place: the vector index, keyed tables and what hangs on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions.text import trigrams
from quarrymill.operators.keyed import KeyedTable, cascade
from quarrymill.operators.vector_index import VectorIndex, misfits
from quarrymill.session import scratch

from .bindings import Queries
from .search_queries import nearest_sql

Q = Queries()
DIMENSION = 64

# -- vectors -----------------------------------------------------------------------------------


def vectors(get, rows=None):
    points = get("embeddings") if rows is None else rows
    return VectorIndex.build(points, scratch(points.sparkSession, "vectors"), DIMENSION)


@Q.plan("G1_index_exact", nearest_sql("cosine", 10))
def index_exact(get):
    """The ten nearest rows of every 20th vector, by cells and their radii; other cells' folders are not read."""
    return vectors(get).exact(get("embeddings").where("vec_id % 20 = 0"), 10)


@Q.plan("G1_index_search")
def index_search(get):
    """The same by the fewest cells that held 95 of 100 of the nearest rows of other queries."""
    index, points = vectors(get), get("embeddings")
    return index.search(points.where("vec_id % 20 = 0"), 10, index.probes_for(points.where("vec_id % 20 = 10"), 10))


UPSERTED = "SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS head FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 2 <> 0 UNION ALL SELECT vec_id, label + 100, round(-(embedding[1]::DOUBLE), 6) FROM embeddings WHERE vec_id % 2 = 0"


@Q.plan("A17_index_upsert", UPSERTED)
def index_upsert(get):
    """Two vectors of three are stored; a batch turns the even ones round and adds those that were not there."""
    points = get("embeddings")
    index = vectors(get, points.where("vec_id % 3 <> 0"))
    index.upsert(points.where("vec_id % 2 = 0").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"), (F.col("label") + 100).alias("label")))
    return index.rows().select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("head"))


@Q.plan("A18_collection_misfits", "SELECT CASE WHEN vec_id % 13 = 0 THEN 'null' WHEN vec_id % 7 = 0 THEN 'dimension' WHEN vec_id % 11 = 0 THEN 'no direction' ELSE 'fits' END AS reason, count(*) AS rows FROM embeddings GROUP BY 1")
def collection_misfits(get):
    """What a collection of 64 numbers by cosine would refuse of a spoilt table."""
    spoilt = F.when(F.col("vec_id") % 13 == 0, None).when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 11 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return misfits(get("embeddings").select(spoilt.alias("embedding")), "embedding", DIMENSION)


@Q.plan("G13_index_stale_delete", "SELECT vec_id, label FROM embeddings WHERE label <> 3 AND vec_id % 5 <> 1")
def index_stale(get):
    """Vectors leave the index when what they stand for is gone: by a list of the living, then by key."""
    points = get("embeddings")
    index = vectors(get)
    index.delete_stale(points.where("label <> 3"))
    index.delete(points.where("vec_id % 5 = 1"))
    return index.rows().select("vec_id", "label")


# -- keyed tables ------------------------------------------------------------------------------


def kept(get, rows, name, keys, by=None):
    return KeyedTable.store(rows, scratch(rows.sparkSession, name), keys, by, parts=16)


FIRST_CHUNKS = "(SELECT file_id, chunk_id, max(line_end) AS line_end FROM {chunks} WHERE chunk_index <= 3 GROUP BY ALL)"
LATER_CHUNKS = "(SELECT file_id, chunk_id, max(line_end) + 1 AS line_end FROM {chunks} WHERE chunk_index BETWEEN 3 AND 5 GROUP BY ALL)"


@Q.plan("Q4_keyed_chunk_upsert", f"""SELECT coalesce(n.file_id, o.file_id) AS file_id, coalesce(n.chunk_id, o.chunk_id) AS chunk_id, coalesce(n.line_end, o.line_end) AS line_end,
  CASE WHEN n.chunk_id IS NOT NULL AND o.chunk_id IS NOT NULL THEN 2 ELSE 1 END AS writes FROM {FIRST_CHUNKS} o FULL JOIN {LATER_CHUNKS} n ON n.file_id = o.file_id AND n.chunk_id = o.chunk_id""")
def chunk_upsert(get):
    """Chunks keyed by file and id: what comes again replaces all columns, and counts its writes."""
    chunks = get("chunks").select("file_id", "chunk_id", "line_end", F.lit(1).alias("writes"), "chunk_index")
    table = kept(get, chunks.where("chunk_index <= 3").drop("chunk_index"), "chunks", ("file_id", "chunk_id"), ("file_id",))
    table.upsert(chunks.where("chunk_index BETWEEN 3 AND 5").withColumn("line_end", F.col("line_end") + 1).drop("chunk_index"), combine={"writes": F.col("old.writes") + 1})
    return table.read()


@Q.plan("Q5_keyed_chunk_delete", "SELECT file_id, chunk_id, max(line_end) AS line_end FROM {chunks} WHERE NOT EXISTS (SELECT 1 FROM {files} f WHERE f.is_deleted AND f.file_id = {chunks}.file_id) GROUP BY ALL".replace("{chunks}.file_id", "c.file_id").replace("FROM {chunks} WHERE", "FROM {chunks} c WHERE"))
def chunk_delete(get):
    table = kept(get, get("chunks").select("file_id", "chunk_id", "line_end"), "chunks", ("file_id", "chunk_id"), ("file_id",))
    table.delete(get("files").where("is_deleted").select("file_id"))
    return table.read()


@Q.plan("Q7_keyed_references", """WITH o AS (SELECT DISTINCT symbol_id, file_id, line_number, reference_kind AS kind FROM {refs} WHERE reference_kind <> 'N'),
n AS (SELECT symbol_id, file_id, line_number, max(reference_kind) AS kind FROM {refs} WHERE line_number <= 2 GROUP BY ALL)
SELECT symbol_id, file_id, line_number, kind FROM n UNION ALL SELECT symbol_id, file_id, line_number, max(kind) FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.symbol_id = o.symbol_id AND n.file_id = o.file_id AND n.line_number = o.line_number) GROUP BY ALL""")
def keyed_references(get):
    """References keyed by symbol, file and line; of several kinds at one place the last one stays."""
    refs = get("refs").select("symbol_id", "file_id", "line_number", F.col("reference_kind").alias("kind"))
    table = kept(get, refs.where("kind <> 'N'"), "refs", ("symbol_id", "file_id", "line_number"), ("file_id",))
    table.upsert(refs.where("line_number <= 2"))
    return table.read()


CASCADED = {
    "files": ("{files}", "is_deleted"),
    "symbols": ("{symbols}", "file_id IN (SELECT file_id FROM d)"),
    "trigrams": ("(SELECT DISTINCT symbol_id, file_id, unnest(list_transform(range(1, length(name) + 3), lambda i: substr('  ' || lower(name) || '  ', i, 3))) AS trigram FROM {symbols})", "file_id IN (SELECT file_id FROM d)"),
    "refs": ("(SELECT DISTINCT symbol_id, file_id, line_number, reference_kind FROM {refs})", "file_id IN (SELECT file_id FROM d)"),
    "chunks": ("(SELECT DISTINCT file_id, chunk_id FROM {chunks})", "file_id IN (SELECT file_id FROM d)"),
    "points": ("(SELECT DISTINCT chunk_id, profile_id, collection FROM {points})", "chunk_id IN (SELECT chunk_id FROM {chunks} WHERE file_id IN (SELECT file_id FROM d))"),
    "summaries": ("(SELECT DISTINCT chunk_hash, profile FROM {summaries})", "chunk_hash IN (SELECT chunk_id FROM {chunks} WHERE file_id IN (SELECT file_id FROM d))"),
}


@Q.plan("Q9_keyed_cascade", "WITH d AS (SELECT file_id FROM {files} WHERE is_deleted) " + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) FILTER (WHERE NOT ({w})) AS kept, count(*) FILTER (WHERE {w}) AS gone FROM {s}" for t, (s, w) in CASCADED.items()))
def keyed_cascade(get):
    """Deleted files take along symbols, their trigrams, references, chunks, and the chunks' vectors and summaries; seven stored tables."""
    symbols = get("symbols").select("symbol_id", "file_id", "name")
    rows = {
        "files": (get("files").select("file_id", "path", "is_deleted"), ("file_id",), None),
        "symbols": (symbols, ("symbol_id", "file_id"), ("file_id",)),
        "trigrams": (symbols.select("symbol_id", F.explode(trigrams(F.col("name"))).alias("trigram")), ("symbol_id", "trigram"), ("symbol_id",)),
        "refs": (get("refs").select("symbol_id", "file_id", "line_number", "reference_kind"), ("symbol_id", "file_id", "line_number", "reference_kind"), ("file_id",)),
        "chunks": (get("chunks").select("file_id", "chunk_id"), ("file_id", "chunk_id"), ("file_id",)),
        "points": (get("points").select("chunk_id", "profile_id", "collection"), ("chunk_id", "profile_id", "collection"), ("chunk_id",)),
        "summaries": (get("summaries").select(F.col("chunk_hash").alias("chunk_id"), "profile"), ("chunk_id", "profile"), ("chunk_id",)),
    }
    t = {n: kept(get, r, n, keys, by) for n, (r, keys, by) in rows.items()}
    gone = cascade(t["files"], get("files").where("is_deleted").select("file_id"), [
        (t["symbols"], t["files"], {"file_id": "file_id"}), (t["trigrams"], t["symbols"], {"symbol_id": "symbol_id"}), (t["refs"], t["files"], {"file_id": "file_id"}),
        (t["chunks"], t["files"], {"file_id": "file_id"}), (t["points"], t["chunks"], {"chunk_id": "chunk_id"}), (t["summaries"], t["chunks"], {"chunk_id": "chunk_id"}),
    ])
    out = None
    for name, table in t.items():
        kept_rows = table.read().agg(F.count(F.lit(1)).alias("kept"))
        one = kept_rows.join(gone[id(table)].agg(F.count(F.lit(1)).alias("gone"))).select(F.lit(name).alias("t"), "kept", "gone")
        out = one if out is None else out.unionByName(one)
    return out


MOVED = "path LIKE 'lib/%'"


@Q.plan("Q10_move_with_audit", f"SELECT file_id, CASE WHEN {MOVED} THEN 'core/' || substr(path, 5) ELSE path END AS path, CASE WHEN {MOVED} THEN path END AS moved_from, CASE WHEN {MOVED} THEN hash END AS content FROM {{files}}")
def move_with_audit(get):
    """Moved files get their new path; each move leaves a row with the old path and the hash of the content."""
    files = get("files").select("file_id", "path", "hash")
    table = kept(get, files, "files", ("file_id",))
    moves = kept(get, files.limit(0).select("file_id", F.col("path").alias("moved_from"), F.col("hash").alias("content")), "moves", ("file_id", "moved_from"), ("file_id",))
    moved = table.read().where(MOVED)
    moves.upsert(moved.select("file_id", F.col("path").alias("moved_from"), F.col("hash").alias("content")))
    table.upsert(moved.withColumn("path", F.concat(F.lit("core/"), F.substr("path", F.lit(5)))))
    return table.read().select("file_id", "path").join(moves.read(), "file_id", "left")


@Q.plan("Q12_token_counts", "SELECT c.file_id, c.chunk_id, CASE WHEN f.file_id IS NOT NULL THEN (max(line_end) * 3 + 1) ELSE 0 END AS token_count FROM {chunks} c LEFT JOIN (SELECT DISTINCT file_id FROM {files} WHERE version = 3) f ON f.file_id = c.file_id GROUP BY c.file_id, c.chunk_id, f.file_id")
def token_counts(get):
    """Chunks of the files that changed are counted anew; the others' rows are not touched."""
    chunks = get("chunks").select("file_id", "chunk_id", "line_end", F.lit(0).alias("token_count"))
    table = kept(get, chunks, "chunks", ("file_id", "chunk_id"), ("file_id",))
    changed = get("files").where("version = 3").select("file_id").distinct()
    counted = table.read(changed).join(changed, "file_id", "left_semi").withColumn("token_count", F.col("line_end") * 3 + 1)
    table.upsert(counted)
    return table.read().select("file_id", "chunk_id", "token_count")


@Q.plan("Q14_keyed_summaries", "SELECT chunk_hash, arg_max(profile, [CASE WHEN profile = 'R' THEN 2 ELSE 1 END::VARCHAR, profile]) AS profile, CASE WHEN count(*) FILTER (WHERE profile = 'R') > 0 AND count(*) FILTER (WHERE profile <> 'R') > 0 THEN 2 ELSE 1 END AS writes FROM {summaries} GROUP BY chunk_hash")
def keyed_summaries(get):
    """One summary a chunk: a later one replaces it, whatever its profile."""
    rows = get("summaries").select("chunk_hash", "profile", F.lit(1).alias("writes"))
    table = kept(get, rows.where("profile <> 'R'"), "summaries", ("chunk_hash",))
    table.upsert(rows.where("profile = 'R'"), combine={"writes": F.col("old.writes") + 1})
    return table.read()


@Q.plan("Q17_keyed_scheme_rebuild", """SELECT file_id, md5(chunk_id || ':v2') AS chunk_id, chunk_id AS was, (SELECT count(*) FROM (SELECT DISTINCT chunk_id, profile_id, collection FROM {points}) p WHERE p.chunk_id = c.chunk_id) AS points_gone
FROM (SELECT DISTINCT file_id, chunk_id FROM {chunks}) c""")
def scheme_rebuild(get):
    """Chunks get the ids of a new scheme, file by file; vectors under the old ids go."""
    chunks = get("chunks").select("file_id", "chunk_id", F.lit(None).cast("string").alias("was"))
    table = kept(get, chunks, "chunks", ("file_id", "chunk_id"), ("file_id",))
    points = kept(get, get("points").select("chunk_id", "profile_id", "collection"), "points", ("chunk_id", "profile_id", "collection"), ("chunk_id",))
    table.rekey({"chunk_id": F.md5(F.concat("chunk_id", F.lit(":v2"))), "was": F.col("chunk_id")})
    lost = points.delete(table.read().select(F.col("was").alias("chunk_id"))).groupBy(F.col("chunk_id").alias("was")).agg(F.count(F.lit(1)).alias("points_gone"))
    return table.read().join(lost, "was", "left").select("file_id", "chunk_id", "was", F.coalesce("points_gone", F.lit(0)).alias("points_gone"))


QUERIES, ORACLES = Q.queries, Q.oracles
