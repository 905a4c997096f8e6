"""State rules on named cases: every state and the order of the rules."""

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import states

FULL, OTHER = "a" * 40, "b" * 40
REGISTRY = "git_managed boolean, live_branch string, live_commit string, branch string, commit string, tracked string, indexed_commit string, staleness string, indexing boolean, index_state string"
GOOD = {"git_managed": True, "live_branch": "main", "live_commit": FULL, "branch": "main", "commit": FULL, "tracked": "main", "indexed_commit": FULL, "indexing": False, "index_state": "ok"}
REPOSITORIES = {
    "fine": (GOOD, "ready"),
    "checkout gone": (GOOD | {"live_commit": None}, "unregistered_repository"),
    "being built": (GOOD | {"indexing": True, "tracked": "dev"}, "index_building"),
    "marked as building": (GOOD | {"staleness": "index_building"}, "index_building"),
    "other branch": (GOOD | {"live_branch": "topic"}, "wrong_branch"),
    "cached branch of an unmanaged one": (GOOD | {"git_managed": False, "live_branch": "topic"}, "ready"),
    "no index": (GOOD | {"index_state": None}, "missing_index"),
    "locked": (GOOD | {"index_state": "index_locked", "indexed_commit": OTHER}, "index_locked"),
    "broken": (GOOD | {"index_state": "corrupt_sqlite"}, "corrupt_sqlite"),
    "old schema": (GOOD | {"index_state": "missing_schema"}, "missing_schema"),
    "rebuilding": (GOOD | {"index_state": "index_rebuilding"}, "index_rebuilding"),
    "other scheme": (GOOD | {"index_state": "scheme_mismatch"}, "scheme_mismatch"),
    "published in part": (GOOD | {"staleness": "partial_index_failure", "index_state": "index_empty"}, "missing_provenance"),
    "empty": (GOOD | {"index_state": "index_empty", "indexed_commit": None}, "index_empty"),
    "never indexed": (GOOD | {"indexed_commit": "  "}, "missing_provenance"),
    "behind": (GOOD | {"indexed_commit": OTHER}, "stale_commit"),
    "nothing known": ({}, "missing_index"),
}
SYNC = "known boolean, commit string, branch string, tracked string, indexed_commit string, force_full boolean, artifacts_on boolean, artifact_commit string, context_ok boolean, changed int, tracked_files int"
SYNC_GOOD = {"known": True, "commit": FULL, "branch": "main", "tracked": "main", "indexed_commit": OTHER, "force_full": False, "artifacts_on": False, "context_ok": True, "changed": 3, "tracked_files": 100}
SYNCS = {
    "few changes": (SYNC_GOOD, "incremental"),
    "unknown": (SYNC_GOOD | {"known": False}, "failed"),
    "no commit": (SYNC_GOOD | {"commit": ""}, "failed"),
    "drift": (SYNC_GOOD | {"branch": "topic"}, "wrong_branch"),
    "nothing tracked": (SYNC_GOOD | {"tracked": None}, "up_to_date"),
    "same commit": (SYNC_GOOD | {"indexed_commit": FULL}, "up_to_date"),
    "same commit, forced": (SYNC_GOOD | {"indexed_commit": FULL, "force_full": True}, "full"),
    "artifact there": (SYNC_GOOD | {"artifacts_on": True, "artifact_commit": FULL}, "downloaded"),
    "artifact of another commit": (SYNC_GOOD | {"artifacts_on": True, "artifact_commit": OTHER}, "incremental"),
    "no context": (SYNC_GOOD | {"context_ok": False}, "failed"),
    "first time": (SYNC_GOOD | {"indexed_commit": None}, "full"),
    "no file changed": (SYNC_GOOD | {"changed": 0}, "up_to_date"),
    "half of the files changed": (SYNC_GOOD | {"changed": 50}, "full"),
    "over a thousand": (SYNC_GOOD | {"changed": 1001, "tracked_files": 90_000}, "full"),
}
STAMPS = {
    "new": ((FULL, "2026-01-09T00:00:00Z", True), "fresh"),
    "old": ((FULL, "2025-11-01T12:30:00", True), "stale_age"),
    "other line": ((FULL, "2026-01-09T00:00:00Z", False), "stale_commit"),
    "old on another line": ((FULL, "2025-11-01T00:00:00Z", False), "stale_commit"),
    "no commit": ((None, "2026-01-09T00:00:00Z", True), "invalid"),
    "no time": ((FULL, "", True), "invalid"),
    "not a time": ((FULL, "yesterday", True), "invalid"),
}
SCHEMES = {
    "same": ({"marker": "s4", "target": "s4", "chunk_rows": 5}, "compatible"),
    "other": ({"marker": "s3", "target": "s4", "chunk_rows": 5}, "mismatch"),
    "unmarked, old target": ({"target": states.LEGACY_SCHEME, "chunk_rows": 5}, "compatible_legacy"),
    "unmarked, new target": ({"target": "s4", "chunk_rows": 5}, "missing_marker"),
    "nothing yet": ({"target": "s4", "chunk_rows": 0}, "empty"),
    "rebuild under way": ({"rebuild_target": "s4", "marker": "s4", "target": "s4", "chunk_rows": 5}, "rebuilding"),
}
MANIFEST = "version string, collection string, indexed_commit string, corpus_sha256 string, profile string, provider string, revision string, point_set string, want_collection string, want_indexed_commit string, want_corpus_sha256 string, want_profile string, want_provider string, want_revision string, want_point_set string"
BOUND = {"version": "v1", "collection": "c", "indexed_commit": FULL, "corpus_sha256": "s", "profile": "p", "provider": "q", "revision": "1", "point_set": "x", "want_indexed_commit": FULL, "want_corpus_sha256": "s"}
MANIFESTS = {
    "bound": (BOUND, "verified"),
    "all asked for": (BOUND | {"want_collection": "c", "want_profile": "p", "want_provider": "q", "want_revision": "1", "want_point_set": "x"}, "verified"),
    "none": ({"want_indexed_commit": FULL}, "missing"),
    "other version": (BOUND | {"version": "v0"}, "tampered"),
    "no profile": (BOUND | {"profile": ""}, "tampered"),
    "other commit": (BOUND | {"indexed_commit": OTHER}, "stale"),
    "other corpus": (BOUND | {"corpus_sha256": "t", "want_profile": "z"}, "stale"),
    "no corpus": (BOUND | {"corpus_sha256": None}, "corpus_unbound"),
    "other collection": (BOUND | {"want_collection": "d", "want_profile": "z"}, "collection_mismatch"),
    "other profile": (BOUND | {"want_profile": "z", "want_provider": "z"}, "profile_mismatch"),
    "other provider": (BOUND | {"want_provider": "z"}, "provider_mismatch"),
    "other revision": (BOUND | {"want_revision": "2", "want_point_set": "z"}, "provider_mismatch"),
    "other run": (BOUND | {"want_point_set": "z"}, "mixed_run"),
}
ARTIFACTS = [("full", "c1", None), ("delta", "c4", "c1"), ("delta", "c7", "c4"), ("delta", "c9", "c7"), ("full", "c8", None), ("delta", "d2", "d1"), ("delta", "e1", None), ("delta", "f1", "f2"), ("delta", "f2", "f1"), ("delta", "g1", "f1")]
CHAINS = [("c1", "c1", "", None), ("c4", "c1", "c4", None), ("c7", "c1", "c4>c7", None), ("c9", "c1", "c4>c7>c9", None), ("c8", "c8", "", None), ("d2", None, "d2", "missing delta d1"), ("e1", None, "", "missing base"), ("f1", None, "f2>f1", "cycle"), ("f2", None, "f1>f2", "cycle"), ("g1", None, "f2>f1>g1", "cycle")]
CALL = "configured boolean, semantic boolean, skips_semantic boolean, raised boolean, fallback boolean, last_error string, reordered boolean"
USUAL = {"configured": True, "semantic": False, "skips_semantic": False, "raised": False, "fallback": False, "reordered": True}
CALLS = {
    "new order": (USUAL, "succeeded"),
    "same order": (USUAL | {"reordered": False}, "attempted"),
    "none": (USUAL | {"configured": False, "raised": True}, "not_configured"),
    "policy": (USUAL | {"semantic": True, "skips_semantic": True}, "skipped_policy"),
    "lexical under that policy": (USUAL | {"skips_semantic": True}, "succeeded"),
    "raised": (USUAL | {"raised": True, "fallback": True}, "failed"),
    "fell back": (USUAL | {"fallback": True, "last_error": "timeout"}, "fallback_applied"),
    "swallowed": (USUAL | {"last_error": "timeout", "reordered": False}, "failed"),
}


def decided(spark, schema, rows, verdict):
    names = [c.split()[0] for c in schema.split(", ")]
    frame = spark.createDataFrame([(k, *(r.get(n) for n in names)) for k, r in rows.items()], f"name string, {schema}")
    return {r.name: r.v for r in frame.select("name", verdict.alias("v")).collect()}


@pytest.mark.parametrize("schema,cases,verdict", [(REGISTRY, REPOSITORIES, states.readiness), (SYNC, SYNCS, states.sync_action), ("rebuild_target string, marker string, target string, chunk_rows int", SCHEMES, states.chunk_scheme), (MANIFEST, MANIFESTS, states.provenance), (CALL, CALLS, states.rerank_outcome)])
def test_states(spark, schema, cases, verdict):
    assert decided(spark, schema, {k: r for k, (r, _) in cases.items()}, verdict()) == {k: v for k, (_, v) in cases.items()}


def test_freshness(spark):
    rows = {k: dict(zip(("commit", "stamp", "ancestor"), r)) for k, (r, _) in STAMPS.items()}
    verdict = states.freshness(F.col("commit"), F.col("stamp"), F.col("ancestor"), F.lit("2026-01-10 00:00:00").cast("timestamp"), 14)
    assert decided(spark, "commit string, stamp string, ancestor boolean", rows, verdict) == {k: v for k, (_, v) in STAMPS.items()}


def test_delta_chains(spark):
    artifacts = spark.createDataFrame(ARTIFACTS, "kind string, commit string, base string")
    got = states.delta_chains(artifacts).withColumn("deltas", F.array_join("deltas", ">")).select("target", "full", "deltas", "problem")
    assert sorted(map(tuple, got.collect())) == sorted(CHAINS)
