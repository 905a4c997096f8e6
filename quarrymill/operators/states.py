"""State machines of repositories, indexes and artifacts, as columns: ordered rules, the first that holds decides.

A null in a rule's input makes the rule not hold, so a row with nothing known falls to the last rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.session import stage


def first_of(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for test, name in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def blank(c: Column) -> Column:
    return c.isNull() | (F.btrim(c) == "")


#: Rows of a registry: git_managed, live_branch, live_commit, branch, commit, tracked, indexed_commit, staleness, indexing, index_state (null: no index).
def readiness() -> Column:
    """What a registered repository's index is good for."""
    c = F.col
    full_commit = c("git_managed") & c("commit").rlike("^[0-9a-fA-F]{40}$")
    branch = F.when(full_commit, c("live_branch")).otherwise(F.coalesce("branch", "live_branch"))
    commit = F.when(full_commit, c("live_commit")).otherwise(F.coalesce("commit", "live_commit"))
    inspected = [(c("index_state") == s, s) for s in ("index_locked", "corrupt_sqlite", "missing_schema", "index_rebuilding", "scheme_mismatch")]
    return first_of(
        [
            (full_commit & (c("live_branch").isNull() | c("live_commit").isNull()), "unregistered_repository"),
            (c("indexing") | (c("staleness") == "index_building"), "index_building"),
            (c("tracked") != branch, "wrong_branch"),
            (c("index_state").isNull(), "missing_index"),
            *inspected,
            (c("staleness").isin("index_publication_pending", "partial_index_failure"), "missing_provenance"),
            (c("index_state") == "index_empty", "index_empty"),
            (blank(c("indexed_commit")), "missing_provenance"),
            (commit != c("indexed_commit"), "stale_commit"),
        ],
        "ready",
    )


def on_tracked_branch(current: Column, tracked: Column) -> Column:
    """True if both are known and equal: only then may a change of the repository be indexed."""
    return F.coalesce(current == tracked, F.lit(False))


#: Rows: known, commit, branch, tracked, indexed_commit, force_full, artifacts_on, artifact_commit, context_ok, changed, tracked_files.
def sync_action(full_share: float = 0.5, full_count: int = 1000) -> Column:
    """What a synchronisation does: wrong_branch, up_to_date, downloaded, incremental, full or failed."""
    c = F.col
    forced = F.coalesce("force_full", F.lit(False))
    large = (c("changed") > full_count) | (c("changed") >= full_share * c("tracked_files"))
    return first_of(
        [
            (~c("known") | blank(c("commit")), "failed"),
            (c("branch") != c("tracked"), "wrong_branch"),
            (~on_tracked_branch(c("branch"), c("tracked")), "up_to_date"),
            ((c("commit") == c("indexed_commit")) & ~forced, "up_to_date"),
            (c("artifacts_on") & ~forced & (c("artifact_commit") == c("commit")), "downloaded"),
            (~c("context_ok"), "failed"),
            (forced | blank(c("indexed_commit")), "full"),
            (c("changed") == 0, "up_to_date"),
            (large, "full"),
        ],
        "incremental",
    )


def freshness(commit: Column, stamp: Column, is_ancestor: Column, now: Column, most_days: int) -> Column:
    """Verdict on an artifact: invalid, stale_commit, stale_age or fresh; a stamp that is no time is invalid."""
    at = F.try_to_timestamp(F.regexp_replace(stamp, "Z+$", ""))
    age = F.unix_timestamp(now) - F.unix_timestamp(at)
    return first_of([(blank(commit) | blank(stamp) | at.isNull(), "invalid"), (~F.coalesce(is_ancestor, F.lit(False)), "stale_commit"), (age > most_days * 86400, "stale_age")], "fresh")


#: Fixed value: the scheme that unmarked indexes were built with.
LEGACY_SCHEME = "treesitter_chunk_id_v1"


#: Rows: rebuild_target, marker, chunk_rows, target.
def chunk_scheme() -> Column:
    """Whether an index's chunk ids are those of the target scheme."""
    c = F.col
    held = F.coalesce(c("chunk_rows") > 0, F.lit(False))
    return first_of(
        [
            (c("rebuild_target").isNotNull(), "rebuilding"),
            (c("marker") == c("target"), "compatible"),
            (c("marker").isNotNull(), "mismatch"),
            (held & (c("target") == LEGACY_SCHEME), "compatible_legacy"),
            (held, "missing_marker"),
        ],
        "empty",
    )


def readable(scheme: Column) -> Column:
    """Reads fail closed: only these states let scheme-dependent rows be read."""
    return scheme.isin("compatible", "compatible_legacy", "empty")


#: Rows: version, collection, indexed_commit, corpus_sha256, profile, provider, revision, point_set, and want_* of each but the version (null: not asked for).
PROVENANCE_VERSION = "v1"


def provenance() -> Column:
    """Whether a collection's manifest binds it to the frozen corpus; each failure has one code, in this order."""
    c = F.col
    differs = lambda name: c(f"want_{name}").isNotNull() & ~c(name).eqNullSafe(c(f"want_{name}"))
    return first_of(
        [
            (c("version").isNull() & c("collection").isNull() & c("indexed_commit").isNull(), "missing"),
            (~c("version").eqNullSafe(F.lit(PROVENANCE_VERSION)) | blank(c("collection")) | blank(c("indexed_commit")) | blank(c("profile")) | blank(c("revision")), "tampered"),
            ((c("indexed_commit") != c("want_indexed_commit")) | (c("corpus_sha256") != c("want_corpus_sha256")), "stale"),
            (blank(c("corpus_sha256")), "corpus_unbound"),
            (differs("collection"), "collection_mismatch"),
            (differs("profile"), "profile_mismatch"),
            (differs("provider") | differs("revision"), "provider_mismatch"),
            (differs("point_set"), "mixed_run"),
        ],
        "verified",
    )


#: Rows of one rerank call: configured, semantic, skips_semantic, raised, fallback, last_error, reordered.
def rerank_outcome() -> Column:
    """What a rerank call came to; a failed or unchanged order is never a success."""
    c = F.col
    return first_of(
        [
            (~c("configured"), "not_configured"),
            (c("semantic") & c("skips_semantic"), "skipped_policy"),
            (c("raised"), "failed"),
            (c("fallback"), "fallback_applied"),
            (c("last_error").isNotNull(), "failed"),
            (c("reordered"), "succeeded"),
        ],
        "attempted",
    )


def delta_chains(artifacts: DataFrame) -> DataFrame:
    """(target, full, deltas, problem) for every target of a delta or full artifact.

    artifacts: kind (full or delta), commit, base. full: the full artifact that the deltas lead back to; deltas:
    their targets, oldest first; problem: null, 'missing base', 'missing delta <commit>' or 'cycle'.
    All chains walk back together, one join a step; a cycle ends when the walk meets its own steps.
    """
    full = artifacts.where("kind = 'full' AND commit IS NOT NULL").select(F.col("commit").alias("f")).distinct()
    delta = artifacts.where("kind = 'delta' AND commit IS NOT NULL").groupBy(F.col("commit").alias("d")).agg(F.max("base").alias("base"))
    targets = artifacts.where("commit IS NOT NULL").select(F.col("commit").alias("target")).distinct()
    walk = targets.select("target", F.col("target").alias("cursor"), F.array().cast("array<string>").alias("deltas"))
    done = None
    while True:
        known = walk.join(full, F.col("cursor") == F.col("f"), "left").join(delta, F.col("cursor") == F.col("d"), "left")
        problem = (
            F.when(F.col("f").isNotNull(), F.lit(None))
            .when(F.array_contains("deltas", F.col("cursor")), "cycle")
            .when(F.col("d").isNull(), F.concat(F.lit("missing delta "), "cursor"))
            .when(blank(F.col("base")), "missing base")
        )
        known = stage(known.withColumn("problem", problem), "chains")
        ended = known.where("f IS NOT NULL OR problem IS NOT NULL").select("target", F.col("f").alias("full"), F.reverse("deltas").alias("deltas"), "problem")
        done = ended if done is None else done.unionByName(ended)
        walk = known.where("f IS NULL AND problem IS NULL").select("target", F.col("base").alias("cursor"), F.concat("deltas", F.array("cursor")).alias("deltas"))
        if walk.isEmpty():
            return done
