"""Sources beside tables: file trees, issue exports, frozen evaluation sets, index artifacts."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.text import glob_regex
from quarrymill.session import list_files, qualified, read_small

#: Suffixes with their language; folders that are never read; the largest file that is indexed.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rs": "rust", "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "kt": "kotlin", "swift": "swift", "dart": "dart", "rb": "ruby", "php": "php", "sh": "bash", "md": "markdown", "txt": "plaintext",
    "html": "html", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "sql": "sql",
}
EXCLUDED_PARTS = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", "target")
MOST_BYTES = 10 << 20


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def _fits(rule: str):
    return lambda x: x.rlike(rule)


def ignored(path: Column, patterns: tuple[str, ...]) -> Column:
    """True if a glob fits the path, its last part, or for `dir/` patterns any folder above it."""
    out = F.lit(False)
    name = F.element_at(F.split(path, "/"), -1)
    for p in patterns:
        if p.endswith("/"):
            folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
            out = out | F.exists(folders, _fits(glob_regex(p[:-1])))
        else:
            out = out | path.rlike(glob_regex(p)) | name.rlike(glob_regex(p))
    return out


def file_tree(spark: SparkSession, root: str, recursive: bool = True, include: str = "*", ignore: tuple[str, ...] = (), known_only: bool = True) -> DataFrame:
    """(path, size, language, status, content) of every file under a folder of any store that Spark reads.

    status: ok, or why a file is left out: ignored, excluded, too_large, no_parser. Contents of files that are left out are null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", include).load(root)
    inner = F.substr("path", F.lit(len(qualified(spark, root)) + 2))
    rows = files.select(inner.alias("path"), F.col("length").alias("size"), "content")
    parts = F.array(*map(F.lit, EXCLUDED_PARTS))
    status = (
        F.when(ignored(F.col("path"), ignore), "ignored")
        .when(F.arrays_overlap(F.split("path", "/"), parts), "excluded")
        .when(F.col("size") > MOST_BYTES, "too_large")
        .when(language_of(F.col("path")).isNull() & F.lit(known_only), "no_parser")
        .otherwise("ok")
    )
    decided = rows.withColumn("status", status).withColumn("language", language_of(F.col("path")))
    return decided.select("path", "size", "language", "status", F.when(F.col("status") == "ok", F.decode("content", "UTF-8")).alias("content"))


def sweep(tree: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, action) that bring an index to the tree: added, modified, deleted, or renamed with `old_path`.

    tree, indexed: path, hash. A deleted and an added path of one hash are a rename, if that hash has one of each.
    """
    both = tree.select("path", F.col("hash").alias("now")).join(indexed.select("path", F.col("hash").alias("was")), "path", "full")
    changed = both.where("NOT now <=> was")
    gone = changed.where("now IS NULL").groupBy("was").agg(F.min("path").alias("old_path"), F.count(F.lit(1)).alias("g")).where("g = 1").drop("g")
    came = changed.where("was IS NULL").groupBy("now").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("a")).where("a = 1").drop("a")
    renamed = came.join(gone, came["now"] == gone["was"]).select("path", F.lit("renamed").alias("action"), "old_path")
    action = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").otherwise("modified")
    plain = changed.select("path", action.alias("action"), F.lit(None).cast("string").alias("old_path"))
    touched = renamed.select("path").union(renamed.select("old_path"))
    return plain.join(touched, "path", "left_anti").unionByName(renamed)


ISSUE = "number long, title string, body string, state string, labels array<struct<name: string>>, createdAt string, updatedAt string, closedAt string, url string"


def issues(spark: SparkSession, path: str, repo: str, state: str = "all", labels: tuple[str, ...] = (), since: str | None = None, until: str | None = None) -> DataFrame:
    """Normalised issue records from JSON exports: one array or one object a line. Predicates are those of the export's own search."""
    rows = spark.read.schema(ISSUE).json(path).where("number IS NOT NULL AND title IS NOT NULL")
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("labels", F.array().cast("array<struct<name: string>>")), lambda x: F.lower(F.btrim(x["name"]))), lambda n: n != "")))
    out = rows.select(
        F.lit("history").alias("source_type"), F.lit(repo.strip().lower()).alias("repo"), "number", F.btrim("title").alias("title"), names.alias("labels"), F.lower(F.btrim("state")).alias("state"),
        F.btrim("createdAt").alias("created_at"), F.btrim("updatedAt").alias("updated_at"), F.nullif(F.btrim("closedAt"), F.lit("")).alias("closed_at"), F.btrim("url").alias("url"), "body",
    )
    if state != "all":
        out = out.where(F.col("state") == state)
    for label in labels:
        out = out.where(F.array_contains("labels", label.lower()))
    if since:
        out = out.where(F.substring("updated_at", 1, 10) >= since)
    if until:
        out = out.where(F.substring("updated_at", 1, 10) <= until)
    return out


class NotFrozen(ValueError):
    """An evaluation set that must not be used."""


def frozen_set(spark: SparkSession, folder: str) -> DataFrame:
    """The queries of a signed evaluation set with `holdout`; refused unless the manifest is signed and every checksum fits."""
    if "MANIFEST.json" not in list_files(spark, folder):
        raise NotFrozen("no manifest")
    try:
        manifest = json.loads(read_small(spark, f"{folder}/MANIFEST.json"))
    except ValueError as error:
        raise NotFrozen("the manifest cannot be read") from error
    if (manifest.get("review") or {}).get("signed") is not True:
        raise NotFrozen("the manifest is not signed")
    for key, name in (("dataset_sha256", "queries.jsonl"), ("thresholds_sha256", "thresholds.json")):
        if not manifest.get(key):
            raise NotFrozen(f"no checksum {key}")
        if name not in list_files(spark, folder):
            raise NotFrozen(f"no file {name}")
        if hashlib.sha256(read_small(spark, f"{folder}/{name}")).hexdigest() != manifest[key]:
            raise NotFrozen(f"{name} has changed")
    held = manifest.get("holdout_query_ids") or []
    rows = spark.read.schema("id string, query string, category string, relevant_doc_ids array<string>, hard_negative_doc_ids array<string>").json(f"{folder}/queries.jsonl")
    return rows.withColumn("holdout", F.col("id").isin(held) if held else F.lit(False))


def export_artifact(frame: DataFrame, path: str) -> DataFrame:
    """Write a table with its manifest: (file, sha256, size) of each part, read back from the store."""
    frame.write.parquet(f"{path}/data")
    parts = frame.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/data")
    manifest = parts.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2(F.col("content"), 256).alias("sha256"), F.col("length").alias("size"))
    manifest.write.json(f"{path}/manifest")
    return frame.sparkSession.read.schema("file string, sha256 string, size long").json(f"{path}/manifest")


def import_artifact(spark: SparkSession, path: str) -> DataFrame:
    """The table of an artifact whose files are all there and unchanged, and named inside it; else an error."""
    manifest = spark.read.schema("file string, sha256 string, size long").json(f"{path}/manifest")
    if manifest.where("file LIKE '%/%' OR file LIKE '%..%' OR file = ''").limit(1).count():
        raise ValueError("the manifest names files outside the artifact")
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/data")
    found = parts.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2(F.col("content"), 256).alias("now"))
    wrong = manifest.join(found, "file", "full").where("NOT now <=> sha256").select("file").orderBy("file").limit(5)
    bad = [r.file for r in wrong.collect()]
    if bad:
        raise ValueError(f"missing, unknown or changed files: {bad}")
    return spark.read.parquet(f"{path}/data")
