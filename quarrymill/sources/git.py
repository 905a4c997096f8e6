"""Change records from git's text output: name-status diffs and porcelain status, one line a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a name-status line with the change that they stand for; others (copies, type changes) are no change of content.
LETTERS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed"}


def unquoted(path: Column) -> Column:
    """A path as git writes it, without the quotes around unusual ones."""
    inner = F.regexp_replace(F.regexp_replace(path, r'^"|"$', ""), r'\\(["\\])', "$1")
    return F.when(F.startswith(path, F.lit('"')) & F.endswith(path, F.lit('"')) & (F.length(path) > 1), inner).otherwise(path)


def supported(path: Column, suffixes: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*suffixes), F.lit(False))


def name_status(lines: DataFrame, line: str, suffixes: tuple[str, ...]) -> DataFrame:
    """lines' columns with path, action and old_path: tab-parted lines of `git diff --name-status --find-renames`.

    Renames carry a similarity and two paths; lines that are no change, cannot be read, or name files of other suffixes are left out.
    """
    parts = F.split(F.col(line), "\t")
    letter = F.substring(F.get(parts, F.lit(0)), 1, 1)
    action = F.element_at(F.create_map(*[F.lit(x) for p in LETTERS.items() for x in p]), letter)
    renamed = letter == "R"
    path = unquoted(F.when(renamed, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))))
    old = F.when(renamed, unquoted(F.get(parts, F.lit(1))))
    rows = lines.withColumns({"path": path, "action": action, "old_path": old})
    return rows.where(F.col("action").isNotNull() & F.col("path").isNotNull() & supported(F.col("path"), suffixes))


def working_tree(staged: DataFrame, unstaged: DataFrame, untracked: DataFrame, line: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, action, old_path, state) of all that is not committed; a path that is staged and changed again comes twice."""
    parts = [name_status(f, line, suffixes).select("path", "action", "old_path", F.lit(s).alias("state")) for f, s in ((staged, "staged"), (unstaged, "unstaged"))]
    new = untracked.select(unquoted(F.col(line)).alias("path"), F.lit("added").alias("action"), F.lit(None).cast("string").alias("old_path"), F.lit("untracked").alias("state"))
    return parts[0].unionByName(parts[1]).unionByName(new.where(supported(F.col("path"), suffixes)))
