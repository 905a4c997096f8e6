"""Friction markers in comments, issue records and their documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marker patterns in order of precedence (category, label, pattern before the description).
MARKERS = (
    ("hack", "HACK", r"\bHACK\b"), ("todo", "TODO", r"\bTODO\b"), ("fixme", "FIXME", r"\bFIXME\b"), ("workaround", "WORKAROUND", r"\bWORKAROUND\b"),
    ("wish", "WISH", r"\bWISH\b"), ("extraction_hint", "EXTRACTION_HINT", r"\bEXTRACTION HINT\b"), ("workaround", "WORKAROUND", r"\bwork[- ]?around\b"),
    ("wish", "WISH", r"\bwish(?:es|ed)?\b"), ("extraction_hint", "EXTRACTION_HINT", r"\bextraction[_ -]?hint\b"),
)
REFERENCE = r"(https?://\S+|#[0-9]+|\b[A-Z]{2,}-[0-9]+\b)"
LEAD = r"^\s*(?:(?:<!--|-->|#|//|/\*|\*/|\*|;|- \[[ x]\]|-)\s*)*"


def markers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, category, pattern, description, reference): the first marker of each line."""
    any_marker = "(?i)" + "|".join(p for _, _, p in MARKERS)
    lines = docs.where(F.col(text).rlike(any_marker)).select(key, F.posexplode(F.split(text, "\n")).alias("at", "raw"))
    clean = lines.select(key, (F.col("at") + 1).alias("line"), F.btrim(F.regexp_replace("raw", LEAD, "")).alias("s")).where(F.col("s").rlike(any_marker))
    chosen = None
    for category, label, pattern in MARKERS:
        hit = F.col("s").rlike(f"(?i){pattern}")
        found = F.struct(
            F.lit(category).alias("category"), F.lit(label).alias("pattern"),
            F.btrim(F.regexp_extract("s", rf"(?i){pattern}(?:\s*[:\-]\s*|\s+)?(.*)$", 1)).alias("description"),
        )
        chosen = F.when(hit, found) if chosen is None else chosen.when(hit, found)
    out = clean.withColumn("m", chosen).select(key, "line", "m.*")
    out = out.withColumn("description", F.when(F.col("description") == "", F.col("pattern")).otherwise(F.col("description")))
    return out.withColumn("reference", F.nullif(F.regexp_extract("description", REFERENCE, 1), F.lit("")))


def issue_type(labels: Column, title: Column) -> Column:
    """Phase, reflection or retrospective by label or title, else issue."""
    t = F.lower(F.btrim(title))
    has = lambda *names: F.arrays_overlap(labels, F.array(*map(F.lit, names)))
    return (
        F.when(has("phase-complete", "phase complete", "phase_complete") | F.contains(t, F.lit("phase complete")), "phase_complete")
        .when(has("reflection") | F.contains(t, F.lit("reflection")), "reflection")
        .when(has("retrospective") | F.contains(t, F.lit("retrospective")), "retrospective")
        .otherwise("issue")
    )


SAID = re.compile(r"learnings?:\s*(.+)$", re.I)
#: Headings over bullets that are learnings.
HEADINGS = frozenset(("learnings", "key learnings", "lessons learned"))


def issue_learnings(body: str) -> list[str]:
    """Learnings of an issue text: what follows `Learning:` on a line, and the bullets right under a heading; distinct, by letters."""
    found, under = set(), False
    for line in map(str.strip, body.splitlines()):
        if said := SAID.match(line):
            found.add(said[1].strip())
            under = False
        elif line.lower().rstrip(":") in HEADINGS:
            under = True
        elif under and line[:1] in ("-", "*"):
            found |= {line[1:].strip()} - {""}
        else:
            under = False
    return sorted(found, key=lambda x: (x.lower(), x))


def _plain(values) -> list[str]:
    return [v.strip().lower() for v in values or () if v.strip()]


def matching(envelopes: DataFrame, version: str, source_type: str | None = None, categories=None, labels=None, repos=None) -> DataFrame:
    """(chunk_id, records): normalised records of envelopes of a version that fit, in order, as text; envelopes without any are left out.

    envelopes: chunk_id, version, records (type, category, labels, repo). Categories ask only of friction records, labels and repositories
    only of history records; records of other types, or without their category or repository, do not count.
    """
    low = lambda c: F.lower(F.btrim(c))
    names = lambda r: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(r["labels"], F.array().cast("array<string>")), low), lambda x: x != "")))
    wanted = {k: F.array(*map(F.lit, _plain(v))) for k, v in (("categories", categories), ("labels", labels), ("repos", repos)) if v is not None}

    def fits(r) -> Column:
        friction, history = r["type"] == "friction", r["type"] == "history"
        ok = (friction & r["category"].isNotNull()) | (history & r["repo"].isNotNull())
        if source_type:
            ok = ok & (r["type"] == source_type)
        if "categories" in wanted:
            ok = ok & (history | F.array_contains(wanted["categories"], low(r["category"])))
        if "labels" in wanted:
            ok = ok & (friction | F.arrays_overlap(names(r), wanted["labels"]))
        if "repos" in wanted:
            ok = ok & (friction | F.array_contains(wanted["repos"], low(r["repo"])))
        return F.coalesce(ok, F.lit(False))

    text = lambda r: F.when(r["type"] == "friction", F.concat(F.lit("friction:"), low(r["category"]))).otherwise(F.concat_ws(":", F.lit("history"), F.array_join(names(r), ","), low(r["repo"])))
    rows = envelopes.where(F.col("version") == version)
    found = rows.select("chunk_id", F.array_sort(F.transform(F.filter("records", fits), text)).alias("records"))
    return found.where(F.size("records") > 0)
