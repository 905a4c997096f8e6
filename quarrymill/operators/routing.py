"""Routing and expansion of queries and files by tables of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of documentation queries and what they widen to.
EXPANSIONS = {
    "install": ("installation", "setup", "getting started", "requirements"),
    "config": ("configuration", "configure", "settings", "options", "parameters"),
    "api": ("api documentation", "api reference", "endpoint", "method"),
    "how to": ("tutorial", "guide", "example", "usage"),
    "example": ("sample", "snippet", "demo", "code example"),
    "error": ("troubleshoot", "debug", "issue", "problem", "fix"),
    "getting started": ("quickstart", "tutorial", "introduction", "setup"),
    "guide": ("tutorial", "documentation", "walkthrough", "how to"),
    "usage": ("how to use", "example", "api", "reference"),
}
#: Words that are no topic, and the forms that a topic is looked for in.
NO_TOPIC = ("how", "to", "the", "a", "an", "is", "are", "what", "where", "when")
TOPIC_FORMS = ("README %s", "%s documentation", "%s docs", "%s guide")
MOST_VARIANTS, APPENDED = 10, 2


def _replacing(text: Column, term: str):
    return lambda related: F.replace(text, F.lit(term), related)


def expansions(query: Column, is_document: Column) -> Column:
    """Distinct variants of a query, itself first: terms replaced, related terms appended, and forms of its topic; ten at most."""
    lowered = F.lower(query)
    variants = [F.array(query)]
    for term, related in EXPANSIONS.items():
        words = F.array(*map(F.lit, related))
        replaced = F.transform(words, _replacing(lowered, term))
        appended = F.transform(F.slice(words, 1, APPENDED), lambda r: F.concat_ws(" ", query, r))
        both = F.concat(F.filter(replaced, lambda x: x != lowered), appended)
        variants.append(F.when(F.contains(lowered, F.lit(term)), both).otherwise(F.array().cast("array<string>")))
    words = F.filter(F.split(F.btrim(F.regexp_replace(lowered, r"\s+", " ")), " "), lambda w: ~w.isin(*NO_TOPIC) & (w != ""))
    topic = F.array_join(F.slice(words, 1, 2), " ")
    forms = F.transform(F.array(*map(F.lit, TOPIC_FORMS)), lambda form: F.replace(form, F.lit("%s"), topic))
    variants.append(F.when(is_document & (F.size(words) > 0), forms).otherwise(F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.concat(*variants)), 1, MOST_VARIANTS)


#: Rules of branch expansion: all these words in a query add these terms, in the named branches.
BRANCH_RULES = (({"artifact", "push", "pull", "delta", "resolution"}, "resolve resolver delta chain base_commit target_commit full artifact", ("bm25", "semantic")),)


def branch_query(query: Column, branch: Column, rules=BRANCH_RULES) -> Column:
    """The query as a branch is asked it."""
    words = F.filter(F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9_]+)"), 1), lambda w: F.length(w) >= 3)
    out = query
    for wanted, added, branches in rules:
        all_there = F.size(F.array_intersect(F.array(*map(F.lit, sorted(wanted))), words)) == len(wanted)
        out = F.when(all_there & branch.isin(*branches), F.concat_ws(" ", query, F.lit(added))).otherwise(out)
    return out


#: What adds to the confidence that a parser suits a file.
SUPPORTS, SAME_LANGUAGE, PART_LANGUAGE, SAME_SUFFIX = 0.3, 0.5, 0.3, 0.2


def route_files(files: DataFrame, parsers: DataFrame) -> DataFrame:
    """(file_id, parser, confidence, choice from 1) of every parser that supports a file.

    files: file_id, suffix, language; parsers: parser, language, suffixes, seconds (mean time), uses. A parser supports the
    files of its language or suffixes, or any file where no other does and it names neither. parsers is a configuration table.
    """
    from pyspark.sql import Window as W

    total = parsers.agg(F.sum("uses").alias("total"))  # one row
    small = parsers.select("parser", F.col("language").alias("speaks"), "suffixes", "seconds", "uses").join(F.broadcast(total))
    same = F.coalesce(F.col("speaks") == F.col("language"), F.lit(False))
    within = F.coalesce(F.contains(F.lower("language"), F.lower("speaks")), F.lit(False))
    suffix = F.coalesce(F.array_contains("suffixes", F.col("suffix")), F.lit(False))
    general = F.col("speaks").isNull() & (F.size("suffixes") == 0)
    score = F.lit(SUPPORTS) + F.when(same, SAME_LANGUAGE).when(within, PART_LANGUAGE).otherwise(0.0) + F.when(suffix, SAME_SUFFIX).otherwise(0.0)
    score = score + F.when(F.col("seconds") > 0, F.greatest(F.lit(0.0), (2.0 - F.col("seconds")) / 10)).otherwise(0.0)
    score = score - F.when(F.col("uses") > 10, F.least(F.lit(0.1), F.col("uses") / F.col("total") * 0.2)).otherwise(0.0)
    pairs = files.join(F.broadcast(small), same | within | suffix | general)  # as many parsers as are configured
    scored = pairs.select("file_id", "parser", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6).alias("confidence"), general.alias("general"), "uses")
    special = F.max(F.when(~F.col("general"), 1).otherwise(0)).over(W.partitionBy("file_id"))
    kept = scored.withColumn("special", special).where("special = 0 OR NOT general")
    order = W.partitionBy("file_id").orderBy(F.desc("confidence"), "uses", "parser")
    return kept.select("file_id", "parser", "confidence", F.row_number().over(order).alias("choice"))
