"""Adjustments and multipliers by path, query terms and document type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extension, query_terms, stem, symbol_precise


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.lower(F.translate(path, "\\", "/")), r"^[./]+", "")


@dataclass(frozen=True)
class PathAdjustment:
    """Additions to a score where lower is better."""

    init_file: float
    test_file: float
    stem_term: float
    path_term: float


#: Adjustments of the two lexical indexes.
CODE_INDEX = PathAdjustment(0.45, 0.7, 0.22, 0.08)
CONTENT_INDEX = PathAdjustment(1.2, 1.4, 0.45, 0.16)


def path_adjustment(query: Column, path: Column, rule: PathAdjustment) -> Column:
    p = normal_path(path)
    terms = query_terms(query)
    name, tokens = stem(p), F.regexp_extract_all(p, F.lit("([a-z0-9_]+)"), 1)
    in_name = F.size(F.filter(terms, lambda t: F.contains(name, t)))
    in_path = F.size(F.filter(terms, lambda t: F.array_contains(tokens, t)))
    init = F.when(p.rlike(r"(^|/)__init__\.py$"), rule.init_file).otherwise(0.0)
    test = F.when(symbol_precise(query) & p.rlike("(^|/)tests/"), rule.test_file).otherwise(0.0)
    return init + test - F.least(in_name, F.lit(3)) * rule.stem_term - F.least(in_path, F.lit(4)) * rule.path_term


#: Penalties of path segments, the first that fits.
SEGMENT_PENALTIES = (("htmlcov/", 10.0), ("docs/benchmarks/", 10.0), ("/tests/", 0.3), ("makefile", 0.5))


def path_penalty(path: Column) -> Column:
    p = F.lower(F.translate(path, "\\", "/"))
    out = None
    for segment, value in SEGMENT_PENALTIES:
        test = F.contains(p, F.lit(segment))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.when(p.endswith(".json"), 0.5).otherwise(0.0)


def stem_boost(query: Column, path: Column) -> Column:
    terms = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9_]+)"), 1))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(stem(path)), F.lit("([a-z0-9]+)"), 1))
    return -F.least(F.size(F.array_intersect(terms, tokens)), F.lit(3)) * 0.6


#: Factors by file class; `code` ones apply to queries with code intent.
FACTORS = {"impl": 1.15, "script": 1.05, "plan": 0.45, "test": 0.75, "doc": 0.7, "benchmark": 0.85}
CODE_FACTORS_HYBRID = {"impl": 1.2, "script": 1.1, "test": 0.55, "doc": 0.35, "benchmark": 0.7}
CODE_FACTORS_SEMANTIC = {"impl": 1.25, "script": 1.1, "plan": 0.2, "test": 0.55, "doc": 0.35, "benchmark": 0.7}
CODE_EXTENSIONS = "py js ts tsx jsx go rs java kt swift c cpp h hpp cs rb php scala dart html css scss sql".split()
PROSE_EXTENSIONS = "md txt rst".split()
CONFIG_EXTENSIONS = "json yaml yml toml ini cfg".split()


def path_multiplier(path: Column, code_intent: Column, code_factors: dict, plans: bool, implementation: tuple[str, ...] = ("src/",)) -> Column:
    """Product of the path class's prior, the benchmark factor, and those for code intent."""
    p = normal_path(path)
    has = {
        "impl": p.rlike("^(" + "|".join(implementation) + ")"),
        "script": p.startswith("scripts/"),
        "plan": p.rlike("(^|/)plans/") if plans else F.lit(False),
        "test": p.rlike("(^|/)tests/"),
        "doc": p.rlike(r"^(docs|ai_docs|architecture)/|readme\.(md|rst|txt)$"),
        "benchmark": p.rlike("(^|/)benchmarks/"),
    }
    prior = None
    for kind in ("impl", "script", "plan", "test", "doc"):
        prior = F.when(has[kind], FACTORS[kind]) if prior is None else prior.when(has[kind], FACTORS[kind])
    out = prior.otherwise(1.0) * F.when(has["benchmark"], FACTORS["benchmark"]).otherwise(1.0)
    for kind, factor in code_factors.items():
        test = has[kind] & ~has["impl"] if kind == "script" else has[kind]
        out = out * F.when(code_intent & test, factor).otherwise(1.0)
    return out


def overlap_multiplier(query: Column, path: Column, content: Column, content_step: float, path_step: float = 0.08) -> Column:
    terms = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9_]+)"), 1), lambda t: F.length(t) >= 3))
    flat = F.btrim(F.regexp_replace(F.lower(path), "[^a-z0-9]+", " "))
    text = F.lower(content)
    hits = F.size(F.filter(terms, lambda t: F.contains(text, t)))
    path_hits = F.size(F.filter(terms, lambda t: F.contains(flat, t)))
    return F.lit(1.0) + F.least(hits, F.lit(5)) * content_step + F.least(path_hits, F.lit(4)) * path_step


def extension_multiplier(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(CODE_EXTENSIONS), 1.2).when(e.isin(PROSE_EXTENSIONS), 0.5).when(e.isin(CONFIG_EXTENSIONS), 0.8).otherwise(1.0)


def file_class(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(CODE_EXTENSIONS), "code").when(e.isin(PROSE_EXTENSIONS), "prose").otherwise("other")


def min_max(score: Column, low: float, high: float) -> Column:
    if high <= low:
        return F.lit(0.5)
    return (F.greatest(F.lit(low), F.least(F.lit(high), score)) - low) / (high - low)
