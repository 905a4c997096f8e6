"""Scalar functions of search text: terms, trigrams, query tests, token estimates, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """Distinct lower-cased 3-grams of the text padded by two spaces on each side."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit("  "))
    # A look-ahead matches at every position, so the padded text is built and read once.
    return F.array_distinct(F.regexp_extract_all(padded, F.lit("(?s)(?=(.{3}))"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays of distinct values; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every > 0, shared / every).otherwise(F.lit(0.0))


def query_terms(query: Column, least: int = 3) -> Column:
    """Lower-cased identifier terms, camel case parted, of at least `least` characters."""
    parted = F.regexp_replace(query, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.regexp_extract_all(F.lower(parted), F.lit("([a-z0-9_]+)"), 1), lambda t: F.length(t) >= least)


def symbol_precise(query: Column) -> Column:
    """True for queries that name a definition, a capitalised word or a snake-case word."""
    return (
        query.rlike(r"\b(class|def|function|method|symbol)\s+[A-Za-z_][A-Za-z0-9_]*")
        | query.rlike(r"\b[A-Z][A-Za-z0-9_]{2,}\b")
        | query.rlike(r"\b[a-z]+_[a-z0-9_]+\b")
    )


def symbol_candidates(query: Column) -> Column:
    """Identifiers that a query may look up: after a keyword first, then those with capitals or underscores."""
    after = F.regexp_extract(query, r"\b(?:class|def|function|method|symbol)\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    words = F.regexp_extract_all(query, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1)
    marked = F.filter(words, lambda w: w.rlike("[A-Z]") | F.contains(w, F.lit("_")))
    return F.array_distinct(F.concat(F.when(after != "", F.array(after)).otherwise(F.array().cast("array<string>")), marked))


#: Keywords that lead a definition query, with the kind that they ask for.
DEFINITION_KINDS = (
    ("class", "class"), ("def", "function"), ("function", "function"), ("func", "function"), ("interface", "interface"),
    ("struct", "struct"), ("type", "type"), ("enum", "enum"), ("(?:const|var|let)", None),
)


def intent(query: Column) -> Column:
    """struct(intent, name, kind): symbol look-up or lexical search; the first rule that fits decides."""
    q = F.btrim(query, F.lit(" \t\r\n\x0b\f"))

    def found(name, kind):
        return F.struct(F.lit("symbol").alias("intent"), name.alias("name"), F.lit(kind).cast("string").alias("kind"))

    out = None
    for word, kind in DEFINITION_KINDS:
        pattern = rf"(?i)^{word}\s+([A-Za-z_][A-Za-z0-9_]*)"
        test, value = q.rlike(pattern), found(F.regexp_extract(q, pattern, 1), kind)
        out = F.when(test, value) if out is None else out.when(test, value)
    out = out.when(q.rlike("^[A-Z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*$"), found(q, "class"))
    out = out.when(q.rlike("^[A-Z][A-Z0-9_]{2,}$"), found(q, None))
    out = out.when(q.rlike("^[a-z_][a-z0-9_]*$") & F.contains(q, F.lit("_")) & (F.length(q) > 3), found(q, "function"))
    out = out.when(q.rlike(r"^[A-Za-z_]\w*\.[A-Za-z_]\w*$"), found(F.element_at(F.split(q, r"\."), -1), None))
    return out.otherwise(F.struct(F.lit("lexical").alias("intent"), q.alias("name"), F.lit(None).cast("string").alias("kind")))


def code_intent(query: Column) -> Column:
    """True if a query asks for code rather than prose."""
    q = F.lower(query)
    return (
        q.rlike(r"\b(class|def|function|method|symbol|module|file|filepath)\b")
        | q.rlike(r"\b(py|python|js|ts|typescript|javascript|treesitter|tree-sitter)\b")
        | q.rlike(r"\b(where is|how does|how do|implemented|implementation|extract|validate)\b")
        | q.rlike(r"\.[a-z0-9]{1,6}\b")
    )


def stem(path: Column) -> Column:
    """File name without its last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.when(F.contains(path, F.lit(".")), F.lower(F.element_at(F.split(path, r"\."), -1))).otherwise(F.lit(""))


def estimate_tokens(text: Column, factor: float = 0.75) -> Column:
    """Characters times a factor, more for code words and for dense punctuation."""
    code = r"\b(def|function|class|import|from|return|if|else|for|while|try|except|catch|throw|public|private|protected|static|const|let|var|async|await)\b"
    n = F.length(text)
    marks = n - F.length(F.translate(text, ".,;:()[]{}", ""))
    value = n * F.lit(factor) * F.when(F.regexp_count(text, F.lit(code)) >= 3, 1.2).otherwise(1.0) * F.when(marks / F.greatest(n, F.lit(1)) > 0.1, 1.1).otherwise(1.0)
    return F.when(F.btrim(text, F.lit(" \t\r\n\x0b\f")) == "", 0).otherwise(F.floor(value)).cast("long")


def count_tokens(text: Column) -> Column:
    """A quarter of the characters and a tenth of the white space, at least 1."""
    n = F.length(text)
    spaces = n - F.length(F.translate(text, " \t\r\n\x0b\f", ""))
    return F.greatest(F.lit(1), F.floor(n / 4) + F.floor(spaces / 10)).cast("long")


def slug(title: Column) -> Column:
    kept = F.regexp_replace(F.lower(title), r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[\s-]+", "-"), "^-+|-+$", "")


def glob_regex(pattern: str) -> str:
    """A file glob as an anchored regular expression."""
    out = ""
    for c in pattern:
        out += ".*" if c == "*" else "." if c == "?" else "\\" + c if c in ".^$+{}()[]|\\" else c
    return f"^{out}$"


def point_id(*parts: Column) -> Column:
    """Unsigned 64-bit id from the first eight bytes of a SHA-1."""
    return F.conv(F.substring(F.sha1(F.concat_ws(":", *parts)), 1, 16), 16, 10).cast("decimal(20,0)")
