"""Inverted-index operators: postings, term statistics and BM25 ranking."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranking constants of the BM25 formula.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def _plain_letters() -> tuple[str, str]:
    """Letters of the alphabetic blocks whose decomposition is one base letter and marks, and those base letters."""
    pairs = []
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.category(c) == "Mn" for c in parts[1:]):
            pairs.append((chr(code), parts[0]))
    marks = "".join(map(chr, range(0x300, 0x370)))  # without a partner in the other string they are dropped
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _plain_letters()


def tokens(text: Column) -> Column:
    """Runs of Unicode letters and digits, in lower case and without accents."""
    return F.regexp_extract_all(F.translate(F.lower(text), _ACCENTED, _PLAIN), F.lit(r"([\p{L}\p{N}]+)"), 1)


def term_frequency(tokens_col: str, term: str) -> Column:
    return F.size(F.filter(tokens_col, lambda x: x == F.lit(term)))


def idf(n: Column, df: Column) -> Column:
    raw = F.ln((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR))


def bm25_scores(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, score) of documents holding any of the terms; lower is better.

    Corpus statistics and term frequencies come from one scan each; only per-document counts of
    the query's own terms are kept, so nothing that grows with the vocabulary is shuffled.
    """
    counted = docs.select(F.col(key), tokens(F.col(text)).alias("t")).select(
        key,
        F.size("t").alias("dl"),
        *[term_frequency("t", q).alias(f"tf{i}") for i, q in enumerate(terms)],
    )
    stats = counted.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("dl").alias("avgdl"),
        *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
    )
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"tf{i}")
        part = idf(F.col("n"), F.col(f"df{i}")) * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * F.col("dl") / F.col("avgdl")))
        score = score + F.when(tf > 0, part).otherwise(0.0)
    hit = counted.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms))))
    return hit.join(F.broadcast(stats)).select(key, (-score).alias("score"))  # stats: one row


def bm25_top(docs: DataFrame, key: str, text: str, terms: list[str], k: int) -> DataFrame:
    ranked = bm25_scores(docs, key, text, terms).select(key, F.round("score", 6).alias("score"))
    return ranked.orderBy("score", key).limit(k)


# -- inverted index ----------------------------------------------------------------------------


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, positions) of every document: the inverted index as a table."""
    exploded = docs.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "term"))
    return exploded.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def document_lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.size(tokens(F.col(text))).alias("dl"))


def term_statistics(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """For each term: document frequency, documents, share and the two idf forms, from one scan."""
    t = docs.select(tokens(F.col(text)).alias("t"), F.length(text).alias("chars"))
    one = t.agg(F.count(F.lit(1)).alias("n"), F.avg("chars").alias("avg_chars"), *[F.count_if(F.array_contains("t", q)).alias(f"d{i}") for i, q in enumerate(terms)])
    rows = F.explode(F.array(*[F.struct(F.lit(q).alias("term"), F.col(f"d{i}").alias("df")) for i, q in enumerate(terms)])).alias("x")
    n, df = F.col("n"), F.col("x.df")
    return one.select("n", "avg_chars", rows).select(
        F.col("x.term").alias("term"), df.alias("df"), "n",
        F.round(F.when(df > 0, F.ln((n + 1) / (df + 1))).otherwise(0.0), 6).alias("smooth_idf"),
        F.round(F.when(df > 0, F.ln((n - df + 0.5) / (df + 0.5))).otherwise(0.0), 6).alias("okapi_idf"),
        F.round(100.0 * df / n, 6).alias("percent"), F.round("avg_chars", 6).alias("avg_chars"),
    )


def spaced(tokens_col: str) -> Column:
    """The tokens as one string with a space around each, so that a test of it is linear wherever a filter is pushed."""
    return F.concat(F.lit(" "), F.array_join(tokens_col, " "), F.lit(" "))


def contains_phrase(tokens_col: str, phrase: list[str]) -> Column:
    """True if the tokens hold the words of the phrase one after another."""
    return F.contains(spaced(tokens_col), F.lit(f" {' '.join(phrase)} "))


def near(tokens_col: str, first: str, second: str, distance: int) -> Column:
    """True if both terms occur with at most `distance` tokens between them, in either order."""
    between = r"(?: [^ ]+){0,%d} " % distance
    return spaced(tokens_col).rlike(f" {first}{between}{second} | {second}{between}{first} ")


def prefix_matches(docs: DataFrame, key: str, text: str, prefix: str) -> DataFrame:
    hit = F.filter(tokens(F.col(text)), lambda t: F.startswith(t, F.lit(prefix)))
    return docs.select(key, F.size(hit).alias("hits"), F.size(F.array_distinct(hit)).alias("terms")).where("hits > 0")


def all_terms(tokens_col: str, terms: list[str]) -> Column:
    return F.forall(F.array(*[F.lit(t) for t in terms]), lambda t: F.array_contains(tokens_col, t))


def any_term(tokens_col: str, terms: list[str]) -> Column:
    return F.arrays_overlap(tokens_col, F.array(*[F.lit(t) for t in terms]))


def highlight(text: Column, terms: list[str], opening: str, closing: str) -> Column:
    """The text with marks around whole-word hits."""
    return F.regexp_replace(text, r"(?i)\b(" + "|".join(terms) + r")\b", f"{opening}$1{closing}")


def snippet(text: Column, terms: list[str], width: int, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """`width` tokens around the first hit, with marks, and dots where text was left out."""
    words = F.split(F.btrim(text), r"\s+")
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9_]", ""))
    wanted = F.array(*[F.lit(t) for t in terms])
    at = F.coalesce(F.array_min(F.filter(F.transform(plain, lambda w, i: F.when(F.array_contains(wanted, w), i)), lambda i: i.isNotNull())), F.lit(0))
    start = F.greatest(at - F.lit(width // 2), F.lit(0))
    part = F.slice(words, start + 1, width)
    marked = F.transform(part, lambda w: F.when(F.array_contains(wanted, F.regexp_replace(F.lower(w), "[^a-z0-9_]", "")), F.concat(F.lit(opening), w, F.lit(closing))).otherwise(w))
    return F.concat(F.when(start > 0, "...").otherwise(""), F.array_join(marked, " "), F.when(F.size(words) > start + width, "...").otherwise(""))


def file_fields(files: DataFrame) -> DataFrame:
    """The text columns of a file's index row: place, name, content, language, and the symbols, imports and comments of the content."""
    every = lambda pattern: F.array_join(F.regexp_extract_all("content", F.lit(pattern), 1), " ")
    return files.select(
        "file_id", F.col("path").alias("filepath"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content", "language",
        every(r"(?m)^[ \t]*(?:def|class|function|func|fn|struct|interface)[ \t]+(\w+)").alias("symbols"),
        every(r"(?m)^[ \t]*(?:import|from|use|require|#include)[ \t]+([\w./<>\"]+)").alias("imports"),
        every(r"(?m)(?:^|[ \t])(?:#|//)[ \t]*([^\n]+)$").alias("comments"),
    )
