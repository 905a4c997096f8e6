"""Sequential text analysis: sentences with abbreviations, paragraphs, structure, topics."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import pack, paragraphs, tokens

#: Abbreviations that do not end a sentence.
ABBREVIATIONS = frozenset("mr. mrs. ms. dr. prof. sr. jr. st. vs. etc. inc. ltd. co. corp. e.g. i.e. fig. no. vol. pp. approx. dept.".split())


def sentences(text: str) -> list[str]:
    """Sentences by words: a word ends one if it closes with . ! or ?, is no abbreviation or number, and the next does not start small."""
    words, out, held = text.split(), [], []
    for word, following in zip(words, [*words[1:], ""]):
        held.append(word)
        bare = word.rstrip("\"')]”’")
        ends = bare[-1:] in ".!?" and bare.lower() not in ABBREVIATIONS and not re.fullmatch(r"\d+\.", bare)
        if ends and not following[:1].islower():
            out.append(" ".join(held))
            held = []
    return [*out, " ".join(held)] if held else out


def blocks(text: str) -> list[tuple[str, int, int]]:
    """(kind, first line, last line): headings, fenced code, lists, quotes and paragraphs."""
    out: list[list] = []
    fenced = False
    for number, line in enumerate(text.split("\n"), 1):
        bare = line.strip()
        if bare.startswith("```"):
            kind = "code"
            if fenced:
                out[-1][2] = number
                fenced = False
                continue
            fenced = True
            out.append([kind, number, number])
            continue
        if fenced:
            out[-1][2] = number
            continue
        if not bare:
            out.append(["blank", number, number])
            continue
        kind = "heading" if re.match(r"#{1,6}\s", bare) else "list" if re.match(r"([-*+•]|\d+[.)])\s", bare) else "quote" if bare[0] == ">" else "paragraph"
        if out and out[-1][0] == kind and kind != "heading":
            out[-1][2] = number
        else:
            out.append([kind, number, number])
    return [tuple(b) for b in out if b[0] != "blank"]


def boundaries(text: str) -> list[tuple[int, float]]:
    """(offset, strength) of strong, medium and weak breaks, those within ten characters of a stronger one left out."""
    levels = ((1.0, r"^#{1,6}\s|^={3,}$|^-{3,}$"), (0.6, r"\n\s*\n"), (0.3, r"(?<=[.!?])\s+(?=[A-Z])"))
    kept: list[tuple[int, float]] = []
    for strength, pattern in levels:
        before, new = [at for at, _ in kept], []
        for m in re.finditer(pattern, text, re.M):
            at = m.start()
            i = bisect_left(before, at)
            if all(abs(at - x) > 10 for x in [*before[max(i - 1, 0) : i + 1], *new[-1:]]):
                new.append(at)
        kept = sorted([*kept, *((at, strength) for at in new)])
    return kept


def topics(text: str, words: int = 50, most: int = 5) -> list[list[str]]:
    """Greedy groups of frequent words that share sentences; each word is in one group."""
    count = Counter(w for w in re.findall(r"\w{4,}", text.lower()))
    ranked = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:words]]
    together: Counter = Counter()
    for sentence in text.lower().split("."):
        here = [w for w in ranked if w in sentence]
        together.update((a, b) for a in here for b in here if a != b)
    out, used = [], set()
    for seed in ranked:
        if seed in used or len(out) == most:
            continue
        near = sorted((w for w in ranked if w not in used and w != seed and together[seed, w]), key=lambda w: (-together[seed, w], w))[:4]
        if len(near) >= 2:
            out.append([seed, *near])
            used.update(out[-1])
    return out


def coherent(parts: list[str], threshold: float = 0.7) -> list[str]:
    """Moves the first sentence of a part to the one before where their edges share too few words."""
    out = parts[:1]
    for part in parts[1:]:
        a, b = (set(re.findall(r"\w+", x.lower())) for x in (out[-1][-200:], part[:200]))
        found = re.search(r"[.!?]\s+", part)
        if a and b and len(a & b) / len(a | b) < threshold and found and found.end() < len(part) // 4:
            out[-1] += " " + part[: found.end()].strip()
            part = part[found.end() :]
        out.append(part)
    return out


def merged(parts: list[str], limit: int, joint: str = " ") -> list[str]:
    """Neighbours joined while together they stay within `limit` tokens."""
    out: list[str] = []
    for part in parts:
        if out and tokens(out[-1]) + tokens(part) <= limit:
            out[-1] += joint + part
        else:
            out.append(part)
    return out


def semantic_chunks(text: str, target: int = 500) -> list[str]:
    """Paragraphs, long ones split at sentences, of about `target` characters."""
    return [c for p in paragraphs(text) for c in ([p] if len(p) <= 1.5 * target else pack(sentences(p), target * 3 // 4))]


def analyse(text: str) -> dict:
    """Counts and ratios that describe a text."""
    found, words = sentences(text), text.lower().split()
    kinds = Counter(k for k, _, _ in blocks(text))
    return {
        "sentences": len(found), "words": len(words), "distinct": len(set(words)), "paragraphs": len(paragraphs(text)),
        "headings": kinds["heading"], "lists": kinds["list"], "questions": sum(s.endswith("?") for s in found), "topics": len(topics(text)),
    }


def table(docs: DataFrame, rows, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A table function: `rows` gives tuples for one text; null texts count as empty."""
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(schema).names
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made = [(k, *r) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in rows(t or "")]
            if made:
                yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(["k", *names], zip(*made))}, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(f"k {kind}, {schema}"))
    picked = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"k {kind}, {schema}").withColumnRenamed("k", key)
