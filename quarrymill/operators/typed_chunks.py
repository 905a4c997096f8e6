"""Chunkers of documents by their type: API references by endpoint, tutorials by step, readme files by section."""

from __future__ import annotations

import re

from . import chunking

#: Lines that open an endpoint or a step, and sections that are kept whole.
ENDPOINT = re.compile(r"^(?:GET|POST|PUT|DELETE|PATCH)\s+/[^\n]+", re.M)
STEP = re.compile(r"^(?:Step\s+\d+|First|Second|Third|Next|Then|Finally)[:\s][^\n]+", re.M | re.I)
KEPT_SECTIONS = ("installation", "quick start", "usage", "getting started", "requirements", "features", "examples")


def at_matches(text: str, pattern: re.Pattern) -> list[str]:
    """The text from each match to the next; what stands before the first is no chunk."""
    starts = [m.start() for m in pattern.finditer(text)]
    return [part for a, b in zip(starts, [*starts[1:], len(text)]) if (part := text[a:b].strip())]


def by_endpoint(text: str, limit: int = 1500) -> list[str]:
    parts = at_matches(text, ENDPOINT)
    if not parts:
        return chunking.by_sentence(text, limit)
    return [c for p in parts for c in ([p] if chunking.tokens(p) <= limit else chunking.pack(p.split("\n"), limit, joint="\n"))]


def by_step(text: str, limit: int = 1500) -> list[str]:
    return at_matches(text, STEP) or by_section(text, limit)


def spans(text: str) -> list[tuple[str, str]]:
    """(title, own text) of each heading with the lines up to the next heading; lines before the first have no title."""
    lines, found = text.split("\n"), chunking.sections(text)
    edges = [s["start"] - 1 for s in found] + [len(lines)]
    out = [("", "\n".join(lines[: edges[0]]))] if edges[0] else []
    return [x for x in [*out, *((s["title"], "\n".join(lines[a:b])) for s, a, b in zip(found, edges, edges[1:]))] if x[1].strip()]


def by_section(text: str, limit: int = 1500) -> list[str]:
    """A chunk for each section that fits, others split at sentences; small neighbours are not joined."""
    return [c for _, body in spans(text) for c in ([body.strip()] if chunking.tokens(body) <= limit else chunking.pack(chunking.sentences(body), limit))]


def by_readme(text: str, limit: int = 1500) -> list[str]:
    """Sections; an important one stays whole with its sub-sections while a fifth over the limit."""
    found, lines, out, done = chunking.sections(text), text.split("\n"), [], 0
    if not found:
        return chunking.by_sentence(text, limit)
    for s in found:
        if s["start"] <= done:
            continue
        whole = "\n".join(lines[s["start"] - 1 : s["end"]])
        if any(k in s["title"].lower() for k in KEPT_SECTIONS) and chunking.tokens(whole) <= 1.2 * limit:
            out.append(whole.strip())
            done = s["end"]
        else:
            nearest = min((x["start"] for x in found if x["start"] > s["start"]), default=len(lines) + 1)
            out += by_section("\n".join(lines[s["start"] - 1 : nearest - 1]), limit)
    return out


for _name, _cut in (("api", by_endpoint), ("tutorial", by_step), ("readme", by_readme), ("section", by_section)):
    chunking.register(_name, _cut)
