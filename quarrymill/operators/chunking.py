"""Document chunkers whose state runs along a text: Arrow-batched table functions, one text at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.session import small_batches

#: Characters of chunks that a task holds at a time.
ROUND_CHARS = 1 << 20
CODE_SPAN = re.compile(r"```.*?```|`[^`]+`", re.S)
SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z])|(?<=\n)\n+|(?<=[\])])\s*\n")
BLANK_LINE = re.compile(r"\n\s*\n")
#: Words and heading forms that open a new topic.
TOPIC = re.compile(
    r"\b(?:however|moreover|furthermore|therefore|consequently|thus|hence|introduction|conclusion|summary|overview|background|"
    r"first|second|third|finally|next|then|additionally)\b|^#+\s+|^\d+\.\s+[A-Z]",
    re.I | re.M,
)
CODE_WORDS = re.compile(r"\b(?:def|function|class|import|from|return|if|else|for|while|try|except|catch|throw|public|private|protected|static|const|let|var|async|await)\b")


def tokens(text: str) -> int:
    """The estimate of functions.text.estimate_tokens for one string."""
    if not text.strip():
        return 0
    value = len(text) * 0.75
    if len(CODE_WORDS.findall(text)) >= 3:
        value *= 1.2
    if sum(map(text.count, ".,;:()[]{}")) / len(text) > 0.1:
        value *= 1.1
    return int(value)


def sentences(text: str) -> list[str]:
    """Sentences, with code spans kept in one piece."""
    spans = [m.span() for m in CODE_SPAN.finditer(text)]
    cuts = [m.span() for m in SENTENCE_END.finditer(text) if not any(a < m.end() and m.start() < b for a, b in spans)]
    edges = [0, *(x for cut in cuts for x in cut), len(text)]
    return [s for a, b in zip(edges[::2], edges[1::2]) if (s := text[a:b].strip())]


def paragraphs(text: str) -> list[str]:
    return [p.strip() for p in BLANK_LINE.split(text) if p.strip()]


def topic_starts(text: str) -> list[int]:
    return sorted({m.start() for p in (TOPIC, BLANK_LINE) for m in p.finditer(text)})


def pack(units: Iterable[str], limit: int, overlap: int = 0, joint: str = " ") -> list[str]:
    """Units joined up to `limit` tokens; a new chunk repeats the last units worth `overlap` tokens."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for unit in units:
        n = tokens(unit)
        if held and size + n > limit:
            out.append(joint.join(held))
            kept, spare = [], overlap
            for last in reversed(held):
                spare -= tokens(last)
                if spare < 0:
                    break
                kept.insert(0, last)
            held, size = kept, sum(map(tokens, kept))
        held.append(unit)
        size += n
    return [*out, joint.join(held)] if held else out


def by_sentence(text: str, limit: int = 1500, overlap: int = 150) -> list[str]:
    return pack(sentences(text), limit, overlap)


def by_paragraph(text: str, least: int = 100) -> list[str]:
    """Paragraphs; one that is short takes up the next while both stay under three times the least size."""
    out: list[str] = []
    for p in paragraphs(text):
        if out and tokens(out[-1]) < least and tokens(out[-1]) + tokens(p) < 3 * least:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def by_topic(text: str, limit: int = 1500) -> list[str]:
    edges = [0, *topic_starts(text), len(text)]
    if len(edges) == 2:
        return by_paragraph(text)
    parts = (text[a:b].strip() for a, b in zip(edges, edges[1:]))
    return [c for p in parts if p for c in ([p] if tokens(p) <= limit else pack(sentences(p), limit))]


def balanced(parts: list[str], limit: int) -> list[str]:
    """Small parts joined, large ones split at sentences."""
    out: list[str] = []
    for part in parts:
        pieces = [part] if tokens(part) <= limit else pack(sentences(part), limit)
        for i, piece in enumerate(pieces):
            if out and i == 0 and tokens(out[-1]) + tokens(piece) < limit:
                out[-1] += "\n\n" + piece
            else:
                out.append(piece)
    return out


def split_points(text: str, target: int) -> list[int]:
    """Positions near multiples of `target`: at a paragraph, else a sentence, else a word, else by force."""
    out, at = [], 0
    while at + int(target * 1.2) < len(text):
        low, high = at + int(target * 0.8), at + int(target * 1.2)
        window = text[low:high]
        for pattern, place in ((BLANK_LINE, lambda m: m.start() + 1), (re.compile(r"[.!?]\s+"), re.Match.end), (re.compile(r"\s+"), re.Match.start)):
            found = pattern.search(window)
            if found and low + place(found) > at:
                at = low + place(found)
                break
        else:
            at = high
        out.append(at)
    return out


def sliding(text: str, size: int = 512, overlap: int = 2) -> list[str]:
    """Windows of whole sentences of about `size` characters that share `overlap` sentences."""
    units, out, i = sentences(text), [], 0
    while i < len(units):
        j, n = i, 0
        while j < len(units) and (j == i or n + len(units[j]) <= size):
            n += len(units[j])
            j += 1
        out.append(" ".join(units[i:j]))
        if j == len(units):
            break
        i = max(j - overlap, i + 1)
    return out


def sections(text: str) -> list[dict]:
    """Markdown headings with level, parent and line span; code fences hold no headings."""
    lines, out, stack, fenced = text.split("\n"), [], [], False
    for number, line in enumerate(lines, 1):
        fenced ^= line.lstrip().startswith("```")
        found = None if fenced else re.match(r"(#{1,6})\s+(.*\S)", line)
        if not found:
            continue
        level = len(found[1])
        while stack and out[stack[-1]]["level"] >= level:
            out[stack.pop()]["end"] = number - 1
        out.append({"title": found[2], "level": level, "parent": stack[-1] if stack else -1, "start": number, "end": len(lines)})
        stack.append(len(out) - 1)
    return out


CHUNKERS: dict[str, Callable[[str], list[str]]] = {
    "sentence": by_sentence,
    "paragraph": by_paragraph,
    "topic": by_topic,
    "sliding": sliding,
    "balanced": lambda t: balanced(paragraphs(t), 1500),
    "hybrid": lambda t: balanced(by_topic(t), 1500),
}


def register(name: str, chunker: Callable[[str], list[str]]) -> None:
    """Adds a chunking strategy under a name."""
    CHUNKERS[name] = chunker


def chunk(docs: DataFrame, strategy: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, content): the chunks of every text by a registered strategy; null texts have none."""
    cut, most = CHUNKERS[strategy], ROUND_CHARS
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for row in range(batch.num_rows):
                for i, c in enumerate(cut(batch.column(1)[row].as_py() or "")):
                    rows.append((row, i, c))
                    size += len(c)
                    if size >= most:
                        yield cast(batch, rows)
                        rows, size = [], 0
            if rows:
                yield cast(batch, rows)

    def cast(batch, rows):
        of, at, content = zip(*rows)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(at, pa.int32()), pa.array(content, pa.string())], ["k", "chunk_index", "content"])

    small_batches(docs.sparkSession)
    picked = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"k {kind}, chunk_index int, content string").withColumnRenamed("k", key)


def with_neighbours(chunks: DataFrame, key: str = "doc_id", edge: int = 100) -> DataFrame:
    """Each chunk with the end of the one before and the start of the one after."""
    from pyspark.sql import Window as W

    order = W.partitionBy(key).orderBy("chunk_index")
    return chunks.withColumn("before", F.right(F.lag("content").over(order), F.lit(edge))).withColumn("after", F.left(F.lead("content").over(order), F.lit(edge)))


def fixed(docs: DataFrame, size: int = 2000, step: int = 1800, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fixed windows of characters as expressions; windows of white space are left out, the last ends the text."""
    n = F.length(text)
    starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda i: (i == 0) | (i - step + size < n))
    cut = docs.where(n > 0).select(key, text, F.posexplode(starts).alias("at", "start"))
    pieces = cut.select(key, "start", F.substr(F.col(text), F.col("start") + 1, F.lit(size)).alias("content"))
    return pieces.where(F.btrim("content", F.lit(" \t\r\n")) != "")
