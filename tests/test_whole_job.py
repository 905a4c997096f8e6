"""Queries on the inputs that were once left out."""

import random
import re
from collections import Counter

import duckdb

from quarrymill.operators import prose
from quarrymill.plans import refined_queries, text_queries


def over(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return lambda name: frame


def test_sentence_split_takes_every_document(spark):
    texts = {
        1: ("Run `a. B` now. Then stop.", 2), 2: ("See [the list]\nMore here", 2), 3: ("So (it was)\nnext", 2), 4: ("one\n\ntwo\n\n\nthree", 3),
        5: ("It is A. B. C follows", 3), 6: (None, 0), 7: ("", 0), 8: ("Code:\n```\nx. Y\n\nz\n```\nEnd. Last", 2), 9: ("One. Two! Three? four.", 3),
    }
    got = {r.doc_id: r.sentences for r in refined_queries.sentence_split(over(spark, [(i, t) for i, (t, _) in texts.items()])).collect()}
    assert got == {i: n for i, (_, n) in texts.items()}


def test_boundaries_of_long_texts():
    levels = ((1.0, r"^#{1,6}\s|^={3,}$|^-{3,}$"), (0.6, r"\n\s*\n"), (0.3, r"(?<=[.!?])\s+(?=[A-Z])"))
    draw = random.Random(3)
    texts = ["One ends.\n\nAnd two follows here. Then more\n\n# Head\n" * 400, "".join(draw.choice(["\n\n", ". A", "words go on ", "# x\n", "---\n", "\n"]) for _ in range(3000))]
    for text in texts:
        kept: list = []
        for strength, pattern in levels:
            for m in re.finditer(pattern, text, re.M):
                if all(abs(m.start() - at) > 10 for at, _ in kept):
                    kept.append((m.start(), strength))
        assert len(kept) > 300 and prose.boundaries(text) == sorted(kept)


def test_key_phrases_of_two_and_three_words_in_sentences(spark):
    texts = {
        1: "Red green blue ends. Red green blue starts. Blue ends", 2: "the of red. the of red. of the red. of the red", 3: "Alpha. Beta alpha. Beta", 4: None, 5: "",
        6: "cat of dog. Cat of dog! A cat of the dog, a cat of the dog", 7: "one two three four five six seven " * 3,
    }
    expected = []
    for i, t in texts.items():
        count: Counter = Counter()
        for sentence in (t or "").split("."):
            w = re.findall("[a-z]+", sentence.lower())
            grams = [w[j : j + n] for n in (2, 3) for j in range(len(w) - n + 1)]
            count.update(" ".join(x) for x in grams if sum(y in text_queries.STOP for y in x) <= len(x) // 2)
        often = [(i, p, n) for p, n in count.items() if n > 1]
        expected += sorted(often, key=lambda x: (-x[2], x[1]))[:10]
    got = refined_queries.phrases(over(spark, list(texts.items()))).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    assert (1, "red green blue", 2) in expected and not any(i == 3 for i, _, _ in expected)


def test_readability_without_words_and_at_halves(spark):
    texts = [None, "", " ", "\n", " \n \n", "\t", ".", " . ", "bcd", "One two. Three?", "\U0001f600 \u00e9", "x" * 100_000, ". " * 10_000]
    # Words, sentences and vowels whose scores lie half way between two values at the fifth digit, or next to it.
    texts += ["a " * (w - 1) + "a" * (y - w + 1) + "." * s for w in range(1, 60) for s in (1, 2, 4, 8) for y in range(w, 2 * w + 2)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT unnest(range(len($1))) AS doc_id, unnest($1::VARCHAR[]) AS text", [texts])
    expected = sorted(con.sql(text_queries.Q.oracles["N32_readability"]).fetchall())
    got = sorted(map(tuple, text_queries.readability(over(spark, list(enumerate(texts)))).collect()))
    assert got == expected and [score for _, score in got[:5]] == [100.0] * 5
