"""The n-gram join against all pairs in plain Python."""

import random

import numpy as np
import pytest

from quarrymill.llm import dedup, textops, triejoin
from quarrymill.llm.staging import Staging

from test_llm_brute import brute_components, near_copies, shingles

SCHEMA = "doc_id long, text string, id string, key int, n string, fp string, block int, places string"


def components(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "a", 1, "b", "c", 2, "d") for r in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in triejoin.join(frame, Staging(spark, "test-triejoin"), **kw).collect()}


def family(rng, first, copies, length, edits, words=4000):
    base = [f"w{rng.randrange(words)}" for _ in range(length)]
    out = []
    for i in range(copies):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(length)] = f"e{rng.randrange(1000)}"
        out.append((first + i, " ".join(text)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = near_copies(seed, 12)
    rows = [(i + 1, t) for i, (_, t) in enumerate(rows)]
    at = 10_000
    # Sizes about every change of slice, short sets, and long documents at either side of the threshold.
    for length in (1, 2, 3, 4, 11, 30, 60, 66, 70, 127, 131, 140, 260, 520, 2100, 6000):
        rows += family(rng, at, 7, length, max(1, length // 45))
        at += 100
    passage = [f"p{i}" for i in range(50)]
    rows += [(at + i, " ".join([*passage, *(f"u{i}x{j}" for j in range(rng.choice([2, 6, 300])))])) for i in range(60)]
    got = components(spark, rows)
    assert {i: c for i, (_, c) in got.items()} == brute_components(rows, 3, 90)
    assert all(got[i][0] == len(shingles(t, 3)) for i, t in rows)


def test_dealt_gatherings_lose_no_link(spark):
    """Blocks of eight: families at 0.7 to 0.95 of each other, so gatherings hold several components."""
    rng = random.Random(7)
    rows = family(rng, 1, 60, 120, 3) + family(rng, 1000, 60, 90, 4, words=30) + family(rng, 2000, 40, 200, 12)
    got = components(spark, rows, block=8)
    assert {i: c for i, (_, c) in got.items()} == brute_components(rows, 3, 90)


def test_join_edges(spark):
    text = "One two three four five six seven eight nine ten eleven twelve."
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, text), (4, text), (None, text), (5, text.upper()), (6, "one two"), (7, "ONE  two"), (8, "é\x00 ü"), (9, "word " * 50_000), (10, "word " * 3)]
    frame = spark.createDataFrame([(*r, "a", 1, "b", "c", 2, "d") for r in rows], SCHEMA)
    out = triejoin.join(frame, Staging(spark, "test-triejoin")).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert got == {None: (10, None), 1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (10, 4), 5: (10, 4), 6: (1, 6), 7: (1, 6), 8: (1, 8), 9: (1, 9), 10: (1, 9)}
    assert triejoin.join(frame.limit(0), Staging(spark, "test-triejoin")).count() == 0


def test_trie_links_span_all_components():
    rng = np.random.default_rng(11)
    for _ in range(60):
        universe = rng.integers(0, 1 << 60, 400).astype(np.uint64)
        bases = [rng.choice(universe, rng.integers(5, 80), replace=False) for _ in range(4)]
        sets = []
        for _ in range(40):
            base = bases[rng.integers(4)]
            keep = base[rng.random(len(base)) > rng.choice([0, 0.03, 0.08])]
            sets.append(np.unique(np.concatenate([keep, rng.choice(universe, rng.integers(0, 4))])))
        sets = [s for s in sets if len(s)]
        ids = np.arange(len(sets)) + 100
        links = triejoin.trie_links(ids, sets, 90)
        assert len(links) < len(ids) and all(dedup.linked(sets[a - 100], sets[b - 100], 90) for a, b in links)
        forest = dedup.Forest(len(sets))
        for a, b in links:
            assert forest.root(a - 100) != forest.root(b - 100)
            forest.parent[forest.root(a - 100)] = forest.root(b - 100)
        for a in range(len(sets)):
            for b in range(a):
                if dedup.linked(sets[a], sets[b], 90):
                    assert forest.root(a) == forest.root(b)


def test_prefixes_meet():
    """The least common key of two linked sets lies in both prefixes, whatever order keys have."""
    rng = np.random.default_rng(3)
    for n in (5, 40, 63, 64, 70, 127, 128, 140, 400, 1023, 5000):
        for _ in range(20):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            gone = rng.integers(0, n // 19 + 1)
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, gone if rng.random() < 0.5 else 0).astype(np.uint64)]))
            a = np.unique(a)
            if not dedup.linked(a, b, 90):
                continue
            order = lambda keys: keys[np.argsort(textops.mix(keys.astype(np.uint64)))]
            left, right = ({s: order(keys)[:cap] for s, cap, keys in triejoin.slices(x, 90)} for x in (a, b))
            assert any(len(np.intersect1d(left[s], right[s])) for s in set(left) & set(right)), n
