"""The filter audit and the repair of conversations against plain Python, on random and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quarrymill.llm import audit, repair
from quarrymill.llm.staging import Staging

NOT_BLANK = "[^\x20\x09-\x0d]"


def plain_repair(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)} of (conv_id, turn, role, text) rows."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        held = convs.setdefault(conv, [])
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            held += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            words = re.findall(NOT_BLANK, text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        # Plain search: (cost, audit, lines) by the repaired initials so far, as far as they matter.
        step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

        def inserted(states):
            states = dict(states)
            for _ in range(3):
                for at, (cost, said, lines) in list(states.items()):
                    for x, name in (("u", "user"), ("a", "assistant")):
                        if (at, x) in step:
                            to, new = step[at, x], (cost + 3, said + "I", [*lines, f"{name}:"])
                            if to not in states or new[:2] < states[to][:2]:
                                states[to] = new
            return states

        states = {"": (0, "", [])}
        for (_, role, text), fault in zip(turns, faults):
            found = {}

            def offer(to, new):
                if to not in found or new[:2] < found[to][:2]:
                    found[to] = new

            for at, (cost, said, lines) in inserted(states).items():
                offer(at, (cost + 4, said + "D", lines))
                if fault not in ("blank", "duplicate"):
                    more = 3 if fault == "truncated" else 0
                    if (at, role[:1]) in step:
                        offer(step[at, role[:1]], (cost + more, said + "K", [*lines, f"{role}:{text}"]))
                    for x, name in (("u", "user"), ("a", "assistant")):
                        if (at, x) in step:
                            offer(step[at, x], (cost + more + 3, said + "R", [*lines, f"{name}:{text}"]))
            states = found
        cost, said, lines = min((v for at, v in inserted(states).items() if at in ("", "a")), key=lambda v: v[:2])
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(turns)]
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, said, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_rows(seed, sizes):
    rng, rows = random.Random(seed), []
    texts = ["yes.", "no", "why?", " ", "", None, "a longer answer.  ", "ünï.\n", "cut off here"]
    for conv, n in enumerate(sizes):
        for t in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.8 else rng.choice(["system", "tool", None, "", "ü"])
            text = rng.choice(texts) if rng.random() < 0.4 else f"turn {t} of {conv}."
            rows.append((conv if conv else None, t + rng.choice([0, 0, 3]) if rng.random() < 0.95 else None, role, text))
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, ck string, seg int, print string, first int"


def run(spark, rows, partitions=4, piece=1 << 20):
    # One of a kind in (turn, role, text) order is all that the rule needs: the plain form sorts alike.
    frame = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = repair.damage_and_repair(frame, Staging(spark, "test-repair"), piece).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r.conv_id for r in out}) == len(out)
    return {r.conv_id: tuple(r)[1:] for r in out}


@pytest.mark.parametrize("seed,partitions,piece", [(1, 3, 1 << 20), (2, 40, 300), (3, 11, 2000)])
def test_repair_against_plain_search(spark, seed, partitions, piece):
    rows = random_rows(seed, [5, 0, 1, 2, 3, 400, 7, 12, 30, 1, 150, 4, 4, 9, 2, 6])
    assert run(spark, rows, partitions, piece) == plain_repair(rows)


def test_repair_of_odd_conversations(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows = [(7, dropped, "user", "gone."), (7, dropped, "user", "gone.")]
    rows += [(8, t, "user", "the same.") for t in range(500)] + [(8, 3, "user", "the same.")] * 300
    rows += [(9, None, None, None)] * 5 + [(10, -(1 << 62), "user", "far."), (10, 1 << 62, "assistant", "away.")]
    rows += [(11, 1, "user", "word " * 100_000 + "?"), (11, 2, "assistant", "short.")]
    got = run(spark, rows, 20, 4000)
    assert got == plain_repair(rows)
    assert got[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert run(spark, []) == {}


def test_product_is_associative():
    rng = random.Random(5)
    for _ in range(200):
        kinds = bytes(rng.choices(range(9), k=rng.randint(1, 40)))
        cuts = sorted(rng.choices(range(len(kinds) + 1), k=3))
        parts = [kinds[a:b] for a, b in itertools.pairwise([0, *cuts, len(kinds)])]
        left = repair.IDENTITY
        for p in parts:
            left = repair.product(left, repair.scan(p))
        one = repair.IDENTITY
        for k in kinds:
            one = repair.product(one, repair.TURNS[k])
        assert left == one == repair.scan(kinds)


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        text = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)),
            i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        )) if bad}
        rows.append((source or "", fails, i in good, i in toxic))
    out = set()
    for part in {r[0] for r in rows}:
        mine, shapley, lines = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for k, f in enumerate(order):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                all_fail = sum(f in r[1] for r in mine)
                shapley[f] += len(here)
                lines.append((part, "".join(order), k + 1, len(left), len(here), all_fail - len(here), sum(r[1] == {f} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here), f))
        out |= {(*x[:-1], shapley[x[-1]]) for x in lines}
    return out


def test_audit_against_every_order(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "Beta", "GAMMA", "δ", "x1", "e", "f#g", "h", "i", "j"])
    texts = [None, "", " \t", " ".join(f"w{i}" for i in range(60)), "same " * 80, "A" * 500, " ".join(f"W{i}" for i in range(50)), "a$b", "long " * 40_000]
    texts += [" ".join(word() for _ in range(rng.choice([3, 60, 90]))) for _ in range(30)] + [" ".join(f"v{rng.randint(0, 60)}" for _ in range(70)) for _ in range(20)]
    docs = [(rng.randint(0, 60) if rng.random() < 0.9 else None, rng.choice(texts), rng.choice(["a", "b", "", None])) for _ in range(220)]
    labels = [(rng.randint(0, 70) if rng.random() < 0.9 else None, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)]
    frame = spark.createDataFrame([(*d, 1, True, "z") for d in docs], "doc_id long, text string, source string, part int, good boolean, print string")
    marked = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, label_id string")
    got = [tuple(r) for r in audit.audit(frame, marked, Staging(spark, "test-audit")).collect()]
    assert len(got) == 3 * 600 and set(got) == plain_audit(docs, labels)
    assert audit.audit(frame.limit(0), marked, Staging(spark, "test-audit")).count() == 0
    none = audit.audit(frame, marked.limit(0), Staging(spark, "test-audit"))
    assert none.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_transform_is_its_own_inverse(spark):
    rng = random.Random(9)
    masks = [rng.randrange(32) for _ in range(500)]
    frame = spark.createDataFrame([(1, m) for m in masks], "k int, mask int")
    cells = audit.parity_sums(frame, ["k"], 5).select(audit.invert(F.col("w"), 5).alias("cells")).first().cells
    assert cells == [masks.count(m) for m in range(32)]
