"""Operators whose queries have no SQL, or that need more than one case, against plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill import api
from quarrymill.functions.porter import stem
from quarrymill.operators import chunking, graph, index, maintenance, order, prose, routing, typed_chunks, vector
from quarrymill.session import scratch
from quarrymill.sources import external

# Published examples of the algorithm's steps.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic", "differentli": "differ",
    "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr",
    "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust",
    "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "angulariti": "angular",
    "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
}


def test_stemmer():
    assert {w: stem(w) for w in STEMS} == STEMS


@pytest.fixture(scope="module")
def built(spark):
    rng = random.Random(3)
    words = ["Straße", "cafés", "running", "runs", "naïve", "the", "of", "a1", "x_y", "Ångström", "日本", "quick"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))), rng.choice(words)) for i in range(120)] + [(200, None, "only title")]
    frame = spark.createDataFrame(rows, "id long, body string, title string")
    made = index.StoredIndex(spark, scratch(spark, "test-index"), "id", ("body", "title"))
    made.add(frame)
    return made, rows


def tokens(text):
    return index.terms_of(text)


def test_terms_are_unicode_and_folded():
    assert tokens("Straße CAFÉS x_y, Ångström 日本 é́") == ["straße", "cafes", "x", "y", "angstrom", "日本", "e"]
    assert index.terms_of("running cafés", True) == ["run", "cafe"]
    assert tokens(None) == []


@pytest.mark.parametrize("query", ["cafes", "cafés AND running", "runs OR 日本", "the NOT of", '"the of"', '"naive the of"', "run*", "title:running", 'title:running OR body:"quick quick"', "NEAR(straße angstrom, 2)", "(the OR of) AND a1 NOT x", "missing", "missing OR quick"])
def test_match_against_brute_force(built, query):
    made, rows = built
    got = {r.key for r in made.match(query).collect()}

    def leaf(kind, column, words, distance, row):
        texts = {"body": row[1], "title": row[2]}
        for name, text in texts.items():
            if column and name != column:
                continue
            t = tokens(text)
            if kind == "prefix" and any(x.startswith(words[0]) for x in t):
                return True
            if kind == "phrase" and any(t[i : i + len(words)] == words for i in range(len(t))):
                return True
            if kind == "near" and any(all(w in t[i : i + distance + len(words)] for w in words) for i, x in enumerate(t) if x in words):
                return True
        return False

    def holds(node, row):
        if node[0] == "and":
            return holds(node[1], row) and holds(node[2], row)
        if node[0] == "or":
            return holds(node[1], row) or holds(node[2], row)
        if node[0] == "not":
            return holds(node[1], row) and not holds(node[2], row)
        return leaf(*node, row)

    tree = index.Parser(query, made.columns, False).parse()
    assert got == {r[0] for r in rows if holds(tree, r)}


@pytest.mark.parametrize("query", ["(a", "a OR", "nocolumn:a", '""', "AND a"])
def test_queries_that_cannot_be_read(query):
    with pytest.raises((ValueError, IndexError)):
        index.Parser(query, ("body",), False).parse()


def test_index_counts_follow_changes(spark):
    made = index.StoredIndex(spark, scratch(spark, "test-index"), "id", ("body",), porter=True)
    frame = lambda rows: spark.createDataFrame(rows, "id long, body string")
    live: dict = {}
    steps = [("add", {1: "runs running", 2: "a b", 3: None}), ("add", {1: "runs running", 2: "changed text", 4: "run"}), ("remove", [2, 9]), ("add", {2: "back again"}), ("remove", [1])]
    for number, (kind, what) in enumerate(steps):
        if kind == "add":
            decided = {r.key: r.decision for r in made.add(frame(list(what.items()))).collect()}
            assert decided == {k: "add" if k not in live else "skip" if live[k] == v else "update" for k, v in what.items()}
            live |= what
        else:
            made.remove(frame([(k, "") for k in what]).select("id"))
            live = {k: v for k, v in live.items() if k not in what}
        if number == 3:
            made.optimize()
            assert made.vacuum()
        hits = defaultdict(int)
        for text in live.values():
            for t in index.terms_of(text, True):
                hits[t] += 1
        assert {r.term: r.hits for r in made.vocabulary().collect()} == dict(hits)
        head = made.head()
        assert (head["documents"], head["tokens"]) == (len(live), sum(hits.values()))
    assert made.scores("nothing here").count() == 0


def test_lookup_reads_few_files(spark, built):
    made, _ = built
    plan = made.postings(["quick"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and re.search(r"part.*IN|part.*=", plan) and "EqualTo(term,quick)" in plan.replace("In(term, [quick])", "EqualTo(term,quick)")


def test_many_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 8)).round(3)
    asked = rng.normal(size=(10_000, 8)).round(3)
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = vector.nearest(frame(points), frame(asked), 2)
    assert got.count() == 20_000
    some = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got.where("query_id < 50").collect()}
    p, q = points.astype(np.float32).astype(float), asked.astype(np.float32).astype(float)
    for i in range(50):
        s = (p @ q[i]) / np.linalg.norm(p, axis=1) / np.linalg.norm(q[i])
        best = sorted(range(300), key=lambda j: (-round(s[j], 5), j))[:2]
        assert [some[i, r][0] for r in (1, 2)] == best


def test_graph_depth_and_cycles(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(12)]
    edges = spark.createDataFrame([*chain, ("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("n0",), ("a",)], "node string")
    assert {r.node: r.distance for r in graph.reach(edges, seeds).collect()} == {f"n{i}": i for i in range(13)} | {"a": 0, "b": 1, "c": 2}
    tree = spark.createDataFrame([*((c, p) for p, c in chain), ("n0", None), ("a", "b"), ("b", "a"), ("under", "a"), ("lost", "unknown")], "chunk string, parent string")
    got = {r.chunk: (r.level, r.in_cycle) for r in graph.levels(tree, "chunk", "parent").collect()}
    assert got == {f"n{i}": (i, False) for i in range(13)} | {"a": (None, True), "b": (None, True), "under": (None, True), "lost": (0, False)}
    pairs = {(r.src, r.dst): r.distance for r in graph.closure(edges).collect()}
    assert pairs["n0", "n12"] == 12 and pairs["a", "a"] == 3 and len(pairs) == 12 * 13 // 2 + 9


def test_positions(spark):
    rows = [(i, i * 7919 % 1000) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, v long")
    got = {r.id: r.position for r in order.positions(frame, [F.desc("v"), F.asc("id")], parts=7).collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}


SPLIT = {
    "One. Two! Three? four. Five": ["One.", "Two!", "Three? four.", "Five"],
    "See `a. B` here. Then": ["See `a. B` here.", "Then"],
    "Item [x]\nNext line. A": ["Item [x]", "Next line.", "A"],
    "First part\n\n\nsecond part": ["First part", "second part"],
    "```\nX. Y\n```\nEnd. Z": ["```\nX. Y\n```\nEnd.", "Z"],
    "": [],
    " \n ": [],
    "No end": ["No end"],
}


@pytest.mark.parametrize("text", list(SPLIT))
def test_sentences(text):
    assert chunking.sentences(text) == SPLIT[text]


def test_abbreviations_do_not_end_sentences():
    assert prose.sentences("Dr. Smith came at five. He left at 3. It rained. But why") == ["Dr. Smith came at five.", "He left at 3. It rained.", "But why"]


def test_chunks_lose_no_words():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["Word here. ", "More words! ", "\n\n", "however it is ", "# Head\n", "x" * 30 + " "]) for _ in range(rng.randint(0, 80)))
        words = text.split()
        for name in ("paragraph", "topic", "balanced", "hybrid"):
            assert " ".join(chunking.CHUNKERS[name](text)).split() == words, name
        parts = chunking.by_sentence(text, 40, 0)
        assert " ".join(parts).split() == words
        assert all(chunking.tokens(p) <= 44 or len(chunking.sentences(p)) == 1 for p in parts)
        windows = chunking.sliding(text, 60, 1)
        assert set(words) == {w for p in windows for w in p.split()}
        points = chunking.split_points(text, 100)
        assert points == sorted(points) and all(60 <= b - a <= 120 for a, b in zip([0, *points], points))


def test_section_tree():
    text = "intro\n# A\none\n## B\ntwo\n```\n# not a heading\n```\n# C\n### D\nend"
    assert [(s["title"], s["level"], s["parent"], s["start"], s["end"]) for s in chunking.sections(text)] == [("A", 1, -1, 2, 8), ("B", 2, 0, 4, 8), ("C", 1, -1, 9, 11), ("D", 3, 2, 10, 11)]


def test_typed_chunkers():
    api_text = "Intro\nGET /items list\ntext\nPOST /items\nbody\n"
    assert typed_chunks.by_endpoint(api_text) == ["GET /items list\ntext", "POST /items\nbody"]
    assert typed_chunks.by_step("Step 1: open\na\nNext do this\nb") == ["Step 1: open\na", "Next do this\nb"]
    readme = "# Tool\nIntro.\n## Usage\nRun it.\n### Options\nMany.\n## History\nOld."
    assert typed_chunks.by_readme(readme) == ["# Tool\nIntro.", "## Usage\nRun it.\n### Options\nMany.", "## History\nOld."]
    assert typed_chunks.by_readme("no sections here. At all") == ["no sections here. At all"]


def test_block_kinds():
    text = "# H\npara one\npara two\n\n- a\n- b\n> q\n```\n# code\n```\n1. one"
    assert prose.blocks(text) == [("heading", 1, 1), ("paragraph", 2, 3), ("list", 5, 6), ("quote", 7, 7), ("code", 8, 10), ("list", 11, 11)]


def test_two_phase_writes():
    log = []
    assert maintenance.two_phase(lambda: log.append("p"), lambda: log.append("s"), lambda: log.append("r")) == "committed"

    def fails():
        raise OSError("away")

    with pytest.raises(OSError):
        maintenance.two_phase(lambda: log.append("p"), fails, lambda: log.append("r"))
    with pytest.raises(OSError):
        maintenance.two_phase(fails, lambda: log.append("never"), lambda: log.append("never"))
    assert log == ["p", "s", "p", "r"]


def test_facade_modes(spark):
    from quarrymill.plans.bindings import frame

    files, symbols = (frame(spark, "/root/testdata/sf0.001", n) for n in ("files", "symbols"))
    engine = api.Engine(spark, files, symbols)
    text = {r.file_id: r.content for r in files.select("file_id", "content").collect()}
    found = engine.search("only from", "lexical", 5).collect()
    assert found and all({"only", "from"} & set(index.terms_of(text[r.file_id])) for r in found)
    assert [r.score for r in found] == sorted((r.score for r in found), reverse=True)
    name = symbols.orderBy("symbol_id").first().name
    assert engine.search(name, "symbol").first().score == 1.0
    path = files.orderBy("file_id").first().path
    assert engine.search(path, "fuzzy", 1).first().score == 1.0
    assert 0 < engine.search("only from", "hybrid", 7).count() <= 7
    assert engine.lookup(name).first().name == name


def test_frozen_set_and_artifacts_refuse(spark):
    with pytest.raises(external.NotFrozen):
        external.frozen_set(spark, scratch(spark, "none"))
    place = scratch(spark, "artifact")
    external.export_artifact(spark.range(10), place)
    assert external.import_artifact(spark, place).count() == 10


def test_branch_expansion_values():
    assert {b for _, _, bs in routing.BRANCH_RULES for b in bs} == {"bm25", "semantic"}
