"""Operators on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import ranking, text
from quarrymill.operators import chunking, evaluation, fusion, fuzzy, graph, lexical, markers, vector
from quarrymill.sources import code
from quarrymill.streaming import changes


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "a x x x")], "doc_id long, text string")
    got = [r.doc_id for r in lexical.bm25_top(docs, "doc_id", "text", ["d", "a"], 3).collect()]
    assert got[0] == 2 and len(got) == 3


def test_phrase_and_near(spark):
    t = spark.createDataFrame([(["x", "a", "b"],), (["a", "x", "b"],), ([],), (["a"],)], "t array<string>")
    assert [r.v for r in t.select(lexical.contains_phrase("t", ["a", "b"]).alias("v")).collect()] == [True, False, False, False]
    assert [r.v for r in t.select(lexical.near("t", "a", "b", 0).alias("v")).collect()] == [True, False, False, False]
    assert [r.v for r in t.select(lexical.near("t", "a", "b", 1).alias("v")).collect()] == [True, True, False, False]


def test_snippet_marks_the_hit(spark):
    assert one(spark, lexical.snippet(F.lit("one two three four five six"), ["four"], 2)) == "...three <mark>four</mark>..."


@pytest.mark.parametrize(
    ("query", "expected"),
    [("class Foo", ("symbol", "Foo", "class")), ("MyClass", ("symbol", "MyClass", "class")), ("MAX_SIZE", ("symbol", "MAX_SIZE", None)), ("do_it", ("symbol", "do_it", "function")),
     ("mod.attr", ("symbol", "attr", None)), ("  ", ("lexical", "", None)), ("how to run", ("lexical", "how to run", None)), ("let x", ("symbol", "x", None)), ("ABC", ("symbol", "ABC", "class"))],
)
def test_intent(spark, query, expected):
    assert tuple(one(spark, text.intent(F.lit(query)))) == expected


def test_trigrams_and_similarity(spark):
    assert one(spark, text.trigrams(F.lit("ab"))) == ["  a", " ab", "ab ", "b  "]
    names = spark.createDataFrame([(1, "parser"), (2, "printer"), (3, "zzz")], "id long, name string")
    got = {r.id: r.score for r in fuzzy.similar(names, "id", "name", "parser").collect()}
    assert got[1] == 1.0 and 0 < got[2] < 1 and 3 not in got


def test_path_rules(spark):
    assert one(spark, ranking.path_adjustment(F.lit("class Foo"), F.lit("tests/foo.py"), ranking.CODE_INDEX)) == pytest.approx(0.7 - 0.22 - 0.08 * 1)
    assert one(spark, ranking.path_penalty(F.lit("a/htmlcov/x.html"))) == 10.0


def test_nearest_takes_queries_in_blocks(spark, monkeypatch):
    points = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert vector.nearest(points, points.where("vec_id = 0"), 2, "euclid").count() == 2
    rows = lambda: sorted(map(tuple, vector.nearest(points, points, 2).collect()))
    whole = rows()
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 2)
    assert rows() == whole and len(whole) == 10


def test_fusion(spark):
    a = fusion.ranked(spark.createDataFrame([(1, 2.0), (2, 1.0)], "id long, s double"), "id", [F.desc("s")], "x", 0)
    b = fusion.ranked(spark.createDataFrame([(2, 9.0)], "id long, s double"), "id", [F.desc("s")], "y", 1)
    got = {r.id: r for r in fusion.reciprocal_rank([a, b], {"x": 0.5, "y": 0.5}, "id").collect()}
    assert got[2].score == pytest.approx(0.5 / 62 + 0.5 / 61) and got[2].best_branch == "y" and got[2].n_branches == 2
    assert fusion.normal_weights({"a": 2.0, "b": -1.0, "c": 1.0}) == {"a": 0.5, "b": 0.0, "c": 0.5}


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.distance for r in graph.reach(edges, seeds, 5).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert graph.shortest_path(edges, "a", "d", 5).first().path == "a>b>c>d"
    assert graph.shortest_path(edges, "a", "a", 5).first().length == 0
    assert graph.shortest_path(edges, "d", "a", 5).count() == 0


def test_chunkers_keep_all_words():
    body = "First point here. Second point there.\n\nHowever, a new topic starts. It goes on! Does it end?\n" * 30
    for name, cut in chunking.CHUNKERS.items():
        assert set(" ".join(cut(body)).split()) == set(body.split()), name
        assert cut("") == [] and cut(" \n ") == []
    assert chunking.sentences("Run `a. B` now. Then stop.") == ["Run `a. B` now.", "Then stop."]
    assert chunking.split_points("word " * 100, 100)[0] in range(80, 121)
    tree = chunking.sections("# A\ntext\n## B\n```\n# no\n```\n# C")
    assert [(s["title"], s["level"], s["parent"], s["start"], s["end"]) for s in tree] == [("A", 1, -1, 1, 6), ("B", 2, 0, 3, 6), ("C", 1, -1, 7, 7)]


def test_fixed_chunks_cover_the_text(spark):
    docs = spark.createDataFrame([(1, "x" * 4100), (2, ""), (3, None), (4, "y")], "doc_id long, text string")
    got = [(r.doc_id, r.start, len(r.content)) for r in chunking.fixed(docs).collect()]
    assert got == [(1, 0, 2000), (1, 1800, 2000), (1, 3600, 500), (4, 0, 1)]


def test_markers(spark):
    docs = spark.createDataFrame([(1, "# TODO: fix #12\nok\n// HACK\n- [ ] work-around for ABC-7")], "id long, text string")
    got = [(r.line, r.category, r.description, r.reference) for r in markers.markers(docs, "id", "text").collect()]
    assert got == [(1, "todo", "fix #12", "#12"), (3, "hack", "HACK", None), (4, "workaround", "for ABC-7", "ABC-7")]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, doc_id string, rank int")
    judged = spark.createDataFrame([("q", "b", 1), ("q", "z", 1)], "query_id string, doc_id string, rel int")
    assert evaluation.reciprocal_rank(ranked, judged).first().rr == 0.5
    assert evaluation.recall(ranked, judged, 3).first().recall == 0.5
    assert evaluation.ndcg(ranked, judged, 3).first().ndcg == pytest.approx(0.63093 / 1.63093, abs=1e-5)


def test_python_extractor():
    assert code.python_symbols("class A:\n  def f(self): pass\nasync def g(): pass") == [("A", "class", 1), ("f", "function", 2), ("g", "function", 3)]
    assert code.python_symbols("def broken(:\n") == [("broken", "function", 1)]


def test_upsert_takes_the_last_change(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id long, hash string")
    log = spark.createDataFrame([(1, 1, "modified", "x"), (1, 2, "deleted", "y"), (3, 1, "added", "z")], "id long, at int, action string, hash string")
    got = {(r.id, r.hash) for r in changes.upsert(now, changes.latest(log, "id", ["at"]), "id").collect()}
    assert got == {(2, "b"), (3, "z")}
