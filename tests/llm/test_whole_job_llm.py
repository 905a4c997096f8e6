"""Operators on the inputs that were once left out."""

import random
import time
import tracemalloc

from pyspark.sql import functions as F

from quarrymill.llm import html_text, langid, quality, urlfilter


def test_quality_lines_strewn_or_unended(spark):
    prose = "A line of prose, with a comma in it, that goes on for well over a hundred characters before it comes to its close"
    lines = {
        "### $$$ &&&": True, "a #b": True, "For&&& thstrend&&& rest": True, prose: True, prose + " ": True, prose[:60]: False,
        prose + ".": False, prose + '."  ': False, prose + ":": False, "Item #1 of a list of things": False, "A heading": False,
    }
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r.line: r.fails for r in frame.select("line", quality.line_fails(F.col("line")).alias("fails")).collect()} == lines
    text = "\n".join(["### $$$ &&&"] * 2 + ["One two three four five six seven eight nine ten eleven."])
    row = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.lost_chars == 22 and row.kept


def test_html_goes_on_after_unknown_declarations():
    page = "<article><p>before</p><p>array{} middle</p><p>after</p></article>"
    for mark in ("<![1]>", "<![foo[x]]>", "<![>", "<![ ]>", "<!x>"):
        assert html_text.main_text(page.format(mark)) == "before\narray middle\nafter", mark
    assert html_text.main_text("<article><p>one</p><p>two <![1 unclosed").startswith("one\ntwo")


def test_html_without_article_keeps_light_regions():
    advert = "<div class='advert'><p>Buy</p><p>now</p><p>or</p><p>never</p></div>"
    related = "<div><p><a href=/1>Related one</a></p><p><a href=/2>Related two</a></p><p><a href=/3>Related three</a></p></div>"
    body = [f"Paragraph {i} of the long article, with a good many words in it, as prose has." for i in range(60)]
    prose = "".join(f"<p>{x}</p>" for x in body)
    page = f"<body><div id=content><h1>Title</h1><p>A short intro.</p>{advert}{prose}{related}<section><h2>Close</h2><p>Short end.</p></section></div></body>"
    assert html_text.main_text(page).split("\n") == ["Title", "A short intro.", *body, "Close", "Short end."]


def test_language_sample_survives_long_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 4000)
    rows = [(i, "le chat dort sur la table et la souris danse " * 200, "fr") for i in range(12)] + [(100 + i, "the cat sleeps on the table and the mouse dances", "en") for i in range(12)]
    rows += [(200, "... " * 2000 + "die Katze sitzt auf dem Tisch und die Maus tanzt", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(docs, "doc_id", "text", "lang", F.lit(True))
    count = {lang: sum(x == lang for x, _ in got) for lang in ("fr", "en", "de")}
    assert count == {"fr": 10, "en": 12, "de": 1} and all(len(t) <= 400 and any(c.isalpha() for c in t) for _, t in got)
    assert sum(len(t) for lang, t in got if lang == "fr") <= 4000
    named = {r.doc_id: r.lang_pred for r in langid.identify(docs, F.lit(True)).collect()}
    assert named[0] == "fr" and named[100] == "en" and named[200] == "de"


def test_hosts_of_many_labels(tmp_path):
    path = tmp_path / "list.bin"
    path.write_bytes(urlfilter.DigestArray.pack([("com", "/en/", 0), ("a.b.example.com", "", 1), (".x", "/", 0)]))
    array = urlfilter.DigestArray(str(path))
    host = "x." * 100_000 + "example.com"
    tracemalloc.start()
    began = time.process_time()
    found = urlfilter.best(array, [(host, "/en/1"), ("a.b." + "b." * 0 + "example.com", "/en/"), ("c.a.b.example.com", "/"), ("b.example.com", "/"), ("q..x", "/"), ("", "/")])
    spent, (_, peak) = time.process_time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found == [("com", "/en/", 0), ("a.b.example.com", "", 1), ("a.b.example.com", "", 1), None, (".x", "/", 0), None]
    assert peak < 50 << 20 and spent < 0.5


def test_language_models_grow_with_their_ngrams():
    rng = random.Random(8)

    def rows(languages):
        return [(f"l{i:02d}", " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(80))) for i in range(languages) for _ in range(10)]

    size = [sum(t.nbytes for t in langid.Model.fit(rows(n)).tables) for n in (4, 8, 16)]
    assert size[1] < 2.3 * size[0] and size[2] < 2.3 * size[1]


def test_notices_count_by_length(spark):
    notice = "We value your privacy. This site uses cookies, see our cookie policy and the privacy policy, and the terms of use, before you go on"
    lines = {
        notice + ", " + notice + ", " + notice + ", " + notice + ".": True, notice + ".": True, "A line with the privacy policy of a state, " + "and many other words about it, " * 12 + "to its end.": False,
        "Alle Rechte vorbehalten": True, "Tous droits réservés.": True, "Todos los derechos reservados": True, "Overall rights reserved": False,
    }
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r.line: r.fails for r in frame.select("line", quality.line_fails(F.col("line")).alias("fails")).collect()} == lines
    own = quality.judge(spark.createDataFrame([(1, "eigene Meldung")], "doc_id long, text string"), notices={"xx": ("eigene meldung",)}).first()
    assert own.lost_chars == 14
