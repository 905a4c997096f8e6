"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrymill.llm import bpe, chat, dedup, html_text, langid, lm, media, mixing, quality, registry, urlfilter
from quarrymill.llm.staging import Staging

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id string, key int, size string, n string, kept int, fp string, block int,"
    " held string, words int, target string, rule_row int, mix_row int, score string, copy int, lang_pred int, ids string, media int, row string, gone_id int"
)
CLASH = (None,) * 19
PROSE = "the cat sat on the mat and looked at the moon over the quiet river bank tonight. "
LONG = " ".join(f"w{i % 977}x{i % 61}" for i in range(20_000)) + "."
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\x0b ", None, "b", 4), (4, PROSE * 3, "en", None, None),
    (4, PROSE * 3, "en", None, None), (None, "a text without an id is still a text to be judged, is it not?", "en", "b", 3),
    (5, LONG, None, "b", 1), (6, "x" * 60_000, "xx", "c", 1), (7, "12 34 ... !!", "en", "c", 9), (8, PROSE * 3, "en", "a", 1),
    (9, "één twee drie vier\u00a0vijf ünïcode 語言 😀 zes zeven acht negen tien elf.", "nl", "c", 2), (10, "one\x00zero \x01 control", "en", "a", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + CLASH for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_bpe(docs, none):
    ranks, pattern = registry.tokenizer()
    run = lambda d: bpe.round_trip(d, ranks, pattern, with_ids=False)
    assert run(none).count() == 0
    rows = run(docs).collect()
    assert len(rows) == len(ROWS)
    got = by_id(run(docs))
    assert got[1].n_tokens == 0 and got[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    for r in ROWS:
        assert got[r[0]].decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest()


def test_media(docs, none):
    assert media.media_digests(none).count() == 0
    rows = media.media_digests(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = next(x[1] for x in ROWS if x[0] == r.doc_id) or ""
        raw = text.encode()
        padded = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_bytes % 188 == 0 and r.feature.endswith("errors=0")


def test_quality(docs, none):
    assert quality.judge(none).count() == 0
    assert quality.judge(docs).count() == len(ROWS)
    got = by_id(quality.judge(docs))
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[5].n_words == 20_000 and not got[6].kept
    assert not got[4].kept and got[4].n_repeat_words == got[4].n_words  # a sentence three times
    assert got[9].kept
    kept = quality.apply_rules(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {9, None}
    assert quality.apply_rules(none).count() == 0


def test_mixing(spark, docs, none):
    assert mixing.taken(none, Staging(spark, "t")).count() == 0
    rows = mixing.taken(docs, Staging(spark, "t")).collect()
    assert len(rows) == len(ROWS)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    again = mixing.taken(docs.repartition(3), Staging(spark, "t")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    mixed = mixing.mix(docs, Staging(spark, "t"))
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.taken // r.size for r in rows if r.size)
    assert mixing.mix(none, Staging(spark, "t")).count() == 0


def test_dedup(spark, docs, none):
    assert dedup.components(none, Staging(spark, "t")).count() == 0
    rows = dedup.components(docs, Staging(spark, "t")).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows}
    assert got[8].component_id == 4 and not got[8].kept and got[4].kept
    assert got[1].component_id == 1 and got[1].n_shingles == 0 and got[2].kept and got[3].kept
    assert got[None].component_id is None and got[None].kept
    kept = dedup.keep_one(docs, Staging(spark, "t"))
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 1
    assert dedup.keep_one(none, Staging(spark, "t")).count() == 0


def test_language(spark, docs, none):
    train = ~langid.held_out(F.col("doc_id"), 3)
    assert langid.identify(none, train).count() == 0
    got = by_id(langid.identify(docs, F.lit(True)))
    assert len(langid.identify(docs, F.lit(True)).collect()) == len(ROWS)
    for i in (1, 2, 3, 7):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert got[4].lang_pred == "en" and 0 <= got[4].score <= 1
    assert all(r.lang_pred == "und" for r in langid.identify(docs, F.lit(False)).collect())
    out = langid.accepted(docs)
    assert out.columns == docs.columns and langid.accepted(none).count() == 0


def test_language_model(spark, docs, none):
    assert lm.train_and_score(none, Staging(spark, "t")).count() == 0
    rows = lm.train_and_score(docs, Staging(spark, "t")).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows}
    assert got[1].n_tokens == 1 and got[2].n_tokens == 1 and got[5].n_tokens == 20_001
    assert got[None].held_out and all(r.score < 0 and r.base_score < 0 for r in rows)
    unseen = lm.train_and_score(docs.where("doc_id IS NULL"), Staging(spark, "t")).collect()
    assert [(r.n_known, r.train_tokens) for r in unseen] == [(0, 0)]


PAGES = [
    (1, None, None), (2, "", ""), (3, "no host", "<p>text"), (4, "HTTP://EXAMPLE.com/en/7?x=/en/", "<html><body><nav><a>x</a></nav><article><h1>T &amp; t</h1><p>one\n two<p>three&nbsp;</article><footer>f</footer>"),
    (5, "http://a.B.org/es/9#f", "<" * 1000), (5, "http://a.B.org/es/9#f", "<" * 1000), (None, "x://www.adult-x.example.com", "<!-- c --><!bogus><p>" + "long words " * 30_000),
    (7, "http://net/de/", "<div class='comments'><p>gone</p></div><p>" + "kept text, of some length. " * 9 + "</p>"), (8, "https://x.net?/de/", "plain &unknown; text &#233; only"),
]


def test_url_filter(spark):
    pages = spark.createDataFrame([p + (0, "k") for p in PAGES], "page_id long, url string, html string, id int, host string")
    rows = [r for r in urlfilter.judge(pages).collect()]
    assert len(rows) == len(PAGES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert got[5] == ("a.b.org", "/es/9", "org/es/", "block")
    assert got[None] == ("www.adult-x.example.com", "", None, "block")
    assert got[7] == ("net", "/de/", "net/de/", "allow")
    assert got[8] == ("x.net", "", None, "allow")
    assert urlfilter.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, rules=(), blocked=()).collect()} == {"allow"}


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda x: len(x) % 3)
    (tmp_path / "a").write_bytes(urlfilter.DigestArray.pack([(f"h{i}.org", "/" * (i % 4), i) for i in range(40)]))
    array = urlfilter.DigestArray(str(tmp_path / "a"))
    keys = [urlfilter.entry_key(f"h{i}.org", "/" * (i % 4)) for i in range(40)] + [urlfilter.entry_key("other.org", "")]
    found = array.probe(keys)
    assert found[-1] == -1 and [array.entry(int(j))[2] for j in found[:-1]] == list(range(40))


def test_html(spark):
    pages = spark.createDataFrame([p + (0, "k") for p in PAGES], "page_id long, url string, html string, id int, text string")
    rows = html_text.extract(pages).collect()
    assert len(rows) == len(PAGES) and all(r.n_chars == len(r.text) for r in rows)
    got = {r.page_id: r.text for r in rows}
    assert got[1] == got[2] == "" and got[3] == "text"
    assert got[4] == "T & t\none two\nthree"
    assert got[7].startswith("kept text") and "gone" not in got[7]
    assert got[8] == "plain &unknown; text é only"
    assert len(got[None]) == 11 * 30_000 - 1
    assert html_text.extract(pages.limit(0)).count() == 0


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Where is the key?\nI lost it."), (1, 1, "assistant", "> where is  the KEY?\nUnder the mat."), (1, 2, "user", ">> Where is the key?\n> under the mat.\nThanks!"),
        (1, 3, "user", "> nobody said this\nWell."), (2, 0, "user", None), (2, 0, "user", None), (2, 1, None, ">\n> \nonly marks"), (None, 1, "user", "> I lost it."), (2, None, "user", "> x"),
    ]
    frame = spark.createDataFrame([r + ("c", 1) for r in rows], "conv_id long, turn long, role string, text string, h string, first int")
    out = chat.link(frame, Staging(spark, "t")).collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn): r for r in out}
    assert got[1, 1].reply_to == 0 and got[1, 1].text == "Under the mat."
    assert (got[1, 2].reply_to, got[1, 2].quote_level, got[1, 2].n_linked) == (1, 2, 2)
    assert got[1, 3].reply_to is None and (got[1, 3].thread, got[1, 3].depth) == (3, 0)
    assert got[2, 0].text == "" and got[2, 1].n_linked == 0 and got[None, 1].reply_to is None
    assert chat.link(frame.limit(0), Staging(spark, "t")).count() == 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, none, stage):
    name, run = corpus_pipeline.STAGES[stage]
    assert run(spark, none, "").count() == 0
    out = run(spark, docs, "")
    rows = out.collect()
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
        assert {r.doc_id for r in rows} <= {r[0] for r in ROWS}
    else:
        assert len(rows) == len(ROWS)
