"""Queries of this subpackage with their production parameters, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import audit, bpe, chat, dedup, html_text, langid, lm, media, mixing, quality, repair, triejoin, urlfilter
from .staging import Staging

RANKS = "byte_bpe_50k.tiktoken"


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[bytes, str]:
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN


def op1(spark, sf_dir):
    return dedup.components(_read(spark, sf_dir, "documents"), Staging(spark, "dedup"))


def op2(spark, sf_dir):
    return urlfilter.judge(_read(spark, sf_dir, "pages"))


def op3(spark, sf_dir):
    return media.media_digests(_read(spark, sf_dir, "documents"))


def op4(spark, sf_dir):
    return lm.train_and_score(_read(spark, sf_dir, "documents"), Staging(spark, "lm"))


def op5(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 3)
    return langid.identify(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op6(spark, sf_dir):
    return chat.link(_read(spark, sf_dir, "conversations"), Staging(spark, "chat"))


def op7(spark, sf_dir):
    return quality.judge(_read(spark, sf_dir, "documents"))


def op8(spark, sf_dir):
    return mixing.taken(_read(spark, sf_dir, "documents"), Staging(spark, "mix"))


def op10(spark, sf_dir):
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op9(spark, sf_dir):
    ranks, pattern = tokenizer()
    return bpe.round_trip(_read(spark, sf_dir, "documents"), ranks, pattern, with_ids=False)


def op11(spark, sf_dir):
    return triejoin.join(_read(spark, sf_dir, "documents"), Staging(spark, "triejoin"))


def op12(spark, sf_dir):
    return repair.damage_and_repair(_read(spark, sf_dir, "conversations"), Staging(spark, "repair"))


def op13(spark, sf_dir):
    return audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), Staging(spark, "audit"))


OP2_SQL = """
WITH u AS (SELECT page_id, CASE WHEN url IS NOT NULL AND contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1), '') AS path FROM u),
r(h, q, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
b AS (SELECT n || '.' || z AS h FROM (VALUES ('ads-track'), ('adult-x'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) AS x(n),
        (VALUES ('example.com'), ('example.net'), ('example.org')) AS y(z)),
m AS (SELECT page_id, max_by(h || q, length(h || q)) AS rule, max_by(v, length(h || q)) AS v
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id),
k AS (SELECT DISTINCT page_id FROM p JOIN b ON host = h OR ends_with(host, '.' || h))
SELECT p.page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN v WHEN k.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id LEFT JOIN k ON p.page_id = k.page_id"""


def queries():
    return {
        "op1_near_dedup": op1,
        "op2_url_filter": op2,
        "op3_media_columns": op3,
        "op4_lm_scoring": op4,
        "op5_language_id": op5,
        "op6_quotation_linking": op6,
        "op7_quality_rules": op7,
        "op8_source_mixing": op8,
        "op9_byte_bpe": op9,
        "op10_html_text": op10,
        "op11_ngram_join": op11,
        "op12_structure_repair": op12,
        "op13_filter_audit": op13,
    }


def oracle_sql():
    return {"op1_near_dedup": dedup.ORACLE, "op2_url_filter": OP2_SQL, "op6_quotation_linking": chat.ORACLE, "op7_quality_rules": quality.ORACLE, "op8_source_mixing": mixing.ORACLE, "op11_ngram_join": triejoin.ORACLE, "op12_structure_repair": repair.ORACLE, "op13_filter_audit": audit.ORACLE}
