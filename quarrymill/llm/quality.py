"""Quality rules, line first, in DataFrame operations only.

Each line with a word is judged alone: navigation (words parted by bars or arrows), boilerplate
(as many notices as its length would hold, see NOTICE_CHARS) and punctuation (a line of prose ends a sentence or a clause, and is not strewn with
symbols). Lines that fail are removed; a document goes if that takes too much of its text, or if it
fails the base rules on length and repetition.

Defined cases: a null or blank text has no words, fails the base rules and is not kept; equal rows
are judged alike; lines of any length and texts of any length are judged whole, in time that grows
as n log n; an empty table gives an empty table; other columns are kept by `apply_rules`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Production parameters.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
MAX_LOST_PERCENT = 50
#: Notices that mark a line as boilerplate, by language; a parameter of `judge` and `apply_rules`. They are looked for at starts of words.
NOTICES = {
    "en": (
        "all rights reserved", "licensed under", "released under", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies",
        "enable javascript", "javascript is disabled", "lorem ipsum", "subscribe to our", "sign up for", "copyright (c)",
    ),
    "de": ("alle rechte vorbehalten", "lizenziert unter", "nutzungsbedingungen", "verwendet cookies", "abonnieren sie"),
    "fr": ("tous droits réservés", "sous licence", "conditions d'utilisation", "politique de confidentialité", "utilise des cookies", "abonnez-vous"),
    "es": ("todos los derechos reservados", "bajo licencia", "condiciones de uso", "política de privacidad", "utiliza cookies", "suscríbete"),
}
#: A line fails with a notice for every so many of its characters.
NOTICE_CHARS = 200
#: Marks that part menu entries.
NAV_MARKS = "|»›>"
#: Lines of so many characters are prose, longer than lines wrapped at a usual width, and must end as prose does.
PROSE_CHARS = 100
LINE_ENDS = ".!?…:;,\"')]}»”’*"


def symbols_in(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def notice_pattern(notices: dict[str, tuple[str, ...]]) -> str:
    every = [x.replace("(", r"\(").replace(")", r"\)") for held in notices.values() for x in held]
    return r"(?:^|[^\p{L}])(?:" + "|".join(every) + ")"


def line_fails(line: Column, notices: dict[str, tuple[str, ...]] = NOTICES) -> Column:
    """True for a line with a word that is navigation, boilerplate or badly punctuated."""
    n_chars = F.length(line)
    notice = F.regexp_count(F.lower(line), F.lit(notice_pattern(notices))) * NOTICE_CHARS >= n_chars
    marks = symbols_in(line, NAV_MARKS)
    navigation = (marks >= 3) & (marks * 40 >= n_chars)
    symbols = symbols_in(line, SYMBOLS)
    strewn = symbols * 10 > n_chars
    unended = (n_chars >= PROSE_CHARS) & ~F.contains(F.lit(LINE_ENDS), F.right(F.rtrim(line, F.lit(BLANK)), F.lit(1)))
    return navigation | strewn | unended | notice  # the costly test last


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), notices: dict[str, tuple[str, ...]] = NOTICES) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept_columns = [F.col(id_col).alias("id"), *[F.col(c).alias(f"carry_{c}") for c in carry]]
    extra = ["id", *[f"carry_{c}" for c in carry]]
    bare = F.btrim(text, F.lit(BLANK))
    split = docs.select(
        *kept_columns,
        text.alias("t"),
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES)).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD)).alias("lines"),
    )
    n = F.size("words")
    counted = split.select(
        *extra,
        n.cast("long").alias("n_words"),
        F.length(F.translate("t", BLANK, "")).cast("long").alias("word_chars"),
        symbols_in(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("line_chars"),
        F.aggregate("lines", F.lit(0), lambda a, x: a + F.when(line_fails(x, notices), F.length(x)).otherwise(0)).cast("long").alias("lost_chars"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).alias("h"),
    )
    # Only texts in which some window comes twice are sorted; positions follow their window's hash.
    again = F.size(F.array_distinct("h")) < F.size("h")
    placed = counted.withColumn("s", F.when(again, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))).drop("h")
    same = lambda x, i, d: F.coalesce(F.get("s", i + d)["h"] == x["h"], F.lit(False))
    found = placed.withColumn(
        "p",
        F.sort_array(F.filter(F.transform("s", lambda x, i: F.when(same(x, i, -1) | same(x, i, 1), x["p"])), lambda p: p.isNotNull())),
    ).drop("s")
    covered = F.transform("p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1) - p, F.lit(WINDOW))))
    repeated = found.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("p")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    passed = 100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("line_chars")
    # As one generated row: a filter on the verdicts stays above it. Pushed below, it would put the steps above
    # into each other's lambdas and evaluate them once an element.
    verdict = F.struct(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & passed).alias("kept"), "lost_chars", *[F.col(f"carry_{c}").alias(c) for c in carry],
    )
    return repeated.select(F.inline(F.array(verdict)))


def clean_text(text: Column, notices: dict[str, tuple[str, ...]] = NOTICES) -> Column:
    """The text without the lines that fail."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(HAS_WORD) & line_fails(x, notices))), "\n")


def apply_rules(docs: DataFrame, clean: bool = True, notices: dict[str, tuple[str, ...]] = NOTICES) -> DataFrame:
    """Documents that pass, without their failing lines, with the columns of the input."""
    columns = docs.columns
    whole = docs.withColumn("rule_row", F.struct(*[F.col(f"`{c}`") for c in columns]))
    out = judge(whole, carry=("rule_row",), notices=notices).where("kept").select("rule_row.*")
    if not clean:
        return out
    out = out.withColumn("text", clean_text(F.col("text"), notices))
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in columns else out


NOTICE_SQL = notice_pattern(NOTICES).replace("'", "''")
ENDS_SQL = LINE_ENDS.replace("'", "''")
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, i AS p, array_to_string(words[i:i+4], ' ') AS gram FROM w, unnest(range(1, len(words) - 3)) AS u(i)),
c AS (SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS n FROM g),
q AS (SELECT r, least(5, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, 5)) AS k FROM c WHERE n > 1),
m AS (SELECT r, sum(k)::BIGINT AS n_repeat_words FROM q GROUP BY r),
l AS (SELECT r, x, length(x) AS n, length(x) - length(translate(x, '{NAV_MARKS}', '')) AS marks,
        length(x) - length(translate(x, '{SYMBOLS}', '')) AS syms FROM w, unnest(lines) AS u(x)),
f AS (SELECT r, sum(n) AS line_chars, coalesce(sum(n) FILTER (WHERE len(regexp_extract_all(lower(x), '{NOTICE_SQL}')) * {NOTICE_CHARS} >= n
        OR (marks >= 3 AND marks * 40 >= n) OR syms * 10 > n
        OR (n >= {PROSE_CHARS} AND NOT contains('{ENDS_SQL}', right(rtrim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 1)))), 0)::BIGINT AS lost_chars FROM l GROUP BY r),
a AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(line_chars, 0) AS line_chars, coalesce(lost_chars, 0)::BIGINT AS lost_chars
      FROM w LEFT JOIN m USING (r) LEFT JOIN f USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_chars <= 50 * line_chars AS kept, lost_chars
FROM a"""
