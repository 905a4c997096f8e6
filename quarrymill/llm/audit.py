"""How document filters act together: an audit of every order of filters by Walsh-Hadamard sums.

A document's failed filters are a mask, bit i for filter i of FILTERS. For each part (source) and label pair
(quality, toxic) one aggregation gathers, for every subset S of filters, the signed parity sum
W(S) = sum over documents of (-1) ** |mask & S|. The transform is its own inverse up to the number of masks, so
count(mask) = sum over S of (-1) ** |mask & S| * W(S) / 32, exactly, in integers. From the cells come, for each subset P,
the documents that pass all of P; every order and step is read from these:

    kept after P and f       pass(P + f)
    removed by f after P     pass(P) - pass(P + f)
    redundant                all that fail f - removed
    shapley                  each document that fails f shares the 120 orders evenly with the other filters that it
                             fails: in 120 / |mask| orders f comes first among them

All counts over documents are partial sums in map tasks; a part with a third of all rows costs no more than another.
`first_holders` decides which rows repeat an earlier text: texts travel as SHA-256, the least id of each text is found by
partial aggregation, and rows meet it again by (text, id), a key that no group of copies makes hot.

Defined cases: a null text is empty, a null source is the part of the empty string (with a source of that name); a null id is never
a copy and has no labels; repeated rows of one id count each, and none is a copy of another, as their ids are equal; an id with
several label rows counts as good or toxic if one of them says so; null labels are 0; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Staging

FILTERS = "ABCDE"
#: Production parameters of the five filters.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, "[#$%&*|]"
GAPS = "[\\x20\\x09-\\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits 1, 2, 4, 8 for filters A to D on one text."""
    words = F.filter(F.split(text, GAPS), lambda w: w != "")
    counts = F.named_struct(F.lit("n"), F.size(words), F.lit("d"), F.size(F.array_distinct(words)))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    # One evaluation of the counts for both conditions.
    by_words = F.transform(F.array(counts), lambda c: (c["n"] < LEAST_WORDS).cast("int") + 2 * (100 * c["d"].cast("long") < LEAST_DISTINCT_PERCENT * c["n"].cast("long")).cast("int"))[0]
    by_chars = 4 * (100 * capitals.cast("long") > MOST_CAPITAL_PERCENT * F.length(text).cast("long")).cast("int") + 8 * text.rlike(SYMBOLS).cast("int")
    return by_words + by_chars


def first_holders(rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, print, ...) with `copy`: some smaller doc_id has the same print."""
    least = rows.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("least_id"))
    least = least.select(F.col("print").alias("least_print"), "least_id")
    met = (rows["print"] == least["least_print"]) & (rows["doc_id"] == least["least_id"])
    return rows.join(least, met, "left").withColumn("copy", F.col("least_id").isNull() & F.col("doc_id").isNotNull()).drop("least_print", "least_id")


def sign(mask: Column, subset: Column) -> Column:
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(subset)) % 2)


def parity_sums(masks: DataFrame, keys: list[str], n: int) -> DataFrame:
    """One row for each value of `keys`: `w`, the 2 ** n signed parity sums of column `mask`."""
    sums = [F.sum(sign(F.col("mask"), F.lit(s)).cast("long")).alias(f"w{s}") for s in range(1 << n)]
    return masks.groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"w{s}" for s in range(1 << n)]).alias("w"))


def invert(sums: Column, n: int) -> Column:
    """Counts of the masks 0 to 2 ** n - 1 from their parity sums."""
    every = F.sequence(F.lit(0), F.lit((1 << n) - 1))

    def cell(mask):
        signed = F.zip_with(sums, every, lambda w, s: w * sign(mask, s))
        return F.shiftright(F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x), n)

    return F.transform(every, cell)


def _total(cells: Column, condition, weight=lambda mask: F.lit(1)) -> Column:
    """Sum of cell counts times weight over the masks that meet a condition."""
    marked = F.transform(cells, lambda c, mask: F.when(condition(mask), c * weight(mask)).otherwise(0))
    return F.aggregate(marked, F.lit(0).cast("long"), lambda total, x: total + x)


def orders(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order and step of the filters for each part of `masks` (part, mask, good, toxic)."""
    n, bit = len(filters), {f: i for i, f in enumerate(filters)}
    subsets = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    cells = parity_sums(masks, ["part", "good", "toxic"], n).select("part", "good", "toxic", invert(F.col("w"), n).alias("cells"))
    passing = cells.select("part", "good", "toxic", "cells", F.transform(subsets, lambda p: _total(F.col("cells"), lambda m: m.bitwiseAND(p) == 0)).alias("pass"))

    # At most four rows a part: label pairs are added up here.
    every = passing.groupBy("part").agg(
        F.array(*[F.sum(F.col("cells")[i]) for i in range(1 << n)]).alias("cells"), F.array(*[F.sum(F.col("pass")[i]) for i in range(1 << n)]).alias("pass"),
        F.array(*[F.sum(F.when(F.col("good"), F.col("pass")[i]).otherwise(0)) for i in range(1 << n)]).alias("good"),
        F.array(*[F.sum(F.when(F.col("toxic"), F.col("pass")[i]).otherwise(0)) for i in range(1 << n)]).alias("toxic"),
    )
    shares = [_total(F.col("cells"), lambda m, b=1 << i: m.bitwiseAND(F.lit(b)) != 0, lambda m: F.floor(F.lit(factorial(n)) / F.bit_count(m))) for i in range(n)]
    every = every.withColumn("shares", F.array(*shares))
    steps = [(order, k + 1, bit[f], sum(1 << bit[g] for g in order[:k])) for order in map("".join, permutations(filters)) for k, f in enumerate(order)]
    packed = ",".join(f'{{"o":"{o}","s":{s},"f":{f},"p":{p}}}' for o, s, f, p in steps)
    step = F.explode(F.from_json(F.lit(f"[{packed}]"), "array<struct<o:string,s:int,f:int,p:int>>")).alias("step")
    rows = every.select("*", step).select("*", F.col("step.o").alias("filter_order"), F.col("step.s").alias("at"), F.col("step.f").alias("f"), F.col("step.p").alias("p"))
    one = F.call_function("shiftleft", F.lit(1), F.col("f"))
    after = F.col("p") + one

    def fallen(name):
        return F.col(name)[F.col("p")] - F.col(name)[after]

    return rows.select(
        "part", "filter_order", F.col("at").alias("step"), F.col("pass")[after].alias("kept"), fallen("pass").alias("removed"),
        (F.col("pass")[0] - F.col("pass")[one] - fallen("pass")).alias("redundant"), F.col("cells")[one].alias("unique_fails"),
        fallen("good").alias("good_lost"), fallen("toxic").alias("toxic_lost"), F.col("shares")[F.col("f")].alias("shapley"),
    )


def masks_of(docs: DataFrame, labels: DataFrame, staging: Staging, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic) of every row of `docs`. Texts are read once; what is staged is 60 bytes a row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_mask(text).alias("low"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("print"),
    )
    held = first_holders(staging.write(narrow))
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    # Rows without id would meet in one task of the join: each looks for a label under its own print's hash, where none is.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("print", "part", "low")).otherwise(0)
    joined = held.withColumn("spread", spread).join(marked.withColumn("spread", F.lit(0).cast("long")).withColumnRenamed("spread", "no_spread"), (F.col("doc_id") == F.col("label_id")) & (F.col("spread") == F.col("no_spread")), "left")
    return joined.select(
        "part", (F.col("low") + 16 * F.col("copy").cast("int")).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )


def audit(docs: DataFrame, labels: DataFrame, staging: Staging) -> DataFrame:
    """One row for each part, order of the five filters and step."""
    return orders(masks_of(docs, labels, staging))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT part, doc_id, len(w) < 50 AS A, 100 * len(list_distinct(w)) < 65 * len(w) AS B,
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D, coalesce(doc_id > least, false) AS E FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
x AS (SELECT part, MAP {'A': A, 'B': B, 'C': C, 'D': D, 'E': E} AS f, A::INT + B::INT + C::INT + D::INT + E::INT AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM m LEFT JOIN l ON l.doc_id = m.doc_id),
g AS (SELECT f, part, fails, good, toxic, count(*) AS n FROM x GROUP BY ALL),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a1.c || a2.c || a3.c || a4.c || a5.c AS o FROM a a1, a a2, a a3, a a4, a a5
      WHERE len(list_distinct([a1.c, a2.c, a3.c, a4.c, a5.c])) = 5),
s AS (SELECT o, k::INT AS k, o[k] AS c FROM o, range(1, 6) AS r(k)),
e AS (SELECT part, o, k, n, fails, good, toxic, f[c] AS bad, len(list_filter(range(1, k), lambda i: f[o[i]])) = 0 AS here FROM g, s),
r AS (SELECT part, o AS filter_order, k AS step, sum(CASE WHEN here AND NOT bad THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN here AND bad THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN bad AND NOT here THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN bad AND fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN here AND bad AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN here AND bad AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM e GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM r"""
