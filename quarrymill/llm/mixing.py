"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every source gets a target share of the words; targets stop at a multiple of what the source has
and the excess is shared again. A source's whole epochs come first; the rest is filled with its
documents in the order of exponential keys -ln(u) / weight, u from a hash of the id, weight the
document's quality, up to the budget by prefix sums of sizes.

A source may hold a third of all rows, so its prefix sums run in two levels: keys are dealt into
ranges of about RANGE_ROWS documents, ranges are summed, and windows run inside single ranges.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own,
the last; a null id draws like the text 'null'; equal keys are ordered by id, then size; repeated rows
count each; an empty table gives an empty mix; other columns are kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import Staging

WORD = r"[^\x20\x09-\x0D]+"
#: Production parameters of the mix.
WEIGHTS, SHARE_TENTHS, EPOCHS = (3, 1, 2), 15, 2
RANGE_ROWS = 5000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def quality_weight(n_chars: Column, size: Column) -> Column:
    """2 for texts of four to nine characters a word, as prose has, else 1."""
    return F.when((n_chars >= 4 * size) & (n_chars <= 9 * size), 2.0).otherwise(1.0)


def draw(doc_id: Column) -> Column:
    """A number in (0, 1] from the id's hash, the same in every run."""
    hexed = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("long") + 1).cast("double") / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights=WEIGHTS, share_tenths=SHARE_TENTHS, epochs=EPOCHS) -> DataFrame:
    """Adds `sid`, `target` to one row per source (source, source_size, n).

    Sources that stop at their limit are a prefix in the order of limit over weight; what they leave
    is shared among the others by weight. One row per source: the windows' single partition is small.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = sources.withColumn("sid", F.row_number().over(by_name).cast("long"))
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * epochs)
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("sid"))
    every = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    shared = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"),
        F.sum("weight").over(after).alias("open_weight"),
    )
    # The level that these open sources would share equally by weight, if all before them are at their limit.
    level = (F.col("total") * share_tenths / F.lit(10.0) - F.col("capped")) / F.col("open_weight")
    levelled = shared.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    levelled = levelled.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return levelled.select("source", "source_size", "n", "sid", F.coalesce(target, F.lit(0.0)).alias("target"))


def taken(docs: DataFrame, staging: Staging, id_col="doc_id", text_col="text", source_col="source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, source_size, target, taken) for every row, and the columns of `carry`."""
    size = size_of(F.col(text_col))
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"), *[F.col(c).alias(f"carry_{c}") for c in carry],
    )
    key = -F.ln(draw(F.col("id"))) / quality_weight(F.col("n_chars"), F.col("size"))
    rows = staging.write(sized.withColumn("key", key).drop("n_chars"))  # texts are read and counted once
    sources = staging.write(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n") / RANGE_ROWS))
    at = F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * ranges).cast("long")
    placed = rows.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("at", at)
    sums = placed.groupBy("sid", "at").agg(F.sum("size").alias("range_size"))
    offsets = sums.select("sid", "at", (F.sum("range_size").over(W.partitionBy("sid").orderBy("at")) - F.col("range_size")).alias("offset"))
    inside = W.partitionBy("sid", "at").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = placed.join(offsets, ["sid", "at"]).withColumn("before", F.col("offset") + F.sum("size").over(inside) - F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    partial = F.when(2.0 * F.col("before") + F.col("size") <= 2.0 * rest, 1).otherwise(0)
    return ordered.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * (epochs + partial)).cast("long").alias("taken"), *[F.col(f"carry_{c}").alias(c) for c in carry],
    )


def mix(docs: DataFrame, staging: Staging) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of the input."""
    columns = docs.columns
    whole = docs.withColumn("mix_row", F.struct(*[F.col(f"`{c}`") for c in columns]))
    times = taken(whole, staging, carry=("mix_row",))
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return times.select("mix_row", F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).select("mix_row.*")


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
             coalesce(length(text), 0) AS chars FROM documents),
k AS (SELECT *, -ln((('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496.0)
        / CASE WHEN chars >= 4 * size AND chars <= 9 * size THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM s),
w AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2 AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
        coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
        (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open_weight FROM w),
v AS (SELECT *, ((total * 15)::DOUBLE / 10.0::DOUBLE - capped::DOUBLE) / open_weight::DOUBLE AS lv FROM l),
x AS (SELECT (SELECT lv FROM v WHERE lv * weight <= cap ORDER BY cap::DOUBLE / weight, sid LIMIT 1) AS level),
t AS (SELECT source, source_size, CASE WHEN level * weight <= cap THEN level * weight ELSE cap::DOUBLE END AS target FROM v, x),
o AS (SELECT k.doc_id, k.size, t.source_size, t.target,
        (sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS before
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END
   + CASE WHEN 2.0::DOUBLE * before + size <= 2.0::DOUBLE * (target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size)
     THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o"""
