"""Quotation linking: who answers whom in a conversation, by quoted passages; DataFrame operations only.

Each line's leading marks give its quote level. Consecutive quoted lines of one level are a passage; a line of
another level, or an unquoted blank line, ends it, and blank quoted lines do not count. A passage is normalised line by
line (lower case, single spaces) and hashed. It belongs to the nearest earlier message of the same conversation whose own lines,
blank ones left out, hold it whole and in one piece. A message answers the message from which it quotes at its lowest
linked level, of several the latest. Messages come back without their quotes, with the first message of their thread,
their depth in it, the message that they answer and their position: a thread in the order of positions has every message behind the
one that it answers, each answer followed by its own answers, those to one message in the order of turns.

Work by step: only conversations with a passage are looked at. Passages are known by first line and length; own
lines that open one are found by a join, and just there windows of that length are hashed. The nearest earlier holder comes
from a running maximum over turns in ranges of RANGE_TURNS and over the ranges, so a passage that many messages
hold or quote gives no pairs and no large group. Threads are followed by doubling: their joins are the logarithm of the depth.
Positions come from the tour around each thread's tree, a list of one way down and one up a message, whose length from each way to
the end is found by doubling too. Without any passage nothing of this runs.

Defined cases: a null text has no lines and an empty clean text; passages that no earlier message
holds link to nothing; a message never answers itself or a later turn, so there are no cycles; null ids link to nothing;
rows of one conversation and turn are one message for linking and share their links; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import Staging

QUOTE = r"^[ \t]*(?:>[ \t]?)+"
RANGE_TURNS = 1024


def _hash(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, "\n"), 256)


def parse(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, t, r, lines): every line with its level, its normal form and itself."""
    lines = F.transform(
        F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
        lambda x: F.struct(
            F.regexp_count(F.regexp_extract(x, QUOTE, 0), F.lit(">")).alias("level"),
            F.btrim(F.regexp_replace(F.lower(F.regexp_replace(x, QUOTE, "")), r"[ \t\r\x0B\f]+", " ")).alias("norm"),
            x.alias("raw"),
        ),
    )
    return messages.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(role).alias("r"), lines.alias("lines"))


def passages(parsed: DataFrame) -> DataFrame:
    """(c, t, level, first, size, h) of every distinct quoted passage."""
    quoting = parsed.where(F.exists("lines", lambda x: x["level"] > 0)).where("c IS NOT NULL AND t IS NOT NULL")
    kept = quoting.select("c", "t", F.filter("lines", lambda x: (x["level"] == 0) | (x["norm"] != "")).alias("ls"))
    level = lambda i: F.coalesce(F.get("ls", i)["level"], F.lit(0))
    places = F.when(F.size("ls") > 0, F.sequence(F.lit(0), F.size("ls") - 1)).otherwise(F.array().cast("array<int>"))
    edged = kept.withColumn("at", places).select(
        "c", "t", "ls",
        F.filter("at", lambda i: (level(i) > 0) & (level(i - 1) != level(i))).alias("starts"),
        F.filter("at", lambda i: (level(i) > 0) & (level(i + 1) != level(i))).alias("ends"),
    )
    spans = edged.select("c", "t", "ls", F.explode(F.arrays_zip("starts", "ends")).alias("s"))
    norms = F.transform(F.slice("ls", F.col("s.starts") + 1, F.col("s.ends") - F.col("s.starts") + 1), lambda x: x["norm"])
    found = spans.select("c", "t", F.get("ls", F.col("s.starts"))["level"].alias("level"), norms.alias("norms"))
    return found.select("c", "t", "level", F.xxhash64(F.get("norms", F.lit(0))).alias("first"), F.size("norms").alias("size"), _hash(F.col("norms")).alias("h")).distinct()


def holders(parsed: DataFrame, wanted: DataFrame, staging: Staging) -> DataFrame:
    """(c, h, t): messages whose own lines hold a wanted passage."""
    quoted = wanted.select("c").distinct()
    own = F.transform(F.filter("lines", lambda x: (x["level"] == 0) & (x["norm"] != "")), lambda x: x["norm"])
    rows = parsed.where("t IS NOT NULL").join(quoted, "c", "left_semi").select("c", "t", own.alias("own")).where(F.size("own") > 0)
    rows = staging.write(rows.withColumn("row", F.monotonically_increasing_id()))  # numbered once, as a table
    needed = wanted.select("c", "first", "size").distinct()
    lines = rows.select("row", "c", F.posexplode(F.transform("own", lambda x: F.xxhash64(x))).alias("at", "first"), F.size("own").alias("n"))
    opened = lines.join(needed, ["c", "first"]).where(F.col("at") + F.col("size") <= F.col("n")).groupBy("row").agg(F.collect_set(F.struct("at", "size")).alias("spans"))
    hashed = F.array_distinct(F.transform("spans", lambda s: _hash(F.slice("own", s["at"] + 1, s["size"]))))
    return rows.join(opened, "row").select("c", "t", F.explode(hashed).alias("h")).distinct()


def nearest(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """wanted's (c, t, level, h) with `source`, the latest turn before t that holds h, where there is one."""
    part = F.floor(F.col("t") / RANGE_TURNS)
    asked = wanted.select("c", "h", "t", "level", part.alias("part"), F.lit(0).alias("kind"))
    have = held.select("c", "h", "t", F.lit(None).cast("int").alias("level"), part.alias("part"), F.lit(1).alias("kind"))
    both = asked.unionByName(have)
    tops = both.groupBy("c", "h", "part").agg(F.max(F.when(F.col("kind") == 1, F.col("t"))).alias("top"))  # a row a range
    before = tops.select("c", "h", "part", F.max("top").over(W.partitionBy("c", "h").orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    inside = W.partitionBy("c", "h", "part").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, -1)  # a quoting message before a holder of its own turn
    near = both.withColumn("near", F.max(F.when(F.col("kind") == 1, F.col("t"))).over(inside)).where("kind = 0")
    return near.join(before, ["c", "h", "part"]).select("c", "h", "t", "level", F.coalesce("near", "before").alias("source")).where("source IS NOT NULL")


def threads(answers: DataFrame, staging: Staging) -> DataFrame:
    """(c, t, root, depth) of every message that answers one; answers: c, t, reply_to, an earlier turn."""
    current = staging.write(answers.select("c", "t", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = current.select("c", F.col("t").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        joined = staging.write(current.join(above, ["c", "root"], "left"))
        staging.drop(current)
        current = staging.write(joined.select("c", "t", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        ended = joined.where("further IS NOT NULL").isEmpty()
        staging.drop(joined)
        if ended:
            return current


def positions(answers: DataFrame, staging: Staging) -> DataFrame:
    """(c, t, position) in its thread of every message that answers one (c, t, reply_to) or is answered."""
    child = answers.select("c", "t", F.col("reply_to").alias("up"))
    siblings = W.partitionBy("c", "up").orderBy("t")  # answers to one message
    # Where many answer one message, the window's rows are its answers' turns alone.
    placed = staging.write(child.select("c", "t", "up", F.lead("t").over(siblings).alias("beside")))
    first = child.groupBy("c", "up").agg(F.min("t").alias("below")).select("c", F.col("up").alias("t"), "below")
    every = child.select("c", "t").union(first.select("c", "t")).distinct()
    about = every.join(first, ["c", "t"], "left").join(placed, ["c", "t"], "left")
    # A way: (turn, down). Down leads to the first answer or back up; up leads to the next answer beside or the parent's way up.
    down = about.select("c", "t", F.lit(True).alias("down"), F.coalesce("below", "t").alias("nt"), F.col("below").isNotNull().alias("nd"), F.lit(1).cast("long").alias("w"))
    up = about.select("c", "t", F.lit(False).alias("down"), F.coalesce("beside", "up").alias("nt"), F.col("beside").isNotNull().alias("nd"), F.lit(0).cast("long").alias("w"))
    ways = staging.write(down.unionByName(up))
    while not ways.where("nt IS NOT NULL").isEmpty():
        ahead = ways.select("c", F.col("t").alias("nt"), F.col("down").alias("nd"), F.col("nt").alias("ft"), F.col("nd").alias("fd"), F.col("w").alias("more"))
        # Ways that have come to the end meet nothing; they are kept apart from the join, so they do not gather in it.
        moved = ways.where("nt IS NOT NULL").join(ahead, ["c", "nt", "nd"]).select("c", "t", "down", F.col("ft").alias("nt"), F.col("fd").alias("nd"), (F.col("w") + F.col("more")).alias("w"))
        following = staging.write(moved.unionByName(ways.where("nt IS NULL")))
        staging.drop(ways)
        ways = following
    return ways.where("down").select("c", "t", F.col("w").alias("left"))


def link(messages: DataFrame, staging: Staging, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, quote_level, n_quoted, n_passages, n_linked, reply_to, thread, depth, position, text)."""
    parsed = parse(messages, conv, turn, role, text)
    wanted = staging.write(passages(parsed))
    clean = F.btrim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["raw"]), "\n"), F.lit(" \t\r\n"))
    base = parsed.select(
        "c", "t", "r", clean.alias("clean"),
        F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).cast("long").alias("quote_level"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
    )
    zero = F.lit(0).cast("long")

    def shaped(rows, *found):
        names = ("n_passages", "n_linked", "reply_to", "thread", "depth", "position")
        return rows.select(F.col("c").alias(conv), F.col("t").alias(turn), F.col("r").alias(role), "quote_level", "n_quoted", *[c.alias(n) for n, c in zip(names, found)], F.col("clean").alias(text))

    if wanted.isEmpty():
        staging.drop(wanted)
        kind = messages.schema[turn].dataType
        return shaped(base, zero, zero, F.lit(None).cast(kind), F.col("t"), zero, zero)
    hits = staging.write(nearest(wanted, holders(parsed, wanted, staging)))
    linked = staging.write(hits.groupBy("c", "t").agg(F.count_distinct("h", "level").alias("n_linked"), F.max_by("source", F.struct(-F.col("level"), F.col("source"))).alias("reply_to")))
    staging.drop(hits)
    counts = wanted.groupBy("c", "t").agg(F.count(F.lit(1)).alias("n_passages"))
    placed = positions(linked, staging)
    # A thread's first message has the whole tour before it, so its length is the thread's size.
    sizes = placed.join(linked.select("c", "t"), ["c", "t"], "left_anti").select("c", F.col("t").alias("root"), F.col("left").alias("size"))
    rooted = threads(linked, staging).join(placed, ["c", "t"]).join(sizes, ["c", "root"]).select("c", "t", "root", "depth", (F.col("size") - F.col("left")).alias("position"))
    about = counts.join(linked, ["c", "t"], "left").join(rooted, ["c", "t"], "left")
    joined = base.join(about, ["c", "t"], "left")
    return shaped(joined, F.coalesce("n_passages", zero), F.coalesce("n_linked", zero), F.col("reply_to"), F.coalesce("root", "t"), F.coalesce("depth", zero), F.coalesce("position", zero))


ORACLE = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS k, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS (SELECT k, conv_id, turn, i, raw, length(regexp_replace(regexp_extract(raw, '^[ \t]*(?:>[ \t]?)+'), '[^>]', '', 'g')) AS level,
        trim(regexp_replace(lower(regexp_replace(raw, '^[ \t]*(?:>[ \t]?)+', '')), '[ \t\r\x0B\f]+', ' ', 'g')) AS norm
      FROM (SELECT k, conv_id, turn, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS raw FROM m)),
q AS (SELECT *, level - lag(level, 1, 0) OVER (PARTITION BY k ORDER BY i) <> 0 AS new FROM l WHERE level = 0 OR norm <> ''),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY k ORDER BY i) AS run FROM q),
p AS (SELECT DISTINCT conv_id, turn, level, body FROM (SELECT conv_id, turn, level, string_agg(norm, chr(10) ORDER BY i) AS body FROM g WHERE level > 0 GROUP BY k, conv_id, turn, level, run)),
o AS (SELECT conv_id, turn, chr(10) || string_agg(norm, chr(10) ORDER BY i) || chr(10) AS own FROM l WHERE level = 0 AND norm <> '' GROUP BY k, conv_id, turn),
h AS (SELECT p.conv_id, p.turn, p.level, p.body, max(o.turn) AS source FROM p JOIN o ON o.conv_id = p.conv_id AND o.turn < p.turn AND contains(o.own, chr(10) || p.body || chr(10)) GROUP BY 1, 2, 3, 4),
a AS (SELECT conv_id, turn, count(*) AS n_linked, arg_max(source, [-level, source]) AS reply_to FROM h GROUP BY 1, 2),
t(conv_id, turn, up, depth, path) AS (SELECT conv_id, turn, reply_to, 1, [reply_to, turn] FROM a UNION ALL SELECT t.conv_id, t.turn, a.reply_to, depth + 1, list_prepend(a.reply_to, path) FROM t JOIN a ON a.conv_id = t.conv_id AND a.turn = t.up),
e AS (SELECT conv_id, turn, arg_max(up, depth) AS root, max(depth)::BIGINT AS depth, arg_max(path, depth) AS path FROM t GROUP BY 1, 2),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, root ORDER BY path) AS position FROM e),
n AS (SELECT conv_id, turn, count(*) AS n_passages FROM p GROUP BY 1, 2),
b AS (SELECT k, max(level) AS quote_level, count(*) FILTER (WHERE level > 0) AS n_quoted,
        trim(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), ' ' || chr(9) || chr(13) || chr(10)) AS text FROM l GROUP BY k)
SELECT m.conv_id, m.turn, m.role, b.quote_level::BIGINT AS quote_level, b.n_quoted, coalesce(n.n_passages, 0)::BIGINT AS n_passages, coalesce(a.n_linked, 0)::BIGINT AS n_linked, a.reply_to,
  coalesce(d.root, m.turn) AS thread, coalesce(d.depth, 0)::BIGINT AS depth, coalesce(d.position, 0)::BIGINT AS position, b.text
FROM m JOIN b USING (k) LEFT JOIN a ON a.conv_id = m.conv_id AND a.turn = m.turn LEFT JOIN n ON n.conv_id = m.conv_id AND n.turn = m.turn LEFT JOIN d ON d.conv_id = m.conv_id AND d.turn = m.turn"""
