"""The graph of a code base from stored symbols and references: who calls whom, ranks around seeds, and the edges inside a selection.

The caller of a reference is the innermost symbol whose lines hold it: of those that do, the one that starts last, then ends first.
Lines are looked up without an interval join: a symbol's lines fall into at most two blocks of every power of two, each block keeps
the innermost symbol that covers it whole, and a reference looks into the one block of every size that holds its line. So a reference
meets at most one row a size, however many symbols lie around it, and a file with very many rows is no single task.

Defined cases: symbols without lines, or that end before they start, hold nothing; a reference outside every symbol has a null caller
and gives no edge; a symbol may call itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.session import stage


def _size(level: str = "level"):
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(level))


def callers(references: DataFrame, symbols: DataFrame, levels: int | None = None) -> DataFrame:
    """references (file_id, line, others) with `caller`; symbols: symbol_id, file_id, line_start, line_end, lines from 0."""
    held = symbols.where("line_start >= 0 AND line_end >= line_start")
    if levels is None:
        top = held.agg(F.max("line_end")).first()[0]
        levels = int(top or 0).bit_length()
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    spread = held.select("file_id", "symbol_id", "line_start", "line_end", level)
    # At each size: the first and last whole block of the range that is not inside a greater whole block.
    first, last = F.ceil(F.col("line_start") / _size()), F.floor((F.col("line_end") + 1) / _size()) - 1
    ends = F.array_compact(F.array(F.when((first <= last) & (first % 2 == 1), first), F.when((first <= last) & (last % 2 == 0), last)))
    blocks = spread.select("file_id", "level", F.explode(ends).alias("block"), F.struct(F.col("line_start"), -F.col("line_end"), -F.col("symbol_id")).alias("inner"))
    best = blocks.groupBy("file_id", "level", "block").agg(F.max("inner").alias("inner"))
    # Places, not references, are looked up: many references may stand in one line.
    places = references.select("file_id", "line").distinct().select("file_id", "line", level).withColumn("block", F.floor(F.col("line") / _size()))
    found = places.join(best, ["file_id", "level", "block"]).groupBy("file_id", "line").agg(F.max("inner").alias("inner"))
    return references.join(found, ["file_id", "line"], "left").select(*references.columns, (-F.col("inner")["col3"]).alias("caller"))


def call_edges(called: DataFrame) -> DataFrame:
    """(src, dst, kind, n) of references with a caller; called: caller, symbol_id, kind."""
    return called.where("caller IS NOT NULL").groupBy(F.col("caller").alias("src"), F.col("symbol_id").alias("dst"), "kind").agg(F.count(F.lit(1)).alias("n"))


def ranks(edges: DataFrame, seeds: DataFrame, rounds: int = 10, follow: float = 0.85) -> DataFrame:
    """(node, rank): PageRank with all jumps to the seeds, after a fixed number of rounds; edges (src, dst, n) weigh by n.

    What stands on nodes without edges goes back to the seeds, so ranks add up to 1.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    links = stage(edges.groupBy("src", "dst").agg(F.sum("n").alias("n")).join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "links")
    start = stage(seeds.select("node").distinct(), "seeds")
    count = start.count()
    if not count:
        return start.withColumn("rank", F.lit(0.0))
    current = start.withColumn("rank", F.lit(1.0 / count))
    for _ in range(rounds):
        sent = current.join(links, current["node"] == links["src"]).groupBy(F.col("dst").alias("node")).agg((F.sum(F.col("rank") * F.col("share")) * follow).alias("rank"))
        gathered = stage(sent, "ranks")
        kept = gathered.agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        back = start.withColumn("rank", F.lit((1.0 - kept) / count))
        current = gathered.unionByName(back).groupBy("node").agg(F.sum("rank").alias("rank"))
    return current


def select_context(edges: DataFrame, seeds: DataFrame, budget: int, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """(the `budget` nodes of the highest rank, the edges that have both ends among them)."""
    best = stage(ranks(edges, seeds, rounds).select("node", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "node").limit(budget), "context")
    ends = best.select("node")  # `budget` rows
    inside = edges.join(F.broadcast(ends.withColumnRenamed("node", "src")), "src", "left_semi").join(F.broadcast(ends.withColumnRenamed("node", "dst")), "dst", "left_semi")
    return best, inside.select(*edges.columns)
