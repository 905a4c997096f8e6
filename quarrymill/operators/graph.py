"""Graph operators on edge tables: reach by levels, paths, degrees, closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.session import stage


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, distance) within `depth` steps of the seeds, or as far as edges lead; the seeds at 0.

    Each level's new nodes are stored, so a level's plan reads the edges once and the earlier levels as tables.
    """
    seen = frontier = stage(seeds.select("node").distinct().withColumn("distance", F.lit(0)), "reach")
    level = 0
    while depth is None or level < depth:
        level += 1
        following = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = stage(following.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(level)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def levels(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, level, in_cycle): roots, whose parent is none or unknown, at 0, children below their parent.

    Rows in a cycle, and those below one, have no level; by (in_cycle, level) parents come before their children.
    """
    pairs = rows.select(F.col(node).alias("src"), F.col(parent).alias("dst"))
    known = pairs.select(F.col("src").alias("known"))
    inner = stage(pairs.join(known, F.col("dst") == F.col("known"), "left_semi"), "levels")
    roots = pairs.join(inner.select("src"), "src", "left_anti").select(F.col("src").alias("node"))
    # Every row has one parent, so the first level at which it is reached is its only one.
    found = reach(reverse(inner), roots)
    every = pairs.select(F.col("src").alias("node")).join(found, "node", "left")
    return every.select(F.col("node").alias(node), F.col("distance").alias("level"), F.col("distance").isNull().alias("in_cycle"))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, distance) of all pairs that edges lead to, at any depth, with the least distance; cycles end by it.

    One stored table a level holds the new pairs; the work is the size of the answer. Where no node has two edges out, as in a
    hierarchy, a level looks at its own pairs alone; else new pairs are held against all earlier ones.
    """
    step = stage(edges.select("src", "dst").distinct(), "step")
    if step.groupBy("src").count().where("count > 1").isEmpty():
        return _closure_of_paths(step)
    seen = frontier = stage(step.withColumn("distance", F.lit(1)), "closure")
    level = 1
    while True:
        level += 1
        following = frontier.select("src", F.col("dst").alias("mid")).join(step.withColumnRenamed("src", "mid"), "mid").select("src", "dst").distinct()
        frontier = stage(following.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("distance", F.lit(level)), "closure")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def _closure_of_paths(step: DataFrame) -> DataFrame:
    """The closure where each node has one edge out: a node's pairs are its one path, which ends or comes round a cycle once."""
    sizes = cycle_sizes(step)
    # `left`: how many more nodes there are once a path has come to a cycle of `size`.
    sized = stage(step.join(sizes, step["dst"] == sizes["node"], "left").select("src", "dst", "size"), "sized")
    after = sized.select(F.col("src").alias("mid"), F.col("dst").alias("next"), "size")
    frontier = stage(sized.select("src", "dst", (F.col("size") - 1).alias("left"), F.lit(1).alias("distance")), "closure")
    seen, level = [frontier], 1
    while True:
        level += 1
        going = frontier.where("left IS NULL OR left > 0").select("src", F.col("dst").alias("mid"), "left")
        left = F.coalesce(F.col("left"), F.col("size")) - 1
        frontier = stage(going.join(after, "mid").select("src", F.col("next").alias("dst"), left.alias("left"), F.lit(level).alias("distance")), "closure")
        if frontier.isEmpty():
            break
        seen.append(frontier)
    out = seen[0]
    for one in seen[1:]:
        out = out.unionByName(one)
    return out.select("src", "dst", "distance")


def cycle_sizes(step: DataFrame) -> DataFrame:
    """(node, size) of the nodes on cycles where each node has one edge out: edges from nodes that none leads to go until none does,
    then each node that is left walks round."""
    rest, n = step, step.count()
    while True:
        rest = stage(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "rest")
        now = rest.count()
        if now == n:
            break
        n = now
    after = rest.select(F.col("src").alias("mid"), F.col("dst").alias("next"))
    walk, size, out = rest, 1, []
    while True:
        out.append(walk.where("src = dst").select(F.col("src").alias("node"), F.lit(size).alias("size")))
        walk = stage(walk.where("src <> dst").select("src", F.col("dst").alias("mid")).join(after, "mid").select("src", F.col("next").alias("dst")), "walk")
        if walk.isEmpty():
            break
        size += 1
    found = out[0]
    for one in out[1:]:
        found = found.unionByName(one)
    return found


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree), parallel edges counted; ends are counted before the shuffle."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def shortest_path(edges: DataFrame, source: str, target: str, depth: int) -> DataFrame:
    """One row (path, length) or none: the least path, as an array, of those with the fewest edges."""
    spark = edges.sparkSession
    paths = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    found = paths.where(F.col("node") == target)
    for _ in range(depth):
        step = paths.join(edges, paths["node"] == edges["src"]).where(~F.array_contains("path", F.col("dst")))
        longer = step.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        paths = longer.groupBy("node").agg(F.min("path").alias("path"))  # one least path a node and level
        found = found.unionByName(paths.where(F.col("node") == target))
    best = found.withColumn("length", F.size("path") - 1).orderBy("length", "path").limit(1)
    return best.select(F.array_join("path", ">").alias("path"), "length")


def context(edges: DataFrame, seeds: DataFrame, radius: int, budget: int) -> DataFrame:
    """Nodes around the seeds scored by nearness and out-degree, the best `budget` of them."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outdegree"))
    near = reach(edges, seeds, radius).join(out, "node", "left")
    score = 1.0 / F.greatest(F.col("distance"), F.lit(1)) + 0.1 * F.coalesce("outdegree", F.lit(0))
    return near.select("node", "distance", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "node").limit(budget)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ends = nodes.select("node")
    kept = edges.join(ends, edges["src"] == ends["node"], "left_semi")
    return kept.join(ends, kept["dst"] == ends["node"], "left_semi")
