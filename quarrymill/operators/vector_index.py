"""A stored vector index: an inverted file of cells, looked up by the cells near a query.

Cells are k-means centres fitted on a sample of SAMPLE_PER_CELL vectors a cell (chosen by a hash of the key, at most MOST_CELLS cells);
every vector is stored, in the part of its nearest centre. A second table holds each key's cell, so that a change finds the old place of a
row without a scan; changes rewrite only the cells that they touch. A collection has one dimension and one metric: rows and queries of
another are refused.

`search` reads the `probes` cells nearest to each query; `exact` goes on to every cell that could still hold a nearer vector, by the
triangle inequality with the cells' radii, so its rows are those of a whole scan.

Defined cases: null vectors are not stored; vectors without length have no direction and are refused by the cosine metric; an
empty table gives one cell; keys that come twice in a batch count once (the greater vector).
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.operators.keyed import KeyedTable, Parts, numbers_of
from quarrymill.operators.vector import BLOCK_QUERIES, BLOCK_SCORES, MARGIN, matrix, similarity
from quarrymill.session import read_small, stage, write_small

METRICS = ("cosine", "euclid")
SAMPLE_PER_CELL, MOST_CELLS = 64, 4096
#: Rounding of distances allows for so much in the bounds of `exact`.
SLACK = 1e-5


class CollectionMismatch(ValueError):
    """Vectors of another dimension, or a metric other than the collection's."""


def direction(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a to those of b."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, with BLOCK_SCORES distances held at a time."""
    step = max(BLOCK_SCORES // max(len(centres), 1), 1)
    return np.concatenate([distances(rows[i : i + step], centres).argmin(axis=1) for i in range(0, len(rows), step)])


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, dimension: int, metric: str = "cosine"):
        self.spark, self.path = spark, path.rstrip("/")
        shape = json.loads(read_small(spark, f"{self.path}/shape.json"))
        if (dimension, metric) != (shape["dimension"], shape["metric"]):
            raise CollectionMismatch(f"the collection holds {shape['dimension']} numbers by {shape['metric']}, not {dimension} by {metric}")
        self.dimension, self.metric, self.key, self.vector = dimension, metric, shape["key"], shape["vector"]
        schema = spark.createDataFrame([], shape["schema"]).schema
        self.vectors = Parts(spark, f"{self.path}/vectors", schema)
        cells = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # MOST_CELLS rows at most
        self.centres = np.array([r.centre for r in cells], np.float64).reshape(len(cells), dimension)
        kind = spark.createDataFrame([], f"{self.key} {schema[self.key].dataType.simpleString()}, cell int").schema
        self.places = KeyedTable(spark, f"{self.path}/places", (self.key,), kind, shape["place_parts"])

    # -- building ------------------------------------------------------------------------------

    @classmethod
    def build(cls, points: DataFrame, path: str, dimension: int, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> VectorIndex:
        """An index of all rows; columns beside key and vector are stored as they are."""
        if metric not in METRICS:
            raise CollectionMismatch(f"no index by {metric}: {', '.join(METRICS)}")
        spark, path = points.sparkSession, path.rstrip("/")
        rows = points.where(F.col(vector).isNotNull())
        n = rows.count()
        cells = max(1, min(cells or round(n**0.5), MOST_CELLS, n))
        centres = cls._fit(checked(rows, vector, dimension, metric), vector, metric, cells, n)
        spark.createDataFrame([(i, c) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/cells")
        place_parts = max(1, -(-n // 1_000_000))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
        write_small(spark, f"{path}/shape.json", json.dumps({"dimension": dimension, "metric": metric, "key": key, "vector": vector, "schema": schema, "place_parts": place_parts}).encode())
        index = cls(spark, path, dimension, metric)
        placed = stage(index.assign(rows), "placed")
        index.vectors.create(placed)
        KeyedTable.store(placed.select(key, F.col("part").alias("cell")), index.places.parts.path, (key,), parts=place_parts)
        return index

    @staticmethod
    def _fit(rows: DataFrame, vector: str, metric: str, cells: int, n: int) -> list[list[float]]:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if not n:
            return []
        share = min(1.0, SAMPLE_PER_CELL * cells / n)
        sample = rows.where(F.pmod(F.xxhash64(F.col(vector).cast("string")), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else rows
        taken = sample.select(F.transform(vector, lambda x: x.cast("double")).alias("features"))
        if metric == "cosine":
            norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x))
            taken = taken.select(F.transform("features", lambda x: x / norm).alias("features"))
        held = stage(taken.select(array_to_vector("features").alias("features")), "sample")
        model = KMeans(k=cells, seed=7, maxIter=12, featuresCol="features").fit(held)
        return [c.tolist() for c in model.clusterCenters()]

    def assign(self, rows: DataFrame) -> DataFrame:
        """Rows of the collection's columns with `part`, the cell of the nearest centre; a wrong dimension fails the job."""
        shipped, metric, dimension = self.spark.sparkContext.broadcast(self.centres), self.metric, self.dimension
        names = [*self.vectors.schema.names]
        at = names.index(self.vector)

        def run(batches):
            for batch in batches:
                a = matrix(batch.column(at)).reshape(-1, dimension)
                cell = nearest(direction(a) if metric == "cosine" else a, shipped.value) if len(a) and len(shipped.value) else np.zeros(len(a))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "part"])

        picked = checked(rows.where(F.col(self.vector).isNotNull()).select(*names), self.vector, dimension, metric)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.vectors.schema)
        return picked.mapInArrow(run, f"{schema}, part int")

    # -- changes -------------------------------------------------------------------------------

    def _places(self, keys: DataFrame) -> DataFrame:
        """(key, cell) of the keys that are stored."""
        return self.places.read(keys).join(keys, self.key, "left_semi")

    def upsert(self, batch: DataFrame) -> list[int]:
        """Insert or replace rows by key; the cells that were rewritten."""
        others = [c for c in self.vectors.schema.names if c != self.key]
        single = batch.where(F.col(self.vector).isNotNull()).groupBy(self.key).agg(F.max(F.struct(self.vector, *[c for c in others if c != self.vector])).alias("r"))
        new = stage(self.assign(single.select(self.key, *[F.col("r")[c].alias(c) for c in others])), "placed")
        return self._change(new.select(self.key), new)

    def delete(self, keys: DataFrame) -> list[int]:
        return self._change(stage(keys.select(self.key).distinct(), "keys"), None)

    def delete_stale(self, live: DataFrame) -> list[int]:
        """Take out every key that `live` does not hold."""
        return self.delete(self.places.read().join(live.select(self.key), self.key, "left_anti"))

    def _change(self, keys: DataFrame, new: DataFrame | None) -> list[int]:
        old = stage(self._places(keys), "old")
        touched = {r.cell for r in old.select("cell").distinct().collect()} | set(numbers_of(new) if new is not None else [])
        left = self.vectors.read(sorted(touched)).join(keys, self.key, "left_anti")
        self.vectors.replace(left if new is None else left.unionByName(new), sorted(touched))
        if new is None:
            self.places.delete(old.select(self.key))
        else:
            self.places.upsert(new.select(self.key, F.col("part").alias("cell")))
        return sorted(touched)

    def rows(self) -> DataFrame:
        return self.vectors.read().drop("part")

    # -- look-ups ------------------------------------------------------------------------------

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query_id, key, score, rank) of the k best rows in each query's nearest `probes` cells; queries have the collection's key and vector columns."""
        return self._search(queries, k, lambda ids, wanted: self._nearest_cells(wanted)[1][:, :probes])

    def exact(self, queries: DataFrame, k: int, probes: int = 2) -> DataFrame:
        """As `search`, over every cell that can hold one of the k best: those whose centre is nearer than the k-th best found so far plus the cell's radius."""
        radii = self._radii()

        def cells(ids, wanted):
            first = self._ranked(self._block(ids, wanted, self._nearest_cells(wanted)[1][:, :probes], k), k).groupBy("query_id").agg(F.max("rank").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
            far = dict.fromkeys(ids, np.inf)
            for r in first.collect():  # one row a query of the block
                if r.n == k:
                    far[r.query_id] = np.sqrt(max(2 - 2 * (r.low - SLACK), 0)) if self.metric == "cosine" else r.high + SLACK
            away = distances(self._directed(wanted), self.centres)
            limit = np.array([far[i] for i in ids])[:, None] + radii[None] + SLACK
            return [np.flatnonzero((row <= edge) & (radii >= 0)) for row, edge in zip(away, limit)]

        return self._search(queries, k, cells)

    def probes_for(self, sample: DataFrame, k: int, recall: float = 0.95) -> int:
        """The fewest probes that find this share of the k best rows of a bounded sample of queries (its size is the caller's parameter)."""
        asked = sample.where(F.col(self.vector).isNotNull()).select(self.key, self.vector)
        found = self.exact(asked, k).select("query_id", self.key).join(self.places.read(), self.key).select("query_id", "cell").collect()
        rows = asked.collect()
        order = self._nearest_cells(np.array([r[1] for r in rows], np.float64).reshape(len(rows), self.dimension))[1]
        place = {r[0]: np.argsort(o) for r, o in zip(rows, order)}
        needed = np.sort([place[r.query_id][r.cell] for r in found])
        return int(needed[max(int(np.ceil(recall * len(needed))) - 1, 0)]) + 1 if len(needed) else 1

    def _radii(self) -> np.ndarray:
        """The greatest distance of a stored vector from its centre, by cell; -1 for empty cells."""
        shipped, metric = self.spark.sparkContext.broadcast(self.centres), self.metric

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    a, cell = matrix(batch.column(0)), batch.column(1).to_numpy()
                    a = direction(a) if metric == "cosine" else a
                    away = np.sqrt(((a - shipped.value[cell]) ** 2).sum(axis=1))
                    cells, at = np.unique(cell, return_inverse=True)
                    most = np.zeros(len(cells))
                    np.maximum.at(most, at, away)
                    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(most)], ["cell", "radius"])

        out = np.full(len(self.centres), -1.0)
        for r in self.vectors.read().select(self.vector, "part").mapInArrow(run, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
            out[r.cell] = r.radius
        return out

    def _directed(self, wanted: np.ndarray) -> np.ndarray:
        return direction(wanted) if self.metric == "cosine" else wanted

    def _nearest_cells(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        away = distances(self._directed(wanted), self.centres)
        return away, np.argsort(away, axis=1, kind="stable")

    def _search(self, queries: DataFrame, k: int, cells_of) -> DataFrame:
        asked = checked(queries.where(F.col(self.vector).isNotNull()).select(self.key, self.vector), self.vector, self.dimension, self.metric)
        blocks = max(-(-asked.count() // BLOCK_QUERIES), 1)
        out = None
        for number in range(blocks):
            block = asked.where(F.pmod(F.xxhash64(self.key), F.lit(blocks)) == number).collect()  # BLOCK_QUERIES rows at most, about
            ids, wanted = [r[0] for r in block], np.array([r[1] for r in block], np.float64).reshape(len(block), self.dimension)
            found = self._ranked(self._block(ids, wanted, cells_of(ids, wanted), k), k)
            found = stage(found, "nearest") if blocks > 1 else found
            out = found if out is None else out.unionByName(found)
        return out

    def _ranked(self, rows: DataFrame, k: int) -> DataFrame:
        order = F.desc("score") if self.metric == "cosine" else F.asc("score")
        return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(order, self.key))).where(F.col("rank") <= k)

    def _block(self, ids: list, wanted: np.ndarray, cells, k: int) -> DataFrame:
        """Scores of the rows in the queries' cells, cut to each batch's k best of a query; other cells' folders are not read."""
        asking: dict[int, list[int]] = {}
        for q, row in enumerate(cells):
            for c in row:
                asking.setdefault(int(c), []).append(q)
        shipped = self.spark.sparkContext.broadcast((ids, wanted, {c: np.array(q, np.int32) for c, q in asking.items()}))
        metric, most = self.metric, BLOCK_SCORES
        sign = 1 if metric == "cosine" else -1
        kind = self.vectors.schema[self.key].dataType.simpleString()

        def run(batches):
            names, b, by_cell = shipped.value
            for batch in batches:
                parts = batch.column(2).to_numpy()
                for cell in np.unique(parts):
                    part = batch.filter(pa.array(parts == cell))
                    # Queries are taken so many at a time that their scores are bounded; a query's k best are still those of the whole part.
                    step = max(most // part.num_rows, 1)
                    for start in range(0, len(by_cell[int(cell)]), step):
                        yield best(part, matrix(part.column(1)), by_cell[int(cell)][start : start + step], names, b)

        def best(part, a, rows, names, b):
            scores = similarity(metric, a, b[rows])
            ranked = sign * np.where(np.isnan(scores), -sign * np.inf, scores)
            if k < len(ranked):
                least = np.partition(ranked, len(ranked) - k, axis=0)[len(ranked) - k]
                row, col = np.nonzero(ranked >= least - MARGIN)
            else:
                row, col = np.nonzero(np.ones_like(ranked, bool))
            return pa.RecordBatch.from_arrays(
                [pa.array([names[rows[i]] for i in col.tolist()], part.schema.field(0).type), part.column(0).take(pa.array(row)), pa.array(scores[row, col])], ["query_id", "key", "score"]
            )

        picked = self.vectors.read(sorted(asking)).select(F.col(self.key), F.col(self.vector), F.col("part"))
        rows = picked.mapInArrow(run, f"query_id {kind}, key {kind}, score double")
        return rows.select("query_id", F.col("key").alias(self.key), F.round("score", 5).alias("score"))


def checked(rows: DataFrame, vector: str, dimension: int, metric: str) -> DataFrame:
    """The rows; a vector of another dimension, or without direction under cosine, fails the job."""
    held = F.size(vector)
    right = held == dimension
    if metric == "cosine":
        right = right & F.exists(vector, lambda x: x != 0)
    refused = F.raise_error(F.concat(F.lit("CollectionMismatch: a vector of "), held.cast("string"), F.lit(f" numbers in a collection of {dimension} by {metric}")))
    kept = F.when(right, F.col(vector)).otherwise(refused)
    return rows.withColumn(vector, kept)


def misfits(rows: DataFrame, vector: str, dimension: int, metric: str = "cosine") -> DataFrame:
    """(reason, rows) of what a collection would refuse."""
    reason = F.when(F.col(vector).isNull(), "null").when(F.size(vector) != dimension, "dimension")
    if metric == "cosine":
        reason = reason.when(~F.exists(vector, lambda x: x != 0), "no direction")
    return rows.select(reason.otherwise("fits").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
