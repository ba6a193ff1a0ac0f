"""An approximate vector index: cells around learned centres, short codes of what is left, exact re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cosine
from .nearest import directed, matrix, meet, nearest

#: Vectors that centres are learned on, those that the number of probes is chosen by, and the most cells.
SAMPLE, TRIED, MOST_CELLS = 65_536, 256, 4096
#: Codes have four bits a number and span so many standard deviations on either side.
LEVELS, SPAN = 16, 2.5
_SETTINGS = "spread array<double>, probes int, recall double"


def _by_hash() -> list[Column]:
    """An order of vectors that has nothing to do with what they hold."""
    return [F.xxhash64("vec_id"), F.col("vec_id")]


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _closest(unit: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """For each vector the cells by distance, of equals the smaller number first."""
    return np.argsort((centers * centers).sum(1)[None, :] - 2 * unit @ centers.T, axis=1, kind="stable")


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(m) + 1) * m.shape[1]).astype(np.int32)), pa.array(m.ravel()))


def packed(rest: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """What is left of vectors after their centres as four-bit levels, two a byte."""
    step = 2 * SPAN * spread / (LEVELS - 1)
    level = np.clip(np.rint((rest + SPAN * spread) / step), 0, LEVELS - 1).astype(np.uint8)
    if level.shape[1] % 2:
        level = np.hstack([level, np.zeros((len(level), 1), np.uint8)])
    return level[:, 0::2] | (level[:, 1::2] << 4)


def unpacked(code: np.ndarray, spread: np.ndarray) -> np.ndarray:
    level = np.empty((len(code), 2 * code.shape[1]))
    level[:, 0::2], level[:, 1::2] = code & 15, code >> 4
    return level[:, : len(spread)] * (2 * SPAN * spread / (LEVELS - 1)) - SPAN * spread


class VectorIndex:
    """Vectors (vec_id, embedding) stored by cell, found by cosine.

    The folder holds `centers` (one row a cell, at most MOST_CELLS), `settings`, and `vectors`, partitioned by cell: vec_id, code, embedding.
    Searching reads the codes of probed cells only, then the vectors of the best candidates. Vectors without a direction
    (null, with nulls, all zero) aren't indexed and find nothing; ids should differ. Nothing that grows with the vectors reaches the driver.
    """

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at
        rows = sorted(spark.read.parquet(f"{at}/centers").collect())
        self.centers = np.array([r.center for r in rows])
        held = spark.read.parquet(f"{at}/settings").first()
        self.spread, self.probes, self.recall = np.array(held.spread), held.probes, held.recall

    @classmethod
    def build(cls, vectors: DataFrame, at: str, cells: int | None = None, sample: int = SAMPLE, rounds: int = 8, recall: float = 0.95) -> VectorIndex:
        """Learn centres on at most `sample` vectors (by the smallest hashes of their ids, after those that are tried), store all vectors,
        and choose the fewest probes that find `recall` of the ten nearest of the TRIED with the smallest hashes (at most a quarter of
        the vectors). No centre is learned on a vector that is tried, as none is on a question.

        The number of cells is the root of the number of vectors unless given. Each round's assignment is a Spark job over the
        written sample, of which sums by cell come back. No vectors make an index of one cell that finds nothing.
        """
        spark, some = vectors.sparkSession, vectors.where(directed("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        n = some.count()
        cells = min(MOST_CELLS, max(1, cells or round(n**0.5)), max(n, 1))
        tried = min(TRIED, n // 4) if n > 10 else 0
        some.orderBy(*_by_hash()).limit(tried).write.parquet(f"{at}/tried")
        some.orderBy(*_by_hash()).offset(tried).limit(sample).write.parquet(f"{at}/sample")
        learned = spark.read.parquet(f"{at}/sample")
        first = learned.orderBy(*_by_hash()).limit(cells).collect()
        centers = _unit(np.array([r.embedding for r in first])) if first else np.zeros((1, 1))
        spread = np.ones(centers.shape[1])
        for _ in range(rounds if n else 0):
            centers, spread = _round(learned, centers)
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>").coalesce(1).write.parquet(f"{at}/centers")
        spark.createDataFrame([(spread.tolist(), len(centers), recall)], _SETTINGS).coalesce(1).write.parquet(f"{at}/settings")
        index = cls(spark, at)
        index._store(some)
        index._choose()
        return index

    def add(self, vectors: DataFrame) -> None:
        """More vectors, to the same centres. What was stored stays as it is; the probes are chosen again, since there is more to find."""
        rows = vectors.where(directed("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        rows.orderBy(*_by_hash()).limit(TRIED).write.mode("append").parquet(f"{self.at}/tried")
        self._store(rows)
        self._choose()

    def _store(self, vectors: DataFrame) -> None:
        centers, spread = self.centers, self.spread

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                m = matrix(pa.chunked_array([batch.column(1)]))
                if not len(m):
                    continue
                unit = _unit(m)
                cell = _closest(unit, centers)[:, 0]
                code = packed(unit - centers[cell], spread)
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(code.shape[1]), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), fixed, _lists(m)], ["cell", "vec_id", "code", "embedding"])

        rows = vectors.where(directed("embedding")).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
        stored = rows.mapInArrow(run, "cell int, vec_id long, code binary, embedding array<double>")
        stored.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.at}/vectors")  # a full cell is several files

    def vectors(self, *columns: str) -> DataFrame:
        schema = "vec_id long, code binary, embedding array<double>, cell int"
        return self.spark.read.schema(schema).parquet(f"{self.at}/vectors").select("cell", "vec_id", *columns)

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, cell, embedding: each query in the cells whose centres are nearest."""
        centers = self.centers

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                m = matrix(pa.chunked_array([batch.column(1)]))
                if len(m):
                    cells = _closest(_unit(m), centers)[:, :probes].astype(np.int32)
                    again = np.repeat(np.arange(len(m)), cells.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(again)), pa.array(cells.ravel()), _lists(m[again])], ["query_id", "cell", "embedding"])

        rows = queries.where(directed("embedding")).select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
        return rows.mapInArrow(run, "query_id long, cell int, embedding array<double>")

    def candidates(self, queries: DataFrame, most: int, probes: int) -> DataFrame:
        """query_id, vec_id, cell of the `most` best of each query by codes, each cell's rows in blocks that meet the queries that probe it."""
        centers, spread = self.centers, self.spread
        asked = self.probed(queries, probes)
        hit = [r.cell for r in asked.select("cell").distinct().collect()]  # at most MOST_CELLS

        def run(r: pa.Table, q: pa.Table) -> pa.Table:
            cell = q["cell"][0].as_py()
            code = np.frombuffer(b"".join(r["code"].to_pylist()), np.uint8).reshape(r.num_rows, -1)
            near = _unit(matrix(q["embedding"])) @ (centers[cell] + unpacked(code, spread)).T
            take = min(most, near.shape[1])
            best = np.argpartition(-near, take - 1, axis=1)[:, :take]
            ids = r["vec_id"].to_numpy()[best]
            return pa.table({"query_id": pa.array(np.repeat(q["query_id"].to_numpy(), take)), "vec_id": pa.array(ids.ravel()), "cell": pa.array(np.full(ids.size, cell, np.int32)), "near": pa.array(np.take_along_axis(near, best, 1).ravel())})

        rows = self.vectors("code").where(F.col("cell").isin(hit))
        found = meet(rows, F.col("vec_id"), asked, F.col("query_id"), run, "query_id long, vec_id long, cell int, near double", keys=["cell"])
        order = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "vec_id", "cell")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, rerank: int = 10) -> DataFrame:
        """query_id, vec_id, similarity, r: about the k nearest of each query, by cosine. The best rerank * k by codes are compared exactly.

        probes: the cells read for a query, chosen when the index was built unless given; with all cells and rerank * k of all
        vectors the result is exact. Then neither cells nor codes leave any vector out, so blocks of stored vectors meet the
        queries as they are and keep the k best of each: no list of all pairs is made.
        """
        probes = min(probes or self.probes, len(self.centers))
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
        if probes == len(self.centers) and rerank * k >= self.vectors().count():
            ranked = nearest(self.vectors("embedding"), queries, k)
            return ranked.withColumn("r", F.row_number().over(order).cast("long")).where(F.col("r") <= k)
        best = self.candidates(queries, rerank * k, probes)
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
        exact = best.join(self.vectors("embedding"), ["cell", "vec_id"]).join(asked, "query_id")
        ranked = exact.select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
        return ranked.withColumn("r", F.row_number().over(order).cast("long")).where(F.col("r") <= k)

    def _choose(self) -> None:
        """Probes by the TRIED of all stored vectors whose ids have the smallest hashes."""
        tried = self.spark.read.schema("vec_id long, embedding array<double>").parquet(f"{self.at}/tried").orderBy(*_by_hash()).limit(TRIED)
        self.probes = self._probes_for(tried, self.recall)
        self.spark.createDataFrame([(self.spread.tolist(), self.probes, self.recall)], _SETTINGS).coalesce(1).write.mode("overwrite").parquet(f"{self.at}/settings")

    def _probes_for(self, tried: DataFrame, recall: float) -> int:
        """The fewest cells, by nearness to a vector, that hold `recall` of its ten nearest others."""
        asked = tried.withColumnRenamed("vec_id", "query_id")
        near = nearest(self.vectors("embedding").select("vec_id", "embedding"), asked, 11).where("vec_id <> query_id")
        ten = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))).where("r <= 10")
        found = ten.join(self.vectors(), "vec_id").join(asked, "query_id").select("cell", "embedding").collect()  # ten for each of TRIED
        if not found:
            return len(self.centers)
        order = _closest(_unit(np.array([r.embedding for r in found])), self.centers)
        place = np.argmax(order == np.array([r.cell for r in found])[:, None], axis=1)
        return int(np.sort(place)[int(np.ceil(recall * len(place))) - 1]) + 1


def _round(sample: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The means of the cells as they are now, and how far vectors spread around their centres in each direction."""
    cells, dim = centers.shape

    def run(batches: Iterator[pa.RecordBatch]):
        total, n, square = np.zeros((cells, dim)), np.zeros(cells), np.zeros(dim)
        for batch in batches:
            m = matrix(pa.chunked_array([batch.column(0)]))
            if len(m):
                unit = _unit(m)
                cell = _closest(unit, centers)[:, 0]
                np.add.at(total, cell, unit)
                n += np.bincount(cell, minlength=cells)
                square += ((unit - centers[cell]) ** 2).sum(0)
        some = np.flatnonzero(n)
        rows = np.vstack([total[some], square])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(n[some], n.sum())), _lists(rows)], ["cell", "n", "x"])

    sums = sample.select("embedding").mapInArrow(run, "cell int, n double, x array<double>").collect()  # at most a row a cell and task
    total, n = np.zeros((cells + 1, dim)), np.zeros(cells + 1)
    for r in sums:
        total[r.cell], n[r.cell] = total[r.cell] + r.x, n[r.cell] + r.n  # -1 is the last
    means = np.where(n[:-1, None] > 0, total[:-1] / np.maximum(n[:-1, None], 1), centers)
    return means, np.sqrt(np.maximum(total[-1] / max(n[-1], 1), 1e-12))
