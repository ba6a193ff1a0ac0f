"""Hard negatives: every row's integer score with each anchor, sorted by score and id, read below each positive."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_dir, table

#: Rows and anchors that meet in one task at a time; 513 anchors by 8192 scores are 34 MB.
ROWS, ANCHORS = 8192, 512


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows of integers; a shorter one is followed by zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; one beyond a long is an error."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    largest = a.shape[1] * max(-int(a.min()), int(a.max()), 1) * max(-int(b.min()), int(b.max()), 1)
    if largest < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if largest < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    if max(abs(int(exact.min())), abs(int(exact.max()))) >= 1 << 63:
        raise OverflowError("an inner product is beyond a long")
    return exact.astype(np.int64)


def _width(*tables: pa.Table) -> int:
    return max((int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in tables if t.num_rows), default=0)


def _sorted(rows: pa.Table, anchors: pa.Table):
    """For each anchor: its place in the table, the rows' scores, and the rows by score and id (numpy's lexsort)."""
    width = _width(rows, anchors)
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    scores = _scores(_matrix(anchors["v"], width), _matrix(rows["v"], width))
    for i in range(anchors.num_rows):
        order = np.lexsort((ids, -scores[i]))
        yield i, scores[i][order], ids[order], labels[order]


def _first(df: DataFrame, keys: list[str], score: str, identity: str, n: int) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), identity)))
    return ranked.where(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, rows_each: int = ROWS, anchors_each: int = ANCHORS) -> DataFrame:
    """For each anchor and each of its best `positives` other rows of its label, the first `negatives` rows of another
    label whose score is `low` to `high` percent of the positive's: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    rows has vec_id, embedding, label; is_anchor is a condition on them. A component x counts as floor(scale * x); a
    score is the inner product of such integers, higher first, ties by smaller vec_id.

    Rows and anchors are dealt by hashes of their ids to blocks of about rows_each and anchors_each; every block of rows
    meets every block of anchors in a task of its own, which sorts the block's rows for each anchor. A first pass
    finds the best positives of each block, which are merged by anchor; a second searches each positive's upper limit in
    the sorted scores and reads on to the lower one; its finds are merged by anchor and positive. So no task holds all
    rows of an anchor, and no label or repeated vector gathers in one. Both counts are taken when the frame is built.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows that repeat as a whole
    are one; rows that share an id but differ are all kept, and an anchor's other rows are those with another id. Of
    vectors of different lengths the shorter is followed by zeros. A positive below zero has no negatives. Without
    rows, anchors or positives there are none. Other columns aren't read.
    """
    spark = rows.sparkSession
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    whole = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector, F.coalesce(is_anchor, F.lit(False)).alias("anchor")).distinct()
    at = fresh_dir(spark, "negatives")
    whole.write.parquet(f"{at}/rows")
    whole = spark.read.parquet(f"{at}/rows")
    whole.where("anchor").select(F.monotonically_increasing_id().alias("a"), "vec_id", "label", "v").write.parquet(f"{at}/anchors")
    anchors = spark.read.parquet(f"{at}/anchors")
    row_blocks, anchor_blocks = (max(1, -(-df.count() // n)) for df, n in ((whole, rows_each), (anchors, anchors_each)))
    row_blocks = max(row_blocks, spark.sparkContext.defaultParallelism)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = whole.select("vec_id", "label", "v", deal(row_blocks).alias("rb"), every(anchor_blocks).alias("ab")).groupBy("rb", "ab")

    def meet(asked: DataFrame, run, schema: str) -> DataFrame:
        each = asked.select("*", deal(anchor_blocks).alias("ab"), every(row_blocks).alias("rb"))
        nothing = pa.table({c.split()[0]: pa.array([], pa.int64()) for c in schema.split(", ")})
        both = lambda r, a: run(r, a) if r.num_rows and a.num_rows else nothing
        return dealt.cogroup(each.groupBy("rb", "ab")).applyInArrow(both, schema)

    def best(r: pa.Table, a: pa.Table) -> pa.Table:
        out = {"a": [], "positive_id": [], "positive_score": []}
        own, own_label = a["vec_id"].to_pylist(), a["label"].to_pylist()
        key = a["a"].to_pylist()
        for i, s, ids, labels in _sorted(r, a):
            found = np.flatnonzero((labels == own_label[i]) & (ids != own[i]))[:positives]
            out["a"] += [key[i]] * len(found)
            out["positive_id"] += ids[found].tolist()
            out["positive_score"] += s[found].tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    merged = _first(meet(anchors, best, "a long, positive_id long, positive_score long"), ["a"], "positive_score", "positive_id", positives)
    of = merged.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p"))
    asked = anchors.join(of, "a").select("a", "vec_id", "label", "v", F.col("p.positive_id").alias("ids"), F.col("p.positive_score").alias("limits"))
    asked.write.parquet(f"{at}/positives")
    asked = spark.read.parquet(f"{at}/positives")

    def below(r: pa.Table, a: pa.Table) -> pa.Table:
        names = ["a", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
        out = {k: [] for k in names}
        own, own_label, key, ids_of, limits = (a[c].to_pylist() for c in ("vec_id", "label", "a", "ids", "limits"))
        for i, s, ids, labels in _sorted(r, a):
            other = np.flatnonzero(labels != own_label[i])
            falling, names_ = -s[other], ids[other]
            for place, (positive, limit) in enumerate(zip(ids_of[i], limits[i], strict=True)):
                first = int(np.searchsorted(falling, -((high * limit) // 100), "left"))
                last = int(np.searchsorted(falling, (-low * limit) // 100, "right"))
                for j in range(first, min(last, first + negatives)):
                    for c, v in zip(names, (key[i], own[i], place, positive, limit, int(names_[j]), -int(falling[j])), strict=True):
                        out[c].append(v)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    found = meet(asked, below, "a long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    found = _first(found, ["a", "place"], "negative_score", "negative_id", negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM (SELECT DISTINCT vec_id, label, embedding FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id AS id, e.label = a.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score
  FROM e AS a JOIN e ON a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
