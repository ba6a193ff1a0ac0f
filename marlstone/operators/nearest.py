"""Many queries against all rows: blocks of both meet in a task of their own, and scores are matrix products."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and queries that meet in one task: 8192 by 1024 scores are 67 MB.
ROWS, QUERIES = 8192, 1024


def meet(rows: DataFrame, row_key: Column, queries: DataFrame, query_key: Column, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, keys: Sequence[str] = (), rows_each: int = ROWS, queries_each: int = QUERIES) -> DataFrame:
    """What run finds in each block of rows for each block of queries, of equal keys if there are any.

    Blocks are dealt by hashes of row_key and query_key, as many for each key as its rows and queries ask for, so a key that holds
    a third of all rows is many blocks; the plan is the same for any number of queries. Rows of a key without queries stay out.
    Both frames are counted (in the plan where there are keys, else when it is built). Ties and limits are run's: it should
    keep the best of each query, to be merged by query.
    """
    nothing = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    both = lambda r, q: run(r, q) if r.num_rows and q.num_rows else nothing
    deal = lambda key, n: F.pmod(F.xxhash64(key), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    if keys:
        many = lambda df, n, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / n).alias(name))
        sizes = many(rows, rows_each, "row_blocks").join(many(queries, queries_each, "query_blocks"), list(keys))
        rows, queries = rows.join(sizes, list(keys)), queries.join(sizes, list(keys))
    else:
        least = rows.sparkSession.sparkContext.defaultParallelism
        sizes = [F.lit(max(-(-rows.count() // rows_each), least)).cast("long").alias("row_blocks"), F.lit(max(1, -(-queries.count() // queries_each))).cast("long").alias("query_blocks")]
        rows, queries = rows.select("*", *sizes), queries.select("*", *sizes)
    at = [*keys, "row_block", "query_block"]
    r = rows.withColumn("row_block", deal(row_key, F.col("row_blocks"))).withColumn("query_block", every(F.col("query_blocks")))
    q = queries.withColumn("query_block", deal(query_key, F.col("query_blocks"))).withColumn("row_block", every(F.col("row_blocks")))
    drop = ("row_blocks", "query_blocks")
    return r.drop(*drop).groupBy(*at).cogroup(q.drop(*drop).groupBy(*at)).applyInArrow(both, schema)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The cosine of each query with each row."""
    if not len(queries) or not len(rows):
        return np.zeros((len(queries), len(rows)))
    if queries.shape[1] != rows.shape[1]:
        raise ValueError(f"vectors of {queries.shape[1]} and {rows.shape[1]} numbers")
    size = lambda m: np.sqrt((m * m).sum(1))
    return (queries @ rows.T) / (size(queries)[:, None] * size(rows)[None, :])


def directed(c: str | Column) -> Column:
    """Whether a vector has a direction: not null, without nulls, not all zero. Others have no cosine and aren't found."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.exists(c, lambda x: x.isNull()) & F.exists(c, lambda x: x != 0)


def first_of(order: Sequence[np.ndarray], k: int) -> np.ndarray:
    """The places of the first k by several orders, the first of which (ascending) counts most."""
    lead = order[0]
    some = np.arange(len(lead))
    if len(lead) > 4 * k:
        some = np.flatnonzero(lead <= np.partition(lead, k - 1)[k - 1])
    return some[np.lexsort([o[some] for o in reversed(order)])[:k]]


def nearest(rows: DataFrame, queries: DataFrame, k: int, digits: int = 6, **blocks) -> DataFrame:
    """query_id, vec_id, similarity of the k best of each block of rows (vec_id, embedding) for each of queries (query_id, embedding):
    by cosine, rounded, then by vec_id."""

    def run(r: pa.Table, q: pa.Table) -> pa.Table:
        found = np.round(cosines(matrix(q["embedding"]), matrix(r["embedding"])), digits)
        ids, which, near = r["vec_id"].to_numpy(), [], []
        for s in found:
            best = first_of([-s, ids], k)
            which.append(ids[best])
            near.append(s[best])
        size = [len(x) for x in which]
        flat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return pa.table({"query_id": pa.array(np.repeat(q["query_id"].to_numpy(), size)), "vec_id": pa.array(flat(which, np.int64)), "similarity": pa.array(flat(near, np.float64))})

    rows = rows.where(directed("embedding")).select(F.col("vec_id").cast("long"), "embedding")
    queries = queries.where(directed("embedding")).select(F.col("query_id").cast("long"), "embedding")
    return meet(rows, F.col("vec_id"), queries, F.col("query_id"), run, "query_id long, vec_id long, similarity double", **blocks)
