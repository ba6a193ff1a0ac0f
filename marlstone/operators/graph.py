"""A property graph built from tables, and fixed multi-hop questions over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes(*parts: DataFrame) -> DataFrame:
    """Union of (ntype, key, name), one a (ntype, key): the last part's name, the least of equals."""
    both = None
    for i, p in enumerate(parts):
        p = p.select("ntype", F.col("key").cast("string").alias("key"), "name", F.lit(-i).alias("_o"))
        both = p if both is None else both.unionByName(p)
    return both.groupBy("ntype", "key").agg(F.min(F.struct("_o", "name"))["name"].alias("name"))


def edges(df: DataFrame, etype: str, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
    """Edges of one type between (type, key column) pairs; ends that are null give none."""
    (st, sc), (dt, dc) = src, dst
    out = df.select(F.lit(st).alias("stype"), F.col(sc).cast("string").alias("skey"), F.lit(etype).alias("etype"), F.lit(dt).alias("dtype"), F.col(dc).cast("string").alias("dkey"))
    return out.where("skey IS NOT NULL AND dkey IS NOT NULL")


def hop(paths: DataFrame, edges_: DataFrame, etype: str, at: str, to: str, optional: bool = False) -> DataFrame:
    """Extend paths from column `at` to `to` along edges of a type; edges are filtered before the join."""
    e = edges_.where(F.col("etype") == etype).select(F.col("skey").alias(at), F.col("dkey").alias(to))
    return paths.join(e, at, "left" if optional else "inner")


def conflicts(edges_: DataFrame, etype: str, by: str, what: str) -> DataFrame:
    """Keys that lead to more than one value along an edge type."""
    return edges_.where(F.col("etype") == etype).groupBy(by).agg(F.countDistinct(what).alias("n")).where("n > 1")
