"""Mixing sources to target weights, by hash-threshold histograms. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, cut, documents, if_small

#: The hash has LEVELS * BITS bits; a histogram has 2 ** BITS buckets.
BITS, LEVELS = 12, 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def row_hash(doc_id: Column) -> Column:
    """The top 48 bits of md5 of the id as text (null: the empty text)."""
    digits = BITS * LEVELS // 4
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, digits), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Targets of (source, source_size): shares by weight of the sum of sizes, none above most times its size.

    With sources in the order of cap / weight, the level is the largest of
    (total - caps before) / (weights from here on), so no loop is needed.
    The windows see one row a source.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    found = sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    found = found.withColumn("level", left.cast("double") / F.sum("weight").over(after).cast("double"))
    level = F.max("level").over(everything)
    return found.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * level).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies.

    A source's target is met by whole copies of all its documents and, for the
    rest, by those whose hash lies under a threshold: a histogram of words by
    hash bucket finds the bucket in which the budget ends, only that bucket is
    refined, LEVELS times in all, and the document at the end is taken if
    that is nearer. Thresholds are nested: a smaller budget takes a subset.
    No document is taken more than `most` times, and of a source whose budget for the rest is nothing
    none is taken for it (texts without words included). Nothing is sorted but the
    buckets of one source.

    Null texts have size 0, a null source is a source of its own (last), null
    ids hash as the empty text, and repeated ids stand or fall together. Only
    the columns doc_id, text and source are read. An empty table gives no rows.
    """
    sized = docs.select("doc_id", "source", word_count(docs["text"]).alias("size"), row_hash(docs["doc_id"]).alias("h"))
    sized = cut(sized)  # a few numbers a document: the texts are read once
    totals = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    n_sources = totals.count()
    size, target = F.col("source_size"), F.col("target")
    full = F.when(size > 0, F.least(F.floor(target / size), F.lit(most))).otherwise(0).cast("long")
    bound = source_targets(totals, weights, most).withColumn("full", full)
    bound = bound.withColumn("budget", target - F.col("full") * size).withColumns({"base": F.lit(0).cast("long"), "bucket": F.lit(0).cast("long"), "inside": F.lit(0).cast("long")})
    keys = ["source", "source_size", "target", "full", "budget", "base"]
    for level in range(1, LEVELS + 1):
        above, here = BITS * (LEVELS - level + 1), BITS * (LEVELS - level)
        of = if_small(bound.withColumnRenamed("source", "_source").drop("inside"), n_sources)
        rows = sized.join(of, sized["source"].eqNullSafe(of["_source"]) & (F.shiftright("h", above) == F.col("bucket")))
        counts = rows.groupBy(*keys, F.shiftright("h", here).alias("bucket")).agg(F.sum("size").alias("inside"))
        upto = F.sum("inside").over(Window.partitionBy("source").orderBy("bucket")) + F.col("base")
        ends = counts.withColumn("upto", upto).where(F.col("upto") >= F.col("budget"))
        first = F.min(F.struct("bucket", "upto", "inside")).alias("first")
        bound = ends.groupBy(*keys).agg(first).select(*keys[:-1], (F.col("first.upto") - F.col("first.inside")).alias("base"), F.col("first.bucket").alias("bucket"), F.col("first.inside").alias("inside"))
    budget, base, inside = F.col("budget"), F.col("base"), F.col("inside")
    bound = bound.withColumn("last", (budget > 0) & (base + inside - budget <= budget - base))
    of = if_small(bound.withColumnRenamed("source", "_source"), n_sources)
    taken = (F.col("budget") > 0) & ((F.col("h") < F.col("bucket")) | ((F.col("h") == F.col("bucket")) & F.col("last")))
    joined = sized.join(of, sized["source"].eqNullSafe(of["_source"]))
    return joined.select("doc_id", sized["source"], "size", "source_size", "target", (F.col("full") + taken.cast("long")).alias("copies"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
total AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM total),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
target AS (SELECT source, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM levels),
budgeted AS (
  SELECT *, target - whole * source_size AS budget
  FROM (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM target)),
upto AS (
  SELECT s.*, b.source_size, b.target, b.whole, b.budget, sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u,
         sum(size) OVER (PARTITION BY s.source, h) AS own
  FROM sized s JOIN budgeted b ON s.source IS NOT DISTINCT FROM b.source),
ending AS (SELECT *, min(CASE WHEN u >= budget THEN h END) OVER (PARTITION BY source) AS last FROM upto)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN budget > 0 AND (h < last OR h = last AND u - budget <= budget - (u - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ending
"""
