"""Idempotent loads, upserts and event logs reduced to their latest state, over immutable tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dedupe_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key, the first by order: a grouped minimum, combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    first = F.min(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in rest])).alias("first")
    return df.groupBy(*key).agg(first).select(*key, *[F.col(f"first._{c}").alias(c) for c in rest])


def new_only(batch: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a batch whose key isn't held; nulls in keys are equal."""
    on = [batch[k].eqNullSafe(held[k]) for k in key]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return batch.join(held, cond, "left_anti")


def upsert(held: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the batch replace those of the same key; the others stay."""
    return new_only(held, batch, key).unionByName(batch)


def replace_changed(held: DataFrame, batch: DataFrame, key: str, digest: str) -> DataFrame:
    """Held rows of a key with another digest go and the batch's come; equal ones stay as they are."""
    changed = batch.join(held.select(key, F.col(digest).alias("_old")), key, "left").where(~F.col(digest).eqNullSafe(F.col("_old"))).drop("_old")
    return held.join(changed.select(key), key, "left_anti").unionByName(changed)


def latest(events: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    rows = events.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return rows.where("_n = 1").drop("_n")


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def conforms(df: DataFrame, required: dict[str, str]) -> list[str]:
    """Required columns that are missing or of another type."""
    held = dict(df.dtypes)
    return sorted(f"{c}: {held.get(c, 'missing')}" for c, t in required.items() if held.get(c) != t)


def upsert_newest(held: DataFrame, batch: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """upsert() of a batch that may have a key several times: its first row by order counts."""
    return upsert(held, latest(batch, key, order), key)


def reload_types(held: DataFrame, batch: DataFrame, kind: str = "doc_type") -> DataFrame:
    """All rows of the types that the batch has go, and the batch comes; nulls are a type."""
    return new_only(held, batch.select(kind).distinct(), [kind]).unionByName(batch)


def reload(held: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch instead of what is held, with its columns in their order and types."""
    return batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in held.schema])


def counted(held: DataFrame, events: DataFrame, key: str, counter: str) -> DataFrame:
    """A counter grown by one for each event of its key; no count is none. Events are added up before they move."""
    more = events.groupBy(key).agg(F.count("*").alias("_more"))
    grown = F.coalesce(F.col(counter), F.lit(0)) + F.col("_more")
    return held.join(more, key, "left").withColumn(counter, F.when(F.col("_more").isNull(), F.col(counter)).otherwise(grown)).drop("_more")


def edit_column(held: DataFrame, edits: DataFrame, key: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table, audit): edits (key, field, value, editor, at) of allowed text columns, the last of each field counting.

    The audit has every edit that was carried out, in turn: key, field, old_value, new_value, editor, at. An edit of another
    field or of a row that isn't held does nothing.
    """
    text = F.create_map(*[x for c in allowed for x in (F.lit(c), F.col(c).cast("string"))])
    first = held.select(key, text.alias("_first"))
    good = edits.where(F.col("field").isin(*allowed)).join(first, key)
    before = F.lag(F.struct("value")).over(Window.partitionBy(key, "field").orderBy("at"))
    old = F.when(before.isNull(), F.try_element_at("_first", F.col("field"))).otherwise(before["value"])
    audit = good.select(key, "field", old.alias("old_value"), F.col("value").alias("new_value"), "editor", "at")
    last = audit.groupBy(key, "field").agg(F.max_by(F.struct("new_value"), "at").alias("v"))
    wide = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("_new"))
    rows = held.join(wide, key, "left")
    new = lambda c: F.try_element_at("_new", F.lit(c))
    columns = [F.when(new(c).isNotNull(), new(c)["new_value"].cast(held.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in allowed else F.col(c) for c in held.columns]
    return rows.select(*columns), audit


def edit_items(items: Column, edits: Column, allowed: list[str]) -> Column:
    """An array of maps with an array of edits (maps) laid over it, place by place: allowed keys take the edit's value, trimmed, empty as
    null. Edits beyond the end add items; items beyond the edits go, but for the first."""
    edits = F.coalesce(edits, F.array().cast("array<map<string,string>>"))
    keep = lambda m: F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    value = lambda v: F.nullif(F.trim(v), F.lit(""))
    change = lambda e: F.transform_values(F.map_filter(keep(e), lambda k, _: k.isin(*allowed)), lambda _, v: value(v))

    def laid(old: Column, e: Column) -> Column:
        new = change(e)
        return F.map_concat(F.map_filter(keep(old), lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)

    return F.slice(F.zip_with(items, edits, laid), F.lit(1), F.greatest(F.size(edits), F.lit(1)))


# Stored tables ------------------------------------------------------------------------------------


def overwrite_parts(rows: DataFrame, at: str, by: str | list[str]) -> None:
    """The partitions that rows has replace those of the table at a place; the files of all others stay as they are."""
    by = [by] if isinstance(by, str) else by
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(at)


class KeyedTable:
    """A stored table dealt by a hash of its key to `parts` partitions (column _part). A write reads and replaces touched ones only."""

    def __init__(self, spark: SparkSession, at: str, key: list[str], parts: int = 64):
        self.spark, self.at, self.key, self.parts = spark, at, key, parts

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_part", F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int"))

    def create(self, rows: DataFrame) -> None:
        self._dealt(rows).repartition("_part").write.partitionBy("_part").parquet(self.at)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.at).drop("_part")

    def _replace(self, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        new = self._dealt(batch)
        touched = [r[0] for r in new.select("_part").distinct().collect()]  # at most `parts`
        if touched:
            held = self.spark.read.parquet(self.at).where(F.col("_part").isin(touched)).drop("_part").select(*batch.columns)
            overwrite_parts(self._dealt(change(held, batch)), self.at, "_part")

    def upsert(self, batch: DataFrame, order: list[Column]) -> None:
        """The batch's rows, of each key the first by order, replace those of the same key or are added."""
        self._replace(batch, lambda held, new: upsert_newest(held, new, self.key, order))

    def replace_changed(self, batch: DataFrame, digest: str) -> None:
        """Rows whose digest differs replace the held ones of their key; new keys are added."""
        self._replace(batch, lambda held, new: replace_changed(held, new, self.key[0], digest))
