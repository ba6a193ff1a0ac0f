"""A training corpus from documents: quality, lines, near duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.bpe import bpe_encode
from marlstone.llm.classifier import classify
from marlstone.llm.common import documents, fresh_dir, table
from marlstone.llm.jaccard import jaccard_components
from marlstone.llm.lines import dedup_lines
from marlstone.llm.mixing import mix_sources

#: SQL can't express the classifier, the Jaccard components or the tokens; the stages are tested against plain versions, one after the other.
ORACLE_SQL = None


def _matched(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with found's columns by doc_id, also where it is null; found has one row a doc_id.

    Own names are longer than any of docs, so none clashes.
    """
    key = _own(docs, "id")
    found = found.withColumnRenamed("doc_id", key)
    return docs.join(found, docs["doc_id"].eqNullSafe(found[key])).drop(key)


def _own(docs: DataFrame, name: str) -> str:
    return name + "_" * (1 + max(map(len, docs.columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; of rows that repeat an id the best decides for all.

    A null or empty text is judged by its statistics, a very long one as a whole; rows with a null id are
    one id; no rows give no rows. Any further columns come along.
    """
    good = classify(docs, table(spark, sf_dir, "labels")).groupBy("doc_id").agg(F.max("predicted").alias("good")).where("good = 1").select("doc_id")
    return _matched(docs, good)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars follows. Every document stays, if with an empty text.

    A null text comes out empty. Rows that repeat an id are one document that holds a line;
    a row with a null id keeps all its lines; no rows give no rows. Any further columns come along.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = docs.select("doc_id", "text", *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest")] if rest else []))
    kept = dedup_lines(one, carry=["rest"] if rest else [])
    count = lambda c: F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"rest.`{c}`")
    return kept.select(*(F.col(c) if c in ("doc_id", "text") else count(c).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document whose id names it stays, with all rows that repeat its id; a row without an id stays.

    Texts that are null, empty or without words are linked with nothing and stay; no rows give no rows. Any further
    columns come along.
    """
    found = jaccard_components(docs).select("doc_id", "component_id").where("doc_id = component_id OR doc_id IS NULL").select("doc_id").distinct()
    return _matched(docs, found)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be not at all.

    Rows that repeat an id are taken alike, rows with a null id are one id, and documents without words go as their
    hash says, never more often than the mix's limit; no rows give no rows. Any further columns come along.
    """
    copies, one = _own(docs, "copies"), _own(docs, "copy")
    taken = mix_sources(docs).groupBy("doc_id").agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    return _matched(docs, taken).withColumn(one, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).drop(copies, one)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the bytes that they decode to, for every row; a null text has no tokens, no rows give no rows."""
    return bpe_encode(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again by the next."""
    docs, at = documents(spark, sf_dir), fresh_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
