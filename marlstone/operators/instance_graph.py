"""The graph of scanned documents: persons, issuers, diseases, codes, grades, agendas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import diseases, grade
from . import graph
from .matching import regex_join
from .rules import compiled
from .shared import fresh_dir, written


def mentions(blocks: DataFrame) -> DataFrame:
    """Blocks (sd_id, doc, line, fields, norm) with what they say: diseases (those of both readings), code, grade.

    fields and norm are structs of disease, grade, kcd and disease, grade, source. A grade that a model put right is trusted alone, even if
    it is none; else the normalised one counts before the rule's.
    """
    model = F.coalesce(F.col("norm.source") == "llm", F.lit(False))
    both = F.array_distinct(F.concat(diseases(F.col("norm.disease")), diseases(F.col("fields.disease"))))
    chosen = F.when(model, grade(F.col("norm.grade"))).otherwise(F.coalesce(grade(F.col("norm.grade")), grade(F.col("fields.grade"))))
    return blocks.select("sd_id", "doc", "line", both.alias("diseases"), F.nullif(F.col("fields.kcd"), F.lit("")).alias("kcd"), chosen.alias("grade"))


def layer(scans: DataFrame, blocks: DataFrame, agendas: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (ntype, key, name) and edges (stype, skey, etype, dtype, dkey) of the scans.

    scans: sd_id, person, reg_no, hospital, doc_kind, ga_id; agendas: ga_id, agenda_no; rules: pattern (those that can't be
    compiled are left out; they are read when this is called). What blocks say is worked out once and written when this is called. Codes of a scan meet its diseases by sd_id, each pair once.
    """
    said = written(mentions(blocks), fresh_dir(blocks.sparkSession, "mentions"))  # five kinds of edges and nodes read it
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    owner = F.when(filled("person").isNotNull(), F.concat("person", F.lit(":"), F.coalesce("reg_no", F.lit(""))))
    scans = scans.select("*", owner.alias("owner"), F.trim(F.concat(F.coalesce(filled("person"), F.lit("미상")), F.lit(" "), F.coalesce("doc_kind", F.lit("")))).alias("title"))
    of = said.select("sd_id", "doc", "line", F.explode("diseases").alias("disease"))
    coded = said.where("kcd IS NOT NULL").select("sd_id", "kcd", "doc")
    graded = said.where("grade IS NOT NULL").select("sd_id", "grade")
    per_code = of.select("sd_id", "disease").distinct().join(coded.hint("merge"), "sd_id")  # both grow with the scans: neither is for the driver to hold
    kinds = of.select("disease").distinct()
    good, _ = compiled(rules)
    matches = regex_join(kinds.select(F.col("disease").alias("text")), good).withColumnRenamed("text", "disease")
    node = lambda df, kind, key, name: df.select(F.lit(kind).alias("ntype"), F.col(key).cast("string").alias("key"), F.col(name).alias("name")).where("key IS NOT NULL AND key <> ''")
    nodes = graph.nodes(
        node(scans, "scan_doc", "sd_id", "title"), node(scans, "person", "owner", "person"), node(scans, "hospital", "hospital", "hospital"), node(kinds, "disease", "disease", "disease"),
        node(coded, "kcd", "kcd", "kcd"), node(graded, "grade", "grade", "grade"), node(agendas, "grade_agenda", "ga_id", "agenda_no"),
    )
    given = scans.join(agendas.select("ga_id").hint("merge"), "ga_id", "left_semi")
    parts = [
        (scans, "HAS_DOC", ("person", "owner"), ("scan_doc", "sd_id")), (scans.withColumn("hospital", filled("hospital")), "ISSUED_BY", ("scan_doc", "sd_id"), ("hospital", "hospital")),
        (of, "MENTIONS", ("scan_doc", "sd_id"), ("disease", "disease")), (matches, "MATCHES_RULE", ("disease", "disease"), ("jr_disease", "pattern")),
        (coded, "MENTIONS_KCD", ("scan_doc", "sd_id"), ("kcd", "kcd")), (per_code, "CODED_AS", ("disease", "disease"), ("kcd", "kcd")), (graded, "ASSIGNS_GRADE", ("scan_doc", "sd_id"), ("grade", "grade")),
        (given, "CONVERTED_TO", ("scan_doc", "sd_id"), ("grade_agenda", "ga_id")), (given, "HAS_AGENDA", ("person", "owner"), ("grade_agenda", "ga_id")),
    ]
    edges = None
    for df, kind, src, dst in parts:
        found = graph.edges(df, kind, src, dst)
        edges = found if edges is None else edges.unionByName(found)
    return nodes, edges
