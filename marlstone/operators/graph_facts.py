"""What the graph of scans says of the persons, diseases and codes that a question names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How codes and grades are written.
CODE = r"(?<![A-Za-z0-9])[A-Z]\d{2}(?:\.\d{1,2})?(?!\d)"
GRADE = r"\d급\s?\d?\s?항?(?:\s?\d{4}\s?호)?"

# What is said of a person's scan, of a disease and of a code.
SCAN, NO_KIND, SCAN_DISEASES, SCAN_GRADES = " — 문서[", "스캔", " 질환: ", " · 기재 등급: "
PEOPLE, PEOPLE_END, CODES = " — 실데이터 대상자 ", "명: ", " (KCD "
CODE_HEAD, CODE_DISEASES, CODE_PEOPLE = "KCD ", " — 질환: ", " / 대상자: "


def entities(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, kind, name) of what questions (id, text) name: persons by words of two to four letters, diseases by containment, both of them
    nodes; codes and grades by how they are written.

    A disease meets the different texts that hold its first two letters before the whole is looked for, so no question meets every node;
    then questions meet what their text names.
    """
    person = nodes.where("ntype = 'person'").select("name").distinct()
    words = questions.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[가-힣]{2,4}"), 0))).alias("name"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))), lambda i: F.substring("text", i, 2))
    disease = nodes.where("ntype = 'disease'").select(F.col("key").alias("name")).distinct().withColumn("begin", F.substring("name", 1, 2))
    begins = F.concat(pairs, F.split("text", ""))  # a name may be one letter
    begun = _grown(questions.select("text").distinct().select("text", F.explode(F.array_distinct(begins)).alias("begin")), disease, "begin").where(F.contains("text", F.col("name")))
    begun = _grown(questions.select("id", "text"), begun.select("text", "name").distinct(), "text")
    written = lambda kind, pattern, bare: questions.select("id", F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), 0), bare))).alias("name"))
    found = _grown(words, person, "name").select("id", F.lit("person").alias("kind"), "name").unionByName(begun.select("id", F.lit("disease").alias("kind"), "name").distinct())
    return found.unionByName(written("code", CODE, lambda x: x)).unionByName(written("grade", GRADE, lambda x: F.regexp_replace(x, r"\s", "")))


def _ends(edges: DataFrame, kind: str, src: str, dst: str) -> DataFrame:
    return edges.where(F.col("etype") == kind).select(F.col("skey").alias(src), F.col("dkey").alias(dst)).distinct()


def _listed(edges: DataFrame, kind: str, name: str) -> DataFrame:
    """The ends of a scan's edges of a kind, sorted, one row a scan: branches are listed before they are joined."""
    return _ends(edges, kind, "scan", name).groupBy("scan").agg(F.array_sort(F.collect_set(name)).alias(name))


def _grown(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with scans or questions: their few, well compressed bytes must not make one a broadcast,
    which the driver would have to hold."""
    return left.join(right.hint("merge"), on, how)


def _said(label: str, c: str, end: str = ""):
    return F.when(F.size(F.col(c)) > 0, F.concat(F.lit(label), F.array_join(c, ", "), F.lit(end))).otherwise("")


def person_facts(found: DataFrame, nodes: DataFrame, edges: DataFrame, scans: DataFrame) -> DataFrame:
    """(id, name, fact): a line for each scan (sd_id, doc_kind) of a person named: its diseases, codes, grades."""
    person = nodes.where("ntype = 'person'").select(F.col("key").alias("person"), "name")
    rows = found.where("kind = 'person'").select("id", "name").join(person, "name")
    rows = _grown(rows, _ends(edges, "HAS_DOC", "person", "scan"), "person")
    for kind, name in (("MENTIONS", "diseases"), ("ASSIGNS_GRADE", "grades"), ("MENTIONS_KCD", "codes")):
        rows = _grown(rows, _listed(edges, kind, name), "scan", "left")
    rows = _grown(rows, scans.select(F.col("sd_id").cast("string").alias("scan"), "doc_kind"), "scan", "left")
    head = F.concat("name", F.lit(SCAN), F.coalesce(F.nullif("doc_kind", F.lit("")), F.lit(NO_KIND)), F.lit("#"), "scan", F.lit("]"))
    return rows.select("id", "name", F.concat(head, _said(SCAN_DISEASES, "diseases"), _said(CODES, "codes", ")"), _said(SCAN_GRADES, "grades")).alias("fact"))


def disease_facts(found: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, fact): how many persons' scans mention a disease named, who they are, and the codes beside it.

    What is said of a disease is put together once, then meets the questions that name it.
    """
    asked = found.where("kind = 'disease'").select("id", "name")
    people = _grown(_grown(_ends(edges, "MENTIONS", "scan", "name"), asked.select("name").distinct(), "name"), _ends(edges, "HAS_DOC", "person", "scan"), "scan").select("name", "person").distinct()
    called = _grown(people, nodes.where("ntype = 'person'").select(F.col("key").alias("person"), F.col("name").alias("who")), "person").groupBy("name").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("who")).alias("who"))
    codes = _ends(edges, "CODED_AS", "name", "code").groupBy("name").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    said = _grown(called, codes, "name", "left").select("name", F.concat("name", F.lit(PEOPLE), F.col("n").cast("string"), F.lit(PEOPLE_END), F.array_join("who", ", "), _said(CODES, "codes", ")")).alias("fact"))
    return _grown(asked, said, "name").select("id", "name", "fact")


def code_facts(found: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, fact): the diseases beside a code named, and the persons whose scans have it; a code that is nowhere gives none."""
    asked = found.where("kind = 'code'").select("id", "name")
    kinds = _ends(edges, "CODED_AS", "disease", "name").groupBy("name").agg(F.array_sort(F.collect_set("disease")).alias("diseases"))
    people = _grown(_ends(edges, "MENTIONS_KCD", "scan", "name"), _ends(edges, "HAS_DOC", "person", "scan"), "scan").join(nodes.where("ntype = 'person'").select(F.col("key").alias("person"), F.col("name").alias("who")), "person")
    people = people.groupBy("name").agg(F.array_sort(F.collect_set("who")).alias("who"))
    rows = _grown(_grown(asked, kinds, "name", "left"), people, "name", "left").where("diseases IS NOT NULL OR who IS NOT NULL")
    return rows.select("id", "name", F.concat(F.lit(CODE_HEAD), "name", F.lit(CODE_DISEASES), F.coalesce(F.array_join("diseases", ", "), F.lit("?")), _said(CODE_PEOPLE, "who")).alias("fact"))
