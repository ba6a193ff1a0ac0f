"""Code tables, dumps of court rulings, refined scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_codes(spark: SparkSession, path: str, flags: tuple[str, ...] = ("in_use", "injury_related")) -> DataFrame:
    """A code table from CSV: the first line names the columns, all texts but for the flags; an empty field is null."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "").csv(path)
    truth = lambda c: F.lower(F.trim(F.col(c))).isin("t", "true", "1", "y", "yes")
    return rows.select(*[F.when(F.col(c).isNotNull(), truth(c)).alias(c) if c in flags else F.col(c) for c in rows.columns])


# Words that tell a ruling of interest, words that must stand beside them in the body, the mark of the latter, fields.
KEYWORDS = ("국가유공자", "보훈보상", "보훈심사", "참전유공자", "고엽제", "상이등급", "전공사상", "공상군경", "순직군경", "무공수훈", "보국수훈", "지원공상", "재해부상군경", "상이연금", "전상군경")
SOFT = ("보훈", "유공자")
IN_BODY = "(전문)"
TITLE, POINTS, GIST, BODY, COURT, NUMBER, DAY = "사건명", "판시사항", "판결요지", "판례내용", "법원명", "사건번호", "선고일자"
RULING = T.StructType().add("PrecService", T.StructType([T.StructField(c, T.StringType()) for c in (TITLE, POINTS, GIST, BODY, COURT, NUMBER, DAY)]))


def keyword(head: Column, body: Column, words: tuple[str, ...] = KEYWORDS, soft: tuple[str, ...] = SOFT) -> Column:
    """The first of the words that stands in the head, else the first in the body, marked, if a soft word stands anywhere; else null."""
    head, body = F.coalesce(head, F.lit("")), F.coalesce(body, F.lit(""))
    inside = lambda text: F.coalesce(*[F.when(F.contains(text, F.lit(w)), w) for w in words])
    beside = F.lit(False)
    for w in soft:
        beside = beside | F.contains(F.concat(head, body), F.lit(w))
    return F.coalesce(inside(head), F.when(beside, F.concat(inside(body), F.lit(IN_BODY))))


def rulings(rows: DataFrame) -> DataFrame:
    """Rows (svc: the fields of a ruling, url) of interest: keyword, case_no, court, date, title, gist, body, url."""
    s = lambda c: F.coalesce(F.col(f"svc.{c}"), F.lit(""))
    bare = lambda c: F.nullif(F.trim(F.regexp_replace(s(c), r"<br\s*/?>", " ")), F.lit(""))
    found = keyword(F.concat_ws(" ", s(TITLE), s(POINTS), s(GIST)), s(BODY))
    return rows.withColumn("keyword", found).where("keyword IS NOT NULL").select(
        "keyword", F.trim(F.concat_ws(" ", s(COURT), s(NUMBER))).alias("case_no"), F.col(f"svc.{COURT}").alias("court"), F.substring(s(DAY), 1, 10).alias("date"), F.col(f"svc.{TITLE}").alias("title"),
        F.substring(F.concat_ws(" / ", bare(POINTS), bare(GIST)), 1, 2000).alias("gist"), F.substring(F.regexp_replace(s(BODY), r"<br\s*/?>", "\n"), 1, 20000).alias("body"), "url",
    )


def read_rulings(spark: SparkSession, path: str) -> DataFrame:
    """Rulings of interest of a dump: folders with names of 32 characters, each with a JSON file and maybe one of the same name and _meta
    beside it that has the url. Of several files the first by name counts; what can't be read is left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    files = files.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("at"), name.alias("name"), folder.alias("folder"), "value").where(F.length("folder") == 32)
    meta = F.endswith("name", F.lit("_meta.json"))
    urls = files.where(meta).select("at", F.regexp_replace("name", "_meta[.]json$", "").alias("stem"), F.get_json_object("value", "$.url").alias("url"))
    first = files.where(~meta).groupBy("at").agg(F.min(F.struct("name", "value")).alias("f"))
    rows = first.select("at", F.regexp_replace("f.name", "[.]json$", "").alias("stem"), F.from_json("f.value", RULING)["PrecService"].alias("svc")).where("svc IS NOT NULL")
    return rulings(rows.join(urls, ["at", "stem"], "left"))


# Refined scans ------------------------------------------------------------------------------------

_TEXTS = ["grade", "exam_kind", "date", "kcd", "person", "hospital"]
_PART = T.StructType().add("doc_type", "string").add("line_range", T.ArrayType(T.IntegerType())).add("disease", "string").add("fixes", T.ArrayType(T.StringType())).add("corrected", "string")
for _c in _TEXTS:
    _PART = _PART.add(_c, "string")
FINAL = T.StructType().add("source", "string").add("birth", "string").add("person", "string").add("docs", T.ArrayType(_PART))


def final_scans(rows: DataFrame) -> DataFrame:
    """Scans of refined files (path, value: JSON): file_name, reg_no, person, hospital, doc_kind, pages, raw_text, blocks.

    A block's line is the first of its range; a list of diseases becomes one text; the first disease and hospital found stand for the scan, and a
    scan of several parts is a bundle. An excerpt has 400 characters.
    """
    rows = rows.select("path", F.from_json("value", FINAL).alias("f")).where("f.docs IS NOT NULL")
    listed = lambda d: F.coalesce(F.array_join(F.from_json(d["disease"], "array<string>"), ", "), d["disease"])
    named = lambda d: F.when(F.startswith(d["disease"], F.lit("[")), listed(d)).otherwise(d["disease"])
    fixed = lambda d: F.when(d["fixes"].isNull(), 0).otherwise(F.size(d["fixes"]))
    block = lambda d: F.struct(
        d["doc_type"].alias("doc"), F.get(d["line_range"], F.lit(0)).alias("line"), F.struct(named(d).alias("disease"), *[d[c].alias(c) for c in _TEXTS]).alias("fields"),
        (fixed(d) > 0).alias("corrected"), fixed(d).alias("n_fixes"), F.substring(F.coalesce(d["corrected"], F.lit("")), 1, 400).alias("excerpt"),
    )
    rows = rows.withColumn("blocks", F.transform("f.docs", block))
    first = lambda c: F.get(F.filter(F.transform("blocks", lambda b: b["fields"][c]), lambda x: x.isNotNull() & (x != "")), F.lit(0))
    many = F.concat(F.lit("의무기록 묶음("), F.coalesce(first("disease"), F.concat(F.size("blocks").cast("string"), F.lit("건"))), F.lit(")"))
    kind = F.when(F.size("blocks") == 1, F.get("blocks", F.lit(0))["doc"]).otherwise(many)
    text = F.array_join(F.transform("f.docs", lambda d: F.coalesce(d["corrected"], F.lit(""))), "\n\n")
    return rows.select(F.col("f.source").alias("file_name"), F.col("f.birth").alias("reg_no"), F.col("f.person").alias("person"), first("hospital").alias("hospital"), kind.alias("doc_kind"), F.col("path").alias("orig_path"), F.size("blocks").alias("pages"), text.alias("raw_text"), "blocks")
