"""Document blocks from JSON files, request texts and plain texts, with a confidence gate and correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = T.StructType().add("type", "string").add("text", "string").add("page", "integer").add("confidence", "double")
DOCUMENT = T.StructType().add("doc_id", "string").add("severity", "string").add("blocks", T.ArrayType(BLOCK))
GATE = 0.85


def _defaults(b: Column) -> list[Column]:
    return [F.coalesce(b["type"], F.lit("other")).alias("type"), b["text"].alias("text"), F.coalesce(b["page"], F.lit(1)).alias("page"), F.coalesce(b["confidence"], F.lit(1.0)).alias("confidence")]


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Files {"doc_id", "blocks": [...]}; the schema is given, missing fields take defaults."""
    rows = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    return rows.select("doc_id", F.posexplode("blocks").alias("seq", "b")).select("doc_id", "seq", *_defaults(F.col("b")))


def from_text(docs: DataFrame) -> DataFrame:
    """Paragraphs between blank lines; the page is the ordinal of those that aren't blank."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.select("doc_id", F.posexplode(parts).alias("seq", "text"))
    return rows.select("doc_id", "seq", F.lit("paragraph").alias("type"), "text", (F.col("seq") + 1).alias("page"), F.lit(0.5).alias("confidence"))


def from_request(docs: DataFrame) -> DataFrame:
    """Blocks of requests (doc_id, text): a JSON object with blocks gives these, with defaults (a block without a type is a
    paragraph); any other text its paragraphs."""
    held = F.from_json("text", T.StructType().add("blocks", T.ArrayType(BLOCK)))["blocks"]
    rows = docs.select("doc_id", "text", held.alias("held"))
    given = rows.where("held IS NOT NULL").select("doc_id", F.posexplode("held").alias("seq", "b"))
    paragraph = F.coalesce(F.col("b")["type"], F.lit("paragraph")).alias("type")
    return given.select("doc_id", "seq", paragraph, *_defaults(F.col("b"))[1:]).unionByName(from_text(rows.where("held IS NULL")))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files of a directory tree: path, length, content, sha256."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return rows.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def manifest_check(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, status): ok, missing, mismatch or extra against expected (path, sha256)."""
    both = files.select("path", F.col("sha256").alias("have")).join(expected.select("path", F.col("sha256").alias("want")), "path", "full_outer")
    status = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("have") == F.col("want"), "ok").otherwise("mismatch")
    return both.select("path", status.alias("status"))


def needs_check(kind: Column, confidence: Column, every: bool = False) -> Column:
    return (kind != "figure") & (F.lit(every) | (confidence < GATE))


# Specks that go; letters that stand for another anywhere; letters that are digits beside a digit.
NOISE = "·¸'˙‚ˈ|"
SAFE = {"멍": "명", "힝": "항", "싱": "심", "둥": "등", "흔": "훈"}
BY_DIGIT = {"O": "0", "l": "1", "B": "8", "S": "5", "ㅡ": "-"}
#: A character that is a digit in any script, or raised, lowered or circled.
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]"
_MARK = "\ue000"


def correct(text: Column) -> Column:
    """Specks go and line ends become spaces; letters of SAFE are put right; those of BY_DIGIT if the character before, as it is
    then, or the next one is a digit; white space is squeezed.

    Going from left to right, a letter put right makes a digit for the next one (but for the dash). So these letters are marked where
    they follow a digit, where they follow the last marked one, or where a digit comes next.
    """
    text = F.regexp_replace(text, f"[{NOISE}{_MARK}]", "")
    text = F.translate(F.translate(text, "\n", " "), "".join(SAFE), "".join(SAFE.values()))
    some = f"[{''.join(BY_DIGIT)}]"
    text = F.regexp_replace(text, rf"(?<={DIGIT}){some}|(?<!^)(?<!ㅡ)\G{some}|{some}(?={DIGIT})", _MARK + "$0")
    for letter, digit in BY_DIGIT.items():
        text = F.replace(text, F.lit(_MARK + letter), F.lit(digit))
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "), "^ | $", "")


def verified(blocks: DataFrame, every: bool = False) -> DataFrame:
    """Corrects blocks that need it and keeps the text before (raw)."""
    need = needs_check(F.col("type"), F.col("confidence"), every)
    return blocks.withColumn("raw", F.when(need, F.col("text"))).withColumn("text", F.when(need, correct(F.col("text"))).otherwise(F.col("text")))
