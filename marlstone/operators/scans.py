"""From scanned records to rows: header, normalised blocks, sections, cases and grade agendas.

Scans: (scan_id, reg_no, person, hospital, kind, text). Blocks: (scan_id, seq, title, line, excerpt, fields, norm), where
fields and norm are structs of FIELDS and NORM; norm is null until a block is normalised. Blocks of a scan are few; they
meet only by partial aggregates or within one scan's partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.replies import outer_json

FIELDS = "struct<date:string,disease:string,grade:string,exam_kind:string,exam_dept:string,opinion:string,kcd:string>"
NORM = "struct<doc_type:string,date:string,hospital:string,disease:string,grade:string,exam_kind:string,exam_dept:string,opinion:string,key_findings:array<string>,summary:string,source:string,src_line:int>"
STRICT_DATE = r"^(19[4-9]\d|20[0-3]\d)-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"
NOISE = "~^`|"


# What stands where nothing is known, a certificate that counts as a grade.
UNKNOWN, NO_DISEASE, NO_NAME, NO_GRADE, HOSPITAL, CERTIFICATE = "미상", "질병명 미상", "성명미상", "미기재", "보훈병원", "장애진단서"


def filled(c: Column) -> Column:
    """Null for a blank value."""
    return F.when(F.trim(c) != "", c)


def header(docs: DataFrame, patterns: dict[str, str], hospitals: tuple[str, ...], kinds: tuple[tuple[tuple[str, ...], str], ...], other: str = "record", head: int = 12) -> DataFrame:
    """Fields of the first lines (a pattern's first group each), the first listed hospital of the text, and its kind.

    kinds: (words, kind); a text that has all the words is of that kind, else `other`.
    """
    top = F.array_join(F.slice(F.split("text", "\n"), 1, head), "\n")
    found = [filled(F.regexp_extract(top, p, 1)).alias(k) for k, p in patterns.items()]
    has = lambda w: F.contains(F.col("text"), F.lit(w))
    hospital = F.coalesce(*[F.when(has(h), h) for h in hospitals]) if hospitals else F.lit(None).cast("string")
    kind = F.lit(other)
    for words, name in reversed(kinds):
        all_of = has(words[0])
        for w in words[1:]:
            all_of = all_of & has(w)
        kind = F.when(all_of, name).otherwise(kind)
    return docs.select("scan_id", *found, hospital.alias("hospital"), kind.alias("kind"))


def rule_norm(letters: str = "[가-힣]") -> Column:
    """The norm of a block by rule: its fields, and sentences of over ten characters with a letter of the language."""
    parts = F.transform(F.split(F.translate(F.coalesce("excerpt", F.lit("")), NOISE, ""), r"[\n.]"), lambda s: F.trim(s))
    good = F.filter(parts, lambda s: (F.length(s) > 10) & F.rlike(s, F.lit(letters)))
    field = lambda k: F.col("fields")[k].alias(k)
    return F.struct(
        F.col("title").alias("doc_type"), field("date"), F.lit(None).cast("string").alias("hospital"), field("disease"), field("grade"), field("exam_kind"), field("exam_dept"), field("opinion"),
        F.slice(good, 1, 3).alias("key_findings"), F.substring(F.get(good, 0), 1, 120).alias("summary"), F.lit("rule").alias("source"), F.col("line").cast("int").alias("src_line"),
    ).cast(NORM)


def _asked(generate: Callable[[str, str], str]) -> Callable:
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for titles, texts in batches:
            replies = []
            for title, text in zip(titles, texts, strict=True):
                try:
                    replies.append(generate(title or "", text or ""))
                except Exception:  # noqa: BLE001  a failed call falls back to the rule, which norm.source shows
                    replies.append(None)
            yield pd.Series(replies, dtype=object)

    return F.pandas_udf(run, "string")


def normalise(blocks: DataFrame, generate: Callable[[str, str], str] | None = None, limit: int | None = None, force: bool = False, letters: str = "[가-힣]") -> DataFrame:
    """Blocks with norm filled: by generate(title, text) where its reply holds a JSON object, else by rule.

    Blocks done before stay as they are (unless forced). limit: how many pending blocks of a scan one step takes, by seq;
    steps repeat until none is pending.
    """
    pending = F.lit(True) if force else F.col("norm").isNull()
    if limit is not None:
        nth = F.sum(pending.cast("int")).over(Window.partitionBy("scan_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
        blocks, pending = blocks.withColumn("_now", pending & (nth <= limit)), F.col("_now")
    new = rule_norm(letters)
    if generate:
        blocks = blocks.withColumn("_now", pending)
        pending = F.col("_now")
        todo = blocks.where("_now").withColumn("_reply", _asked(generate)("title", "excerpt"))
        blocks = todo.unionByName(blocks.where("NOT coalesce(_now, false)").withColumn("_reply", F.lit(None).cast("string")))
        told = F.from_json(outer_json(F.col("_reply")), NORM)
        told = F.when(outer_json(F.col("_reply")).isNotNull() & told.isNotNull() & F.try_parse_json(outer_json(F.col("_reply"))).isNotNull(), told.withField("source", F.lit("llm")).withField("src_line", F.col("line").cast("int")))
        new = F.coalesce(told, new)
    return blocks.withColumn("norm", F.when(pending, new).otherwise(F.col("norm"))).drop("_now", "_reply")


def sections(blocks: DataFrame, scans: DataFrame) -> DataFrame:
    """One row a block: the normalised value, else the field, else what the block or scan has; blanks don't count."""
    b = blocks.join(scans.select("scan_id", F.col("hospital").alias("_hospital")), "scan_id", "left")
    norm, field = (lambda k: filled(F.col("norm")[k])), (lambda k: filled(F.col("fields")[k]))
    both = lambda k: F.coalesce(norm(k), field(k)).alias(k)
    return b.select(
        "scan_id", "seq", F.coalesce(norm("doc_type"), filled(F.col("title")), F.lit(UNKNOWN)).alias("doc_type"), both("date"), F.coalesce(norm("hospital"), F.col("_hospital")).alias("hospital"),
        both("disease"), both("grade"), both("exam_kind"), field("kcd").alias("kcd"), both("opinion"), norm("summary").alias("summary"),
        F.coalesce(F.col("norm")["key_findings"], F.array().cast("array<string>")).alias("key_findings"), F.col("line").alias("source_line"), F.col("norm").isNotNull().alias("normalized"), norm("source").alias("norm_source"),
    )


def clean_text(rows: DataFrame) -> DataFrame:
    """The readable text of each scan: its sections in order, a line for each value present, and the source line."""
    names = ("date", "hospital", "disease", "grade", "exam_kind", "kcd", "opinion", "summary")
    values = [F.when(filled(F.col(k)).isNotNull(), F.concat(F.lit(f"{k}: "), F.col(k))) for k in names]
    findings = F.when(F.size("key_findings") > 0, F.concat(F.lit("- "), F.array_join("key_findings", "\n- ")))
    part = F.concat_ws("\n", F.concat(F.lit("["), "doc_type", F.lit("]")), *values, findings, F.when(F.col("source_line").isNotNull(), F.concat(F.lit("(line "), F.col("source_line").cast("string"), F.lit(")"))))
    g = rows.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("seq", part.alias("part")))).alias("parts"), F.count("*").alias("n_sections"))
    return g.select("scan_id", "n_sections", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("text"))


def first_values(blocks: DataFrame, *keys: str, normalised: bool) -> DataFrame:
    """Each key's first value that isn't blank, by seq (of equal ones the smallest value); a partial aggregate, so a scan's blocks needn't meet."""
    value = lambda k: F.coalesce(filled(F.col("norm")[k]), filled(F.col("fields")[k])) if normalised and k != "kcd" else filled(F.col("fields")[k])
    firsts = [F.min(F.when(value(k).isNotNull(), F.struct(F.col("seq").alias("seq"), value(k).alias("v"))))["v"].alias(k) for k in keys]
    certified = F.bool_or(F.coalesce(F.contains("title", F.lit(CERTIFICATE)), F.lit(False))).alias("certified")
    return blocks.groupBy("scan_id").agg(*firsts, certified, F.count("*").alias("n_blocks"))


def _kept_kind(kind: Column) -> Column:
    return filled(F.regexp_extract(kind, r"^의무기록 묶음\((.*?)\)*$", 1))


def cases(scans: DataFrame, blocks: DataFrame, held: DataFrame) -> dict[str, DataFrame]:
    """applications, disabilities, records and links of scans with blocks. held: (recv_no, app_id).

    A scan whose number is held is linked to its application and makes no rows.
    """
    b = first_values(blocks, "disease", "kcd", "grade", "date", normalised=False)
    rows = scans.join(b, "scan_id").withColumn("recv_no", F.concat(F.lit("RD"), F.coalesce(filled(F.col("reg_no")), F.col("scan_id").cast("string"))))
    rows = rows.withColumn("disease", F.coalesce("disease", _kept_kind(F.col("kind")), F.lit(NO_DISEASE)))
    known = rows.join(held, "recv_no")
    new = rows.join(held, "recv_no", "left_anti")
    born = F.substring("reg_no", 1, 2).try_cast("int") + 1900
    applications = new.groupBy("recv_no").agg(F.min_by(F.struct("scan_id", F.coalesce(filled(F.col("person")), F.lit(NO_NAME)).alias("applicant"), born.alias("birth_year"), "disease", "n_blocks"), "scan_id").alias("x")).select("recv_no", "x.*")
    chosen = new.join(applications.select("scan_id"), "scan_id", "left_semi")
    month = F.replace(F.substring("date", 1, 7), F.lit("-"), F.lit("."))
    disabilities = chosen.select("recv_no", F.col("disease").alias("name"), "kcd", month.alias("onset"), F.coalesce("grade", F.lit(NO_GRADE)).alias("grade"))
    day = F.col("fields")["date"]
    records = blocks.join(chosen.select("scan_id", "recv_no", "hospital"), "scan_id").select(
        "recv_no", "seq", F.coalesce(filled(F.col("hospital")), F.lit(HOSPITAL)).alias("hospital"), F.col("title").alias("rec_type"),
        F.when(F.rlike(day, F.lit(STRICT_DATE)), day).alias("rec_date"), F.col("fields")["disease"].alias("diagnosis"), F.substring("excerpt", 1, 400).alias("finding"),
    )
    links = known.select("scan_id", "recv_no", "app_id").unionByName(new.select("scan_id", "recv_no", F.lit(None).cast(held.schema["app_id"].dataType).alias("app_id")))
    return {"applications": applications, "disabilities": disabilities, "records": records, "links": links}


def agendas(scans: DataFrame, blocks: DataFrame, held: DataFrame) -> DataFrame:
    """A grade agenda for every scan with blocks; held: (agenda_no, agenda_id), which mark those that exist.

    Normalised values go before fields. Without a grade, a certificate among the blocks stands for it.
    """
    b = first_values(blocks, "disease", "grade", "exam_kind", "exam_dept", "opinion", normalised=True)
    rows = scans.join(b, "scan_id").withColumn("agenda_no", F.concat(F.lit("RD"), F.coalesce(filled(F.col("reg_no")), F.col("scan_id").cast("string")), F.lit("호")))
    disease = F.coalesce("disease", _kept_kind(F.col("kind")), F.lit(NO_DISEASE))
    grade = F.coalesce("grade", F.when(F.col("certified"), CERTIFICATE))
    out = rows.join(held, "agenda_no", "left")
    return out.select("scan_id", "agenda_no", "agenda_id", F.col("agenda_id").isNotNull().alias("existed"), disease.alias("injury"), grade.alias("exam_grade"), F.coalesce("exam_kind", F.lit("재확인")).alias("exam_kind"), "exam_dept", "opinion")
