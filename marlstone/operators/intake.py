"""Whole text files of scanned bundles to scans and blocks: mask, split at titles, fields, person, kind.

A file is one row from beginning to end: lines and segments are arrays of that row, so nothing is shuffled. A null or empty
text is one block of the default title without fields.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scans import FIELDS, NORM

# Titles that begin a document of a bundle; labels and wordings of its forms.
TITLES = (
    "신체검사 의사 소견서", "고엽제후유의증환자등검진결과통보서", "검진결과통보서", "고엽제후유의증환자등", "진 단서", "진단서", "입 퇴 원 요 약", "입퇴원요약",
    "외래재진기록", "외래기록", "외 래 기 록", "방사선 판독", "수술기록", "PULMONARY FUNCTION TEST", "경과기록지", "답변서", "사실조사", "의무조사보고서",
    "장애진단서", "영상검사결과", "기능검사결과", "소 견 서", "소견서", "신청사유", "병상일지",
)
SPACED = ("진 단서", "입 퇴 원 요 약", "외 래 기 록")  # these lose their spaces as names
HOSPITALS = ("부산보훈병원", "중앙보훈병원", "보훈병원")
RECORD = "의무기록"
NOT_NAMES = ("성별", "성명", "주민", "번호", "나이", "보훈", "관할", "신규", "재심")
NOT_FILES = ("제출서류", "진단서")
NOT_DISEASE = r"신체검사|의사\s*소견|소견서|질병명|상이처|구\s*분|요청사항|아래와\s*같이"
# Labels before a disease and a department and what isn't their value, titles of examinations, kinds of one, a certificate; years
# of a date; letters of a title's line beyond it, lines and letters of an excerpt, letters of a disease and of a department, lines with a name.
DISEASE_LABELS, DISEASE_LABEL, NOT_AFTER_DISEASE = ("상이처(질병명)", "신청질병명"), "질병명", ("질병명", "구분", "(")
DEPT_LABEL, NOT_AFTER_DEPT, NAME_LABEL, NOT_AFTER_NAME = "신검과목", ("신검", "소속"), "성명", ("성명", "주민", "번호")
EXAMINATIONS, KINDS, SPACED_KINDS, CERTIFICATE = ("신체검사", "소견서"), "재확인|재판정", r"재\s?심|신\s?규", "진단서"
YEARS, TITLE_ROOM, EXCERPT, DISEASE_CHARS, DEPT_CHARS, NAME_LINES = (1940, 2035), 12, (40, 400), 60, 20, 83
OUTSIDE, INSIDE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
RESIDENT = rf"{OUTSIDE}(\d{{6}}) ?[-–]? ?([1-4])(?:\d{{6}}|\*{{6}}){INSIDE}"
CODE = rf"{OUTSIDE}([A-Z]\d{{2}}(?:\.\d{{1,2}})?){INSIDE}"
GRADE = r"(\d급\s?\d?항?\s?\d{4}호|\d-\d-\d{4}|\d급)"
ANY_DATE = r"(\d{4})[.\-/년\s]{1,2}(\d{1,2})[.\-/월\s]{1,2}(\d{1,2})"
OPINION = r"(?:신체\s?장애\s?정도|검진\s?소견\s?1?)\s*\n+\s*(.{4,120}?)\n"


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, text) of whole text files; bytes that aren't UTF-8 become U+FFFD."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def masked(text: Column) -> Column:
    """Resident numbers keep their first seven digits. Masking again changes nothing."""
    return F.regexp_replace(text, RESIDENT, r"$1-$2******")


def after(lines: Column, label, unwanted: tuple[str, ...], span: int = 3) -> Column:
    """Values after the lines that label() accepts: of the next `span` lines the first with text and without unwanted words."""

    def value(line: Column, i: Column) -> Column:
        near = F.filter(F.transform(F.slice(lines, i + 2, span), lambda v: F.trim(v)), lambda v: (v != "") & ~F.exists(F.array(*map(F.lit, unwanted)), lambda w: F.contains(v, w)))
        return F.when(label(F.trim(line)), F.get(near, 0))

    return F.array_compact(F.transform(lines, value))


def valid_name(value: Column) -> Column:
    """Two to four Hangul syllables that aren't a label, without the mark of the deceased; else null."""
    bare = F.regexp_replace(F.regexp_replace(F.translate(value, " ", ""), "^[고.]*故*", ""), r"^\.+|\.+$", "")
    return F.when(F.rlike(bare, F.lit("^[가-힣]{2,4}$")) & ~bare.isin(*NOT_NAMES), bare)


def valid_disease(value: Column) -> Column:
    """A disease without the number before it, at most 60 characters; null for labels and single characters."""
    bare = F.regexp_replace(F.trim(value), r"^\d+[.)]\s*", "")
    return F.when((F.length(bare) >= 2) & ~F.rlike(bare, F.lit(NOT_DISEASE)), F.substring(bare, 1, DISEASE_CHARS))


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Unicode NFC, which no built-in function gives."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def person_of(file_name: Column) -> Column:
    """The name in a file name's brackets, else at its beginning."""
    name = composed(file_name)
    inner = valid_name(F.regexp_extract(name, r"[(\[]\s*故?\s*([가-힣]{2,4})\s*[)\]]", 1))
    head = valid_name(F.regexp_extract(name, "^故?([가-힣]{2,4})", 1))
    return F.coalesce(inner, F.when(~head.isin(*NOT_FILES), head))


def first_date(text: Column) -> Column:
    """The first date within 1940 to 2035, as yyyy-MM-dd; days up to 31 count in every month."""
    part = lambda d, i: F.regexp_extract(d, ANY_DATE, i).cast("int")
    good = F.filter(F.regexp_extract_all(text, F.lit(ANY_DATE), 0), lambda d: part(d, 1).between(*YEARS) & part(d, 2).between(1, 12) & part(d, 3).between(1, 31))
    found = F.get(good, 0)
    return F.when(F.size(good) > 0, F.format_string("%d-%02d-%02d", part(found, 1), part(found, 2), part(found, 3)))


def _fields(title: Column, lines: Column, body: Column) -> Column:
    disease = after(lines, lambda x: F.contains(x, F.lit(DISEASE_LABELS[0])) | F.contains(x, F.lit(DISEASE_LABELS[1])) | (x == DISEASE_LABEL), NOT_AFTER_DISEASE)
    dept = after(lines, lambda x: F.contains(x, F.lit(DEPT_LABEL)), NOT_AFTER_DEPT)
    examined = F.contains(title, F.lit(EXAMINATIONS[0])) | F.contains(title, F.lit(EXAMINATIONS[1]))
    kind = F.coalesce(_some(F.regexp_extract(body, KINDS, 0)), _some(F.regexp_extract(body, SPACED_KINDS, 0)))
    opinion = F.regexp_extract(body, OPINION, 1)
    return F.struct(
        first_date(body).alias("date"), valid_disease(F.get(disease, 0)).alias("disease"), _some(F.regexp_extract(body, GRADE, 1)).alias("grade"), F.when(examined, F.regexp_replace(kind, r"\s", "")).alias("exam_kind"),
        F.substring(F.get(dept, 0), 1, DEPT_CHARS).alias("exam_dept"), F.when(examined & valid_disease(opinion).isNotNull(), F.trim(opinion)).alias("opinion"), F.when(title == CERTIFICATE, _some(F.regexp_extract(body, CODE, 1))).alias("kcd"),
    ).cast(FIELDS)


def bundle_blocks(files: DataFrame, titles: tuple[str, ...] = TITLES) -> DataFrame:
    """Blocks (scan_id, seq, title, line, excerpt, fields, norm) of files (file_name, text); the file name is the scan's id.

    A line that begins with a title, spaces aside, and is less than 12 characters longer begins a block; the first title
    listed wins. A file without titles is one block. The excerpt: text of the first 40 lines, 400 characters at most.
    """

    def title(line: Column) -> Column:
        bare = F.translate(F.trim(line), " ", "")
        return F.coalesce(*[F.when(bare.startswith(b) & (F.length(bare) < len(b) + TITLE_ROOM), b if t in SPACED else t) for t in titles for b in [t.replace(" ", "")]])

    rows = files.select(F.col("file_name").alias("scan_id"), F.split(masked(F.coalesce("text", F.lit(""))), r"\r?\n").alias("lines"))
    marks = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), title(x).alias("title"))), lambda m: m["title"].isNotNull())
    rows = rows.select("scan_id", "lines", F.when(F.size(marks) > 0, marks).otherwise(F.array(F.struct(F.lit(0).alias("at"), F.lit(RECORD).alias("title")))).alias("marks"))
    part = lambda m, k: F.slice(F.col("lines"), m["at"] + 1, F.coalesce(F.get(F.col("marks"), k + 1)["at"], F.size("lines")) - m["at"])
    cut = rows.select("scan_id", F.posexplode(F.transform("marks", lambda m, k: F.struct(m["title"].alias("title"), (m["at"] + 1).alias("line"), part(m, k).alias("lines")))).alias("seq", "b")).select("scan_id", "seq", "b.*")
    excerpt = F.array_join(F.filter(F.transform(F.slice("lines", 1, EXCERPT[0]), lambda x: F.trim(x)), lambda x: x != ""), " ")
    return cut.select("scan_id", "seq", "title", "line", F.substring(excerpt, 1, EXCERPT[1]).alias("excerpt"), _fields(F.col("title"), F.col("lines"), F.array_join("lines", "\n")).alias("fields"), F.lit(None).cast(NORM).alias("norm"))


def bundle_scans(files: DataFrame, blocks: DataFrame, hospitals: tuple[str, ...] = HOSPITALS) -> DataFrame:
    """Scans (scan_id, reg_no, person, hospital, kind, text, pages) of files (file_name, text) and their blocks.

    The registration number is read before masking. The person stands after a name label of the first 80 lines, else in the
    file name. A single block gives the kind; a bundle is named by its first disease, else by its number of blocks.
    """
    text = F.coalesce("text", F.lit(""))
    head = F.slice(F.split(masked(text), r"\r?\n"), 1, NAME_LINES)
    named = after(head, lambda x: F.contains(x, F.lit(NAME_LABEL)), NOT_AFTER_NAME)
    person = F.coalesce(F.get(F.array_compact(F.transform(named, valid_name)), 0), person_of(F.col("file_name")))
    hospital = F.coalesce(*[F.when(F.contains(text, F.lit(h)), h) for h in hospitals])
    found = F.min(F.when(F.col("fields.disease").isNotNull(), F.struct("seq", F.col("fields.disease").alias("d"))))["d"]
    of = blocks.groupBy("scan_id").agg(F.count("*").cast("int").alias("pages"), F.min_by("title", "seq").alias("title"), found.alias("disease"))
    kind = F.when(F.col("pages") == 1, F.col("title")).otherwise(F.concat(F.lit(f"{RECORD} 묶음("), F.coalesce("disease", F.concat(F.col("pages").cast("string"), F.lit("건"))), F.lit(")")))
    docs = files.select(F.col("file_name").alias("scan_id"), _some(F.regexp_extract(text, RESIDENT, 1)).alias("reg_no"), person.alias("person"), hospital.alias("hospital"), masked(text).alias("text"))
    return docs.join(of, "scan_id").select("scan_id", "reg_no", "person", "hospital", kind.alias("kind"), "text", "pages")
