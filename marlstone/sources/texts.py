"""Blocks from plain texts: pages, manuals, manuals with headings, precedents; PDF through a given extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAP = r"\n[ \t\r\n\f]*\n"
SPACES = r"[ \t\r\n\f]+"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def _paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, GAP), squeezed), lambda p: p != "")


def merged_lines(text: Column, least: int = 400) -> Column:
    """Lines without blank ones, joined by a space until a piece has at least `least` characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), squeezed), lambda x: x != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(held: Column, line: Column) -> Column:
        joined = F.trim(F.concat(held["open"], F.lit(" "), line))
        full = F.length(joined) >= least
        return F.struct(F.when(full, F.array_append(held["done"], joined)).otherwise(held["done"]).alias("done"), F.when(full, "").otherwise(joined).alias("open"))

    return F.aggregate(lines, empty, add, lambda held: F.when(held["open"] == "", held["done"]).otherwise(F.array_append(held["done"], held["open"])))


def page_blocks(pages: DataFrame, least: int = 15) -> DataFrame:
    """Blocks of pages (doc_id, page, text): paragraphs between blank lines, or merged lines where a page has one only.

    Pieces under `least` characters go. A null or blank page gives none (see empty_pages).
    """
    text = F.coalesce("text", F.lit(""))
    parts = _paragraphs(text)
    parts = F.filter(F.when(F.size(parts) > 1, parts).otherwise(merged_lines(text)), lambda p: F.length(p) >= least)
    return pages.select("doc_id", "page", F.posexplode(parts).alias("seq", "text")).select("doc_id", "seq", F.lit("paragraph").alias("type"), "text", "page", F.lit(1.0).alias("confidence"))


def empty_pages(pages: DataFrame) -> DataFrame:
    return pages.where(squeezed(F.coalesce("text", F.lit(""))) == "").select("doc_id", "page")


def has_text_layer(pages: DataFrame, least: int = 30) -> DataFrame:
    """(doc_id, layered): whether the text layer has `least` characters a page; else the scan needs recognition."""
    return pages.groupBy("doc_id").agg((F.sum(F.length(F.coalesce("text", F.lit("")))) >= least * F.count("*")).alias("layered"))


def read_pdf(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(doc_id, page, text) of PDF files below path; extract gives a file's pages as texts (the engine brings no PDF library)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                texts = extract(bytes(content))
                yield pd.DataFrame({"doc_id": name, "page": range(1, len(texts) + 1), "text": texts})

    return files.select("path", "content").mapInPandas(run, "doc_id string, page int, text string")


def manual_blocks(docs: DataFrame, least: int = 20, a_page: int = 8) -> DataFrame:
    """Paragraphs of at least `least` characters, numbered; every `a_page` of them count as a page."""
    parts = F.filter(_paragraphs(F.coalesce("text", F.lit(""))), lambda p: F.length(p) >= least)
    rows = docs.select("doc_id", F.posexplode(parts).alias("seq", "text"))
    return rows.select("doc_id", "seq", F.lit("paragraph").alias("type"), "text", (F.floor(F.col("seq") / a_page) + 1).cast("int").alias("page"), F.lit(1.0).alias("confidence"))


def heading_blocks(docs: DataFrame, heading: str = r"[ⅠⅡⅢⅣⅤⅥ]\s|\d+\.\s", least: int = 40, dots: int = 30, most: int = 2400) -> DataFrame:
    """Pieces that begin at a heading line. Short ones and tables of contents (many middle dots) go, long ones are cut."""
    parts = F.transform(F.split(F.coalesce("text", F.lit("")), rf"\n(?={heading})"), squeezed)
    n_dots = lambda p: F.length(p) - F.length(F.translate(p, "·", ""))
    parts = F.filter(parts, lambda p: (F.length(p) >= least) & (n_dots(p) <= dots))
    rows = docs.select("doc_id", F.posexplode(F.transform(parts, lambda p: F.substring(p, 1, most))).alias("seq", "text"))
    return rows.select("doc_id", "seq", F.lit("paragraph").alias("type"), "text", F.lit(1).alias("page"), F.lit(1.0).alias("confidence"))


def precedent_blocks(items: DataFrame, size: int = 1200, most: int = 20) -> DataFrame:
    """Blocks of precedents (doc_id, case_no, court, date, title, gist, body): a head with the gist, then slices of the body.

    At most `most` slices (a rule of the format); blank ones go, the page numbers stay.
    """
    head = F.concat(F.lit("["), F.concat_ws(" / ", *[F.nullif(F.col(c), F.lit("")) for c in ("case_no", "court", "date", "title")]), F.lit("]\n"), F.coalesce("gist", F.lit("")))
    body = F.coalesce("body", F.lit(""))
    last = F.least(F.ceil(F.length(body) / size), F.lit(most)).cast("int")
    slices = F.transform(F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(body, i * size + 1, F.lit(size)))
    rows = items.select("doc_id", F.posexplode(F.concat(F.array(head), slices)).alias("seq", "text"))
    rows = rows.where((F.col("seq") == 0) | (squeezed(F.col("text")) != ""))
    return rows.select("doc_id", "seq", F.lit("paragraph").alias("type"), "text", (F.col("seq") + 1).alias("page"), F.lit(1.0).alias("confidence"))


# What begins and ends a checklist, lines of its table head, endings of a whole item.
CHECKLIST = "검토서 체크리스트"
CHECKLIST_END = "패스트 트랙|분야별 심사|보훈심사 개요"
CHECKLIST_HEAD = ("체 크 사 항", "이상여부(체크)", "○ ×", "O X", "검토서 체크리스트")
ITEM_END = r"(는지\??|여부|확인|경우)$"
BULLETS = "-･∙․"


def checklists(docs: DataFrame, most: int = 3500) -> DataFrame:
    """Items (doc_id, seq, item, subs) of the last checklist of each text, within `most` characters of its heading.

    It ends at the next heading, 100 characters on at the earliest. Bullets belong to the item before; a line continues the
    item before if that has no bullets and no ending of a whole item. A text without a checklist gives nothing.
    """
    text = F.coalesce("text", F.lit(""))
    tail = F.when(F.contains(text, F.lit(CHECKLIST)), F.substring(F.concat(F.lit(CHECKLIST), F.substring_index(text, CHECKLIST, -1)), 1, most))
    rest = F.get(F.split(F.substring(tail, 101, most), CHECKLIST_END), 0)
    lines = F.transform(F.split(F.concat(F.substring(tail, 1, 100), rest), r"\r?\n"), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: ~x.isin("", *CHECKLIST_HEAD) & ~F.rlike(x, F.lit(r"^[ⅠⅡⅢⅣⅤ\d\s]+$")))
    none = F.array().cast("array<string>")
    item = lambda name, subs: F.struct(name.alias("item"), subs.alias("subs"))

    def add(held: Column, line: Column) -> Column:
        last = F.get(held, F.size(held) - 1)
        before = F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))
        bullet = F.rlike(line, F.lit(f"^[{BULLETS}]"))
        open_ = (F.size(held) > 0) & (F.size(last["subs"]) == 0) & ~F.rlike(last["item"], F.lit(ITEM_END))
        with_bullet = F.array_append(before, item(last["item"], F.array_append(last["subs"], F.regexp_replace(line, f"^[{BULLETS} ]+", ""))))
        longer = F.array_append(before, item(F.concat(last["item"], F.lit(" "), line), none))
        return F.when(bullet & (F.size(held) == 0), held).when(bullet, with_bullet).when(open_, longer).otherwise(F.array_append(held, item(line, none)))

    found = F.aggregate(lines, F.array().cast("array<struct<item:string,subs:array<string>>>"), add)
    return docs.select("doc_id", F.posexplode(found).alias("seq", "x")).select("doc_id", "seq", "x.item", "x.subs")
