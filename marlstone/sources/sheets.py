"""Rows of spreadsheet files (xlsx: zipped XML), read on the workers with the standard library."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _string(node: ElementTree.Element) -> str:
    """The text of a string item; readings above characters don't count."""
    parts = [node, *node.findall(f"{MAIN}r")]
    return "".join(t.text or "" for p in parts for t in p.findall(f"{MAIN}t"))


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if c.isalpha():
            n = 26 * n + ord(c.upper()) - 64
    return n - 1


def sheet_rows(content: bytes) -> list[list[str]]:
    """The active sheet's rows as stripped strings, from row 1 on; absent cells are empty. Dates stay serial numbers."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [_string(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        view = book.find(f"{MAIN}bookViews/{MAIN}workbookView")
        active = book.findall(f"{MAIN}sheets/{MAIN}sheet")[int(view.get("activeTab", 0)) if view is not None else 0]
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[active.get(LINK)]
        sheet = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows: dict[int, dict[int, str]] = {}
    at = 0
    for row in sheet.iter(f"{MAIN}row"):
        at = int(row.get("r", at + 1))
        cells, x = rows.setdefault(at, {}), -1
        for c in row.findall(f"{MAIN}c"):
            x = _column(c.get("r")) if c.get("r") else x + 1
            kind, value = c.get("t", "n"), c.findtext(f"{MAIN}v") or ""
            if kind == "inlineStr":
                value = _string(c.find(f"{MAIN}is"))
            elif value:
                value = shared[int(value)] if kind == "s" else {"1": "True", "0": "False"}[value] if kind == "b" else value
            cells[x] = value.strip()
    width = max((max(r, default=-1) for r in rows.values()), default=-1) + 1
    return [[rows.get(i, {}).get(x, "") for x in range(width)] for i in range(1, max(rows, default=0) + 1)]


def read_sheets(spark: SparkSession, path: str, glob: str = "*.xlsx", skip: int = 3) -> DataFrame:
    """(path, row, cells) of spreadsheets below path, without their first `skip` rows. A task holds one file at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = sheet_rows(bytes(content))[skip:]
                yield pd.DataFrame({"path": pd.Series([name] * len(rows), dtype=object), "row": range(skip + 1, skip + 1 + len(rows)), "cells": pd.Series(rows, dtype=object)})

    return files.select("path", "content").mapInPandas(run, "path string, row int, cells array<string>")


def code_table(rows: DataFrame, columns: dict[str, int], needed: int = 1, flags: dict[str, tuple[int, str]] | None = None) -> DataFrame:
    """Named columns of rows (cells) that have the needed cell; a flag says whether a cell holds its word."""
    cell = lambda i: F.coalesce(F.get("cells", i), F.lit(""))
    named = [cell(i).alias(k) for k, i in columns.items()]
    return rows.where(cell(needed) != "").select(*named, *[(cell(i) == word).alias(k) for k, (i, word) in (flags or {}).items()])


def order_rules(rows: DataFrame, pairs: int = 4) -> DataFrame:
    """Rules with up to four pairs of item and result side by side, as a row for each pair; the pair's number stays, empty items go."""
    cell = lambda i: F.coalesce(F.get("cells", i), F.lit(""))
    items = F.filter(F.array(*[F.struct(F.lit(k + 1).alias("pair_order"), cell(5 + 2 * k).alias("judge_item"), cell(6 + 2 * k).alias("result")) for k in range(pairs)]), lambda p: p["judge_item"] != "")
    named = [cell(1).alias("rule_no"), cell(2).alias("review_type_name"), cell(3).alias("review_content"), cell(4).alias("target_cond")]
    return rows.where(cell(1) != "").select(*named, F.explode(items).alias("p"), (cell(5 + 2 * pairs) == "사용").alias("in_use")).select("rule_no", "review_type_name", "review_content", "target_cond", "p.*", "in_use")
