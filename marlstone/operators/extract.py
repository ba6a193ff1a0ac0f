"""Records from lines of scanned reports and bundles. A document's lines never leave its row's partition key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATE = r"(?:19[4-9]\d|20[0-3]\d)[-./]\s?(?:0?[1-9]|1[0-2])[-./]\s?(?:0?[1-9]|[12]\d|3[01])"


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


def segments(lines: DataFrame, anchor: Column) -> DataFrame:
    """Lines with the number of their segment; a segment begins at an anchor, what stands before the first is 0."""
    begun = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("segment", F.sum(anchor.cast("int")).over(begun))


def labelled(label: str, lines: str = "lines") -> Column:
    """The rest of the first line that starts with a label, or else the next of three lines with text that isn't a label."""
    n = len(label)
    at = F.array_position(F.transform(lines, lambda x: F.upper(F.trim(x)).startswith(label)), True)
    rest = F.trim(F.regexp_replace(F.substring(F.trim(F.element_at(lines, at.cast("int"))), n + 1, 10_000), "^[: ]+", ""))
    after = F.filter(F.transform(F.slice(lines, at.cast("int") + 1, 3), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^[A-Z ]+:"))
    return F.when(at > 0, F.coalesce(F.nullif(rest, F.lit("")), F.get(after, 0)))


def exam_reports(docs: DataFrame, labels: tuple[str, ...] = ("EXAM", "FINDING", "CONCLUSION", "READER")) -> DataFrame:
    """Exams of report texts: a line with two dates or more begins one; kept if it names an exam or a finding."""
    dates = F.regexp_extract_all("text", F.lit(DATE), 0)
    rows = segments(lines_of(docs), F.size(dates) >= 2).where("segment > 0")
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    seg = rows.groupBy("doc_id", "segment").agg(F.transform(ordered, lambda x: x["text"]).alias("lines"), F.min("line").alias("line"))
    found = F.regexp_extract_all(F.get("lines", 0), F.lit(DATE), 0)
    named = [labelled(x).alias(x.lower()) for x in labels]
    out = seg.select("doc_id", "segment", "line", F.get(found, 0).alias("requested"), F.get(found, 1).alias("examined"), F.get(found, 2).alias("read"), *named)
    return out.where(F.col(labels[0].lower()).isNotNull() | F.col(labels[1].lower()).isNotNull())


def bundles(docs: DataFrame, titles: tuple[str, ...]) -> DataFrame:
    """Documents of a bundle: a short line that starts with a title (spaces aside; the first title listed wins) begins one.

    A bundle without any title is one document named other. The excerpt is its first 40 lines, 400 characters at most.
    """
    bare = F.regexp_replace(F.col("text"), r"\s+", "")
    title = F.coalesce(*[F.when(bare.startswith(t.replace(" ", "")) & (F.length(bare) < len(t.replace(" ", "")) + 12), t) for t in titles])
    rows = segments(lines_of(docs).withColumn("title", title), F.col("title").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("line", "text", "title")))
    seg = rows.groupBy("doc_id", "segment").agg(ordered.alias("x"))
    text = F.substring(F.array_join(F.transform(F.slice("x", 1, 40), lambda v: v["text"]), "\n"), 1, 400)
    seg = seg.select("doc_id", "segment", F.get("x", 0)["title"].alias("title"), F.get("x", 0)["line"].alias("line"), text.alias("excerpt"))
    any_title = F.max(F.col("title").isNotNull()).over(Window.partitionBy("doc_id"))
    return seg.withColumn("any", any_title).where("title IS NOT NULL OR NOT any").select("doc_id", F.coalesce("title", F.lit("other")).alias("title"), "line", "excerpt")


# Marks of an exam's parts as scans have them (brackets may be lost), what ends a part, readers and their numbers.
DAY = r"\d{4}-\d{2}-\d{2}(?:\s?\d{2}:\d{2})?"
PARTS = {"dx": "임상진단", "exam_name": "검사명", "finding": r"(?i)\[?\s*Finding\s*\]?", "conclusion": r"(?i)\[?\s*Conclusion\s*\]?", "recommendation": r"(?i)\[?\s*Recommendation\s*\]?"}
ENDS = {"dx": "임상소견|검사명", "exam_name": PARTS["finding"], "finding": PARTS["conclusion"], "conclusion": PARTS["recommendation"], "recommendation": "판독의"}
LATIN = r"^[A-Za-z][A-Za-z0-9 ,&()\-./]+$"
READER = r"판독의\s*[:;]?\s*([가-힣]{2,5})\s*\(?\s*(\d+)?"
NUMBERED = r"([가-힣][가-힣\s]{1,6})?\(?\s*(\d{5,6})\s*\)\s*$"
READ = "판독"


def exam_blocks(pages: DataFrame) -> DataFrame:
    """Exams of scanned pages (doc_id, page, text): doc_id, place, page, req_date, exam_date, read_date, dx, exam_name, finding, conclusion,
    recommendation, reader. A line with two days or more begins one; kept if it names an exam or has a finding.

    A part is what stands between the first line with its mark, unless an earlier part took this line, and its end. Without a
    name the last Latin line before the finding, other than the diagnosis, is the name; without a reader a line that
    ends in a number of five or six digits names one. All is judged within an exam's own lines.
    """
    lines = pages.where("text IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.split("text", r"\r\n|[\n\r]", -1).alias("ls")))).alias("p"))
    flat = F.flatten(F.transform("p", lambda p: F.transform(p["ls"], lambda x: F.struct(p["page"].alias("page"), x.alias("x")))))
    rows = lines.select("doc_id", flat.alias("flat"))
    begins = F.filter(F.sequence(F.lit(1), F.size("flat")), lambda i: F.size(F.regexp_extract_all(F.element_at("flat", i)["x"], F.lit(DAY), 0)) >= 2)
    rows = rows.select("doc_id", "flat", begins.alias("begins")).where(F.size("begins") > 0)
    parts = F.transform("begins", lambda b, k: F.slice("flat", b, F.coalesce(F.get("begins", k + 1), F.size("flat") + 1) - b))
    rows = rows.select("doc_id", F.posexplode(parts).alias("place", "s")).select("doc_id", "place", F.col("s")[0]["page"].alias("page"), F.transform("s", lambda v: v["x"]).alias("ls"))
    taken: list[str] = []
    for name, mark in PARTS.items():  # where each part's mark is, none of them twice
        other = F.array(F.lit(-1), *[F.col(f"at_{p}") - 1 for p in taken])
        here = F.transform("ls", lambda x, i: F.rlike(x, F.lit(mark)) & ~F.array_contains(other, i))  # noqa: B023 (used at once)
        rows = rows.withColumn(f"at_{name}", F.array_position(here, True).cast("int"))
        taken.append(name)
    found = {}
    for name, end in ENDS.items():
        rest = F.slice("ls", F.col(f"at_{name}") + 1, F.size("ls"))
        stop = F.array_position(F.transform(rest, lambda x: F.rlike(x, F.lit(end))), True).cast("int")  # noqa: B023
        kept = F.filter(F.transform(F.slice(rest, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size("ls"))), lambda x: F.trim(x)), lambda x: x != "")
        found[name] = F.when(F.col(f"at_{name}") > 0, F.array_join(kept, " "))
    days = F.regexp_extract_all(F.get("ls", 0), F.lit(DAY), 0)
    rows = rows.select("doc_id", "place", "page", "ls", *[F.get(days, k).alias(c) for k, c in enumerate(("req_date", "exam_date", "read_date"))], *[c.alias(k) for k, c in found.items()])
    first = F.array_position(F.transform("ls", lambda x: F.rlike(x, F.lit(PARTS["finding"]))), True).cast("int")
    latin = F.filter(F.transform(F.slice("ls", F.lit(1), F.greatest(first - 1, F.lit(0))), lambda x: F.trim(x)), lambda x: F.rlike(x, F.lit(LATIN)) & (F.lower(x) != F.lower(F.trim(F.coalesce("dx", F.lit(""))))))
    name = F.when((F.coalesce("exam_name", F.lit("")) == "") & F.col("finding").isNotNull(), F.coalesce(F.get(latin, F.size(latin) - 1), F.col("exam_name"))).otherwise(F.col("exam_name"))
    said = F.get(F.filter("ls", lambda x: F.rlike(x, F.lit(READER))), 0)
    numbered = F.get(F.filter(F.transform("ls", lambda x: F.trim(x)), lambda x: F.rlike(x, F.lit(NUMBERED)) & (F.contains(x, F.lit(READ)) | (F.regexp_extract(x, NUMBERED, 1) != ""))), 0)
    called = F.replace(F.regexp_extract(numbered, NUMBERED, 1), F.lit(" "), F.lit(""))
    reader = F.coalesce(F.regexp_extract(said, READER, 1), F.concat(F.when(called != "", called).otherwise("판독의"), F.lit("("), F.regexp_extract(numbered, NUMBERED, 2), F.lit(")")))
    rows = rows.withColumn("exam_name", name).withColumn("reader", reader).drop("ls")
    return rows.where((F.coalesce("exam_name", F.lit("")) != "") | (F.coalesce("finding", F.lit("")) != ""))
