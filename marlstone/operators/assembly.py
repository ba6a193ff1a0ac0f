"""Sheets and documents assembled from confirmed parts, and the loops around a text generator."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import NOTHING_TO_FIX, cites_page
from .clauses import NO_EVIDENCE

ITEM = "struct<injury:string,manual:string,exam_grade:string,predicted:string,review_items:array<string>>"


def gate(sections: DataFrame) -> DataFrame:
    """(case_id, ok, missing, empty) of sections (case_id, seq, title, content, checks: array of label, required, checked).

    Missing are required checks not ticked, as "title: label"; empty are sections without content.
    """
    open_ = F.filter(F.coalesce("checks", F.array().cast("array<struct<label:string,required:boolean,checked:boolean>>")), lambda c: F.coalesce(c["required"], F.lit(False)) & ~F.coalesce(c["checked"], F.lit(False)))
    labels = F.transform(open_, lambda c: F.concat(F.col("title"), F.lit(": "), c["label"]))
    blank = F.coalesce(F.col("content"), F.lit("")) == ""
    g = sections.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("seq", labels.alias("labels"), F.when(blank, F.col("title")).alias("empty")))).alias("x"))
    missing, empty = F.flatten(F.transform("x", lambda s: s["labels"])), F.array_compact(F.transform("x", lambda s: s["empty"]))
    return g.select("case_id", ((F.size(missing) == 0) & (F.size(empty) == 0)).alias("ok"), missing.alias("missing"), empty.alias("empty"))


def assemble(cases: DataFrame, sections: DataFrame, conclusions: DataFrame, absent: str = "(미작성)", closing: str = "") -> DataFrame:
    """(case_id, text): a case's head, its sections in order, then each item's conclusion; nothing is generated.

    cases (case_id, head), sections (case_id, seq, title, content), conclusions (case_id, seq, name, body, final).
    """
    part = F.concat(F.lit("■ "), "title", F.lit("\n"), F.coalesce(F.nullif(F.col("content"), F.lit("")), F.lit(absent)), F.lit("\n"))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    item = F.concat(F.concat_ws("\n", F.concat(F.lit("○ "), "name"), some("body"), F.concat(F.lit("결론: "), some("final"))), F.lit("\n"))

    def listed(df: DataFrame, text: Column, name: str) -> DataFrame:
        g = df.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("seq", text.alias("t")))).alias("x"))
        return g.select("case_id", F.transform("x", lambda v: v["t"]).alias(name))

    rows = cases.join(listed(sections, part, "parts"), "case_id", "left").join(listed(conclusions, item, "items"), "case_id", "left")
    none = F.array().cast("array<string>")
    end = F.array(F.lit(closing)) if closing else none
    return rows.select("case_id", F.array_join(F.concat(F.array("head"), F.coalesce("parts", none), F.array(F.lit("■ 4. 종합판단")), F.coalesce("items", none), end), "\n").alias("text"))


def severity(grade: Column) -> Column:
    """The digit before 급, or before a hyphen at the start; 99 for all else."""
    return F.coalesce(F.regexp_extract(grade, r"(\d)급", 1).try_cast("int"), F.regexp_extract(grade, r"^(\d)-", 1).try_cast("int"), F.lit(99))


def sheet(agendas: DataFrame) -> DataFrame:
    """A row for each item of agendas (agenda_id, injury, exam_grade, review_items, items: array of ITEM or null).

    An agenda without items is one item made of its own columns; the first item inherits the agenda's review items. Proposed is
    the manual grade unless blank or a dash, else the exam's, else the predicted one. The total, on the first row only, is the
    gravest grade; with several items it says whether three of them or more are of grade 7. Items lie in their agenda's row.
    """
    own = F.array(F.struct(F.col("injury").alias("injury"), F.lit(None).cast("string").alias("manual"), F.col("exam_grade").alias("exam_grade"), F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("array<string>").alias("review_items")).cast(ITEM))
    items = F.when(F.coalesce(F.size("items"), F.lit(0)) > 0, F.col("items").cast(f"array<{ITEM}>")).otherwise(own)
    chosen = lambda c: F.when(~F.trim(c).isin("", "-", "—"), F.trim(c))

    def row(x: Column, i: Column) -> Column:
        review = F.when((i == 0) & x["review_items"].isNull(), F.col("review_items")).otherwise(x["review_items"])
        return F.struct(x["injury"].alias("injury"), F.coalesce(chosen(x["manual"]), chosen(x["exam_grade"]), chosen(x["predicted"])).alias("proposed"), review.alias("review_items"))

    a = agendas.select("agenda_id", F.transform(items, row).alias("x"))
    grades = F.transform("x", lambda v: severity(v["proposed"]))
    worst = F.array_min(grades)
    a = a.select("agenda_id", "x", F.size("x").alias("n_items"), F.size(F.filter(grades, lambda s: s == 7)).alias("sevens"), F.when(worst < 99, F.get(F.col("x"), (F.array_position(grades, worst) - 1).cast("int"))["proposed"]).alias("best"), F.exists("x", lambda v: F.coalesce(F.contains(v["proposed"], F.lit("미달")), F.lit(False))).alias("below"))
    total = F.coalesce("best", F.when(F.col("below"), "등급기준미달"))
    mark = F.when(F.col("n_items") < 2, "").when(F.col("sevens") >= 3, F.concat(F.lit("\n(종합판정 대상 — 7급 "), F.col("sevens").cast("string"), F.lit("개)"))).otherwise("\n(종합판정 비대상)")
    rows = a.select("agenda_id", "n_items", F.concat(total, mark).alias("total"), F.posexplode("x").alias("item", "v"))
    points = F.transform(F.coalesce(F.col("v")["review_items"], F.array().cast("array<string>")), lambda p: F.concat(F.lit("○ "), p))
    tagged = F.concat(F.when(F.col("n_items") > 1, F.array(F.concat(F.lit("["), F.coalesce(F.col("v")["injury"], F.lit("")), F.lit("]")))).otherwise(F.array().cast("array<string>")), points)
    return rows.select("agenda_id", "item", F.col("v")["injury"].alias("injury"), F.coalesce(F.col("v")["proposed"], F.lit("—")).alias("proposed"), F.when(F.size(points) > 0, F.array_join(tagged, "\n")).otherwise("—").alias("review"), F.when(F.col("item") == 0, F.coalesce("total", F.lit("—"))).alias("total"))


# Generators ---------------------------------------------------------------------------------------


class Transient(Exception):
    """A failure of a generator that may pass: a time-out, a busy server."""


def render(template: str, **values: str) -> str:
    """A template with its values; a placeholder without a value is an error."""
    try:
        return template.format(**values)
    except (KeyError, IndexError) as e:
        raise ValueError(f"the template needs {e}") from e


def retrying(call: Callable[[str], str], retries: int = 2, wait: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """call, repeated after 1, 2, ... seconds on transient failures; others pass at once."""

    def run(prompt: str) -> str:
        for attempt in range(retries + 1):
            try:
                return call(prompt)
            except Transient as e:
                if attempt == retries:
                    raise RuntimeError(f"failed {retries + 1} times: {e}") from e
                wait(2.0**attempt)
        raise AssertionError

    return run


def points_of(reply: str | None, nothing: tuple[str, ...] = NOTHING_TO_FIX, most: int = 5) -> list[str]:
    """As functions.replies.issues, for one reply on a worker."""
    text = (reply or "").strip()
    if text.translate({32: None, 46: None}).startswith(nothing):
        return []
    points = [line.strip().lstrip("-•*").strip() for line in text.splitlines()]
    return [p for p in points if p and p.replace(" ", "") not in nothing][:most]


def refine(draft: str, critique: Callable[[str], str], revise: Callable[[str, list[str]], str], passes: int = 1) -> tuple[str, int, list[str], bool]:
    """(text, critiques, issues, revised): a draft judged and rewritten until nothing is found or the passes end.

    A failure or an empty rewrite leaves the text as it is: the check must not block a document.
    """
    text, found, n, revised = draft, [], 0, False
    for _ in range(passes):
        try:
            issues = points_of(critique(text))
            n += 1
            found += issues
            new = revise(text, issues).strip() if issues else ""
        except Exception:  # noqa: BLE001
            break
        if not new:
            break
        text, revised = new, True
    return text, n, found, revised


def refined(drafts: DataFrame, critique: Callable[[str], str], revise: Callable[[str, list[str]], str], passes: int = 1) -> DataFrame:
    """refine of every draft (id, draft): id, text, critiques, issues, revised. Calls run on the workers, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [refine(d or "", critique, revise, passes) for d in batch["draft"]]
            out = pd.DataFrame(rows, columns=["text", "critiques", "issues", "revised"])
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    kind = drafts.schema["id"].dataType.simpleString()
    return drafts.select("id", "draft").mapInPandas(run, f"id {kind}, text string, critiques int, issues array<string>, revised boolean")


def answer_quality(answers: DataFrame, by: str = "mode") -> DataFrame:
    """Shares of answers (by, expected, sources, answer, retries, score): those with a source whose name holds the expected one, that say
    there is no evidence, with citation, retried; mean score."""
    said = F.coalesce("answer", F.lit(""))
    hit = F.coalesce(F.exists("sources", lambda s: F.contains(s, F.col("expected"))), F.lit(False))
    share = lambda c, name: F.round(F.avg(c.cast("int")), 6).alias(name)
    return answers.groupBy(by).agg(F.count("*").alias("n"), share(hit, "hit"), share(F.contains(said, F.lit(NO_EVIDENCE)), "no_evidence"), share(cites_page(said), "cited"), share(F.col("retries") > 0, "retried"), F.round(F.avg("score"), 6).alias("score"))
