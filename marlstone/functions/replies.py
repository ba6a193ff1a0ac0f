"""Texts that people and models write: replies, findings, names, grades, wrapping, comparison."""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Replies that report nothing to correct.
NOTHING_TO_FIX = ("문제없음", "이상없음", "지적사항없음")
# Titles and signatures around a drafted decision.
TITLES = ("심의의결서", "심 의 의 결", "종합 판단", "판단 내용", "국가보훈부")
SENTENCE_ENDS = ("다.", "함.", "음.", "됨.")
SIGNATURES = ("[보훈심사관", "[날짜", "권고 사항", "권고사항", "서명:")
# Wording of findings, the name and part that each stands for, first match first.
FINDINGS = (
    (r"ACL\s*reconstruction|anterior\s*cruciate", "무릎 전방십자인대 파열(재건술 후)", "다리"),
    (r"PCL|posterior\s*cruciate", "무릎 후방십자인대 파열", "다리"),
    (r"meniscus|meniscal", "무릎 반월상연골 파열", "다리"),
    (r"rotator\s*cuff", "어깨 회전근개 파열", "팔"),
    (r"achilles", "아킬레스건 파열", "다리"),
    (r"disc|HNP|herniation", "추간판탈출증", "척추"),
    (r"compression\s*fracture", "척추 압박골절", "척추"),
    (r"fracture", "골절", None),
)
# What parts disease names, how they are written, labels and noise among them, words for none; the two forms of a grade.
BETWEEN, DISEASE, TWO_SYLLABLES = "[,·/]", "^[가-힣A-Za-z][가-힣A-Za-z0-9 ]*$", "[가-힣]{2,}"
NOT_DISEASE, NO_DISEASE = "검진|검사|판독|소견|기록|서류|구분|성명|번호", ("null", "none", "없음", "-")
#: Titles and labels of forms that stand where a disease is asked for.
FORM_TITLES = ("임상적추정", "병상일지", "신청사유", "의무기록", "소견서", "진단서", "수술기록", "외래기록", "입퇴원요약", "영상검사결과", "기능검사결과")
GRADES = r"^\d급|^\d-\d-\d{4}$"
SIDES = ((r"\bleft\b|\bLt\b", "좌"), (r"\bright\b|\bRt\b", "우"), (r"\bboth\b|양측", "양측"))


def issues(reply: Column, nothing: tuple[str, ...] = NOTHING_TO_FIX, most: int = 5) -> Column:
    """The points of a critique, without bullets; none if it reports nothing to fix. Null counts as empty."""
    text = F.trim(F.coalesce(reply, F.lit("")))
    bare = F.translate(text, " .", "")
    fine = F.lit(False)
    for word in nothing:
        fine = fine | bare.startswith(word)
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(F.trim(x), r"^[-•*]+\s*", ""))
    points = F.filter(lines, lambda x: (x != "") & ~F.translate(x, " ", "").isin(*nothing))
    return F.when(fine, F.array().cast("array<string>")).otherwise(F.slice(points, 1, most))


def without_frame(text: Column, titles: tuple[str, ...] = TITLES, ends: tuple[str, ...] = SENTENCE_ENDS, signatures: tuple[str, ...] = SIGNATURES) -> Column:
    """A draft without leading blank or title lines (short, no sentence) and from the signature on."""
    lines = F.split(text, r"\r?\n")

    def any_of(tests: list[Column]) -> Column:
        found = tests[0]
        for test in tests[1:]:
            found = found | test
        return found

    def leads(x: Column) -> Column:
        t = F.trim(x)
        return (t == "") | ((F.length(t) < 34) & any_of([F.contains(t, F.lit(k)) for k in titles]) & ~any_of([t.endswith(e) for e in ends]))

    def signs(x: Column) -> Column:
        t = F.trim(x)
        return any_of([t == "서명", *[t.startswith(s) for s in signatures]])

    first = F.array_position(F.transform(lines, leads), False)
    body = F.when(first > 0, F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    cut = F.array_position(F.transform(body, signs), True)
    body = F.when(cut > 0, F.slice(body, 1, F.greatest(cut - 1, F.lit(0)).cast("int"))).otherwise(body)
    return F.btrim(F.array_join(body, "\n"), F.lit(" \t\r\n"))


def fenced_sql(reply: Column) -> Column:
    """The statement of a reply: what stands in a code fence, else all of it; no semicolon at the end."""
    inner = F.regexp_extract(reply, r"(?s)```(?:sql)?\s*(.*?)```", 1)
    return F.regexp_replace(F.trim(F.coalesce(F.nullif(inner, F.lit("")), reply)), r"[;\s]+$", "")


def outer_json(reply: Column) -> Column:
    """From the first { to the last } of a chatty reply; null without them."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def cites_page(text: Column) -> Column:
    """Whether a text cites [name p.N]."""
    return F.rlike(text, F.lit(r"\[[^\[\]]+ p\.\s?\d+\]"))


def file_name(text: Column) -> Column:
    """A name without the characters that file systems refuse."""
    return F.translate(text, '\\/:*?"<>|', "_________")


def finding(text: Column, findings: tuple = FINDINGS, sides: tuple = SIDES) -> Column:
    """struct(name, part, side): the first wording that matches in any case; unknown findings keep their text."""
    has = lambda p: F.rlike(text, F.lit(f"(?i){p}"))
    name = F.coalesce(*[F.when(has(p), n) for p, n, _ in findings], F.regexp_replace(F.trim(text), r"\.+$", ""))
    known = F.lit(None).cast("string")
    for p, _, part in reversed(findings):  # an earlier wording wins, its part being null or not
        known = F.when(has(p), F.lit(part)).otherwise(known)
    side = F.coalesce(*[F.when(has(p), s) for p, s in sides], F.lit(""))
    return F.struct(name.alias("name"), known.alias("part"), side.alias("side"))


def grade(text: Column) -> Column:
    """A grade without white space, if it has one of the two known forms, else null."""
    bare = F.regexp_replace(text, r"\s", "")
    return F.when(F.rlike(bare, F.lit(GRADES)), bare)


def diseases(text: Column, unwanted: tuple[str, ...] = FORM_TITLES, unwanted_pattern: str = NOT_DISEASE) -> Column:
    """The disease names of a field: up to an asterisk, split, without what stands in brackets; titles of forms, labels and noise go."""
    parts = F.split(F.get(F.split(F.coalesce(text, F.lit("")), r"\*"), 0), BETWEEN)
    names = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\([^)]*\)", "")))
    good = lambda v: (F.length(v) >= 2) & F.rlike(v, F.lit(DISEASE)) & F.rlike(v, F.lit(TWO_SYLLABLES)) & ~F.rlike(v, F.lit(unwanted_pattern))
    names = F.filter(names, good)
    if unwanted:
        names = F.filter(names, lambda v: ~v.isin(*unwanted))
    return F.when(F.lower(F.trim(text)).isin(*NO_DISEASE), F.array().cast("array<string>")).otherwise(names)


def wrapped(text: Column, width: int = 78, pad: str = "", hang: str = "  ") -> Column:
    """Lines of at most `width` characters before their indent, broken at spaces; all but the first hang.

    A word longer than a line stands alone. Null or empty gives a dash.
    """
    words = F.split(F.coalesce(F.nullif(text, F.lit("")), F.lit("—")), " ")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(held: Column, word: Column) -> Column:
        full = F.length(held["open"]) + F.length(word) + 1 > width
        more = F.concat(F.when(full, "").otherwise(held["open"]), word, F.lit(" "))
        return F.struct(F.when(full, F.array_append(held["done"], F.rtrim(held["open"]))).otherwise(held["done"]).alias("done"), more.alias("open"))

    lines = F.aggregate(words, empty, add, lambda held: F.when(F.trim(held["open"]) == "", held["done"]).otherwise(F.array_append(held["done"], F.rtrim(held["open"]))))
    return F.transform(lines, lambda x, i: F.concat(F.when(i == 0, pad).otherwise(hang), x))


def _escaped(word: str) -> str:
    return html.escape(word).replace("&#x27;", "&#39;")


def word_diff(old: str | None, new: str | None) -> tuple[str, str]:
    """Both texts with words that only one has marked <del> and <ins>, by a longest common subsequence.

    Of several such subsequences the one is taken that pairs words as soon as they meet and else gives up old words
    first: an old word is given up as long as the rest can still share as much without it.

    For each old word one bit a place in the new text is kept: whether the rest shares as much without the old word.
    """
    a, b = ([x for x in re.split(r"(\s+)", t or "") if x] for t in (old, new))
    number = {w: k for k, w in enumerate(dict.fromkeys(a + b))}
    numbers = np.array([number[w] for w in b], np.int64)
    rest, spare = np.zeros(len(b) + 1, np.int32), []
    for word in reversed(a):
        with_it = np.zeros_like(rest)
        with_it[:-1] = np.where(numbers == number[word], rest[1:] + 1, rest[:-1])
        with_it = np.maximum.accumulate(with_it[::-1])[::-1]
        spare.append(np.packbits(rest[:-1] >= with_it[1:]))
        rest = with_it
    gone = lambda words: "".join(f"<del>{_escaped(w)}</del>" for w in words)
    come = lambda words: "".join(f"<ins>{_escaped(w)}</ins>" for w in words)
    before, after, at = [], [], 0
    for word in a:
        bits = spare.pop()
        meets = at
        while meets < len(b) and b[meets] != word and not bits[meets >> 3] >> (7 - (meets & 7)) & 1:
            meets += 1
        after.append(come(b[at:meets]))
        at = meets
        if at < len(b) and b[at] == word:
            before.append(_escaped(word))
            after.append(_escaped(word))
            at += 1
        else:
            before.append(gone([word]))
    after.append(come(b[at:]))
    return "".join(before), "".join(after)


@F.pandas_udf(T.StructType().add("before", "string").add("after", "string"))
def compared(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """word_diff of each row; a table over two sequences has no counterpart among the built-in functions."""
    return pd.DataFrame([word_diff(x, y) for x, y in zip(old, new, strict=True)], columns=["before", "after"])
