"""Text expressions: chunks, tokens, masks, dates. All return Columns and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chunk length and overlap.
CHUNK, OVERLAP = 1200, 150
# Ordered masks (resident number, mobile number, landline, e-mail), and what stands in their place.
MASKS = [
    (r"\b[0-9]{6}[- ][0-9]{7}\b", "******-*******"),
    (r"\b01[0-9][- ]?[0-9]{3,4}[- ]?[0-9]{4}\b", "01*-****-****"),
    (r"\b0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}\b", "0**-****-****"),
    (r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+", "****@****"),
]
#: Found by nothing; stands for a query without terms.
NO_TERM = "___none___"


def chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Overlapping pieces of a text; an empty text has none."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.length(text) > 0, F.transform(starts, lambda p: F.substring(text, p + 1, size))).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and hyphens with at least one letter or digit."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<!-)-*+[\p{L}\p{N}][\p{L}\p{N}\-]*+"), 0)


def or_terms(query: Column) -> Column:
    """The different terms of a question, lower-cased as those of texts are, any of which a hit may have; one that nothing has if there are none."""
    found = F.array_distinct(tokens(F.coalesce(query, F.lit(""))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_TERM)))


def mask(text: Column) -> Column:
    """Personal data masked, one kind after the other. Letters of any script are letters at a word's border."""
    for pattern, by in MASKS:
        text = F.regexp_replace(text, f"(?U){pattern}", by)
    return text


def label(path: Column) -> Column:
    """What a source is called: the text behind the first #, else the file's name."""
    base = F.substring_index(F.translate(path, "\\", "/"), "/", -1)
    return F.when(F.contains(path, F.lit("#")), F.regexp_replace(path, "(?s)^[^#]*#", "")).otherwise(base)


# How a day and a month are written.
FULL_DATE = r"([0-9]{4})[.\-/년\s]{1,2}([0-9]{1,2})[.\-/월\s]{1,2}([0-9]{1,2})"
MONTH = r"([0-9]{4})[.\-/]([0-9]{1,2})"


def tolerant_date(text: Column) -> Column:
    """The first day anywhere in a text, else the first month as its 15th; an impossible day is null and isn't read as a month."""
    part = lambda p, i: F.lpad(F.regexp_extract(text, p, i), 2, "0")
    read = lambda y, *more: F.when(F.regexp_extract(text, y, 1) != "0000", F.try_to_date(F.concat_ws("-", F.regexp_extract(text, y, 1), *more), "yyyy-MM-dd"))
    return F.when(text.rlike(FULL_DATE), read(FULL_DATE, part(FULL_DATE, 2), part(FULL_DATE, 3))).when(text.rlike(MONTH), read(MONTH, part(MONTH, 2), F.lit("15")))


# What markdown's marks look like (headings, rules, bold, italics, bullets, blank lines, ends), and what stays of them.
MARKDOWN = [
    (r"(?m)^#{1,6}\s*", ""), (r"(?m)^\s*[-*]{3,}\s*$", ""), (r"\*\*(.+?)\*\*", "$1"),
    (r"(?U)(?<!\w)\*(.+?)\*(?!\w)", "$1"), (r"(?m)^\s*[-*]\s+", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
]


def strip_markdown(text: Column) -> Column:
    """Headings, rules, bold, italics and bullets lose their marks; of several blank lines one stays."""
    for pattern, by in MARKDOWN:
        text = F.regexp_replace(text, pattern, by)
    return text


def first_most(values: Column) -> Column:
    """The most frequent value of an array, of equals the one that comes first; null if there is none."""
    kinds = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), v.alias("v")))
    start = F.struct(F.lit(0).alias("n"), F.get(values, F.lit(0)).alias("v"))
    return F.aggregate(kinds, start, lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))["v"]


def merged(*lists: Column) -> Column:
    """Lists one after the other, each value once where it comes first; a null list is empty."""
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))


def number_order(text: Column) -> Column:
    """To sort a text by the number that it is; others come last."""
    return F.coalesce(F.trim(text).try_cast("decimal(38,9)"), F.lit("9" * 29).cast("decimal(38,9)"))


def strip_markup(html: Column) -> Column:
    """Scripts, styles and tags go, a few entities are read, white space is squeezed."""
    for pattern, by in [(r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), (r"(?i)<br\s*/?>", "\n"), (r"(?s)<[^>]+>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), (r"[ \t\r\n]+", " ")]:
        html = F.regexp_replace(html, pattern, by)
    return F.trim(html)


def harmonic_rank(n: Column, terms: int) -> Column:
    """Weight of a term found n times: 0.1 * sum of 1 / j^2 up to n, over pi^2 / 6 and the number of terms."""
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, j: a + 1.0 / (j.cast("double") * j))
    return 0.1 * total / 1.64493406685 / terms


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
