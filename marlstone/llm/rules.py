"""Quality rules with cross-document line frequency. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, cut, documents

WINDOW = 8
SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]


def _repeat_words(rows: DataFrame, *kept: str) -> DataFrame:
    """n_repeat_words: words in windows found twice or more. Only texts with such windows sort
    (hash, place); places like a neighbour stay; what they cover is added up.

    Each step is a column of its own: a lambda that names a longer expression would evaluate it for each element.
    """
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    pairs = F.when(F.size("hashes") > F.col("distinct"), F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)
    rows = rows.select(*kept, pairs.alias("pairs"))
    like = lambda x, k: F.coalesce(F.get("pairs", k)["h"] == x["h"], F.lit(False))
    found = F.transform(F.filter("pairs", lambda x, j: like(x, j - 1) | like(x, j + 1)), lambda x: x["i"])
    rows = rows.select(*kept, F.array_sort(found).alias("places"))
    covered = F.transform("places", lambda p, j: F.least(F.coalesce(F.get("places", j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return rows.select(*kept, F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))


def text_rules(docs: DataFrame, *more: str) -> DataFrame:
    """Base figures of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; its normalised lines as an
    array of line (a hash) and words; then the columns in more."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", *more, text.alias("text"), F.regexp_extract_all(text, F.lit(NOT_SPACE), 0).alias("w"))
    n = F.size("w")
    bare = F.col("text")
    for c in SPACES:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    every = F.split("text", "\n", -1)
    normal = F.transform(every, lambda x: F.lower(F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")))
    base = base.select(
        "doc_id", *more, n.cast("long").alias("n_words"), F.length(bare).cast("long").alias("word_chars"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(every, lambda x: x.rlike(NOT_SPACE)).alias("filled"), F.filter(normal, lambda x: x != "").alias("normal"), F.transform("w", lambda x: F.xxhash64(x)).alias("hw"),
    )
    # A window's hash is that of its words' hashes, so each word is read once.
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*(F.get("hw", i + k) for k in range(WINDOW))))
    held = F.transform("normal", lambda x: F.struct(F.xxhash64(x).alias("line"), F.regexp_count(x, F.lit(NOT_SPACE)).alias("words")))
    n_dup = (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long").alias("n_dup_lines")
    base = base.select("doc_id", *more, "n_words", "word_chars", "n_symbols", n_dup, held.alias("lines"), F.when(F.col("n_words") >= WINDOW, windows).otherwise(F.array().cast("array<long>")).alias("hashes"))
    base = base.select("*", F.size(F.array_distinct("hashes")).alias("distinct"))
    base = _repeat_words(base, "doc_id", *more, "n_words", "word_chars", "n_symbols", "n_dup_lines", "lines")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return base.withColumn("base_failed", failed)


def _boilerplate(rows: DataFrame, least: int) -> DataFrame:
    """Lines (host, line, n_docs) in `least` or more different documents of a host; rows have host, doc_id, unnamed, line."""
    return rows.select("host", "doc_id", "unnamed", "line").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least)


def _lines(rows: DataFrame) -> DataFrame:
    """A row for each line of a row of text_rules(): its number, the document, host, line, words."""
    return rows.select("row", "doc_id", F.when(F.col("doc_id").isNull(), F.col("th")).alias("unnamed"), F.col("source").alias("host"), F.inline("lines"))


def boilerplate(docs: DataFrame, least: int = 10) -> DataFrame:
    """Lines (host, line) in `least` or more different documents of a host, however many documents the host has.

    Rows that repeat an id are one document; rows without an id are told apart by their text.
    """
    return _boilerplate(_lines(_rows(docs).withColumn("row", F.lit(0))), least)


def _rows(docs: DataFrame) -> DataFrame:
    """Figures and lines of each row, with a hash of its text; of docs only doc_id, text and source are read."""
    return text_rules(docs.select("doc_id", "text", "source", F.xxhash64("text").alias("th")), "th", "source")


def quality_rules(docs: DataFrame, least: int = 10, remains: float = 0.5) -> DataFrame:
    """Base figures, the words left without boilerplate lines (n_left), and kept, for every document.

    The host is the source. A line found in `least` or more different
    documents of its host is removed; a document that passed the base rules
    is rejected if less than `remains` of its words is left. The texts are read once, for figures and hashes of lines.

    A null text has no words and fails; a null host is one of its own; rows
    that repeat an id are judged by their own text. Only doc_id, text and
    source are read. An empty table gives no rows.
    """
    rows = cut(_rows(docs)).withColumn("row", F.monotonically_increasing_id())  # of a written table: the same at each reading
    lines = _lines(rows)
    # Written down, so that the join below can part a host's very common line among tasks.
    limits = cut(_boilerplate(lines, least)).select(F.col("line").alias("_line"), F.col("host").alias("_host"))
    found = lines.join(limits, (lines["line"] == limits["_line"]) & lines["host"].eqNullSafe(limits["_host"]))
    gone = found.groupBy(F.col("row").alias("_row")).agg(F.sum("words").alias("gone"))
    rows = rows.join(gone, rows["row"] == gone["_row"], "left").withColumn("n_left", F.col("n_words") - F.coalesce("gone", F.lit(0)))
    kept = ~F.col("base_failed") & (F.col("n_left") >= F.col("n_words") * remains)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_left")


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


_LEADS = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER o" for k in range(1, WINDOW))])
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
token AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
gram AS (SELECT doc_id, i, {_LEADS} AS g FROM token WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, (g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1)::INT AS twice FROM gram),
covered AS (SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS c FROM twice),
repeated AS (SELECT doc_id, sum(c)::BIGINT AS n FROM covered GROUP BY 1),
line AS (SELECT doc_id, source, lower(regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')) AS line FROM (SELECT doc_id, source, unnest(ls) AS x FROM d)),
often AS (SELECT source, line FROM line WHERE line <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
gone AS (SELECT doc_id, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')))::BIGINT AS n FROM line l WHERE EXISTS (SELECT 1 FROM often o WHERE o.line = l.line AND o.source IS NOT DISTINCT FROM l.source) GROUP BY 1),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, len(w) - coalesce(g.n, 0) AS n_left
  FROM d LEFT JOIN repeated r USING (doc_id) LEFT JOIN gone g USING (doc_id)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND n_left >= n_words * 0.5 AS kept FROM failed
"""
