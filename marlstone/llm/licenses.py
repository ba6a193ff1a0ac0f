"""License scans by diagonal voting. DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

#: Words of a lower-cased text: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, put as what it holds, which Java matches much faster.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
K = 3

# The phrases of the base places, then well-known notices, each with its label.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def _templates(spark: SparkSession) -> DataFrame:
    """A row for each k-gram of each template; a fixed table of about 200 rows."""
    rows = []
    for number, (label, text) in enumerate(PHRASES + NOTICES):
        w = text.split()
        assert len(w) >= K and re.fullmatch(r"[a-z0-9 -]+", text)
        for i in range(len(w) - K + 1):
            grams = ", ".join(f"'{x}'" for x in w[i : i + K])
            rows.append(f"({number}, '{label}', {str(number < len(PHRASES)).lower()}, {len(w)}, {i}, {grams})")
    found = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(template, label, base, length, place, g0, g1, g2)")
    return found.withColumn("gram", F.xxhash64("g0", "g1", "g2"))


def license_scan(docs: DataFrame, share: float = 0.8, drift: int = 3) -> DataFrame:
    """License mentions of every document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    All rolling 3-gram hashes of all words join the templates' 3-grams
    (a fixed, small table). Each hit votes for the diagonal word - place of
    its template; its words are compared, so a hash alone decides nothing.
    A diagonal on which every 3-gram of a phrase voted is a base place.
    Diagonals at most `drift` apart (words put in or left out) merge; what
    they cover of the template, as a share of its words, must reach `share`
    over a span of at most one and a half times its length to give the
    label. The score is the best share found.

    A null text is empty; no words give zeros, nulls for places and empty
    labels. Rows that repeat an id are scanned by their own text. Only doc_id
    and text are read. An empty table gives no rows.
    """
    # lower() also folds other letters; none of them becomes a letter of the phrases.
    lowered = F.lower(F.coalesce("text", F.lit("")))
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.regexp_extract_all(lowered, F.lit(WORD), 0).alias("w"))
    n = F.size("w")
    grams = base.select("doc_id", "th", "w", F.explode_outer(F.when(n >= K, F.sequence(F.lit(0), n - K))).alias("i"))
    words = [F.get("w", F.col("i") + k) for k in range(K)]
    grams = grams.withColumn("gram", F.xxhash64(*words))
    known = F.broadcast(_templates(docs.sparkSession))
    same = [F.get("w", F.col("i") + k) == F.col(f"g{k}") for k in range(K)]
    hits = grams.join(known, "gram").where(same[0] & same[1] & same[2])
    key = ["doc_id", "th"]
    of = ["template", "label", "base", "length"]
    diagonals = hits.groupBy(*key, *of, (F.col("i") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    exact = F.col("base") & (F.size("places") == F.col("length") - (K - 1))
    before = F.lag("diagonal").over(Window.partitionBy(*key, "template").orderBy("diagonal"))
    apart = F.coalesce((F.col("diagonal") - before > drift).cast("int"), F.lit(0))
    begun = F.sum("apart").over(Window.partitionBy(*key, "template").orderBy("diagonal").rowsBetween(Window.unboundedPreceding, 0))
    marked = diagonals.withColumn("exact", exact).withColumn("apart", apart).withColumn("cluster", begun)
    merged = marked.groupBy(*key, *of, "cluster").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.min(F.col("diagonal") + F.array_min("places")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("places") + K).alias("end"),
        F.sum(F.col("exact").cast("long")).alias("n_exact"),
        F.min(F.when(F.col("exact"), F.col("diagonal"))).alias("first"),
        F.max(F.when(F.col("exact"), F.col("diagonal"))).alias("last"),
    )
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.array(*[p + k for k in range(K)]))))
    merged = merged.withColumn("share", F.size(covered) / F.col("length"))
    fits = (F.col("share") >= share) & (F.col("end") - F.col("start") <= 1.5 * F.col("length"))
    labelled = F.when((F.col("n_exact") > 0) | fits, F.col("label"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = merged.groupBy(*key).agg(
        F.sum("n_exact").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        joined(F.when(F.col("n_exact") > 0, F.col("label"))).alias("base_labels"),
        joined(labelled).alias("labels"),
        F.max(F.when(F.col("n_exact") > 0, 1.0).otherwise(F.least("share", F.lit(1.0)))).alias("score"),
    )
    counted = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.regexp_count(F.lower("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    both = counted.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.th") == F.col("f.th")), "left")
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return both.select("d.doc_id", "n_words", none("n_base", 0), "first_word", "last_word", none("base_labels", ""), none("labels", ""), none("score", 0.0))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def _values() -> str:
    rows = []
    for number, (label, text) in enumerate(PHRASES + NOTICES):
        w = text.split()
        rows += [f"({number}, '{label}', {str(number < len(PHRASES)).lower()}, {len(w)}, {i}, '{w[i]}', '{w[i + 1]}', '{w[i + 2]}')" for i in range(len(w) - K + 1)]
    return ", ".join(rows)


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
token AS (SELECT doc_id, unnest(w) AS w0, unnest(range(len(w))) AS i FROM d),
gram AS (SELECT *, lead(w0, 1) OVER o AS w1, lead(w0, 2) OVER o AS w2 FROM token WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
known(template, label, base, size, place, g0, g1, g2) AS (VALUES {_values()}),
hit AS (SELECT doc_id, template, label, base, size, i - place AS diagonal, place FROM gram JOIN known ON w0 = g0 AND w1 = g1 AND w2 = g2),
diagonals AS (SELECT doc_id, template, label, size, diagonal, any_value(base) AND count(DISTINCT place) = any_value(size) - {K - 1} AS exact FROM hit GROUP BY doc_id, template, label, size, diagonal),
apart AS (SELECT *, coalesce((diagonal - lag(diagonal) OVER o > 3)::INT, 0) AS apart FROM diagonals WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
clusters AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS cluster FROM apart),
words AS (SELECT doc_id, template, cluster, h.diagonal, h.place, unnest(range({K})) AS k FROM hit h JOIN clusters c USING (doc_id, template, diagonal)),
spans AS (SELECT doc_id, template, cluster, count(DISTINCT place + k) AS covered, min(diagonal + place) AS first, max(diagonal + place) + {K} AS last FROM words GROUP BY ALL),
merged AS (SELECT doc_id, template, label, size, cluster, sum(exact::INT) AS n_exact, min(CASE WHEN exact THEN diagonal END) AS lo, max(CASE WHEN exact THEN diagonal END) AS hi FROM clusters GROUP BY ALL),
judged AS (SELECT *, covered::DOUBLE / size AS share, n_exact > 0 OR (covered::DOUBLE / size >= 0.8 AND last - first <= 1.5 * size) AS labelled FROM merged JOIN spans USING (doc_id, template, cluster)),
found AS (
  SELECT doc_id, sum(n_exact)::BIGINT AS n_base, min(lo)::BIGINT AS first_word, max(hi)::BIGINT AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE n_exact > 0)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE labelled)), ',') AS labels,
         max(CASE WHEN n_exact > 0 THEN 1.0::DOUBLE ELSE least(share, 1.0::DOUBLE) END) AS score
  FROM judged GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0::DOUBLE) AS score
FROM d LEFT JOIN found USING (doc_id)
"""
