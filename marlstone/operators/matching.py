"""Names and patterns found in texts without comparing every text with every one of them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The letters of a gram that a name or a pattern's literal is filed under; shorter ones are filed whole.
GRAM = 4
#: Names with so many letters in all are sent to the tasks; more meet the texts in a shuffle. Texts that are looked at at once.
LETTERS, TEXTS = 1_000_000, 256


def _grams(text: str, size: int) -> Column:
    """All pieces of so many letters, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1)


def contains_join(texts: DataFrame, names: DataFrame, gram: int = GRAM, letters: int = LETTERS) -> DataFrame:
    """(id, name) of texts (id, text) that contain a name (name), each pair once.

    A name is filed under that one of its grams that texts have least. Texts meet names by equality on such grams, and only pairs
    that do are compared; a name with a gram that no text has meets none. Names of up to `letters` in all are sent to
    the texts, which then aren't shuffled; of more, a text's grams are kept where some name has them, before anything is shuffled by text.
    Null texts and null or empty names meet nothing; ids should differ. Names are looked up, and
    their grams in texts counted, when this is called.
    """
    known = names.select("name").where(F.length("name") > 0).distinct()
    if (known.agg(F.sum(F.length("name"))).first()[0] or 0) <= letters:
        return _met_in_place(texts.where("text IS NOT NULL"), [r[0] for r in known.collect()], gram)
    return _met_by_gram(texts, known, gram)


def _slots(text: str, size: int, bits: int) -> np.ndarray:
    """A number of so many bits for the piece of `size` letters that starts at each place; different pieces may share one."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(letters) - size + 1)
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h += letters[j : j + n] * _ODD[j % 4]
        h ^= h >> np.uint64(29)
    return ((h * _ODD[0]) >> np.uint64(64 - bits)).astype(np.int64)


_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA5A3564E27F8862B, 0xC2B2AE3D27D4EB4F], np.uint64)


def _met_in_place(texts: DataFrame, names: list[str], gram: int) -> DataFrame:
    """Pieces are known by their slots. Those that share one, and those across two texts, only make more pairs to be compared."""
    spark, size = texts.sparkSession, lambda name: min(len(name), gram)
    sizes = sorted({size(n) for n in names})
    bits = min(22, max(16, (16 * sum(map(len, names))).bit_length()))
    of = {n: np.unique(_slots(n, size(n), bits)) for n in names}
    wanted = np.zeros(1 << bits, bool)
    wanted[np.concatenate([*of.values(), np.zeros(0, np.int64)])] = True
    sent = spark.sparkContext.broadcast(wanted)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (batch.slice(k, TEXTS) for batch in batches for k in range(0, batch.num_rows, TEXTS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(1 << bits, np.int64)
        for part in slices(batches):
            whole = "".join(part.column(0).to_pylist())
            for s in sizes:
                found = _slots(whole, s, bits)
                often += np.bincount(found[sent.value[found]], minlength=1 << bits)
        at = np.flatnonzero(often)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(often[at])], ["slot", "times"])

    often = dict(texts.select("text").mapInArrow(count, "slot long, times long").groupBy("slot").agg(F.sum("times")).collect())
    filed = defaultdict(list)
    for n in names:
        slot = min(of[n].tolist(), key=lambda x: (often.get(x, 0), x))
        filed[slot].append((n, int(np.flatnonzero(_slots(n, size(n), bits) == slot)[0])))
    held = np.zeros(1 << bits, bool)
    held[list(filed)] = True
    sent_filed = spark.sparkContext.broadcast((dict(filed), held))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, held = sent_filed.value
        for part in slices(batches):
            lines = part.column(1).to_pylist()
            ends, whole, met = np.cumsum([len(x) for x in lines]), "".join(lines), set()
            for s in sizes:
                found = _slots(whole, s, bits)
                at = np.flatnonzero(held[found])
                row = np.searchsorted(ends, at, "right")
                # A name is compared where its piece is found, in the text that the piece begins in.
                for p, i, slot, end in zip(at.tolist(), row.tolist(), found[at].tolist(), ends[row].tolist(), strict=True):
                    for n, before in named[slot]:
                        if p - before >= end - len(lines[i]) and whole.startswith(n, p - before, end):
                            met.add((i, n))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([i for i, _ in met], pa.int64())), pa.array([n for _, n in met], pa.string())], ["id", "name"])

    return texts.select("id", "text").mapInArrow(meet, f"id {texts.schema['id'].dataType.simpleString()}, name string")


def _met_by_gram(texts: DataFrame, known: DataFrame, gram: int) -> DataFrame:
    sizes = sorted(r[0] for r in known.select(F.least(F.length("name"), F.lit(gram))).distinct().collect()) or [gram]
    of = lambda c: F.coalesce(*(F.when(F.least(F.length(c), F.lit(gram)) == s, _grams(c, s)) for s in sizes))
    parts = known.select("name", F.explode(F.array_distinct(of("name"))).alias("gram"))
    each = texts.where("text IS NOT NULL").select("id", F.explode(F.array_distinct(F.concat(*(_grams("text", s) for s in sizes)))).alias("gram"))
    held = each.join(parts.select("gram").distinct(), "gram", "left_semi")
    often = held.groupBy("gram").agg(F.count("*").alias("texts"))
    filed = parts.join(often, "gram", "left").groupBy("name").agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("gram"))
    pairs = held.join(filed, "gram").groupBy("id").agg(F.collect_list("name").alias("names"))
    met = pairs.join(texts, "id").select("id", F.filter("names", lambda n: F.contains(F.col("text"), n)).alias("names"))
    return met.select("id", F.explode("names").alias("name"))


def literals(pattern: str) -> list[str] | None:
    """Texts of which every match of a (Java) pattern holds at least one; None if none are sure.

    Of each of the alternatives the longest run of plain letters outside groups and classes counts, without one that
    may be left out. Flags, comments and quotes make a pattern unsure.
    """
    runs, run, found, i = [], "", [], 0

    def ended() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while i <= len(pattern):
        c = pattern[i] if i < len(pattern) else "|"
        if c == "|":
            ended()
            best = max(runs, key=len)
            if not best:
                return None
            found.append(best)
            runs.clear()
        elif c in "([":
            if pattern.startswith("(?", i) and not pattern.startswith(("(?:", "(?=", "(?!", "(?<"), i):
                return None
            ended()
            end = _closing(pattern, i)
            if end is None:
                return None
            i = end
        elif c == "\\":
            i += 1
            if i >= len(pattern) or pattern[i] in "QE":
                return None
            if pattern[i].isalnum():
                ended()
                if pattern[i] in "pPxu0Nkc":  # what follows belongs to it
                    return None
            else:
                run += pattern[i]
        elif c in "?*{":
            run = run[:-1]
            ended()
            if c == "{":
                i = pattern.find("}", i)
                if i < 0:
                    return None
        elif c in "+.^$":
            ended()
        elif c in ")]}" or 0xD800 <= ord(c) <= 0xDFFF:
            return None
        else:
            run += c
        i += 1
    return sorted(set(found))


def _closing(pattern: str, i: int) -> int | None:
    """Where the group or class that begins at i ends."""
    depth, inside = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 < len(pattern) and pattern[i + 1] in "QE":
                return None
            i += 1
        elif inside:
            if c == "[" or pattern.startswith("&&", i):
                return None  # classes in classes
            inside = c != "]" or pattern[i - 1] == "[" or pattern[i - 2 : i] == "[^"
            if not inside and depth == 0:
                return i
        elif c == "[":
            inside = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return None


def regex_join(texts: DataFrame, patterns: list[str]) -> DataFrame:
    """(text, pattern) of different texts (text) in which a pattern is found. Patterns are compiled before (rules.usable).

    Literals that a pattern requires are looked for with contains_join, and only texts that have one are tested. Patterns of which no
    literal is sure are tested on every different text, all of them in one row of a text; unsure() counts them.
    """
    spark = texts.sparkSession
    kinds = texts.select("text").where("text IS NOT NULL").distinct()
    sure = {p: found for p in dict.fromkeys(patterns) if (found := literals(p))}
    rest = unsure(patterns)
    filed = spark.createDataFrame([(p, x) for p, found in sure.items() for x in found], "pattern string, name string")
    named = kinds.select(F.md5("text").alias("id"), "text")
    met = contains_join(named, filed).join(filed, "name").select("id", "pattern").distinct().join(named, "id").where(F.rlike("text", F.col("pattern"))).select("text", "pattern")
    if not rest:
        return met
    held = F.array(*(F.when(F.rlike("text", F.lit(p)), F.lit(p)) for p in rest))
    return met.unionByName(kinds.select("text", F.explode(F.array_compact(held)).alias("pattern")))


def unsure(patterns: list[str]) -> list[str]:
    """The patterns that have to be tested on every text."""
    return [p for p in dict.fromkeys(patterns) if not literals(p)]
