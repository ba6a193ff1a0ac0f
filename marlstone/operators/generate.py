"""Invented data for trials: every choice is a hash of the row's keys, so that reruns and other partitionings agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Error rates by severity.
RATES = {"high": 0.15, "mid": 0.07, "low": 0.02}
#: Faults of a scan: what happens to a character and how often, in parts of a hundred of all faults.
FAULTS = (("alike", 40), ("lost", 15), ("speck", 15), ("joined", 15), ("broken", 15))
ALIKE = "0O1l5S8B2Z6G.,:;"
SPECKS = "·˙¸'`"


def chance(*keys: Column) -> Column:
    """A number from 0 to 1, 1 excluded, that only the keys decide."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / float(1 << 30)


def picked(options: list[str] | tuple[str, ...], *keys: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), F.pmod(F.xxhash64(*keys), F.lit(len(options))).cast("int"))


def noisy(text: Column, rate: Column | float, *keys: Column, faults: tuple = FAULTS) -> Column:
    """A text as a bad scan gives it. `rate` of the characters meet a fault, drawn by the shares in `faults`:

    alike: the other of a pair of ALIKE; lost: nothing; speck: a speck behind it; joined: a space goes;
    broken: a space or line end behind it. A fault that can't befall a character (another letter alike, a space
    joined) leaves it, and line ends are only ever lost. The keys name the row. Null stays null.
    """
    rate = F.lit(rate) if isinstance(rate, float) else rate
    drawn = [name for name, share in faults for _ in range(share)]
    other = {ALIKE[k]: ALIKE[k ^ 1] for k in range(len(ALIKE) // 2 * 2)}
    alike = F.create_map(*[F.lit(x) for pair in other.items() for x in pair])

    def befallen(c: Column, i: Column) -> Column:
        draw = lambda what: F.pmod(F.xxhash64(*keys, i, F.lit(what)), F.lit(len(drawn))).cast("int")
        fault = F.get(F.array(*map(F.lit, drawn)), draw("fault"))
        outcome = {
            "alike": F.coalesce(alike[c], c), "lost": F.lit(""), "speck": F.concat(c, picked(SPECKS, *keys, i, F.lit("speck"))),
            "joined": F.when(c == " ", "").otherwise(c), "broken": F.concat(c, F.when(draw("end") % 3 == 0, "\n").otherwise(" ")),
        }
        result = c
        for name in outcome:
            result = F.when((fault == name) & ((c != "\n") | F.lit(name == "lost")), outcome[name]).otherwise(result)
        return F.when(chance(*keys, i) < rate, result).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), befallen), "")


def mirrored(name: Column) -> Column:
    """Left for right and right for left."""
    return F.replace(F.replace(F.replace(name, F.lit("우측"), F.lit("\x00")), F.lit("좌측"), F.lit("우측")), F.lit("\x00"), F.lit("좌측"))


# What a variant adds to its case's number, the days that it moves by, the last day of a month.
NUMBER_STEP, DAY_STEP, LAST_DAY = 111, 3, 28


def grade_variants(pool: DataFrame) -> DataFrame:
    """Each case of pool (recv_no, meeting_date, disease_name, body_part, grade) and two more: later by a month and by two, earlier by three
    and six days, within the year and the month's first 28 days; the first of them mirrored; numbers go up by 111."""
    day = F.to_date("meeting_date")
    rows = pool.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    moved = F.make_date(F.year(day), F.least(F.month(day) + F.col("j"), F.lit(12)), F.greatest(F.least(F.dayofmonth(day) - DAY_STEP * F.col("j"), F.lit(LAST_DAY)), F.lit(1)))
    return rows.select(
        F.when(F.col("j") == 0, F.col("recv_no")).otherwise((F.col("recv_no").cast("long") + NUMBER_STEP * F.col("j")).cast("string")).alias("recv_no"), F.when(F.col("j") == 0, day).otherwise(moved).alias("meeting_date"),
        F.when(F.col("j") == 1, mirrored(F.col("disease_name"))).otherwise(F.col("disease_name")).alias("disease_name"), "body_part", "grade",
    )


def past_variants(past: DataFrame, granted: tuple[str, ...], refused: tuple[str, ...], each: int = 5, yes: str = "해당") -> DataFrame:
    """Each case of past (review_type, review_content, kcd_codes, decision, summary) and `each` more, whose summaries are the
    first code and a reason that fits the decision."""
    rows = past.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(each))))
    keys = (F.col("summary"), F.col("k"))
    reason = F.when(F.col("decision") == yes, picked(granted, *keys)).otherwise(picked(refused, *keys))
    told = F.concat(F.coalesce(F.get("kcd_codes", 0), F.lit("")), F.lit(" 계열 - "), reason)
    return rows.select("review_type", "review_content", "kcd_codes", "decision", F.when(F.col("k") == 0, F.col("summary")).otherwise(told).alias("summary"))
