"""Names and patterns in texts against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.operators import matching


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("무릎|허리", ["무릎", "허리"]), ("목$", ["목"]), ("^abc?d", ["ab"]), ("ab*|c", ["a", "c"]), ("(x|y) pain", [" pain"]), ("[ab]cd+e", ["cd"]), (".", None), ("", None), ("(?i)abc", None), (r"a\.b", ["a.b"]),
        (r"\bknee\b", ["knee"]), (r"\d{2}급", ["급"]), ("a{0,2}bc", ["bc"]), (r"\Qa|b\E", None), ("(?:ab)?cd", ["cd"]), ("(?!x)yz", ["yz"]), ("[]a]b", ["b"]), ("ab|", None), ("[a[bc]]d", None), (r"x\p{L}y", None), ("[^]]q", ["q"]),
    ],
)
def test_literals(pattern, want):
    assert matching.literals(pattern) == want


def test_literals_are_required(spark):
    """What matches holds a literal, in Java's reading: random patterns over random texts."""
    r = random.Random(4)
    piece = lambda: r.choice(["ab", "c", "d+", "e?", "[ab]", "(a|b)", "(cd)?", ".", "f*", r"\w", "a{2}", "b{0,1}", "^", "$", r"\."])
    patterns = ["|".join("".join(piece() for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 3))) for _ in range(150)]
    texts = ["".join(r.choice("abcdef.") for _ in range(r.randrange(0, 9))) for _ in range(60)]
    pairs = spark.createDataFrame([(p, t) for p in patterns for t in texts], "p string, t string").where("rlike(t, p)").collect()
    assert pairs and all(any(x in row.t for x in found) for row in pairs if (found := matching.literals(row.p)))


def test_contains_join(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abc가나") for _ in range(n))
    names = sorted({word(r.randrange(1, 9)) for _ in range(120)})
    texts = [(i, "".join(word(r.randrange(1, 30)))) for i in range(200)] + [(300, None), (301, ""), (302, names[0]), (303, "a" * 5000)]
    df = spark.createDataFrame([(i, t, "n") for i, t in texts], "id long, text string, name string").repartition(3)
    known = spark.createDataFrame([(x,) for x in [*names, "", None, "zz"]], "name string")
    got = sorted(map(tuple, matching.contains_join(df.select("id", "text"), known).collect()))
    assert got == sorted((i, x) for i, t in texts if t for x in names if x in t)
    assert matching.contains_join(df.select("id", "text"), known.where("false")).count() == 0


def test_names_meet_texts_in_place_or_by_shuffle(spark):
    """Few names go to the texts: neither their grams nor they are shuffled; beyond the limit the result is the same."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("ab é가나😀") for _ in range(n))
    names = sorted({word(r.randrange(1, 9)) for _ in range(90)})
    texts = [(i, word(r.randrange(0, 60))) for i in range(700)] + [(900, None)]
    df, known = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in names], "name string")
    want = sorted((i, x) for i, t in texts if t for x in names if x in t)
    few, many = matching.contains_join(df, known), matching.contains_join(df, known, letters=0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == want
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_regex_join(spark):
    texts = ["무릎 염좌", "허리", "목", "12급 x", "", None, "무릎 염좌", "a.b", "axb"]
    patterns = ["무릎|허리", "목$", r"\d+급", ".", "(?i)A", r"a\.b", "zz"]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, pattern int")
    got = sorted(map(tuple, matching.regex_join(df, patterns).collect()))
    assert got == sorted({(t, p) for t in texts if t is not None for p in patterns if re.search(p, t)})
    assert matching.unsure(patterns) == [".", "(?i)A"]


def test_no_nested_loop_where_literals_are_known(spark):
    df = spark.createDataFrame([("무릎 염좌",)], "text string")
    plan = matching.regex_join(df, ["무릎|허리", "목$"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    names = spark.range(3).select(F.col("id").cast("string").alias("name"))
    assert "NestedLoop" not in matching.contains_join(df.select(F.lit(1).alias("id"), "text"), names)._jdf.queryExecution().executedPlan().toString()
