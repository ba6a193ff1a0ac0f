"""Guarded SQL: one SELECT over allow-listed views with allow-listed functions, capped."""

from __future__ import annotations

import threading
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Row, SparkSession

ROOTS = {"Project", "Aggregate", "UnresolvedHaving", "Distinct", "Sort", "GlobalLimit", "Filter"}
FUNCTIONS = {"count", "sum", "avg", "min", "max", "round", "abs", "coalesce", "year", "month", "lower", "upper", "length", "substring", "concat", "if", "nullif", "greatest", "least", "count_if"}
MOST, SECONDS = 200, 5.0


class Refused(ValueError):
    pass


def _walk(node, relations: set, functions: set) -> None:
    """Names below a node of an unresolved plan, sub-queries included. Needs the classic session's parser."""
    name = node.getClass().getSimpleName()
    if name == "UnresolvedRelation":
        parts = node.multipartIdentifier()
        relations.add(".".join(parts.apply(i) for i in range(parts.size())))
    elif name == "UnresolvedTableValuedFunction":
        raise Refused("a table function")
    elif name == "UnresolvedFunction":
        parts = node.nameParts()
        functions.add(".".join(parts.apply(i) for i in range(parts.size())).lower())
    for kind in ("children", "innerChildren", "expressions"):
        try:
            found = getattr(node, kind)()
        except Py4JError:  # expressions have no expressions()
            continue
        for i in range(found.size()):
            _walk(found.apply(i), relations, functions)


def check(spark: SparkSession, sql: str, allowed: set[str]) -> None:
    """Raises Refused unless the text is one SELECT over at least one allowed view, with allowed functions only."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused("it can't be parsed as one statement") from e
    top = plan
    while top.getClass().getSimpleName() in ("GlobalLimit", "LocalLimit", "Sort", "Distinct") and top.children().size():
        top = top.children().apply(0)
    for p in (plan, top):
        if p.getClass().getSimpleName() not in ROOTS | {"LocalLimit"}:
            raise Refused(f"its root is {p.getClass().getSimpleName()}")
    relations, functions = set(), set()
    _walk(plan, relations, functions)
    if not relations or not relations <= allowed:
        raise Refused(f"relations: {sorted(relations - allowed)}")
    if not functions <= FUNCTIONS:
        raise Refused(f"functions: {sorted(functions - FUNCTIONS)}")


def _own_view(session: SparkSession, name: str, df: DataFrame) -> None:
    """A view that only this session has. Plans pass between sessions through a global view, under a name never used twice and gone at once."""
    passing = f"guarded_{uuid.uuid4().hex}"
    df.createGlobalTempView(passing)
    try:
        session.table(f"global_temp.{passing}").createOrReplaceTempView(name)
    finally:
        session.catalog.dropGlobalTempView(passing)


def run(spark: SparkSession, sql: str, views: dict[str, DataFrame], most: int = MOST) -> DataFrame:
    """Runs a checked SELECT in a session that has the views only."""
    session = spark.newSession()
    check(session, sql, set(views))
    for name, df in views.items():
        _own_view(session, name, df)
    return session.sql(sql).limit(most)


def rows(spark: SparkSession, sql: str, views: dict[str, DataFrame], most: int = MOST, seconds: float = SECONDS) -> list[Row]:
    """The rows of run(), Refused if they take longer than that: its jobs carry a tag of their own and are interrupted; the session stays usable."""
    df, sc = run(spark, sql, views, most), spark.sparkContext
    tag, late = f"guarded-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    sc.setInterruptOnCancel(True)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if late.is_set():
            raise Refused(f"it took longer than {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
        sc.setInterruptOnCancel(False)
