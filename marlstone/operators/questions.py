"""Frames of questions: hits, laws first, answers that are tried again on new evidence, and how good they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .assembly import answer_quality
from .clauses import LAWS, NO_EVIDENCE, expand_clauses, has_clause
from .shared import fresh_dir, written

#: A search takes questions (id, text) and gives their hits (id, doc_id, r).
Search = Callable[[DataFrame], DataFrame]
#: A generator takes questions with their hits (id, text, hits: doc_ids in order) and gives each an answer or wording (id, said).
Generate = Callable[[DataFrame], DataFrame]


def listed(hits: DataFrame) -> DataFrame:
    """(id, hits): the doc_ids of each question in order."""
    ordered = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "doc_id"))).alias("x"))
    return ordered.select("id", F.transform("x", lambda h: h["doc_id"]).alias("hits"))


def merged(lists: list[DataFrame], most: int) -> DataFrame:
    """(id, doc_id, r) of several hit lists, one after the other for each question: a document where it comes first, at most `most`."""
    both = None
    for i, hits in enumerate(lists):
        part = hits.select("id", "doc_id", F.struct(F.lit(i).alias("list"), F.col("r").cast("long").alias("r")).alias("at"))
        both = part if both is None else both.unionByName(part)
    first = both.groupBy("id", "doc_id").agg(F.min("at").alias("at"))
    r = F.row_number().over(Window.partitionBy("id").orderBy("at", "doc_id")).cast("long")
    return first.select("id", "doc_id", r.alias("r")).where(F.col("r") <= most)


def law_first(questions: DataFrame, search: Search, search_laws: Search, most: int = 10, laws: dict[str, str] = LAWS) -> DataFrame:
    """Hits (id, doc_id, r) of questions (id, text); where one names a clause, what its written-out form finds among the laws comes first."""
    named = questions.where(has_clause(F.col("text"))).select("id", expand_clauses(F.col("text"), laws).alias("text"))
    return merged([search_laws(named), search(questions)], most)


def per_question(call: Callable[[str, list], str | None]) -> Generate:
    """A generator from a function of one question and its hits, called on the workers batch by batch; a failure says nothing (null)."""

    def said(text: str, hits: list) -> str | None:
        try:
            return call(text, hits)
        except Exception:  # noqa: BLE001
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [said(t, list(h) if h is not None else []) for t, h in zip(batch["text"], batch["hits"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "said": pd.Series(out, dtype=object, index=batch.index)})

    return lambda asked: asked.select("id", "text", "hits").mapInPandas(run, f"id {asked.schema['id'].dataType.simpleString()}, said string")


def _unanswered(answer: Column) -> Column:
    return F.contains(F.coalesce(answer, F.lit("")), F.lit(NO_EVIDENCE))


def answers(questions: DataFrame, search: Search, generate: Generate, rewrite: Generate | None = None, retries: int = 1, most: int = 10, laws: dict[str, str] = LAWS, wording: int = 200) -> DataFrame:
    """(id, text, answer, hits, retried, wordings) of all questions (id, text; ids differ), in rounds over the frame.

    A round takes the questions whose answer still says that there is no evidence, gives each a wording that it hasn't had (clauses written
    out, else the first `wording` letters of the first line of what rewrite says), and searches for all of them at once. Those for which a document turns up
    that they didn't have (an anti-join with the pairs held) get a new answer from the found documents before the held ones, `most` at the
    most; the others are done. So a round is a few jobs for any number of questions, and there are at most `retries`. Each
    round's state is a table in the shared folder, written when this is called. A question without a new wording, or whose
    rewriting says nothing, is done. wordings are all that were searched for, the first included.
    """
    return _rounds(questions, search, generate, rewrite, retries, most, laws, wording)[-1]


def _rounds(questions: DataFrame, search: Search, generate: Generate, rewrite: Generate | None = None, retries: int = 1, most: int = 10, laws: dict[str, str] = LAWS, wording: int = 200) -> list[DataFrame]:
    """What answers() says without retries, after one, and so on."""
    spark, at = questions.sparkSession, fresh_dir(questions.sparkSession, "answers")
    none = F.array().cast("array<long>")
    asked = questions.select("id", F.coalesce("text", F.lit("")).alias("text"))

    def told(rows: DataFrame) -> DataFrame:
        said = generate(rows.select("id", F.element_at("wordings", 1).alias("text"), "hits")).withColumnRenamed("said", "answer")
        return rows.join(said, "id")

    hits = listed(search(asked)).select("id", F.col("hits").cast("array<long>").alias("hits"))
    start = asked.join(hits, "id", "left").select("id", "text", F.coalesce("hits", none).alias("hits"), F.array("text").alias("wordings"), F.lit(0).alias("retried"))
    state = written(told(start).withColumn("open", _unanswered(F.col("answer"))), f"{at}/0")
    states = [state]
    for k in range(1, retries + 1):
        tried = state.where("open").withColumn("last", F.element_at("wordings", -1)).withColumn("now", expand_clauses(F.col("last"), laws))
        known = F.array_contains("wordings", F.col("now"))
        if rewrite:
            other = rewrite(tried.where(known).select("id", F.col("last").alias("text"), "hits"))
            first_line = F.substring(F.substring_index(F.trim(F.regexp_replace("said", r"^\s+|\s+$", "")), "\n", 1), 1, wording)
            tried = tried.join(other.select("id", first_line.alias("other")), "id", "left").withColumn("now", F.when(known, F.col("other")).otherwise(F.col("now"))).drop("other")
        fresh = written(tried.where((F.coalesce("now", F.lit("")) != "") & ~F.array_contains("wordings", F.col("now"))).drop("last"), f"{at}/{k}-tried")
        found = written(search(fresh.select("id", F.col("now").alias("text"))).select("id", F.col("doc_id").cast("long").alias("doc_id"), "r"), f"{at}/{k}-found")
        held = fresh.select("id", F.explode("hits").alias("doc_id"))
        better = found.join(held, ["id", "doc_id"], "left_anti").select("id").distinct()
        rows = fresh.join(better, "id", "left_semi").join(listed(found).withColumnRenamed("hits", "more"), "id")
        rows = rows.select("id", "text", F.slice(F.array_distinct(F.concat("more", "hits")), 1, most).alias("hits"), F.concat("wordings", F.array("now")).alias("wordings"), (F.col("retried") + 1).alias("retried"))
        again = written(told(rows).withColumn("open", _unanswered(F.col("answer"))), f"{at}/{k}-again")
        kept = state.join(again.select("id"), "id", "left_anti").withColumn("open", F.lit(False))
        state = written(kept.unionByName(again), f"{at}/{k}")
        states.append(state)
    return [x.select("id", "text", "answer", "hits", "retried", "wordings") for x in states]


def evaluation(questions: DataFrame, search: Search, generate: Generate, rewrite: Generate | None = None, retries: int = 1, names: DataFrame | None = None, **more) -> DataFrame:
    """Rates of the answers to questions (id, text, expected: a source's name), without and with retries: answer_quality by mode, `off` and `on`.

    A source is called by its doc_id unless names (doc_id, name) say otherwise. Retries go on from the answers without them, which are
    searched for and generated once for both modes.
    """
    both, rounds = None, _rounds(questions.select("id", "text"), search, generate, rewrite, retries, **more)
    for mode, said in (("off", rounds[0]), ("on", rounds[-1])):
        got = said.select(F.lit(mode).alias("mode"), "id", "answer", "hits", F.col("retried").alias("retries"))
        both = got if both is None else both.unionByName(got)
    each = both.select("mode", "id", F.explode("hits").alias("doc_id"))
    each = each.join(names, "doc_id", "left") if names is not None else each.withColumn("name", F.col("doc_id").cast("string"))
    sources = each.groupBy("mode", "id").agg(F.collect_list("name").alias("sources"))
    rows = both.join(sources, ["mode", "id"], "left").join(questions.select("id", "expected"), "id").withColumn("score", F.lit(None).cast("double"))
    return answer_quality(rows)
