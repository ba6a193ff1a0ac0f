"""Short forms of law clauses: written out, explained, chosen by rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full names of laws by their short ones, how a clause is shortened, ranks that count as soldiers, clauses by duty and
# death, the mark of an answer without evidence.
LAWS = {"예우법": "국가유공자 등 예우 및 지원에 관한 법률", "보상법": "보훈보상대상자 지원에 관한 법률", "보상자법": "보훈보상대상자 지원에 관한 법률", "고엽제법": "고엽제후유의증 등 환자지원 및 단체설립에 관한 법률"}
CLAUSE = r"(\S+법)\s*([0-9]+)-([0-9]+)(?:-([0-9]+))?"
SOLDIERS = ("병사", "부사관", "장교", "경찰")
BY_DUTY = {(True, True): ("예우법 4-1-5", "보상법 2-1-1"), (True, False): ("예우법 4-1-6", "보상법 2-1-2"), (False, True): ("예우법 4-1-14", "보상법 2-1-3"), (False, False): ("예우법 4-1-15", "보상법 2-1-4")}
NO_EVIDENCE = "확인되지 않습니다"


def has_clause(text: Column) -> Column:
    return F.rlike(text, F.lit(CLAUSE))


def _clauses(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CLAUSE), 0)


def _read(clause: Column, laws: dict[str, str]) -> tuple[Column, Column, Column]:
    """Name, written reference and full name (null for a law that isn't known) of one short form."""
    part = lambda i: F.regexp_extract(clause, CLAUSE, i)
    item = F.when(part(4) != "", F.concat(F.lit("제"), part(4), F.lit("호"))).otherwise("")
    full = F.create_map(*[F.lit(x) for pair in laws.items() for x in pair])
    return part(1), F.concat(F.lit("제"), part(2), F.lit("조제"), part(3), F.lit("항"), item), F.try_element_at(full, part(1))


def expand_clauses(text: Column, laws: dict[str, str] = LAWS) -> Column:
    """Every short form with its article, paragraph and item written out, and the law's full name; the short name stays."""
    found = F.transform(_clauses(text), lambda m: F.concat_ws(" ", *_read(m, laws)))
    return F.array_join(F.zip_with(F.split(text, CLAUSE, -1), found, lambda between, m: F.concat(between, F.coalesce(m, F.lit("")))), "")


def clause_notes(text: Column, laws: dict[str, str] = LAWS) -> Column:
    """For each short form of a text the note 'short' = name reference (full name)."""

    def note(m: Column) -> Column:
        name, reference, full = _read(m, laws)
        return F.concat(F.lit("'"), m, F.lit("' = "), name, F.lit(" "), reference, F.coalesce(F.concat(F.lit(" ("), full, F.lit(")")), F.lit("")))

    return F.transform(_clauses(text), note)


def clauses_for(duty: Column, died: Column) -> Column:
    """struct(merit, compensation): the clauses that apply to a kind of duty, and whether the person died."""
    soldier = F.coalesce(duty.isin(*SOLDIERS), F.lit(False))
    one = lambda i: F.when(soldier & died, BY_DUTY[True, True][i]).when(soldier, BY_DUTY[True, False][i]).when(died, BY_DUTY[False, True][i]).otherwise(BY_DUTY[False, False][i])
    return F.struct(one(0).alias("merit"), one(1).alias("compensation"))
