"""Golden cases of clauses, rules, prediction, edits and sources."""

import datetime
import json
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.functions import replies, text as tx
from marlstone.operators import clauses, graph_facts, instance_graph, prediction, questions, records, rules, state
from marlstone.sources import tables


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("보상법 2-1-3", "보상법 제2조제1항제3호 보훈보상대상자 지원에 관한 법률"), ("예우법4-1 요건", "예우법 제4조제1항 국가유공자 등 예우 및 지원에 관한 법률 요건"), ("민법 1-2와 (예우법 3-4)", "민법 제1조제2항와 (예우법 제3조제4항)"),
        ("요건은?", "요건은?"), ("고엽제법 28-1, 보상자법 1-1-1.", "고엽제법 제28조제1항 고엽제후유의증 등 환자지원 및 단체설립에 관한 법률, 보상자법 제1조제1항제1호 보훈보상대상자 지원에 관한 법률."), ("", ""),
    ],
)
def test_clauses_are_written_out(spark, text, want):
    assert one(spark, text, clauses.expand_clauses) == want
    assert one(spark, text, clauses.has_clause) == (text != want)


def test_notes_of_clauses(spark):
    assert one(spark, "예우법 4-1-6과 민법 1-2", clauses.clause_notes) == ["'예우법 4-1-6' = 예우법 제4조제1항제6호 (국가유공자 등 예우 및 지원에 관한 법률)", "'민법 1-2' = 민법 제1조제2항"]
    assert one(spark, "없음", clauses.clause_notes) == []


FRAMES = {"q 예우법 1-2": [1, 2], "q 예우법 제1조제2항 X": [3, 1], "other words": [4]}
LAWS = {"예우법": "X"}


@pytest.fixture(scope="module")
def found(spark):
    """Hits by question."""
    held = spark.createDataFrame([(q, d, i + 1) for q, ds in FRAMES.items() for i, d in enumerate(ds)], "text string, doc_id long, r long")
    return lambda asked: asked.join(held, "text").select("id", "doc_id", "r")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def always(said):
    return questions.per_question(lambda text, hits: said)


def test_retry_takes_new_evidence_only(spark, found):
    """Many questions at once: each goes its own way through the rounds."""
    texts = ["q 예우법 1-2", "other words", "nothing", None]
    never = always(clauses.NO_EVIDENCE)
    got = {r.id: r for r in questions.answers(asked(spark, *texts), found, never, laws=LAWS).collect()}
    assert (got[0].hits, got[0].retried, got[0].wordings) == ([3, 1, 2], 1, ["q 예우법 1-2", "q 예우법 제1조제2항 X"])
    assert [(got[i].hits, got[i].retried) for i in (1, 2, 3)] == [([4], 0), ([], 0), ([], 0)] and all(clauses.NO_EVIDENCE in r.answer for r in got.values())
    got = {r.id: r for r in questions.answers(asked(spark, *texts), found, never, always(" other words\nmore"), retries=3, laws=LAWS).collect()}
    assert (got[0].hits, got[0].retried, got[0].wordings[-1]) == ([4, 3, 1, 2], 2, "other words")
    assert (got[1].hits, got[1].retried) == ([4], 0) and (got[2].hits, got[2].retried) == ([4], 1)
    got = questions.answers(asked(spark, *texts), found, always("an answer"), laws=LAWS).collect()
    assert {(r.retried, r.answer) for r in got} == {(0, "an answer")}
    failing = questions.per_question(lambda text, hits: 1 / 0)
    got = {r.id: r for r in questions.answers(asked(spark, *texts), found, never, failing, retries=2, laws=LAWS).collect()}
    assert (got[0].retried, got[1].hits, got[1].retried) == (1, [4], 0)
    assert questions.answers(asked(spark, "x").where("false"), found, never, laws=LAWS).count() == 0


def test_a_failing_generator_says_nothing(spark, found):
    got = questions.answers(asked(spark, "other words"), found, questions.per_question(lambda text, hits: 1 / 0)).first()
    assert (got.answer, got.hits, got.retried) == (None, [4], 0)


def test_evaluation(spark, found):
    rows = asked(spark, "q 예우법 1-2", "other words", "nothing").withColumn("expected", F.lit("3"))
    generate = questions.per_question(lambda text, hits: f"see [a p.{hits[0]}]" if 3 in hits or 4 in hits else clauses.NO_EVIDENCE)
    got = {r.mode: r for r in questions.evaluation(rows, found, generate, laws=LAWS).collect()}
    third = round(1 / 3, 6)
    assert tuple(got["off"])[1:6] == (3, 0.0, round(2 / 3, 6), third, 0.0)
    assert tuple(got["on"])[1:6] == (3, third, third, round(2 / 3, 6), third)


def test_evaluation_searches_a_round_once(spark, found):
    """With retries goes on from the answers without them: first all questions, then those tried again."""
    searched = []
    search = lambda rows: searched.append(sorted(r.id for r in rows.collect())) or found(rows)
    rows = asked(spark, "q 예우법 1-2", "other words", "nothing").withColumn("expected", F.lit("3"))
    questions.evaluation(rows, search, always(clauses.NO_EVIDENCE), laws=LAWS).collect()
    assert searched == [[0, 1, 2], [0]]


def test_laws_come_first(spark, found):
    laws = lambda rows: rows.where(F.endswith("text", F.lit("X"))).select("id", F.explode(F.array(F.lit(2).cast("long"), F.lit(9).cast("long"))).alias("doc_id")).withColumn("r", F.col("doc_id"))
    rows = questions.law_first(asked(spark, "q 예우법 1-2", "other words"), found, laws, laws=LAWS).orderBy("id", "r").collect()
    assert [(r.id, r.doc_id) for r in rows] == [(0, 2), (0, 9), (0, 1), (1, 4)]


@pytest.mark.parametrize(("query", "want"), [("예우법 - 4조 예우법 --", ["예우법", "4조"]), ("- ---", [tx.NO_TERM]), ("", [tx.NO_TERM]), ("S83-5 a A", ["s83-5", "a"])])
def test_or_terms(spark, query, want):
    assert one(spark, query, tx.or_terms) == want


PREFIXES = {"2": ["M5"], "3": ["S83", "M17"], "4": ["C", "I"], "5": ["F"]}


@pytest.mark.parametrize(
    ("codes", "content", "want"),
    [
        (["C1"], "고엽제 자해", "5"), ([], "고엽제", "4"), (["i20"], "사망", "4"), (["M5"], "사망", "2"), (["i20"], None, "4"), (["S83"], "전상 여부", "1"), ([None, "x", "s831", "M51"], "부상", "3"), (["Z"], "", "1"), (None, None, "1"),
        (["e1"], "사망", "1"), (["E1"], "사망", "4"), ([None], "사망", "4"), ([], "사망", "1"),
    ],
)
def test_routes(spark, codes, content, want):
    df = spark.createDataFrame([(codes, content)], "codes array<string>, content string")
    assert df.select(rules.route(F.col("codes"), F.col("content"), PREFIXES)).first()[0] == want


RULE = "jr_id long, subcommittee string, pattern string, axis string, condition string, check_kind string, required_docs array<string>, basis string"


def test_rules_of_a_case(spark):
    d = datetime.date
    held = [(1, "3", "무릎 인대", "MRI 소견 진단서", d(2020, 1, 1), [d(2020, 5, 1), d(2020, 4, 2), None]), (2, "3", "무릎", None, None, [d(2020, 1, 1)]), (3, "3", "무릎", "x", d(2020, 1, 1), [d(2021, 1, 1)]), (4, "2", "무릎", "x", None, [])]
    cases = spark.createDataFrame(held, "app_id long, subcommittee string, target string, pool string, injured date, images array<date>")
    rows = [(1, "3", "무릎", "급성 외상", "c", "auto", None, "b"), (2, "3", "인대|힘줄", "서류", "c", "doc", ["mri", "진단서", "영상"], "b"), (3, "3", "무릎(", "급성", "c", "auto", None, "b"), (4, "3", "무릎", "전체", "c", "auto", None, "b")]
    got = {(r.app_id, r.jr_id): r for r in rules.check(cases, spark.createDataFrame(rows, RULE)).collect()}
    assert {k: r.status for k, r in got.items()} == {(1, 1): "ok", (1, 2): "lack", (1, 4): "manual", (2, 1): "manual", (2, 4): "manual", (3, 1): "lack", (3, 4): "manual"}
    assert got[1, 1].note == "MRI 촬영이 부상일 기준 92일 — 3개월 이내 (급성 축 충족)" and got[1, 2].missing_docs == ["영상"] and got[1, 2].note == "미확인 자료: 영상"
    assert got[2, 1].note == rules.NO_DATES and "366일 경과" in got[3, 1].note and got[1, 4].note is None


def test_facts_of_rules(spark):
    rows = [(1, "3", "무릎|슬관절", "급성", "c1", "auto", ["b", "a"], "m"), (2, "3", "무릎", "서류", "c2", "doc", None, ""), (3, "2", "(", "x", "c3", "doc", None, "")]
    texts = spark.createDataFrame([(1, "무릎 통증"), (2, "슬관절"), (3, "목")], "id long, text string")
    got = [tuple(r) for r in rules.rule_facts(texts, spark.createDataFrame(rows, RULE)).orderBy("id", "place").collect()]
    first = "〔제3분과·급성〕 c1 (필요서류: a, b) [근거: m]"
    assert got == [(1, 1, first), (1, 2, "〔제3분과·서류〕 c2"), (2, 1, first)]
    fact = lambda k: (lambda: spark.range(k).select(F.col("id").alias("place"), F.col("id").cast("string").alias("fact")))
    assert len(rules.facts_or_none([fact(7), fact(7)])) == 10 and rules.facts_or_none([fact(3), lambda: 1 / 0]) == []


@pytest.mark.parametrize(("before", "proposed", "want"), [(99, 99, None), (5, 99, "등급기준미달"), (99, 3, "승급(기준미달→등급)"), (5, 3, "승급"), (3, 5, "하향"), (3, 3, "직전등급 유지")])
def test_updown(spark, before, proposed, want):
    df = spark.createDataFrame([(before, proposed)], "a int, b int")
    assert df.select(prediction.updown(F.col("a"), F.col("b"))).first()[0] == want


def test_predictions(spark):
    v = [1.0, 0.0]
    criteria = spark.createDataFrame([(1, "7급", "무릎", "기능장애가 있는 사람", v), (2, "6급", "무릎", "경도의 기능장애", v), (2, "5급", "허리", "운동", v)], "class_no int, grade string, body_part string, description string, embedding array<double>")
    cases = spark.createDataFrame([(1, "목", "7급", v), (2, None, "6급", [0.0, 1.0]), (3, "눈", "7급", v)], "case_id long, body_part string, grade string, embedding array<double>")
    asked = spark.createDataFrame([(1, "경도 기능장애", "무릎", v), (2, "운동 장애", None, v), (3, "x", "눈", v)], "id long, disease string, body_part string, embedding array<double>")
    got = {r.id: r for r in prediction.predict(asked, criteria, cases).collect()}
    assert (got[1].grade1, got[1].grade2) == ("6급 2호", "7급 1호") and "상이등급구분표 2호 \"경도의 기능장애\"" in got[1].rationale and got[1].rationale.endswith("상이등급 '6급 2호'에 해당함.")
    assert (got[2].grade1, got[2].grade2) == ("7급 1호", "5급 2호")  # 장애 and 운동 count alike; the smaller number wins
    assert (got[3].grade1, got[3].grade2, got[3].rationale) == ("7급", "6급", None)
    near = [(r.r, r.case_id) for r in prediction.similar_cases(asked.where("id = 3"), cases).orderBy("r").collect()]
    assert near == [(1, 2), (2, 3), (3, 1)]  # a case without body part, then the same one, then others


def test_items_are_edited(spark):
    kind = "array<map<string,string>>"
    df = spark.createDataFrame([([{"g": "1", "x": "k"}, {"g": "2"}], [{"g": " 3 ", "no": "n"}]), ([{"g": "1"}], [{"g": ""}, {"g": "5"}]), ([{"g": "1"}, {"g": "2"}], []), ([], [{"g": "9"}]), ([{"g": "1"}], None)], f"items {kind}, edits {kind}")
    got = [r[0] for r in df.select(state.edit_items(F.col("items"), F.col("edits"), ["g"])).collect()]
    assert got == [[{"x": "k", "g": "3"}], [{"g": None}, {"g": "5"}], [{"g": "1"}], [{"g": "9"}], [{"g": "1"}]]


def test_columns_are_edited_with_an_audit(spark):
    held = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "k long, v string, n int")
    edits = spark.createDataFrame([(1, "v", "b", "e", 1), (1, "v", None, "e", 2), (2, "v", "c", "f", 3), (2, "n", "9", "f", 4), (7, "v", "z", "f", 5)], "k long, field string, value string, editor string, at long")
    now, audit = state.edit_column(held, edits, "k", ["v"])
    assert sorted(map(tuple, now.collect())) == [(1, None, 5), (2, "c", 6)]
    assert [tuple(r) for r in audit.orderBy("at").collect()] == [(1, "v", "a", "b", "e", 1), (1, "v", "b", None, "e", 2), (2, "v", None, "c", "f", 3)]


def test_reloads_and_counters(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, doc_type string")
    batch = spark.createDataFrame([(8, "a"), (9, None)], "k long, doc_type string")
    assert sorted(map(tuple, state.reload_types(held, batch).collect())) == [(2, "b"), (8, "a"), (9, None)]
    likes = spark.createDataFrame([(1, None), (2, 4), (3, None)], "k long, likes long")
    assert sorted(map(tuple, state.counted(likes, spark.createDataFrame([(1,), (1,), (2,)], "k long"), "k", "likes").collect())) == [(1, 2), (2, 5), (3, None)]


def test_code_tables(spark, tmp_path):
    (tmp_path / "agenda.csv").write_text('review_type_name,content,agenda,in_use\n등록,요건,"가, 나 ""다""",t\n재심,,x,f\n', encoding="utf-8")
    df = tables.read_codes(spark, str(tmp_path / "agenda.csv"))
    assert df.columns == ["review_type_name", "content", "agenda", "in_use"] and dict(df.dtypes)["in_use"] == "boolean"
    assert sorted(map(tuple, df.collect())) == [("등록", "요건", '가, 나 "다"', True), ("재심", None, "x", False)]


def test_dump_of_rulings(spark, tmp_path):
    def folder(name, svc, url=None):
        at = tmp_path / "d" / name
        at.mkdir(parents=True)
        (at / "p.json").write_text(json.dumps({"PrecService": svc}) if isinstance(svc, dict) else svc, encoding="utf-8")
        if url:
            (at / "p_meta.json").write_text(json.dumps({"url": url}), encoding="utf-8")

    folder("a" * 32, {"사건명": "국가유공자 등록", "판시사항": "가<br/>나", "판례내용": "x<br>y", "법원명": "법원", "사건번호": "1", "선고일자": "20200102999"}, "u")
    folder("b" * 32, {"사건명": "다른 일", "판례내용": "고엽제 보훈"})
    folder("c" * 32, {"사건명": "다른 일", "판례내용": "고엽제만"})
    folder("d" * 32, "{broken")
    folder("short", {"사건명": "국가유공자"})
    got = {r.keyword: r for r in tables.read_rulings(spark, str(tmp_path / "d")).collect()}
    assert set(got) == {"국가유공자", "고엽제(전문)"}
    r = got["국가유공자"]
    assert (r.case_no, r.court, r.date, r.title, r.gist, r.body, r.url) == ("법원 1", "법원", "2020010299", "국가유공자 등록", "가 나", "x\ny", "u") and got["고엽제(전문)"].url is None


def test_refined_files(spark):
    part = lambda **k: {"doc_type": "진단서", "line_range": [3, 9], "corrected": "글" * 500} | k
    rows = [("a", {"source": "s1", "birth": "80", "person": "p", "docs": [part(disease=["무릎", "목"], hospital="h", fixes=["x"]), part(disease=None)]}), ("b", {"source": "s2", "docs": [part(disease="허리")]}), ("c", {"source": "s3", "docs": [part(), part()]})]
    got = {r.file_name: r for r in tables.final_scans(spark.createDataFrame([(p, json.dumps(v)) for p, v in rows], "path string, value string")).collect()}
    a = got["s1"]
    assert (a.doc_kind, a.pages, a.hospital, a.reg_no) == ("의무기록 묶음(무릎, 목)", 2, "h", "80") and len(a.raw_text) == 1002
    assert (a.blocks[0].line, a.blocks[0].fields.disease, a.blocks[0].corrected, a.blocks[0].n_fixes, len(a.blocks[0].excerpt)) == (3, "무릎, 목", True, 1, 400) and not a.blocks[1].corrected
    assert (got["s2"].doc_kind, got["s2"].blocks[0].fields.disease, got["s3"].doc_kind) == ("진단서", "허리", "의무기록 묶음(2건)")


@pytest.mark.parametrize(("text", "want"), [("# 제목\n**굵게** *기울임* a*b*c", "제목\n굵게 기울임 a*b*c"), ("x\n\n\n\ny", "x\n\ny"), ("- a\n* b", "a\nb"), ("---\nz", "z"), (None, None)])
def test_markdown(spark, text, want):
    assert one(spark, text, tx.strip_markdown) == want


@pytest.mark.parametrize(("path", "want"), [("a/b.txt#이름#n", "이름#n"), ("a\\b\\c.pdf", "c.pdf"), ("c.pdf", "c.pdf"), ("a#", "")])
def test_labels(spark, path, want):
    assert one(spark, path, tx.label) == want


@pytest.mark.parametrize(("values", "want"), [(["a", "b", "b", "a"], "a"), (["a", "b", "b"], "b"), ([], None), (["x"], "x")])
def test_first_most(spark, values, want):
    assert one(spark, values, tx.first_most, "array<string>") == want


def test_word_diff_prefers_giving_up_old_words():
    assert replies.word_diff("a b", "b a") == ("<del>a</del><del> </del>b", "b<ins> </ins><ins>a</ins>")
    assert replies.word_diff("x", "y") == ("<del>x</del>", "<ins>y</ins>") and replies.word_diff("a", None) == ("<del>a</del>", "")


def test_board(spark):
    posts = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 99, "d"), (5, None, "e"), (6, 1, "f")], "id long, parent_id long, author string")
    got = {r.id: [x.id for x in r.replies] for r in records.threads(posts).collect()}
    assert got == {1: [2, 6], 5: []}


def test_exchanges(spark):
    held = spark.createDataFrame([("s", 1), ("s", 2)], "session string, seq long")
    batch = spark.createDataFrame([("s", 2, "q2", "a2", []), ("s", 1, "q1" * 40, "a1", [(7, "c", "more")]), ("t", 1, "q" * 70, "a", None)], "session string, at long, question string, answer string, sources array<struct<doc_id:long,content:string,other:string>>")
    got = {(r.session, r.seq): r for r in records.exchanges(held, batch).collect()}
    assert {k: r.role for k, r in got.items()} == {("s", 3): "user", ("s", 4): "ai", ("s", 5): "user", ("s", 6): "ai", ("t", 1): "user", ("t", 2): "ai"}
    assert [tuple(x) for x in got["s", 4].sources] == [("7", None, None, "c", None)] and got["s", 6].sources == [] and got["t", 2].sources is None and got["s", 5].content == "q2"
    assert [tuple(r) for r in records.new_sessions(held, batch).collect()] == [("t", "q" * 60)]


def test_facts_of_a_scan_graph(spark):
    nodes = spark.createDataFrame([("person", "김철수:1", "김철수"), ("person", "김철수:2", "김철수"), ("disease", "무릎 염좌", "무릎 염좌"), ("disease", "목", "목"), ("scan_doc", "1", "x")], "ntype string, key string, name string")
    edge = [("person", "김철수:1", "HAS_DOC", "scan_doc", "1"), ("person", "김철수:2", "HAS_DOC", "scan_doc", "2"), ("scan_doc", "1", "MENTIONS", "disease", "무릎 염좌"), ("scan_doc", "2", "MENTIONS", "disease", "무릎 염좌"), ("scan_doc", "1", "ASSIGNS_GRADE", "grade", "7급"), ("scan_doc", "1", "MENTIONS_KCD", "kcd", "S83"), ("disease", "무릎 염좌", "CODED_AS", "kcd", "S83")]
    edges = spark.createDataFrame(edge, "stype string, skey string, etype string, dtype string, dkey string")
    asked = spark.createDataFrame([(1, "김철수 님의 무릎 염좌 S83은 7급 1항?"), (2, "M17.1과 XS83, 손목"), (3, "")], "id long, text string")
    found = graph_facts.entities(asked, nodes)
    assert sorted(map(tuple, found.collect())) == [(1, "code", "S83"), (1, "disease", "무릎 염좌"), (1, "grade", "7급1항"), (1, "person", "김철수"), (2, "code", "M17.1"), (2, "disease", "목")]
    scans = spark.createDataFrame([(1, "진단서"), (2, None)], "sd_id long, doc_kind string")
    facts = lambda df: sorted(r.fact for r in df.collect())
    assert facts(graph_facts.person_facts(found, nodes, edges, scans)) == ["김철수 — 문서[스캔#2] 질환: 무릎 염좌", "김철수 — 문서[진단서#1] 질환: 무릎 염좌 (KCD S83) · 기재 등급: 7급"]
    assert facts(graph_facts.disease_facts(found, nodes, edges)) == ["무릎 염좌 — 실데이터 대상자 2명: 김철수 (KCD S83)"]
    assert facts(graph_facts.code_facts(found, nodes, edges)) == ["KCD S83 — 질환: 무릎 염좌 / 대상자: 김철수"]


def test_field_hits(spark):
    found = spark.createDataFrame([(1, "grade", "7급 12"), (1, "disease", "무릎 염좌"), (2, "grade", None)], "block long, field string, value string")
    expected = spark.createDataFrame([(1, "grade", ["7급", "1201"]), (1, "disease", ["허리", "무릎"]), (2, "grade", ["7"]), (3, "disease", ["x"])], "block long, field string, needles array<string>")
    assert sorted(map(tuple, records.field_hits(found, expected).collect())) == [(1, "disease", True), (1, "grade", False), (2, "grade", False), (3, "disease", False)]


def test_clauses_are_numbered_once_for_all_cases_of_a_kind(spark):
    """More cases and clauses than one block of either; nothing is gathered or sorted for a case."""
    order = spark.range(600).select((F.col("id") % 60).cast("string").alias("rule_no"), F.lit("x").alias("review_content"), F.lit(None).cast("string").alias("target_cond"), F.floor(F.col("id") / 60).cast("string").alias("pair_order"), F.col("id").cast("string").alias("judge_item"), F.lit("r").alias("result"))
    cases = spark.range(1100).select(F.col("id").alias("case_id"), F.when(F.col("id") < 1099, "x").otherwise("y").alias("review_content"), F.when(F.col("id") % 2 == 0, "").alias("target_cond"))
    found = rules.applied_clauses(order, cases)
    got = found.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "judge_item"))), lambda c: c["judge_item"]).alias("items"), F.max("place").alias("most")).collect()
    want = [str(pair * 60 + no) for no in range(60) for pair in range(10)]
    assert sorted(r.case_id for r in got) == list(range(1099)) and all(r["items"] == want and r.most == 600 for r in got)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [case_id" not in plan


def test_written_clauses_stay_small(spark, tmp_path):
    """All clauses of a case one after the other took about four bytes a row, so a gigabyte of tables filled the disk. A case without id stays."""
    order = spark.range(20_000).select(F.col("id").cast("string").alias("rule_no"), F.lit("x").alias("review_content"), F.lit("").alias("target_cond"), F.lit("1").alias("pair_order"), F.concat(F.lit("item "), F.col("id") * 7919 % 61).alias("judge_item"), F.lit("r").alias("result"))
    cases = spark.range(40).select(F.when(F.col("id") > 0, F.col("id")).alias("case_id"), F.lit("x").alias("review_content"), F.lit("").alias("target_cond"))
    rules.applied_clauses(order, cases).select("case_id", "place", "judge_item").write.parquet(str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out"))
    held = found.groupBy("case_id").agg(F.count("*").alias("n"), F.sum("place").alias("s"), F.count_distinct("place").alias("d"), F.count_if(F.col("judge_item") == F.concat(F.lit("item "), (F.col("place") - 1) * 7919 % 61)).alias("right")).collect()
    assert {r.case_id for r in held} == {None, *range(1, 40)} and all((r.n, r.s, r.d, r.right) == (20_000, 200_010_000, 20_000, 20_000) for r in held)
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.5 * 800_000


def test_entities_leave_questions_and_nodes_to_the_executors(spark):
    """Both grow; neither the questions' letters nor the nodes are a table that the driver would have to hold."""
    nodes = spark.createDataFrame([("person", "p", "김철수"), ("disease", "허리", "허리"), ("disease", "목 통증", "목 통증"), ("disease", "x", "x")], "ntype string, key string, name string")
    texts = ["김철수 허리와 목 통증", "허리", None, "", "ax", "허리"]
    found = graph_facts.entities(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), nodes)
    want = {(0, "person", "김철수"), (0, "disease", "허리"), (0, "disease", "목 통증"), (1, "disease", "허리"), (4, "disease", "x"), (5, "disease", "허리")}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bare", [0, 2, 4, 9])
def test_similar_cases_meet_only_cases_that_may_come_first(spark, bare):
    """Many, few or no cases without a body part; parts with many cases, with one, with none."""
    r = np.random.default_rng(bare)
    cases = [(i, None if i < bare else ["a", "a", "a", "", "b"][i % 5] if i < 40 else "a", f"g{i % 3}", r.normal(0, 1, 4).tolist()) for i in range(60)] + [(99, "a", "g", None)]
    asked = [(i, ["a", "b", "c", None, ""][i % 5], r.normal(0, 1, 4).tolist()) for i in range(20)] + [(50, "a", [0.0] * 4)]
    found = prediction.similar_cases(spark.createDataFrame(asked, "id long, body_part string, embedding array<double>"), spark.createDataFrame(cases, "case_id long, body_part string, grade string, embedding array<double>"), 5)
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 4)
    want = []
    for q, own, v in asked[:-1]:
        ranked = sorted((-(2 if p is None else int(p == (own or ""))), -cos(v, e), c, g) for c, p, g, e in cases[:-1])[:5]
        want += [(q, i, c, g, -s) for i, (_, s, c, g) in enumerate(ranked, 1)]
    assert sorted(map(tuple, found.collect())) == want
    assert ("CoGroups" in (plan := found._jdf.queryExecution().optimizedPlan().toString())) and ((plan.count("CoGroups") == 1 and "isnull(body_part" in plan) == (bare > 5))


def test_what_blocks_say_is_worked_out_once(spark):
    blocks = spark.createDataFrame([(1, "t", 1, ("무릎 염좌", "3 급", "M1"), (None, None, "rule"))], "sd_id long, doc string, line int, fields struct<disease: string, grade: string, kcd: string>, norm struct<disease: string, grade: string, source: string>")
    scans = spark.createDataFrame([(1, "p", None, None, "k", 1)], "sd_id long, person string, reg_no string, hospital string, doc_kind string, ga_id long")
    agendas, asked = spark.createDataFrame([], "ga_id long, agenda_no string"), spark.createDataFrame([("무릎",)], "pattern string")
    edges = instance_graph.layer(scans, blocks, agendas, asked)[1]
    assert "regexp_replace" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert {(e.etype, e.skey, e.dkey) for e in edges.collect()} == {("HAS_DOC", "p:", "1"), ("MENTIONS", "1", "무릎 염좌"), ("MATCHES_RULE", "무릎 염좌", "무릎"), ("MENTIONS_KCD", "1", "M1"), ("CODED_AS", "무릎 염좌", "M1"), ("ASSIGNS_GRADE", "1", "3급")}


def test_a_set_that_many_questions_exclude_is_no_row_for_each_pair(spark, monkeypatch):
    """predict_grades listed every excluded case of every fifth question, so its picks grew with the square of the vectors."""
    from marlstone import queries_review

    given = []
    monkeypatch.setattr(prediction, "predict", lambda asked, criteria, cases, *picks: given.append((asked, picks)) or asked.select("id", *(F.lit("").alias(c) for c in ("grade1", "grade2", "rationale"))))
    queries_review.predict_grades(queries_review.Tables(spark, "/root/testdata/sf0.01"))
    asked, picks = given[0]
    rows = [f.count() for p in picks if p is not None for f in (p if isinstance(p, tuple) else (p,))]
    assert sum(rows) <= 3 * asked.count()


def test_excluded_sets_are_as_their_cases_excluded_one_by_one(spark):
    near = spark.createDataFrame([(i, r, (i + 3 * r) % 11, f"g{r % 2}", 1.0 - r / 10) for i in range(12) for r in range(1, 6)], "id long, r long, case_id long, grade string, similarity double")
    cases = spark.createDataFrame([(c, f"own{c}") for c in range(11)], "case_id long, grade string")
    held, out = [(c, s) for c in range(10) for s in {c % 3, c % 4 + 10, None}], [(i, s) for i in range(0, 12, 2) for s in {i % 3, 11, None}]
    pairs = {(i, c) for i, s in out for c, x in held if s is not None and s == x}
    pins = [(i, (i * 5) % 11, "pin", 1.0) for i in range(0, 12, 3)]
    picks = lambda rows: spark.createDataFrame(rows, "id long, case_id long, kind string, weight double")
    sets = spark.createDataFrame(out, "id long, case_set long"), spark.createDataFrame(held, "case_id long, case_set long")
    got = sorted(map(tuple, prediction.picked_cases(near, cases, picks(pins), sets).collect()), key=str)
    assert got == sorted(map(tuple, prediction.picked_cases(near, cases, picks(pins + [(i, c, "exclude", 1.0) for i, c in pairs])).collect()), key=str)


def test_alike_criteria_are_met_once(spark, monkeypatch):
    """Many criteria of one vector and text: only those that may be among the best are sent, and ties go by number, grade and text."""
    r = np.random.default_rng(5)
    vectors = r.normal(0, 1, (3, 4)).tolist()
    rows = [(int(r.integers(0, 40)), f"g{i % 3}", ["a", "a", "b", None][i % 4], ["red bolt", "ring", None, "bolt"][int(r.integers(0, 4))], vectors[int(r.integers(0, 3))]) for i in range(600)]
    asked = [(i, ["red bolt", "ring", None, "xx bolt"][i % 4], ["a", "b", "c", None][i // 4 % 4], vectors[i % 3] if i % 5 else r.normal(0, 1, 4).tolist()) for i in range(150)]
    real, sent = prediction.meet, []
    monkeypatch.setattr(prediction, "meet", lambda known, *a, **b: sent.append(known) or real(known, *a, **b))
    found = prediction.score_criteria(spark.createDataFrame(asked, "id long, disease string, body_part string, embedding array<double>"), spark.createDataFrame(rows, "class_no long, grade string, body_part string, description string, embedding array<double>"))
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = []
    for i, disease, part, v in asked:
        words = [w for w in dict.fromkeys((disease or "").split()) if len(w) > 1]
        ranked = sorted((-round(sum(len(w) for w in words if w in (d or "")) + cos(v, e), 4), c, g, d is not None, d or "") for c, g, p, d, e in rows if p and part in (None, p))[:6]
        want += [(i, n, c, g, d if some else None, -s) for n, (s, c, g, some, d) in enumerate(ranked, 1)]
    assert sorted(map(tuple, found.collect()), key=lambda x: x[:2]) == want
    most = sent[0].groupBy("body_part", "description", F.col("embedding").cast("string")).count().agg(F.max("count")).first()[0]
    assert most <= prediction.CRITERIA


def test_criteria_hold_the_scores_of_few_queries_at_once(spark, monkeypatch):
    """A block of 8192 criteria and 1024 queries has 67 MB of scores; less than half of that is held."""
    kept = []
    monkeypatch.setattr(prediction, "meet", lambda r, rk, q, qk, run, schema, **_: kept.append(run) or spark.createDataFrame([], schema))
    queries = spark.createDataFrame([], "id long, disease string, body_part string, embedding array<double>")
    prediction.score_criteria(queries, spark.createDataFrame([], "class_no long, grade string, body_part string, description string, embedding array<double>"))
    r = np.random.default_rng(1)
    vectors = lambda n: pa.array(list(r.normal(0, 1, (n, 4))))
    rows = pa.table({"class_no": np.arange(8192), "grade": ["g"] * 8192, "description": ["red bolt", "ring"] * 4096, "embedding": vectors(8192)})
    asked = pa.table({"id": np.arange(1024), "words": [["bolt"], ["ring", "red"], []] * 341 + [["red"]], "embedding": vectors(1024)})
    tracemalloc.start()
    got = kept[0](rows, asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 1024 * prediction.CRITERIA and peak < 33e6
