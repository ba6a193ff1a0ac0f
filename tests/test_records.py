"""Texts to blocks, replies, scans to rows, assembled documents, generator loops."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import replies
from marlstone.operators import assembly, clauses, records, scans
from marlstone.sources import texts

BLOCKS = f"scan_id long, seq int, title string, line int, excerpt string, fields {scans.FIELDS}, norm {scans.NORM}"
SCANS = "scan_id long, reg_no string, person string, hospital string, kind string, text string"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_pages(spark):
    long = "\n".join(["word " * 30] * 4)
    pages = spark.createDataFrame([(1, 1, "first paragraph here\n \nsecond  paragraph\nhere\n\nshort"), (1, 2, long), (1, 3, " "), (2, 1, None)], "doc_id long, page int, text string")
    got = [(r.doc_id, r.page, r.seq, len(r.text)) for r in texts.page_blocks(pages).orderBy("doc_id", "page", "seq").collect()]
    assert got == [(1, 1, 0, 20), (1, 1, 1, 21), (1, 2, 0, 449), (1, 2, 1, 149)]
    assert texts.empty_pages(pages).count() == 2
    assert {r.doc_id: r.layered for r in texts.has_text_layer(pages).collect()} == {1: True, 2: False}


def test_manuals_and_precedents(spark):
    text = "\n\n".join(f"paragraph number {i:04d}" for i in range(9)) + "\n\nshort"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert [r.page for r in texts.manual_blocks(docs).orderBy("seq").collect()] == [1] * 8 + [2]
    docs = spark.createDataFrame([(1, "1. " + "a" * 50 + "\nmore\n2. short\nⅡ " + "b" * 3000)], "doc_id long, text string")
    assert [len(r.text) for r in texts.heading_blocks(docs).orderBy("seq").collect()] == [58, 2400]
    item = spark.createDataFrame([("d", "n1", None, "2020", "", "gist", "x" * 1200 + " " * 1200 + "y" * 24000), ("e", None, None, None, None, None, None)], "doc_id string, case_no string, court string, date string, title string, gist string, body string")
    got = texts.precedent_blocks(item).orderBy("doc_id", "seq").collect()
    assert (got[0].text, [r.page for r in got[:-1]], got[-1].text) == ("[n1 / 2020]\ngist", [1, 2, *range(4, 22)], "[]\n")


@pytest.mark.parametrize(("reply", "want"), [("문제 없음.", []), (None, []), ("- one\n\n* two", ["one", "two"]), ("\n".join("abcdefg"), list("abcde"))])
def test_issues(spark, reply, want):
    assert one(spark, reply, replies.issues) == want == assembly.points_of(reply)


def test_replies(spark):
    assert one(spark, "심의의결서\n\nText one다.\nmore\n서명\nname", replies.without_frame) == "Text one다.\nmore"
    assert one(spark, "so:\n```sql\nSELECT 1;\n```", replies.fenced_sql) == "SELECT 1"
    assert one(spark, 'ok {"a": {"b": 1}} bye', replies.outer_json) == '{"a": {"b": 1}}'
    assert one(spark, "none", replies.outer_json) is None
    assert tuple(one(spark, "Left ACL reconstruction.", replies.finding)) == ("무릎 전방십자인대 파열(재건술 후)", "다리", "좌")
    assert tuple(one(spark, "Rt wrist fracture", replies.finding)) == ("골절", None, "우")
    assert tuple(one(spark, " sprain. ", replies.finding)) == ("sprain. ".strip().rstrip("."), None, "")
    assert [one(spark, x, replies.grade) for x in ("7 급 1항", "1-2-3456", "G3", None)] == ["7급1항", "1-2-3456", None, None]
    assert one(spark, "방광암 (C67.9),7초검진/폐암 *to", replies.diseases) == ["방광암", "폐암"]
    assert one(spark, "aaa bbb cccc d", lambda c: replies.wrapped(c, 8)) == ["aaa bbb", "  cccc d"]


def test_word_diff(spark):
    assert replies.word_diff("a b c", "a x c") == ("a <del>b</del> c", "a <ins>x</ins> c")
    assert replies.word_diff(None, "<") == ("", "<ins>&lt;</ins>") and replies.word_diff("", "") == ("", "")
    got = spark.createDataFrame([("a b", "b")], "x string, y string").select(replies.compared("x", "y")).first()[0]
    assert tuple(got) == ("<del>a</del><del> </del>b", "b")


def _scan_rows(spark):
    f = lambda **k: tuple(k.get(n) for n in ("date", "disease", "grade", "exam_kind", "exam_dept", "opinion", "kcd"))
    blocks = spark.createDataFrame([
        (1, 0, "장애진단서", 3, "~Long enough 소견 sentence. no\nAnother 긴 sentence here", f(date="2020-02-31", disease=" "), None),
        (1, 1, "record", 9, "x" * 500, f(date="bad", disease="폐암", kcd="C34"), None),
        (2, 0, "record", 1, None, f(grade="7급"), None),
    ], BLOCKS)
    docs = spark.createDataFrame([(1, "650101", None, None, "의무기록 묶음(위암)", "t"), (2, None, "p", "h", "의무기록 묶음(위암)", "t"), (3, "1", "p", "h", "k", "t")], SCANS)
    return docs, blocks


def test_normalise(spark):
    docs, blocks = _scan_rows(spark)
    step = scans.normalise(blocks, limit=1)
    assert {(r.scan_id, r.seq): r.norm is not None for r in step.collect()} == {(1, 0): True, (1, 1): False, (2, 0): True}
    done = {(r.scan_id, r.seq): r.norm for r in scans.normalise(step).collect()}
    assert done[1, 0].summary == "Long enough 소견 sentence" and len(done[1, 0].key_findings) == 2 and done[1, 1].source == "rule"
    told = {(r.scan_id, r.seq): r.norm for r in scans.normalise(blocks, lambda title, text: 'so {"disease": "간암"}' if title == "record" else 1 / 0).collect()}
    assert (told[1, 0].source, told[1, 1].source, told[1, 1].disease, told[1, 1].src_line) == ("rule", "llm", "간암", 9)
    text = {r.scan_id: r.text for r in scans.clean_text(scans.sections(scans.normalise(blocks), docs)).collect()}
    assert text[2] == "[record]\nhospital: h\ngrade: 7급\n(line 1)"


def test_cases_and_agendas(spark):
    docs, blocks = _scan_rows(spark)
    got = scans.cases(docs, blocks, spark.createDataFrame([("RD2", 77)], "recv_no string, app_id long"))
    assert [tuple(r) for r in got["applications"].collect()] == [("RD650101", 1, "성명미상", 1965, "폐암", 2)]
    assert [(r.name, r.kcd, r.onset) for r in got["disabilities"].collect()] == [("폐암", "C34", "2020.02")]
    assert [(r.seq, r.rec_date, len(r.finding)) for r in got["records"].orderBy("seq").collect()] == [(0, "2020-02-31", 52), (1, None, 400)]
    assert {r.scan_id: r.app_id for r in got["links"].collect()} == {1: None, 2: 77}
    ag = {r.scan_id: r for r in scans.agendas(docs, blocks, spark.createDataFrame([("RD2호", 5)], "agenda_no string, agenda_id long")).collect()}
    assert (ag[1].injury, ag[1].exam_grade, ag[1].existed, ag[2].injury, ag[2].exam_grade, ag[2].agenda_id) == ("폐암", "장애진단서", False, "위암", "7급", 5)


def test_header(spark):
    docs = spark.createDataFrame([(1, "no: 12\nname\nB hospital\nexam FINDING"), (2, "")], "scan_id long, text string")
    got = scans.header(docs, {"reg_no": r"no: (\d+)"}, ("A hospital", "B hospital"), ((("exam", "FINDING"), "images"),)).orderBy("scan_id").collect()
    assert [tuple(r) for r in got] == [(1, "12", "B hospital", "images"), (2, None, None, "record")]


def test_assembly(spark):
    checks = "array<struct<label:string,required:boolean,checked:boolean>>"
    rows = spark.createDataFrame([(1, 0, "T", "c", [("l", True, False), ("m", True, True), ("n", False, False)]), (1, 1, "U", "", None), (2, 0, "T", "c", [])], f"case_id long, seq int, title string, content string, checks {checks}")
    assert {r.case_id: (r.ok, r.missing, r.empty) for r in assembly.gate(rows).collect()} == {1: (False, ["T: l"], ["U"]), 2: (True, [], [])}
    ends = spark.createDataFrame([(1, 0, "i", "", "yes")], "case_id long, seq int, name string, body string, final string")
    text = assembly.assemble(spark.createDataFrame([(1, "head")], "case_id long, head string"), rows, ends).first().text
    assert text == "head\n■ T\nc\n\n■ U\n(미작성)\n\n■ 4. 종합판단\n○ i\n결론: yes\n"
    items = [("a", "-", "7급", None, None), ("b", " 6급 ", "7급", None, ["p"]), ("c", None, None, None, None)]
    a = spark.createDataFrame([(1, "x", "5급", ["r"], items), (2, "x", "5급", ["r"], None), (3, "x", None, None, [])], f"agenda_id long, injury string, exam_grade string, review_items array<string>, items array<{assembly.ITEM}>")
    got = [tuple(r) for r in assembly.sheet(a).orderBy("agenda_id", "item").select("item", "proposed", "review", "total").collect()]
    assert got == [(0, "7급", "[a]\n○ r", "6급\n(종합판정 비대상)"), (1, "6급", "[b]\n○ p", None), (2, "—", "—", None), (0, "5급", "○ r", "5급"), (0, "—", "—", "—")]


def test_generators(spark):
    calls, waits = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise assembly.Transient("busy")
        return "ok"

    assert assembly.retrying(flaky, wait=waits.append)("p") == "ok" and waits == [1.0, 2.0]
    with pytest.raises(ValueError, match="b"):
        assembly.render("{a} {b}", a="1")
    assert assembly.refine("d", lambda t: "- bad" if t == "d" else "문제없음", lambda t, i: "e", 3) == ("e", 2, ["bad"], True)
    assert assembly.refine("d", lambda t: "- bad", lambda t, i: " ") == ("d", 1, ["bad"], False)
    got = assembly.refined(spark.createDataFrame([(1, "d"), (2, None)], "id long, draft string"), lambda t: "- x" if t else "", lambda t, i: "e").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "e", 1, ["x"], True), (2, "", 1, [], False)]
    a = spark.createDataFrame([("on", "d", ["d"], "see [n p.3]", 1, 4.0), ("on", "d", ["e"], f"x {clauses.NO_EVIDENCE}", 0, 2.0)], "mode string, expected string, sources array<string>, answer string, retries int, score double")
    assert tuple(assembly.answer_quality(a).first()) == ("on", 2, 0.5, 0.5, 0.5, 0.5, 3.0)


def test_lists_and_fallbacks(spark):
    rows = spark.createDataFrame([(1, "2"), (2, None), (3, "9"), (4, "1")], "id long, sub string")
    profiles = spark.createDataFrame([("1", "first"), ("2", "second")], "key string, name string")
    assert {r.id: r.name for r in records.with_profile(rows, "sub", profiles, "1").collect()} == {1: "second", 2: "first", 3: "first", 4: "first"}
    assert {r.name for r in records.with_profile(rows, "sub", profiles, "7").where("id = 3").collect()} == {None}
    items = spark.createDataFrame([(1, 2, None), (1, 1, "b"), (3, 1, "a")], "id long, at int, code string")
    assert {r.id: r.code for r in records.listed_items(rows.select("id"), items, "id", "at", "code").collect()} == {1: ["b", None], 2: [None], 3: ["a"], 4: [None]}
    sizes = spark.createDataFrame([([[1, 2], None, []],), (None,)], "x array<array<int>>").select(records.nested_size(F.col("x"))).collect()
    assert [r[0] for r in sizes] == [2, 0]


def test_list_filters(spark):
    rows = spark.createDataFrame([(1, "Kim", "a"), (21, "Lee", "b"), (3, None, "a")], "id long, name string, kind string")
    shown = lambda **k: sorted(r.id for r in records.matching_list(rows, **k).collect())
    assert shown() == shown(said=" ", equal={"kind": ""}) == [1, 3, 21]
    assert shown(said="1", within=("id", "name")) == [1, 21] and shown(said="kIM", within=("id", "name")) == [1] and shown(equal={"kind": "a"}) == [1, 3]
    assert shown(unanswered=(rows.where("id > 2"), "id")) == [1]


def test_what_is_held_is_left_out_in_one_exchange(spark):
    """Held files (by case, item, none or 0, kind and title) stay as they are; new and held ones go to their case together, without a join of theirs."""
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    cases, items = df([(1,), (2,)], "app_id long"), df([(1, 10, "knee"), (2, 20, None)], "app_id long, dis_id long, name string")
    found = df([(10, "h", "x", "2020-01-01", None, "f"), (10, "h", "x", "2020-01-01", "d", "f")], "dis_id long, hospital string, rec_type string, rec_date string, diagnosis string, finding string")
    none = lambda schema: df([], schema)
    officials, scans = none("app_id long, dis_id long, doc_kind string, doc_date string, issuer string, content string"), none("app_id long, doc_kind string, file_name string, orig_path string")
    held = df([(1, None, records.SERVICE, records.SERVICE_TITLE), (2, 20, records.FACTS, records.FACTS_TITLE), (9, 1, "x", "y"), (1, None, records.FACTS, records.FACTS_TITLE + "knee")], "app_id long, dis_id long, kind string, title string")
    got = records.register(cases, items, found, officials, scans, held)
    rows = sorted((r.app_id, r.dis_id or 0, r.kind, r.note) for r in got.collect())
    assert rows == sorted([(1, 0, records.APPLICATION, None), (2, 0, records.APPLICATION, None), (2, 0, records.SERVICE, None), (1, 10, records.FACTS, None), (1, 10, records.MEDICAL, "d")])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Join") == 1
