"""Fact sheets, dossiers, decisions, and generated data."""

import datetime

from pyspark.sql import functions as F

from marlstone.operators import dossiers, generate

MEDICAL = ("2020-01-02", "복무중", "외래", "병원", "통증", None, "MRI", "파열", "재건", "Y")
FACTS = "review_type string, review_content string, target string, codes array<struct<code:string,disease:string>>, orders array<struct<clause:string,result:string,standard:string>>, passages array<struct<clause:string,content:string,source:string,page:int>>, team string, specialty string, criteria array<struct<content:string,source:string>>, similar array<struct<case_id:string,decision:string,shared:int>>"
CASE = f"item long, applicant string, duty string, round int, apply_kind string, story string, history array<struct<seq:int,date:string,kind:string,summary:string,result:string>>, aftermath string, name string, side string, kcd string, onset string, fact_date string, fact_place string, fact_dx string, service {dossiers.SERVICE}, similar array<{dossiers.SIMILAR}>, precedents array<string>, official array<{dossiers.OFFICIAL}>, medical array<{dossiers.MEDICAL}>"
DECIDED = f"recv_no string, review_content string, round int, assignee string, track string, assigned string, birth string, applicant string, team string, story string, aftermath string, service {dossiers.SERVICE}, items array<{dossiers.ITEM}>, official array<{dossiers.OFFICIAL}>, laws array<struct<clause:string,passage:string>>"


def test_fact_sheet(spark):
    rows = [("t", "c", "", [("S83", "무릎"), ("M51", None)], [("4-1", "yes", None)], [("4-1", "p" * 300, "law", 3)], "one", "legal", [], [("7", "해당", 2)]), (None,) * 10]
    a, b = (r[0].split("\n") for r in spark.createDataFrame(rows, FACTS).select(dossiers.fact_sheet()).collect())
    assert a == ["심의유형: t / 심의내용: c / 판단대상: (단일)", "상이처(KCD): S83 무릎, M51 ", "적용 조문(주문):", "  - 4-1 -> yes (표준문안 없음)", "조문 원문 근거:", f"  - [4-1] {'p' * 200} (law p.3)", "담당 분과: one (legal)", "동일 상이처 과거 판정:", "  - 사례 7: 해당 (일치 KCD 2개)"]
    assert b[:2] == ["심의유형: 없음 / 심의내용: 없음 / 판단대상: (단일)", "상이처(KCD): 없음"] and len(b) == 6


def test_dossier(spark):
    row = (1, "kim", "병사", 2, None, "story", [(1, "2019", "신규", "s", "비해당")], None, "무릎", None, "S83", "2020.01", None, "p", "d", ("2019", None, "육군", "c", "leave", None), [("7", "해당", "pin", " ", ["S83", "M51"]), ("8", None, None, "x" * 200, None)], ["a", "b", "c"], [(None, "회신", "d1", "i", "all"), (1, "경위서", "d2", "i", "mine"), (2, "경위서", "d3", "i", "other")], [MEDICAL])
    empty = (None,) * 20
    a, b = (r[0].split("\n") for r in spark.createDataFrame([row, empty], CASE).select(dossiers.dossier()).collect())
    assert a[1:5] == ["신청구분: 신규 (신규/재신청/이의신청/재심의 중)", "신청경위: story", "재신청 이력1: 2019 신규 — s → 비해당", "현재 후유증: 기재 없음"]
    assert a[7:9] == ["병적: 입대 2019 / 전역 복무중 / 육군 / c", "휴가내역: leave"]
    assert a[10:12] == ["  - [해당]★담당자 추가 과거사례 7 (KCD S83, M51)", "  - [판정미상] " + "x" * 150]
    assert a[12:] == ["관련 판례 발췌 (논리 전개 참고):", "  - a", "  - b", "공적서류(발병경위서·군 심사 결정·사실조회 등):", "  - [회신] d1 i: all", "  - [경위서] d2 i: mine", "의무기록(시간순):", "  - 2020-01-02 [복무중/외래] 병원: 통증 (MRI: 파열) / 수술: 재건 / 진구성 소견"]
    assert len(b) == 8 and b[-1] == "의무기록(시간순):"


def test_decision(spark):
    def item(name, body, status, merit):
        return (name, None, "S83", "2020.01", None, None, None, [MEDICAL, (*MEDICAL[:2], "재판독", *MEDICAL[3:])], [("long  text", "manual")], body, "final", status, merit, "비해당")

    case = ("r1", "content", 1, None, None, None, None, "kim", "team", "word " * 30, None, None)
    rows = [(*case, [item("무릎", "one\n\ntwo", "확정", "해당")], [(None, "사실조회 회신", None, None, "reply"), (None, "경위서", "d", "i", "text")], [("4-1", "law  text")]), (*case, [item("귀", None, None, None)], None, None), (*case, [item("귀", "b", "확정", "비해당")], [], []), (None,) * 15]
    frame = spark.createDataFrame(rows, DECIDED).select(dossiers.decision(("premise",), "closing"))
    a, b, c, d = (r[0].split("\n") for r in frame.collect())
    assert a[0] == "심 의 의 결 서" and "검토의견 해당(일부 포함)" in a[1] and b[0].endswith("(초안)") and "검토중" in b[1] and "비해당" in c[1]
    assert a[7].startswith("        word") and a[8].startswith("            word") and len(a[8]) <= 90
    for line in ("    라. 발병경위서·공무상병인증서 등 공적서류", "        1) 경위서 (d. i)", "            text", "        - (—. —) reply", "        - 2020-01-02. [무릎] MRI: 파열 — 진구성", "        1) 4-1", "            law text", "        premise", "        [무릎 관련 매뉴얼 발췌] long text (manual)", "            two", "        ⇒ 결론: final  (확정)", "closing"):
        assert line in a, line
    assert "        신청상이 '무릎'은(는) 국가유공자 요건에 해당, 보훈보상대상자 요건에 비해당하는 것으로 검토함." in a
    assert "            (판단내용 미작성)" in b and not any("다. 결론" == x.strip() for x in b) and any("각각 해당하지 않는" in x for x in c) and "4. 종합 판단" in d


def test_noise(spark):
    text = "10.5 abc\n" * 400
    rows = spark.createDataFrame([(1, text), (2, text), (3, None)], "k long, t string")
    noised = [[r[0] for r in rows.repartition(n).orderBy("k").select(generate.noisy(F.col("t"), generate.RATES["high"], F.col("k"))).collect()] for n in (1, 3)]
    assert noised[0] == noised[1] and noised[0][0] != noised[0][1] and noised[0][2] is None
    assert rows.where("k = 1").select(generate.noisy(F.col("t"), 0.0, F.col("k"))).first()[0] == text
    assert 0 < sum(noised[0][0].count(c) for c in generate.SPECKS) < 0.06 * len(text)


def test_variants(spark):
    pool = spark.createDataFrame([("20", "2024-11-05", "좌측 우측 무릎", "다리", "7급")], "recv_no string, meeting_date string, disease_name string, body_part string, grade string")
    got = [tuple(r)[:3] for r in generate.grade_variants(pool).orderBy("recv_no").collect()]
    assert got == [("131", datetime.date(2024, 12, 2), "우측 좌측 무릎"), ("20", datetime.date(2024, 11, 5), "좌측 우측 무릎"), ("242", datetime.date(2024, 12, 1), "좌측 우측 무릎")]
    past = spark.createDataFrame([("t", "c", ["S83"], "해당", "s"), ("t", "c", None, "비해당", "u")], "review_type string, review_content string, kcd_codes array<string>, decision string, summary string")
    got = generate.past_variants(past, ("y1", "y2"), ("n1",)).collect()
    assert len(got) == 12 and {r.summary for r in got if r.decision == "해당"} <= {"s", "S83 계열 - y1", "S83 계열 - y2"} and sum(r.summary == " 계열 - n1" for r in got) == 5
