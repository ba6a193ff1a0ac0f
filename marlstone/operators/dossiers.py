"""Fact sheets, dossiers and decisions: one text a row, from the row's own structs and arrays; nothing is shuffled.

Null arrays count as empty. A missing value shows as the parameter `absent`, or as a dash where the form has one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.replies import wrapped

LINE = "struct<level:int,text:string,wrap:boolean>"
RULE = "─" * 60
SERVICE = "struct<enlist:string,discharge:string,branch:string,career:string,leave_note:string,overtime:string>"
MEDICAL = "struct<date:string,period:string,kind:string,hospital:string,chief:string,diagnosis:string,imaging:string,finding:string,surgery:string,chronic:string>"
OFFICIAL = "struct<item:long,kind:string,date:string,issuer:string,content:string>"
SIMILAR = "struct<case_id:string,decision:string,pick:string,summary:string,codes:array<string>>"
ITEM = f"struct<name:string,side:string,kcd:string,onset:string,fact_date:string,fact_place:string,fact_dx:string,medical:array<{MEDICAL}>,criteria:array<struct<content:string,source:string>>,body:string,final:string,status:string,merit:string,reward:string>"


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def _or(c: Column, absent: str = "—") -> Column:
    return F.coalesce(_some(c), F.lit(absent))


def _said(*parts: Column | str) -> Column:
    """The parts joined; null if one is null, so that an absent line falls away."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _all(items: Column, kind: str) -> Column:
    return F.coalesce(items, F.array().cast(f"array<{kind}>"))


def _listed(heading: str, lines: Column, always: bool = False) -> Column:
    """A heading and its lines; no heading without lines unless always."""
    lines = F.array_compact(lines)
    whole = F.concat(F.array(F.lit(heading)), lines)
    return whole if always else F.when(F.size(lines) > 0, whole).otherwise(F.array().cast("array<string>"))


def fact_sheet(absent: str = "없음") -> Column:
    """The text of review_type, review_content, target, codes (code, disease), orders (clause, result, standard), passages (clause,
    content, source, page), team, specialty, criteria (content, source), similar (case_id, decision, shared). At most 200
    characters of a passage and 250 of a criterion are cited, as the form has it."""
    codes = F.array_join(F.transform(_all(F.col("codes"), "struct<code:string,disease:string>"), lambda k: _said(k["code"], " ", F.coalesce(k["disease"], F.lit("")))), ", ")
    orders = F.transform(_all(F.col("orders"), "struct<clause:string,result:string,standard:string>"), lambda o: _said("  - ", _or(o["clause"], absent), " -> ", _or(o["result"], absent), " (표준문안 ", _or(o["standard"], absent), ")"))
    cited = F.transform(_all(F.col("passages"), "struct<clause:string,content:string,source:string,page:int>"), lambda p: _said("  - [", p["clause"], "] ", F.substring(p["content"], 1, 200), " (", p["source"], " p.", p["page"], ")"))
    criteria = F.transform(_all(F.col("criteria"), "struct<content:string,source:string>"), lambda c: _said("  - ", F.substring(c["content"], 1, 250), " (", c["source"], ")"))
    similar = F.transform(_all(F.col("similar"), "struct<case_id:string,decision:string,shared:int>"), lambda s: _said("  - 사례 ", s["case_id"], ": ", _or(s["decision"], absent), " (일치 KCD ", s["shared"], "개)"))
    head = F.array(
        _said("심의유형: ", _or(F.col("review_type"), absent), " / 심의내용: ", _or(F.col("review_content"), absent), " / 판단대상: ", _or(F.col("target"), "(단일)")),
        _said("상이처(KCD): ", _or(codes, absent)),
    )
    team = F.array(_said("담당 분과: ", _or(F.col("team"), absent), " (", _or(F.col("specialty"), absent), ")"))
    return F.array_join(F.concat(head, _listed("적용 조문(주문):", orders, True), _listed("조문 원문 근거:", cited, True), team, _listed("분과 심사기준 발췌 (분과 매뉴얼):", criteria), _listed("동일 상이처 과거 판정:", similar, True)), "\n")


def record(m: Column, absent: str = "—") -> Column:
    """A medical record (MEDICAL) as a line: what was found, operated, and whether the finding is an old one."""
    image, found = _some(m["imaging"]), _some(m["finding"])
    seen = F.coalesce(_said(" (", image, ": ", F.coalesce(found, F.lit("")), ")"), _said(" — ", found), F.lit(""))
    age = F.when(m["chronic"] == "Y", " / 진구성 소견").when(_some(m["chronic"]).isNotNull(), " / 급성 소견").otherwise("")
    return _said(_or(m["date"], absent), " [", _or(m["period"], absent), "/", _or(m["kind"], absent), "] ", _or(m["hospital"], absent), ": ", F.coalesce(_some(m["diagnosis"]), m["chief"], F.lit("")), seen, F.coalesce(_said(" / 수술: ", _some(m["surgery"])), F.lit("")), age)


def dossier(absent: str = "None") -> Column:
    """The material on one item of a case, for a generator. Columns: item, applicant, duty, round, apply_kind, story, history (seq, date,
    kind, summary, result), aftermath, name, side, kcd, onset, fact_date, fact_place, fact_dx, service (SERVICE), similar (SIMILAR;
    the first three), precedents (texts; the first two), official (OFFICIAL; of the item or of none), medical (MEDICAL, in order)."""
    v = lambda c: _or(F.col(c).cast("string"), absent)
    s = lambda k: _some(F.col("service")[k])
    head = F.array(
        _said("신청인: ", v("applicant"), " (", v("duty"), ", 심의차수 ", v("round"), "차)"),
        _said("신청구분: ", _or(F.col("apply_kind"), "신규"), " (신규/재신청/이의신청/재심의 중)"),
        _said("신청경위: ", v("story")),
    )
    history = F.transform(_all(F.col("history"), "struct<seq:int,date:string,kind:string,summary:string,result:string>"), lambda h: _said("재신청 이력", h["seq"], ": ", _or(h["date"], absent), " ", _or(h["kind"], absent), " — ", _or(h["summary"], absent), " → ", _or(h["result"], absent)))
    facts = F.array(
        _said("현재 후유증: ", _or(F.col("aftermath"), "기재 없음")),
        _said("신청상이: ", v("name"), " (", _or(F.col("side"), "부위 표기 없음"), ", KCD ", v("kcd"), ", 발병 ", v("onset"), ")"),
        _said("요건사실확인서: 상이연월일 ", v("fact_date"), " / 장소 ", v("fact_place"), " / 최초부상명 ", v("fact_dx")),
        _said("병적: 입대 ", F.coalesce(s("enlist"), F.lit(absent)), " / 전역 ", F.coalesce(s("discharge"), F.lit("복무중")), " / ", F.coalesce(s("branch"), F.lit(absent)), " / ", F.coalesce(s("career"), F.lit(absent))),
        _said("휴가내역: ", s("leave_note")),
        _said("초과근무·특별업무: ", s("overtime")),
    )

    def case(x: Column) -> Column:
        plain = _said("과거사례 ", _or(x["case_id"], absent), " (KCD ", F.array_join(_all(x["codes"], "string"), ", "), ")")
        return _said("  - [", _or(x["decision"], "판정미상"), "]", F.when(x["pick"] == "pin", "★담당자 추가").otherwise(""), " ", F.coalesce(_some(F.substring(F.trim(x["summary"]), 1, 150)), plain))

    similar = F.transform(F.slice(_all(F.col("similar"), SIMILAR), 1, 3), case)
    precedents = F.transform(F.slice(_all(F.col("precedents"), "string"), 1, 2), lambda p: _said("  - ", F.substring(p, 1, 200)))
    mine = F.filter(_all(F.col("official"), OFFICIAL), lambda o: o["item"].isNull() | (o["item"] == F.col("item")))
    official = F.transform(mine, lambda o: _said("  - [", _or(o["kind"], absent), "] ", _or(o["date"], absent), " ", _or(o["issuer"], absent), ": ", F.substring(F.coalesce(o["content"], F.lit("")), 1, 220)))
    medical = F.transform(_all(F.col("medical"), MEDICAL), lambda m: _said("  - ", record(m, absent)))
    return F.array_join(F.concat(
        head, F.array_compact(history), F.array_compact(facts), _listed("과거 유사사례 (담당자 선별 반영 — 인정/비인정 구분 참고):", similar), _listed("관련 판례 발췌 (논리 전개 참고):", precedents),
        _listed("공적서류(발병경위서·군 심사 결정·사실조회 등):", official), _listed("의무기록(시간순):", medical, True),
    ), "\n")


# Decisions ----------------------------------------------------------------------------------------


def line(level: int, *parts: Column | str, wrap: bool = False) -> Column:
    return F.struct(F.lit(level).alias("level"), _said(*parts).alias("text"), F.lit(wrap).alias("wrap")).cast(LINE)


def rendered(lines: Column, width: int = 78, step: int = 4) -> Column:
    """Lines (array of LINE) as a text: each level is `step` spaces deeper; a wrapped line hangs one level deeper, three at most. Lines without text go."""
    pad = lambda n: F.repeat(F.lit(" " * step), n)
    one = lambda x: F.when(x["wrap"], wrapped(x["text"], width, pad(x["level"]), pad(F.least(x["level"] + 1, F.lit(3))))).otherwise(F.array(F.concat(pad(x["level"]), x["text"])))
    return F.array_join(F.flatten(F.transform(F.filter(lines, lambda x: x["text"].isNotNull()), one)), "\n")


def decision(premises: tuple[str, ...] = (), closing: str = "", names: Callable[[], tuple[Column, Column]] | None = None) -> Column:
    """The decision of a case in four chapters. Columns: recv_no, review_content, round, assignee, track, assigned, birth, applicant, team,
    story, aftermath, service (SERVICE), items (ITEM), official (OFFICIAL), laws (clause, passage). It is a draft until every
    item's status is 확정; only then the fourth chapter concludes. premises: sentences of the third chapter. names: the two
    classes that the conclusion names, as Columns of the row."""
    items, official, c = _all(F.col("items"), ITEM), _all(F.col("official"), OFFICIAL), F.col
    s = lambda k: _some(c("service")[k])
    each = lambda xs, f: F.flatten(F.transform(xs, lambda x: F.array(*f(x))))
    when = lambda cond, lines: F.when(cond, lines).otherwise(F.array().cast(f"array<{LINE}>"))
    confirmed = F.forall(items, lambda d: F.coalesce(d["status"], F.lit("")) == "확정")
    some_yes = F.exists(items, lambda d: (F.coalesce(d["merit"], F.lit("")) == "해당") | (F.coalesce(d["reward"], F.lit("")) == "해당"))
    verdict = F.when(~confirmed, "검토중").when(some_yes, "해당(일부 포함)").otherwise("비해당")
    blank = line(0, "")
    top = F.array(
        line(0, "심 의 의 결 서", F.when(confirmed, "").otherwise("  (초안)")),
        line(0, "담당자 ", _or(F.coalesce(_some(c("assignee")), c("team"))), "  │  신청인 ", _or(c("applicant")), "  │  생년 ", _or(c("birth")), "  │  심사구분 ", _or(c("track"), "일반"), "  │  배정일 ", _or(c("assigned")), "  │  검토의견 ", verdict),
        line(0, "접수번호 ", _or(c("recv_no")), "  │  ", _or(c("review_content")), " ", _or(c("round").cast("string")), "차  │  담당 ", _or(c("team"))),
        line(0, RULE), blank, line(0, "1. 신청사항"), line(1, "가. 신청경위"), line(2, _or(c("story")), wrap=True), line(2, "③ 현재시점 후유증·합병증"), line(3, _or(c("aftermath")), wrap=True), line(1, "나. 신청상이"),
    )
    wounds = each(items, lambda d: [line(2, "· ", _or(d["name"]), "  (", _or(d["side"]), " · KCD ", _or(d["kcd"]), " · 발병 ", _or(d["onset"]), ")")])
    service = F.array(
        blank, line(0, "2. 관련자료"), line(1, "가. 병적관련자료"), line(2, "입대 ", F.coalesce(s("enlist"), F.lit("—")), " / 전역 ", F.coalesce(s("discharge"), F.lit("복무중")), " / ", F.coalesce(s("branch"), F.lit(""))),
        line(2, "근무경력: ", s("career"), wrap=True), line(2, "휴가내역: ", s("leave_note"), wrap=True), line(2, "초과근무·특별업무: ", s("overtime"), wrap=True),
    )
    again = lambda d, want: F.filter(_all(d["medical"], MEDICAL), lambda m: (F.coalesce(m["kind"], F.lit("")) == "재판독") == want)
    papers = F.flatten(F.transform(items, lambda d: F.concat(
        F.array(line(1, "나. 요건사실확인서 — ", _or(d["name"])), line(2, "상이연월일 ", _or(d["fact_date"]), " / 상이장소 ", _or(d["fact_place"])), line(2, "최초부상명 ", _or(d["fact_dx"])), line(1, "다. 의무기록 — ", _or(d["name"]), " (진료 시간순)")),
        each(again(d, False), lambda m: [line(2, "- ", record(m, "-"), wrap=True)]),
    )))
    asked = lambda want: F.filter(official, lambda o: (F.coalesce(o["kind"], F.lit("")) == "사실조회 회신") == want)
    others = F.flatten(F.transform(asked(False), lambda o, i: F.array(line(2, i + 1, ") ", _or(o["kind"]), " (", _or(o["date"]), ". ", _or(o["issuer"]), ")"), line(3, _some(o["content"]), wrap=True))))
    rereads = F.flatten(F.transform(items, lambda d: each(again(d, True), lambda m: [line(2, "- ", _or(m["date"]), ". [", _or(d["name"]), "] ", F.coalesce(m["imaging"], F.lit("")), ": ", F.coalesce(m["finding"], F.lit("")), " — ", F.when(m["chronic"] == "Y", "진구성").otherwise("최근 외상"), wrap=True)])))
    facts = each(asked(True), lambda o: [line(2, "- (", _or(o["date"]), ". ", _or(o["issuer"]), ") ", F.coalesce(o["content"], F.lit("")), wrap=True)])
    under = lambda heading, lines: when(F.size(lines) > 0, F.concat(F.array(line(1, heading)), lines))
    squeezed = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    laws = F.flatten(F.transform(_all(c("laws"), "struct<clause:string,passage:string>"), lambda x, i: F.array(line(2, i + 1, ") ", _or(x["clause"])), line(3, F.substring(squeezed(_some(x["passage"])), 1, 500), wrap=True))))
    criteria = F.flatten(F.transform(items, lambda d: each(F.slice(_all(d["criteria"], "struct<content:string,source:string>"), 1, 1), lambda x: [line(2, "[", _or(d["name"]), " 관련 매뉴얼 발췌] ", F.substring(squeezed(x["content"]), 1, 280), " (", _or(x["source"]), ")", wrap=True)])))
    third = F.concat(F.array(blank, line(0, "3. 관련법령 및 판단의 전제, 참고자료"), line(1, "가. 관련법령")), laws, F.array(line(1, "나. 본 건 판단의 전제"), *[line(2, p, wrap=True) for p in premises], line(1, "다. 의학정보·분과 판단기준")), criteria)

    def judged(d: Column) -> Column:
        written = each(F.split(d["body"], "\n"), lambda p: [line(3, F.trim(p), wrap=False).withField("wrap", F.trim(p) != "").withField("level", F.when(F.trim(p) != "", 3).otherwise(0))])
        done = F.concat(written, F.array(line(2, "⇒ 결론: ", F.coalesce(d["final"], F.lit("")), "  (", F.coalesce(d["status"], F.lit("")), ")")))
        return F.concat(F.array(line(2, "[ ", _or(d["name"]), " ]")), F.when(_some(d["body"]).isNotNull(), done).otherwise(F.array(line(3, "(판단내용 미작성)"))), F.array(blank))

    fourth = F.concat(F.array(blank, line(0, "4. 종합 판단"), line(1, "가. 신청경위 요약"), line(2, _or(c("story")), wrap=True), line(1, "나·다. 판단내용 및 결론")), F.flatten(F.transform(items, judged)))
    merit, reward = names() if names else (F.lit("국가유공자"), F.lit("보훈보상대상자"))
    none = F.array(line(2, "신청상이 ", F.array_join(F.transform(items, lambda d: _said("'", _or(d["name"]), "'")), ", "), "에 대하여 ", merit, " 및 ", reward, " 요건에 각각 해당하지 않는 것으로 검토함.", wrap=True))
    yes = each(items, lambda d: [line(2, "신청상이 '", _or(d["name"]), "'은(는) ", merit, " 요건에 ", _or(d["merit"]), ", ", reward, " 요건에 ", _or(d["reward"]), "하는 것으로 검토함.", wrap=True)])
    concluded = when(confirmed, F.concat(F.array(line(1, "다. 결론")), F.when(some_yes, yes).otherwise(none), F.array(blank)))
    end = F.array(line(0, RULE), line(0, F.lit(closing) if closing else F.lit(None), wrap=True))
    return rendered(F.concat(
        top, wounds, service, papers, under("라. 발병경위서·공무상병인증서 등 공적서류", others), under("마. 군병원 영상자료에 대한 위원회 재판독 결과", rereads), under("바. 보훈심사위원회에서 확인한 자료 (사실조회)", facts),
        third, fourth, concluded, end,
    ))
