"""Whole bundles, spreadsheets and checklists."""

import io
import unicodedata
import zipfile

from marlstone.operators import intake
from marlstone.sources import sheets, texts

BUNDLE = "표지 중앙보훈병원\n성명\n주민번호\n홍 길 동\n480603 - 1108611\n진 단서\n질병명\n\n1. 폐암 초기\nC34.1 2019년 3월 5일 9999-1-1\n신체검사 의사 소견서\n신검과목\n내과\n신규 재확인 7급 1항 2104호\n검진 소견\n폐 기능 저하 소견임\n끝"


def _files(spark):
    name = unicodedata.normalize("NFD", "제출서류(故김철수).txt")
    return spark.createDataFrame([("a.txt", BUNDLE), (name, "no title\n\nhere"), ("이순신_1.txt", None)], "file_name string, text string")


def test_bundles_to_scans(spark):
    files = _files(spark)
    blocks = intake.bundle_blocks(files)
    got = [r for r in blocks.orderBy("seq").collect() if r.scan_id == "a.txt"]
    assert [(r.title, r.line) for r in got] == [("진단서", 6), ("신체검사 의사 소견서", 11)]
    assert got[0].fields.asDict() == {"date": "2019-03-05", "disease": "폐암 초기", "grade": None, "exam_kind": None, "exam_dept": None, "opinion": None, "kcd": "C34.1"}
    assert got[1].fields.asDict() == {"date": None, "disease": None, "grade": "7급 1항 2104호", "exam_kind": "재확인", "exam_dept": "내과", "opinion": "폐 기능 저하 소견임", "kcd": None}
    docs = {unicodedata.normalize("NFC", r.scan_id): r for r in intake.bundle_scans(files, blocks).collect()}
    a, b, c = docs["a.txt"], docs["제출서류(故김철수).txt"], docs["이순신_1.txt"]
    assert (a.reg_no, a.person, a.hospital, a.kind, a.pages) == ("480603", "홍길동", "중앙보훈병원", "의무기록 묶음(폐암 초기)", 2)
    assert "480603-1******" in a.text and "1108611" not in a.text
    assert (b.person, b.kind, b.pages, c.person, c.kind, c.text) == ("김철수", "의무기록", 1, "이순신", "의무기록", "")


def test_read_bundles(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"a\xff\nb")
    assert [tuple(r) for r in intake.read_bundles(spark, str(tmp_path)).collect()] == [("x.txt", "a�\nb")]


def _xlsx(rows, active=1):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><bookViews><workbookView activeTab="{active}"/></bookViews><sheets><sheet name="a" r:id="r1"/><sheet name="b" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t> one </t></si><si><r><t>t</t></r><r><t>wo</t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def test_sheets(spark, tmp_path):
    rows = '<row r="1"><c r="A1"><v>1</v></c></row><row r="3"><c r="B3" t="s"><v>0</v></c><c r="D3" t="s"><v>1</v></c></row><row><c t="b"><v>1</v></c><c t="inlineStr"><is><t>x</t></is></c></row>'
    assert sheets.sheet_rows(_xlsx(rows)) == [["1", "", "", ""], ["", "", "", ""], ["", "one", "", "two"], ["True", "x", "", ""]]
    assert sheets.sheet_rows(_xlsx(rows, 0)) == []
    (tmp_path / "a.xlsx").write_bytes(_xlsx(rows))
    (tmp_path / "b.xlsx").write_bytes(_xlsx(rows, 0))
    got = sheets.read_sheets(spark, str(tmp_path), skip=2)
    assert [(r.row, r.cells[1]) for r in got.orderBy("row").collect()] == [(3, "one"), (4, "x")]
    table = sheets.code_table(got, {"code": 1, "name": 3}, flags={"in_use": (3, "two")})
    assert [tuple(r) for r in table.orderBy("code").collect()] == [("one", "two", True), ("x", "", False)]


def test_order_rules(spark):
    cells = ["", "1.0", "type", "content", "", "i1", "r1", "", "r2", "i3", "", "", "", "사용"]
    rows = spark.createDataFrame([("p", 4, cells), ("p", 5, ["", ""])], "path string, row int, cells array<string>")
    got = [(r.rule_no, r.pair_order, r.judge_item, r.result, r.in_use) for r in sheets.order_rules(rows).orderBy("pair_order").collect()]
    assert got == [("1.0", 1, "i1", "r1", True), ("1.0", 3, "i3", "", True)]


def test_checklists(spark):
    lines = ["검토서 체크리스트", "old", "검토서 체크리스트", "- stray", "Ⅰ 1", "○ ×", "요건을 갖추", "었는지", "- first", "∙ second", "다음 항목 여부", "last one", "x" * 100, "패스트 트랙", "gone"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "none"), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.item, r.subs) for r in texts.checklists(docs).orderBy("seq").collect()]
    assert got == [(1, "요건을 갖추 었는지", ["first", "second"]), (1, "다음 항목 여부", []), (1, "last one " + "x" * 100, [])]
