"""Reports, bundles and the ingest of blocks."""

import hashlib

import numpy as np

from marlstone.operators import extract, ingest

REPORT = "header\n2019-01-02 2019.1.5 2019-01-06\nEXAM: MRI knee\nFINDING:\n\nread: torn\nREADER Kim\n2020-02-02 2020-02-03\nno label here\n2021-03-01 2021-03-02\nFINDING normal"


def test_exam_reports(spark):
    got = extract.exam_reports(spark.createDataFrame([(1, REPORT), (2, "nothing"), (3, None)], "doc_id long, text string")).orderBy("segment").collect()
    assert [(r.segment, r.line, r.requested, r.examined, r.read, r.exam, r.finding, r.reader) for r in got] == [
        (1, 1, "2019-01-02", "2019.1.5", "2019-01-06", "MRI knee", "read: torn", "Kim"),
        (3, 9, "2021-03-01", "2021-03-02", None, None, "normal", None),
    ]


def test_bundles(spark):
    text = "cover\nDischarge  note\nline one\nDischarge note of a very long story\nRecord\nx"
    got = extract.bundles(spark.createDataFrame([(1, text), (2, "plain\ntext")], "doc_id long, text string"), ("Discharge note", "Record")).orderBy("doc_id", "line").collect()
    assert [(r.doc_id, r.title, r.line) for r in got] == [(1, "Discharge note", 1), (1, "Record", 4), (2, "other", 0)]
    assert got[2].excerpt == "plain\ntext"


def test_hash_vector():
    v = ingest.hash_vector("a", 64)
    one = hashlib.sha256(b"a").digest()
    want = np.frombuffer(one + hashlib.sha256(one).digest(), np.uint8) / 255 - 0.5
    assert np.allclose(v, want / np.linalg.norm(want), atol=1e-6) and abs(np.linalg.norm(v) - 1) < 1e-6


def test_load_is_idempotent(spark):
    schema = "doc_id long, seq int, type string, text string, page int, confidence double"
    blocks = spark.createDataFrame([(1, 0, "paragraph", "1O5", 1, 0.5), (1, 1, "table", "t" * 1300, 1, 1.0), (2, 0, "paragraph", "", 1, 1.0), (3, 0, "paragraph", "x" * 1201, 1, 1.0)], schema)
    none = spark.createDataFrame([], "sha256 string")
    got = ingest.load(blocks, none).collect()
    assert sorted((r.doc_id, r.seq, r.part, len(r.content)) for r in got) == [(1, 0, 0, 3), (1, 1, 0, 1300), (3, 0, 0, 1200), (3, 0, 1, 151)]
    assert {r.content for r in got if r.seq == 0 and r.doc_id == 1} == {"105"} and all(len(r.embedding) == 1024 for r in got)
    held = spark.createDataFrame([(r.sha256,) for r in got], "sha256 string")
    assert ingest.load(blocks, held).count() == 0


def test_exam_blocks(spark):
    one = "성명 홍길동\n2024-01-02 2024-01-03 10:20 2024-01-04\n임상진단\n Knee pain \n검사명\nMRI knee\n\n[Finding]\ntear\nof meniscus\n[ Conclusion ]\nc1\nRecommendation\nr1\n판독의 : 김철수 (12345)"
    two = "2024-02-02 2024-02-03\n임상진단\nback\n검사\nback\nL-spine AP/Lat\nFinding\nnormal\n이영 희(54321)\n2024-03-01 2024-03-02\nnothing here"
    pages = spark.createDataFrame([(1, 1, one), (1, 2, two), (2, 1, "no dates"), (3, 1, None), (4, 1, "2024-01-01 2024-01-02\nFinding\nx\n판독 (99999)")], "doc_id long, page int, text string")
    got = [tuple(r) for r in extract.exam_blocks(pages).orderBy("doc_id", "place").collect()]
    assert got == [
        (1, 0, 1, "2024-01-02", "2024-01-03 10:20", "2024-01-04", "Knee pain", "MRI knee", "tear of meniscus", "c1", "r1", "김철수"),
        (1, 1, 2, "2024-02-02", "2024-02-03", None, "back 검사 back L-spine AP/Lat Finding normal 이영 희(54321)", "L-spine AP/Lat", "normal 이영 희(54321)", None, None, "이영희(54321)"),
        (4, 0, 1, "2024-01-01", "2024-01-02", None, None, None, "x 판독 (99999)", None, None, "판독(99999)"),
    ]
