"""Each query equals its SQL; golden cases of expressions, guard, blocks, state and streaming."""

import json
import random

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from marlstone import queries as core
from marlstone import queries_review, queries_search  # noqa: F401 (add their queries to those of core)
from marlstone.functions import text as tx
from marlstone.operators import nearest, search, state
from marlstone.plans import guard
from marlstone.sources import blocks
from marlstone.streaming import windows

AT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_equals_sql(spark, name):
    assert oracle.differences(spark, AT, name, core.QUERIES, core.ORACLES) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "score", "r"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("length", [0, 1, 150, 151, 1200, 1201, 2250, 2251, 5000])
def test_chunks(spark, length):
    text = "".join(random.Random(length).choice("abc ") for _ in range(length))
    want, at = [], 0
    while at < length:
        want.append(text[at : at + 1200])
        if at + 1200 >= length:
            break
        at += 1050
    got = spark.createDataFrame([(text,)], "text string").select(tx.chunks(F.col("text"))).first()[0]
    assert got == want
    assert not want or want[0] + "".join(c[150:] for c in want[1:]) == text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(("text", "want"), [("2019. 3. 4", "2019-03-04"), ("2020.05", "2020-05-15"), ("2021.02.31", None), ("none", None), (None, None), ("2019-12-01 x", "2019-12-01"), ("No 12, on 2019년 3월 4일", "2019-03-04"), ("7 of 2020-5", "2020-05-15"), ("1996. 1", None), ("0000.01.02", None)])
def test_dates(spark, text, want):
    got = one(spark, text, tx.tolerant_date)
    assert (got and str(got)) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("id 900101-1234567.", "id ******-*******."), ("id 900101 1234567", "id ******-*******"), ("9001011234567", "9001011234567"), ("번900101-1234567", "번900101-1234567"), ("900101-9234567", "******-*******"),
        ("call 010-1234-5678 now", "call 01*-****-**** now"), ("010 1234 5678", "01*-****-****"), ("01112345678,", "01*-****-****,"), ("02-123-4567", "0**-****-****"), ("064-123-4567", "0**-****-****"),
        ("a.b@c-d.org,", "****@****,"), ("홍길동@회사.한국", "****@****"), ("010-1234-5678 900101-1234567", "01*-****-**** ******-*******"), (None, None),
    ],
)
def test_masks(spark, text, want):
    assert one(spark, text, tx.mask) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1O5 x", "105 x"), ("2l3\n4", "213 4"), ("Solo", "Solo"), ("9S", "95"), ("OlB5", "Ol85"), ("5OlBSx", "50185x"), ("3ㅡO", "3-O"), ("Oㅡ1", "O-1"), ("lO5", "l05"), ("4ㅡ1ㅡ6", "4-1-6"),
        ("·설멍|  x", "설명 x"), ("1힝 싱흔", "1항 심훈"), ("²O", "²0"), ("1o5", "1o5"), ("", ""), (None, None),
    ],
)
def test_correction(spark, text, want):
    assert one(spark, text, blocks.correct) == want


@pytest.mark.parametrize(("grade", "want"), [("grade 3", 3), ("6-1-0101", 6), ("below", 99), ("", 99), (None, 99)])
def test_severity(spark, grade, want):
    assert one(spark, grade, core.severity) == want


ALLOWED = ["SELECT k, count(*) FROM stats_a GROUP BY k", "SELECT * FROM stats_a ORDER BY k LIMIT 3", "SELECT k FROM stats_a GROUP BY k HAVING count(*) > 1", "SELECT DISTINCT a.k FROM stats_a a JOIN stats_b b ON a.k = b.k"]
REFUSED = [
    "SELECT 1", "SELECT * FROM other", "SELECT * FROM stats_a; SELECT 1", "INSERT INTO stats_a SELECT * FROM stats_a", "DROP TABLE stats_a", "SET x = 1", "SELECT * FROM range(10)",
    "WITH c AS (SELECT * FROM stats_a) SELECT * FROM c", "SELECT k FROM stats_a UNION SELECT k FROM stats_b", "SELECT reflect('java.lang.System', 'exit', 1) FROM stats_a",
    "SELECT k FROM stats_a WHERE k IN (SELECT k FROM secret)", "SELECT * FROM parquet.`/etc`", "SELECT * FROM x.stats_a", "SELECT k FROM stats_a, LATERAL (SELECT * FROM secret)", "not sql",
]


@pytest.mark.parametrize("sql", ALLOWED)
def test_guard_allows(spark, sql):
    guard.check(spark, sql, {"stats_a", "stats_b"})


@pytest.mark.parametrize("sql", REFUSED)
def test_guard_refuses(spark, sql):
    with pytest.raises(guard.Refused):
        guard.check(spark, sql, {"stats_a", "stats_b"})


def test_guard_runs_over_views_only(spark):
    df = spark.range(500).withColumn("k", F.col("id") % 3)
    assert guard.run(spark, "SELECT k, id FROM stats_a", {"stats_a": df}).count() == 200
    one, two = (guard.run(spark, "SELECT k, id FROM stats_a", {"stats_a": df.where(f"k = {k}")}) for k in (1, 2))  # of one name, side by side
    assert {r.k for r in one.collect()} == {1} and {r.k for r in two.collect()} == {2}


def test_blocks(spark, tmp_path):
    data = {"doc_id": "d", "blocks": [{"type": "paragraph", "text": "1O5", "page": 2, "confidence": 0.5}, {"text": "1O5"}, {"type": "figure", "text": "1O5", "confidence": 0.1}, {"type": "table", "text": "1O5", "confidence": 0.85}]}
    (tmp_path / "a.json").write_text(json.dumps(data))
    got = blocks.verified(blocks.read_json(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r.type, r.text, r.page, r.confidence, r.raw) for r in got] == [("paragraph", "105", 2, 0.5, "1O5"), ("other", "1O5", 1, 1.0, None), ("figure", "1O5", 1, 0.1, None), ("table", "1O5", 1, 0.85, None)]
    text = spark.createDataFrame([(1, " a \n\n\n\nb\nc\n \n")], "doc_id long, text string")
    assert [(r.text, r.page) for r in blocks.from_text(text).orderBy("seq").collect()] == [("a", 1), ("b\nc", 2)]
    asked = spark.createDataFrame([(1, '{"blocks": [{"text": "x"}, {"type": "table", "text": "y", "page": 3, "confidence": 0.2}]}'), (2, "one\n\ntwo")], "doc_id long, text string")
    got = [(r.doc_id, r.type, r.text, r.page, r.confidence) for r in blocks.from_request(asked).orderBy("doc_id", "seq").collect()]
    assert got == [(1, "paragraph", "x", 1, 1.0), (1, "table", "y", 3, 0.2), (2, "paragraph", "one", 1, 0.5), (2, "paragraph", "two", 2, 0.5)]


def test_manifest(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text(name)
    files = blocks.read_files(spark, str(tmp_path))
    path = {r.path[-1]: (r.path, r.sha256) for r in files.collect()}
    want = spark.createDataFrame([path["a"], (path["b"][0], "0"), ("gone", "0")], "path string, sha256 string")
    assert {r.path[-1]: r.status for r in blocks.manifest_check(files, want).collect()} == {"a": "ok", "b": "mismatch", "e": "missing"}


def test_upserts_with_nulls(spark):
    held = spark.createDataFrame([(1, None, "a"), (2, 5, "b")], "k long, d long, v string")
    batch = spark.createDataFrame([(1, None, "c"), (3, None, "d")], "k long, d long, v string")
    assert {tuple(r) for r in state.upsert(held, batch, ["k", "d"]).collect()} == {(1, None, "c"), (2, 5, "b"), (3, None, "d")}
    assert [r.v for r in state.new_only(batch, held, ["k", "d"]).collect()] == ["d"]
    assert state.conforms(held, {"k": "bigint", "v": "int", "w": "string"}) == ["v: string", "w: missing"]


def test_one_branch_keeps_its_order(spark):
    hits = spark.createDataFrame([(i, i + 1) for i in range(5)], "doc_id long, r long")
    assert [r.doc_id for r in search.fuse([(hits, 0.5)]).orderBy(F.desc("score"), "doc_id").collect()] == list(range(5))


def test_partitions_do_not_matter(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    want = search.lexical(docs, core.TERMS).orderBy("doc_id").collect()
    assert search.lexical(docs.repartition(7), core.TERMS).orderBy("doc_id").collect() == want


def test_stream_equals_batch(spark):
    events = spark.read.parquet(f"{AT}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(spark.read.parquet(f"{AT}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(AT).withColumn("ts", F.col("ts").cast("timestamp"))
    q = windows.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    try:
        q.processAllAvailable()
        key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
        assert key(spark.sql("SELECT * FROM tumbled")) == key(windows.tumbling(events))
    finally:
        q.stop()


def test_many_queries_are_ranked_one_by_one(spark):
    """Each query of hybrid_multi gets what hybrid gives it alone; hybrid and knn refuse several query rows."""
    t = core.Tables(spark, AT)
    asked = t.embeddings.where("vec_id IN (1, 5)").selectExpr("vec_id AS query_id", "embedding", "CASE vec_id WHEN 1 THEN array('the', 'pour') ELSE array('and') END AS terms")
    many = search.hybrid_multi(t.documents, t.embeddings, asked).collect()
    for q, terms in ((1, ["the", "pour"]), (5, ["and"])):
        alone = search.hybrid(t.documents, t.embeddings, asked.where(f"query_id = {q}"), terms).collect()
        assert sorted((r.r, r.doc_id, r.score) for r in many if r.query_id == q) == sorted((r.r, r.doc_id, r.score) for r in alone)
    for df in (search.knn(t.embeddings, asked, 5), search.hybrid(t.documents, t.embeddings, asked, ["the"])):
        with pytest.raises(Exception, match="one query row"):
            df.collect()
    assert search.knn(t.embeddings, asked.where("false"), 5).count() == 0


@pytest.mark.parametrize("each", [(8192, 1024), (60, 7)])
def test_queries_meet_all_rows_in_blocks(spark, each):
    """The nearest of every query, ties by id, against a plain sort; vectors without a direction have no part in it."""
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 6)]) for i in range(300)]
    odd = [(400, None), (401, [0.0] * 6), (402, [None] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)
    asked = df.where("vec_id % 9 = 0 OR vec_id > 399").withColumnRenamed("vec_id", "query_id")
    found = nearest.nearest(df, asked, 7, rows_each=each[0], queries_each=each[1])
    got = sorted(map(tuple, search.top_each(found, 7, F.desc("similarity"), "vec_id").select("query_id", "r", "vec_id", "similarity").collect()))
    size = lambda v: sum(x * x for x in v) ** 0.5
    some = [(i, v) for i, v in rows if any(v)]
    want = []
    for q, u in some:
        if q % 9 == 0:
            near = sorted((-round(sum(a * b for a, b in zip(u, v, strict=True)) / (size(u) * size(v)), 6), i) for i, v in some)[:7]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, sorted(want), strict=True))
    assert nearest.nearest(df, asked.where("false"), 7).count() == 0 == nearest.nearest(df.where("false"), asked, 7).count()


@pytest.mark.parametrize("rows", [1, 25, 10_000, 10_007, 25_000])
def test_page_asked_for_is_clamped_only_beyond_the_last(spark, tmp_path, rows):
    spark.range(rows).select((F.col("id") * 3).alias("o_orderkey"), F.lit("P").alias("o_orderstatus")).write.parquet(f"{tmp_path}/orders.parquet")
    assert oracle.differences(spark, str(tmp_path), "page_clamped", core.QUERIES, core.ORACLES) is None
