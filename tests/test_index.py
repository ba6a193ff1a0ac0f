"""Stored indexes: vectors by cell, postings by block."""

import glob
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import ann, ingest, postings, search, state
from marlstone.operators.postings import Postings
from marlstone.plans import guard

AT = "/root/testdata/sf0.1"


def test_codes_of_four_bits():
    r = np.random.default_rng(1)
    rest, spread = r.normal(0, 1, (50, 7)) * np.arange(1, 8), np.arange(1.0, 8.0)
    back = ann.unpacked(ann.packed(rest, spread), spread)
    inside = np.abs(rest) <= ann.SPAN * spread
    assert (np.abs(back - rest) <= ann.SPAN * spread / (ann.LEVELS - 1) + 1e-9)[inside].all()


def test_recall_and_addition(spark, tmp_path):
    """Half of the vectors are indexed, the others added; nine of ten of the ten nearest are found, and all with every cell."""
    vectors = spark.read.parquet(f"{AT}/embeddings.parquet").select("vec_id", "embedding")
    index = ann.VectorIndex.build(vectors.where("vec_id % 2 = 0"), str(tmp_path / "i"))
    index.add(vectors.where("vec_id % 2 = 1"))
    queries = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id): r.similarity for r in search.knn_multi(vectors, queries, 10).collect()}
    index = ann.VectorIndex(spark, str(tmp_path / "i"))
    assert index.vectors().count() == vectors.count() and index.probes < len(index.centers)
    found = {(r.query_id, r.vec_id): r.similarity for r in index.search(queries, 10).collect()}
    assert len(set(found) & set(exact)) >= 0.9 * len(exact)
    whole = {(r.query_id, r.vec_id): r.similarity for r in index.search(queries, 10, probes=len(index.centers), rerank=200).collect()}
    assert whole == exact


def test_only_probed_cells_are_read(spark, tmp_path):
    vectors = spark.read.parquet(f"{AT}/embeddings.parquet").select("vec_id", "embedding")
    index = ann.VectorIndex.build(vectors, str(tmp_path / "i"), cells=20)
    one = vectors.where("vec_id = 7").withColumnRenamed("vec_id", "query_id")
    assert index.probed(one, 3).select("cell").distinct().count() == 3
    cells = [r.cell for r in index.probed(one, 3).collect()]
    assert all(r.cell in cells for r in index.candidates(one, 50, 3).collect())


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, tmp_path, n):
    data = [(i, [float(i), 1.0, 0.0]) for i in range(n)] + [(90, None), (91, [0.0, 0.0, 0.0]), (92, [None, 1.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    index = ann.VectorIndex.build(df, str(tmp_path / "i"))
    asked = df.withColumnRenamed("vec_id", "query_id")
    found = index.search(asked, 2, probes=99, rerank=99).collect()
    assert sorted((r.query_id, r.vec_id) for r in found if r.r == 1) == [(i, i) for i in range(n)]


def test_one_vector_many_times(spark, tmp_path):
    """A cell that holds most vectors is dealt out, and ties go by id."""
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.when(F.col("id") < 2500, 2.0).otherwise(F.col("id") % 97)).alias("embedding"))
    index = ann.VectorIndex.build(df, str(tmp_path / "i"), cells=8)
    found = index.search(spark.createDataFrame([(0, [1.0, 2.0])], "query_id long, embedding array<double>"), 5, rerank=1000).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r.r)] == [0, 1, 2, 3, 4]


def test_postings_equal_a_scan_and_skip_blocks(spark, tmp_path):
    """Three segments; the best documents are those of a scan of all texts, and blocks that can't hold one aren't read."""
    docs = spark.read.parquet(f"{AT}/documents.parquet").select("doc_id", "text").where("doc_id < 4000")
    index = Postings.build(docs.where("doc_id % 3 = 0"), str(tmp_path / "p"))
    before = sorted(glob.glob(f"{tmp_path}/p/*/*.parquet"))
    for k in (1, 2):
        index.add(docs.where(f"doc_id % 3 = {k}"))
    assert set(before) <= set(glob.glob(f"{tmp_path}/p/*/*.parquet"))
    asked = spark.createDataFrame([(1, "The THAT and"), (2, "nicht der und"), (3, "nobodyhasthis"), (4, None), (5, "pour")], "query_id long, text string")
    hits, counts = index.search(asked, 5)
    terms = asked.select("query_id", F.split(F.lower("text"), " ").alias("terms")).where("text IS NOT NULL")
    want = search.top_each(search.lexical_multi(docs, terms), 5, F.desc("score"), "doc_id")
    columns = ["query_id", "r", "doc_id", "score"]
    assert sorted(map(tuple, hits.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    read = {r.query_id: (r.blocks, r.read) for r in counts.collect()}
    assert set(read) == {1, 2, 5} and all(r <= b for b, r in read.values()) and sum(r for _, r in read.values()) < 0.8 * sum(b for b, _ in read.values())


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "- !")], "doc_id long, text string")
    index = Postings.build(docs.unionByName(spark.createDataFrame([(4, "one two two")], docs.schema)), str(tmp_path / "p"))
    hits, counts = index.search(spark.createDataFrame([(0, "two three")], "query_id long, text string"), 3)
    assert [(r.doc_id, r.r) for r in hits.collect()] == [(4, 1)] and counts.first()["read"] == 1


def test_untouched_partitions_stay(spark, tmp_path):
    at = str(tmp_path / "t")
    table = state.KeyedTable(spark, at, ["id"], 16)
    table.create(spark.range(500).withColumn("v", F.lit("a")))
    files = lambda: set(glob.glob(f"{at}/*/*.parquet"))
    before = files()
    batch = spark.createDataFrame([(3, "b"), (3, "c"), (900, "b")], "id long, v string")
    table.upsert(batch, [F.desc("v")])
    assert len(before & files()) >= len(before) - 2 and files() != before
    got = {r.id: r.v for r in table.read().collect()}
    assert (len(got), got[3], got[900], got[4]) == (501, "c", "b", "a")
    table.upsert(batch.where("false"), [F.desc("v")])
    table.replace_changed(spark.createDataFrame([(3, "c"), (4, "z")], "id long, v string"), "v")
    assert {r.id: r.v for r in table.read().where("id < 5").collect()} == {0: "a", 1: "a", 2: "a", 3: "c", 4: "z"}


def test_only_changed_chunks_are_embedded(spark):
    calls = spark.sparkContext.accumulator(0)

    def encode(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    rows = lambda texts: spark.createDataFrame([(d, 0, "paragraph", t, 1, 1.0) for d, t in texts], "doc_id long, seq int, type string, text string, page int, confidence double")
    long = "abcdefghij" * 300  # the first two of its three chunks are equal
    none = spark.createDataFrame([], "sha256 string, embedding array<float>")
    loaded = ingest.reindexed(rows([(1, long), (2, "short")]), none, encode).drop("fresh")
    first = spark.createDataFrame(loaded.collect(), loaded.schema)
    made = calls.value
    after = ingest.reindex(first, rows([(1, long + "!")]), encode).collect()
    assert (made, calls.value - made) == (3, 1) and sorted((r.doc_id, r.part) for r in after) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    shorter = ingest.reindex(first, rows([(1, "abc")]), encode).collect()
    assert sorted((r.doc_id, r.content) for r in shorter) == [(1, "abc"), (2, "short")]


def test_a_slow_statement_is_refused(spark):
    slow = spark.range(4, numPartitions=4).select(F.udf(lambda x: time.sleep(20) or x, "long")("id").alias("x"))
    start = time.time()
    with pytest.raises(guard.Refused, match="longer"):
        guard.rows(spark, "SELECT sum(x) AS s FROM v", {"v": slow}, seconds=1.5)
    assert time.time() - start < 15
    assert guard.rows(spark, "SELECT sum(x) AS s FROM v", {"v": spark.range(5).withColumnRenamed("id", "x")})[0].s == 10


def test_probes_are_chosen_on_vectors_that_no_centre_was_learned_on(spark, tmp_path):
    """Of all that is stored: those added later are tried too, and raise the probes if their neighbours lie farther."""
    r = np.random.default_rng(3)
    tight = np.repeat(r.normal(0, 1, (12, 16)), 50, 0) + r.normal(0, 0.01, (600, 16))
    data = [(i, v.tolist()) for i, v in enumerate(np.vstack([tight, r.normal(0, 1, (2400, 16))]))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    at = str(tmp_path / "i")
    index = ann.VectorIndex.build(df.where("vec_id < 600"), at)
    before, ids = index.probes, lambda what: {x.vec_id for x in spark.read.parquet(f"{at}/{what}").collect()}
    assert len(ids("tried")) == 150 and not ids("tried") & ids("sample") and len(ids("sample")) == 450
    index.add(df.where("vec_id >= 600"))
    assert before < index.probes == ann.VectorIndex(spark, at).probes


def test_a_search_of_everything_lists_no_pairs(spark, tmp_path):
    vectors = spark.read.parquet(f"{AT}/embeddings.parquet").select("vec_id", "embedding").where("vec_id < 300")
    index = ann.VectorIndex.build(vectors, str(tmp_path / "i"))
    asked = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    found = index.search(asked, 3, probes=len(index.centers), rerank=100)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, search.knn_multi(vectors, asked, 3).collect()))


def test_a_block_meets_its_questions_once(spark, tmp_path):
    """Postings are shuffled once for all questions of a block, not once for each of them; ids and terms of all kinds are found as by a scan."""
    rows = [(k * 10**15 - 3 * 10**17, " ".join(f"w{j}" for j in range(k % 7, 40)) + " --w1 -- --- élan-Vital 東京 x-" * (k % 5)) for k in range(600)]
    docs = spark.createDataFrame([*rows, (None, "w1 w2"), (7, None), (8, "-- -")], "doc_id long, text string").cache()
    index = Postings.build(docs, str(tmp_path / "p"))
    few, many = ([(q, f"w{q % 40} w{(q + 5) % 40} w39 élan-vital 東京 --w1") for q in range(n)] for n in (2, 60))
    for asked in (few, many):
        questions = spark.createDataFrame(asked, "query_id long, text string")
        hits, _ = index.search(questions, 4)
        terms = questions.select("query_id", F.split(F.lower("text"), " ").alias("terms"))
        want = search.top_each(search.lexical_multi(docs.where("doc_id IS NOT NULL"), terms), 4, F.desc("score"), "doc_id")
        columns = ["query_id", "r", "doc_id", "score"]
        assert sorted(map(tuple, hits.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_documents_are_indexed_where_they_lie(spark, tmp_path):
    """Building shuffles nothing; counts about a byte's limit, long texts and documents without terms among them are found as by a scan."""
    rows = [(k, "aa " * n + "bb " * (k % 3)) for k, n in enumerate([1, 254, 255, 256, 300, 70_000, 0, 3])] + [(20 + k, "- --" if k % 2 else "aa Bb-c") for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    spark.sparkContext.setJobGroup("build", "")
    index = Postings.build(docs, str(tmp_path / "p"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getJobIdsForGroup("build")
    assert len(jobs) and all(len(tracker.getJobInfo(j).stageIds) == 1 for j in jobs)
    asked = spark.createDataFrame([(1, "aa"), (2, "BB cc"), (3, "bb-c aa - -"), (4, "--")], "query_id long, text string")
    hits, _ = index.search(asked, 400)
    terms = spark.createDataFrame([(1, ["aa"]), (2, ["bb", "cc"]), (3, ["bb-c", "aa"])], "query_id long, terms array<string>")
    want = search.top_each(search.lexical_multi(docs, terms), 400, F.desc("score"), "doc_id")
    columns = ["query_id", "r", "doc_id", "score"]
    assert sorted(map(tuple, hits.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_equal_questions_are_searched_once(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"w{k % 9} w{k % 4}") for k in range(500)], "doc_id long, text string")
    index, tables = Postings.build(docs, str(tmp_path / "p")), {}
    put = postings.written
    monkeypatch.setattr(postings, "written", lambda df, at: tables.setdefault(at.rsplit("/", 1)[-1], put(df, at)))
    asked = spark.createDataFrame([(q, "w1 w2" if q % 3 else "W2, w1!") for q in range(30)] + [(99, "w1")], "query_id long, text string")
    hits, counts = index.search(asked, 4)
    assert tables["bounds"].select("query_id").distinct().count() == 2
    got = {q: [(r.doc_id, r.score) for r in sorted(hits.where(F.col("query_id") == q).collect(), key=lambda r: r.r)] for q in (0, 1, 29, 99)}
    assert got[0] == got[1] == got[29] != got[99] and all(len(x) == 4 for x in got.values())
    assert counts.count() == 31 and hits.count() == 31 * 4
