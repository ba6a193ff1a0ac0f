"""Language spans against a plain Viterbi, held-out accuracy, odd rows."""

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from marlstone.llm import language, negatives

AT = "/root/testdata/sf0.01"


def plain_viterbi(score, free, penalty):
    n, k = score.shape
    best, back = np.zeros(k, int), []
    for t in range(n):
        top = int(best.argmax())
        changed = best[top] - (0 if free[t] else penalty)
        back.append([j if best[j] >= changed else top for j in range(k)])
        best = np.array([max(best[j], changed) + score[t, j] for j in range(k)])
    state, out = int(best.argmax()), []
    for t in reversed(range(n)):
        out.append(state)
        state = back[t][state]
    return out[::-1]


@pytest.mark.parametrize("n", [1, 2, 7, 60, 400])
@pytest.mark.parametrize("k", [2, 5])
def test_viterbi_in_blocks(n, k):
    r = np.random.default_rng(n * k)
    score, free = r.integers(-6, 6, (n, k)), r.random(n) < 0.1
    free[0] = True
    for step in (1, 3, 16, 256):
        assert language.viterbi(score, free, 4, step).tolist() == plain_viterbi(score, free, 4)


def test_words():
    texts = ["Ab cd2ab", "", "ÀB привет", "abпри", "x" * 300]
    raw = [t.encode() for t in texts]
    w = language.split(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), language.Letters())
    distinct = ["".join(map(chr, w.chars[a:b].tolist())) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    assert [(int(t), distinct[i]) for t, i in zip(w.text, w.which, strict=True)] == [(0, "ab"), (0, "cd"), (0, "ab"), (2, "àb"), (2, "привет"), (3, "ab"), (3, "при"), (4, "x" * 300)]


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(spark.read.parquet(f"{AT}/documents.parquet"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    found = language.op11_language(spark, AT)
    assert found.count() == docs.count()
    right = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("share"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert right.share > 0.98 and 0 <= right.low and right.high <= 1


def test_mixed_text(spark, model):
    texts = {r.lang: " ".join(r.text.split()[:30]) for r in spark.read.parquet(f"{AT}/documents.parquet").where("n_chars > 1500").orderBy("doc_id").collect()}
    mixed = f"{texts['de']} 12 {texts['en']} {texts['es']}"
    found = language.language_spans(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert [s.lang for s in found.spans] == ["de", "en", "es"]
    assert sum(s.letters for s in found.spans) == sum(c.isalpha() for c in mixed) and found.spans[0].first_word == 0
    assert all(b.first_word == a.last_word + 1 for a, b in zip(found.spans, found.spans[1:], strict=False))


def test_odd_rows(spark, model):
    data = [(1, None, 5), (2, "", 5), (3, "12 !?\n", 5), (None, "the", 5), (4, "привет", 5), (4, "the of and", 5), (5, "the and of " * 300_000, 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, spans int")
    found = sorted(language.language_spans(docs, model).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.score))
    assert [(r.doc_id, r.lang_pred) for r in found] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "en"), (None, "en")]
    assert [r.score for r in found[:4]] == [0, 0, 0, 1 / len(model.names)] and found[5].score == 1
    assert language.language_spans(docs.limit(0), model).count() == 0
    nothing = language.learn(docs.select("text", F.lit(None).cast("string").alias("lang")))
    assert {(r.lang_pred, r.score) for r in language.language_spans(docs, nothing).collect()} == {("und", 0.0)}


def plain_negatives(rows, scale=256):
    rows = [(i, lab, tuple(int(np.floor(scale * np.float64(x))) for x in v)) for i, v, lab in set(rows)]
    out = []
    for a, la, va in rows:
        if a % 100:
            continue
        dot = lambda v: sum(x * y for x, y in zip(va, v, strict=False))  # noqa: B023, E731
        scored = sorted((-dot(v), i, lab) for i, lab, v in rows)
        for s, p, _ in [x for x in scored if x[2] == la and x[1] != a][:5]:
            near = [x for x in scored if x[2] != la and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("each", [(8192, 512), (40, 2)])
def test_hard_negatives(spark, each):
    r = np.random.default_rng(5)
    rows = [(i, tuple(float(x) for x in np.float32(r.normal(0.3, 0.5, 8))), int(r.integers(0, 3))) for i in range(600)]
    rows += [(i, rows[7][1], int(r.integers(0, 3))) for i in range(600, 640)] + rows[:30]  # ties and repeated rows
    odd = [(700, None, 1), (701, (1.0, None), 1), (702, (float("nan"),) * 8, 1), (703, (float("inf"),) * 8, 1), (704, rows[0][1], None), (None, rows[0][1], 1)]
    df = spark.createDataFrame([(*x, 1) for x in rows + odd], "vec_id long, embedding array<float>, label int, rank int").repartition(5)
    found = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, rows_each=each[0], anchors_each=each[1])
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0 == negatives.hard_negatives(df, F.lit(False)).count()


def test_hard_negatives_of_large_components(spark):
    data = [(0, [1.0e7, 1.0], 1), (1, [1.0e7, 2.0], 1), (2, [1.0e7], 2), (3, [0.9e7, 0.0, 5.0], 2)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    x = 2_560_000_000
    found = negatives.hard_negatives(df, F.col("vec_id") == 0)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 1, 2, x * x + 2 * 65536, x * x), (0, 1, 2, 3, x * x + 2 * 65536, x * x * 9 // 10)]
    with pytest.raises(Exception, match="beyond a long"):
        negatives.hard_negatives(df.withColumn("embedding", F.transform("embedding", lambda v: v * 3)), F.col("vec_id") == 0).collect()


def test_negatives_sql(spark):
    assert oracle.differences(spark, AT, "q", {"q": negatives.op12_negatives}, {"q": negatives.OP12_SQL}) is None
