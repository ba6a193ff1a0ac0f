"""Queries over stored indexes, dictionaries and frames of questions, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import ann, matching, questions, search
from .operators.postings import Postings
from .operators.shared import fresh_dir
from .queries import HYBRID_MULTI_SQL, LEXICAL_SQL, MANY, TERMS, TOKENS_SQL, Tables, query
from .queries_review import _LAWS, answered

_H = "0.1 * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493406685 / n"


# Vectors ------------------------------------------------------------------------------------------


def _index(t: Tables) -> ann.VectorIndex:
    """Vectors of even ids, then the others added."""
    index = ann.VectorIndex.build(t.embeddings.where("vec_id % 2 = 0"), fresh_dir(t.spark, "vectors"))
    index.add(t.embeddings.where("vec_id % 2 = 1"))
    return index


def _hundredth(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY 3 DESC, e.vec_id)::BIGINT AS r FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0".replace("ORDER BY 3 DESC", "ORDER BY similarity DESC") + " QUALIFY r <= 10")
def ann_every_cell(t):
    """The index asked with all of its cells and all vectors as candidates: exact."""
    index = _index(t)
    return index.search(_hundredth(t), 10, probes=len(index.centers), rerank=max(1, -(-index.vectors().count() // 10)))


@query("SELECT count(*)::BIGINT AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def ann_recall(t):
    """Every hundredth vector asked: whether the index finds nine in ten of the ten nearest that the exact search finds."""
    asked = _hundredth(t)
    found, exact = _index(t).search(asked, 10), search.knn_multi(t.embeddings, asked, 10)
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("reached"))


def ann_knn(t):
    """Every hundredth vector asked, with the probes that the index chose: its ten nearest, about."""
    return _index(t).search(_hundredth(t), 10)


query()(ann_knn)


# Terms --------------------------------------------------------------------------------------------


def _postings(t: Tables) -> Postings:
    """Documents of even ids, then the others as a second segment."""
    index = Postings.build(t.documents.where("doc_id % 2 = 0"), fresh_dir(t.spark, "postings"))
    index.add(t.documents.where("doc_id % 2 = 1"))
    return index


def _asked(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(MANY.items()), "query_id long, terms array<string>")


@query(f"WITH {LEXICAL_SQL} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS r FROM lex QUALIFY r <= 50")
def postings_search(t):
    """lexical_or_search over stored postings, of which only blocks that may reach the best fifty are read."""
    hits, _ = _postings(t).search(t.spark.createDataFrame([(0, TERMS)], "query_id long, terms array<string>"), 50)
    return hits.select("doc_id", "score", "r")


@query(HYBRID_MULTI_SQL)
def postings_hybrid_multi(t):
    """hybrid_rrf_multi with stored postings."""
    asked = t.embeddings.where(F.col("vec_id").isin(*MANY)).select(F.col("vec_id").cast("long").alias("query_id"), "embedding")
    sparse, _ = _postings(t).search(_asked(t), search.DEPTH)
    return search.fused_multi(search.knn_multi(t.embeddings, asked, search.DEPTH).withColumnRenamed("vec_id", "doc_id"), sparse)


_ITEM_TOKENS = TOKENS_SQL.replace("doc_id", "item_id").replace("documents", "benchmark")


@query(f"""WITH tok AS ({TOKENS_SQL}), asked AS (SELECT DISTINCT item_id, term FROM ({_ITEM_TOKENS})), q AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM asked),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
s AS (SELECT item_id AS query_id, doc_id, round(sum({_H}), 9) AS score FROM tf JOIN q USING (term) GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS r FROM s QUALIFY r <= 5""")
def question_search(t):
    """Every benchmark text as a question, as it is written."""
    return _postings(t).search(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), 5)[0].select("query_id", "doc_id", "score", "r")


# Dictionaries -------------------------------------------------------------------------------------

_NAMES_SQL = "names AS (SELECT p_name AS name FROM part UNION SELECT n_name FROM nation UNION SELECT text FROM benchmark WHERE length(text) > 0 UNION SELECT unnest(string_split(text, ' ')) FROM benchmark)"


def _names(t: Tables) -> DataFrame:
    """Names of parts and nations, passages, and the words of these."""
    words = t.benchmark.select(F.explode(F.split("text", " ")).alias("name"))
    return t.part.select(F.col("p_name").alias("name")).union(t.nation.select("n_name")).union(t.benchmark.select("text")).union(words).distinct()


@query(f"WITH {_NAMES_SQL} SELECT doc_id, count(*)::BIGINT AS n, min(name) AS least, max(length(name))::BIGINT AS longest FROM documents JOIN names ON contains(text, name) WHERE length(name) > 3 GROUP BY doc_id")
def names_in_documents(t):
    """Every name of over three letters that a document contains."""
    found = matching.contains_join(t.documents.select(F.col("doc_id").alias("id"), "text"), _names(t).where(F.length("name") > 3))
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n"), F.min("name").alias("least"), F.max(F.length("name")).cast("long").alias("longest"))


_PATTERNS = [r"the (h|w)and", r"licen[cs]e, version [0-9]", r"[0-9]{3}-[0-9]{4}|@[a-z]+\.", "nicht|pour", r"^[A-D]", r"\bund der\b", "Lorem$"]


@query(f"SELECT pattern, count(*)::BIGINT AS n, min(doc_id) AS least, max(doc_id) AS largest FROM documents JOIN (VALUES {', '.join(f"('{p}')" for p in _PATTERNS)}) v(pattern) ON regexp_matches(text, pattern) GROUP BY pattern")
def patterns_in_documents(t):
    """Patterns with literals that they require, one of which none is sure, over whole documents."""
    met = t.documents.join(matching.regex_join(t.documents, _PATTERNS), "text")
    return met.groupBy("pattern").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("largest"))


# Questions ----------------------------------------------------------------------------------------

_EVALUATION_SQL = f"""WITH q AS (SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN text ELSE '예우법 4-1' END AS a, CASE WHEN item_id % 2 = 1 THEN '예우법 제4조제1항 der und' END AS b FROM benchmark),
w AS (SELECT id, 0 AS round, a AS text FROM q UNION ALL SELECT id, 1, b FROM q WHERE b IS NOT NULL),
asked AS (SELECT *, count(*) OVER (PARTITION BY id, round) AS n FROM (SELECT DISTINCT id, round, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\-]+'), lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))) AS term FROM w)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM ({TOKENS_SQL}) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
s AS (SELECT id, round, doc_id, round(sum({_H}), 9) AS score FROM tf JOIN asked USING (term) GROUP BY ALL),
h AS (SELECT id, round, doc_id FROM s QUALIFY row_number() OVER (PARTITION BY id, round ORDER BY score DESC, doc_id) <= 5),
e AS (SELECT item_id AS id, min(doc_id)::VARCHAR AS want FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1),
r AS (SELECT mode, id, want, (SELECT count(*) FROM h WHERE h.id = q.id AND (round = 0 OR mode = 'on')) AS hits, coalesce((SELECT bool_or(contains(doc_id::VARCHAR, want)) FROM h WHERE h.id = q.id AND (round = 0 OR mode = 'on')), false) AS hit, mode = 'on' AND EXISTS (SELECT 1 FROM h WHERE h.id = q.id AND round = 1) AS again FROM q LEFT JOIN e USING (id), (VALUES ('off'), ('on')) m(mode))
SELECT mode, count(*)::BIGINT AS n, round(avg(hit::INT), 6) AS hit, round(avg((hits = 0)::INT), 6) AS no_evidence, round(avg((hits > 0)::INT), 6) AS cited, round(avg(again::INT), 6) AS retried FROM r GROUP BY mode"""


@query(_EVALUATION_SQL)
def evaluate_questions(t):
    """All benchmark rows as questions, without and with retries: even ones ask for their passage, whose document is expected, odd ones name a
    clause that is found only once it is written out."""
    index, k = _postings(t), F.col("item_id")
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    holds = matching.contains_join(docs, t.benchmark.select(F.col("text").alias("name"))).groupBy("name").agg(F.min("id").cast("string").alias("expected"))
    asked = t.benchmark.join(holds, F.col("text") == F.col("name"), "left").select(k.alias("id"), F.when(k % 2 == 0, F.col("text")).otherwise("예우법 4-1").alias("text"), "expected")
    hits = lambda rows: index.search(rows.select(F.col("id").alias("query_id"), "text"), 5)[0].select(F.col("query_id").alias("id"), "doc_id", "r")
    return questions.evaluation(asked, hits, answered, laws=_LAWS).drop("score")
