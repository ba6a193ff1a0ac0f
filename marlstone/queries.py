"""Queries over the driver's tables and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import dossiers, extract, generate, graph, ingest, intake, matching, prediction, scans, search, state
from .operators.shared import fresh_dir
from .plans import guard
from .sources import blocks, texts
from .streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TERMS = ["the", "that", "and", "pour", "nicht"]


class Tables:
    """t.orders is the table orders of a folder."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, at: f(Tables(spark, at))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def n(c: str | Column = "*") -> Column:
    return F.count(c)


# Documents and search -----------------------------------------------------------------------------

CHUNKS_SQL = "SELECT doc_id, i::BIGINT AS seq, substr(text, (i * 1050 + 1)::INT, 1200) AS content FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 151, 0) // 1050 + 1)) AS i FROM documents WHERE length(text) > 0)"
TOKENS_SQL = r"SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}\-]+'), lambda t: regexp_matches(t, '[\p{L}\p{N}]'))) AS term FROM documents"
LEXICAL_SQL = f"""
tok AS ({TOKENS_SQL}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN ({", ".join(f"'{t}'" for t in TERMS)}) GROUP BY ALL),
lex AS (SELECT doc_id, round(sum(0.1 * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493406685 / {len(TERMS)}), 9) AS score FROM tf GROUP BY doc_id)"""
COSINE_SQL = "SELECT vec_id, label, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS similarity FROM (SELECT e.vec_id, e.label, e.embedding::DOUBLE[] AS a, q.embedding::DOUBLE[] AS b FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
HYBRID_SQL = f"""WITH {LEXICAL_SQL},
sparse AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM lex QUALIFY r <= 50),
dense AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS r FROM ({COSINE_SQL}) QUALIFY r <= 50),
fused AS (SELECT doc_id, round(sum(s), 9) AS score FROM (SELECT doc_id, 1.0::DOUBLE / (60 + r) AS s FROM dense UNION ALL SELECT doc_id, 0.5::DOUBLE / (60 + r) FROM sparse) GROUP BY doc_id)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS r FROM fused QUALIFY r <= 5"""
#: Queries by the vector that stands for each.
MANY = {0: TERMS, 3: ["der", "und", "nicht"], 17: ["les"], 42: ["the", "por"]}
HYBRID_MULTI_SQL = f"""WITH asked(query_id, term, n) AS (VALUES {", ".join(f"({q}::BIGINT, '{x}', {len(terms)})" for q, terms in MANY.items() for x in terms)}),
tok AS ({TOKENS_SQL}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
lex AS (SELECT query_id, doc_id, round(sum(0.1 * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493406685 / n), 9) AS score FROM tf JOIN asked USING (term) GROUP BY ALL),
sparse AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM lex QUALIFY r <= 50),
v AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings),
near AS (SELECT q.vec_id::BIGINT AS query_id, e.vec_id, round(list_dot_product(e.a, q.a) / (sqrt(list_dot_product(e.a, e.a)) * sqrt(list_dot_product(q.a, q.a))), 6) AS similarity FROM v e, v q WHERE q.vec_id IN ({", ".join(map(str, MANY))})),
dense AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM near QUALIFY r <= 50),
fused AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + r) AS s FROM dense UNION ALL SELECT query_id, doc_id, 0.5::DOUBLE / (60 + r) FROM sparse) GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS r FROM fused QUALIFY r <= 5"""


def _one(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id = 0")


@query(CHUNKS_SQL)
def chunk_documents(t):
    return search.chunk_documents(t.documents)


@query(f"SELECT lang, count(*)::BIGINT AS n_chunks, count(DISTINCT doc_id)::BIGINT AS n_docs FROM ({CHUNKS_SQL}) JOIN documents USING (doc_id) GROUP BY lang")
def chunk_counts_by_lang(t):
    size = F.size(tx.chunks(F.col("text"))).cast("long")
    return t.documents.groupBy("lang").agg(F.sum(size).alias("n_chunks"), F.sum((size > 0).cast("long")).alias("n_docs"))


@query(f"SELECT term, sum(tf)::BIGINT AS tf, count(*)::BIGINT AS df FROM (SELECT doc_id, term, count(*) AS tf FROM ({TOKENS_SQL}) GROUP BY ALL) GROUP BY term ORDER BY tf DESC, term LIMIT 50")
def token_postings_topterms(t):
    return search.term_counts(t.documents).orderBy(F.desc("tf"), "term").limit(50)


@query(f"WITH {LEXICAL_SQL} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS r FROM lex QUALIFY r <= 50")
def lexical_or_search(t):
    return search.top(search.lexical(t.documents, TERMS), 50, F.desc("score"), "doc_id")


@query(f"SELECT vec_id, label::BIGINT AS label, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id)::BIGINT AS r FROM ({COSINE_SQL}) QUALIFY r <= 10")
def vector_knn(t):
    return search.knn(t.embeddings, _one(t), 10).withColumn("label", F.col("label").cast("long"))


@query(f"SELECT vec_id, label::BIGINT AS label, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id)::BIGINT AS r FROM ({COSINE_SQL}) WHERE label = 3 QUALIFY r <= 10")
def vector_knn_filtered(t):
    return search.knn(t.embeddings.where("label = 3"), _one(t), 10).withColumn("label", F.col("label").cast("long"))


@query(f"WITH k AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id) AS r FROM ({COSINE_SQL}) QUALIFY r <= 30) SELECT label::BIGINT AS label, round(sum(similarity), 5) AS vote, min(r)::BIGINT AS first FROM k GROUP BY label ORDER BY 2 DESC, 3 LIMIT 2")
def vector_group_vote(t):
    near = search.knn(t.embeddings, _one(t), 30)
    return near.groupBy(F.col("label").cast("long").alias("label")).agg(F.round(F.sum("similarity"), 5).alias("vote"), F.min("r").alias("first")).orderBy(F.desc("vote"), "first").limit(2)


@query(f"WITH c AS ({COSINE_SQL}) SELECT d.doc_id, round(length(CASE WHEN contains(lower(text), 'the') THEN 'the' ELSE '' END) + length(CASE WHEN contains(lower(text), 'nicht') THEN 'nicht' ELSE '' END) + similarity, 4) AS score FROM documents d JOIN c ON c.vec_id = d.doc_id ORDER BY 2 DESC, 1 LIMIT 20")
def criteria_score(t):
    one = F.broadcast(_one(t).select(F.col("embedding").alias("q")))
    near = t.embeddings.crossJoin(one).select(F.col("vec_id").alias("doc_id"), F.round(tx.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    words = sum((F.when(F.contains(F.lower("text"), F.lit(w)), len(w)).otherwise(0) for w in ("the", "nicht")), F.lit(0))
    return t.documents.join(near, "doc_id").select("doc_id", F.round(words + F.col("similarity"), 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(HYBRID_SQL)
def hybrid_rrf(t):
    return search.hybrid(t.documents, t.embeddings, _one(t), TERMS)


@query(HYBRID_MULTI_SQL)
def hybrid_rrf_multi(t):
    terms = F.create_map(*(x for q, words in MANY.items() for x in (F.lit(q).cast("long"), F.array(*map(F.lit, words)))))
    asked = t.embeddings.where(F.col("vec_id").isin(*MANY)).select(F.col("vec_id").cast("long").alias("query_id"), "embedding", F.element_at(terms, F.col("vec_id").cast("long")).alias("terms"))
    return search.hybrid_multi(t.documents, t.embeddings, asked)


@query(f"WITH {LEXICAL_SQL}, s AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM lex QUALIFY r <= 50) SELECT doc_id, round(0.5::DOUBLE / (60 + r), 9) AS score, r::BIGINT AS r FROM s WHERE r <= 5")
def hybrid_rrf_sparse_only(t):
    return search.hybrid(t.documents, t.embeddings, _one(t), TERMS, dense=False)


@query("WITH a AS (SELECT doc_id, 0 AS list, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE lang = 'fr' QUALIFY r <= 3), b AS (SELECT doc_id, 1 AS list, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 10), f AS (SELECT doc_id, min((list, r)) AS p FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id) SELECT doc_id, p[1]::BIGINT AS list, row_number() OVER (ORDER BY p)::BIGINT AS r FROM f QUALIFY r <= 10")
def priority_merge_hits(t):
    order = (F.desc("n_chars"), "doc_id")
    return search.merge_hits([search.top(t.documents.where("lang = 'fr'"), 3, *order), search.top(t.documents, 10, *order)], 10)


@query("WITH h AS (SELECT doc_id, CASE WHEN lang = 'xx' THEN 0 ELSE 1 END AS tier, n_chars FROM documents), b AS (SELECT * FROM h WHERE tier = (SELECT min(tier) FROM h)) SELECT doc_id, tier::BIGINT AS tier, row_number() OVER (ORDER BY n_chars DESC, doc_id)::BIGINT AS r FROM b QUALIFY r <= 5")
def search_with_fallback(t):
    rows = t.documents.select("doc_id", F.when(F.col("lang") == "xx", 0).otherwise(1).cast("long").alias("tier"), "n_chars")
    best = F.broadcast(rows.agg(F.min("tier").alias("tier")))
    return search.top(rows.join(best, "tier"), 5, F.desc("n_chars"), "doc_id").select("doc_id", "tier", "r")


@query(f"WITH k AS (SELECT vec_id AS id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS r FROM ({COSINE_SQL}) QUALIFY r <= 10), p(id, kind, weight) AS (VALUES (0, 'exclude', 0.0::DOUBLE), (499, 'pin', 1.0), (498, 'pin', 2.0)), m AS (SELECT coalesce(k.id, q.id) AS id, k.similarity, k.r, q.weight FROM (SELECT * FROM k WHERE id NOT IN (SELECT id FROM p WHERE kind = 'exclude')) k FULL JOIN (SELECT * FROM p WHERE kind = 'pin') q ON k.id = q.id) SELECT id::BIGINT AS id, similarity, weight IS NOT NULL AS pinned, row_number() OVER (ORDER BY weight IS NOT NULL DESC, weight DESC NULLS LAST, similarity DESC NULLS LAST, r NULLS LAST, id)::BIGINT AS place FROM m")
def knn_with_picks(t):
    hits = search.knn(t.embeddings, _one(t), 10).select(F.col("vec_id").alias("id"), "similarity", "r")
    picks = t.spark.sql("SELECT * FROM VALUES (0L, 'exclude', 0D), (499L, 'pin', 1D), (498L, 'pin', 2D) AS t(id, kind, weight)")
    return search.apply_picks(hits, picks)


@query("WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM p WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS q, q.label AS want, p.label AS got, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(p.v, q.v) / (sqrt(list_dot_product(p.v, p.v)) * sqrt(list_dot_product(q.v, q.v))), 6) DESC, p.vec_id) AS r FROM p, q WHERE p.vec_id <> q.vec_id), h AS (SELECT q, want, max((got = want AND r <= 1)::INT) AS h1, max((got = want)::INT) AS h5 FROM s WHERE r <= 5 GROUP BY ALL) SELECT want::BIGINT AS label, count(*)::BIGINT AS n, round(avg(h1), 6) AS hit1, round(avg(h5), 6) AS hit5 FROM h GROUP BY GROUPING SETS ((want), ())")
def hit_at_k_by_group(t):
    """Every hundredth vector, a stated set of queries, meets all others: its six nearest without itself."""
    v = t.embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    q = v.where("vec_id % 100 = 0")
    near = search.knn_multi(v, q.select(F.col("vec_id").alias("query_id"), "embedding"), 6).where("vec_id <> query_id")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("r"))).where("r <= 5")
    r = near.join(v.select("vec_id", "label"), "vec_id").join(q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id").withColumnRenamed("query_id", "q")
    same = (F.col("label") == F.col("want")).cast("int")
    h = r.groupBy("q", "want").agg(F.max(F.when(F.col("r") <= 1, same).otherwise(0)).alias("h1"), F.max(same).alias("h5"))
    return h.rollup("want").agg(n().alias("n"), F.round(F.avg("h1"), 6).alias("hit1"), F.round(F.avg("h5"), 6).alias("hit5")).select(F.col("want").cast("long").alias("label"), "n", "hit1", "hit5")


# Relational core ----------------------------------------------------------------------------------

CASES_SQL = "cases AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT p_brand)) AS codes FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"


def _cases(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("p_brand")).alias("codes"))


@query(f"WITH {CASES_SQL} SELECT id, array_to_string(codes, ',') AS codes FROM cases WHERE list_has_any(codes, ['Brand#11', 'Brand#23'])")
def cases_array_overlap(t):
    hit = F.coalesce(F.arrays_overlap("codes", F.array(F.lit("Brand#11"), F.lit("Brand#23"))), F.lit(False))
    return _cases(t).where(hit).select("id", F.array_join("codes", ",").alias("codes"))


@query(f"WITH {CASES_SQL} SELECT id, len(codes)::BIGINT AS n_codes FROM cases WHERE list_contains(codes, 'Brand#12')")
def cases_array_contains(t):
    return _cases(t).where(F.array_contains("codes", "Brand#12")).select("id", F.size("codes").cast("long").alias("n_codes"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'urg') OR o_orderstatus = upper('p') ORDER BY o_orderkey DESC LIMIT 30")
def cases_search_ilike(t):
    hit = F.contains(F.lower("o_orderpriority"), F.lit("urg")) | (F.col("o_orderstatus") == "P")
    return t.orders.where(hit).select("o_orderkey", "o_orderpriority").orderBy(F.desc("o_orderkey")).limit(30)


def _views(t: Tables) -> dict[str, DataFrame]:
    """The six allow-listed views."""
    o = t.orders
    codes = _cases(t).select("id", F.explode("codes").alias("code"))
    return {
        "stats_type": o.groupBy("o_orderpriority", "o_orderstatus").agg(n().alias("cnt")),
        "stats_year": o.groupBy(F.year("o_orderdate").cast("long").alias("year"), "o_orderstatus").agg(n().alias("cnt")),
        "stats_code": codes.groupBy("code").agg(n().alias("cnt")),
        "stats_status": o.groupBy("o_orderstatus").agg(n().alias("cnt")),
        "stats_group": t.customer.groupBy("c_mktsegment").agg(n().alias("cnt")),
        "stats_conclusion": t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(n().alias("cnt")),
    }


for _name, _sql in {
    "stats_type": "SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS cnt FROM orders GROUP BY ALL",
    "stats_year": "SELECT year(o_orderdate)::BIGINT AS year, o_orderstatus, count(*)::BIGINT AS cnt FROM orders GROUP BY ALL",
    "stats_code": f"WITH {CASES_SQL} SELECT unnest(codes) AS code, count(*)::BIGINT AS cnt FROM cases GROUP BY 1",
    "stats_status": "SELECT o_orderstatus, count(*)::BIGINT AS cnt FROM orders GROUP BY ALL",
    "stats_group": "SELECT c_mktsegment, count(*)::BIGINT AS cnt FROM customer GROUP BY ALL",
    "stats_conclusion": "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS cnt FROM lineitem GROUP BY ALL",
}.items():
    QUERIES[_name] = lambda spark, at, k=_name: _views(Tables(spark, at))[k]
    ORACLES[_name] = _sql


@query("SELECT o_orderstatus, sum(cnt)::BIGINT AS total FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS cnt FROM orders GROUP BY ALL) GROUP BY 1")
def guarded_sql(t):
    return guard.run(t.spark, "SELECT o_orderstatus, sum(cnt) AS total FROM stats_type GROUP BY o_orderstatus", {"stats_type": _views(t)["stats_type"]})


@query("SELECT count(*)::BIGINT AS total, (count(*) FILTER (WHERE o_orderstatus = 'O'))::BIGINT AS open, (count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 100000))::BIGINT AS large FROM orders")
def dashboard_filtered_counts(t):
    return t.orders.agg(n().alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).alias("large"))


@query("SELECT o_orderkey, c_name, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS at FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20")
def recent_confirmed(t):
    rows = t.orders.where("o_orderstatus = 'F'").join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return rows.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "c_name", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("at"))


@query("SELECT c_custkey, count(DISTINCT o_orderkey)::BIGINT AS n_orders, count(l_orderkey)::BIGINT AS n_items, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'final' WHEN count(l_orderkey) > 0 THEN 'judged' WHEN count(o_orderkey) > 0 THEN 'drafted' ELSE 'received' END AS step FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def case_list_with_counts(t):
    """Each optional branch is counted before it is joined, so nothing fans out."""
    items = t.lineitem.groupBy("l_orderkey").agg(n().alias("items"))
    o = t.orders.join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_custkey").agg(n().alias("n_orders"), F.sum("items").alias("n_items"), F.bool_or(F.col("o_orderstatus") == "F").alias("final"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = t.customer.select("c_custkey").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", z("n_orders"), z("n_items"), "final")
    step = F.when(F.col("final"), "final").when(F.col("n_items") > 0, "judged").when(F.col("n_orders") > 0, "drafted").otherwise("received")
    return rows.select("c_custkey", "n_orders", "n_items", step.alias("step"))


@query("SELECT o_orderkey, l_partkey, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 2")
def compound_on_left_join(t):
    return t.orders.join(t.lineitem.where("l_linenumber = 2"), F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "l_partkey", "l_quantity")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_in_subquery(t):
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def anti_not_exists(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'O'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT r_name, n_name FROM (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY md5(r_name || n_name)) AS k FROM region, nation) WHERE k = 1")
def lateral_md5_pick(t):
    """The nation with the least md5 beside each region: the region has a handful of rows."""
    rows = t.nation.join(t.region)
    return rows.groupBy("r_name").agg(F.min(F.struct(F.md5(F.concat("r_name", "n_name").cast("binary")).alias("h"), "n_name"))["n_name"].alias("n_name"))


#: Names that texts are searched for: a fixed few.
SOUGHT = ["data", "license", "nicht", "pour", "system", "the"]


@query(f"SELECT name, doc_id FROM (VALUES {', '.join(f"('{x}')" for x in SOUGHT)}) v(name), documents WHERE contains(lower(text), name)")
def theta_contains_join(t):
    names = F.broadcast(t.spark.sql(f"SELECT * FROM VALUES {', '.join(f"('{x}')" for x in SOUGHT)} AS v(name)"))
    return t.documents.join(names, F.contains(F.lower("text"), F.col("name"))).select("name", "doc_id")


@query(r"SELECT rule, count(*)::BIGINT AS n FROM (VALUES ('money', '[0-9]+ ?(%|\$)'), ('mail', '[a-z0-9.]+@[a-z0-9.]+'), ('license', '(?i)licen[cs]e')) r(rule, pattern), documents WHERE regexp_matches(text, pattern) GROUP BY 1")
def theta_regex_join(t):
    rules = t.spark.sql(r"SELECT * FROM VALUES ('money', r'[0-9]+ ?(%|\$)'), ('mail', r'[a-z0-9.]+@[a-z0-9.]+'), ('license', r'(?i)licen[cs]e') AS t(rule, pattern)")
    met = matching.regex_join(t.documents, [r.pattern for r in rules.collect()])
    return t.documents.join(met, "text").join(rules, "pattern").groupBy("rule").agg(n().alias("n"))


@query("SELECT c_nationkey::BIGINT AS nation, c_custkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1")
def distinct_on_first(t):
    rows = t.customer.select(F.col("c_nationkey").cast("long").alias("nation"), "c_custkey", "c_name")
    return state.dedupe_first(rows, ["nation"], [F.col("c_custkey").alias("_by")])


@query("SELECT l_orderkey, l_linenumber::BIGINT AS line, i::BIGINT AS pair, item, result FROM (SELECT l_orderkey, l_linenumber, unnest([1, 2]) AS i, unnest([l_returnflag, l_linestatus]) AS item, unnest([l_tax, l_discount]) AS result FROM lineitem) WHERE item <> 'N'")
def unpivot_pairs(t):
    pairs = F.posexplode(F.array(F.struct(F.col("l_returnflag").alias("item"), F.col("l_tax").alias("result")), F.struct(F.col("l_linestatus").alias("item"), F.col("l_discount").alias("result"))))
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), pairs.alias("i", "p"))
    return rows.select("l_orderkey", "line", (F.col("i") + 1).cast("long").alias("pair"), "p.item", "p.result").where("item <> 'N'")


@query("WITH p AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role <> 'user') SELECT p.conv_id, p.turn, length(p.text)::BIGINT AS n_chars, count(r.text)::BIGINT AS n_replies, coalesce(string_agg(md5(r.text), '|' ORDER BY r.text), '') AS replies FROM p LEFT JOIN r USING (conv_id, turn) GROUP BY ALL")
def tree_nest_replies(t):
    c = t.conversations
    r = c.where("role <> 'user'").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(n("text").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list("text")), lambda x: F.md5(x.cast("binary"))), "|").alias("replies"))
    rows = c.where("role = 'user'").join(r, ["conv_id", "turn"], "left")
    return rows.select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"), F.coalesce("k", F.lit(0)).alias("n_replies"), F.coalesce("replies", F.lit("")).alias("replies"))


@query("SELECT conv_id, substr(min_by(text, turn), 1, 60) AS title, (count(*) FILTER (WHERE role = 'user'))::BIGINT AS asked, max(turn)::BIGINT AS last FROM conversations GROUP BY 1 ORDER BY last DESC, conv_id DESC LIMIT 50")
def session_list(t):
    g = t.conversations.groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 60).alias("title"), F.count_if(F.col("role") == "user").alias("asked"), F.max("turn").alias("last"))
    return g.orderBy(F.desc("last"), F.desc("conv_id")).limit(50)


@query("WITH m AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1) SELECT conv_id, (m + k)::BIGINT AS turn, CASE k WHEN 1 THEN 'user' ELSE 'assistant' END AS role FROM m, (VALUES (1), (2)) v(k)")
def session_append_seq(t):
    m = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("m"))
    return m.select("conv_id", "m", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select("conv_id", (F.col("m") + F.col("k")).alias("turn"), F.when(F.col("k") == 1, "user").otherwise("assistant").alias("role"))


@query("WITH t AS (SELECT greatest(1, ceil(count(*) / 10))::BIGINT AS pages FROM orders WHERE o_orderstatus = 'P') SELECT o_orderkey, least(greatest(1000, 1), pages)::BIGINT AS page FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'P'), t WHERE (r - 1) // 10 + 1 = least(greatest(1000, 1), pages)")
def page_clamped(t):
    """The page asked for (1000) is clamped to the last; no window sees more rows than the pages up to the one asked for have."""
    rows = t.orders.where("o_orderstatus = 'P'").select("o_orderkey")
    pages = rows.agg(F.least(F.lit(1000), F.greatest(F.lit(1), F.ceil(n() / 10))).cast("long").alias("page"))
    upto = search.top(rows, 1000 * 10, "o_orderkey")
    return upto.crossJoin(F.broadcast(pages)).where(F.ceil(F.col("r") / 10) == F.col("page")).select("o_orderkey", "page")


# Sinks and state ----------------------------------------------------------------------------------


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedupe_by_sha256(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"))


@query("WITH h AS (SELECT DISTINCT sha256(text) AS s FROM documents WHERE doc_id % 2 = 0) SELECT sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT s FROM h) GROUP BY 1")
def incremental_load_antijoin(t):
    """The odd documents are the batch, the even ones what is held."""
    keyed = t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))
    batch = keyed.where("doc_id % 2 = 1").groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
    return state.new_only(batch, keyed.where("doc_id % 2 = 0").select("sha256"), ["sha256"]).select("sha256", "doc_id")


_HALVES = "held AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 < 2), batch AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END AS v FROM orders WHERE o_orderkey % 3 > 0)"


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = t.orders
    held = o.where("o_orderkey % 3 < 2").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return held, o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("k"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END").alias("v"))


@query(f"WITH {_HALVES}, c AS (SELECT b.* FROM batch b LEFT JOIN held h USING (k) WHERE b.v IS DISTINCT FROM h.v) SELECT * FROM held WHERE k NOT IN (SELECT k FROM c) UNION ALL SELECT * FROM c")
def replace_on_change(t):
    return state.replace_changed(*_halves(t), "k", "v")


@query(f"WITH {_HALVES} SELECT * FROM batch UNION ALL SELECT * FROM held WHERE k NOT IN (SELECT k FROM batch)")
def upsert_latest(t):
    return state.upsert(*_halves(t), ["k"])


@query(f"WITH {_HALVES} SELECT * FROM held UNION ALL SELECT * FROM batch WHERE k NOT IN (SELECT k FROM held)")
def insert_ignore(t):
    held, batch = _halves(t)
    return held.unionByName(state.new_only(batch, held, ["k"]))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') THEN 'ready' ELSE 'review' END AS status FROM orders")
def status_machine(t):
    o = t.orders.select("o_orderkey", "o_orderstatus")
    open_ = t.lineitem.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("open", F.lit(True))
    return o.join(open_, "o_orderkey", "left").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "final").when(F.col("open").isNull(), "ready").otherwise("review").alias("status"))


@query("SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'view'")
def latest_state_picks(t):
    return state.latest(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).where("event_type <> 'view'").select("user_id", "event_type", "value")


@query("SELECT event_id, user_id, old, new FROM (SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old, event_type AS new FROM events) WHERE old <> new AND length(new) BETWEEN 2 AND 300 ORDER BY event_id DESC LIMIT 40")
def audit_pairs_recent(t):
    old = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t.events.select("event_id", "user_id", old.alias("old"), F.col("event_type").alias("new"))
    return rows.where((F.col("old") != F.col("new")) & F.length("new").between(2, 300)).orderBy(F.desc("event_id")).limit(40)


@query("SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1")
def cascade_delete(t):
    kept = state.cascade(t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), t.orders.where("o_orderstatus <> 'P'"), "o_orderkey")
    return kept.groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(n().alias("n"))


# Text, dates, JSON --------------------------------------------------------------------------------


def _masks() -> str:
    sql = "text"
    for p, by in tx.MASKS:
        sql = f"regexp_replace({sql}, '{p}', '{by}', 'g')"
    return sql


@query(f"SELECT doc_id, sha256({_masks()}) AS masked FROM documents")
def mask_pii(t):
    return t.documents.select("doc_id", F.sha2(tx.mask(F.col("text")), 256).alias("masked"))


_DIGITS = "'" + blocks.DIGIT + "'"
CORRECT_SQL = f"""WITH t AS (SELECT doc_id, translate(replace(translate(text, '{blocks.NOISE.replace("'", "''")}', ''), chr(10), ' '), '{"".join(blocks.SAFE)}', '{"".join(blocks.SAFE.values())}') AS t FROM documents),
c AS (SELECT doc_id, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS i FROM t),
near AS (SELECT *, lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS after,
  last_value(CASE WHEN c NOT IN ('O', 'l', 'B', 'S') THEN c END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
done AS (SELECT doc_id, i, CASE WHEN c IN ('O', 'l', 'B', 'S', 'ㅡ') AND (coalesce(regexp_matches(after, {_DIGITS}), false) OR coalesce(regexp_matches(before, {_DIGITS}), false)) THEN translate(c, 'OlBSㅡ', '0185-') ELSE c END AS c FROM near),
joined AS (SELECT doc_id, trim(regexp_replace(string_agg(c, '' ORDER BY i), '[\\s\\v\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS text FROM done GROUP BY 1)
SELECT doc_id, coalesce(length(j.text), 0)::BIGINT AS n_chars, sha256(coalesce(j.text, '')) AS corrected FROM documents LEFT JOIN joined j USING (doc_id)"""


@query(CORRECT_SQL)
def rule_correct_text(t):
    """In SQL by windows over single characters: the letters between a digit and here decide."""
    fixed = blocks.correct(F.col("text"))
    return t.documents.select("doc_id", F.length(fixed).cast("long").alias("n_chars"), F.sha2(fixed, 256).alias("corrected"))


@query(r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages")
def strip_markup(t):
    return t.pages.select("page_id", tx.strip_markup(F.col("html")).alias("text"))


@query(r"SELECT p_partkey, regexp_extract(p_brand, '#([0-9])', 1) AS major, array_to_string(regexp_extract_all(p_brand || ' ' || p_type, '[0-9]+|[A-Z]{3,}'), ',') AS codes FROM part")
def code_extract(t):
    codes = F.regexp_extract_all(F.concat_ws(" ", "p_brand", "p_type"), F.lit("[0-9]+|[A-Z]{3,}"), 0)
    return t.part.select("p_partkey", F.regexp_extract("p_brand", "#([0-9])", 1).alias("major"), F.array_join(codes, ",").alias("codes"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 3 THEN NULL WHEN o_orderkey % 5 = 2 THEN make_date(year(o_orderdate), month(o_orderdate), 15) ELSE o_orderdate::DATE END AS day FROM orders")
def tolerant_date_parse(t):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(k == 4, "unknown 12 of 7").when(k == 3, F.concat(F.date_format(d, "yyyy"), F.lit(".13.40"))).when(k == 2, F.date_format(d, "'No 7:' yyyy.M")).when(k == 1, F.date_format(d, "yyyy년 M월 d일")).otherwise(F.date_format(d, "'No 7:' yyyy. M. d"))
    return t.orders.select("o_orderkey", tx.tolerant_date(text).alias("day"))


@query("SELECT o_orderkey, min(abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)))::BIGINT AS gap, CASE WHEN min(l_shipdate) IS NULL THEN 'manual' WHEN min(abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE))) <= 92 THEN 'ok' ELSE 'lack' END AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def min_day_gap(t):
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    gap = F.min(F.abs(F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")))).cast("long").alias("gap")
    return rows.groupBy("o_orderkey").agg(gap).select("o_orderkey", "gap", F.when(F.col("gap").isNull(), "manual").when(F.col("gap") <= 92, "ok").otherwise("lack").alias("status"))


@query("SELECT event_type, count(*)::BIGINT AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def json_path_counts(t):
    return t.events.groupBy("event_type").agg(n().alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("total"))


@query("SELECT user_id, count(*)::BIGINT AS n, (count(*) FILTER (WHERE (props->>'$.k')::BIGINT > 50))::BIGINT AS marked FROM events GROUP BY 1")
def json_array_filter_size(t):
    items = F.collect_list(F.from_json("props", "struct<k:bigint>"))
    return t.events.groupBy("user_id").agg(items.alias("items")).select("user_id", F.size("items").cast("long").alias("n"), F.size(F.filter("items", lambda b: b["k"] > 50)).cast("long").alias("marked"))


_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"


@query(f"WITH {_LINES}, a AS (SELECT *, sum(CASE WHEN length(line) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM lines) SELECT doc_id, seg::BIGINT AS seg, min(i)::BIGINT AS first, max(i)::BIGINT AS last, sum(length(line))::BIGINT AS n_chars FROM a GROUP BY ALL")
def anchor_segments(t):
    """Short lines are anchors; a block ends before the next, and lines before the first are block 0. A document's lines stay in its row."""
    rows = t.documents.select("doc_id", F.transform(F.split("text", "\n", -1), lambda x: F.length(x)).alias("lens"))
    anchors = F.filter(F.sequence(F.lit(1), F.size("lens")), lambda i: F.element_at("lens", i) < 60)
    headless = F.element_at("lens", 1) >= 60
    rows = rows.select("doc_id", "lens", F.when(headless, F.concat(F.array(F.lit(1)), anchors)).otherwise(anchors).alias("begins"), F.when(headless, 0).otherwise(1).alias("from"))
    ends = F.transform("begins", lambda b, k: F.struct(b.alias("first"), (F.coalesce(F.get("begins", k + 1), F.size("lens") + 1) - 1).alias("last")))
    rows = rows.select("doc_id", "lens", "from", F.posexplode(ends).alias("k", "x"))
    chars = F.aggregate(F.slice("lens", F.col("x.first"), F.col("x.last") - F.col("x.first") + 1), F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.select("doc_id", (F.col("k") + F.col("from")).cast("long").alias("seg"), F.col("x.first").cast("long").alias("first"), F.col("x.last").cast("long").alias("last"), chars.alias("n_chars"))


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), nullif(props->>'$.k', ''), 'none') AS section FROM events")
def section_fallback(t):
    norm = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))
    filled = lambda c: F.nullif(c, F.lit(""))
    return t.events.select("event_id", F.coalesce(filled(norm), filled(F.get_json_object("props", "$.k")), F.lit("none")).alias("section"))


# Rules, graph, assembly ---------------------------------------------------------------------------


@query("WITH h AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS held FROM lineitem GROUP BY 1) SELECT k, array_to_string(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(held, x)), ',') AS missing FROM h")
def missing_docs(t):
    need = F.array(*map(F.lit, ("A", "N", "R")))
    held = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("held"))
    return held.select("k", F.array_join(F.filter(need, lambda x: ~F.array_contains("held", x)), ",").alias("missing"))


_RULES = [("dated", "auto", "^(A|R)"), ("open", "doc", "^N"), ("any", "manual", ".")]


@query("WITH r(rule, kind, pattern) AS (VALUES ('dated', 'auto', '^(A|R)'), ('open', 'doc', '^N'), ('any', 'manual', '.')) SELECT l_orderkey AS k, rule, CASE kind WHEN 'auto' THEN CASE WHEN min(abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE))) <= 60 THEN 'ok' ELSE 'lack' END WHEN 'doc' THEN CASE WHEN bool_or(l_linestatus = 'F') THEN 'ok' ELSE 'lack' END ELSE 'manual' END AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey, r WHERE regexp_matches(l_returnflag || l_linestatus, pattern) GROUP BY l_orderkey, rule, kind")
def rule_check(t):
    """Rules (a fixed few) meet every line; each case's facts are combined before they move."""
    rules = F.broadcast(t.spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in _RULES) + " AS t(rule, kind, pattern)"))
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    hit = rows.join(rules, F.rlike(F.concat("l_returnflag", "l_linestatus"), F.col("pattern")))
    gap = F.min(F.abs(F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))))
    g = hit.groupBy(F.col("l_orderkey").alias("k"), "rule", "kind").agg(gap.alias("gap"), F.bool_or(F.col("l_linestatus") == "F").alias("has"))
    ok = lambda c: F.when(c, "ok").otherwise("lack")
    return g.select("k", "rule", F.when(F.col("kind") == "auto", ok(F.col("gap") <= 60)).when(F.col("kind") == "doc", ok(F.col("has"))).otherwise("manual").alias("status"))


_GRADE = "CASE WHEN p_size % 4 = 0 THEN 'grade ' || (p_size % 7 + 1) WHEN p_size % 4 = 1 THEN (p_size % 7 + 1) || '-1-0101' WHEN p_size % 4 = 2 THEN 'below' ELSE '' END"


def severity(grade: Column) -> Column:
    """The digit after 'grade ' or before a hyphen at the start; 99 for everything else."""
    return F.coalesce(F.regexp_extract(grade, r"grade (\d)", 1).try_cast("int"), F.regexp_extract(grade, r"^(\d)-", 1).try_cast("int"), F.lit(99)).cast("long")


@query(f"WITH g AS (SELECT p_brand, {_GRADE} AS grade, p_partkey FROM part), s AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(grade, 'grade ([0-9])', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(grade, '^([0-9])-', 1), '') AS BIGINT), 99) AS sev FROM g) SELECT p_brand, min(sev)::BIGINT AS worst, (count(*) FILTER (WHERE sev = 7))::BIGINT AS sevens, CASE WHEN count(*) FILTER (WHERE sev = 7) >= 3 THEN 6 ELSE min(sev) END::BIGINT AS total FROM s WHERE sev < 99 GROUP BY 1")
def severity_total_grade(t):
    s = t.part.select("p_brand", severity(F.expr(_GRADE)).alias("sev")).where("sev < 99")
    g = s.groupBy("p_brand").agg(F.min("sev").alias("worst"), F.count_if(F.col("sev") == 7).alias("sevens"))
    return g.select("p_brand", "worst", "sevens", F.when(F.col("sevens") >= 3, 6).otherwise(F.col("worst")).cast("long").alias("total"))


@query("SELECT p_partkey, CASE WHEN b = 99 THEN CASE WHEN a < 99 THEN '등급기준미달' END WHEN a = 99 THEN '승급(기준미달→등급)' WHEN b < a THEN '승급' WHEN b > a THEN '하향' ELSE '직전등급 유지' END AS label, coalesce(nullif(trim(m), '-'), e, 'predicted') AS proposed FROM (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 99 ELSE p_size % 7 + 1 END AS a, CASE WHEN p_size % 3 = 0 THEN 99 ELSE p_size % 5 + 1 END AS b, CASE p_size % 3 WHEN 0 THEN 'manual' WHEN 1 THEN ' - ' END AS m, CASE WHEN p_size % 2 = 0 THEN 'exam' END AS e FROM part)")
def updown_labels(t):
    a, size = F.when(F.col("p_size") % 4 == 0, 99).otherwise(F.col("p_size") % 7 + 1), F.col("p_size")
    b = F.when(size % 3 == 0, 99).otherwise(size % 5 + 1)
    manual = F.when(size % 3 == 0, "manual").when(size % 3 == 1, " - ")
    return t.part.select("p_partkey", prediction.updown(a, b).alias("label"), F.coalesce(F.nullif(F.trim(manual), F.lit("-")), F.when(size % 2 == 0, "exam"), F.lit("predicted")).alias("proposed"))


@query("WITH s AS (SELECT o_orderkey, sum(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END) AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_orderkey, score::BIGINT AS score, CASE WHEN score > 0 THEN 'likely' WHEN score >= 0 THEN 'open' ELSE 'unlikely' END AS label, CASE WHEN abs(score) >= 2 THEN 'high' ELSE 'low' END AS confidence FROM s")
def axis_predict(t):
    sign = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(sign).cast("long").alias("score")).join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi")
    c = F.col("score")
    return s.select("o_orderkey", "score", F.when(c > 0, "likely").when(c >= 0, "open").otherwise("unlikely").alias("label"), F.when(F.abs(c) >= 2, "high").otherwise("low").alias("confidence"))


def _graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    nodes = graph.nodes(
        t.region.select(F.lit("region").alias("ntype"), F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")),
        t.nation.select(F.lit("nation").alias("ntype"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")),
        t.customer.select(F.lit("customer").alias("ntype"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name")),
        t.part.select(F.lit("code").alias("ntype"), F.col("p_brand").alias("key"), F.col("p_brand").alias("name")),
    )
    codes = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    edges = graph.edges(t.nation, "IN", ("nation", "n_nationkey"), ("region", "n_regionkey"))
    edges = edges.unionByName(graph.edges(t.customer, "FROM", ("customer", "c_custkey"), ("nation", "c_nationkey")))
    edges = edges.unionByName(graph.edges(t.orders, "HAS", ("customer", "o_custkey"), ("order", "o_orderkey")))
    return nodes, edges.unionByName(graph.edges(codes, "CODED", ("order", "l_orderkey"), ("code", "p_brand")))


@query("SELECT ntype, key, name FROM (SELECT 'region' AS ntype, r_regionkey::VARCHAR AS key, r_name AS name FROM region UNION ALL SELECT 'nation', n_nationkey::VARCHAR, n_name FROM nation UNION ALL SELECT 'customer', c_custkey::VARCHAR, c_name FROM customer UNION SELECT 'code', p_brand, p_brand FROM part)")
def graph_nodes(t):
    return _graph(t)[0]


@query("SELECT etype, stype, dtype, count(*)::BIGINT AS n, count(DISTINCT (skey, dkey))::BIGINT AS different FROM (SELECT 'IN' AS etype, 'nation' AS stype, n_nationkey::VARCHAR AS skey, 'region' AS dtype, n_regionkey::VARCHAR AS dkey FROM nation UNION ALL SELECT 'FROM', 'customer', c_custkey::VARCHAR, 'nation', c_nationkey::VARCHAR FROM customer UNION ALL SELECT 'HAS', 'customer', o_custkey::VARCHAR, 'order', o_orderkey::VARCHAR FROM orders UNION ALL SELECT 'CODED', 'order', l_orderkey::VARCHAR, 'code', p_brand FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1, 2, 3")
def graph_edges(t):
    e = _graph(t)[1].groupBy("etype", "stype", "dtype", "skey", "dkey").agg(n().alias("k"))
    return e.groupBy("etype", "stype", "dtype").agg(F.sum("k").alias("n"), n().alias("different"))


@query("SELECT DISTINCT c_custkey::VARCHAR AS customer, n_regionkey::VARCHAR AS region FROM customer JOIN nation ON n_nationkey = c_nationkey")
def graph_two_hop(t):
    _, e = _graph(t)
    start = t.customer.select(F.col("c_custkey").cast("string").alias("customer"))
    return graph.hop(graph.hop(start, e, "FROM", "customer", "nation"), e, "IN", "nation", "region").select("customer", "region").distinct()


@query("SELECT l_orderkey::VARCHAR AS skey, count(DISTINCT p_brand)::BIGINT AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def graph_conflicts(t):
    return graph.conflicts(_graph(t)[1], "CODED", "skey", "dkey")


@query("WITH e AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT x.o::VARCHAR AS id, count(*)::BIGINT AS shared, array_to_string(list_sort(list(x.b)), ',') AS codes FROM e x JOIN e y ON x.b = y.b AND y.o = (SELECT min(o_orderkey) FROM orders) WHERE x.o <> y.o GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def graph_shared_codes(t):
    e = _graph(t)[1].where("etype = 'CODED'").select("skey", "dkey").distinct()
    one = F.broadcast(t.orders.agg(F.min("o_orderkey").cast("string").alias("skey")))
    mine = e.join(one, "skey").select(F.col("skey").alias("own"), "dkey")
    g = e.join(mine, "dkey").where("skey <> own").groupBy(F.col("skey").alias("id")).agg(n().alias("shared"), F.array_join(F.array_sort(F.collect_list("dkey")), ",").alias("codes"))
    return g.orderBy(F.desc("shared"), "id").limit(20)


@query("SELECT c_custkey::VARCHAR AS customer, count(DISTINCT o_orderkey)::BIGINT AS n_orders, count(DISTINCT p_brand)::BIGINT AS n_codes FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1")
def graph_optional_hops(t):
    """Each branch is counted before it is joined, so nothing fans out."""
    _, e = _graph(t)
    has = e.where("etype = 'HAS'").select(F.col("skey").alias("customer"), F.col("dkey").alias("order")).distinct()
    codes = graph.hop(has, e.where("etype = 'CODED'").distinct(), "CODED", "order", "code").select("customer", "code").distinct()
    start = t.customer.select(F.col("c_custkey").cast("string").alias("customer"))
    rows = start.join(has.groupBy("customer").agg(n().alias("n_orders")), "customer", "left").join(codes.groupBy("customer").agg(n().alias("n_codes")), "customer", "left")
    return rows.select("customer", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_codes", F.lit(0)).alias("n_codes"))


@query(f"SELECT 'topic' AS ntype, name AS key, count(*)::BIGINT AS n FROM (VALUES {', '.join(f"('{x}')" for x in SOUGHT)}) v(name), documents WHERE contains(' ' || lower(text) || ' ', ' ' || name || ' ') GROUP BY ALL")
def graph_entity_match(t):
    """Nodes whose whole name stands between spaces: a question's words meet the names by equality."""
    nodes = t.spark.sql(f"SELECT 'topic' AS ntype, name AS key FROM VALUES {', '.join(f"('{x}')" for x in SOUGHT)} AS v(name)")
    said = t.documents.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " ", -1))).alias("key"))
    return said.join(nodes, "key").groupBy("ntype", "key").agg(n().alias("n"))


@query("SELECT c_custkey AS app, kind, title, bool_or(final) AS final FROM (SELECT o_custkey AS c_custkey, 'order' AS kind, o_orderpriority AS title, o_orderstatus = 'F' AS final FROM orders UNION ALL SELECT o_custkey, 'item', l_returnflag, l_linestatus = 'F' FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT c_custkey, 'profile', c_mktsegment, true FROM customer) GROUP BY 1, 2, 3")
def file_register(t):
    o = t.orders.select(F.col("o_custkey").alias("app"), F.lit("order").alias("kind"), F.col("o_orderpriority").alias("title"), (F.col("o_orderstatus") == "F").alias("final"))
    i = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("app"), F.lit("item").alias("kind"), F.col("l_returnflag").alias("title"), (F.col("l_linestatus") == "F").alias("final"))
    c = t.customer.select(F.col("c_custkey").alias("app"), F.lit("profile").alias("kind"), F.col("c_mktsegment").alias("title"), F.lit(True).alias("final"))
    return o.unionByName(i).unionByName(c).groupBy("app", "kind", "title").agg(F.bool_or("final").alias("final"))


@query("SELECT o_orderkey, 'Order ' || o_orderkey || ' (' || o_orderstatus || '): ' || string_agg(l_linenumber || '=' || l_returnflag, '; ' ORDER BY l_linenumber, l_returnflag) AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus")
def fact_sheet_lines(t):
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("items"))
    text = F.array_join(F.transform("items", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit("="), x["l_returnflag"])), "; ")
    rows = t.orders.join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" ("), "o_orderstatus", F.lit("): "), text).alias("line"))


@query("SELECT lang, count(*)::BIGINT AS n, round(avg((quality = 1)::INT), 6) AS good, round(avg((toxic = 1)::INT), 6) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())")
def field_accuracy(t):
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    share = lambda c: F.round(F.avg((F.col(c) == 1).cast("int")), 6)
    return rows.rollup("lang").agg(n().alias("n"), share("quality").alias("good"), share("toxic").alias("toxic"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(t):
    return windows.tumbling(t.events).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM b GROUP BY user_id, s")
def events_session(t):
    return windows.sessions(t.events).withColumn("start", F.col("start").cast("timestamp_ntz"))


# Ingest and extraction ----------------------------------------------------------------------------


_CHAIN = ", ".join(["sha256(content) AS h0", *(f"sha256(unhex(h{k - 1})) AS h{k}" for k in range(1, 32))])
_EMBED_SQL = f"""WITH h AS (SELECT doc_id, seq, {_CHAIN} FROM ({CHUNKS_SQL})),
b AS (SELECT doc_id, seq, list_transform(range(1, 2048, 2), lambda i: ('0x' || substr({" || ".join(f"h{k}" for k in range(32))}, i, 2))::INT / 255.0::DOUBLE - 0.5::DOUBLE) AS v FROM h)
SELECT doc_id, seq, len(v)::BIGINT AS dim, len(list_filter(v, lambda x: x > 0))::BIGINT AS n_positive, round(v[1] / sqrt(list_dot_product(v, v)), 3) + 0.0::DOUBLE AS first, round(v[1024] / sqrt(list_dot_product(v, v)), 3) + 0.0::DOUBLE AS last FROM b"""


@query(_EMBED_SQL)
def embed_chunks(t):
    """Chunks with their hash vectors: size, positive components, the first and the last one."""
    v = F.col("embedding")
    one = lambda x: F.round(x.cast("double"), 3) + F.lit(0.0)  # no negative zero
    rows = ingest.embed(search.chunk_documents(t.documents))
    return rows.select("doc_id", "seq", F.size(v).cast("long").alias("dim"), F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("n_positive"), one(F.get(v, F.lit(0))).alias("first"), one(F.element_at(v, -1)).alias("last"))


@query("WITH f AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text), n AS (SELECT * FROM f WHERE doc_id % 2 = 1 OR text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)) SELECT doc_id, (greatest(length(text) - 151, 0) // 1050 + 1)::BIGINT AS n_chunks FROM n WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0) AND length(text) > 0")
def ingest_new_documents(t):
    """All documents arrive while the even ones are held; confident blocks aren't corrected."""
    rows = t.documents.select("doc_id", F.lit(0).alias("seq"), F.lit("paragraph").alias("type"), "text", F.lit(1).alias("page"), F.lit(1.0).alias("confidence"))
    held = t.documents.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("sha256"))
    return ingest.load(rows, held).groupBy("doc_id").agg(n().alias("n_chunks"))


_EDITED_SQL = CHUNKS_SQL.replace("FROM documents WHERE length(text) > 0", "FROM (SELECT doc_id, text || ' end' AS text FROM documents WHERE doc_id % 3 = 0 AND length(text) > 0)")


@query(f"WITH c AS ({CHUNKS_SQL}), e AS ({_EDITED_SQL}) SELECT doc_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE content NOT IN (SELECT content FROM c))::BIGINT AS embedded FROM e GROUP BY doc_id")
def reindex_chunks(t):
    """All documents are held; every third one comes again with a word more, and only its changed chunks are embedded."""
    held = ingest.embed(search.chunk_documents(t.documents).select(F.sha2("content", 256).alias("sha256"), "content"), dim=32)
    batch = t.documents.where("doc_id % 3 = 0 AND length(text) > 0").select("doc_id", F.lit(0).alias("seq"), F.lit("paragraph").alias("type"), F.concat("text", F.lit(" end")).alias("text"), F.lit(1).alias("page"), F.lit(1.0).alias("confidence"))
    rows = ingest.reindexed(batch, held, dim=32)
    return rows.groupBy("doc_id").agg(n().alias("n"), F.count_if("fresh").alias("embedded"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -o_orderkey, 'Y' FROM orders WHERE o_orderkey % 50 = 1")
def stored_upsert(t):
    """Orders stored by key; a batch changes and adds some, and the table is read back."""
    table = state.KeyedTable(t.spark, fresh_dir(t.spark, "orders"), ["o_orderkey"], 16)
    table.create(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status")))
    k = F.col("o_orderkey")
    batch = t.orders.where(k % 50 < 2).select(F.when(k % 50 == 0, k).otherwise(-k).alias("o_orderkey"), F.when(k % 50 == 0, "X").otherwise("Y").alias("status"))
    table.upsert(batch, [F.desc("status")])
    return table.read()


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, round(sum(CASE WHEN starts_with(o_orderpriority, '1') THEN 1 ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1")
def stored_reload(t):
    """Orders stored by priority; those of one priority are loaded again, with another price."""
    at = fresh_dir(t.spark, "priorities")
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority")
    rows.write.partitionBy("o_orderpriority").parquet(at)
    state.overwrite_parts(rows.where("startswith(o_orderpriority, '1')").withColumn("o_totalprice", F.lit(1.0)), at, "o_orderpriority")
    return t.spark.read.parquet(at).groupBy("o_orderpriority").agg(n().alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT k, n_segments FROM (SELECT c_custkey AS k, count(o_orderkey)::BIGINT AS n_segments FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def exam_report_segments(t):
    """Reports written from each customer's orders and parsed again."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    part = F.concat(day, F.lit(" "), day, F.lit("\nEXAM: "), "o_orderpriority", F.lit("\nFINDING\n\n"), "o_orderstatus")
    docs = t.orders.select("o_custkey", "o_orderkey", part.alias("part")).groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "part"))), lambda x: x["part"]), "\n").alias("text"))
    return extract.exam_reports(docs).groupBy(F.col("doc_id").alias("k")).agg(n().alias("n_segments"))


# Text sources and records -------------------------------------------------------------------------

_PARAGRAPHS = r"SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t\r\n\f]*\n'), lambda p: trim(regexp_replace(p, '[ \t\r\n\f]+', ' ', 'g'))), lambda p: length(p) >= 20) AS ps FROM documents"


@query(f"SELECT doc_id, (i // 8 + 1)::BIGINT AS page, count(*)::BIGINT AS n_blocks, sum(length(p))::BIGINT AS n_chars FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(0, len(ps))) AS i FROM ({_PARAGRAPHS})) GROUP BY ALL")
def manual_pages(t):
    rows = texts.manual_blocks(t.documents)
    return rows.groupBy("doc_id", F.col("page").cast("long").alias("page")).agg(n().alias("n_blocks"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("SELECT doc_id, i::BIGINT AS seq, sha256(substr(text, (i * 1200 - 1199)::INT, 1200)) AS slice FROM (SELECT doc_id, text, unnest(range(1, least(20, ceil(length(text) / 1200))::BIGINT + 1)) AS i FROM documents) WHERE regexp_matches(substr(text, (i * 1200 - 1199)::INT, 1200), '[^ \t\r\n\f]')")
def precedent_slices(t):
    none = F.lit(None).cast("string")
    items = t.documents.select("doc_id", F.col("source").alias("case_no"), none.alias("court"), none.alias("date"), none.alias("title"), none.alias("gist"), F.col("text").alias("body"))
    return texts.precedent_blocks(items).where("seq > 0").select("doc_id", F.col("seq").cast("long").alias("seq"), F.sha2("text", 256).alias("slice"))


def _scans(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders stand in for scans, their lines for blocks; every third line has no disease."""
    docs = t.orders.select(F.col("o_orderkey").alias("scan_id"), F.lit(None).cast("string").alias("reg_no"), F.lit("p").alias("person"), F.lit("h").alias("hospital"), F.lit("k").alias("kind"), F.lit("").alias("text"))
    day, disease = F.date_format("l_shipdate", "yyyy-MM-dd"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_returnflag"))
    none = F.lit(None).cast("string")
    fields = F.struct(day.alias("date"), disease.alias("disease"), F.col("l_linestatus").alias("grade"), none.alias("exam_kind"), none.alias("exam_dept"), none.alias("opinion"), none.alias("kcd")).cast(scans.FIELDS)
    rows = t.lineitem.select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").cast("int").alias("seq"), F.lit("t").alias("title"), F.col("l_linenumber").cast("int").alias("line"), F.lit("").alias("excerpt"), fields.alias("fields"), F.lit(None).cast(scans.NORM).alias("norm"))
    return docs, rows


_FIRST = "SELECT l_orderkey, (min((l_linenumber, l_returnflag)) FILTER (WHERE l_linenumber % 3 > 0))[2] AS disease, min((l_linenumber, l_linestatus))[2] AS grade, min((l_linenumber, l_shipdate))[2] AS d FROM lineitem GROUP BY 1"


@query(f"SELECT 'RD' || o_orderkey AS recv_no, coalesce(disease, '질병명 미상') AS name, strftime(d, '%Y.%m') AS onset, grade FROM orders JOIN ({_FIRST}) ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 1")
def scan_cases(t):
    """The even scans have an application already."""
    docs, rows = _scans(t)
    held = docs.where("scan_id % 2 = 0").select(F.concat(F.lit("RD"), F.col("scan_id").cast("string")).alias("recv_no"), F.col("scan_id").alias("app_id"))
    return scans.cases(docs, rows, held)["disabilities"].select("recv_no", "name", "onset", "grade")


@query(f"SELECT o_orderkey AS scan_id, coalesce(disease, '질병명 미상') AS injury, grade AS exam_grade, '재확인' AS exam_kind FROM orders JOIN ({_FIRST}) ON l_orderkey = o_orderkey")
def scan_agendas(t):
    docs, rows = _scans(t)
    held = t.spark.createDataFrame([], "agenda_no string, agenda_id long")
    return scans.agendas(docs, rows, held).select("scan_id", "injury", "exam_grade", "exam_kind")


@query("SELECT o_orderkey::VARCHAR AS scan_id, 0::BIGINT AS seq, '진단서' AS title, 3::BIGINT AS line, '진단서 질병명 ' || o_orderpriority || ' ' || strftime(o_orderdate, '%Y-%m-%d') AS excerpt, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS disease FROM orders")
def bundle_blocks(t):
    """Bundles written from orders and split again."""
    text = F.concat(F.lit("성명\n홍길동\n진 단서\n질병명\n\n"), "o_orderpriority", F.lit("\n"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = intake.bundle_blocks(t.orders.select(F.col("o_orderkey").cast("string").alias("file_name"), text.alias("text")))
    return rows.select("scan_id", F.col("seq").cast("long").alias("seq"), "title", F.col("line").cast("long").alias("line"), F.replace("excerpt", F.lit("진 단서"), F.lit("진단서")).alias("excerpt"), "fields.date", "fields.disease")


@query("SELECT l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linestatus, l_returnflag) - 1)::BIGINT AS seq, l_linestatus || ' ' || l_linenumber || ' 여부' AS item, l_returnflag AS subs FROM lineitem")
def checklist_items(t):
    """Checklists written from the lines of orders and read again."""
    part = F.concat("l_linestatus", F.lit("\n"), F.col("l_linenumber").cast("string"), F.lit(" 여부\n- "), "l_returnflag")
    docs = t.lineitem.select("l_orderkey", "l_linenumber", part.alias("part")).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit("검토서 체크리스트\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "part"))), lambda x: x["part"]), "\n")).alias("text"))
    return texts.checklists(docs).select("doc_id", F.col("seq").cast("long").alias("seq"), "item", F.array_join("subs", ",").alias("subs"))


@query("SELECT (o_orderkey + 111 * j)::VARCHAR AS recv_no, CASE WHEN j = 0 THEN o_orderdate::DATE ELSE make_date(year(o_orderdate), least(month(o_orderdate) + j, 12), greatest(least(day(o_orderdate) - 3 * j, 28), 1)) END AS meeting_date, (CASE WHEN j = 1 THEN '우측 ' ELSE '좌측 ' END) || o_orderpriority AS disease_name, o_orderstatus AS body_part, 'g' AS grade FROM orders, range(0, 3) AS r(j)")
def grade_variants(t):
    pool = t.orders.select(F.col("o_orderkey").cast("string").alias("recv_no"), F.col("o_orderdate").alias("meeting_date"), F.concat(F.lit("좌측 "), "o_orderpriority").alias("disease_name"), F.col("o_orderstatus").alias("body_part"), F.lit("g").alias("grade"))
    return generate.grade_variants(pool)


@query("SELECT o_orderkey, '심의유형: ' || o_orderpriority || ' / 심의내용: ' || o_orderstatus || ' / 판단대상: (단일)' || chr(10) || '상이처(KCD): 없음' || chr(10) || '적용 조문(주문):' || chr(10) || string_agg('  - ' || l_linenumber || ' -> ' || l_returnflag || ' (표준문안 ' || l_linestatus || ')', chr(10) ORDER BY l_linenumber, l_returnflag, l_linestatus) || chr(10) || '조문 원문 근거:' || chr(10) || '담당 분과: 없음 (없음)' || chr(10) || '동일 상이처 과거 판정:' AS text FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderstatus")
def fact_sheets(t):
    """Orders stand in for cases, their lines for the clauses that apply."""
    row = F.struct("l_linenumber", F.col("l_returnflag").alias("result"), F.col("l_linestatus").alias("standard"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x["l_linenumber"].cast("string").alias("clause"), x["result"].alias("result"), x["standard"].alias("standard"))).alias("orders"))
    none = {"target": "string", "codes": "array<struct<code:string,disease:string>>", "passages": "array<struct<clause:string,content:string,source:string,page:int>>", "team": "string", "specialty": "string", "criteria": "array<struct<content:string,source:string>>", "similar": "array<struct<case_id:string,decision:string,shared:int>>"}
    cases = t.orders.join(rows, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.col("o_orderpriority").alias("review_type"), F.col("o_orderstatus").alias("review_content"), "orders", *[F.lit(None).cast(k).alias(c) for c, k in none.items()])
    return cases.select("o_orderkey", dossiers.fact_sheet().alias("text"))
