"""Queries of the case review over the driver's tables and the SQL that each must equal: clauses, rules, prediction, edits, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import clauses, graph_facts, instance_graph, prediction, questions, records, rules, search, state
from .queries import COSINE_SQL, TOKENS_SQL, Tables, n, query
from .sources import tables


def _pick(c: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(c, F.lit(len(values))) + 1).cast("int"))


def _case(c: str, values: list[str]) -> str:
    return f"CASE {c} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


# Clauses ------------------------------------------------------------------------------------------

_NAMES = ["예우법", "보상법", "보상자법", "고엽제법", "민법"]
_FULL = "CASE law " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in clauses.LAWS.items()) + " END"
_SHORT_SQL = f"SELECT o_orderkey AS k, {_case('o_orderkey', _NAMES)} AS law, o_orderkey % 90 AS a, o_orderkey % 7 AS b, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 END AS c FROM orders"
_REF_SQL = f"SELECT *, law || ' ' || a || '-' || b || coalesce('-' || c, '') AS short, '제' || a || '조제' || b || '항' || coalesce('제' || c || '호', '') AS ref, {_FULL} AS long FROM ({_SHORT_SQL})"


def _questions(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    s = lambda m: (k % m).cast("string")
    short = F.concat(_pick(k, _NAMES), F.lit(" "), s(90), F.lit("-"), s(7), F.when(k % 2 == 0, F.concat(F.lit("-"), s(5))).otherwise(""))
    return t.orders.select(k.alias("k"), F.concat(F.lit("see "), short, F.lit(", and "), short, F.lit("!")).alias("text"))


@query(f"SELECT k, 'see ' || x || ', and ' || x || '!' AS expanded, true AS has FROM (SELECT k, law || ' ' || ref || coalesce(' ' || long, '') AS x FROM ({_REF_SQL}))")
def clause_expand(t):
    return _questions(t).select("k", clauses.expand_clauses(F.col("text")).alias("expanded"), clauses.has_clause(F.col("text")).alias("has"))


@query(f"SELECT k, x || ' / ' || x AS notes FROM (SELECT k, '''' || short || ''' = ' || law || ' ' || ref || coalesce(' (' || long || ')', '') AS x FROM ({_REF_SQL}))")
def clause_notes(t):
    return _questions(t).select("k", F.array_join(clauses.clause_notes(F.col("text")), " / ").alias("notes"))


_DUTIES = ["병사", "부사관", "장교", "경찰", "공무원"]


@query(f"SELECT o_orderkey, merit, compensation FROM (SELECT o_orderkey, o_orderkey % 5 < 4 AS soldier, o_orderstatus = 'F' AS died FROM orders) JOIN (VALUES {', '.join(f"({str(s).lower()}, {str(d).lower()}, '{a}', '{b}')" for (s, d), (a, b) in clauses.BY_DUTY.items())}) v(soldier, died, merit, compensation) USING (soldier, died)")
def clause_by_duty(t):
    both = clauses.clauses_for(_pick(F.col("o_orderkey"), _DUTIES), F.col("o_orderstatus") == "F")
    return t.orders.select("o_orderkey", both.alias("c")).select("o_orderkey", "c.merit", "c.compensation")


def _lexical_sql(name: str, terms: list[str], where: str, most: int) -> str:
    listed = ", ".join(f"'{x}'" for x in terms)
    return f"""{name}_tf AS (SELECT doc_id, term, count(*) AS tf FROM ({TOKENS_SQL}) JOIN documents USING (doc_id) WHERE term IN ({listed}) AND {where} GROUP BY ALL),
{name}_s AS (SELECT doc_id, round(sum(0.1 * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493406685 / {len(terms)}), 9) AS score FROM {name}_tf GROUP BY doc_id),
{name} AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM {name}_s QUALIFY r <= {most})"""


def _search(docs: DataFrame, most: int) -> questions.Search:
    """Searches any frame of questions in the given documents."""

    def search_all(asked: DataFrame) -> DataFrame:
        found = search.lexical_multi(docs, asked.select(F.col("id").alias("query_id"), tx.or_terms(F.col("text")).alias("terms")))
        return search.top_each(found, most, F.desc("score"), "doc_id").select(F.col("query_id").alias("id"), "doc_id", "r")

    return search_all


def _one(t: Tables, text: str) -> DataFrame:
    return t.spark.createDataFrame([(0, text)], "id long, text string")


#: Stands in for the law's full name, so that writing a clause out finds something in these texts.
_LAWS = {"예우법": "der und"}


@query(f"WITH {_lexical_sql('plain', ['the', '예우법', '4-1-6'], 'true', 5)}, {_lexical_sql('law', ['the', '예우법', '제4조제1항제6호', 'der', 'und'], "lang = 'de'", 3)} SELECT doc_id, row_number() OVER (ORDER BY list, r)::BIGINT AS r FROM (SELECT doc_id, 0 AS list, r FROM law UNION ALL SELECT doc_id, 1, r FROM plain WHERE doc_id NOT IN (SELECT doc_id FROM law)) QUALIFY r <= 10")
def law_first_hits(t):
    """The question names a clause, so what the German texts (standing in for laws) say of it comes first."""
    return questions.law_first(_one(t, "the 예우법 4-1-6"), _search(t.documents, 5), _search(t.documents.where("lang = 'de'"), 3), laws=_LAWS).select("doc_id", "r")


def answered(asked: DataFrame) -> DataFrame:
    """Stands in for a model: cites the first hit, or says that there is no evidence."""
    return asked.select("id", F.when(F.size("hits") > 0, F.concat(F.lit("see ["), F.get("hits", F.lit(0)).cast("string"), F.lit(" p.1]"))).otherwise(clauses.NO_EVIDENCE).alias("said"))


@query(f"WITH {_lexical_sql('found', ['예우법', '제4조제1항', 'der', 'und'], 'true', 5)} SELECT doc_id, r::BIGINT AS r, 1::BIGINT AS retried FROM found")
def retry_new_evidence(t):
    """The short form finds nothing, the written-out one does; the answer then stands."""
    asked = _one(t, "예우법 4-1")
    got = questions.answers(asked, _search(t.documents, 5), answered, laws=_LAWS)
    return got.select(F.posexplode("hits").alias("r", "doc_id"), F.col("retried").cast("long").alias("retried")).select("doc_id", (F.col("r") + 1).cast("long").alias("r"), "retried")


@query(r"WITH x AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}\-]+'), lambda t: regexp_matches(t, '[\p{L}\p{N}]')) AS l FROM benchmark) SELECT item_id, array_to_string(CASE WHEN len(l) > 0 THEN list_filter(l, lambda v, i: list_position(l, v) = i) ELSE ['___none___'] END, ' | ') AS terms FROM x")
def or_terms(t):
    return t.benchmark.select("item_id", F.array_join(tx.or_terms(F.col("text")), " | ").alias("terms"))


_POOL_SQL = f"""WITH {_lexical_sql('sparse', ['the', 'that', 'and', 'pour', 'nicht'], "lang = 'fr'", 50)},
dense AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS r FROM ({COSINE_SQL}) WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'fr') QUALIFY r <= 50),
fused AS (SELECT doc_id, round(sum(s), 9) AS score FROM (SELECT doc_id, 1.0::DOUBLE / (60 + r) AS s FROM dense UNION ALL SELECT doc_id, 0.5::DOUBLE / (60 + r) FROM sparse) GROUP BY doc_id)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS r FROM fused QUALIFY r <= 5"""


@query(_POOL_SQL)
def hybrid_rrf_pool(t):
    return search.hybrid(t.documents, t.embeddings, t.embeddings.where("vec_id = 0"), ["the", "that", "and", "pour", "nicht"], pool=F.col("lang") == "fr")


# Rules --------------------------------------------------------------------------------------------

_CONTENTS = ["자해 사고", "고엽제 질환", "사망", "전상", "무릎 부상", "허리"]
_PREFIXES = {"2": ["Brand#2"], "3": ["Brand#1"], "4": ["Brand#4"], "5": ["Brand#5"]}


@query(f"SELECT p_partkey, CASE WHEN contains(x, '자해') THEN '5' WHEN contains(x, '고엽제') THEN '4' WHEN contains(x, '사망') AND regexp_matches(c, '^[CEFIJK]') THEN '4' WHEN contains(x, '전상') THEN '1' WHEN starts_with(c, 'BRAND#1') THEN '3' WHEN starts_with(c, 'BRAND#2') THEN '2' WHEN starts_with(c, 'BRAND#4') THEN '4' WHEN starts_with(c, 'BRAND#5') THEN '5' ELSE '1' END AS committee FROM (SELECT p_partkey, {_case('p_partkey', _CONTENTS)} AS x, upper(CASE WHEN p_partkey % 4 = 0 THEN 'C' || p_brand ELSE p_brand END) AS c FROM part)")
def route_committee(t):
    code = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("C"), "p_brand")).otherwise(F.col("p_brand"))
    prefixes = {k: [p.upper() for p in v] for k, v in _PREFIXES.items()}
    return t.part.select("p_partkey", rules.route(F.array(code), _pick(F.col("p_partkey"), _CONTENTS), prefixes).alias("committee"))


#: jr_id, subcommittee, pattern, axis, condition, check_kind, required documents, basis. One pattern can't be compiled.
_RULES = [
    (1, "1", "무릎|허리", "급성·외상", "image near", "auto", [], "b1"), (2, "1", "무릎", "서류", "papers held", "doc", ["A", "n"], "b2"), (3, "2", ".", "판단", "by person", "manual", [], ""),
    (4, "2", "발목(", "급성", "never", "auto", [], "b4"), (5, "3", "어깨|무릎", "서류", "two papers", "doc", ["R", "zz"], "b5"), (6, "3", "목$", "급성", "image near too", "auto", ["A"], "b6"),
]
_NAMED = ["무릎 염좌", "허리 통증", "발목", "어깨와 목", "손목"]


def _rules(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(_RULES, "jr_id long, subcommittee string, pattern string, axis string, condition string, check_kind string, required_docs array<string>, basis string")


def _cases(t: Tables) -> DataFrame:
    """Orders as cases: their lines' flags are what is held, shipping days of returned lines the days of images."""
    held = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), " ").alias("pool"), F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate").cast("date"))).alias("images"))
    k = F.col("o_orderkey")
    rows = t.orders.join(held, k == F.col("l_orderkey"), "left")
    return rows.select(k.alias("app_id"), (k % 3 + 1).cast("string").alias("subcommittee"), _pick(k, _NAMED).alias("target"), "pool", F.col("o_orderdate").cast("date").alias("injured"), F.coalesce("images", F.array().cast("array<date>")).alias("images"))


_CASES_SQL = f"SELECT o_orderkey AS k, o_orderkey % 3 + 1 AS sub, {_case('o_orderkey', _NAMED)} AS target, coalesce(bool_or(l_returnflag = 'A'), false) AS has_a, coalesce(bool_or(l_returnflag = 'N'), false) AS has_n, coalesce(bool_or(l_returnflag = 'R'), false) AS has_r, min(CASE WHEN l_returnflag = 'R' THEN abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) END) AS days FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"
_AUTO = "CASE WHEN days IS NULL THEN 'manual' WHEN days <= 92 THEN 'ok' ELSE 'lack' END"


@query(f"""WITH c AS ({_CASES_SQL})
SELECT k AS app_id, 1::BIGINT AS jr_id, {_AUTO} AS status, '' AS missing FROM c WHERE sub = 1 AND regexp_matches(target, '무릎|허리')
UNION ALL SELECT k, 2, CASE WHEN has_a AND has_n THEN 'ok' ELSE 'lack' END, concat_ws(',', CASE WHEN NOT has_a THEN 'A' END, CASE WHEN NOT has_n THEN 'n' END) FROM c WHERE sub = 1 AND contains(target, '무릎')
UNION ALL SELECT k, 3, 'manual', '' FROM c WHERE sub = 2
UNION ALL SELECT k, 5, 'lack', concat_ws(',', CASE WHEN NOT has_r THEN 'R' END, 'zz') FROM c WHERE sub = 3 AND regexp_matches(target, '어깨|무릎')
UNION ALL SELECT k, 6, {_AUTO}, '' FROM c WHERE sub = 3 AND ends_with(target, '목')""")
def rule_check_cases(t):
    return rules.check(_cases(t), _rules(t)).select("app_id", "jr_id", "status", F.array_join("missing_docs", ",").alias("missing"))


_FACTS = {  # by committee, axis, pattern
    "무릎 염좌": ["〔제1분과·급성·외상〕 image near [근거: b1]", "〔제1분과·서류〕 papers held (필요서류: A, n) [근거: b2]", "〔제2분과·판단〕 by person", "〔제3분과·서류〕 two papers (필요서류: R, zz) [근거: b5]"],
    "허리 통증": ["〔제1분과·급성·외상〕 image near [근거: b1]", "〔제2분과·판단〕 by person"],
    "발목": ["〔제2분과·판단〕 by person", "〔제3분과·급성〕 image near too (필요서류: A) [근거: b6]"],
    "어깨와 목": ["〔제2분과·판단〕 by person", "〔제3분과·급성〕 image near too (필요서류: A) [근거: b6]", "〔제3분과·서류〕 two papers (필요서류: R, zz) [근거: b5]"],
    "손목": ["〔제2분과·판단〕 by person", "〔제3분과·급성〕 image near too (필요서류: A) [근거: b6]"],
}


@query(f"SELECT o_orderkey AS id, place::BIGINT AS place, fact FROM (SELECT o_orderkey, {_case('o_orderkey', _NAMED)} AS target FROM orders) JOIN (VALUES {', '.join(f"('{k}', {i}, '{f}')" for k, fs in _FACTS.items() for i, f in enumerate(fs, 1))}) v(target, place, fact) USING (target)")
def rule_facts(t):
    return rules.rule_facts(t.orders.select(F.col("o_orderkey").alias("id"), _pick(F.col("o_orderkey"), _NAMED).alias("text")), _rules(t), 4)


@query("""WITH r AS (SELECT p_partkey, (p_size % 6 + 1)::VARCHAR AS sub, p_name, p_brand, p_type FROM part)
SELECT 'HAS_DISEASE' AS kind, count(*)::BIGINT AS n FROM r UNION ALL SELECT 'JUDGED_BY', count(*) FROM r UNION ALL SELECT 'REQUIRES', 2 * count(*) FROM r UNION ALL SELECT 'jr_sub', count(DISTINCT sub) FROM r UNION ALL SELECT 'jr_disease', count(DISTINCT p_name) FROM r
UNION ALL SELECT 'jr_axis', count(DISTINCT sub || ':' || p_brand) FROM r UNION ALL SELECT 'jr_doc', (SELECT count(DISTINCT x) FROM (SELECT p_type AS x FROM r UNION ALL SELECT p_brand FROM r))""")
def rule_graph_layer(t):
    """Parts as rules: their names as patterns, brands as axes, types and brands as required documents."""
    sub = (F.col("p_size") % 6 + 1).cast("string")
    nodes, edges = rules.layer(t.part.select(F.col("p_partkey").alias("jr_id"), sub.alias("subcommittee"), F.col("p_name").alias("pattern"), F.col("p_brand").alias("axis"), F.array("p_type", "p_brand").alias("required_docs")))
    return nodes.groupBy(F.col("ntype").alias("kind")).agg(n().alias("n")).unionByName(edges.groupBy(F.col("etype").alias("kind")).agg(n().alias("n")))


@query("""WITH c AS (SELECT o_custkey AS case_id, 'Brand#' || (min(o_orderkey) % 25 + 1) AS brand, min(o_orderkey) % 2 = 0 AS even FROM orders GROUP BY 1)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY p_size, p_partkey % 4, p_name, p_retailprice::VARCHAR)::BIGINT AS place, p_name AS judge_item FROM c JOIN part ON p_brand = brand AND (p_partkey % 3 = 0) = even""")
def applied_clauses(t):
    """Parts as rules of a brand, with a condition on some; a case for each customer with orders, told by the first of these."""
    order = t.part.select(F.col("p_size").cast("string").alias("rule_no"), F.col("p_brand").alias("review_content"), F.when(F.col("p_partkey") % 3 == 0, "even").otherwise("").alias("target_cond"), (F.col("p_partkey") % 4).cast("string").alias("pair_order"), F.col("p_name").alias("judge_item"), F.col("p_retailprice").cast("string").alias("result"))
    k = F.col("k")
    cases = t.orders.groupBy(F.col("o_custkey").alias("case_id")).agg(F.min("o_orderkey").alias("k")).select("case_id", F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string")).alias("review_content"), F.when(k % 2 == 0, "even").alias("target_cond"))
    return rules.applied_clauses(order, cases).select("case_id", "place", "judge_item")


@query("SELECT o_orderkey AS app_id, l_linenumber::BIGINT AS dis_id, count(*)::BIGINT AS n, sum(e.event_id)::BIGINT AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN events e ON e.user_id = o_orderkey AND (e.event_id % 3 = 0 OR e.event_id % 3 = l_linenumber) GROUP BY ALL")
def item_documents(t):
    """Events as documents of a case: every third one is about all of it."""
    items = t.lineitem.select(F.col("l_orderkey").alias("app_id"), F.col("l_linenumber").cast("long").alias("dis_id"))
    docs = t.events.select(F.col("user_id").alias("app_id"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3).alias("dis_id"), "event_id")
    return rules.item_documents(items, docs).groupBy("app_id", "dis_id").agg(n().alias("n"), F.sum("event_id").alias("total"))


@query("SELECT p_brand AS id, r::BIGINT AS r, p_name AS content FROM (SELECT p_brand, p_partkey, p_name, p_partkey AS r FROM part WHERE contains(p_name, 'red') OR contains(p_name, 'gear')) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY r) <= 2")
def fitting_passages(t):
    hits = t.part.select(F.col("p_brand").alias("id"), F.col("p_partkey").alias("r"), F.col("p_name").alias("content"))
    return rules.fitting_passages(hits, F.lit("red a gear ty"))


# Prediction ---------------------------------------------------------------------------------------

_ASKED = ["red bolt", "small widget of size", "xx", "gear gear hot"]


def _criteria(t: Tables) -> DataFrame:
    """Parts as criteria of their brand, with the vector that their key leads to."""
    rows = t.part.join(t.embeddings, F.col("p_partkey") % 500 == F.col("vec_id"))
    return rows.select(F.col("p_partkey").alias("class_no"), F.concat(F.lit("g"), (F.col("p_size") % 7 + 1).cast("string")).alias("grade"), F.col("p_brand").alias("body_part"), F.col("p_name").alias("description"), "embedding")


def _asked(t: Tables) -> DataFrame:
    """Every vector as a question; brands beyond 25 have no criteria."""
    v = F.col("vec_id")
    return t.embeddings.select(v.alias("id"), _pick(v, _ASKED).alias("disease"), F.when(v % 31 > 0, F.concat(F.lit("Brand#"), (v % 29 + 1).cast("string"))).alias("body_part"), "embedding")


def _earlier(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    return t.embeddings.select(v.alias("case_id"), F.when(v % 9 > 0, F.concat(F.lit("Brand#"), (v % 26 + 1).cast("string"))).alias("body_part"), F.concat(F.lit("c"), "label").alias("grade"), "embedding")


_COS = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"
_ASKED_SQL = f"SELECT vec_id AS id, {_case('vec_id', _ASKED)} AS disease, CASE WHEN vec_id % 31 > 0 THEN 'Brand#' || (vec_id % 29 + 1) END AS part, embedding AS q FROM embeddings"
_CRITERIA_SQL = f"""asked AS ({_ASKED_SQL}),
crit AS (SELECT p_partkey AS class_no, 'g' || (p_size % 7 + 1) AS grade, p_brand AS body_part, p_name AS description, embedding FROM part JOIN embeddings ON p_partkey % 500 = vec_id),
scored AS (SELECT id, disease, class_no, grade, description, round_even(coalesce(list_sum(list_transform(list_filter(list_distinct(regexp_extract_all(disease, '[가-힣A-Za-z0-9]{{2,}}')), lambda w: contains(description, w)), lambda w: length(w))), 0) + {_COS.format('embedding', 'q')}, 4) AS similarity
  FROM asked JOIN crit ON part IS NULL OR part = body_part),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, class_no, grade, description) AS r FROM scored QUALIFY r <= 6)"""
_CASES_NEAR_SQL = f"""near AS (SELECT id, vec_id AS case_id, 'c' || label AS grade, CASE WHEN own IS NULL THEN 2 WHEN own = coalesce(part, '') THEN 1 ELSE 0 END AS first, round({_COS.format('embedding', 'q')}, 4) AS similarity
  FROM (SELECT *, CASE WHEN vec_id % 9 > 0 THEN 'Brand#' || (vec_id % 26 + 1) END AS own FROM embeddings), asked),
cases AS (SELECT id, case_id, grade, similarity, row_number() OVER (PARTITION BY id ORDER BY first DESC, similarity DESC, case_id) AS r FROM near QUALIFY r <= 5)"""


@query(f"WITH {_CRITERIA_SQL} SELECT id, r::BIGINT AS r, class_no, grade, similarity FROM best")
def criteria_by_part(t):
    return prediction.score_criteria(_asked(t), _criteria(t)).select("id", "r", "class_no", "grade", "similarity")


@query(f"WITH asked AS ({_ASKED_SQL}), {_CASES_NEAR_SQL} SELECT id, r::BIGINT AS r, case_id, grade, similarity FROM cases")
def cases_part_first(t):
    return prediction.similar_cases(_asked(t), _earlier(t))


@query(f"""WITH {_CRITERIA_SQL}, {_CASES_NEAR_SQL},
top AS (SELECT * FROM best WHERE r = 1), other AS (SELECT b.id, min(b.r) AS r FROM best b JOIN top USING (id) WHERE (b.grade, b.class_no) <> (top.grade, top.class_no) GROUP BY 1),
kept AS (SELECT id, case_id, c.grade, c.similarity, c.r, p.case_id IS NOT NULL AS pinned, p.weight, 'c' || e.label AS own FROM (SELECT * FROM cases WHERE id NOT IN (SELECT id FROM top) AND (id % 3 <> 2 OR case_id <> (id * 7 + 1) % 500) AND (id % 5 <> 0 OR case_id % 26 <> 3)) c
  FULL JOIN (SELECT id, (id * 13) % 500 AS case_id, 1.0 AS weight FROM asked WHERE id NOT IN (SELECT id FROM top) AND id % 3 = 1) p USING (id, case_id) LEFT JOIN embeddings e ON e.vec_id = case_id),
placed AS (SELECT id, coalesce(grade, own) AS grade, similarity, row_number() OVER (PARTITION BY id ORDER BY pinned DESC, weight DESC NULLS LAST, similarity DESC NULLS LAST, r NULLS LAST, case_id) AS r FROM kept),
votes AS (SELECT id, grade, row_number() OVER (PARTITION BY id ORDER BY sum(coalesce(similarity, 0)) DESC, min(r)) AS place FROM placed GROUP BY id, grade)
SELECT t.id, t.grade || ' ' || t.class_no || '호' AS grade1, b.grade || ' ' || b.class_no || '호' AS grade2, replace(replace('{prediction.RATIONALE}', '%s호 "%s"', t.class_no || '호 "' || t.description || '"'), '%s %s호', t.grade || ' ' || t.class_no || '호') AS rationale, t.disease
FROM top t LEFT JOIN other o ON o.id = t.id LEFT JOIN best b ON b.id = t.id AND b.r = o.r
UNION ALL SELECT id, max(grade) FILTER (WHERE place = 1), max(grade) FILTER (WHERE place = 2), NULL, disease FROM votes JOIN asked USING (id) GROUP BY id, disease""".replace("'%s'에", "''%s''에").replace("상이등급 '%s %s호'에", "상이등급 ''%s %s호''에"))
def predict_grades(t):
    """Where a body part has no criteria (brands beyond 25) the cases vote, as picks of some questions want them: one pinned case, one
    excluded, and for every fifth question a whole body part excluded. The SQL leaves the disease to the end, so it is cut out here."""
    asked = _asked(t)
    k = F.col("id")
    pick = lambda case, kind: F.struct(case.cast("long").alias("case_id"), F.lit(kind).alias("kind"), F.lit(1.0).alias("weight"))
    one = asked.where(k % 3 > 0).select("id", F.when(k % 3 == 1, pick(k * 13 % 500, "pin")).otherwise(pick((k * 7 + 1) % 500, "exclude")).alias("p")).select("id", "p.*")
    parts = asked.where(k % 5 == 0).select("id", F.lit(3).cast("long").alias("case_set")), t.embeddings.select(F.col("vec_id").alias("case_id"), (F.col("vec_id") % 26).alias("case_set"))
    rows = prediction.predict(asked, _criteria(t), _earlier(t), one, parts).join(asked.select("id", "disease"), "id")
    return rows.select("id", "grade1", "grade2", F.replace("rationale", F.concat(F.lit("'"), "disease", F.lit("'에 대하여")), F.lit("'%s'에 대하여")).alias("rationale"), "disease")


@query("SELECT p_partkey, round((a + 2 * b + 2 * c + d) / 6, 6) AS loss, (a + 2 * b + 2 * c + d) / 6 >= 26 AS impaired FROM (SELECT p_partkey, p_size::DOUBLE AS a, (p_size * 3 % 50)::DOUBLE AS b, (p_partkey % 60)::DOUBLE AS c, (p_partkey % 45)::DOUBLE AS d FROM part)")
def hearing_loss(t):
    of = lambda c: c.cast("double")
    x = prediction.audiometry(of(F.col("p_size")), of(F.col("p_size") * 3 % 50), of(F.col("p_partkey") % 60), of(F.col("p_partkey") % 45))
    return t.part.select("p_partkey", x.alias("x")).select("p_partkey", F.round("x.loss", 6).alias("loss"), "x.impaired")


# The graph of scans -------------------------------------------------------------------------------

_DISEASES = ["무릎 염좌", "허리, 목 통증", "진단서, 검진 기록/병상일지", "발목*x", "어깨(좌)"]


@query("""WITH l AS (SELECT l_orderkey AS sd, l_linenumber AS line, l_returnflag AS f, l_linestatus AS s, l_partkey AS p FROM lineitem),
d AS (SELECT sd, line, unnest(CASE p % 5 WHEN 0 THEN ['무릎 염좌'] WHEN 1 THEN ['허리', '목 통증'] WHEN 3 THEN ['발목'] WHEN 4 THEN ['어깨'] END) AS x FROM l),
k AS (SELECT sd, line, 'M' || (p % 30) AS x FROM l WHERE p % 2 = 0),
g AS (SELECT sd, line, CASE WHEN f = 'A' THEN CASE WHEN s = 'F' THEN (p % 7 + 1) || '급' END ELSE (p % 6 + 1) || '급' END AS x FROM l),
e AS (SELECT DISTINCT sd FROM l),
edge AS (SELECT 'MENTIONS' AS etype, sd || '>' || x AS e FROM d UNION ALL SELECT 'MENTIONS_KCD', sd || '>' || x FROM k UNION ALL SELECT 'ASSIGNS_GRADE', sd || '>' || x FROM g WHERE x IS NOT NULL
  UNION ALL SELECT 'CODED_AS', d.x || '>' || k.x FROM (SELECT DISTINCT sd, x FROM d) d JOIN k USING (sd) UNION ALL SELECT 'MATCHES_RULE', x || '>' || p FROM (SELECT DISTINCT x FROM d) JOIN (VALUES ('무릎|허리'), ('무릎'), ('.'), ('어깨|무릎'), ('목$')) v(p) ON regexp_matches(x, p)
  UNION ALL SELECT 'HAS_DOC', 'p' || (sd % 40) || ':>' || sd FROM e UNION ALL SELECT 'ISSUED_BY', sd || '>h' || (sd % 3) FROM e WHERE sd % 3 > 0
  UNION ALL SELECT 'CONVERTED_TO', sd || '>' || sd FROM e WHERE sd % 4 = 1 UNION ALL SELECT 'HAS_AGENDA', 'p' || (sd % 40) || ':>' || sd FROM e WHERE sd % 4 = 1)
SELECT etype, count(*)::BIGINT AS n, count(DISTINCT e)::BIGINT AS different, min(e) AS least FROM edge GROUP BY 1""")
def instance_graph_layer(t):
    """Every order as a scan, its lines as blocks; a model put right those with flag A."""
    edges = _scan_graph(t)[1]
    e = edges.groupBy("etype", F.concat("skey", F.lit(">"), "dkey").alias("e")).agg(n().alias("k"))
    return e.groupBy("etype").agg(F.sum("k").alias("n"), n().alias("different"), F.min("e").alias("least"))


def _scan_graph(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, scans."""
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    rows = t.lineitem
    empty = F.lit(None).cast("string")
    model = F.col("l_returnflag") == "A"
    fields = F.struct(_pick(p, _DISEASES).alias("disease"), F.concat((p % 6 + 1).cast("string"), F.lit(" 급")).alias("grade"), F.when(p % 2 == 0, F.concat(F.lit("M"), (p % 30).cast("string"))).alias("kcd"))
    norm = F.struct(F.when(p % 5 == 0, "무릎 염좌").otherwise(empty).alias("disease"), F.when(model & (F.col("l_linestatus") == "F"), F.concat((p % 7 + 1).cast("string"), F.lit("급"))).alias("grade"), F.when(model, "llm").otherwise("rule").alias("source"))
    blocks = rows.select(k.alias("sd_id"), F.lit("t").alias("doc"), F.col("l_linenumber").alias("line"), fields.alias("fields"), norm.alias("norm"))
    s = F.col("sd_id")
    scans = rows.select(k.alias("sd_id")).distinct().select(s, F.concat(F.lit("p"), (s % 40).cast("string")).alias("person"), empty.alias("reg_no"), F.when(s % 3 > 0, F.concat(F.lit("h"), (s % 3).cast("string"))).alias("hospital"), F.lit("k").alias("doc_kind"), s.alias("ga_id"))
    agendas = scans.where("sd_id % 4 = 1").select("ga_id", F.lit("a").alias("agenda_no"))
    return *instance_graph.layer(scans, blocks, agendas, _rules(t)), scans


_SCANS_SQL = """l AS (SELECT l_orderkey AS sd, l_linenumber AS line, l_partkey AS p FROM lineitem),
d AS (SELECT DISTINCT sd, unnest(CASE p % 5 WHEN 0 THEN ['무릎 염좌'] WHEN 1 THEN ['허리', '목 통증'] WHEN 3 THEN ['발목'] WHEN 4 THEN ['어깨'] END) AS x FROM l),
k AS (SELECT DISTINCT sd, 'M' || (p % 30) AS x FROM l WHERE p % 2 = 0)"""


@query(f"""WITH {_SCANS_SQL}, q AS (SELECT o_orderkey AS id, o_orderkey % 30 AS c, {_case('o_orderkey', _DISEASES)} AS t FROM orders),
e AS (SELECT id, x AS name FROM q, (SELECT DISTINCT x FROM d) WHERE contains(t, x)),
people AS (SELECT x, count(DISTINCT sd % 40) AS n, string_agg(DISTINCT 'p' || (sd % 40), ', ' ORDER BY 'p' || (sd % 40)) AS who FROM d GROUP BY 1),
codes AS (SELECT d.x, string_agg(DISTINCT k.x, ', ' ORDER BY k.x) AS codes FROM d JOIN k USING (sd) GROUP BY 1)
SELECT id, name || ' — 실데이터 대상자 ' || n || '명: ' || who || coalesce(' (KCD ' || codes || ')', '') AS fact FROM e JOIN people p ON p.x = name LEFT JOIN codes c ON c.x = name""")
def graph_disease_facts(t):
    """Every order as a question, most of which name a disease."""
    nodes, edges, _ = _scan_graph(t)
    asked = t.orders.select(F.col("o_orderkey").alias("id"), _pick(F.col("o_orderkey"), _DISEASES).alias("text"))
    return graph_facts.disease_facts(graph_facts.entities(asked, nodes), nodes, edges).select("id", "fact")


@query(f"""WITH {_SCANS_SQL}, q AS (SELECT o_orderkey AS id, 'M' || (10 + o_orderkey // 50 % 30) AS c FROM orders),
kinds AS (SELECT k.x, string_agg(DISTINCT d.x, ', ' ORDER BY d.x) AS d FROM k JOIN d USING (sd) GROUP BY 1), people AS (SELECT x, string_agg(DISTINCT 'p' || (sd % 40), ', ' ORDER BY 'p' || (sd % 40)) AS who FROM k GROUP BY 1)
SELECT id, 'KCD ' || c || ' — 질환: ' || coalesce(d, '?') || coalesce(' / 대상자: ' || who, '') AS fact FROM q LEFT JOIN kinds s ON s.x = c LEFT JOIN people p ON p.x = c WHERE d IS NOT NULL OR who IS NOT NULL""")
def graph_code_facts(t):
    """Questions that name a code of two digits, some of which no scan has."""
    nodes, edges, _ = _scan_graph(t)
    k = F.col("o_orderkey")
    asked = t.orders.select(k.alias("id"), F.concat(F.lit("코드 M"), (10 + (k / 50).cast("long") % 30).cast("string"), F.lit("은?")).alias("text"))
    return graph_facts.code_facts(graph_facts.entities(asked, nodes), nodes, edges).select("id", "fact")


# Boards, sessions, files --------------------------------------------------------------------------


@query("WITH p AS (SELECT event_id AS id, CASE WHEN event_id % 3 > 0 THEN event_id - event_id % 7 END AS parent, event_type FROM events) SELECT r.id, r.event_type AS author, count(c.id)::BIGINT AS n, coalesce(string_agg(c.id::VARCHAR, ',' ORDER BY c.id), '') AS replies FROM p r LEFT JOIN p c ON c.parent = r.id WHERE r.parent IS NULL GROUP BY ALL ORDER BY r.id DESC LIMIT 100")
def board_threads(t):
    """Events as posts; the newest hundred posts with their replies."""
    k = F.col("event_id")
    posts = t.events.select(k.alias("id"), F.when(k % 3 > 0, k - k % 7).alias("parent_id"), F.col("event_type").alias("author"))
    rows = records.threads(posts).orderBy(F.desc("id")).limit(100)
    return rows.select("id", "author", F.size("replies").cast("long").alias("n"), F.array_join(F.transform("replies", lambda r: r["id"].cast("string")), ",").alias("replies"))


@query("WITH m AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1), b AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') SELECT conv_id AS session, (last + 2 * k - 1 + i)::BIGINT AS seq, CASE i WHEN 0 THEN 'user' ELSE 'ai' END AS role, CASE i WHEN 0 THEN text ELSE 'a' END AS content, CASE i WHEN 1 THEN turn::VARCHAR END AS source FROM b JOIN m USING (conv_id), (VALUES (0), (1)) v(i)")
def session_exchanges(t):
    """Each question of a conversation asked once more, with one source."""
    c = t.conversations
    source = F.array(F.struct(F.col("turn").alias("doc_id"), F.lit("x").alias("content"), F.lit(1).alias("other")))
    batch = c.where("role = 'user'").select(F.col("conv_id").alias("session"), F.col("turn").alias("at"), F.col("text").alias("question"), F.lit("a").alias("answer"), source.alias("sources"))
    new = records.exchanges(c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq")), batch)
    return new.select("session", "seq", "role", "content", F.get("sources", F.lit(0))["doc_id"].alias("source"))


@query(f"""WITH i AS (SELECT DISTINCT l_orderkey AS app, l_linenumber AS dis, l_returnflag AS f, l_linestatus AS s, l_shipdate::DATE AS d FROM lineitem),
u AS (SELECT o_orderkey AS app, 0 AS item, '신청서' AS kind, '{records.APPLICATION_TITLE}' AS title, true AS final FROM orders UNION ALL SELECT o_orderkey, 0, '병적', '{records.SERVICE_TITLE}', true FROM orders
  UNION ALL SELECT app, dis, '요건사실확인서', '1-4 요건사실확인서 — ' || f, true FROM i UNION ALL SELECT app, dis, '의무기록', 'h ' || CASE s WHEN 'F' THEN '영상' ELSE '외래' END || ' (' || CASE WHEN f = 'A' THEN '일자미상' ELSE d::VARCHAR END || ')', s = 'F' FROM i
  UNION ALL SELECT o_orderkey, 0, '공적서류', o_orderstatus || ' ( ' || o_orderpriority || ')', false FROM orders UNION ALL SELECT o_orderkey, 0, '스캔 원문', 's — ' || o_orderkey, false FROM orders),
g AS (SELECT app, item, kind, title, min(final::INT) = 1 AS final FROM u GROUP BY ALL)
SELECT app AS app_id, kind, count(*)::BIGINT AS n, count(*) FILTER (WHERE final)::BIGINT AS final, min(title) AS least FROM g WHERE NOT (app % 10 = 0 AND kind = '병적') GROUP BY ALL""")
def file_register_sources(t):
    """Every order as a case, with files from five sources; of every tenth one file is held already."""
    none = F.lit(None).cast("string")
    cases = t.orders.withColumnRenamed("o_orderkey", "app_id")
    lines = t.lineitem.select(F.col("l_orderkey").alias("app_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("dis_id"), "l_returnflag", "l_linestatus", "l_shipdate").repartition("dis_id").distinct()  # what follows goes by dis_id
    items = lines.select("app_id", "dis_id", F.col("l_returnflag").alias("name"))
    medical = lines.select("dis_id", F.lit("h").alias("hospital"), F.when(F.col("l_linestatus") == "F", "영상").otherwise("외래").alias("rec_type"), F.when(F.col("l_returnflag") != "A", F.col("l_shipdate").cast("date")).alias("rec_date"), none.alias("diagnosis"), F.lit("f").alias("finding"))
    officials = cases.select("app_id", F.lit(None).alias("dis_id"), F.col("o_orderstatus").alias("doc_kind"), none.alias("doc_date"), F.col("o_orderpriority").alias("issuer"), F.lit("c").alias("content"))
    scans = cases.select("app_id", F.lit("s").alias("doc_kind"), F.col("app_id").cast("string").alias("file_name"), none.alias("orig_path"))
    held = cases.where("app_id % 10 = 0").select("app_id", F.lit(None).cast("long").alias("dis_id"), F.lit(records.SERVICE).alias("kind"), F.lit(records.SERVICE_TITLE).alias("title"))
    got = records.register(cases.select("app_id"), items.dropDuplicates(["dis_id", "name"]), medical.distinct(), officials, scans, held)
    return got.groupBy("app_id", "kind").agg(n().alias("n"), F.count_if("is_final").alias("final"), F.min("title").alias("least"))


@query("SELECT event_id AS block, CASE event_id % 2 WHEN 0 THEN 'grade' ELSE 'disease' END AS field, CASE WHEN event_id % 5 = 0 THEN false WHEN event_id % 2 = 0 THEN contains(event_type, 'c') AND contains(event_type, 'k') ELSE contains(event_type, 'c') OR contains(event_type, 'k') END AS hit FROM events")
def field_needles(t):
    k = F.col("event_id")
    field = F.when(k % 2 == 0, "grade").otherwise("disease")
    found = t.events.where("event_id % 5 > 0").select(k.alias("block"), field.alias("field"), F.col("event_type").alias("value"))
    return records.field_hits(found, t.events.select(k.alias("block"), field.alias("field"), F.array(F.lit("c"), F.lit("k")).alias("needles")))


@query("SELECT CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size > 45) THEN 'review_content' WHEN p_type = 'ECONOMY' THEN 'review_type' ELSE 'agenda' END AS stype, count(*)::BIGINT AS n, min(p_partkey) AS least FROM part GROUP BY 1")
def agenda_edges(t):
    """Parts as agendas of a brand and a type, not all of which are nodes."""
    rows = t.part.select(F.col("p_partkey").alias("agenda"), F.col("p_brand").alias("content"), F.col("p_type").alias("type"))
    got = records.agenda_sources(rows, t.part.where("p_size > 45").select(F.col("p_brand").alias("key")), t.spark.sql("SELECT 'ECONOMY' AS key"))
    return got.groupBy("stype").agg(n().alias("n"), F.min("dkey").alias("least"))


# Changes of tables --------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_orderstatus, -o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0")
def reload_by_type(t):
    """The type P is loaded anew, with half of its rows."""
    held = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return state.reload_types(held, held.where("o_orderstatus = 'P' AND o_orderkey % 2 = 0").withColumn("o_totalprice", -F.col("o_totalprice")), "o_orderstatus")


@query("SELECT p_partkey, p_name, p_size * 2 AS p_size FROM part WHERE p_size > 25")
def truncate_reload(t):
    held = t.part.select("p_partkey", "p_name", "p_size")
    return state.reload(held, held.where("p_size > 25").select("p_name", (F.col("p_size") * 2).cast("long").alias("p_size"), F.col("p_partkey").cast("string").alias("p_partkey")))


@query("WITH b AS (SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT c_custkey AS user_id, 'none' AS event_type, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM b) UNION ALL SELECT * FROM b")
def upsert_newest(t):
    """Of several events of a user in the batch the newest replaces what is held."""
    held = t.customer.select(F.col("c_custkey").alias("user_id"), F.lit("none").alias("event_type"), F.col("c_acctbal").alias("value"))
    batch = t.events.select("user_id", "event_type", "value", "ts", "event_id")
    return state.upsert_newest(held.withColumns({"ts": F.lit(None).cast("timestamp_ntz"), "event_id": F.lit(None).cast("long")}), batch, ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts", "event_id")


@query("SELECT c_custkey, CASE WHEN e.n IS NULL THEN likes ELSE coalesce(likes, 0) + e.n END::BIGINT AS likes FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS likes FROM customer) LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON e.user_id = c_custkey")
def counter_increment(t):
    held = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey").cast("long")).alias("likes"))
    return state.counted(held, t.events.select(F.col("user_id").alias("c_custkey")), "c_custkey", "likes")


_EDITS_SQL = "edits AS (SELECT user_id AS k, CASE event_type WHEN 'click' THEN 'c_name' WHEN 'view' THEN 'c_mktsegment' ELSE 'c_acctbal' END AS field, 'v' || event_id AS value, event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer)), good AS (SELECT * FROM edits WHERE field <> 'c_acctbal')"


def _edited(t: Tables) -> tuple[DataFrame, DataFrame]:
    kind = F.col("event_type")
    edits = t.events.select(F.col("user_id").alias("c_custkey"), F.when(kind == "click", "c_name").when(kind == "view", "c_mktsegment").otherwise("c_acctbal").alias("field"), F.concat(F.lit("v"), "event_id").alias("value"), F.lit("e").alias("editor"), F.col("event_id").alias("at"))
    return state.edit_column(t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), edits, "c_custkey", ["c_name", "c_mktsegment"])


@query(f"WITH {_EDITS_SQL}, last AS (SELECT k, field, max_by(value, event_id) AS v FROM good GROUP BY ALL) SELECT c_custkey, coalesce((SELECT v FROM last WHERE k = c_custkey AND field = 'c_name'), c_name) AS c_name, coalesce((SELECT v FROM last WHERE k = c_custkey AND field = 'c_mktsegment'), c_mktsegment) AS c_mktsegment, c_acctbal FROM customer")
def edit_column(t):
    return _edited(t)[0]


@query(f"WITH {_EDITS_SQL} SELECT k AS c_custkey, field, coalesce(lag(value) OVER (PARTITION BY k, field ORDER BY event_id), CASE field WHEN 'c_name' THEN c_name ELSE c_mktsegment END) AS old_value, value AS new_value, 'e' AS editor, event_id FROM good JOIN customer ON c_custkey = k")
def edit_column_audit(t):
    return _edited(t)[1].withColumnRenamed("at", "event_id")


@query("""WITH i AS (SELECT l_orderkey AS k, l_linenumber AS ln, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS place, l_returnflag AS f, l_linestatus AS s FROM lineitem),
want AS (SELECT k, (k % 4)::BIGINT AS m, count(*) AS have FROM i GROUP BY ALL),
rows AS (SELECT k, m, have, unnest(range(1, greatest(m, 1) + 1)) AS place FROM want)
SELECT r.k, r.place::BIGINT AS place, CASE WHEN r.place <= m THEN nullif('g' || (r.place % 2) , 'g0') ELSE f END AS grade, s AS opinion FROM rows r LEFT JOIN i ON i.k = r.k AND i.place = r.place""")
def edit_items(t):
    """Lines as items; as many edits as the key modulo 4, every second of which empties the grade; one asks for a column that isn't allowed."""
    line = F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(line)).alias("x"))
    items = F.transform("x", lambda x: F.create_map(F.lit("grade"), x["l_returnflag"], F.lit("opinion"), x["l_linestatus"]))
    edit = lambda i: F.create_map(F.lit("grade"), F.when(i % 2 == 1, F.concat(F.lit(" g"), (i % 2).cast("string"))).otherwise(" "), F.lit("other"), F.lit("no"))
    edits = F.when(F.col("k") % 4 > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("k") % 4), edit)).otherwise(F.array().cast("array<map<string,string>>"))
    got = rows.select("k", F.posexplode(state.edit_items(items, edits, ["grade", "opinion"])).alias("place", "m"))
    return got.select("k", (F.col("place") + 1).cast("long").alias("place"), F.try_element_at("m", F.lit("grade")).alias("grade"), F.try_element_at("m", F.lit("opinion")).alias("opinion"))


# Texts, sorts, lists ------------------------------------------------------------------------------


@query("SELECT o_orderkey, 'Order ' || o_orderkey || chr(10) || chr(10) || 'It is ' || o_orderstatus || ' and ' || o_orderpriority || '.' || chr(10) || 'a*b' || chr(10) || 'end' AS text FROM orders")
def strip_markdown(t):
    part = ["## Order ", "o_orderkey", "\n---\nIt is **", "o_orderstatus", "** and *", "o_orderpriority", "*.\n- a*b\n\n\n\n* end\n"]
    text = F.concat(*[F.col(x).cast("string") if x.startswith("o_") else F.lit(x) for x in part])
    return t.orders.select("o_orderkey", tx.strip_markdown(text).alias("text"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'tag#' || o_orderstatus WHEN 1 THEN o_orderkey || '.txt' ELSE 'c.pdf' END AS label FROM orders")
def source_label(t):
    k = F.col("o_orderkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("a/b.txt#tag#"), "o_orderstatus")).when(k % 3 == 1, F.concat(F.lit("a/b\\"), k.cast("string"), F.lit(".txt"))).otherwise("c.pdf")
    return t.orders.select("o_orderkey", tx.label(path).alias("label"))


@query("SELECT l_orderkey, f AS most FROM (SELECT l_orderkey, l_returnflag AS f, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first, f) = 1")
def mode_first(t):
    line = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"])
    return t.lineitem.groupBy("l_orderkey").agg(line.alias("f")).select("l_orderkey", tx.first_most(F.col("f")).alias("most"))


@query("WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) AS place FROM lineitem), x AS (SELECT l_orderkey, l_returnflag AS v, place FROM i UNION ALL SELECT l_orderkey, l_linestatus, 1000 + place FROM i), f AS (SELECT l_orderkey, v, min(place) AS place FROM x GROUP BY ALL) SELECT l_orderkey, string_agg(v, ',' ORDER BY place) AS findings FROM f GROUP BY 1")
def merged_findings(t):
    """Findings by rule, then those of another reading that are new, in their order."""
    g = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))).alias("x"))
    return g.select("l_orderkey", F.array_join(tx.merged(F.transform("x", lambda x: x["l_returnflag"]), F.transform("x", lambda x: x["l_linestatus"]), F.lit(None).cast("array<string>")), ",").alias("findings"))


@query("SELECT p_partkey, no FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'x' ELSE p_size || '.' || p_partkey % 3 END AS no FROM part) ORDER BY coalesce(try_cast(no AS DECIMAL(20, 9)), 1e10), p_partkey LIMIT 40")
def number_sorted(t):
    no = F.when(F.col("p_partkey") % 10 == 0, "x").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 3).cast("string")))
    return t.part.select("p_partkey", no.alias("no")).orderBy(tx.number_order(F.col("no")), "p_partkey").limit(40)


@query("SELECT l_orderkey, sum(n)::BIGINT AS records, count(*)::BIGINT AS items FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def nested_totals(t):
    """Items with their records in arrays, added up inside the row."""
    items = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list("l_linenumber").alias("records")).groupBy("l_orderkey").agg(F.collect_list("records").alias("items"))
    return items.select("l_orderkey", records.nested_size(F.col("items")).alias("records"), F.size("items").cast("long").alias("items"))


_KW, _SOFT = ("license", "data", "time"), ("the", "der")


@query("SELECT doc_id, CASE WHEN contains(h, 'license') THEN 'license' WHEN contains(h, 'data') THEN 'data' WHEN contains(h, 'time') THEN 'time' WHEN NOT (contains(h || b, 'the') OR contains(h || b, 'der')) THEN NULL WHEN contains(b, 'license') THEN 'license(전문)' WHEN contains(b, 'data') THEN 'data(전문)' WHEN contains(b, 'time') THEN 'time(전문)' END AS keyword FROM (SELECT doc_id, coalesce(lang || ' ' || source, '') AS h, coalesce(text, '') AS b FROM documents)")
def keyword_class(t):
    return t.documents.select("doc_id", tables.keyword(F.concat_ws(" ", "lang", "source"), F.col("text"), _KW, _SOFT).alias("keyword"))


@query("""SELECT 'f' || l_orderkey AS file_name, CASE WHEN count(*) = 1 THEN min(l_returnflag) ELSE '의무기록 묶음(' || coalesce((min((l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag || ', ' || l_linestatus ELSE l_returnflag END)))[2], '') || ')' END AS doc_kind,
count(*)::BIGINT AS pages, string_agg('t' || l_linenumber, chr(10) || chr(10) ORDER BY l_linenumber) AS raw_text, sum(l_linenumber * 10)::BIGINT AS lines, sum(l_linenumber % 3)::BIGINT AS fixes FROM lineitem GROUP BY l_orderkey""")
def refined_scans(t):
    """Refined files written from the lines of orders as JSON, and read; diseases are lists in every second part."""
    no = F.col("l_linenumber")
    disease = F.when(no % 2 == 1, F.concat(F.lit('["'), "l_returnflag", F.lit('","'), "l_linestatus", F.lit('"]'))).otherwise(F.concat(F.lit('"'), "l_returnflag", F.lit('"')))
    fixes = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('"x"'), no % 3), ","), F.lit("]"))
    part = F.concat(F.lit('{"doc_type":"'), "l_returnflag", F.lit('","line_range":['), (no * 10).cast("string"), F.lit(',99],"disease":'), disease, F.lit(',"fixes":'), fixes, F.lit(',"corrected":"t'), no.cast("string"), F.lit('"}'))
    docs = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", part.alias("p")))).alias("x"))
    value = F.concat(F.lit('{"source":"f'), F.col("l_orderkey").cast("string"), F.lit('","docs":['), F.array_join(F.transform("x", lambda x: x["p"]), ","), F.lit("]}"))
    got = tables.final_scans(docs.select(F.lit("p").alias("path"), value.alias("value")))
    total = lambda f: F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + f(b))
    return got.select("file_name", "doc_kind", F.col("pages").cast("long").alias("pages"), "raw_text", total(lambda b: b["line"]).alias("lines"), total(lambda b: b["n_fixes"]).alias("fixes"))


@query("SELECT c_custkey, c_name FROM customer WHERE (contains(lower(c_name), '1') OR contains(c_custkey::VARCHAR, '1')) AND c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def list_filters(t):
    """A list as its filters show it: a word in name or number, one kind, and without an answer yet."""
    answered_ = t.orders.where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return records.matching_list(t.customer, " 1", ("c_name", "c_custkey"), {"c_mktsegment": "BUILDING", "c_name": ""}, (answered_, "c_custkey")).select("c_custkey", "c_name")


@query("SELECT c_custkey, coalesce(r.r_name, f.r_name) AS profile FROM customer LEFT JOIN region r ON r.r_regionkey = CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 8 END, (SELECT r_name FROM region WHERE r_regionkey = 1) f")
def profile_fallback(t):
    """Regions as profiles: some customers name one, some one that isn't there, some none."""
    k = F.col("c_custkey")
    rows = t.customer.select("c_custkey", F.when(k % 3 > 0, k % 8).alias("sub"))
    return records.with_profile(rows, "sub", t.region.select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("profile")), "1").select("c_custkey", "profile")


@query("WITH i AS (SELECT o_custkey AS k, o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS code, o_orderpriority FROM orders) SELECT c_custkey AS k, coalesce(string_agg(coalesce(code, '-'), '' ORDER BY o_orderkey), '-') AS codes, count(o_orderkey)::BIGINT AS n, count(code)::BIGINT AS coded, min(o_orderpriority) AS least FROM customer LEFT JOIN i ON k = c_custkey GROUP BY c_custkey")
def items_listed(t):
    """Customers as cases with their orders' codes in arrays, of which every fourth is null and keeps its place."""
    k = F.col("o_orderkey")
    items = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", F.when(k % 4 > 0, F.col("o_orderstatus")).alias("code"), F.col("o_orderpriority").alias("kind"))
    rows = records.listed_items(t.customer.select(F.col("c_custkey").alias("k")), items, "k", "o_orderkey", "code", "kind")
    some = lambda c: F.array_compact(c)
    return rows.select("k", F.array_join("code", "", "-").alias("codes"), F.size(some("kind")).cast("long").alias("n"), F.size(some("code")).cast("long").alias("coded"), F.array_min(some("kind")).alias("least"))
