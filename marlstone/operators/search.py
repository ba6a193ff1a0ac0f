"""Vector, lexical and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunks, cosine, harmonic_rank, tokens
from .nearest import nearest

# Candidates of each branch, rank constant, branch weights, results.
DEPTH, RRF_K, DENSE, SPARSE, TOP = 50, 60, 1.0, 0.5, 5


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows by a complete order, with rank r. The limit comes first, so no window sees more than k rows."""
    return df.orderBy(*order).limit(k).withColumn("r", F.row_number().over(Window.orderBy(*order)).cast("long"))


def chunk_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(chunks(F.col("text"))).alias("seq", "content")).withColumn("seq", F.col("seq").cast("long"))


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf. Terms are counted in their row: sorted, then from one's first place to the next's. Nothing is shuffled."""
    rows = docs.select("doc_id", F.array_sort(tokens(F.col("text"))).alias("s")).where(F.size("s") > 0)
    rows = rows.select("doc_id", "s", F.filter(F.sequence(F.lit(1), F.size("s")), lambda i: (i == 1) | (F.element_at("s", i) != F.get("s", i - 2))).alias("at"))
    found = F.transform("at", lambda p, k: F.struct(F.element_at("s", p).alias("term"), (F.coalesce(F.get("at", k + 1), F.size("s") + 1) - p).cast("long").alias("tf")))
    return rows.select("doc_id", F.inline(found))


def term_counts(docs: DataFrame) -> DataFrame:
    """term, tf, df over all documents: two kinds of ones, added up in the same place before they move."""
    found = docs.select(tokens(F.col("text")).alias("s"))
    one = lambda terms, tf, df: found.select(F.explode(terms).alias("term"), F.lit(tf).alias("tf"), F.lit(df).alias("df"))
    return one("s", 1, 0).unionAll(one(F.array_distinct("s"), 0, 1)).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def lexical(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id and rank of documents with any of the terms. The tokens are counted in place: nothing is shuffled."""
    held = F.filter(tokens(F.col("text")), lambda t: t.isin(terms))
    counted = docs.select("doc_id", held.alias("held")).where(F.size("held") > 0)
    count = lambda term: F.size(F.filter("held", lambda t: t == term))
    score = sum((F.when(count(t) > 0, harmonic_rank(count(t), len(terms))).otherwise(0.0) for t in terms), F.lit(0.0))
    return counted.select("doc_id", F.round(score, 9).alias("score"))


def knn(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k nearest of vectors (vec_id, embedding) to the one row of query, by cosine; exact. More than one row is an error."""
    several = F.raise_error(F.lit("knn takes one query row; knn_multi ranks for each of many"))
    one = F.broadcast(query.agg(F.count("*").alias("n"), F.first("embedding").alias("q")).where("n > 0").select(F.when(F.col("n") == 1, F.col("q")).otherwise(several).alias("q")))
    scored = vectors.crossJoin(one).select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return top(scored, k, F.desc("similarity"), "vec_id")


def fuse(branches: list[tuple[DataFrame, float]], key: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (key, r)."""
    parts = [b.select(key, (F.lit(w) / (F.lit(float(k)) + F.col("r"))).alias("s")) for b, w in branches]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(key).agg(F.round(F.sum("s"), 9).alias("score"))


def hybrid(docs: DataFrame, vectors: DataFrame, query: DataFrame, terms: list[str], dense: bool = True, pool: Column | None = None) -> DataFrame:
    """doc_id, score, r: dense and lexical top lists fused; a document's vector has its id. Texts are fetched after the top-k only.

    With pool, a condition on documents, both lists are made of the documents that meet it.
    """
    if pool is not None:
        docs = docs.where(pool)
        vectors = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    sparse = top(lexical(docs, terms), DEPTH, F.desc("score"), "doc_id")
    branches = [(sparse, SPARSE)]
    if dense:
        branches.insert(0, (knn(vectors, query, DEPTH).select(F.col("vec_id").alias("doc_id"), "r"), DENSE))
    return top(fuse(branches), TOP, F.desc("score"), "doc_id")


def top_each(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each query_id by a complete order, with rank r."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")).where(F.col("r") <= k)


def knn_multi(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, similarity, r: the k nearest of vectors to each row of queries (query_id, embedding), by cosine; exact, as matrix
    products of blocks. A vector without a direction isn't found and finds nothing. Both frames are counted when this one is built."""
    return top_each(nearest(vectors, queries, k), k, F.desc("similarity"), "vec_id")


def lexical_multi(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id and rank of documents with any of a query's different terms. Only tokens that some query asks for are counted."""
    asked = queries.select("query_id", F.array_distinct("terms").alias("terms")).select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    found = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    counted = found.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).join(asked, "term")
    return counted.groupBy("query_id", "doc_id").agg(F.round(F.sum(harmonic_rank(F.col("tf"), F.col("n"))), 9).alias("score"))


def fused_multi(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """query_id, doc_id, score, r: ranked lists (query_id, doc_id, r) fused for each query, wherever they come from."""
    part = lambda hits, w: hits.select("query_id", "doc_id", (F.lit(w) / (RRF_K + F.col("r"))).alias("s"))
    fused = part(dense, DENSE).unionByName(part(sparse, SPARSE)).groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 9).alias("score"))
    return top_each(fused, TOP, F.desc("score"), "doc_id")


def hybrid_multi(docs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score, r: hybrid() for each row of queries (query_id, embedding, terms), ranked per query."""
    sparse = top_each(lexical_multi(docs, queries), DEPTH, F.desc("score"), "doc_id")
    return fused_multi(knn_multi(vectors, queries, DEPTH).withColumnRenamed("vec_id", "doc_id"), sparse)


def merge_hits(lists: list[DataFrame], most: int) -> DataFrame:
    """Hit lists (doc_id, r) one after the other, each id once where it comes first, at most `most`."""
    both = None
    for i, hits in enumerate(lists):
        part = hits.select("doc_id", F.lit(i).alias("list"), "r")
        both = part if both is None else both.unionByName(part)
    first = both.groupBy("doc_id").agg(F.min(F.struct("list", "r")).alias("p")).select("doc_id", "p.list", F.col("p.r").alias("at"))
    return top(first, most, "list", "at").select("doc_id", F.col("list").cast("long").alias("list"), "r")


def apply_picks(hits: DataFrame, picks: DataFrame) -> DataFrame:
    """Hits (id, similarity, r) without excluded ids, with pinned ones first by weight, then by similarity, stable.

    Both are short lists (a search's top hits and one person's picks), ranked in one task.
    """
    kept = hits.join(picks.where("kind = 'exclude'").select("id"), "id", "left_anti")
    pins = picks.where("kind = 'pin'").select("id", "weight")
    rows = kept.join(pins, "id", "full_outer").withColumn("pinned", F.col("weight").isNotNull())
    order = [F.desc("pinned"), F.desc_nulls_last("weight"), F.desc_nulls_last("similarity"), F.asc_nulls_last("r"), "id"]
    return rows.select("id", "similarity", "pinned", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))
