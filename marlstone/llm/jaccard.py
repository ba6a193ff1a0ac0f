"""Exact Jaccard join of word n-gram sets by vertical partitioning."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, if_small, mix, release, signed, slices, words
from .components import components

#: Tokens of a fragment aimed at when candidates are sought; fragments in which overlaps are counted.
FRAGMENT, PARTS = 2_000_000, 4
#: A list of this many documents at most gives all its pairs; n-grams found so often in a batch of
#: CHUNK come last in the order; so many of them are kept at most (the limit is doubled until they fit).
SHORT, OFTEN, CHUNK, MOST_OFTEN = 8, 3, 2_000_000, 1_000_000
_ODD = np.array([0xD6E8FEB86659FD93, 0xA5A3564E27F8862B, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F], np.uint64)


def ngram_sets(data: np.ndarray, at: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct n-gram hashes; with fewer words than n, one for all; without words, none."""
    h, first = words(data, at)
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        grams += h[k : k + len(grams)] * _ODD[k % 8]
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix(np.array([(h[a:b] * _ODD[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed longs."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    a, b = h >> 64, h & ((1 << 64) - 1)
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _classes(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: a document's set (a, b: its id; size; doc_id). kind 1: an n-gram (a) found in size sets of a batch."""

    def run(batches):
        held, count, seen = [], 0, set()

        def often():
            nonlocal held, count
            s = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            held, count = [], 0
            seen.clear()
            begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            times = np.diff(np.append(begin, len(s)))
            begin, times = begin[times >= OFTEN], times[times >= OFTEN]
            k = len(begin)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(signed(s[begin])), pa.array(np.zeros(k, np.int64)), pa.array(times.astype(np.int64)), pa.nulls(k, pa.int64())], names)

        names = ["kind", "a", "b", "size", "doc_id"]
        for batch, data, at in slices(batches):
            ids = np.zeros((batch.num_rows, 2), np.int64)
            sizes = np.zeros(batch.num_rows, np.int64)
            for i, s in enumerate(ngram_sets(data, at, n)):
                ids[i] = key = set_id(s)
                sizes[i] = len(s)
                if key not in seen:
                    seen.add(key)
                    held.append(s)
                    count += len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy()), pa.array(sizes), batch.column(0)], names)
            if count >= CHUNK:
                yield often()
        yield often()

    return _rows(docs).mapInArrow(run, "kind int, a long, b long, size long, doc_id long")


def _prefixes(docs: DataFrame, n: int, percent: int, frequent: np.ndarray, fragments: int) -> DataFrame:
    """The n-grams of each set of which one at least is shared by any set linked with it.

    The order has n-grams that aren't in `frequent` first, by hash, then these,
    rarest first. Those before go to fragments as packed arrays, one row a
    fragment and batch; the others as rows (gram, set), for lists that may be long.
    """
    spark = docs.sparkSession
    order = np.argsort(frequent)
    sent = spark.sparkContext.broadcast((frequent[order], order))
    names = ["fragment", "grams", "at", "sets", "gram", "a", "b", "size", "rare"]

    def run(batches):
        table, rank = sent.value
        grams, owner, sets, long, seen = [], [], [], [], set()
        held = 0

        def flush():
            nonlocal grams, owner, sets, long, held
            cols = [[] for _ in names]
            if grams:
                g, o, s = np.concatenate(grams), np.concatenate(owner), np.array(sets, np.int64).reshape(-1, 4)
                f = (mix(g) % np.uint64(fragments)).astype(np.int64)
                by = np.argsort(f, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(f[by]) != 0]))
                for a, b in zip(cuts, np.append(cuts[1:], len(by)), strict=True):
                    mine = by[a:b]
                    used, at = np.unique(o[mine], return_inverse=True)
                    for c, v in zip(cols, (int(f[mine[0]]), g[mine].tobytes(), at.astype(np.int32).tobytes(), s[used].tobytes(), None, None, None, None, None), strict=True):
                        c.append(v)
            for row in long:
                for c, v in zip(cols, (row[1] % fragments, None, None, None, *row), strict=True):
                    c.append(v)
            grams, owner, sets, long, held = [], [], [], [], 0
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for batch, data, at in slices(batches):
            for doc, s in zip(batch.column(0).to_pylist(), ngram_sets(data, at, n), strict=True):
                if doc is None or not len(s) or (key := set_id(s)) in seen:
                    continue
                seen.add(key)  # equal sets of a task are sent once
                size = len(s)
                length = size - -(-percent * size // 100) + 1
                place = np.searchsorted(table, s) if len(table) else np.zeros(size, np.int64)
                known = table[np.minimum(place, len(table) - 1)] == s if len(table) else np.zeros(size, bool)
                light = s[~known]
                grams.append(light[:length])
                owner.append(np.full(len(grams[-1]), len(sets), np.int32))
                sets.append((*key, size, len(light)))
                held += len(grams[-1])
                if length > len(light):
                    k = np.flatnonzero(known)
                    k = k[np.argsort(rank[place[k]], kind="stable")][: length - len(light)]
                    long += [(g, *key, size, len(light)) for g in signed(s[k]).tolist()]
            if held >= CHUNK or len(long) >= 20_000:
                yield flush()
        yield flush()

    return _rows(docs).mapInArrow(run, "fragment int, grams binary, at binary, sets binary, gram long, a long, b long, size long, rare long")


def _near(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sizes allow a link."""
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def _candidates(prefixes: DataFrame, percent: int) -> DataFrame:
    """kind 0: pairs of sets that share n-grams (gram: how many) of short lists. kind 1: members of long lists (gram)."""
    names = ["kind", "gram", "a", "b", "size", "rare", "a2", "b2", "size2"]

    def run(batches):
        grams, at, sets, base = [], [], [], 0
        for batch in batches:
            p = batch.select(["gram", "a", "b", "size", "rare"])
            rows = pc.is_valid(p.column(0))
            if pc.any(rows).as_py():
                t = p.filter(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(t.num_rows, np.int32)), *t.columns, *[pa.nulls(t.num_rows, pa.int64())] * 3], names)
            for g, i, s in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("grams", "at", "sets")), strict=True):
                if g is not None:
                    s = np.frombuffer(s, np.int64).reshape(-1, 4)
                    grams.append(np.frombuffer(g, np.uint64))
                    at.append(np.frombuffer(i, np.int32).astype(np.int64) + base)
                    sets.append(s)
                    base += len(s)
        if not grams:
            return
        g, o, s = np.concatenate(grams), np.concatenate(at), np.concatenate(sets)
        del grams, at, sets
        by = np.argsort(g, kind="stable")
        g, o = g[by], o[by]
        same = g[1:] == g[:-1]
        shared = np.append(same, False) | np.insert(same, 0, False)
        g, o = g[shared], o[shared]
        # A set sent by several tasks is one; members of a list stand by size.
        _, first, one = np.unique(s[:, :2], axis=0, return_index=True, return_inverse=True)
        s, o = s[first], one.ravel()[o]
        by = np.lexsort((o, s[o, 2], g))
        g, o = g[by], o[by]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
        g, o = g[new], o[new]
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(g)))
        n_of = np.repeat(count, count)
        keep = (n_of > 1) & (n_of <= SHORT)
        gs, os_, left = g[keep], o[keep], []
        for step in range(1, SHORT):
            x, y = os_[:-step], os_[step:]
            ok = (gs[:-step] == gs[step:]) & _near(s[x, 2], s[y, 2], percent)
            left.append(np.minimum(x, y)[ok] * len(s) + np.maximum(x, y)[ok])
        pairs, times = np.unique(np.concatenate(left), return_counts=True)
        x, y = pairs // max(len(s), 1), pairs % max(len(s), 1)
        arrays = [np.zeros(len(x), np.int32), times, s[x, 0], s[x, 1], s[x, 2], None, s[y, 0], s[y, 1], s[y, 2]]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()) if v is None else pa.array(np.ascontiguousarray(v)) for v in arrays], names)
        k = n_of > SHORT
        arrays = [np.ones(k.sum(), np.int32), signed(g[k]), *(s[o[k], c] for c in range(4)), None, None, None]
        yield pa.RecordBatch.from_arrays([pa.nulls(int(k.sum()), pa.int64()) if v is None else pa.array(np.ascontiguousarray(v)) for v in arrays], names)

    def whole(rows: pa.Table) -> pa.Table:
        kinds = [pa.int32(), *[pa.int64()] * 8]
        return pa.Table.from_batches(list(run(rows.to_batches())), pa.schema(list(zip(names, kinds, strict=True))))

    return prefixes.groupBy("fragment").applyInArrow(whole, "kind int, gram long, a long, b long, size long, rare long, a2 long, b2 long, size2 long")


def _overlaps(docs: DataFrame, sets: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (x, y: documents standing for their sets) that link: overlaps are counted in each
    fragment of the n-gram order (PARTS ranges of the hash) and summed for each pair."""
    members = pairs.select(F.col("x").alias("_id")).union(pairs.select(F.col("y").alias("_id"))).distinct()
    members = cut(members.join(sets.select(F.col("x").alias("_id"), "a", "b"), "_id"))
    members = if_small(members, members.count(), 500_000)  # few: the texts aren't shuffled
    rows = _rows(docs).join(members, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "a", "b")
    names = ["doc", "part", "size", "grams"]
    cuts = np.array([(1 << 64) * k // PARTS for k in range(1, PARTS)], np.uint64)

    def run(batches):
        for batch, data, at in slices(batches):
            docs_, parts, sizes, out = [], [], [], []
            for doc, a, b, s in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), ngram_sets(data, at, n), strict=True):
                if set_id(s) == (a, b):  # another row may repeat the id with another text
                    for k, part in enumerate(np.split(s, np.searchsorted(s, cuts))):
                        docs_.append(doc)
                        parts.append(k)
                        sizes.append(len(s))
                        out.append(part)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            values = pa.array(signed(np.concatenate(out)) if out else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(parts, pa.int32()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], names)

    parts = rows.mapInArrow(run, "doc long, part int, size long, grams array<long>")
    side = lambda v: parts.select(F.col("doc").alias(v), "part", F.col("size").alias(f"{v}_size"), F.col("grams").alias(f"{v}_grams"))
    each = pairs.select("x", "y", F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part"))
    both = each.join(side("x"), ["x", "part"]).join(side("y"), ["y", "part"])
    counted = both.select("x", "y", "part", "x_size", "y_size", F.size(F.array_intersect("x_grams", "y_grams")).alias("inside"))
    partial = counted.groupBy("x", "y", "part", "x_size", "y_size").agg(F.max("inside").alias("inside"))  # a repeated row counts once
    total = partial.groupBy("x", "y", "x_size", "y_size").agg(F.sum("inside").alias("inside"))
    return total.where(100 * F.col("inside") >= percent * (F.col("x_size") + F.col("y_size") - F.col("inside"))).select("x", "y")


def _ordered(pairs: DataFrame) -> DataFrame:
    """The same with x < y, pairs of one set left out."""
    swap = lambda v, w, name: F.when(F.col("x") < F.col("y"), F.col(v)).otherwise(F.col(w)).alias(name)
    return pairs.where("x <> y").select(swap("x", "y", "x"), swap("y", "x", "y"), swap("x_size", "y_size", "x_size"), swap("y_size", "x_size", "y_size"), "inside")


def _possible(pairs: DataFrame, listed: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) whose overlap may still suffice.

    Up to the nearer end of the two prefixes the shared n-grams are known: those of short lists by
    count, those of long lists at most as many as either set has there. Behind
    it at most the rest of a set is shared.
    """
    pairs = pairs.groupBy("x", "y", "x_size", "y_size").agg(F.sum("inside").alias("inside"))
    pairs = pairs.join(listed.withColumnRenamed("listed", "lx"), "x", "left").join(listed.select(F.col("x").alias("y"), F.col("listed").alias("ly")), "y", "left")
    known = F.col("inside") + F.least(F.coalesce("lx", F.lit(0)), F.coalesce("ly", F.lit(0)))
    return pairs.where(_fits("x_size", "y_size", known, percent)).select("x", "y")


def _fits(x: str, y: str, shared: Column, percent: int) -> Column:
    """Whether two sets of sizes x and y that share so many n-grams up to the nearer end of their prefixes may link."""
    rest = lambda c: F.ceil(F.col(c) * percent / 100) - 1
    most = F.least(shared + F.greatest(rest(x), rest(y)), F.col(x), F.col(y))
    return 100 * most >= percent * (F.col(x) + F.col(y) - most)


def _numbers(lists: DataFrame) -> DataFrame:
    """(gram, number) of the n-grams of long lists, from 0 on: arrays of numbers, in order, take less than half of the disk that hashes do."""
    found = lists.select("gram").distinct().rdd.map(lambda row: row[0]).zipWithIndex()
    return cut(lists.sparkSession.createDataFrame(found, "gram long, number long").select("gram", F.col("number").cast("int").alias("number")))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every document.

    Equal sets are one class, and only classes are compared. Two sets that link
    share an n-gram among the first of each in any fixed order (as many as may be
    missing, plus one). The order puts n-grams met often last, by counts over
    all documents, so candidates come from rare ones. Lists of up to SHORT sets give all their
    pairs. A longer list first links its members with the one with fewest rare
    n-grams; then those outside its largest component are compared with
    all members of other components, so no link that matters is lost though
    near copies aren't expanded into all pairs. Pairs are verified by partial
    overlaps in fragments of the order, summed for each pair.

    Null or empty texts and texts without words link with nothing. Rows that
    repeat an id are one node of the graph, with n_shingles of their own text. A row
    without an id links with nothing; its component is null. Only doc_id
    and text are read; no rows give no rows.
    """
    found = cut(_classes(docs, n))
    of = found.where("kind = 0")
    counts = found.where("kind = 1").groupBy("a").agg(F.sum("size").alias("times"))
    counts = counts.where(F.col("times") >= OFTEN)
    limit = OFTEN
    while (rows := counts.where(F.col("times") >= limit)).count() > MOST_OFTEN:
        limit *= 2
    frequent = rows.orderBy("times", "a").select("a").toPandas()["a"].to_numpy(np.int64).view(np.uint64)
    length = F.sum(F.floor(F.col("size") * (100 - percent) / 100) + 1)
    total = of.where("size > 0").agg(length).first()[0] or 0
    fragments = max(1, -(-int(total) // FRAGMENT))
    sets = cut(of.where("size > 0 AND doc_id IS NOT NULL").groupBy("a", "b").agg(F.min("doc_id").alias("x")))
    seen = cut(_candidates(_prefixes(docs, n, percent, frequent, fragments), percent))
    release(docs.sparkSession)

    named = lambda a, b, x: sets.select(F.col("a").alias(a), F.col("b").alias(b), F.col("x").alias(x))
    lists = cut(seen.where("kind = 1").select("gram", "a", "b", "size", "rare").distinct().join(sets, ["a", "b"]).select("gram", "x", "size", "rare"))
    lists = cut(lists.join(_numbers(lists), "gram").select(F.col("number").alias("gram"), "x", "size", "rare"))
    shared = seen.where("kind = 0").groupBy("a", "b", "size", "a2", "b2", "size2").agg(F.sum("gram").alias("inside"))
    pairs = shared.join(named("a", "b", "x"), ["a", "b"]).join(named("a2", "b2", "y"), ["a2", "b2"])
    pairs = cut(_ordered(pairs.select("x", "y", F.col("size").alias("x_size"), F.col("size2").alias("y_size"), "inside")))
    release(docs.sparkSession)
    # A set has no more of these n-grams than its prefix.
    listed = cut(lists.groupBy("x").agg(F.count("*").alias("listed"), F.array_sort(F.collect_set("gram")).alias("grams")))
    # Hubs and largest components are written down, so that the joins with the lists can part a very long one among tasks.
    hub = cut(lists.groupBy("gram").agg(F.min(F.struct("rare", F.col("x").alias("y"), F.col("size").alias("y_size"))).alias("hub")).select("gram", "hub.y", "hub.y_size"))
    star = _ordered(lists.join(hub, "gram").select("x", "y", F.col("size").alias("x_size"), "y_size", F.lit(0).cast("long").alias("inside")))
    first = cut(_possible(pairs.unionByName(star), listed, percent))
    release(docs.sparkSession)
    links = cut(_overlaps(docs, sets, first, n, percent))
    release(docs.sparkSession)
    joined = cut(components(links, "x", "y"))

    # The rest of the long lists: pairs of different components.
    at = lists.join(joined.withColumnRenamed("node", "x"), "x", "left").withColumn("component", F.coalesce("component", "x"))
    sizes = at.groupBy("gram", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("gram").agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    at = cut(at.join(cut(main), "gram"))
    if not at.isEmpty():
        # Pairs that share n-grams of short lists too were weighed above. The others share those of
        # their lists only, so the bound is known here; a pair is met at the least of them. A list is
        # dealt out by bands of sizes as well: those of linked sets are the same or next to each other.
        at = at.join(listed.select("x", "grams"), "x").withColumn("band", F.floor(F.log("size") / math.log(max(100 / percent, 1.01) * 1.0001)))
        near = F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("near")
        outer = at.where("component <> main").select(F.col("gram").alias("met"), near, F.col("x").alias("y"), F.col("size").alias("y_size"), F.col("component").alias("other"), F.col("grams").alias("y_grams"))
        sizes_near = 100 * F.least("size", "y_size") >= percent * F.greatest("size", "y_size")
        # The shared n-grams are found once a pair, as the one element that exists() looks at.
        fits = F.exists(F.array(F.array_intersect("grams", "y_grams")), lambda both: _fits("size", "y_size", F.size(both), percent) & (F.array_min(both) == F.col("gram")))
        met = at.join(outer, (F.col("gram") == F.col("met")) & (F.col("band") == F.col("near")) & (F.col("component") != F.col("other")) & sizes_near & fits)
        more = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        more = cut(more.join(first, ["x", "y"], "left_anti"))
        if not more.isEmpty():
            links = links.unionByName(_overlaps(docs, sets, more, n, percent))
            joined = cut(components(links, "x", "y"))
    # Documents -> class -> component. Rows that repeat an id tie their classes together.
    of = of.select("doc_id", F.col("size").alias("n_shingles"), "a", "b")
    repeated = of.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    if not repeated.isEmpty():
        tied = of.join(repeated, "doc_id").join(sets, ["a", "b"]).select("x", F.col("doc_id").alias("y"))
        joined = cut(components(links.unionByName(tied), "x", "y"))
    member = of.join(sets, ["a", "b"], "left").join(joined.withColumnRenamed("node", "x"), "x", "left")
    return member.select("doc_id", "n_shingles", F.coalesce("component", "x", "doc_id").alias("component_id"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
token AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d WHERE len(w) >= 5),
gram AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS g FROM token WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
shingle AS MATERIALIZED (SELECT DISTINCT doc_id, md5(g) AS g FROM gram WHERE g IS NOT NULL UNION ALL SELECT doc_id, md5(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 4),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM pair JOIN size s ON s.doc_id = x JOIN size t ON t.doc_id = y WHERE 100 * k >= 80 * (s.n + t.n - k)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.least AS component_id
FROM d LEFT JOIN size s USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS least FROM reach GROUP BY 1) c USING (doc_id)
"""
