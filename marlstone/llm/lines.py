"""Line dedup with sharded cuckoo filters over exact reference tables; reversible."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents, slices
from .cuckoo import CuckooFilter

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Keys of a shard's filter aimed at, and the size up to which all filters together are sent to every task.
SHARD_KEYS, SEND_BYTES = 200_000, 16 << 20
#: Rows that meet a copy of their shard's filter at once, where the filters are not sent.
GROUP_ROWS = 1_000_000
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> tuple[int, int] | None:
    """128-bit hash, as two signed longs, of a line stripped and with A-Z lower-cased; None if it is too short."""
    key = line.strip(_STRIP).lower()
    if len(key) < LEAST_CHARS or (not key.isascii() and len(key.decode("utf-8", "replace")) < LEAST_CHARS):
        return None
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & ((1 << 64) - 1)
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def references(docs: DataFrame, filters: dict[int, bytes] | None = None) -> DataFrame:
    """A row (a, b, doc_id) for each key of each document, once a document and task batch.

    With filters, only keys that these may hold.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters) if filters is not None else None

    def run(batches):
        held = sent and {k: CuckooFilter.from_bytes(v) for k, v in sent.value.items()}
        for batch, data, at in slices(batches):
            raw, out = data.tobytes(), []
            for doc, start, end in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if doc is not None:
                    out += [(*k, doc) for k in {line_key(x) for x in raw[start:end].split(b"\n")} if k]
            a, b, d = np.array(out, np.int64).reshape(-1, 3).T
            if held is not None:
                may, shard = np.zeros(len(a), bool), b.view(np.uint64) % np.uint64(len(held)) if len(held) else b
                for k, f in held.items():
                    mine = shard == k
                    may[mine] = f.contains(a[mine].view(np.uint64))
                a, b, d = a[may], b[may], d[may]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (a, b, d)], ["a", "b", "doc_id"])

    return _rows(docs).mapInArrow(run, "a long, b long, doc_id long")


@dataclass
class LineIndex:
    """refs (a, b, doc_id) is exact: which document holds which key. counts (a, b, n, keep, version) is the
    reference-count table: how many documents hold a key, and the largest of them; a change adds rows of a later
    version for the keys that it touches, and the latest row of a key counts. filters (shard, filter) hold
    the keys of at least LEAST_DOCS documents, to leave out lines that can't be dropped."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    version: int = 0

    @staticmethod
    def build(docs: DataFrame, shards: int | None = None) -> LineIndex:
        refs = cut(references(docs).distinct())
        counts = cut(_counted(refs).withColumn("version", F.lit(0)))
        often = counts.where(F.col("n") >= LEAST_DOCS)
        shards = shards or max(1, -(-often.count() // SHARD_KEYS))
        return LineIndex(refs, counts, cut(_filters(often, shards)), shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With more documents. What they hold already stays as it is; only keys that the new documents hold are counted again."""
        mine = cut(references(docs).distinct())
        same = self.refs.join(mine.select("doc_id").distinct(), "doc_id", "left_semi")
        new = cut(mine.join(same, ["a", "b", "doc_id"], "left_anti"))
        added = _counted(new).select("a", "b", F.col("n").alias("more"), F.col("keep").alias("top"))
        old = self._latest(added.select("a", "b"))
        n = F.coalesce("n", F.lit(0).cast("long"))
        touched = added.join(old, ["a", "b"], "left").select("a", "b", n.alias("before"), (n + F.col("more")).alias("n"), F.greatest("keep", "top").alias("keep"))
        return self._with(self.refs.unionByName(new), touched)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents in ids (doc_id); the keys they held are counted again, and the filters forget those that fall under the limit."""
        ids = ids.select("doc_id").distinct()
        gone = cut(self.refs.join(ids, "doc_id", "left_semi").select("a", "b").distinct())
        refs = cut(self.refs.join(ids, "doc_id", "left_anti").select("a", "b", "doc_id"))
        now = _counted(refs.join(gone, ["a", "b"], "left_semi"))
        old = self._latest(gone).select("a", "b", F.col("n").alias("before"))
        touched = old.join(now, ["a", "b"], "left").select("a", "b", "before", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "keep")
        return self._with(refs, touched)

    def _latest(self, keys: DataFrame | None = None) -> DataFrame:
        """(a, b, n, keep) of the keys, or of all."""
        rows = self.counts if keys is None else self.counts.join(keys, ["a", "b"], "left_semi")
        if not self.version:
            return rows.drop("version")
        last = rows.groupBy("a", "b").agg(F.max(F.struct("version", "n", "keep")).alias("last"))
        return last.select("a", "b", "last.n", "last.keep")

    def _with(self, refs: DataFrame, touched: DataFrame) -> LineIndex:
        """touched: (a, b, before, n, keep) of the keys that changed. Keys that cross the limit go into or out of their shard's filter."""
        version = self.version + 1
        touched = cut(touched)
        counts = self.counts.unionByName(touched.select("a", "b", "n", "keep", F.lit(version).alias("version")))
        up = (F.col("before") < LEAST_DOCS) & (F.col("n") >= LEAST_DOCS)
        down = (F.col("before") >= LEAST_DOCS) & (F.col("n") < LEAST_DOCS)
        change = touched.where(up | down).select("a", "b", F.when(up, 1).otherwise(-1).alias("sign"), _shard(self.shards).alias("shard"))

        def apply(key, held, rows):
            f = CuckooFilter.from_bytes(held["filter"].iloc[0]) if len(held) else CuckooFilter.sized(1)
            for k in rows.loc[rows["sign"] < 0, "a"]:
                f.delete(int(k))
            keys = [int(k) for k in rows.loc[rows["sign"] > 0, "a"]]
            full = not all(f.insert(k) for k in keys)
            return pd.DataFrame({"shard": [key[0]], "filter": [None if full else f.to_bytes()]})

        changed = change.groupBy("shard").count().select("shard")
        held = self.filters.join(changed, "shard", "left_semi")
        moved = cut(held.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(apply, "shard int, filter binary"))
        found = LineIndex(refs, counts, self.filters.join(changed, "shard", "left_anti").unionByName(moved.where("filter IS NOT NULL")), self.shards, version)
        full = moved.where("filter IS NULL").select("shard")
        if not full.isEmpty():
            anew = _filters(found.droppable().withColumn("shard", _shard(self.shards)).join(full, "shard", "left_semi").drop("shard"), self.shards).join(full, "shard", "left_semi")
            found.filters = found.filters.unionByName(anew)
        found.filters = cut(found.filters)
        return found

    def droppable(self) -> DataFrame:
        """(a, b, keep): keys of enough documents, and the largest doc_id, which keeps its lines."""
        return self._latest().where(F.col("n") >= LEAST_DOCS).select("a", "b", "keep")

    def candidates(self, docs: DataFrame) -> DataFrame:
        """Rows of references() whose key the filters may hold.

        The filters go to every task if together they stay under SEND_BYTES; beyond that the
        references are dealt by shard and meet their own filter there. A shard with
        more than GROUP_ROWS is parted by document, with a copy of its filter for each part.
        """
        size = self.filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
        if size <= SEND_BYTES:
            return references(docs, {r["shard"]: bytes(r["filter"]) for r in self.filters.toLocalIterator()})
        found = cut(references(docs).withColumn("shard", _shard(self.shards)))
        most = found.groupBy("shard").count().agg(F.max("count")).first()[0] or 1
        parts = -(-most // GROUP_ROWS)
        found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
        held = self.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def test(rows, held):
            if not len(rows) or not len(held):
                return rows[["a", "b", "doc_id"]].iloc[:0]
            f = CuckooFilter.from_bytes(held["filter"].iloc[0])
            return rows.loc[f.contains(rows["a"].to_numpy(np.int64).view(np.uint64)), ["a", "b", "doc_id"]]

        return found.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInPandas(test, "a long, b long, doc_id long")

    def drops(self, docs: DataFrame) -> DataFrame:
        """(doc_id, a, b) of keys that lose all their lines in a document, exactly: what the filters let pass joins the exact
        table. Rows that repeat an id may give a key again. Nothing is grouped by key behind the join, so a key that
        very many documents hold is parted among tasks at run time."""
        return self.candidates(docs).join(self.droppable(), ["a", "b"]).where("doc_id < keep").select("doc_id", "a", "b")


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep"))


def _shard(shards: int):
    """As in references(): the unsigned b modulo the number of shards."""
    high = F.pmod(F.shiftrightunsigned("b", 1), F.lit(shards)) * 2 + F.col("b").bitwiseAND(F.lit(1))
    return F.pmod(high, F.lit(shards)).cast("int")


def _filters(often: DataFrame, shards: int) -> DataFrame:
    """A filter for every shard; a shard has distinct keys only, about SHARD_KEYS of them."""
    keys = often.select("a", _shard(shards).alias("shard"), F.lit(True).alias("real"))
    every = often.sparkSession.range(shards).select(F.lit(0).cast("long").alias("a"), F.col("id").cast("int").alias("shard"), F.lit(False).alias("real"))

    def build(key, rows):
        return pd.DataFrame({"shard": [key[0]], "filter": [CuckooFilter.of(rows.loc[rows["real"], "a"]).to_bytes()]})

    return keys.unionByName(every).groupBy("shard").applyInPandas(build, "shard int, filter binary")


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, digest: bool = False, carry: list[str] = ()) -> DataFrame:
    """Drop lines whose key stands in at least 3 documents, except in the largest doc_id that holds it.

    Returns doc_id, text (the other lines, joined), n_lines, n_dropped, or
    with digest kept_sha256 for the text; the columns in carry come along. The index is that of docs unless
    another is given, so a batch can be cleaned against a corpus.

    A null or empty text is one empty line, which stays (no text comes out as
    null). Rows that repeat an id count as one document. A row without an id
    holds nothing and keeps all. Only doc_id and text are read; no rows give no rows.
    """
    index = index or LineIndex.build(docs)
    drops = index.drops(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("a", "b")).alias("drops"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    rows = rows.join(drops, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "drops", *carry)
    last = "kept_sha256" if digest else "text"

    def run(batches):
        for batch, data, at in slices(batches):
            raw, out, n_lines, n_dropped = data.tobytes(), [], [], []
            for drops, start, end in zip(batch.column(2).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                all_lines = raw[start:end].split(b"\n")
                gone = {(d["a"], d["b"]) for d in drops or ()}
                stay = [x for x in all_lines if line_key(x) not in gone] if gone else all_lines
                kept = b"\n".join(stay)
                out.append(hashlib.sha256(kept).hexdigest() if digest else kept)
                n_lines.append(len(all_lines))
                n_dropped.append(len(all_lines) - len(stay))
            column = pa.array(out, pa.string()) if digest else pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), column, *batch.columns[3:]], ["doc_id", "n_lines", "n_dropped", last, *carry])

    schema = T.StructType().add("doc_id", "long").add("n_lines", "long").add("n_dropped", "long").add(last, "string")
    for c in carry:
        schema.add(docs.schema[c])
    return rows.mapInArrow(run, schema)


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir), digest=True)


OP6_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM split),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
often AS (SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT x.doc_id, x.line, x.i, o.k IS NOT NULL AND x.doc_id <> o.keep AS gone FROM keyed x LEFT JOIN often o ON x.k = o.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
