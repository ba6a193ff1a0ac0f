"""Language-model scores: an n-gram model by deleted interpolation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, mix, release, slices, trim, words

#: Tokens of a chunk and keys of a fragment aimed at; ranges of hashes that one exchange deals out.
CHUNK, FRAGMENT, WIDTH = 1_500_000, 2_500_000, 256
END, BEGIN = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
_ODD = np.uint64(0xA24BAED4963EE407)
#: Buckets by the logarithm of a context's count, for each order; octaves below 1 that the cells of estimates tell apart.
LOGS, OCTAVES = 24, 32


def _pack(x: np.ndarray) -> bytes:
    """Bytes by plane, compressed: small numbers and the high bytes of differences take little."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, np.uint64), dtype=np.uint64)


def _pack_counts(x: np.ndarray) -> bytes:
    """A leading byte tells the width."""
    wide = int(x.max(initial=0) >= 1 << 32)
    return bytes([wide]) + _pack(x.astype(np.uint64 if wide else np.uint32))


def _unpack_counts(raw: bytes) -> np.ndarray:
    return _unpack(raw[1:], np.uint64 if raw[0] else np.uint32).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, so that only its values are in memory as Python objects; what it left is given back behind it."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            trim()


def fold(doc: int | None) -> int:
    """0: held out; 1: held-out counts for the mixture weights; else the rest of the training documents."""
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 10


def _chunks(docs: DataFrame, most: int) -> DataFrame:
    """Tokens of about `most` words of texts as one packed row: vocabulary (sorted hashes), seq (places in it), sizes, ids, and tokens and documents of training and of its held-out fold."""

    def run(batches):
        from pyspark import TaskContext

        number, held, count = TaskContext.get().partitionId() << 32, [], 0
        names = ["chunk", "vocabulary", "seq", "sizes", "ids", "n_tokens", "sums"]

        def flush():
            nonlocal held, count, number
            tokens, sizes = np.concatenate([t for t, _, _ in held]), np.concatenate([s for _, s, _ in held])
            ids, held = [d for _, _, i in held for d in i], []
            vocabulary, seq = np.unique(tokens, return_inverse=True)
            folds = np.array([fold(d) for d in ids])
            sums = [int(x) for x in (sizes[folds > 0].sum(), (folds > 0).sum(), sizes[folds == 1].sum(), (folds == 1).sum())]
            row = [number, _pack_sorted(vocabulary), _pack(seq.astype(np.uint32)), _pack(sizes.astype(np.uint32)), ids, len(tokens), sums]
            count, number = 0, number + 1
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for batch, data, at in slices(batches):
            h, first = words(data, at)
            held.append((np.insert(h, first[1:], END), np.diff(first) + 1, batch.column(0).to_pylist()))
            count += len(held[-1][0])
            if count >= most:
                yield flush()
                trim()
        if held:
            yield flush()
        trim()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "chunk long, vocabulary binary, seq binary, sizes binary, ids array<long>, n_tokens long, sums array<long>")


@dataclass
class _Chunk:
    vocabulary: np.ndarray
    seq: np.ndarray
    sizes: np.ndarray
    ids: list
    first: np.ndarray
    folds: np.ndarray  # by document

    @classmethod
    def of(cls, row: dict) -> _Chunk:
        sizes = _unpack(row["sizes"], np.uint32).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return cls(_unpack_sorted(row["vocabulary"]), _unpack(row["seq"], np.uint32), sizes, row["ids"], first, np.array([fold(d) for d in row["ids"]]))

    def tokens_of(self, chosen: np.ndarray) -> np.ndarray:
        return np.repeat(chosen, self.sizes)

    def grams(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each kind (words before the token: 0 to n - 1) its sorted distinct keys, and each token's place in them."""
        yield 0, self.vocabulary, self.seq
        h = word = self.vocabulary[self.seq]
        for kind in range(1, n):
            before = np.concatenate([h[:1], h[:-1]])
            before[self.first] = BEGIN + np.uint64(kind)
            h = mix(before * _ODD + word)
            keys, place = np.unique(h, return_inverse=True)
            yield kind, keys, place.astype(np.uint32)

    def shifted(self, x: np.ndarray, begin: int) -> np.ndarray:
        """The value of the token before; `begin` where a text begins."""
        out = np.concatenate([x[:1], x[:-1]])
        out[self.first] = begin
        return out


def _cuts(low: int, ranges: int, every: int) -> np.ndarray:
    """Where ranges low + 1 .. low + ranges - 1 of `every` equal ranges of hashes begin."""
    return np.array([(k << 64) // every for k in range(low + 1, low + ranges)], np.uint64)


_PIECE = "kind int, slot long, node long, keys binary, counts binary, held binary"


def _piece_rows(kind: int, low: int, ranges: int, every: int, node: int, keys: np.ndarray, counts: np.ndarray, held: np.ndarray) -> list[tuple]:
    """Sorted keys with their counts, split by range; a range without keys gives no row."""
    ends = np.concatenate([[0], np.searchsorted(keys, _cuts(low, ranges, every)), [len(keys)]])
    return [(kind, low + s, node, _pack_sorted(keys[a:b]), _pack_counts(counts[a:b]), _pack_counts(held[a:b])) for s, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if b > a]


_PIECE_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _columns(rows: list[tuple], kinds: list, names: list[str]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


_PIECE_NAMES = ["kind", "slot", "node", "keys", "counts", "held"]


def _pieces(chunks: DataFrame, n: int, ranges: int) -> DataFrame:
    """For each chunk and range of hashes, the keys and how often training texts, and their held-out fold, have them."""

    def run(batches):
        for row in _rows(batches):
            c = _Chunk.of(row)
            train, second = c.tokens_of(c.folds > 0), c.tokens_of(c.folds == 1)
            for kind, keys, place in c.grams(n):
                counts, held = (np.bincount(place[of], minlength=len(keys)) for of in (train, second))
                rows = _piece_rows(kind, 0, ranges, ranges, row["chunk"], keys, counts, held)
                yield from _columns(rows, _PIECE_TYPES, _PIECE_NAMES).to_batches()

    return chunks.mapInArrow(run, _PIECE)


def _together(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Of the pieces of a group: all keys, each piece's places in them, and the summed counts."""
    keys = [_unpack_sorted(k.as_py()) for k in table.column("keys")]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(place, weights=np.concatenate([_unpack_counts(c.as_py()) for c in table.column(name)]), minlength=len(every)).astype(np.int64) for name in ("counts", "held")]
    return every, np.split(place, np.cumsum([len(k) for k in keys])[:-1]), *sums


_ANSWER = "kind int, slot long, node long, counts binary, held binary, seen long"
_ANSWER_TYPES, _ANSWER_NAMES = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()], ["kind", "slot", "node", "counts", "held", "seen"]


def _replies(table: pa.Table, places: list[np.ndarray], counts: np.ndarray, held: np.ndarray, seen: int) -> pa.Table:
    at = zip(*(table.column(c).to_pylist() for c in ("kind", "slot", "node")), places, strict=True)
    rows = [(kind, slot, node, _pack_counts(counts[p]), _pack_counts(held[p]), 0 if i else seen) for i, (kind, slot, node, p) in enumerate(at)]
    trim()
    return _columns(rows, _ANSWER_TYPES, _ANSWER_NAMES)


def _answers(pieces: DataFrame, nodes: int, every: int, levels: int, width: int) -> DataFrame:
    """For each piece the corpus counts of its keys, in their order; seen: on one row of a range, its keys in training texts.

    The pieces of each of the `every` ranges meet and their counts are added up. With further
    levels about `width` nodes of a range are first made one, which is a node of the
    next level and deals its keys out to `width` smaller ranges; the replies go back the same way. So there
    are about nodes times width pieces on the first level and no more on the others: in proportion to the input.
    """
    if not levels:

        def add(table: pa.Table) -> pa.Table:
            _, places, counts, held = _together(table)
            return _replies(table, places, counts, held, int((counts > 0).sum()))

        return cut(pieces.groupBy("kind", "slot").applyInArrow(add, _ANSWER))
    gangs = max(1, nodes // width)
    pieces = cut(pieces.withColumn("gang", F.pmod(F.xxhash64("node"), F.lit(gangs))))

    def merge(table: pa.Table) -> pa.Table:
        keys, _, counts, held = _together(table)
        kind, slot, gang = (table.column(c)[0].as_py() for c in ("kind", "slot", "gang"))
        trim()
        return _columns(_piece_rows(kind, slot * width, width, every * width, gang, keys, counts, held), _PIECE_TYPES, _PIECE_NAMES)

    below = _answers(pieces.groupBy("kind", "slot", "gang").applyInArrow(merge, _PIECE), gangs, every * width, levels - 1, width)
    release(pieces.sparkSession)

    def back(mine: pa.Table, found: pa.Table) -> pa.Table:
        _, places, *_ = _together(mine)
        found = found.sort_by("slot")
        counts, held = (np.concatenate([_unpack_counts(x.as_py()) for x in found.column(c)]) for c in ("counts", "held"))
        return _replies(mine, places, counts, held, sum(found.column("seen").to_pylist()))

    below = below.withColumn("up", F.expr(f"slot div {width}"))
    return cut(pieces.groupBy("kind", "slot", "gang").cogroup(below.groupBy("kind", "up", "node")).applyInArrow(back, _ANSWER))


def _joined(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    found = answers.groupBy("node").agg(F.collect_list(F.struct("kind", "slot", "counts", "held")).alias("answers"))
    return chunks.join(found, chunks["chunk"] == found["node"])


def _counts(c: _Chunk, answers: list, n: int, column: str) -> list[np.ndarray]:
    """For each kind, how often training texts (or their held-out fold) have each token's n-gram."""
    answers = sorted(answers, key=lambda a: (a["kind"], a["slot"]))
    out = []
    for kind, _, place in c.grams(n):
        out.append(np.concatenate([_unpack_counts(a[column]) for a in answers if a["kind"] == kind])[place])
    return out


@dataclass
class Model:
    """Counts of training (tokens, documents, different tokens) and for each bucket of contexts the weights of kinds 0 .. n - 1 and of all tokens alike."""

    n: int
    tokens: int
    docs: int
    v: int
    weights: np.ndarray

    def contexts(self, c: _Chunk, counts: list[np.ndarray]) -> list[np.ndarray]:
        """For each kind the count of what stands before the token."""
        return [np.full(len(counts[0]), self.tokens), *(c.shifted(x, self.docs) for x in counts[:-1])]

    @staticmethod
    def buckets(contexts: list[np.ndarray]) -> np.ndarray:
        """By the longest context that training texts have, and the logarithm of its count; 0 if they have none."""
        found = np.zeros(len(contexts[0]), np.int64)
        for kind, x in enumerate(contexts[1:], 1):
            found = np.where(x > 0, kind * LOGS + np.minimum(np.log2(np.maximum(x, 1)).astype(np.int64), LOGS - 1), found)
        return found

    @staticmethod
    def estimates(counts: list[np.ndarray], contexts: list[np.ndarray]) -> list[np.ndarray]:
        return [x / np.maximum(y, 1) for x, y in zip(counts, contexts, strict=True)]

    def mixed(self, c: _Chunk, counts: list[np.ndarray]) -> np.ndarray:
        contexts = self.contexts(c, counts)
        w = self.weights[self.buckets(contexts)]
        return sum(w[:, k] * p for k, p in enumerate(self.estimates(counts, contexts))) + w[:, -1] / (self.v + 1)


def _cells(joined: DataFrame, outside: Model) -> DataFrame:
    """Tokens of the held-out fold by bucket and estimates, both from the counts of the other training documents.

    A cell is a bucket and a step of each estimate (quarters of an octave with two kinds, fewer with more, so the
    cells stay under about a million), with the sums of its estimates: the mean stands for the cell.
    """
    n = outside.n
    steps = {1: 16, 2: 4, 3: 1}.get(n, 1)
    most = OCTAVES * steps
    names = ["cell", "tokens", "sums"]

    def run(batches):
        for row in _rows(batches):
            c = _Chunk.of(row)
            chosen = c.tokens_of(c.folds == 1)
            if not chosen.any():
                continue
            counts = [x - y for x, y in zip(_counts(c, row["answers"], n, "counts"), _counts(c, row["answers"], n, "held"), strict=True)]
            contexts = [x[chosen] for x in outside.contexts(c, counts)]
            p = outside.estimates([x[chosen] for x in counts], contexts)
            cell = outside.buckets(contexts)
            for x in p:
                step = np.where(x > 0, np.minimum(-steps * np.log2(np.maximum(x, 2.0**-OCTAVES)), most - 1), most).astype(np.int64)
                cell = cell * (most + 1) + step
            found, at = np.unique(cell, return_inverse=True)
            sums = np.stack([np.bincount(at, weights=x, minlength=len(found)) for x in p], 1)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * n), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(at).astype(np.int64)), values], names)

    rows = joined.mapInArrow(run, "cell long, tokens long, sums array<double>")
    bucket = F.expr(f"cell div {(most + 1) ** n}").alias("bucket")
    return rows.groupBy("cell").agg(F.sum("tokens").alias("tokens"), *(F.sum(F.col("sums")[k]).alias(f"p{k}") for k in range(n))).select(bucket, "tokens", *(f"p{k}" for k in range(n)))


def mixture(bucket: np.ndarray, tokens: np.ndarray, p: np.ndarray, v: int, rounds: int = 100) -> np.ndarray:
    """Weights (bucket x kinds + 1) by expectation-maximisation on held-out counts: so many tokens of a cell with mean estimates p.

    A bucket without held-out tokens has the weights of the nearest lower one of its order, else equal ones.
    """
    n = p.shape[1]
    weights = np.zeros((n * LOGS, n + 1))
    for b in range(n * LOGS):
        kinds = b // LOGS + 1  # estimates that can be above zero
        w = np.append(np.where(np.arange(n) < kinds, 1.0, 0.0), 1.0) / (kinds + 1)
        at = bucket == b
        if at.any():
            x = np.column_stack([p[at], np.full(at.sum(), 1 / (v + 1))])
            for _ in range(rounds):
                share = x * w
                w = (share / share.sum(1, keepdims=True) * tokens[at][:, None]).sum(0) / tokens[at].sum()
            w = 0.999 * w
            w[-1] += 0.001  # never zero for what was not met
        elif b % LOGS:
            w = weights[b - 1]
        weights[b] = w
    return weights


def lm_scores(docs: DataFrame, n: int = 2, chunk: int = CHUNK, fragment: int = FRAGMENT, width: int = WIDTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from documents whose fold() isn't 0; a text's tokens are its words (A-Z
    lower-cased) and one end. score is the sum of log10 of the mixture of the maximum-likelihood estimates of
    orders 1 to n and of all tokens alike. Weights are those of the bucket of the token's context (the longest one that was
    met, by the logarithm of its count) and come from expectation-maximisation on held-out counts: the tokens
    of fold 1 of the training documents, with estimates from the other training documents. The score's own
    estimates then have the counts of all training documents.

    Tokens are stored once, packed in chunks; each chunk asks for its n-grams
    once, ranges of hashes add up the counts of all chunks and answer, through as many exchanges of `width` ranges as the
    input needs. So a word that stands everywhere costs each chunk one key, and no vocabulary is sent
    anywhere. A text longer than a chunk is a chunk of its own.

    A null or empty text is one end token. A null id counts as the empty text in
    the choice of training documents, so it is held out; rows that repeat an id count each. Without training tokens
    all tokens are alike. Only doc_id and text are read; no rows give no rows.
    """
    chunks = cut(_chunks(docs, chunk))
    size = chunks.agg(F.count("*"), F.sum("n_tokens"), *(F.sum(F.col("sums")[k]) for k in range(4))).first()
    if not size[0]:
        return docs.select(F.col("doc_id").cast("long")).where("false").selectExpr("doc_id", "false AS held_out", "0L AS n_tokens", "0L AS n_known", "0L AS train_tokens", "0D AS base_score", "0D AS score")
    tokens, n_docs, held_tokens, held_docs = map(int, size[2:])
    ranges, levels = max(1, -(-int(size[1]) // fragment)), 0
    while ranges > width:
        ranges, levels = -(-ranges // width), levels + 1
    ranges = width if levels else ranges
    answers = _answers(_pieces(chunks, n, ranges), int(size[0]), ranges, levels, width)
    release(docs.sparkSession)
    v = int(answers.where("kind = 0").agg(F.sum("seen")).first()[0] or 0)
    joined = _joined(chunks, answers)
    cells = _cells(joined, Model(n, tokens - held_tokens, n_docs - held_docs, v, np.zeros((0, n + 1)))).toPandas()
    model = Model(n, tokens, n_docs, v, mixture(cells["bucket"].to_numpy(np.int64), cells["tokens"].to_numpy(float), cells[[f"p{k}" for k in range(n)]].to_numpy(float) / cells[["tokens"]].to_numpy(float), v))
    release(docs.sparkSession)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        for row in _rows(batches):
            c = _Chunk.of(row)
            counts = _counts(c, row["answers"], n, "counts")
            by_doc = lambda x: np.add.reduceat(x, c.first)  # noqa: E731, B023
            score = by_doc(np.log10(model.mixed(c, counts)))
            base = by_doc(np.log10((counts[0] + 0.1) / (tokens + 0.1 * (v + 1))))
            known = by_doc((counts[0] > 0).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c.ids, pa.int64()), pa.array(c.folds == 0), pa.array(c.sizes), pa.array(known), pa.array(np.full(len(c.ids), tokens)), pa.array(base), pa.array(score)], names)

    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
