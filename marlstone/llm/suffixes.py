"""Dedup of repeated byte strings by longest-previous-factor arrays over shards of candidate text."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE, cut, documents, mix, signed, slices, trim

#: Bytes of an anchor (a k-gram whose hash is the least of its window); bytes of text in a shard
#: aimed at; bytes of different texts at one anchor beyond which its windows are hashed instead.
ANCHOR, SHARD_BYTES, BIN_BYTES = 32, 1 << 20, 8 << 20


# Suffix arrays ------------------------------------------------------------------------------------


def _order(first: np.ndarray, second: np.ndarray | None, at: np.ndarray, bits: int) -> np.ndarray:
    """The places `at` sorted by one or two keys, ties by place. Keys of `bits` bits (a single one of 32) and
    places are sorted as one number if they fit."""
    width = 32 if second is None else 2 * bits
    if width + bits <= 64:
        key = first if second is None else (first << np.uint64(bits)) | second
        return (np.sort((key << np.uint64(bits)) | at.astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return at[np.lexsort((at, first) if second is None else (at, second, first))]


def suffix_order(texts: list[bytes], sizes: tuple[int, ...]) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each of the ascending sizes, the suffixes that share so many bytes with another, in the order of these
    bytes, ties by place: their places and a rank, equal for equal bytes. Then where each text starts.

    Ranks of 4 bytes are doubled, the last step before a size by two overlapping ones. A rank
    is where its group of equal suffixes begins in the order, so a suffix that is alone keeps it and
    only groups of several are sorted again. A suffix takes part as long as its text goes on, so no
    end marks are needed.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    left = np.repeat(starts + lengths, lengths) - np.arange(len(data))  # bytes from here to the end of the text
    bits = max(1, int(len(data)).bit_length())
    rank, found = np.zeros(len(data), np.uint64), {}
    value, k = data.astype(np.uint64), 1
    while k < 4 and 2 * k <= sizes[0]:
        value = (value[:-k] << np.uint64(8 * k)) | value[k:]
        k *= 2
    at = _order(value[at_ := np.flatnonzero(left >= k)], None, at_, bits)
    new = value[at[1:]] != value[at[:-1]]
    group = np.zeros(len(at), np.uint64)
    del value
    while True:
        # group: the rank that all had before; new: where the order goes on to other bytes.
        begin = np.flatnonzero(np.concatenate([[True], new]))[: len(at)]
        members = np.diff(np.append(begin, len(at)))
        old = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))[: len(at)]
        inside = begin - np.repeat(old, np.diff(np.append(np.searchsorted(begin, old), len(begin)))) if len(begin) else begin
        now = np.repeat(group[begin] + inside.astype(np.uint64), members)
        rank[at] = now
        shared = np.repeat(members > 1, members)
        if k in sizes:
            found[k] = at[shared], now[shared]
            if k == sizes[-1]:
                return found, starts
        step = min(k, next(x for x in sizes if x > k) - k)
        open_ = at[shared]
        open_ = open_[left[open_] >= k + step]
        at = _order(rank[open_], rank[open_ + step], open_, bits)
        group, other = rank[at], rank[at + step]
        new = (group[1:] != group[:-1]) | (other[1:] != other[:-1])
        k += step


def smaller_before(place: np.ndarray) -> np.ndarray:
    """For each entry of a suffix order, the nearest entry before it with a smaller place (-1: none)."""
    n = len(place)
    found = np.arange(-1, n - 1)
    open_ = np.flatnonzero((found >= 0) & (place[np.maximum(found, 0)] > place))
    while len(open_):  # all at once: each jumps over what is known to be larger
        found[open_] = found[found[open_]]
        held = found[open_]
        open_ = open_[(held >= 0) & (place[np.maximum(held, 0)] > place[open_])]
    return found


def long_factors(place: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of the suffix order whether its longest previous factor reaches the size, and its longest next factor.

    The longest match with an earlier place is with the nearest smaller place
    before or after an entry; the rank tells whether it reaches the size. For
    later places the order of places is turned round.
    """
    n = len(place)
    out = []
    for key in (place, -place):
        before = smaller_before(key)
        after = n - 1 - smaller_before(key[::-1])[::-1]
        hit = np.zeros(n, bool)
        for near in (before, np.where(after >= n, -1, after)):
            hit |= (near >= 0) & (rank[np.maximum(near, 0)] == rank)
        out.append(hit)
    return out[0], out[1]


def repeated_windows(texts: list[bytes], sizes: tuple[int, ...], counts: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each size and text, which of its first windows (so many as counts says) also start earlier (in this or an earlier
    text), and which anywhere else. The bytes behind them are those of a text's next run, whose windows aren't a second place."""
    found, starts = suffix_order(texts, sizes)
    own = np.zeros(sum(map(len, texts)) + 1, np.int8)
    np.add.at(own, starts, 1)
    np.add.at(own, starts + np.minimum(counts, [len(t) for t in texts]), -1)
    own = np.cumsum(own) > 0
    out = []
    for size in sizes:
        place, rank = found[size]
        place, rank = place[own[place]], rank[own[place]]
        later, sooner = long_factors(place, rank)
        flags = np.zeros((2, sum(map(len, texts)) + 1), bool)
        flags[0, place], flags[1, place] = later, later | sooner
        out.append([(flags[0, s : s + max(0, len(t) - size + 1)], flags[1, s : s + max(0, len(t) - size + 1)]) for s, t in zip(starts.tolist(), texts, strict=True)])
    return out


def runs_of(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


# Anchored runs ------------------------------------------------------------------------------------


def window_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row, from running minima of blocks of w."""
    n = len(h)
    if n < w:
        return np.zeros(0, h.dtype)
    blocks = np.full(-(-n // w) * w, np.iinfo(h.dtype).max, h.dtype)
    blocks[:n] = h
    blocks = blocks.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchored_runs(data: np.ndarray, at: np.ndarray, size: int):
    """Runs of windows of `size` bytes with the same least anchor hash: (row, start in row, windows, anchor, anchor repeats).

    Equal windows have equal anchors, and every window is in one run.
    """
    lengths = np.diff(at)
    if not (lengths >= size).any():
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64), np.zeros(0, bool)]
    h, k = _BYTE[data], 1
    base = 0x9E3779B97F4A7C15
    while k < ANCHOR:
        h = h[:-k] * np.uint64(base) + h[k:]
        base, k = base * base % (1 << 64), 2 * k
    h = mix(h)
    w = size - ANCHOR + 1
    least = window_least(h, w)
    inside = np.zeros(len(least) + 1, np.int32)
    row = np.flatnonzero(lengths >= size)
    np.add.at(inside, at[row], 1)
    np.add.at(inside, at[row] + lengths[row] - size + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[at[row]] = True
    begin = np.flatnonzero(new & inside)
    stop = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside) + 1
    anchor = least[begin]
    again = np.array([np.count_nonzero(h[a : b + w - 1] == m) > 1 for a, b, m in zip(begin.tolist(), stop.tolist(), anchor, strict=True)], bool)
    rows = np.searchsorted(at, begin, "right") - 1
    # Empty rows share an offset with the next one; the last of equal offsets is the row that has bytes.
    return rows, begin - at[rows], stop - begin, anchor, again


def _named(raw: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(raw)
    a, b = h >> 64, h & ((1 << 64) - 1)
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


#: Stands for a null id inside; the smallest of all.
NO_ID = -(1 << 63)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, (a, b) naming the text, n_bytes, sha."""

    def run(batches):
        for batch, data, at in slices(batches, 16 << 20):
            raw = data.tobytes()
            parts = [raw[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            names = np.array([_named(p) for p in parts], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array(np.diff(at)), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())], ["doc_id", "a", "b", "n_bytes", "sha"])

    return _rows(docs).mapInArrow(run, "doc_id long, a long, b long, n_bytes long, sha string")


def _runs(docs: DataFrame, least: int, reach: int) -> DataFrame:
    """A row for each run of windows of `least` bytes of each text: text (a, b), place (start, windows, anchor repeats), anchor,
    width (bytes, as far as `reach` from its last window's start), content (a hash of these bytes and the number of windows)."""

    def run(batches):
        for batch, data, at in slices(batches):
            raw = data.tobytes()
            rows, start, count, anchor, again = anchored_runs(data, at, least)
            names = np.array([_named(raw[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64).reshape(-1, 2)
            view, begin = memoryview(raw), at[rows] + start
            width = np.minimum(count + reach - 1, at[rows + 1] - begin)
            content = np.array([xxhash.xxh3_64_intdigest(view[s:e], n) for s, e, n in zip(begin.tolist(), (begin + width).tolist(), count.tolist(), strict=True)], np.uint64)
            place = (start << 31) | (count << 1) | again
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (names[rows, 0], names[rows, 1], place, signed(anchor), width, signed(content))], ["a", "b", "place", "anchor", "width", "content"])

    return _rows(docs).mapInArrow(run, "a long, b long, place long, anchor long, width long, content long")


def _bytes_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of wanted runs (_id, a, b, runs: array of (anchor, content, place, width)): anchor, content, first, windows, text."""
    rows = _rows(docs).join(wanted, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "a", "b", "runs")
    names = ["anchor", "content", "doc", "start", "count", "bytes"]

    def run(batches):
        for batch, data, at in slices(batches):
            raw, out = data.tobytes(), [[] for _ in names]
            for doc, a, b, runs, s, e in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if _named(raw[s:e]) == (a, b):
                    for r in runs:
                        begin = r["place"] >> 31
                        for c, v in zip(out, (r["anchor"], r["content"], doc, begin, (r["place"] & 0x7FFFFFFF) >> 1, raw[s + begin : s + begin + r["width"]]), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 5 + [pa.binary()], strict=True)], names)

    found = rows.mapInArrow(run, "anchor long, content long, doc long, start long, count long, bytes binary")
    return found.dropDuplicates(["anchor", "content"])


_RANGES = "array<struct<s:int,e:int>>"


def _flags(levels: int) -> str:
    return "anchor long, content long, " + ", ".join(f"later{k} {_RANGES}, every{k} {_RANGES}" for k in range(levels))


def _by_suffixes(texts: DataFrame, sizes: tuple[int, ...], shards: int) -> DataFrame:
    """Flagged ranges of windows of each text, for each size: shards of whole anchors, each a suffix array."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc", "start"])
        ranges = lambda f: [{"s": s, "e": e} for s, e in zip(*runs_of(f), strict=True)]
        out = {"anchor": rows["anchor"].to_numpy(), "content": rows["content"].to_numpy()}
        for k, flags in enumerate(repeated_windows(rows["bytes"].tolist(), sizes, rows["count"].to_numpy())):
            out[f"later{k}"], out[f"every{k}"] = [ranges(f) for f, _ in flags], [ranges(f) for _, f in flags]
        found = pd.DataFrame(out)
        trim()
        return found

    return texts.groupBy(F.pmod("anchor", F.lit(shards))).applyInPandas(solve, _flags(len(sizes)))


def _by_windows(texts: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """The same for anchors with very much text: each window's 128-bit hash is counted."""

    def hashed(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                view = memoryview(row["bytes"])
                for level, size in enumerate(sizes):
                    names = np.array([_named(view[i : i + size]) for i in range(min(row["count"], len(view) - size + 1))], np.int64).reshape(-1, 2)
                    k = len(names)
                    same = [pa.array(np.full(k, row[c], np.int64)) for c in ("anchor", "content", "doc", "start")]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(k, level, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy())], ["anchor", "content", "doc", "start", "level", "i", "w1", "w2"])

    w = cut(texts.mapInArrow(hashed, "anchor long, content long, doc long, start long, level int, i int, w1 long, w2 long"))
    first = w.groupBy("level", "w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("doc", "start", "i")).alias("first")).where("n > 1")
    hit = w.join(first, ["level", "w1", "w2"]).withColumn("later", F.struct("doc", "start", "i") > F.col("first"))
    one = F.struct(F.col("i").alias("s"), (F.col("i") + 1).alias("e"))
    none = F.array().cast(_RANGES)
    of = lambda k: (F.collect_list(F.when((F.col("level") == k) & F.col("later"), one)).alias(f"later{k}"), F.collect_list(F.when(F.col("level") == k, one)).alias(f"every{k}"))
    flagged = hit.groupBy("anchor", "content").agg(*(c for k in range(len(sizes)) for c in of(k)))
    names = [f"{what}{k}" for k in range(len(sizes)) for what in ("later", "every")]
    return w.select("anchor", "content").distinct().join(flagged, ["anchor", "content"], "left").select("anchor", "content", *(F.coalesce(c, none).alias(c) for c in names))


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def dedup_spans(docs: DataFrame, size: int = 400, keep: str = "first", passage: int | None = None, bin_bytes: int = BIN_BYTES, digest: bool = False) -> DataFrame:
    """Remove repeated strings: doc_id, n_bytes, n_removed, n_spans, kept (bytes), or with digest kept_sha256.

    A byte goes if a string of `size` bytes over it also starts elsewhere:
    with keep="first" at an earlier place (smaller doc_id, then place), with
    keep="none" at any other, in this text or another. With passage (fewer bytes than size), n_shared follows: the
    bytes in strings of that length that also start at any other place; they aren't removed for it.

    Windows are dealt by their anchor (the least k-gram hash in the shorter of both lengths), which equal
    windows share; anchors met once are done with. At the others equal runs are
    one. Where runs differ, their bytes go to shards of whole
    anchors, and a suffix array with its longest-previous-factor array tells which windows
    repeat. An anchor with more than bin_bytes of different runs has its
    windows counted by hash instead, so no shard grows with a group of copies.

    Texts are judged as UTF-8; a null text is empty and loses nothing; rows that
    repeat an id or text are copies of each other (with keep="first" rows of the
    smallest id keep the text); a null id counts as the smallest, and the smallest long as a null id.
    Only doc_id and text are read; no rows give no rows.
    """
    none = keep == "none"
    sizes = (passage, size) if passage else (size,)
    if passage and passage >= size:
        raise ValueError("a passage is shorter than the strings that are removed")
    top = len(sizes) - 1
    texts = cut(_texts(docs))
    by_text = texts.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.min("n_bytes").alias("n_bytes"), F.min("sha").alias("sha"))
    runs = cut(_runs(docs, sizes[0], size))
    bins = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("c1"), F.max("content").alias("c2"), F.max(F.col("place").bitwiseAND(F.lit(1))).alias("again")).where("n > 1 OR again = 1")
    alone = (F.col("c1") == F.col("c2")) & (F.col("again") == 0)
    found = runs.join(bins.select("anchor", alone.alias("equal")), "anchor").select("a", "b", "place", "anchor", "width", "content", "equal").distinct()
    found = cut(found.join(by_text.select("a", "b", "rep"), ["a", "b"]))

    first = F.min(F.struct(F.col("rep"), F.col("place"), F.col("a"), F.col("b"))).alias("first")
    heads = found.groupBy("anchor", "content", "equal", "width").agg(first)
    differ = cut(heads.where("NOT equal"))
    weight = differ.groupBy("anchor").agg(F.sum("width").alias("bytes"))
    total = weight.agg(F.sum("bytes")).first()[0] or 0
    heavy = cut(weight.where(F.col("bytes") > bin_bytes).select("anchor"))
    wanted = differ.groupBy(F.col("first.rep").alias("_id"), F.col("first.a").alias("a"), F.col("first.b").alias("b")).agg(F.collect_list(F.struct("anchor", "content", F.col("first.place").alias("place"), "width")).alias("runs"))
    pieces = _bytes_of(docs, wanted)
    shards = max(1, int(total) // SHARD_BYTES)
    if heavy.isEmpty():
        flags = _by_suffixes(pieces, sizes, shards)
    else:
        flags = _by_suffixes(pieces.join(heavy, "anchor", "left_anti"), sizes, shards).unionByName(_by_windows(pieces.join(heavy, "anchor", "left_semi"), sizes))

    # Ranges of windows, then of bytes, of each text; k tells the size.
    start, count = F.shiftright("place", 31), F.shiftright(F.col("place").bitwiseAND(F.lit(0x7FFFFFFF)), 1)
    windows = [F.least(count, F.col("width") - (n - 1)).cast("int") for n in sizes]
    at = found.join(heads.select("anchor", "content", "first"), ["anchor", "content"])
    is_first = (F.col("first.rep") == F.col("rep")) & (F.col("first.place") == F.col("place")) & (F.col("first.a") == F.col("a")) & (F.col("first.b") == F.col("b"))
    empty = F.array().cast(_RANGES)
    whole = [F.when(n > 0, F.array(F.struct(F.lit(0).cast("int").alias("s"), n.alias("e")))).otherwise(empty) for n in windows]
    keeps_first = lambda k: not none and k == top
    sure = [F.when(is_first, empty).otherwise(w) if keeps_first(k) else w for k, w in enumerate(whole)]
    some = [F.when(is_first, F.col(f"later{k}")).otherwise(w) if keeps_first(k) else F.when(F.col("copied"), w).otherwise(F.col(f"every{k}")) for k, w in enumerate(whole)]
    bytes_ = lambda r, k: F.transform(r, lambda x: F.struct(F.lit(k).alias("k"), (F.col("start") + x["s"]).alias("s"), (F.col("start") + x["e"] + (sizes[k] - 1)).alias("e")))
    names = [f"r{k}" for k in range(len(sizes))]
    settled = at.where("equal").select("a", "b", "rep", start.alias("start"), *(r.alias(n) for r, n in zip(sure, names, strict=True)))
    judged = at.where("NOT equal").join(flags, ["anchor", "content"]).withColumn("copied", F.count("*").over(_over("anchor", "content")) > 1)
    judged = judged.select("a", "b", "rep", start.alias("start"), *(r.alias(n) for r, n in zip(some, names, strict=True)))
    spans = settled.unionByName(judged).select("a", "b", "rep", F.explode(F.concat(*(bytes_(F.col(n), k) for k, n in enumerate(names)))).alias("r"))
    spans = spans.groupBy(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("rep").alias("_id")).agg(F.collect_list("r").alias("spans"))
    rows = _rows(docs).join(spans, F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("_a").alias("a"), F.col("_b").alias("b"), "spans")
    last, kind = ("kept_sha256", pa.string()) if digest else ("kept", pa.binary())

    def strip(batches):
        for batch, data, at_ in slices(batches):
            raw, out = data.tobytes(), [[] for _ in range(6)]
            for a, b, spans_, s, e in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), at_[:-1].tolist(), at_[1:].tolist(), strict=True):
                text = raw[s:e]
                if _named(text) != (a, b):
                    continue
                merged = _merged([(r["s"], r["e"]) for r in spans_ if r["k"] == top])
                shared = sum(y - x for x, y in _merged([(r["s"], r["e"]) for r in spans_ if r["k"] < top]))
                kept, done = [], 0
                for x, y in merged:
                    kept.append(text[done:x])
                    done = y
                kept = b"".join([*kept, text[done:]])
                for c, v in zip(out, (a, b, len(text) - len(kept), len(merged), shared, hashlib.sha256(kept).hexdigest() if digest else kept), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 5 + [kind], strict=True)], ["_a", "_b", "n_removed", "n_spans", "n_shared", last])

    done = rows.mapInArrow(strip, f"_a long, _b long, n_removed long, n_spans long, n_shared long, {last} {'string' if digest else 'binary'}").dropDuplicates(["_a", "_b"])
    joined = texts.join(by_text.select("a", "b", "rep", "n"), ["a", "b"]).join(done, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    # A text with copies goes whole: each of its windows starts in the copy too.
    goes = (F.col("n") > 1) & (F.col("n_bytes") >= size)
    if not none:
        goes = goes & ~F.col("doc_id").eqNullSafe(F.col("rep"))
    void = F.lit(hashlib.sha256(b"").hexdigest()) if digest else F.lit(b"")
    own = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    none_ = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    removed = F.when(goes, F.col("n_bytes")).otherwise(none_("n_removed")).alias("n_removed")
    n_spans = F.when(goes, 1).otherwise(none_("n_spans")).cast("long").alias("n_spans")
    shared = [F.when((F.col("n") > 1) & (F.col("n_bytes") >= passage), F.col("n_bytes")).otherwise(none_("n_shared")).alias("n_shared")] if passage else []
    if digest:
        return joined.select(own, "n_bytes", removed, n_spans, F.when(goes, void).otherwise(F.coalesce(last, "sha")).alias(last), *shared)
    result = joined.select(F.col("doc_id").alias("_doc"), F.col("sha").alias("_sha"), "n_bytes", removed, n_spans, F.when(goes, void).otherwise(F.col(last)).alias("_kept"), *shared).distinct()
    named = _rows(docs).withColumn("_text", F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    back = named.join(result, (F.col("doc_id") == F.col("_doc")) & (F.sha2("_text", 256) == F.col("_sha")))
    return back.select(own, "n_bytes", "n_removed", "n_spans", F.coalesce("_kept", "_text").alias(last), *(["n_shared"] if passage else []))


#: Bytes of a passage of over 50 words, taken low: five a word.
PASSAGE = 256


def _over(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(documents(spark, sf_dir), keep="none", passage=PASSAGE, digest=True)
