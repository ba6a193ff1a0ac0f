"""Cross-tokenizer alignment: tokens of two vocabularies linked by the bytes that they cover."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import rank_bytes
from .common import documents, fresh_dir, mix, removed, settings, slices, stored, trim

#: Bytes of texts that share a list of units (or one longer text); bytes whose units are hashed together.
CHUNK, _BLOCK = 16 << 20, 1 << 20
_PAIR = 1 << 32
_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum()) + b"\n\t"
_ODD = np.random.default_rng(77).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def safe_marks(vocabulary: str, model: bytes) -> bytes:
    """The ASCII marks before which both tokenizers cut after any letter, once the two files are known to allow units at all.

    The first must split by the byte-level pattern, which ends a match before a space that follows anything but
    white space, and after letters before whatever is none. In the second no piece may hold a space after another
    character, or a line feed; and a mark is safe if no piece has it after a letter. Merges then never cross such a place.
    """
    import sentencepiece

    kind = json.loads(vocabulary)
    before = kind["pre_tokenizer"] or {}
    if kind["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space"):
        raise ValueError("the first vocabulary must be byte-level with its pattern, without a normalizer or prefix")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [p for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for p in [sp.id_to_piece(i)]]
    pairs = {(x, y) for p in pieces for x, y in zip(p, p[1:], strict=False)}
    if any(y == "▁" != x for x, y in pairs) or any("\n" in p for p in pieces) or [sp.id_to_piece(i) for i in sp.encode("\n  a")][:3] != ["▁", "<0x0A>", "▁"]:
        raise ValueError("the second vocabulary has pieces across spaces or line feeds, or drops spaces")
    unsafe = {y for x, y in pairs if x.isalpha()}
    return bytes(c for c in _MARKS if chr(c) not in unsafe)


def unit_starts(data: np.ndarray, at: np.ndarray, marks: bytes) -> np.ndarray:
    """Where units begin: each text, a space after a character that is surely none, a safe mark after a Latin letter."""
    kind = np.zeros(256, np.uint8)
    kind[np.frombuffer(marks, np.uint8)] = 2
    kind[0x20] = 1
    place = np.flatnonzero(kind[data])
    place = place[place > 2]
    what, p1, p2, p3 = kind[data[place]], data[place - 1], data[place - 2], data[place - 3]
    tail = (p1 & 0xC0) == 0x80
    two, three = tail & (p2 >= 0xC3) & (p2 <= 0xDF), tail & ((p2 & 0xC0) == 0x80) & ((p3 == 0xE0) | (p3 >= 0xE4)) & (p3 < 0xF0)
    solid = ((p1 > 0x20) & (p1 < 0x7F)) | two | three
    latin = tail & (p2 >= 0xC3) & (p2 <= 0xC8) & ~((p2 == 0xC3) & ((p1 == 0x97) | (p1 == 0xB7)))
    letter = ((p1 | 0x20) >= 0x61) & ((p1 | 0x20) <= 0x7A) | latin
    begins = np.zeros(len(data) + 1, bool)
    begins[place[np.where(what == 1, solid, letter)]] = True
    begins[at] = True
    return np.flatnonzero(begins[:-1])


def _hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each unit, block by block."""
    out, end, done = np.empty((2, len(start)), np.uint64), np.append(start[1:], len(data)), 0
    while done < len(start):
        last = max(done + 1, int(np.searchsorted(end, start[done] + _BLOCK, "right")))
        first, block = start[done:last] - start[done], data[start[done] : end[last - 1]]
        size = end[done:last] - start[done:last]
        place = np.arange(len(block)) - np.repeat(first, size)
        for k in range(2):
            power = np.full(int(size.max()), _BASES[k], np.uint64)
            power[0] = 1
            out[k, done:last] = mix(np.add.reduceat(_ODD[k][block] * np.cumprod(power)[place], first) + size.astype(np.uint64))
        done = last
    return out


def distinct_units(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first place of each distinct unit, which one each unit is)."""
    h = _hashes(data, start)
    _, index, which = np.unique(h[0], return_index=True, return_inverse=True)
    if (h[1][index][which] != h[1]).any():  # one hash fits two units: both hashes name them
        _, index, which = np.unique(h.T.copy().view([("x", np.uint64), ("y", np.uint64)]).ravel(), return_index=True, return_inverse=True)
    return index, which


def short_numbers(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each number ends): seven bits a byte, the lowest first, an eighth where more follow; up to 28 bits."""
    size = 1 + (n >= 1 << 7) + (n >= 1 << 14) + (n >= 1 << 21)
    ends = np.cumsum(size)
    out, first = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8), ends - size
    for k in range(4):
        some = size > k
        out[first[some] + k] = ((n[some] >> 7 * k) & 127) | ((size[some] > k + 1).astype(np.int64) << 7)
    return out, ends


def long_numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, where each ends) of short_numbers' bytes."""
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64) if len(last) else last
    size, n = last - first + 1, np.zeros(len(last), np.int64)
    for k in range(4):
        some = size > k
        n[some] |= (data[first[some] + k] & 127).astype(np.int64) << 7 * k
    return n, last + 1


def _cut(docs: DataFrame, marks: bytes, chunk: int) -> DataFrame:
    """Rows of two kinds: a document with the numbers of its units in order, and a unit of a chunk with its number."""

    def run(batches: Iterator[pa.RecordBatch]):
        number = TaskContext.get().partitionId() << 24
        for batch, data, at in slices(batches, chunk, 1 << 20):
            rows, number = batch.num_rows, number + 1
            data, at = np.insert(data, at[:-1], 0x20), at + np.arange(rows + 1)
            start = unit_starts(data, at[:-1], marks)
            index, which = distinct_units(data, start)
            common = np.argsort(-np.bincount(which), kind="stable")  # frequent units have small numbers, which take a byte
            index, which = index[common], np.argsort(common)[which]
            numbers, ends = short_numbers(which)
            bounds = np.concatenate([[0], ends])[np.searchsorted(start, at)]
            some = pa.array(np.diff(at) > 1)
            order = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(numbers)]).cast(pa.binary())
            null = lambda n, kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, number)), batch.column(0), pa.compute.if_else(some, order, None), null(rows, pa.int32()), null(rows, pa.string())], NAMES)
            end = np.append(start[1:], len(data))[index]
            size = end - start[index]
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            flat = np.arange(offsets[-1]) + np.repeat(start[index] - offsets[:-1], size)
            units = pa.StringArray.from_buffers(len(index), pa.py_buffer(offsets), pa.py_buffer(data[flat]))
            for a in range(0, len(index), 1 << 16):
                part = units.slice(a, 1 << 16)
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), null(n, pa.int64()), null(n, pa.binary()), pa.array(np.arange(a, a + n, dtype=np.int32)), part], NAMES)

    NAMES = ["chunk", "doc_id", "units", "number", "unit"]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "chunk long, doc_id long, units binary, number int, unit string")


def _tokens(units: DataFrame, vocabulary: str, model: bytes) -> DataFrame:
    """unit, a and b: the tokens (t) of both and their bytes (n); none where the bytes of either aren't the unit's."""
    sent = units.sparkSession.sparkContext.broadcast((vocabulary, model))

    def run(batches: Iterator[pa.RecordBatch]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        first = Tokenizer.from_str(sent.value[0])
        first.encode_special_tokens = True
        second = sentencepiece.SentencePieceProcessor(model_proto=sent.value[1])
        # The byte of each character of byte-level entries: printable Latin ones are themselves, the others follow from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        assert set(byte) == set(ByteLevel.alphabet())
        entry = {i: bytes(byte[c] for c in token) for token, i in first.get_vocab(with_added_tokens=False).items()}
        piece = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in range(second.get_piece_size()) for p in [second.id_to_piece(i)]]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                texts = part.column(0).to_pylist()
                sides = [[x.ids for x in first.encode_batch(texts, add_special_tokens=False)], [x[2:] for x in second.encode(["\n" + t for t in texts], num_threads=1)]]
                out = []
                for table, ids in zip((entry, piece), sides, strict=True):
                    raw = [[table[i] for i in x] for x in ids]
                    out.append((ids, raw))
                whole = [b"".join(x) == t.encode() == b"".join(y) for t, x, y in zip(texts, out[0][1], out[1][1], strict=True)]
                columns = [part.column(0)]
                for ids, raw in out:
                    kept = [x if ok else [] for x, ok in zip(ids, whole, strict=True)]
                    flat = pa.StructArray.from_arrays([pa.array([i for x in kept for i in x], pa.int32()), pa.array([len(r) for x, ok in zip(raw, whole, strict=True) if ok for r in x], pa.int32())], ["t", "n"])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)), flat))
                yield pa.RecordBatch.from_arrays(columns, ["unit", "a", "b"])

    return units.mapInArrow(run, "unit string, a array<struct<t: int, n: int>>, b array<struct<t: int, n: int>>")


def align(tokens: DataFrame) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, pairs and groups of each sequence: tokens has id, a and b (arrays of t and n).

    Tokens are exploded with their places, their lengths summed up in order, and both sides meet where they end at the same
    byte of the same sequence. The count of such cuts before a token's end is its group. A group's links are all its
    pairs of occurrences: pairs has each pair of ids (p: the first times 2^32 plus the second) and how often (m).
    """

    def ends(side: str) -> DataFrame:
        each = tokens.select("id", F.posexplode(side).alias("place", "x"))
        end = F.sum("x.n").over(Window.partitionBy("id").orderBy("place"))
        return each.select("id", F.col("x.t").alias(side), end.alias("end"))

    met = ends("a").join(ends("b"), ["id", "end"], "full")
    before = Window.partitionBy("id").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    grouped = met.withColumn("g", F.coalesce(F.sum(cut).over(before), F.lit(0))).groupBy("id", "g").agg(F.sort_array(F.collect_list(F.struct("end", "a", "b"))).alias("x"))
    of = lambda side: F.filter(F.transform("x", lambda e: e[side]), lambda t: t.isNotNull())
    grouped = grouped.select("id", "g", of("a").alias("a"), of("b").alias("b"))
    times = lambda side: F.transform(F.array_distinct(side), lambda t: F.struct(t.alias("t"), F.size(F.filter(side, lambda u: u == t)).cast("long").alias("m")))
    pairs = F.flatten(F.transform(times("a"), lambda x: F.transform(times("b"), lambda y: F.struct((x["t"].cast("long") * _PAIR + y["t"]).alias("p"), (x["m"] * y["m"]).alias("m")))))
    text = F.concat(F.array_join("a", ","), F.lit("|"), F.array_join("b", ","))
    total = lambda side: F.sum(F.size(side).cast("long"))
    whole = grouped.groupBy("id").agg(
        total("a").alias("n_a"), total("b").alias("n_b"), F.count("*").alias("n_groups"), F.sum(F.size("a").cast("long") * F.size("b")).alias("n_links"),
        F.sort_array(F.collect_list(F.struct("g", text.alias("text"), pairs.alias("pairs")))).alias("x"),
    )
    return whole.select("id", "n_a", "n_b", "n_groups", "n_links", F.flatten("x.pairs").alias("pairs"), F.array_join("x.text", ";").alias("groups"))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.diff(offsets))])


def _sequences(docs: pa.Table, units: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The documents of a chunk all of whose units have tokens, the others, the former's units one after the other and where each
    begins, and which units have tokens."""
    some = docs.filter(pa.compute.is_valid(docs["units"]))
    raw = some["units"].combine_chunks() if some.num_rows else pa.array([], pa.binary())
    raw = pa.concat_arrays(raw.chunks) if isinstance(raw, pa.ChunkedArray) else raw
    which, ends = long_numbers(np.frombuffer(b"".join(raw.to_pylist()), np.uint8))
    at = np.searchsorted(ends, np.concatenate([[0], np.cumsum(pa.compute.binary_length(raw).to_numpy(zero_copy_only=False))]), "right")
    known = np.zeros(int(max(which.max(initial=-1), units["number"].to_numpy().max(initial=-1))) + 1, bool)
    known[units["number"].to_numpy()] = True
    whole = np.logical_and.reduceat(known[which], at[:-1]) if some.num_rows else np.zeros(0, bool)
    size = np.diff(at)
    kept = which[np.repeat(whole, size)]
    others = pa.concat_tables([docs.filter(pa.compute.is_null(docs["units"])), some.filter(pa.array(~whole))])
    return some.filter(pa.array(whole)), others, kept, np.concatenate([[0], np.cumsum(size[whole])]), known


def _pairs_of_chunk(docs: pa.Table, units: pa.Table) -> pa.Table:
    """How many documents of the chunk hold each pair."""
    if not docs.num_rows or not units.num_rows:
        return pa.table({"p": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    rows, _, which, at, known = _sequences(docs, units)
    pair, bounds = _flat(units["pairs"])
    names, local = np.unique(pair, return_inverse=True)
    if not len(which) or not len(names):
        return pa.table({"p": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    row = np.zeros(len(known), np.int64)
    row[units["number"].to_numpy()] = np.arange(units.num_rows)
    n, count = len(known), np.zeros(len(names), np.int64)
    # Documents go in runs, so that the pairs of a run stay few.
    sizes = np.diff(bounds)[row]
    load = np.cumsum(sizes[which])
    first = 0
    while first < rows.num_rows:
        last = max(first + 1, int(np.searchsorted(load[at[1:] - 1], (load[at[first] - 1] if at[first] else 0) + 2_000_000, "right")))
        doc = np.repeat(np.arange(last - first), np.diff(at[first : last + 1]))
        once = np.unique(doc * n + which[at[first] : at[last]])
        doc, unit = once // n, row[once % n]
        many = np.diff(bounds)[unit]
        flat = np.arange(many.sum()) + np.repeat(bounds[unit] - (np.cumsum(many) - many), many)
        held = np.unique(np.repeat(doc, many) * len(names) + local[flat])
        count += np.bincount(held % len(names), minlength=len(names))
        first = last
    some = np.flatnonzero(count)
    trim()
    return pa.table({"p": pa.array(names[some], pa.int64()), "n": pa.array(count[some])})


SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _documents_of_chunk(digest: bool):
    nothing = pa.table({"number": pa.array([], pa.int32()), "groups": pa.array([], pa.string()), **{c: pa.array([], pa.int64()) for c in SUMS}})

    def run(docs: pa.Table, units: pa.Table) -> pa.Table:
        if not units.num_rows:
            units = nothing
        rows, others, which, at, known = _sequences(docs, units)
        number = units["number"].to_numpy()
        texts = np.empty(len(known), object)
        texts[number] = np.array(units["groups"].to_pylist() + [None], object)[:-1]
        n = others.num_rows
        columns = {"doc_id": pa.concat_arrays([c for x in (rows, others) for c in x["doc_id"].chunks] or [pa.array([], pa.int64())])}
        for c in SUMS:
            of = np.zeros(len(known), np.int64)
            of[number] = units[c].to_numpy()
            total = np.add.reduceat(of[which], at[:-1]) if rows.num_rows else np.zeros(0, np.int64)
            columns[c] = pa.array(np.concatenate([total, np.zeros(n, np.int64)]))
        joined = (";".join(texts[which[a:b]].tolist()) for a, b in zip(at[:-1], at[1:], strict=True))
        columns["groups"] = pa.array([hashlib.sha256(x.encode()).hexdigest() if digest else x for x in joined] + [""] * n, pa.string())
        trim()
        return pa.table(columns)

    return run


def align_tokens(docs: DataFrame, vocabulary_file: str | None = None, model_file: str | None = None, digest: bool = False, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Links between the tokens of space+text in a byte-level vocabulary (A) and in a piece model (B, which adds the space).

    The first frame has a row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (a1,a2|b1;...,
    or its sha256 with digest). The second has a row for each pair of ids: a, b, n_docs (documents in which they are linked) and best
    (n_docs is the highest of its A id).

    Both vocabularies cut at known places whatever stands around (safe_marks), so texts are sequences of units that are tokenised
    and aligned once for the whole corpus, relationally (align): a third of all rows in one text or a word in every
    document is one unit. Texts are cut where they lie; about `chunk` bytes of them share a list of their units, which then meets
    the units' results by an equi-join, and the documents of a chunk are put together from them. Units are named
    by themselves; within a chunk by two 64-bit hashes. Files are read on the driver and sent to the tasks (2 MB).

    A text without a safe place is one unit. Null and empty texts, and those of which a unit's bytes aren't joined again by its
    tokens, have zeros and an empty `groups`, and count for no pair. Rows that repeat, or share an id, are documents of their own;
    a null id passes through; only doc_id and text are read; no rows give no rows. All but the last join runs when the frames are built.
    """
    import public_tokenizers as public

    spark = docs.sparkSession
    vocabulary = rank_bytes(vocabulary_file or public.path("byte_bpe_50k.json")).decode()
    model = rank_bytes(model_file or public.path("piece_bpe_32k.model"))
    at = fresh_dir(spark, "alignment")

    written = lambda df, name: stored(df, f"{at}/{name}")
    cut = _cut(docs, safe_marks(vocabulary, model), chunk).withColumn("kind", F.when(F.col("unit").isNull(), "texts").otherwise("units"))
    stored(cut, f"{at}/parts", "kind")
    part = lambda kind, *columns: spark.read.schema(cut.schema).parquet(f"{at}/parts").where(F.col("kind") == kind).select(*columns)
    rows, units = part("texts", "chunk", "doc_id", "units"), part("units", "chunk", "number", "unit")
    tokens = written(_tokens(units.select("unit").distinct(), vocabulary, model).withColumn("id", F.monotonically_increasing_id()), "tokens")
    with settings(spark, spark__sql__requireAllClusterKeysForCoPartition="false"):  # both sides are dealt by id, enough for a join on id and end
        aligned = align(tokens.where("size(a) > 0").select("id", "a", "b").repartition("id"))
        aligned = written(aligned.join(tokens.select("id", "unit"), "id"), "aligned")
    removed(spark, f"{at}/tokens")
    once = aligned.select("unit", F.array_distinct("pairs.p").alias("pairs"))
    held = rows.where("units IS NOT NULL").groupBy("chunk").cogroup(units.join(once, "unit").drop("unit").groupBy("chunk")).applyInArrow(_pairs_of_chunk, "p long, n long")
    counted = written(held.groupBy("p").agg(F.sum("n").alias("n_docs")).withColumn("a", F.shiftright("p", 32).cast("int")), "counted")
    most = counted.groupBy("a").agg(F.max("n_docs").alias("most"))
    pairs = counted.join(most, "a").select("p", "a", (F.col("p") % _PAIR).cast("int").alias("b"), "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    linked = aligned.select("id", F.explode("pairs").alias("x")).select("id", "x.*").join(pairs, "p")
    sums = linked.groupBy("id").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("n_docs") * F.col("m")).alias("count_sum"))
    valued = aligned.join(sums, "id").select("unit", "groups", *SUMS)
    valued = written(units.join(valued, "unit").drop("unit"), "valued")
    for done in ("aligned", "parts/kind=units"):
        removed(spark, f"{at}/{done}")
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in SUMS) + ", groups string"
    found = rows.groupBy("chunk").cogroup(valued.groupBy("chunk")).applyInArrow(_documents_of_chunk(digest), schema)
    return found, pairs.select("a", "b", "n_docs", "best")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = align_tokens(documents(spark, sf_dir), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")
