"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Texts longer than this many characters are cut at safe places before they are encoded.
PIECE = 1 << 20
_SAFE = re.compile(r"(?<=\S)(?=[ \t\r\n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def safe_pieces(text: str, piece: int = PIECE) -> Iterator[str]:
    """Cut a text where a match of the pattern ends whatever stands around.

    No alternative of the pattern matches a white space after anything else, or
    a digit next to a letter, so a match ends there, and its look-ahead only
    looks to the right of a white space. Without such a place the rest stays whole.
    """
    start = 0
    while len(text) - start > piece:
        found = _SAFE.search(text, start + piece)
        if not found or found.start() >= len(text):
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def rank_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode_text(enc, text: str, piece: int = PIECE) -> list[int]:
    if len(text) <= piece:
        return enc.encode_ordinary(text)
    return [t for part in safe_pieces(text, piece) for t in enc.encode_ordinary(part)]


SCHEMA = "doc_id long, ids array<int>, decoded binary"


def bpe_encode(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None, digest: bool = False) -> DataFrame:
    """Token ids of every text and the bytes that they decode to: doc_id, ids, decoded.

    With digest, a few numbers instead: doc_id, n_tokens, ids_sha256 (of the
    decimal ids joined by a space), decoded_sha256. The rank file (a path on
    the driver; under 2 MB, sent to the executors once) and the pattern are
    parameters. Rows go through Arrow in batches and nothing is shuffled.

    A null text is empty and has no tokens; null and repeated ids pass
    through; only doc_id and text are read; no rows give no rows.
    """
    import public_tokenizers as public

    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(rank_bytes(rank_file or public.path("byte_bpe_50k.tiktoken")))
    pattern = pattern or public.PATTERN

    def run(batches):
        enc = encoding(ranks.value, pattern)
        names = [b"%d " % i for i in range(enc.max_token_value + 1)]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = [[], [], []]
                for text in part.column(1).to_pylist():
                    ids = encode_text(enc, text or "")
                    raw = enc.decode_bytes(ids)
                    if digest:
                        out[0].append(len(ids))
                        out[1].append(hashlib.sha256(b"".join([names[i] for i in ids])[:-1]).hexdigest())
                        out[2].append(hashlib.sha256(raw).hexdigest())
                    else:
                        out[0].append(ids)
                        out[1].append(raw)
                ids = part.column(0).cast(pa.int64())
                if digest:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.binary())], ["doc_id", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else SCHEMA
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(documents(spark, sf_dir), digest=True)
