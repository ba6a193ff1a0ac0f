"""Blocks to chunks to vectors, loaded once: correction, chunking, embedding, idempotent load."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..functions.text import chunks
from ..sources.blocks import verified
from .state import new_only

DIM = 1024


def hash_vectors(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Stand-in embeddings: SHA-256 digests, each of the one before, as bytes / 255 - 0.5, of unit length."""
    sha, parts = hashlib.sha256, []
    for text in texts:
        digest = sha(text.encode()).digest()
        for _ in range(-(-dim // 32)):
            parts.append(digest)
            digest = sha(digest).digest()
    v = np.frombuffer(b"".join(parts), np.uint8).reshape(len(texts), -1)[:, :dim] / 255.0 - 0.5
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def hash_vector(text: str, dim: int = DIM) -> np.ndarray:
    return hash_vectors([text], dim)[0]


def embed(df: DataFrame, encode: Callable[[list[str]], list] | None = None, column: str = "content", dim: int = DIM, batch: int = 1024) -> DataFrame:
    """df with the column embedding. encode turns a batch of texts into vectors of one length; null texts are empty.

    The hash needs a loop over digests for each text, hence Arrow batches and not SQL; a batch's vectors are one array.
    """
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                texts = [t or "" for t in part.column(at).to_pylist()]
                found = np.asarray(encode(texts), np.float32) if encode else hash_vectors(texts, dim)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "embedding"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def chunked(blocks: DataFrame) -> DataFrame:
    """Chunks of blocks (doc_id, seq, type, text, page): tables and figures stay whole, empty text gives none."""
    whole = F.col("type").isin("table", "figure")
    parts = F.when(whole, F.array("text")).otherwise(chunks(F.coalesce("text", F.lit(""))))
    return blocks.select("doc_id", "seq", "type", "page", F.posexplode(parts).alias("part", "content"))


def load(blocks: DataFrame, held: DataFrame, tag: str = "") -> DataFrame:
    """New documents' chunks with vectors: corrected, chunked, embedded. A document is known by the
    digest of its tag and texts (held: sha256); loading it again gives nothing. NUL characters go."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    digests = blocks.groupBy("doc_id").agg(F.sha2(F.concat(F.lit(tag), text), 256).alias("sha256"))
    first = digests.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
    new = new_only(first, held.select("sha256"), ["sha256"])
    clean = verified(blocks.withColumn("text", F.replace("text", F.lit("\x00"), F.lit(""))))
    return embed(chunked(clean).join(new, "doc_id"))


def reindexed(blocks: DataFrame, held: DataFrame, encode: Callable[[list[str]], list] | None = None, dim: int = DIM) -> DataFrame:
    """The chunks of a batch of corrected documents, with vectors: what stands for them from now on in place of their held ones.

    blocks: doc_id, seq, type, text, page, confidence; held: sha256 and embedding of all chunks there are. A chunk is known by its
    content's digest, so only contents that no held chunk has are embedded, each once; the others take over their vector, and chunks that a
    document no longer has are gone. fresh tells what was embedded.
    """
    now = chunked(verified(blocks.withColumn("text", F.replace("text", F.lit("\x00"), F.lit(""))))).withColumn("sha256", F.sha2("content", 256))
    known = held.groupBy("sha256").agg(F.first("embedding").alias("embedding"))
    new = now.select("sha256", "content").dropDuplicates(["sha256"]).join(known, "sha256", "left_anti")
    vectors = known.withColumn("fresh", F.lit(False)).unionByName(embed(new, encode, dim=dim).select("sha256", "embedding", F.lit(True).alias("fresh")))
    return now.join(vectors, "sha256")


def reindex(chunks: DataFrame, blocks: DataFrame, encode: Callable[[list[str]], list] | None = None, dim: int = DIM) -> DataFrame:
    """All chunks (with sha256 and embedding) after a batch: those of its documents are replaced (reindexed), the others stay."""
    rows = reindexed(blocks, chunks, encode, dim).drop("fresh")
    return chunks.join(blocks.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(rows.select(*chunks.columns))
