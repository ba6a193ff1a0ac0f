"""Media columns: texts stored as PNG images in zip archives, read back by a data source of byte ranges."""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceArrowWriter, InputPartition, WriterCommitMessage

from .common import documents, fresh_dir

ROW = 192  # bytes of an image row: 64 pixels of three 8-bit samples
MEMBERS = "doc_id long, n_bytes long, media binary"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(raw: bytes) -> bytes:
    return raw + b" " * ((-len(raw)) % ROW if raw else ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 1) -> bytes:
    rows = len(payload) // ROW
    lines = np.zeros((rows, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, rows, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image of 8-bit samples, not interlaced, with any row filters; each chunk's CRC is tested."""
    if media[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, data, head = 8, [], None
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    width, rows, depth, colour, _, _, interlaced = head or (0,) * 7
    per_pixel = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or not per_pixel:
        raise ValueError("not an image of 8-bit samples, row by row")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, width * per_pixel + 1)
    return (lines[:, 1:] if not lines[:, 0].any() else _unfiltered(lines, per_pixel)).tobytes()


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters (1: from the left, 2: from above, 3: from the mean of both, 4: from the nearest of left, above, corner to left + above - corner)."""
    out = np.zeros((len(lines) + 1, lines.shape[1] - 1 + step), np.int64)  # zeros above and left of the image
    for y, (kind, *_) in enumerate(lines, 1):
        row, above = out[y], out[y - 1]
        row[step:] = lines[y - 1, 1:]
        if kind == 1:
            for c in range(step):
                row[c::step] = np.cumsum(row[c::step]) & 255
        elif kind == 2:
            row[step:] = (row[step:] + above[step:]) & 255
        elif kind in (3, 4):
            for x in range(step, len(row)):
                left, up, corner = int(row[x - step]), int(above[x]), int(above[x - step])
                near = (left + up) // 2 if kind == 3 else min((left, up, corner), key=lambda v: abs(left + up - corner - v))  # noqa: B023
                row[x] = (row[x] + near) & 255
        elif kind:
            raise ValueError("no such row filter")
    return out[1:, step:].astype(np.uint8)


def feature_of(payload: bytes) -> str:
    """Rows, mean of each of three channels, deviation of all samples, and an 8 x 8 average hash."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
    cells = [part.astype(np.int64).sum((0, 2)).reshape(8, 8).sum(1) / (len(part) * 24) if len(part) else np.zeros(8) for part in np.array_split(x, 8)]
    grid = np.concatenate(cells)
    bits = np.packbits(grid > grid.mean()).tobytes().hex()
    sums = x.astype(np.int64).sum((0, 1)) / (len(x) * 64)
    return f"rows={len(x)};mean={sums[0]:.4f},{sums[1]:.4f},{sums[2]:.4f};deviation={x.std():.4f};hash={bits}"


# Archives: zip files, members not compressed again, named doc_id-n_bytes.png ---------------------


def _open(path: str):
    """(file system, path in it) of any store that Arrow knows; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]


def _manifests(store, root: str) -> list[str]:
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".list"))


def _archives(store, manifest: str) -> list[tuple[str, int]]:
    """(name, bytes) of the archives of one commit."""
    with store.open_input_stream(manifest) as f:
        return [(name, int(size)) for name, size in (x.split("\t") for x in f.read().decode().splitlines())]


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes archives under a name of its own; commit() adds a manifest of the successful tasks' archives, with
    their sizes, and readers take what all manifests name. An overwriting job removes the earlier ones after its own commit."""

    def __init__(self, path: str, most: int, overwrite: bool):
        self.path, self.most, self.overwrite, self.job = path, most, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        store, root = _open(self.path)
        store.create_dir(root)
        attempt = TaskContext.get().taskAttemptId()
        files, out, archive, size = [], None, None, 0

        def close():
            nonlocal out, archive
            if archive is not None:
                archive.close()
                files.append((name, out.tell()))
                out.close()
                archive = out = None

        for batch in iterator:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):  # one text at a time
                if archive is None:
                    name = f"part-{self.job}-{attempt}-{len(files)}.zip"
                    out, size = store.open_output_stream(f"{root}/{name}"), 0
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                raw, doc = (text.as_py() or "").encode(), doc.as_py()
                media = to_png(payload_of(raw))
                archive.writestr(zipfile.ZipInfo(f"{'' if doc is None else doc}_{len(raw)}.png"), media)
                size += len(media)
                if size >= self.most:
                    close()
        close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        store, root = _open(self.path)
        store.create_dir(f"{root}/_commits")
        before = _manifests(store, root) if self.overwrite else []
        with store.open_output_stream(f"{root}/_commits/{self.job}.tmp") as f:
            f.write("".join(f"{name}\t{size}\n" for m in messages if m for name, size in m.files).encode())
        store.move(f"{root}/_commits/{self.job}.tmp", f"{root}/_commits/{self.job}.list")
        for manifest in before:
            gone = _archives(store, manifest)
            store.delete_file(manifest)
            for name, _ in gone:
                store.delete_file(f"{root}/{name}")

    def abort(self, messages: list) -> None:
        store, root = _open(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                store.delete_file(f"{root}/{name}")


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    """Plans ranges of bytes; a range's members are those whose header starts in it."""

    def __init__(self, path: str, step: int, retries: int):
        self.path, self.step, self.retries = path, step, retries

    def partitions(self) -> list[ByteRange]:
        store, root = _open(self.path)
        manifests = _manifests(store, root)
        if not manifests:
            raise FileNotFoundError(f"{self.path} holds no archives")
        sizes = [(f"{root}/{name}", size) for m in manifests for name, size in _archives(store, m)]
        return [ByteRange(p, a, min(a + self.step, size)) for p, size in sizes for a in range(0, size, self.step)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = _open(self.path)
        with zipfile.ZipFile(store.open_input_file(partition.path)) as z:
            members = [(m.filename, m.header_offset, m.file_size, m.CRC) for m in z.infolist() if partition.start <= m.header_offset < partition.end]
        rows, held, source = [[], [], []], 0, store.open_input_file(partition.path)
        for name, offset, size, crc in members:
            for attempt in range(self.retries + 1):
                try:  # each member by its own offset: what went well before isn't read again
                    source.seek(offset)
                    header = source.read(30)
                    if header[:4] != b"PK\x03\x04":
                        raise ValueError("no member starts here")
                    source.seek(offset + 30 + sum(struct.unpack("<HH", header[26:30])))
                    media = source.read(size)
                    if zlib.crc32(media) != crc:
                        raise ValueError("a member is damaged")
                    break
                except (OSError, ValueError) as e:
                    if attempt == self.retries:
                        raise OSError(f"{partition.path}: {name} at {offset}: {e}") from e
                    time.sleep(0.1 * 2**attempt)
                    source = store.open_input_file(partition.path)
            doc, n = name.removesuffix(".png").split("_")
            for column, value in zip(rows, (int(doc) if doc else None, int(n), media), strict=True):
                column.append(value)
            held += size
            if held >= 8 << 20:
                yield self._batch(rows)
                rows, held = [[], [], []], 0
        if rows[0]:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], ["doc_id", "n_bytes", "media"])


class MediaArchive(DataSource):
    """format("media_archive"): options path, step (bytes of a range), retries, most (bytes of an archive)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("step", 16 << 20)), int(self.options.get("retries", 3)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("most", 64 << 20)), overwrite)


def write_media(docs: DataFrame, path: str, mode: str = "append") -> None:
    """mode: append or overwrite."""
    docs.sparkSession.dataSource.register(MediaArchive)
    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).write.format("media_archive").mode(mode).save(path)


def read_media(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(path=path, **options).load()


def media_features(media: DataFrame) -> DataFrame:
    """Figures of each stored image: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            out = [[] for _ in names[2:]]
            for stored in batch.column(2).to_pylist():
                p = from_png(stored)
                row = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(p))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an image in an archive of the shared folder, read back.

    A null text is empty (a payload of 192 spaces); ids may be null or repeat;
    only doc_id and text are read; no rows give no rows.
    """
    path = fresh_dir(spark, "media")
    write_media(documents(spark, sf_dir), path)
    return media_features(read_media(spark, path))
