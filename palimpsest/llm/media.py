"""Media columns: payloads in archives in a shared folder, read back through a data source of Spark.

Payloads are stored as images of 8-bit grey samples (PNG, lossless) in ZIP archives, one for each task that writes. The
data source "archivemedia" plans partitions by byte ranges over the archives of a folder: a partition reads the members
that begin in its range, streams them as Arrow batches, and reads a member again, by its offset alone, when a read fails.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import by_batch, new_folder, raw_texts, staged

WIDTH, RANGE_BYTES, BATCH_BYTES, ATTEMPTS = 64, 16 << 20, 4 << 20, 4
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any store that Arrow reaches, by its address; a plain path is local."""
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes, unpadded: int) -> bytes:
    """A PNG of 64 grey samples a row for a payload of a positive multiple of 64 bytes; its text chunk keeps the unpadded length."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"Length\0%d" % unpadded) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 2)) + chunk(b"IEND", b"")


def decode_image(stored: bytes) -> tuple[bytes, int]:
    """The payload and its unpadded length; raises ValueError on a damaged image."""
    if not stored.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, data, length, shape = len(SIGNATURE), [], None, None
    while at < len(stored):
        n, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            length = int(body[7:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if shape is None or length is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an image of this kind")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes(), length


def padded(raw: bytes, unit: int = WIDTH) -> bytes:
    """With bytes 0 up to a positive multiple of unit."""
    return raw + bytes(-len(raw) % unit if raw else unit)


def features(payload: bytes) -> str:
    """Mean, deviation and a histogram of 8 ranges of the samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x >> 5, minlength=8)
    n, total, squares = len(x), int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    return f"mean={total / n:.4f};sd={max(0.0, squares / n - (total / n) ** 2) ** 0.5:.4f};hist={'/'.join(map(str, counts.tolist()))}"


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """Stores each text of docs (doc_id, text) as an image in archives below folder; one row (path, members, bytes) per archive.

    A task writes an archive under a name of its own try; only archives of tries that ended are in the result, so what a
    lost executor left behind is never read.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        path = f"{base}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip"
        members = 0
        with fs.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for doc_id, raw in zip(part.column("doc_id").to_pylist(), raw_texts(part.column("text")), strict=True):
                        name = f"{members:010d}_{'' if doc_id is None else doc_id}.png"
                        archive.writestr(zipfile.ZipInfo(name), encode_image(padded(raw), len(raw)))
                        members += 1
        if members:
            size = fs.get_file_info(path).size
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([members], pa.int64()), pa.array([size], pa.int64())], names=["path", "members", "bytes"])
        else:
            fs.delete_file(path)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(store, "path string, members long, bytes long")


class ByteRange(InputPartition):
    """The members of an archive that begin between two offsets: (offset, bytes, CRC, method, name) of each, or None to read its directory."""

    def __init__(self, path: str, start: int, end: int, members: list[tuple[int, int, int, int, str]] | None = None):
        self.path, self.start, self.end, self.members = path, start, end, members


def member_bytes(file: pa.NativeFile, offset: int, size: int, crc: int, method: int) -> bytes:
    """The bytes of a member, stored or deflated, by its offset alone."""
    file.seek(offset)
    head = file.read(30)
    if len(head) != 30 or head[:4] != b"PK\x03\x04":
        raise OSError("no member at this offset")
    name, extra = struct.unpack_from("<HH", head, 26)
    file.seek(offset + 30 + name + extra)
    data = file.read(size)
    if len(data) != size:
        raise OSError("a member is cut short")
    if method == zipfile.ZIP_DEFLATED:
        try:
            data = zlib.decompress(data, -15)
        except zlib.error as e:
            raise OSError("damaged member") from e
    elif method != zipfile.ZIP_STORED:
        raise ValueError(f"members of compression method {method} are not read")
    if zlib.crc32(data) != crc:
        raise OSError("damaged member")
    return data


class ArchiveReader(DataSourceReader):
    """Reads the archives of a folder, or those of a list; each range by a task of its own."""

    def __init__(self, folder: str, archives: list[tuple[str, int]] | None, range_bytes: int, attempts: int):
        self.folder, self.archives, self.range_bytes, self.attempts = folder, archives, range_bytes, attempts

    def partitions(self) -> list[InputPartition]:
        fs, base = filesystem(self.folder)
        found = self.archives
        if found is None:
            found = sorted((x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)) if x.is_file and x.path.endswith(".zip"))
        return [r for path, size in found for r in self.ranges(fs, path, size)] or [ByteRange("", 0, 0)]

    def ranges(self, fs: pafs.FileSystem, path: str, size: int) -> list[ByteRange]:
        """The ranges of an archive that hold members; its directory is read once, here."""
        parts: dict[int, list] = {}
        for x in self.directory(fs, path):
            parts.setdefault(x.header_offset // self.range_bytes, []).append((x.header_offset, x.compress_size, x.CRC, x.compress_type, x.filename))
        return [ByteRange(path, k * self.range_bytes, min(size, (k + 1) * self.range_bytes), members) for k, members in sorted(parts.items())]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = filesystem(self.folder)
        rows: list[tuple] = []
        held = 0
        members = partition.members
        if members is None:
            members = [(x.header_offset, x.compress_size, x.CRC, x.compress_type, x.filename) for x in self.directory(fs, partition.path) if partition.start <= x.header_offset < partition.end]
        file = fs.open_input_file(partition.path)
        try:
            for offset, size, crc, method, name in members:
                for left in range(self.attempts - 1, -1, -1):
                    try:
                        data = member_bytes(file, offset, size, crc, method)
                        break
                    except OSError:
                        if not left:
                            raise
                        time.sleep(0.1 * (self.attempts - left))
                        file.close()
                        file = fs.open_input_file(partition.path)
                doc_id = name.rpartition("_")[2].removesuffix(".png")
                rows.append((int(doc_id) if doc_id else None, partition.path, name, offset, data))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
        finally:
            file.close()
        if rows:
            yield self.batch(rows)

    def directory(self, fs: pafs.FileSystem, path: str) -> list[zipfile.ZipInfo]:
        """The members of an archive; tried again where it can't be read or seems damaged."""
        for left in range(self.attempts - 1, -1, -1):
            try:
                with fs.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                    return archive.infolist()
            except (OSError, zipfile.BadZipFile):
                if not left:
                    raise
                time.sleep(0.1 * (self.attempts - left))
        return []

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "archive", "member", "offset", "media"])


class ArchiveMedia(DataSource):
    """spark.read.format("archivemedia").load(folder): a row per member of the ZIP archives of a folder."""

    @classmethod
    def name(cls) -> str:
        return "archivemedia"

    def schema(self) -> str:
        return "doc_id long, archive string, member string, offset long, media binary"

    def reader(self, schema) -> DataSourceReader:
        archives = None
        if text := self.options.get("archives"):
            archives = [(path, int(size)) for path, size in (x.rsplit("|", 1) for x in text.split("\n"))]
        return ArchiveReader(self.options["path"], archives, int(self.options.get("rangeBytes", RANGE_BYTES)), int(self.options.get("attempts", ATTEMPTS)))


def read_archives(spark: SparkSession, folder: str, archives: list[tuple[str, int]] | None = None) -> DataFrame:
    """The members of a folder's archives, or of those named (path, bytes) alone."""
    spark.dataSource.register(ArchiveMedia)
    reader = spark.read.format("archivemedia").option("path", folder)
    if archives is not None:
        reader = reader.option("archives", "\n".join(f"{p}|{n}" for p, n in archives))
    return reader.load()


def media_column(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) stored and read back: doc_id, archive, member, offset and media (the stored image) of each row.

    Null text counts as empty; a null doc_id stays null; repeated rows are members of their own. An empty table gives no
    rows. Archives lie in the shared folder, for as long as the result is read. The list of archives, one for each task,
    goes to the driver like any list of files.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "media")
    listed = staged(write_archives(docs, folder), "archives").collect()  # one row per archive
    if not listed:
        return spark.createDataFrame([], "doc_id long, archive string, member string, offset long, media binary")
    return read_archives(spark, folder, sorted((r["path"], r["bytes"]) for r in listed))


def media_digest(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: of what is read back."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def f(batch: pa.RecordBatch) -> dict:
        out: dict = {x: [] for x in schema.names} | {"doc_id": batch.column("doc_id")}
        for stored in batch.column("media").to_pylist():
            payload, length = decode_image(stored)
            row = (length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload))
            for name, x in zip(schema.names[1:], row, strict=True):
                out[name].append(x)
        return out

    return media.select("doc_id", "media").mapInArrow(by_batch(f, schema, 256), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
