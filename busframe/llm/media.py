"""Media columns: binary members kept in archives and read through a Spark data source.

An archive is a ZIP file whose members are stored as they are (media are compressed already); its central directory
gives every member's offset. `write_archives` packs members where the rows are, one or more archives per task. The
data source "members" plans byte ranges over the archives of a folder: it looks at file sizes only, so planning
doesn't grow with the number of members; each task reads the directory of its archive, takes the members whose header
begins in its range, and yields Arrow batches of bounded bytes. A member that can't be read or fails its checksum is
read again by its own offset, up to `retries` times, without touching the others; then the task fails, or, with
`on_error=null`, its payload is null.

The archives live in the folder of spark.checkpoint.dir and are opened through pyarrow's file systems (local, HDFS, S3,
GCS).
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship_package
from .common import shared_path

SIDE = 64
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20


def _files(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


# A payload as a picture: 8-bit grey samples, 64 wide, in PNG.


def padded(text: str | None) -> bytes:
    """UTF-8 of the text (null: empty), filled with bytes 0 up to a positive multiple of 64."""
    data = (text or "").encode()
    return data + b"\0" * (max(SIDE, -(-len(data) // SIDE) * SIDE) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    filtered = np.zeros((len(rows), SIDE + 1), np.uint8)  # a filter byte 0 (none) starts every row
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", SIDE, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 3)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """Samples of a picture of encode_png; a broken one raises ValueError."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, data, height = 8, [], 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("checksum of a PNG chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (width, depth, colour) != (SIDE, 8, 0):
                raise ValueError("not 8-bit grey, 64 wide")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, SIDE + 1)
    if rows[:, 0].any():
        raise ValueError("row filter")
    return rows[:, 1:].tobytes()


def write_archives(docs: DataFrame, path: str, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Packs each row's text as a picture; writes ZIP archives below `path`. Returns (archive, members, bytes), one row
    per archive, from the attempts that succeeded; a lost or repeated attempt leaves a file that no row names."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(path)
        files.create_dir(root, recursive=True)

        def close():
            archive.close()
            name = f"{uuid.uuid4().hex}.zip"
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(held.getbuffer())
            return pa.RecordBatch.from_pydict({"archive": [name], "members": pa.array([count], pa.int64()), "bytes": pa.array([held.tell()], pa.int64())})

        held = archive = None
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if archive is None:
                    held, count = io.BytesIO(), 0
                    archive = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(f"{count}/{'' if doc is None else doc}/{len((text or '').encode())}"), encode_png(padded(text)))
                count += 1
                if held.tell() >= archive_bytes:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, "archive string, members long, bytes long")


class Range(InputPartition):
    def __init__(self, archive: str, begin: int, end: int):
        self.archive, self.begin, self.end = archive, begin, end


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.retries = options["path"], int(options.get("retries", "3"))
        self.step, self.null = int(options.get("range_bytes", RANGE_BYTES)), options.get("on_error", "fail") == "null"
        self.manifest = options["manifest"]

    def partitions(self) -> list[Range]:
        files, path = _files(self.manifest)
        with files.open_input_stream(path) as f:
            sizes = json.loads(f.read())
        return [Range(name, at, at + self.step) for name, size in sizes for at in range(0, size, self.step)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no archives
            return
        files, root = _files(self.path)
        name = f"{root}/{part.archive}"
        with files.open_input_file(name) as f, zipfile.ZipFile(f) as archive:
            members = [m for m in archive.infolist() if part.begin <= m.header_offset < part.end]
        rows: list[tuple] = []
        held = 0
        source = files.open_input_file(name)
        try:
            for m in members:
                payload = None
                for attempt in range(self.retries + 1):
                    try:
                        payload = self.member(source, m)
                        break
                    except (OSError, ValueError, struct.error):
                        if attempt == self.retries and not self.null:
                            raise
                        source.close()
                        source = files.open_input_file(name)
                rows.append((*m.filename.split("/")[1:], m.header_offset, payload))
                held += len(payload or b"")
                if held >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
        finally:
            source.close()
        if rows:
            yield self.batch(rows)

    @staticmethod
    def member(source, m: zipfile.ZipInfo) -> bytes:
        """The stored bytes, by the member's own offset."""
        source.seek(m.header_offset)
        head = source.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no member at {m.header_offset}")
        name, extra = struct.unpack_from("<HH", head, 26)
        source.seek(m.header_offset + 30 + name + extra)
        data = source.read(m.compress_size)
        if len(data) != m.compress_size or zlib.crc32(data) != m.CRC:
            raise ValueError(f"checksum of the member at {m.header_offset}")
        return data

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        docs, sizes, offsets, media = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(x) if x else None for x in docs], pa.int64()),
                pa.array([int(x) for x in sizes], pa.int64()),
                pa.array(offsets, pa.int64()),
                pa.array(media, pa.binary()),
            ],
            names=["doc_id", "n_bytes", "member_offset", "media"],
        )


class MemberSource(DataSource):
    """spark.read.format("members").option("path", ...).option("manifest", ...): doc_id, n_bytes, member_offset, media."""

    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, member_offset long, media binary"

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options)


def read_archives(spark: SparkSession, path: str, archives: list[Row], **options: str) -> DataFrame:
    """The members of the archives that `archives` (rows of write_archives, one per archive) names. Names and sizes
    of archives, as a manifest, are the only thing that passes through the driver."""
    spark.dataSource.register(MemberSource)
    sizes = [[r.archive, r.bytes] for r in archives]
    files, root = _files(path)
    files.create_dir(root, recursive=True)
    manifest = f"{path}/manifest-{uuid.uuid4().hex}.json"
    with files.open_output_stream(f"{root}/{manifest.rpartition('/')[2]}") as f:
        f.write(json.dumps(sorted(sizes)).encode())
    return spark.read.format("members").options(path=path, manifest=manifest, **options).load()


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(members: DataFrame) -> DataFrame:
    """Features of the samples that were read back: size, mean, deviation, and share of each quarter of the grey range.
    A null payload (on_error=null) gives nulls."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, size, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                if media is None:
                    out.append((doc, size, *[None] * 6))
                    continue
                payload = decode_png(media)
                grey = np.frombuffer(payload, np.uint8)
                share = np.bincount(grey >> 6, minlength=4) / len(grey)
                text = f"{SIDE}x{len(grey) // SIDE};mean={grey.mean():.4f};std={grey.std():.4f};q=" + ",".join(f"{x:.4f}" for x in share)
                out.append((
                    doc, size, len(payload), hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-SIDE:]), len(media), hashlib.sha256(media).hexdigest(), text,
                ))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return members.mapInArrow(rows, FEATURES)


def media_features(docs: DataFrame) -> DataFrame:
    """Texts to pictures in archives, read back through the data source, to features."""
    spark = docs.sparkSession
    path = shared_path(spark, "media")
    return features(read_archives(spark, path, write_archives(docs, path).collect()))  # collects a row per archive
