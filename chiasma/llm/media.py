"""Media columns: texts as lossless 8-bit images in archives, written and read by a Spark data source.

Payload and media. A payload is a text's UTF-8 bytes with bytes 32 appended up to a positive multiple of ROW. It is stored
as an 8-bit greyscale PNG, ROW samples wide, one row for each ROW bytes.

Archives. A writing task streams its members into ZIP archives (stored, since PNG is compressed), a new one after
ARCHIVE_BYTES or ARCHIVE_MEMBERS. Members are named number_id_bytes.png, the id as it is or "null". When all tasks have
committed, a manifest lists the archives of those attempts alone, so what lost or repeated attempts left is never read.

Reading. The manifest gives each archive's size; the planner cuts the archives into byte ranges of RANGE_BYTES without
opening them. A partition reads its archive's directory, at most ARCHIVE_MEMBERS entries, and takes the members whose
header begins in its range. It reads neighbouring members together, up to READ_BYTES at once, and yields Arrow batches of
about that size. A member that cannot be read or fails its CRC is read again by its own offset, up to RETRIES times,
without the others; so are manifests and directories.

Files are opened through pyarrow's file systems, by the path's scheme, below the folder that all executors share.

Defined results: null and empty texts are payloads of ROW spaces with n_bytes 0; a null id stays null; repeated rows are
members of their own; equal texts give equal media; an empty table gives an empty one; a text of any length is one member
and has to fit into memory, as its row does.
"""

from __future__ import annotations

import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from chiasma.llm.common import documents, shared_dir

NAME = "op8_media"
ROW = 192
ARCHIVE_BYTES, ARCHIVE_MEMBERS, RANGE_BYTES, READ_BYTES, RETRIES = 256 << 20, 16_384, 16 << 20, 4 << 20, 3
SCHEMA = "id long, n_bytes long, archive string, offset long, media binary, payload binary, feature string"
_PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % ROW or (0 if raw else ROW))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = len(payload) // ROW
    lines = bytearray(rows * (ROW + 1))  # each line begins with its filter, 0
    view = memoryview(payload)
    for k in range(rows):
        lines[k * (ROW + 1) + 1 : (k + 1) * (ROW + 1)] = view[k * ROW : (k + 1) * ROW]
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(bytes(lines), 6)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an 8-bit greyscale PNG whose lines have no filter; ValueError for anything else."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, head = 8, [], None
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's CRC is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit greyscale")
    lines, width = zlib.decompress(b"".join(data)), head[0] + 1
    if len(lines) != width * head[1] or any(lines[::width]):
        raise ValueError("filtered or missing lines")
    return b"".join([lines[k + 1 : k + width] for k in range(0, len(lines), width)])


def feature_of(payload: bytes) -> str:
    """Mean, standard deviation and mean step between neighbours of the samples, to four digits."""
    import numpy as np

    s = np.frombuffer(payload, np.uint8).astype(np.int64)
    n, total = len(s), int(s.sum())
    var = (n * int((s * s).sum()) - total * total) / (n * n)
    return f"mean={total / n:.4f};std={var**0.5:.4f};step={int(np.abs(np.diff(s)).sum()) / max(1, n - 1):.4f}"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (id, text) into archives below path."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        fs, top = _store(self.path)
        fs.create_dir(top, recursive=True)
        done, number, out, z, name = [], 0, None, None, None

        def close():
            z.close()
            done.append((name, out.tell()))
            out.close()

        for b in iterator:
            for i, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                if z is not None and (out.tell() >= ARCHIVE_BYTES or number >= ARCHIVE_MEMBERS):
                    close()
                    z = None
                if z is None:
                    name, number = f"{uuid.uuid4().hex}.zip", 0
                    out = fs.open_output_stream(f"{top}/{name}")
                    z = zipfile.ZipFile(_Stream(out), "w", zipfile.ZIP_STORED)
                text = text.as_py()
                info = zipfile.ZipInfo(f"{number}_{'null' if i is None else i}_{len((text or '').encode())}.png")
                z.writestr(info, to_png(payload_of(text)))
                number += 1
        if z is not None:
            close()
        return Written(done)

    def commit(self, messages):
        fs, top = _store(self.path)
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(f"{top}/manifest.json") as f:
            f.write(json.dumps(sorted(a for m in messages if m for a in m.archives)).encode())

    def abort(self, messages):
        fs, top = _store(self.path)
        for name in (name for m in messages if m for name, _ in m.archives):
            fs.delete_file(f"{top}/{name}")


class _Stream(io.RawIOBase):
    """A file to write once and not to seek in, as zipfile wants it."""

    def __init__(self, out):
        self.out = out

    def writable(self):
        return True

    def write(self, data):
        self.out.write(bytes(data))
        return len(data)


@dataclass
class Range(InputPartition):
    """The members of an archive whose header begins in [start, end)."""

    archive: str | None
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self):
        fs, top = _store(self.path)

        def manifest():
            with fs.open_input_stream(f"{top}/manifest.json") as f:
                return json.loads(f.read())

        archives = retried(manifest)
        cut = [Range(name, k, min(size, k + self.range_bytes)) for name, size in archives for k in range(0, size, self.range_bytes)]
        return cut or [Range(None, 0, 0)]

    def read(self, partition):
        import pyarrow as pa

        if partition.archive is None:
            return
        fs, top = _store(self.path)
        path = f"{top}/{partition.archive}"

        def directory():
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                return sorted((m for m in z.infolist() if partition.start <= m.header_offset < partition.end), key=lambda m: m.header_offset)

        members = retried(directory)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
        k = 0
        while k < len(members):
            n = k + 1
            reach = lambda j: members[j].header_offset + _HEADER + len(members[j].filename.encode()) + members[j].compress_size
            while n < len(members) and reach(n) - members[k].header_offset <= READ_BYTES:
                n += 1
            some, rows = members[k:n], []
            try:
                with fs.open_input_file(path) as f:
                    together = f.read_at(reach(n - 1) - some[0].header_offset + _SLACK, some[0].header_offset)
            except OSError:
                together = b""
            for m in some:
                media = _media(together[m.header_offset - some[0].header_offset :], m)
                payload = _payload(media)
                if payload is None:
                    media, payload = read_again(fs, path, m)
                _, i, size = m.filename.removesuffix(".png").rsplit("_", 2)
                rows.append((None if i == "null" else int(i), int(size), partition.archive, m.header_offset, media, payload, feature_of(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names)
            k = n


_HEADER, _SLACK = 30, 64


def retried(read):
    """What read() gives, called again after an error, RETRIES times in all."""
    for attempt in range(RETRIES):
        try:
            return read()
        except (OSError, ValueError, zipfile.BadZipFile):
            if attempt + 1 == RETRIES:
                raise
            time.sleep(0.1 * 2**attempt)


def _media(data: bytes, m: zipfile.ZipInfo) -> bytes | None:
    """The member's bytes where data begins with its header and its CRC is right."""
    if len(data) < _HEADER or data[:4] != b"PK\x03\x04":
        return None
    name, extra = struct.unpack("<HH", data[26:30])
    media = bytes(data[_HEADER + name + extra : _HEADER + name + extra + m.compress_size])
    return media if len(media) == m.compress_size and zlib.crc32(media) == m.CRC else None


def _payload(media: bytes | None) -> bytes | None:
    try:
        return None if media is None else from_png(media)
    except (ValueError, zlib.error, struct.error):
        return None


def read_again(fs, path: str, m: zipfile.ZipInfo) -> tuple[bytes, bytes]:
    """One member by its offset, each time with a newly opened file."""
    for attempt in range(RETRIES):
        try:
            with fs.open_input_file(path) as f:
                media = _media(f.read_at(_HEADER + len(m.filename.encode()) + _SLACK + m.compress_size, m.header_offset), m)
            payload = _payload(media)
            if payload is not None:
                return media, payload
        except OSError:
            pass
        time.sleep(0.1 * 2**attempt)
    raise OSError(f"{m.filename} at {m.header_offset} of {path} could not be read in {RETRIES} attempts")


class ArchiveSource(DataSource):
    """format("chiasma_archive"): option path; to read also range_bytes."""

    @classmethod
    def name(cls):
        return "chiasma_archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options["path"])


def write_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    docs.sparkSession.dataSource.register(ArchiveSource)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    d.write.format("chiasma_archive").mode("append").save(path)
    return path


def read_media(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """id, n_bytes, archive, offset, media (the PNG), payload (its samples) and feature of every member."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("chiasma_archive").option("range_bytes", range_bytes).load(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read_media(spark, write_media(documents(spark, sf_dir), f"{shared_dir(spark)}/media"))
    return m.select(
        F.col("id").alias("doc_id"), "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
