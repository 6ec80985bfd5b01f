"""Media columns: payloads kept as images in archives, read by a data source of their own.

An archive is a ZIP file of stored PNG members; a payload becomes an image of 8-bit grey samples, 64 to a
row. The members' names carry what isn't in the image: a running number and the doc_id. `media_archive`
is the data source's name. Its writer makes one archive after another in each task and lists those of
the attempts that count in a manifest of that write, beside those of writes before unless it overwrites them;
its reader plans byte ranges over the archives that the manifests list. A task reads an archive's directory and takes the members whose headers begin in its range. It
streams them as Arrow batches of bounded size, and a member that can't be read is tried again on its own,
at its offset, through a new handle; its neighbours are not read again.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import filesystem, fresh_path

ROW = 64
SCHEMA = "doc_id bigint, n_bytes bigint, payload binary, media binary, feature string, error string"
_PNG = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(data: bytes, level: int = 3) -> bytes:
    """A payload as a PNG of 8-bit grey samples, 64 to a row; a text chunk keeps the unpadded length."""
    samples = np.frombuffer(padded(data), np.uint8).reshape(-1, ROW)
    rows = np.zeros((len(samples), ROW + 1), np.uint8)
    rows[:, 1:] = samples
    head = struct.pack(">IIBBBBB", ROW, len(samples), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0" + str(len(data)).encode()) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of what to_png made; raises ValueError on anything else or a damaged chunk."""
    if png[:8] != _PNG:
        raise ValueError("no PNG")
    at, chunks = 8, {}
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != png[at + 8 + n : at + 12 + n]:
            raise ValueError(f"damaged chunk {kind!r}")
        chunks[kind] = chunks.get(kind, b"") + body
        at += 12 + n
    width, height, depth, colour = struct.unpack(">IIBB", chunks[b"IHDR"][:10])
    rows = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(height, width + 1)
    if depth != 8 or colour or rows[:, 0].any():
        raise ValueError("another kind of PNG")
    return np.ascontiguousarray(rows[:, 1:]).tobytes(), int(chunks[b"tEXt"].split(b"\0")[1])


def feature(payload: bytes) -> str:
    """Of the samples: rows, mean and deviation in thousandths, entropy of the histogram in millibits, mean step between neighbours in thousandths."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256).astype(np.int64)
    n, total, squares = len(x), int((counts * np.arange(256)).sum()), int((counts * np.arange(256) ** 2).sum())
    p = counts[counts > 0] / n
    steps = int(np.abs(np.diff(x.astype(np.int16))).sum())
    deviation = int(round(max(0, squares * n - total * total) ** 0.5 * 1000 / n))
    return f"rows={n // ROW};mean={total * 1000 // n};dev={deviation};entropy={int(round(float(-(p * np.log2(p)).sum()) * 1000))};step={steps * 1000 // max(n - 1, 1)}"


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    archives: list


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, path: str, archive_bytes: int, overwrite: bool):
        self.path, self.most, self.overwrite = path, archive_bytes, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        done, out, n = [], None, 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    sink = fs.open_output_stream(f"{folder}/{name}")
                    out, n = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED), 0
                out.writestr(zipfile.ZipInfo(f"{n}.{doc_id.as_py() if doc_id.is_valid else 'null'}.png"), to_png((text.as_py() or "").encode()))
                n += 1
                if out.start_dir >= self.most:
                    done.append(self._closed(fs, folder, name, out, sink))
                    out = None
        if out is not None:
            done.append(self._closed(fs, folder, name, out, sink))
        return Written(done)

    @staticmethod
    def _closed(fs, folder: str, name: str, out: zipfile.ZipFile, sink) -> list:
        out.close()
        sink.close()
        return [name, fs.get_file_info(f"{folder}/{name}").size]

    def commit(self, messages: list) -> None:
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        before = _manifests(fs, folder) if self.overwrite else []
        name = f"manifest-{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{folder}/{name}") as f:
            f.write(json.dumps([a for m in messages if m for a in m.archives]).encode())
        for old in before:
            fs.delete_file(old)

    def abort(self, messages: list) -> None:
        """What a failed write leaves is in no manifest."""


def _manifests(fs, folder: str) -> list[str]:
    """The manifests of a folder, one for each write, in the order they were made."""
    found = [x.path for x in fs.get_file_info(FileSelector(folder)) if x.base_name.startswith("manifest-")]
    return sorted(found, key=lambda x: x.rsplit("/", 1)[-1])


class MediaReader(DataSourceReader):
    def __init__(self, path: str, options):
        self.path = path
        self.range_bytes = int(options.get("rangebytes", 16 << 20))
        self.batch_bytes = int(options.get("batchbytes", 8 << 20))
        self.tries = int(options.get("tries", 3))
        self.keep_errors = options.get("onerror", "fail") == "row"

    def partitions(self) -> list[Range]:
        fs, folder = filesystem(self.path)
        archives = []
        for manifest in _manifests(fs, folder):
            with fs.open_input_file(manifest) as f:
                archives += json.loads(f.read())
        return [Range(f"{self.path}/{name}", at, min(at + self.range_bytes, size)) for name, size in archives for at in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows, total = [], 0
        for member in self._members(partition):
            row = self._member(partition.path, *member)
            size = len(row[2] or b"") + len(row[3] or b"")
            if rows and total + size > self.batch_bytes:
                yield _batch(rows)
                rows, total = [], 0
            rows.append(row)
            total += size
        if rows:
            yield _batch(rows)

    def _members(self, partition: Range) -> list[tuple[int, str, int, int]]:
        fs, path = filesystem(partition.path)
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            return [(x.header_offset, x.filename, x.file_size, x.CRC) for x in z.infolist() if partition.begin <= x.header_offset < partition.end]

    def _member(self, path: str, offset: int, name: str, size: int, crc: int) -> tuple:
        """Reads one member at its offset, again if need be."""
        doc_id = name.split(".")[1]
        doc_id = None if doc_id == "null" else int(doc_id)
        for k in range(self.tries):
            try:
                png = self._bytes(path, offset, size, crc, again=k > 0)
                payload, n = from_png(png)
                return doc_id, n, payload, png, feature(payload), None
            except (OSError, ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                why = f"{type(e).__name__}: {e}"
                if k + 1 < self.tries:
                    time.sleep(0.1 * 2**k)
        if not self.keep_errors:
            raise OSError(f"{path}, member at {offset}: {why}")
        return doc_id, None, None, None, None, why

    def _bytes(self, path: str, offset: int, size: int, crc: int, again: bool) -> bytes:
        held = getattr(self, "_held", None)
        if held is None or held[0] != path or again:
            if held:
                held[1].close()
            fs, at = filesystem(path)
            held = self._held = (path, fs.open_input_file(at))
        f = held[1]
        f.seek(offset)
        head = struct.unpack("<4s5H3I2H", f.read(30))
        if head[0] != b"PK\x03\x04":
            raise ValueError("no member here")
        f.seek(offset + 30 + head[9] + head[10])
        png = f.read(size)
        if len(png) != size or zlib.crc32(png) != crc:
            raise ValueError("damaged member")
        return png


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string()]
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class MediaArchives(DataSource):
    """spark.read.format("media_archive").load(folder); df.select("doc_id", "text").write.format("media_archive").mode("append").save(folder).

    Reading takes the options rangeBytes, batchBytes, tries and onError ("fail", or "row": a row with an
    error in place of a payload). Writing takes archiveBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"], self.options)

    def writer(self, schema, overwrite: bool) -> MediaWriter:
        return MediaWriter(self.options["path"], int(self.options.get("archivebytes", 48 << 20)), overwrite)


def store(docs: DataFrame, folder: str | None = None) -> str:
    """Writes the texts of `docs` (doc_id, text) as archives and returns their folder.

    A null text is an empty one, and a payload has 64 bytes at least. Repeated rows are members of their
    own, null doc_ids stay null, other columns are left aside; doc_ids must be whole numbers or text that reads as
    such, or the write fails. A folder that has archives gets more. An empty table has an empty manifest.
    """
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchives)
    folder = folder or fresh_path(spark, "media")
    docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").write.format("media_archive").mode("append").save(folder)
    return folder


def load(spark: SparkSession, folder: str, **options) -> DataFrame:
    """One row for each member: doc_id, n_bytes (unpadded), payload, media, feature, error."""
    spark.dataSource.register(MediaArchives)
    reader = spark.read.format("media_archive")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(folder)


def digests(media: DataFrame) -> DataFrame:
    """What can be compared: lengths, digests and features of the members."""
    tail = F.substring("payload", -ROW, ROW)
    return media.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
