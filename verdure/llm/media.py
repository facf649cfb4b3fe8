"""Media columns: payloads stored as lossless grey images in archives, read by a data source.

``store`` writes every payload as an 8-bit greyscale PNG of 24 samples a row
into uncompressed ZIP archives in the shared folder, rolled at a bounded size
and number of members.  ``MediaArchives`` is a Spark data source over them:
planning reads the manifest, a table in the shared folder with one row an archive
that a winning task wrote, and cuts each archive into byte ranges; neither a job
nor a task carries the list.  A task reads the archive's directory (bounded by the roll), takes
the members whose offset lies in its range, and streams them as Arrow batches.
A member that can't be read or fails its checksum is retried alone, from its
own offset.

A payload is the text in UTF-8 followed by bytes 255 (which UTF-8 never
holds) up to a positive multiple of 576.

Edge cases: a null or empty text is 576 bytes of padding.  Null ids read back
as null; repeated rows are members of their own.  An empty table gives an
empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.dataset import dataset
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from verdure.llm import common

UNIT, WIDTH, ROLL, MEMBERS, SPLIT, ATTEMPTS = 576, 24, 128 << 20, 20_000, 32 << 20, 4
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = (b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07")


def pad(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """The payload as an image of WIDTH samples a row, filter 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """The samples of an image that ``encode_png`` wrote; checks every chunk."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not an image")
    at, packed, shape = 8, [], (0, 0)
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("an image chunk does not match its checksum")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("an image line has a filter")
    return lines[:, 1:].tobytes()


def describe(samples: np.ndarray) -> str:
    """Whole-number features: sample mean and spread (in 1/1000), 8-bin histogram (in 1/10000) and a 64-bit difference hash of row means."""
    x = samples.reshape(-1, WIDTH).astype(np.int64)
    n, total = x.size, int(x.sum())
    spread = int((x * x).sum()) * n - total * total
    bins = np.bincount((x.ravel() >> 5), minlength=8) * 10_000 // n
    grid = np.add.reduceat(x, np.linspace(0, len(x), 9).astype(int)[:-1].clip(0, len(x) - 1), axis=0)
    thirds = grid.reshape(8, 8, 3).sum(axis=2)
    ring = thirds > np.roll(thirds, 1, axis=1)
    return f"mean={total * 1000 // n};var={spread * 1000 // (n * n)};hist={','.join(map(str, bins))};dhash={np.packbits(ring).tobytes().hex()}"


class _Archive:
    """Appends stored members and a directory to one ZIP file."""

    def __init__(self, folder: str):
        self.file = common.AtomicFile(folder, "media", ".zip")
        self.directory: list[bytes] = []

    def add(self, name: str, data: bytes) -> None:
        raw, crc = name.encode(), zlib.crc32(data)
        common_ = struct.pack("<HHHHHIIIH", 20, 0, 0, 0, 33, crc, len(data), len(data), len(raw))
        at = self.file.write(_LOCAL + common_ + struct.pack("<H", 0) + raw)
        self.file.write(data)
        self.directory.append(_CENTRAL + struct.pack("<H", 20) + common_ + struct.pack("<HHHHII", 0, 0, 0, 0, 0, at) + raw)

    def close(self) -> tuple[str, int, int]:
        packed, n = b"".join(self.directory), len(self.directory)
        at = self.file.write(packed)
        self.file.write(_END + struct.pack("<HHHHIIH", 0, 0, n, n, len(packed), at, 0))
        self.file.close()
        return self.file.name, self.file.size, n


def _write(folder: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box, done = None, []
        for part in parts:
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                box = box or _Archive(folder)
                box.add(f"{len(box.directory):08d}_{'none' if i is None else i}.png", encode_png(pad(text.encode("utf-8", "replace"))))
                if box.file.size >= ROLL or len(box.directory) >= MEMBERS:
                    done.append(box.close())
                    box = None
        if box:
            done.append(box.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["name", "bytes", "members"])

    return run


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, str]:
    """Writes the archives; returns their folder and that of the manifest (name, bytes, members), one row an archive of up to 128 MB."""
    at = common.shared_dir(docs.sparkSession, "media")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text"))
    common.table(docs.sparkSession, rows.mapInArrow(_write(f"{at}/archives"), "name string, bytes long, members long"), f"{at}/manifest")
    return f"{at}/archives", f"{at}/manifest"


class Range(InputPartition):
    """The members of one archive whose offset lies in [start, end)."""

    def __init__(self, name: str, size: int, start: int, end: int):
        super().__init__((name, start))
        self.name, self.size, self.start, self.end = name, size, start, end


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").option("folder", ...).option("manifest", folder).load()``."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, member string, member_offset long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["folder"], self.options["manifest"], int(self.options.get("split", SPLIT)), int(self.options.get("attempts", ATTEMPTS)))


class _Reader(DataSourceReader):
    def __init__(self, folder: str, manifest: str, split: int, attempts: int):
        self.folder, self.manifest, self.split, self.attempts = folder, manifest, split, attempts

    def partitions(self) -> list[Range]:
        system, root = common.file_system(self.manifest)
        rows = dataset(root, filesystem=system, format="parquet").to_table(columns=["name", "bytes"]).sort_by("name")
        archives = zip(*(c.to_pylist() for c in rows.columns), strict=True)
        return [Range(name, size, at, at + self.split) for name, size in archives for at in range(0, size, self.split)] or [Range("", 0, 0, 0)]

    def _tried(self, path: str, act):
        """Runs act on the opened archive; an error is retried with the file opened anew."""
        system, root = common.file_system(self.folder)
        for n in range(self.attempts):
            try:
                with system.open_input_file(f"{root}/{path}") as f:
                    return act(f)
            except (OSError, ValueError, struct.error, zlib.error):
                if n + 1 == self.attempts:
                    raise
                time.sleep(0.1 * 2**n)
        raise AssertionError("unreachable")

    def _directory(self, part: Range) -> list[tuple[int, int, int, str]]:
        def act(f):
            end = f.read_at(22, part.size - 22)
            if end[:4] != _END:
                raise ValueError(f"{part.name}: no directory")
            n, size, at = struct.unpack_from("<HII", end, 10)
            data, p, found = f.read_at(size, at), 0, []
            for _ in range(n):
                if data[p : p + 4] != _CENTRAL:
                    raise ValueError(f"{part.name}: broken directory")
                crc, stored, _, long_ = struct.unpack_from("<IIIH", data, p + 16)
                (offset,) = struct.unpack_from("<I", data, p + 42)
                if part.start <= offset < part.end:
                    found.append((offset, stored, crc, data[p + 46 : p + 46 + long_].decode()))
                p += 46 + long_
            return found

        return self._tried(part.name, act)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("member_offset", pa.int64()), ("media", pa.binary())])

        def rows():
            for offset, size, crc, name in self._directory(part):

                def act(f, offset=offset, size=size, crc=crc, name=name):
                    data = f.read_at(30 + len(name.encode()) + size, offset)
                    body = data[30 + len(name.encode()) :]
                    if data[:4] != _LOCAL or len(body) != size or zlib.crc32(body) != crc:
                        raise ValueError(f"{part.name}: member at {offset} does not match its checksum")
                    return body

                yield {"archive": part.name, "member": name, "member_offset": offset, "media": self._tried(part.name, act)}

        yield from common.batches(schema, rows(), weigh=lambda r: 100 + len(r["media"]))


def read_media(spark, folder: str, manifest: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("folder", folder).option("manifest", manifest).load()


def _columns(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        out: list[list] = [[] for _ in range(8)]
        for name, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            payload = decode_png(data)
            i = name.partition("_")[2].removesuffix(".png")
            row = (None if i == "none" else int(i), len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), describe(np.frombuffer(payload, np.uint8)))
            for held, v in zip(out, row, strict=True):
                held.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_columns(media: DataFrame) -> DataFrame:
    """Sizes, digests and features of the stored images, read back."""
    return media.select("member", "media").mapInArrow(_columns, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
