"""WARC/1.1 archives: one gzip member per record, written and read sequentially.

``write_archives`` turns rows into response and revisit records.  Of records
with equal payloads of at least ``least`` bytes the one with the largest id is
the response and the others revisit it.  ``read_archives`` inflates the
members incrementally, frames each record by its Content-Length and verifies
block and payload digests.

Files appear under unique names when they are whole; the manifest, a table in
the shared folder, names the files of the tasks that won, so a lost or
repeated task leaves nothing that is read.

Edge cases: a null payload is empty; a null id is written without one, reads
back as null and counts as the smallest; a null or unsafe URL is left out or
percent-encoded.  Of repeated rows with the winning id all are responses.  An
empty table gives no archives and an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure.llm import common

LEAST, ROLL, CHUNK = 1000, 256 << 20, 1 << 16
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "record_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


class WarcError(ValueError):
    """A record that is cut off, misframed or does not match its digest."""


def _digest(sha1) -> str:
    return "sha1:" + base64.b32encode(sha1.digest()).decode()


def record(record_id: int | None, uri: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One whole gzip member; a revisit of ``refers_to`` carries no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:x-record:{'none' if record_id is None else record_id}>")
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: {_digest(hashlib.sha1(payload))}", f"WARC-Block-Digest: {_digest(hashlib.sha1(block))}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-record:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


class _Member:
    """The inflated bytes of the gzip member that begins at the reader's position."""

    def __init__(self, reader: Reader):
        self.reader, self.box, self.held = reader, zlib.decompressobj(31), b""

    def more(self) -> bool:
        if self.box.eof:
            return False
        source, data = self.reader, self.box.unconsumed_tail
        if not data:
            data, source.rest = source.rest or source.stream.read(CHUNK), b""
            source.taken += len(data)
        if not data:
            raise WarcError(f"member at {source.begin} ends early")
        try:
            self.held += self.box.decompress(data, CHUNK)
        except zlib.error as e:
            raise WarcError(f"member at {source.begin}: {e}") from e
        if self.box.eof:
            source.rest = self.box.unused_data
            source.taken -= len(source.rest)
        return True

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (i := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark))
            if not self.more():
                raise WarcError(f"header at {self.reader.begin} ends early")
        out, self.held = self.held[:i], self.held[i + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise WarcError(f"block at {self.reader.begin} ends early")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            if part:
                yield part


class Reader:
    """Iterates over the records of one archive from its first byte to its last."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.rest, self.taken, self.begin = stream, b"", 0, 0

    def __iter__(self) -> Iterator[dict]:
        while True:
            self.begin = self.taken
            if not self.rest:
                self.rest = self.stream.read(CHUNK)
                if not self.rest:
                    return
            yield self._record(_Member(self))

    def _record(self, member: _Member) -> dict:
        head = member.until(b"\r\n\r\n").decode("utf-8").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise WarcError(f"no record at {self.begin}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        whole, inner, parts, http = hashlib.sha1(), hashlib.sha1(), [], b""
        open_ = True
        for part in member.take(int(fields["content-length"])):
            whole.update(part)
            if open_:
                http += part
                if (i := http.find(b"\r\n\r\n")) < 0:
                    continue
                http, part, open_ = http[:i], http[i + 4 :], False
            inner.update(part)
            parts.append(part)
        if member.until(b"\r\n\r\n") or member.held or member.more() and member.held:
            raise WarcError(f"record at {self.begin} is longer than its Content-Length")
        while not member.box.eof:  # the trailer with gzip's own checksum
            member.more()
        kind, payload = fields["warc-type"], b"".join(parts)
        if fields["warc-block-digest"] != _digest(whole) or kind == "response" and fields["warc-payload-digest"] != _digest(inner):
            raise WarcError(f"record at {self.begin} does not match its digest")
        named = {k.lower(): v for k, v in re.findall(rb"(?m)^([^:\r\n]+):[ \t]*([^\r\n]*)", http)}
        number = lambda v: int(m[1]) if v and (m := re.search(r"x-record:(-?\d+)>", v)) else None
        sha1 = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
        size = int(named[b"content-length"])
        if kind == "response" and size != len(payload):
            raise WarcError(f"record at {self.begin}: its payload has another length")
        return {"record_id": number(fields["warc-record-id"]), "uri": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": size, "payload_digest": sha1, "refers_to": number(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None}


def _write(folder: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        done: list[tuple[str, int, int]] = []
        for part in parts:
            for i, uri, payload, refers in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                out = out or common.AtomicFile(folder, "pages", ".warc.gz")
                out.write(record(i, uri, payload or b"", refers))
                n += 1
                if out.size >= ROLL:
                    out.close()
                    done.append((f"{folder}/{out.name}", out.size, n))
                    out, n = None, 0
        if out:
            out.close()
            done.append((f"{folder}/{out.name}", out.size, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    return run


def write_archives(rows: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Writes the archives into the shared folder; returns their manifest (path, bytes, records)."""
    spark = rows.sparkSession
    at = common.shared_dir(spark, "warc")
    payload = F.encode(common.text_of(payload_col), "utf-8") if dict(rows.dtypes)[payload_col] != "binary" else F.coalesce(payload_col, F.lit(b""))
    pages = rows.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    big = F.length("payload") >= least
    digests = pages.where(big).select("id", F.sha1("payload").alias("digest"), F.length("payload").alias("size"))
    again = digests.groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("id").alias("last")).where("n > 1 and last is not null").select("digest", "size", "last")
    again = common.table(spark, again, f"{at}/repeated")
    # only large payloads can repeat; the others get keys of their own and spread
    own = F.when(big, F.sha1("payload")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "uri").cast("string")))
    keyed = pages.withColumns({"digest": own, "size": F.length("payload")})
    other = F.when(F.col("id").isNull() | (F.col("id") < F.col("last")), F.col("last"))
    told = keyed.join(again, ["digest", "size"], "left").select("id", "uri", "payload", other.alias("refers_to"))
    return common.table(spark, told.mapInArrow(_write(f"{at}/archives"), "path string, bytes long, records long"), f"{at}/manifest")


def _read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def rows():
        for part in parts:
            for path in part.column(0).to_pylist():
                system, name = common.file_system(path)
                with system.open_input_stream(name, compression=None, buffer_size=1 << 20) as stream:
                    yield from Reader(stream)

    yield from common.batches(schema, rows(), weigh=lambda r: 200 + len(r["payload"] or b""))


def read_archives(manifest: DataFrame) -> DataFrame:
    """All records of the archives that the manifest names, an archive a task."""
    n = max(1, manifest.count())
    return manifest.select("path").repartition(n, F.xxhash64("path")).mapInArrow(_read, _RECORD)


def archive_round_trip(spark: SparkSession, rows: DataFrame, **names) -> DataFrame:
    return read_archives(write_archives(rows, **names))
