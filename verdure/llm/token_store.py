"""Token ids in wavelet-matrix shards.

A shard file holds the ids of consecutive documents as bit planes, the most
significant first; after each plane the ids are partitioned stably by their
bit, zeros before ones.  With counts of ones every 512 bits this gives, from
one file: ``access`` (the id at a position), ``rank`` (how often an id occurs
before a position), ``select`` (where its k-th occurrence is), ``count`` and
``occurrences``.  Planes are deflated one by one and checked by CRC-32; the
rank directory is rebuilt when a file is opened.

Documents are range-partitioned by id, so shards are in ascending order of
documents; the manifest has one row a shard, from whose totals the global
starts follow.  Only its sums meet in one place, never ids or documents.

Layout, little-endian: magic ``VWM1``, planes u32, ids u64, documents u64;
then blocks, each u32 deflated size, u32 CRC-32 of the raw bytes, data: the
planes, and then the documents' ids (i64), null flags (u8) and lengths (i64).

Edge cases: a null or empty text is a document of its end id alone.  Null ids
come first; rows of one id, and those without one, stand in order of a hash of
their texts, by which they are parted too.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdure.llm import common, text_units

MAGIC, ROLL, RANGE = b"VWM1", 8 << 20, 64 << 20


class WaveletMatrix:
    """Bit planes of a sequence with rank support; positions and counts are exact."""

    def __init__(self, planes: list[np.ndarray], n: int):
        self.n, self.planes = n, planes  # bytes, least significant bit first
        self.ones = [np.concatenate(([0], np.cumsum(self._blocks(p)))) for p in planes]
        self.zeros = [n - int(o[-1]) for o in self.ones]

    @staticmethod
    def _blocks(plane: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-max(1, len(plane)) // 64) * 64, np.uint8)
        padded[: len(plane)] = plane
        return np.bitwise_count(padded.view(np.uint64)).reshape(-1, 8).sum(1, dtype=np.int64)

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> width:
            raise ValueError("an id needs more planes")
        own, planes = ids.astype(np.uint16 if width <= 16 else np.uint32), []
        for b in range(width - 1, -1, -1):
            bit = (own >> own.dtype.type(b)) & own.dtype.type(1)
            planes.append(np.packbits(bit.view(np.uint8)[:: own.dtype.itemsize], bitorder="little"))
            one = bit.astype(bool)
            own = np.concatenate((own[~one], own[one]))
        return cls(planes, len(ids))

    def _rank(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block, plane = i >> 9, self.planes[level]
        rest = plane[block * 64 : i >> 3]
        out = int(self.ones[level][block]) + int(np.bitwise_count(rest).sum())
        return out + (int(plane[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else out

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][i >> 3]) >> (i & 7) & 1
            ones = self._rank(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        a, b = 0, end
        for level in range(len(self.planes)):
            x, y = self._rank(level, a), self._rank(level, b)
            if token >> (len(self.planes) - 1 - level) & 1:
                a, b = self.zeros[level] + x, self.zeros[level] + y
            else:
                a, b = a - x, b - y
        return a, b

    def rank(self, token: int, end: int) -> int:
        """Occurrences of the id in [0, end)."""
        if token >> len(self.planes):
            return 0
        a, b = self._range(token, min(end, self.n))
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, self.n)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] * bit)
        return at

    def _find(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th bit of that value in a plane."""
        ones = self.ones[level]
        before = ones if bit else np.arange(len(ones)) * 512 - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * 64 : block * 64 + 64], bitorder="little")
        return block * 512 + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def all(self) -> np.ndarray:
        """The whole sequence: walks the planes upwards, undoing each partition."""
        width = len(self.planes)
        kind = np.uint16 if width <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(width - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros = self.zeros[level]
            whole = np.empty(self.n, kind)
            whole[~one] = out[:zeros]
            whole[one] = out[zeros:] | kind(1 << (width - 1 - level))
            out = whole
        return out


def pack_shard(ids: np.ndarray, documents: list[tuple[int | None, int]], width: int) -> bytes:
    """The bytes of one shard; documents are (id, number of tokens)."""
    matrix = WaveletMatrix.build(ids, width)
    keys = np.array([k or 0 for k, _ in documents], "<i8")
    none, sizes = np.array([k is None for k, _ in documents], np.uint8), np.array([n for _, n in documents], "<i8")
    out = [MAGIC, struct.pack("<IQQ", width, len(ids), len(documents))]
    for raw in (*(p.tobytes() for p in matrix.planes), keys.tobytes(), none.tobytes(), sizes.tobytes()):
        packed = zlib.compress(raw, 1)
        out += [struct.pack("<II", len(packed), zlib.crc32(raw)), packed]
    return b"".join(out)


def open_shard(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, the documents' ids and their lengths; raises ValueError if damaged."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard")
    width, n, docs = struct.unpack_from("<IQQ", data, 4)
    at, blocks = 24, []
    for _ in range(width + 3):
        size, crc = struct.unpack_from("<II", data, at)
        raw = zlib.decompress(data[at + 8 : at + 8 + size])
        if zlib.crc32(raw) != crc:
            raise ValueError("a block does not match its checksum")
        blocks.append(np.frombuffer(raw, np.uint8))
        at += 8 + size
    matrix = WaveletMatrix(blocks[:width], n)
    keys = [None if x else int(k) for k, x in zip(blocks[width].view("<i8"), blocks[width + 1], strict=True)]
    sizes = blocks[width + 2].view("<i8")
    if len(sizes) != docs or int(sizes.sum()) != n:
        raise ValueError("the shard's documents do not cover its ids")
    return matrix, keys, sizes


def _write(folder: str, tokenizer: str, keeps_space: bool, end_id: int, width: int, roll: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, number = text_units.encoder(tokenizer, keeps_space), TaskContext.get().partitionId()
        held: list[bytes] = []
        docs: list[tuple[int | None, int]] = []
        done: list[tuple] = []

        def flush() -> None:
            if docs:
                out = common.AtomicFile(folder, f"tokens-{number:06d}-{len(done):06d}", ".vwm")
                raw = np.frombuffer(b"".join(held), "<u4")
                out.write(pack_shard(raw, docs, width))
                out.close()
                done.append((number, len(done), f"{folder}/{out.name}", len(raw), len(docs), out.size))
                held.clear()
                docs.clear()

        size = 0
        for part in parts:
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text) + struct.pack("<I", end_id)
                held.append(ids)
                docs.append((i, len(ids) // 4))
                size += len(ids) // 4
                if size >= roll:
                    flush()
                    size = 0
        flush()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names=["part", "nth", "path", "ids", "documents", "bytes"])

    return run


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, keeps_space: bool = True, width: int = 16, roll: int = ROLL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards of about ``roll`` ids in ascending order of documents.

    Returns the manifest: part, nth, path, ids, documents, bytes and ``start``,
    the number of ids in all shards before.
    """
    spark = docs.sparkSession
    at = common.shared_dir(spark, "tokens")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text"))
    # ranges follow the input's size; the hash parts the rows without an id, and repeated ids
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), common.planned_bytes(plain, "text") // RANGE)
    dealt = plain.withColumn("h", F.xxhash64("text")).repartitionByRange(ranges, "id", "h").sortWithinPartitions("id", "h", "text").drop("h")
    made = dealt.mapInArrow(_write(f"{at}/shards", tokenizer, keeps_space, end_id, width, roll), "part int, nth int, path string, ids long, documents long, bytes long")
    manifest = common.table(spark, made, f"{at}/manifest")
    # sums by part first: the ordered window then sees one row a part, and one part's shards
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("own", own).join(parts.select("part", before.alias("before")), "part").select("part", "nth", "path", "ids", "documents", "bytes", (F.col("before") + F.col("own")).alias("start"))


def _read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for path, start in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            system, name = common.file_system(path)
            with system.open_input_stream(name, compression=None) as stream:
                matrix, keys, sizes = open_shard(stream.read())
            ids = matrix.all()
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(ids[b - n : b].astype("<u4").tobytes()) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, start, n_tokens and ids_crc32 of every document, from the files."""
    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n, F.xxhash64("path")).mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
