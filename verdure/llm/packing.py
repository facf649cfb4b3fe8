"""Best-fit packing of token pieces by vector capacities.

A sequence (bin) has three capacities: tokens, documents and attention cost
(the sum of squared piece lengths).  Pieces are placed in descending length
into an open bin that fits under every constraint, the one whose residual
vector has the least weighted norm afterwards, or whose weighted dot product
with the piece is largest.  All three count alike by default.  A bin is opened
only where none fits.

Pieces of one length are alike, so the plan is made from the histogram of
lengths alone: at most ``capacity`` counts come to the driver, however large
the input.  Bins in the same state are handled together with their number, so
the plan is a bounded list of patterns too.  The executors then look up the
sequence and offset of each piece by its length and its rank among pieces of
that length; ranks come from a count for each (writer part, length).  Placing
pieces of one length together is the choice piece by piece: under the norm rule
the bin just filled leaves the least residual again as long as it fits, under
the dot rule bins in one state come one after the other, and a new bin is the
only one that fits until it is full.

Only documents longer than the capacity are cut, into pieces of the capacity
and a shorter last one.

Edge cases: a null or empty text is a document of its end id alone.  Null and
repeated ids are packed row by row.  An empty table gives an empty result.
Other columns are ignored.
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

CAPACITY = 4096


class Plan:
    """Where the r-th piece of a length goes: tables of bounded size."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm"):
        if rule not in ("norm", "dot"):
            raise ValueError(rule)
        self.limit = np.array([capacity, documents or capacity, attention or capacity * capacity], np.int64)
        if max(counts, default=0) > capacity or max(counts, default=0) ** 2 > self.limit[2]:
            raise ValueError("a piece is larger than a sequence")
        self.weights, self.rule = np.array(weights, float), rule
        # a group of bins in one state: residuals, number of bins, its pieces as (length, how many) in order
        left = np.empty((0, 3), np.int64)
        bins = np.empty(0, np.int64)
        filled: list[tuple[tuple[int, int], ...]] = []
        for size in sorted((s for s, n in counts.items() if n), reverse=True):
            n, need = counts[size], np.array([size, 1, size * size], np.int64)
            while n:
                ok = np.flatnonzero((left >= need).all(1) & (bins > 0))
                if len(ok):
                    g = int(ok[self._choose(left[ok], need)])
                    rest, number, own = left[g], int(bins[g]), filled[g]
                else:
                    rest, number, own, g = self.limit, 1 << 62, (), -1
                each = int((rest // need).min()) if rule == "norm" or g < 0 else 1
                full, part = divmod(n, each)
                full = min(full, number)
                new = [(full, each)] if full else [(1, part)]
                used = sum(b * k for b, k in new)
                for b, k in new:
                    after = own + ((size, k),) if not own or own[-1][0] != size else own[:-1] + ((size, own[-1][1] + k),)
                    state = rest - k * need
                    same = next((i for i in np.flatnonzero((left == state).all(1)) if filled[i] == after), None)
                    if same is None:
                        left, bins, filled = np.vstack([left, state]), np.append(bins, b), [*filled, after]
                    else:
                        bins[same] += b
                    if g >= 0:
                        bins[g] -= b
                n -= used
            alive = np.flatnonzero(bins)
            left, bins, filled = left[alive], bins[alive], [filled[i] for i in alive]
        self.sequences = int(bins.sum())
        self._tables(bins.tolist(), filled)

    def _choose(self, left: np.ndarray, need: np.ndarray) -> int:
        share = left / self.limit
        if self.rule == "dot":
            return int((share * (need / self.limit) * self.weights).sum(1).argmax())
        after = share - need / self.limit
        return int((self.weights * after * after).sum(1).argmin())

    def _tables(self, bins: list[int], filled: list[tuple[tuple[int, int], ...]]) -> None:
        """For each length, segments of ranks: first rank, first sequence, pieces a sequence, first offset."""
        rank: dict[int, int] = {}
        rows, first = [], 0
        for number, own in zip(bins, filled, strict=True):
            at = 0
            for size, k in own:
                begin = rank.get(size, 0)
                rows.append((size, begin, first, k, at))
                rank[size] = begin + number * k
                at += size * k
            first += number
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.sizes, self.begin, self.first, self.each, self.offset = table.T.copy()
        self.key = self.sizes * (1 << 48) + self.begin

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank."""
        i = np.searchsorted(self.key, size * (1 << 48) + rank, "right") - 1
        nth, k = np.divmod(rank - self.begin[i], self.each[i])
        return self.first[i] + nth, self.offset[i] + k * size


def cut(docs: DataFrame, tokenizer: str, end_id: int, keeps_space: bool, capacity: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """Pieces with the number of their writer part and their rank among its pieces of that length."""
    kinds = [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
    schema = pa.schema(kinds + ([("ids", pa.list_(pa.int32()))] if keep_ids else []))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = text_units.encoder(tokenizer, keeps_space)
        number, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

        def rows():
            for part in parts:
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                encoded = (x for at in range(0, len(texts), 256) for x in encoder.encode_all(texts[at : at + 256]))
                for i, ids in zip(keys, encoded, strict=True):
                    ids += struct.pack("<I", end_id)
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        size = len(own) // 4
                        row = {"id": i, "piece": n, "start": at // 4, "length": size, "ids_crc32": zlib.crc32(own), "part": number, "nth": int(seen[size])}
                        seen[size] += 1
                        yield row | {"ids": np.frombuffer(own, "<i4")} if keep_ids else row

        yield from common.batches(schema, rows(), weigh=lambda r: 64 + (4 * r["length"] if keep_ids else 0))

    plain = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text"))
    return plain.mapInArrow(common.lean(run), "id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids array<int>" if keep_ids else ""))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, keeps_space: bool = False, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, **limits) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id, offset, and with ``keep_ids`` the ids; ``limits`` go to ``Plan``."""
    spark = docs.sparkSession
    at = common.shared_dir(spark, "packing")
    pieces = common.table(spark, cut(docs, tokenizer, end_id, keeps_space, capacity, id_col, text_col, keep_ids), f"{at}/pieces")
    tally = common.table(spark, pieces.groupBy("part", "length").agg(F.count("*").alias("n")), f"{at}/tally")
    plan = Plan({r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity, **limits)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranks = tally.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            size, rank = part.column("length").to_numpy(), part.column("rank").to_numpy()
            sequence, offset = plan.place(size, rank)
            i = part.schema.get_field_index("rank")
            part = part.set_column(i, "sequence_id", pa.array(sequence, pa.int64()))
            yield part.append_column("offset", pa.array(offset, pa.int64()))

    ranked = pieces.join(ranks, ["part", "length"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), (F.col("before") + F.col("nth")).alias("rank"))
    kinds = "id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long"
    return ranked.mapInArrow(common.lean(run), kinds).withColumnRenamed("id", id_col)
