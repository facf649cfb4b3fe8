"""Shared storage, file and Arrow helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure import scratch

REPO = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package even if the session began elsewhere."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder, for a session whose workers know this package."""
    prepare(spark)
    return scratch.shared_dir(spark, tag)


def planned_bytes(df: DataFrame, text_col: str) -> int:
    """The optimizer's estimate of a frame's size, from its files; where it has none, the sum of the texts' lengths."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 60 else df.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).head()[0]


def table(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write and reread: cuts lineage in storage that outlives any executor."""
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


remove = scratch.remove


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Opens ``file:``, ``hdfs:``, ``s3:`` and ``gs:`` folders and plain paths alike."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


class AtomicFile:
    """A file under a unique name that appears only when it is whole.

    A task that is lost or run twice leaves at most a ``.part`` file or a
    file that no manifest names.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.system, root = file_system(folder)
        self.system.create_dir(root, recursive=True)
        self.name = f"{stem}-{uuid.uuid4().hex}{suffix}"
        self.path = f"{root}/{self.name}"
        self.stream = self.system.open_output_stream(self.path + ".part", compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Appends; returns the offset at which the data begin."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.path + ".part", self.path)

    def abort(self) -> None:
        self.stream.close()
        self.system.delete_file(self.path + ".part")


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """An Arrow function that gives freed memory back when its task ends; workers that are used again would keep it beside the next stage's."""

    def wrapped(parts):
        try:
            yield from run(parts)
        finally:
            _trim()

    return wrapped


def text_of(name: str) -> Column:
    """A text column where null reads as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def batches(schema: pa.Schema, rows, limit: int = 4 << 20, weigh=None):
    """Groups dict rows into record batches of a bounded size."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row) if weigh else 64
        if weight >= limit or len(held) >= 20_000:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
