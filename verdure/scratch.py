"""Folders for tables that outlive executors, below the cluster's shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names that folder.  Where it is unset, a session
    whose executors are threads of this process (``local[...]``, as in tests)
    takes a temporary folder, and any other raises.  What is still there when
    the driver ends is deleted then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = os.environ.get("VERDURE_TEST_SHARED")
        if not root:
            root = os.environ["VERDURE_TEST_SHARED"] = tempfile.mkdtemp(prefix="verdure-shared-")
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path))
    return path


def _clear() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may have ended
            remove(spark, path)
    _made.clear()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no later plan reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
