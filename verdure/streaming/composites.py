"""Incremental composites: the batch bins as windows of a stream with a watermark.

Windows start half a step before their anchor, as in the batch form, so both
give the same rows.  In append mode a bin is final once the watermark, one
step behind the newest observation, has passed its end.
"""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def composites(obs: DataFrame, first: str, hours: int, n: int) -> DataFrame:
    """(pixel_id, k, v) from a stream (pixel_id, ts, ndvi); bins are ``hours`` long."""
    step = f"{hours} hours"
    rows = obs.where(F.col("ndvi").isNotNull()).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", step)
    zone = ZoneInfo(rows.sparkSession.conf.get("spark.sql.session.timeZone"))  # in which ts becomes an instant too
    begin = int(dt.datetime.fromisoformat(first).replace(tzinfo=zone).timestamp())
    seconds = (begin - hours * 1800) % (hours * 3600)
    out = rows.groupBy(F.window("at", step, step, f"{seconds} seconds").alias("w"), "pixel_id").agg(F.max("ndvi").alias("v"))
    k = F.expr(f"cast((unix_seconds(w.start) + {hours * 1800} - {begin}) / {hours * 3600} as int)")
    return out.select("pixel_id", k.alias("k"), "v").where(F.col("k").between(0, n - 1))


def freshness(obs: DataFrame) -> DataFrame:
    """Newest clear observation of each pixel, as updating state."""
    rows = obs.where(F.col("ndvi").isNotNull())
    return rows.groupBy("pixel_id").agg(F.max("ts").alias("last_obs"))


def run_once(stream: DataFrame, path: str, *key: str) -> DataFrame:
    """Drives a stream over all available input into files below ``path`` and returns the newest row of each key.

    Every micro-batch adds the rows that it changed, under its own number, so a
    batch that runs again replaces its files; nothing passes through the driver.
    """

    def save(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/n={batch}")

    query = stream.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("recursiveFileLookup", True).parquet(f"{path}/rows")
    rest = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct("batch", *rest)).alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*stream.columns)


def append_once(stream: DataFrame, path: str) -> DataFrame:
    """The same in append mode: only rows that the watermark has made final, each written once by the file sink."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def push(stream: DataFrame, sink, checkpoint: str):
    """Calls sink(batch, id) for every finished micro-batch."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
