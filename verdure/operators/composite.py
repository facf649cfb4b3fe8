"""Regular composites on an anchor grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anchors(start: Column, end: Column, days: int, align: str = "start") -> Column:
    """Dates every ``days`` from the start, or back from the end, in ascending order."""
    step = F.make_dt_interval(F.lit(days))
    if align == "start":
        return F.sequence(start, end, step)
    if align != "end":
        raise ValueError(align)
    return F.sequence(F.date_sub(end, (F.floor(F.datediff(end, start) / days) * days).cast("int")), end, step)


def bin_of(when: Column, first: str, days: float) -> Column:
    """Index of the anchor within half a step: half-open bins around the anchors, by arithmetic."""
    size = int(days * 86_400_000_000)
    return F.floor((F.unix_micros(when.cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp")) + size // 2) / size).cast("int")


def composite(obs: DataFrame, first: str, days: float, n: int, method: str = "max") -> DataFrame:
    """(pixel_id, k, v) of the bins 0..n-1 that hold a value, from (pixel_id, ts, ndvi)."""
    rows = obs.where(F.col("ndvi").isNotNull()).select("pixel_id", bin_of(F.col("ts"), first, days).alias("k"), "ndvi")
    rows = rows.where(F.col("k").between(0, n - 1))
    reduce = {"max": F.max, "median": F.median}[method]
    return rows.groupBy("pixel_id", "k").agg(reduce("ndvi").alias("v"))


def dense(obs: DataFrame, first: str, days: float, n: int) -> DataFrame:
    """(pixel_id, k, t, v) for every bin of every pixel with a value; empty bins are null.

    Maxima of all bins are taken in one aggregation by pixel: partial results
    are made before the only shuffle, and later windows by pixel reuse it.
    """
    rows = obs.where(F.col("ndvi").isNotNull()).select("pixel_id", bin_of(F.col("ts"), first, days).alias("k"), "ndvi")
    rows = rows.where(F.col("k").between(0, n - 1))
    packed = rows.groupBy("pixel_id").agg(*(F.max(F.when(F.col("k") == i, F.col("ndvi"))).alias(f"v{i}") for i in range(n)))
    t = F.unix_date(F.lit(first).cast("date")) + (F.col("k") * days).cast("int")
    return packed.select("pixel_id", F.posexplode(F.array(*(f"v{i}" for i in range(n)))).alias("k", "v")).select("pixel_id", "k", t.alias("t"), "v")


def fuse(obs: DataFrame, bands: list[str]) -> DataFrame:
    """One observation per pixel and day: the first valid one by scene."""
    day = F.to_date("ts")
    valid = F.col(bands[0]).isNotNull()
    return obs.where(valid).groupBy("pixel_id", day.alias("day")).agg(F.min(F.struct("scene_id", "ts", *bands)).alias("s")).select("pixel_id", "day", "s.*")
