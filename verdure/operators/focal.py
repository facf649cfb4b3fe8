"""Neighbourhood filters over grid cells (row, col).

Every cell is sent to the cells whose window it lies in, and one aggregation
by cell does the rest; the shuffle supplies what blocks of a grid would need
from their neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _spread(cells: DataFrame, radius: int, values: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1)))
    near = cells.select(*by, "row", "col", *values, F.explode(steps).alias("d"))
    home = (F.col("d.r") == 0) & (F.col("d.c") == 0)
    return near.select(*by, (F.col("row") + F.col("d.r")).alias("row"), (F.col("col") + F.col("d.c")).alias("col"), *values, home.alias("home"))


def _reduced(cells: DataFrame, radius: int, values: list[str], reduce, by: tuple[str, ...] = ()) -> DataFrame:
    """Values whose own cell is null stay null; places without a cell are left out."""
    own = [F.max(F.when(F.col("home"), F.col(v))).alias(f"__{v}") for v in values]
    out = _spread(cells, radius, values, by).groupBy(*by, "row", "col").agg(F.max("home").alias("__there"), *(reduce(v).alias(v) for v in values), *own)
    return out.where("__there").select(*by, "row", "col", *(F.when(F.col(f"__{v}").isNotNull(), F.col(v)).alias(v) for v in values))


def median(cells: DataFrame, values: list[str], radius: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Within each group of ``by``, like all filters here."""
    return cells.select(*by, "row", "col", *values) if radius < 1 else _reduced(cells, radius, values, F.median, by)


def majority(cells: DataFrame, value: str, radius: int = 1, nodata: int = -1, by: tuple[str, ...] = ()) -> DataFrame:
    """Most frequent class, the lowest on ties; no-data cells neither count nor change."""
    valid = cells.withColumn(value, F.when(F.col(value) != nodata, F.col(value)))
    out = _reduced(valid, radius, [value], lambda v: F.mode(v, True), by)
    return out.withColumn(value, F.coalesce(value, F.lit(nodata)))


def smooth_dates(cells: DataFrame, dates: list[str], radius: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Each date by itself; the season length follows from the smoothed dates."""
    out = median(cells, dates, radius, by)
    return out.withColumn("season_length", F.col("harvest") - F.col("emergence")) if {"harvest", "emergence"} <= set(dates) else out


def first_valid(cells: DataFrame, order: str, bands: list[str], nodata: int) -> DataFrame:
    """Per cell the bands of the first input that has any valid band."""
    any_valid: Column = F.lit(False)
    for b in bands:
        any_valid = any_valid | (F.col(b) != nodata)
    return cells.where(any_valid).groupBy("row", "col").agg(F.min(F.struct(order, *bands)).alias("s")).select("row", "col", *(F.col(f"s.{b}").alias(b) for b in bands))
