"""Growth stages on a date or over a period, from the cycle dates (day numbers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.config import NO_STAGE, NO_VALUE, STAGE_STARTS


def stage_at(day: Column) -> Column:
    """-1 without quality, 0 without a cycle, else 1 or the class whose date has come last in their order."""
    stage = F.lit(1)
    for code, band in STAGE_STARTS:
        stage = F.when(F.col(band) <= day, code).otherwise(stage)
    return F.when(F.col("qc").isNull(), NO_STAGE).when(F.col("qc") >= 10, 0).otherwise(stage).cast("smallint")


def stage_over(start: Column, end: Column, method: str = "dominant") -> Column:
    """The class with the most days in [start, end); the later class on ties.  Or the class on the middle day."""
    if method != "dominant":
        return stage_at(start + (end - start) / 2)
    far = F.lit(float("inf"))
    starts = [F.lit(float("-inf")), *(F.coalesce(F.col(b).cast("double"), far) for _, b in STAGE_STARTS)]
    codes = [1, *(c for c, _ in STAGE_STARTS)]
    spans = []
    for i, code in enumerate(codes):
        stop = F.least(*starts[i + 1 :], far) if i + 1 < len(codes) else far
        days = F.greatest(F.least(stop, end.cast("double")) - F.greatest(starts[i], start.cast("double")), F.lit(0.0))
        spans.append(F.struct(days.alias("days"), F.lit(code).alias("code")))
    pick = F.array_max(F.array(*spans))["code"]
    return F.when(F.col("qc").isNull(), NO_STAGE).when(F.col("qc") >= 10, 0).otherwise(pick).cast("smallint")


def stage_in_month(month: str, method: str = "dominant") -> Column:
    """``midmonth`` is the class on the 15th."""
    first = F.unix_date(F.lit(f"{month}-01").cast("date"))
    if method == "midmonth":
        return stage_at(first + 14)
    return stage_over(first, F.unix_date(F.add_months(F.lit(f"{month}-01").cast("date"), 1)), method)


def stage_maps(cycles: DataFrame, periods: DataFrame, method: str = "dominant") -> DataFrame:
    """(pixel_id, label, growth_stage) for all periods (label, p_start, p_end) in one pass; the calendar is a few rows."""
    both = cycles.crossJoin(F.broadcast(periods))
    return both.select("pixel_id", "label", stage_over(F.unix_date("p_start"), F.unix_date("p_end"), method).alias("growth_stage"))


def recent(cycles: DataFrame, as_of: str) -> DataFrame:
    """Stage, age of the newest observation and quality on a date."""
    day = F.unix_date(F.lit(as_of).cast("date"))
    return cycles.select("pixel_id", stage_at(day).alias("growth_stage"), (day - F.col("last_obs")).alias("data_age_days"), "qc")


def encoded(cycles: DataFrame, year: int) -> DataFrame:
    """Small whole numbers for storage: dates as day of year, indices times 10000, null as the no-value code."""
    first = F.unix_date(F.lit(f"{year}-01-01").cast("date"))
    pack = lambda c: F.coalesce(F.least(F.greatest(F.bround(c), F.lit(-32767.0)), F.lit(32767.0)), F.lit(float(NO_VALUE))).cast("smallint")
    out = []
    for name in cycles.columns:
        c = F.col(name).cast("double")
        if name in ("plant", "emergence", "tillering", "panicle_init", "heading", "peak", "maturity", "harvest", "last_obs"):
            c = c - first + 1
        elif name.startswith("ndvi"):
            c = c * 10_000
        out.append(F.col(name) if name == "pixel_id" else pack(c).alias(name))
    return cycles.select(*out)


def decoded(rows: DataFrame, year: int) -> DataFrame:
    """Day numbers again, so any date can be classified from stored results."""
    first = F.unix_date(F.lit(f"{year}-01-01").cast("date"))
    value = lambda n: F.when(F.col(n) != NO_VALUE, F.col(n).cast("double"))
    dates = ("plant", "emergence", "tillering", "panicle_init", "heading", "peak", "maturity", "harvest", "last_obs")
    return rows.select(*(F.col(n) if n == "pixel_id" else (value(n) + first - 1 if n in dates else value(n) / 10_000 if n.startswith("ndvi") else value(n)).alias(n) for n in rows.columns))
