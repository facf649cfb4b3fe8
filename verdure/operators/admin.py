"""Units, planting months and plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdure.functions import calendar
from verdure.functions.text import column_key, name_key


class UnknownNames(ValueError):
    """Requested names that no unit has."""


def match_columns(columns: list[str], need: list[str], optional: list[str] = ()) -> dict[str, str] | None:
    """Actual names of the wanted columns, compared by ``column_key``; None if a needed one is missing."""
    have = {column_key(c): c for c in reversed(columns)}
    if any(column_key(n) not in have for n in need):
        return None
    return {n: have[column_key(n)] for n in [*need, *optional] if column_key(n) in have}


def resolve_table(layers: dict[str, DataFrame], need: list[str], optional: list[str] = ()) -> DataFrame:
    """The first layer with all needed columns, under their wanted names."""
    for df in layers.values():
        if found := match_columns(df.columns, list(need), list(optional)):
            return df.withColumnsRenamed({actual: wanted for wanted, actual in found.items()})
    seen = "; ".join(f"{name}: {', '.join(df.columns)}" for name, df in layers.items())
    raise ValueError(f"no layer has {', '.join(need)}. Found {seen}")


def select_units(units: DataFrame, level: str = "national", names: list[str] = (), exclude: list[str] = (), check: bool = True) -> DataFrame:
    """Units (name, region) of a level, without those that contain an excluded text."""
    if level not in ("national", "regional", "provincial"):
        raise ValueError(level)
    out, wanted = units, [n.strip().upper() for n in names]
    if level != "national":
        col = name_key(F.col("region" if level == "regional" else "name"))
        if check:
            found = {r[0] for r in units.select(col).where(col.isin(wanted)).distinct().collect()}  # at most the requested names
            if missing := [n for n in wanted if n not in found]:
                raise UnknownNames(f"no {level} unit named {', '.join(missing)}")
        out = out.where(col.isin(wanted))
    if exclude:
        out = out.where(~name_key(F.col("name")).rlike("|".join(re.escape(x.strip().upper()) for x in exclude)))
    return out


def list_areas(units: DataFrame, column: str = "name", region: str | None = None, contains: str | None = None) -> DataFrame:
    out = units
    if region:
        out = out.where(name_key(F.col("region")) == region.strip().upper())
    out = out.select(F.col(column).alias("name")).distinct()
    if contains:
        out = out.where(F.upper("name").contains(contains.upper()))
    return out.orderBy("name")


def planting(units: DataFrame, fallback: int, season: str) -> DataFrame:
    """Per unit name the months that at least a tenth of its usable rows give, their counts and notes."""
    rows = units.select("name", calendar.parse_month(F.col("planting_month_raw")).alias("month"), F.col("planting_month_raw").isNotNull().alias("given"))
    counts = rows.groupBy("name", "month").agg(F.count("*").alias("n"), F.sum(F.col("given").cast("int")).alias("given"))
    total = F.sum(F.when(F.col("month").isNotNull(), F.col("n"))).over(W.partitionBy("name"))
    keep = F.col("month").isNotNull() & (F.col("n") >= F.greatest(F.lit(1.0), 0.1 * total))
    found = counts.withColumn("keep", keep).groupBy("name").agg(
        F.sort_array(F.collect_list(F.when(F.col("keep"), F.col("month")))).alias("months"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("month").isNotNull(), F.struct("month", "n"))))).alias("counts"),
        F.sort_array(F.collect_list(F.when(F.col("month").isNotNull() & ~F.col("keep"), F.col("month")))).alias("rare"),
        F.sum(F.when(F.col("month").isNull(), F.col("given"))).alias("unparsed"),
        F.sort_array(F.collect_list(F.when(F.col("keep") & ~F.col("month").isin(*calendar.TYPICAL[season]), F.col("month")))).alias("atypical"),
    )
    return found.withColumn("months", F.when(F.size("months") > 0, F.col("months")).otherwise(F.array(F.lit(fallback))))


def season_windows(planted: DataFrame, year: int, season: str) -> DataFrame:
    """Earliest start, latest end and the month of the earliest window per unit."""
    rows = planted.select("name", F.explode("months").alias("month"))
    own = calendar.planting_year(F.lit(year), F.col("month"), season)
    rows = rows.select("name", "month", calendar.season_start(F.col("month"), own).alias("s"), calendar.season_end(F.col("month"), own).alias("e"))
    return rows.groupBy("name").agg(F.min("s").alias("season_start"), F.max("e").alias("season_end"), F.min(F.struct("s", "month")).alias("f")).select("name", "season_start", "season_end", F.col("f.month").alias("plant_month"))


def unit_periods(windows: DataFrame, as_of: str, which: str, period: str = "monthly") -> DataFrame:
    """Periods of each unit's season: all that have ended by the end of the day, the current one, or the last complete one."""
    day = F.lit(as_of).cast("date")
    rows = windows.select("*", F.explode(calendar.periods_between(F.col("season_start"), F.col("season_end"), period)).alias("p_start"))
    rows = rows.withColumn("p_end", calendar.period_end(F.col("p_start"), period)).withColumn("label", calendar.period_label(F.col("p_start"), period))
    rule = {"season": F.col("p_end") <= F.date_add(day, 1), "current": F.col("p_start") == calendar.period_start(day, period), "last_complete": F.col("p_start") == calendar.last_complete(day, period)}[which]
    return rows.where(rule)


def missing(expected: DataFrame, saved: DataFrame) -> DataFrame:
    """Expected (name, label) pairs that are not saved yet."""
    return expected.join(saved, ["name", "label"], "left_anti")
