"""Areas, shares and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdure.config import STAGES


def stage_name(code: Column) -> Column:
    return F.try_element_at(F.create_map(*(x for c, n in STAGES.items() for x in (F.lit(c), F.lit(n)))), code.cast("int"))


def counts(cells: DataFrame, by: list[str], area: str = "ha") -> DataFrame:
    """Pixels and hectares per stage; no-data cells do not count.  Partial sums are made before the shuffle."""
    return cells.where("growth_stage >= 0").groupBy(*by, "growth_stage").agg(F.count("*").alias("pixels"), F.sum(area).alias("hectares"))


def shares(totals: DataFrame, by: list[str]) -> DataFrame:
    """Name, rounded hectares and share of the group's area, half to even."""
    total = F.sum("hectares").over(W.partitionBy(*by)) if by else F.sum("hectares").over(W.partitionBy(F.lit(1)))
    share = F.when(total > 0, F.bround(100 * F.col("hectares") / total, 1)).otherwise(0.0)
    return totals.select(*by, "growth_stage", stage_name(F.col("growth_stage")).alias("name"), "pixels", F.bround("hectares", 1).alias("hectares"), share.alias("share_pct"))


def rollup(cells: DataFrame, levels: list[str], area: str = "ha") -> DataFrame:
    """Totals of every level of a hierarchy in one aggregation."""
    return cells.where("growth_stage >= 0").rollup(*levels).agg(F.count("*").alias("pixels"), F.sum(area).alias("hectares"))


def quality_histogram(cycles: DataFrame) -> DataFrame:
    return cycles.groupBy("qc").agg(F.count("*").alias("pixels"))
