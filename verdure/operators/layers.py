"""Window programmes: layers of named SQL expressions over (pixel_id, k) series.

A programme is a list of layers; each layer adds columns that may use those of
earlier layers.  ``apply`` builds the DataFrame plan.  Every window is
partitioned by the pixel and, where ordered, ordered by k, so all layers share
one exchange and one sort.  ``render`` gives the same programme as nested SQL
for another engine, for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIXEL = "OVER (PARTITION BY pixel_id)"
SERIES = "PARTITION BY pixel_id ORDER BY k"
BEFORE = f"OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AFTER = f"OVER ({SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
Layers = list[dict[str, str]]


def apply(df: DataFrame, layers: Layers) -> DataFrame:
    for layer in layers:
        df = df.select("*", *(F.expr(e.replace("LAST_OF(", "last_value(").replace("FIRST_OF(", "first_value(").replace(" SKIP_NULLS)", ", true)")).alias(n) for n, e in layer.items()))
    return df


def render(source: str, layers: Layers) -> str:
    for layer in layers:
        parts = ", ".join(f"{e.replace('LAST_OF(', 'last_value(').replace('FIRST_OF(', 'first_value(').replace(' SKIP_NULLS)', ' IGNORE NULLS)')} AS {n}" for n, e in layer.items())
        source = f"SELECT *, {parts} FROM ({source})"
    return source


def at(index: str, value: str, shift: int = 0) -> str:
    """The pixel's value at an index."""
    return f"max(CASE WHEN k = {index}{f' + {shift}' if shift > 0 else f' - {-shift}' if shift else ''} THEN {value} END) {PIXEL}"


def best(fn: str, where: str, value: str) -> str:
    return f"{fn}(CASE WHEN {where} THEN {value} END) {PIXEL}"
