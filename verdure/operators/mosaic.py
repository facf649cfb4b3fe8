"""Mosaics of rasters with their own resolutions and no-data values."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.operators import focal, grid

CRS = "EPSG:4326"


@dataclass(frozen=True)
class Raster:
    """Cells (row, col, bands) of the global grid of a resolution."""

    cells: DataFrame
    res: float
    nodata: int | None
    crs: str = CRS

    @property
    def bands(self) -> list[str]:
        return [c for c in self.cells.columns if c not in ("row", "col")]

    def replaced(self, **changes) -> Raster:
        return replace(self, **changes)


def checked(inputs: list[Raster]) -> None:
    """All inputs in one reference system, with the same bands of the same types and a no-data value."""
    if not inputs:
        raise ValueError("nothing to join")
    for i, r in enumerate(inputs):
        if r.crs != CRS:
            raise ValueError(f"input {i}: expected {CRS}, got {r.crs}")
        if r.nodata is None:
            raise ValueError(f"input {i} has no no-data value")
    kinds = [[t for t in r.cells.dtypes if t[0] in r.bands] for r in inputs]
    if any(k != kinds[0] for k in kinds):
        raise ValueError(f"inputs differ in bands or types: {kinds}")


def mosaic(inputs: list[Raster], nodata: int | None = None, res: float | None = None, bbox: tuple | None = None) -> Raster:
    """The first input with a valid band wins a cell.

    The finest resolution, all inputs' cells and the first input's no-data value
    are taken unless others are given; an input's cell goes to the cell in which
    its centre lies.
    """
    checked(inputs)
    res = res or min(r.res for r in inputs)
    nodata = inputs[0].nodata if nodata is None else nodata
    bands, parts = inputs[0].bands, []
    for i, r in enumerate(inputs):
        step = r.res / res
        at = [F.floor((F.col(c) + 0.5) * step + 1e-9).cast("int").alias(c) if step != 1 else F.col(c) for c in ("row", "col")]
        kinds = dict(r.cells.dtypes)
        own = [F.when(F.col(b) == r.nodata, F.lit(nodata)).otherwise(F.col(b)).cast(kinds[b]).alias(b) if r.nodata != nodata else F.col(b) for b in bands]
        parts.append(r.cells.select(*at, F.lit(i).alias("input_order"), *own))
    rows = reduce(DataFrame.unionByName, parts)
    if bbox:
        west, north, cols, height = grid.snapped(bbox, res)
        left, top = round(west / res), round(-north / res)
        rows = rows.where(F.col("col").between(left, left + cols - 1) & F.col("row").between(top, top + height - 1))
    return Raster(focal.first_valid(rows, "input_order", bands, nodata), res, nodata)


def extent(r: Raster) -> tuple[float, float, float, float] | None:
    """The box (w, s, e, n) of a raster's cells."""
    x0, x1, y0, y1 = r.cells.agg(F.min("col"), F.max("col"), F.min("row"), F.max("row")).head()
    return None if x0 is None else tuple(round(v * r.res, 9) + 0.0 for v in (x0, -(y1 + 1), x1 + 1, -y0))
