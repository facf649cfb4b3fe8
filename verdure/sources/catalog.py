"""Scene catalogs, reflectance reads and land cover as DataFrames.

A catalog is a table ``scene(scene_id, collection, acq_ts, cloud_cover,
footprint struct<w,s,e,n>, assets map)``; observations are long rows
``obs(scene_id, row, col, ts, source, red, nir, qa)``.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure.config import Reflectance
from verdure.functions import masks

#: Collections of each source, and the assets that may hold a band, best first (fixed values).
COLLECTIONS = {"s2": ("sentinel-2-l2a",), "hls": ("hls2-s30", "hls2-l30")}
BANDS = {"red": ("B04", "red"), "nir": ("B8A", "nir08", "B08", "B05", "nir"), "qa": ("SCL", "Fmask", "fmask")}


class NoLandCover(LookupError):
    """No land-cover tile touches the box."""


class NoBand(KeyError):
    """A scene has none of a band's assets."""


def retried(act: Callable[[], DataFrame], attempts: int = 4, sleep: Callable[[float], None] = time.sleep, allow_empty: bool = False) -> DataFrame:
    """Runs a scan again after an error or an empty result, after 1, 2, 4 seconds."""
    for n in range(attempts):
        try:
            found = act()
            if allow_empty or n == attempts - 1 or not found.isEmpty():
                return found
        except Exception:
            if n == attempts - 1:
                raise
        sleep(2.0**n)
    raise AssertionError("unreachable")


_opened: dict[tuple[str, str], DataFrame] = {}


def open_catalog(spark: SparkSession, path: str, fresh: bool = False, attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The scene table of a folder, opened once for a session; tried again after 1, 2, 4 seconds, and anew where ``fresh``."""
    key = (spark.sparkContext.applicationId, path)
    if fresh or key not in _opened:
        _opened[key] = retried(lambda: spark.read.parquet(path), attempts, sleep, allow_empty=True)
    return _opened[key]


def search(scenes: DataFrame, source: str, bbox: tuple, start: str, end: str, max_cloud: float = Reflectance().max_cloud) -> DataFrame:
    """Scenes of a source's collections; all predicates are plain columns that reach the scan."""
    w, s, e, n = bbox
    box = F.col("footprint")
    hit = (box.w < e) & (box.e > w) & (box.s < n) & (box.n > s)
    day = F.col("acq_ts").cast("date")
    return scenes.where(F.col("collection").isin(*COLLECTIONS[source]) & day.between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("cloud_cover") < max_cloud) & hit)


def asset(name: str) -> Column:
    """The first of a band's assets that the scene has."""
    return F.coalesce(*(F.try_element_at("assets", F.lit(k)) for k in BANDS[name]))


def with_bands(scenes: DataFrame, check: bool = True) -> DataFrame:
    out = scenes.withColumns({f"{n}_href": asset(n) for n in BANDS})
    if check and (bad := out.where(" OR ".join(f"{n}_href IS NULL" for n in BANDS)).select("scene_id", F.map_keys("assets").alias("keys")).head()):
        raise NoBand(f"{bad['scene_id']} has only {', '.join(bad['keys'])}")
    return out


def find_bad(headers: DataFrame) -> DataFrame:
    """Addresses (href) of assets whose header (href, crs, transform) has no reference system or no usable transform; all headers are read by the executors."""
    t = F.col("transform")
    usable = F.col("crs").isNotNull() & (F.size(t) >= 6) & (F.get(t, F.lit(0)) != 0) & (F.get(t, F.lit(4)) != 0)
    return headers.where(~F.coalesce(usable, F.lit(False))).select("href").distinct()


def resampling(source: str, resolution_m: float, band: str) -> str:
    """How a band is read onto a grid: coarser grids average reflectance and take the most frequent class, others the nearest cell."""
    if resolution_m <= {"s2": 15, "hls": 45}[source]:
        return "nearest"
    return "mode" if band == "qa" else "average"


def on_grid(obs: DataFrame, x0: float, y0: float, res: float, tolerance: float = 0.5) -> DataFrame:
    """Observations (x, y, ...) on the cells of the first sensor's grid, by the nearest node; what lies further than the tolerance (in steps) goes."""
    col, row = (F.col("x") - x0) / res, (y0 - F.col("y")) / res
    near = lambda c: F.floor(c + 0.5)
    inside = (F.abs(col - near(col)) <= tolerance) & (F.abs(row - near(row)) <= tolerance)
    return obs.where(inside).select(near(row).cast("int").alias("row"), near(col).cast("int").alias("col"), *(c for c in obs.columns if c not in ("x", "y")))


def without_bad(scenes: DataFrame, bad_hrefs: DataFrame) -> DataFrame:
    """Scenes none of whose assets is in quarantine (a table with a column href)."""
    rows = scenes.select("*", F.explode(F.map_values("assets")).alias("href")).join(bad_hrefs, "href", "left_semi").select("scene_id").distinct()
    return scenes.join(rows, "scene_id", "left_anti")


def ndvi(obs: DataFrame, source: str, c: Reflectance | None = None) -> DataFrame:
    """(pixel row, col, ts, ndvi) with the mask of the source."""
    c = c or Reflectance()
    red, nir, qa = F.col("red"), F.col("nir"), F.col("qa")
    value = masks.ndvi_from_classes(red, nir, qa, F.col("ts"), c) if source == "s2" else masks.ndvi_from_bits(red, nir, qa, c)
    return obs.select("row", "col", "ts", value.alias("ndvi"))


def merged(parts: list[DataFrame]) -> DataFrame:
    """Observations of several sensors together."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stack(sensors: list[DataFrame], source: str, x0: float, y0: float, res: float, c: Reflectance | None = None) -> DataFrame:
    """(row, col, ts, ndvi) of all sensors' observations (x, y, ts, red, nir, qa) on the first one's grid."""
    return merged([ndvi(on_grid(s, x0, y0, res), source, c) for s in sensors])


def cropland(cover: DataFrame, bbox: tuple, c: Reflectance | None = None, attempts: int = 1, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Cells (row, col) whose newest class is cropland; an error when no land cover touches the box."""
    c = c or Reflectance()
    w, s, e, n = bbox
    own = retried(lambda: cover.where((F.col("x") >= w) & (F.col("x") <= e) & (F.col("y") >= s) & (F.col("y") <= n)), attempts, sleep)
    if own.isEmpty():
        raise NoLandCover(f"no land cover for {bbox}")
    return own.groupBy("row", "col").agg(F.max_by("cls", "time").alias("cls")).where(F.col("cls") == c.cropland_class).select("row", "col")


def masked(obs: DataFrame, crop: DataFrame, value: str | None = None) -> DataFrame:
    """Observations on cropland, or all of them with the value null elsewhere; the optimizer picks the join from the mask's size and prunes the scan at run time."""
    if value is None:
        return obs.join(crop, ["row", "col"], "left_semi")
    mask = crop.select("row", "col").distinct().withColumn("__crop", F.lit(True))
    return obs.join(mask, ["row", "col"], "left").withColumn(value, F.when(F.col("__crop"), F.col(value))).select(*obs.columns)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


#: Names that coordinate columns may have (fixed values).
AXES = {"x": ("x", "X", "lon", "longitude"), "y": ("y", "Y", "lat", "latitude")}


def normalised_axes(df: DataFrame) -> DataFrame:
    """Coordinate columns under the names x and y, whatever their source calls them."""
    return df.withColumnsRenamed({old: new for new, names in AXES.items() for old in names if old in df.columns})
