"""The star-schema tables read as observations, pixels, units and scenes.

Each binding has a DataFrame and the same relation in DuckDB's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure.config import Reflectance

FIRST, DAYS, N = "2025-11-01", 10, 25
FIRST_DAY = 20393
EVENT_FIRST, EVENT_N = "2024-01-01", 30
REFLECTANCE = Reflectance(offset=10.0, offset_from="2024-01-15", clear_classes=("click", "view", "purchase", "login", "logout", "signup", "search", "cart", "scroll"))
RES = 0.01


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw observations: the number in props is the red band and the bit field, value is near infrared."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("pixel_id"), "ts", k.alias("red"), F.col("value").alias("nir"), k.alias("qa"), F.col("event_type").alias("cls"))


SCENES = "SELECT event_id, user_id AS pixel_id, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS red, value AS nir, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS qa, event_type AS cls FROM events"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pixel_id, ts, ndvi): errors are clouds; the value in thousandths stands for the index."""
    return scenes(spark, sf_dir).select("pixel_id", "ts", F.when(F.col("cls") != "error", F.col("nir") / 500).alias("ndvi"))


OBSERVATIONS = f"SELECT pixel_id, ts, CASE WHEN cls <> 'error' THEN nir / 500 END AS ndvi FROM ({SCENES})"
BINNED = f"SELECT pixel_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '{EVENT_FIRST}') + 43200000000) / 86400000000) AS INT) AS k, ndvi FROM ({OBSERVATIONS}) WHERE ndvi IS NOT NULL"
EVENT_SERIES = f"""SELECT p.pixel_id, a.k, CAST(19723 + a.k AS INT) AS t, c.v
FROM (SELECT DISTINCT pixel_id FROM ({BINNED}) WHERE k BETWEEN 0 AND {EVENT_N - 1}) p CROSS JOIN (SELECT CAST(range AS INT) AS k FROM range({EVENT_N})) a
LEFT JOIN (SELECT pixel_id, k, max(ndvi) AS v FROM ({BINNED}) WHERE k BETWEEN 0 AND {EVENT_N - 1} GROUP BY ALL) c ON c.pixel_id = p.pixel_id AND c.k = a.k"""

def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scenes of three collections, with footprints and assets whose names differ."""
    k = F.col("o_orderkey")
    w, s = k * 37 % 100 / 10.0, k * 53 % 100 / 10.0
    kind = F.when(F.col("o_orderstatus") == "F", "sentinel-2-l2a").when(F.col("o_orderstatus") == "O", "hls2-s30").otherwise("hls2-l30")
    href = lambda band: F.concat(F.lit(band), k.cast("string"))
    nir = F.when(k % 3 == 0, "B8A").when(k % 3 == 1, "B05").otherwise("nir08")
    assets = F.create_map(F.lit("B04"), href("r"), nir, href("n"), F.when(k % 7 == 0, "fmask").otherwise("SCL"), href("q"))
    box = F.struct(w.alias("w"), s.alias("s"), (w + 0.5).alias("e"), (s + 0.5).alias("n"))
    return read(spark, sf_dir, "orders").select(k.alias("scene_id"), kind.alias("collection"), F.col("o_orderdate").alias("acq_ts"), (F.col("o_custkey") % 100).cast("double").alias("cloud_cover"), box.alias("footprint"), assets.alias("assets"))


CATALOG = "SELECT o_orderkey AS scene_id, CASE o_orderstatus WHEN 'F' THEN 'sentinel-2-l2a' WHEN 'O' THEN 'hls2-s30' ELSE 'hls2-l30' END AS collection, o_orderdate AS acq_ts, o_custkey % 100 AS cloud_cover, o_orderkey * 37 % 100 / 10.0 AS w, o_orderkey * 53 % 100 / 10.0 AS s FROM orders"


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset headers: a reference system and a transform, of which some are missing or empty."""
    k = F.col("scene_id")
    rows = catalog(spark, sf_dir).select(k, F.explode(F.map_values("assets")).alias("href"))
    own = F.array(*(F.lit(v) for v in (0.01, 0.0, 120.0, 0.0, -0.01, 10.0)))
    return rows.select("href", F.when(k % 11 != 0, "EPSG:4326").alias("crs"), F.when(k % 13 == 0, F.array(F.lit(0.0))).when(k % 17 != 0, own).alias("transform"))


def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as land cover of three dates: (x, y, row, col, cls, time)."""
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(k, "s_nationkey", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("time"))
    return rows.select((k % 40 * 0.01).alias("x"), (-F.floor(k / 40) * 0.01).alias("y"), F.floor(k / 40).cast("int").alias("row"), (k % 40).cast("int").alias("col"), F.when((F.col("s_nationkey") + F.col("time")) % 3 == 0, 40).otherwise(10).alias("cls"), "time")


COVER = "SELECT s_suppkey % 40 * 0.01 AS x, -floor(s_suppkey / 40) * 0.01 AS y, CAST(floor(s_suppkey / 40) AS INT) AS row, CAST(s_suppkey % 40 AS INT) AS col, CASE WHEN (s_nationkey + time) % 3 = 0 THEN 40 ELSE 10 END AS cls, time FROM supplier CROSS JOIN (SELECT unnest([1, 2, 3]) AS time)"

_CURVE = "round(0.15 + 0.05 * ({key} % 8) + (0.15 + 0.05 * ({key} % 11)) * exp(-0.5 * pow((10.0 * k - 75.0 - {key} % 120) / 25.0, 2)), 6)"


def _curves(customers: DataFrame) -> DataFrame:
    """(pixel_id, k, v) and the other columns of rows of ``customer``."""
    rows = customers.withColumnRenamed("c_custkey", "pixel_id").select("*", F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("k"))
    curve = F.expr(_CURVE.format(key="pixel_id"))
    return rows.withColumn("v", F.when((F.col("pixel_id") * 7 + F.col("k") * 13) % 5 != 0, curve))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pixels of a grid 40 cells wide, with analytic growth curves (pixel_id, k, t, v); a fifth is missing."""
    rows = _curves(read(spark, sf_dir, "customer").select("c_custkey"))
    return rows.select("pixel_id", "k", (F.lit(FIRST_DAY) + DAYS * F.col("k")).alias("t"), "v")


PIXELS = f"SELECT c_custkey AS pixel_id, k, {FIRST_DAY} + {DAYS} * k AS t, CASE WHEN (c_custkey * 7 + k * 13) % 5 <> 0 THEN {_CURVE.format(key='c_custkey')} END AS v FROM customer CROSS JOIN (SELECT CAST(range AS INT) AS k FROM range({N}))"


def grid(df: DataFrame) -> DataFrame:
    return df.withColumns({"row": F.floor(F.col("pixel_id") / 40).cast("int"), "col": (F.col("pixel_id") % 40).cast("int")})


GRID = "CAST(floor(pixel_id / 40) AS INT) AS row, CAST(pixel_id % 40 AS INT) AS col"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as units of regions, with planting months written in several ways."""
    n = F.col("n_nationkey")
    names = F.array(*map(F.lit, ("January", "feb", " Mar", "APRIL", "May", "June", "Jul", "August", "Sept", "october", "Nov", "December")))
    month = n % 12 + 1
    raw = F.when(n % 7 == 6, F.lit(None)).when(n % 5 == 0, month.cast("string")).when(n % 5 == 1, F.get(names, n % 12)).when(n % 5 == 2, F.concat(month.cast("string"), F.lit("-"), (month % 12 + 1).cast("string"))).when(n % 5 == 3, F.concat(month.cast("string"), F.lit(".0"))).otherwise(F.lit("n/a"))
    region = read(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    own = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("name"), raw.alias("planting_month_raw"))
    return own.join(region, own.n_regionkey == region.r_regionkey).select("n_nationkey", "name", "region", "planting_month_raw")


UNITS = """SELECT n_nationkey, n_name AS name, r_name AS region,
  CASE WHEN n_nationkey % 7 = 6 THEN NULL WHEN n_nationkey % 5 = 0 THEN CAST(n_nationkey % 12 + 1 AS VARCHAR)
       WHEN n_nationkey % 5 = 1 THEN list_extract(['January','feb',' Mar','APRIL','May','June','Jul','August','Sept','october','Nov','December'], n_nationkey % 12 + 1)
       WHEN n_nationkey % 5 = 2 THEN concat(n_nationkey % 12 + 1, '-', (n_nationkey % 12 + 1) % 12 + 1)
       WHEN n_nationkey % 5 = 3 THEN concat(n_nationkey % 12 + 1, '.0') ELSE 'n/a' END AS planting_month_raw
FROM nation JOIN region ON n_regionkey = r_regionkey"""
MONTH = """CASE WHEN TRY_CAST(trim(regexp_extract(lower(trim(raw)), '^([^-/–]*)', 1)) AS DOUBLE) IS NOT NULL
  THEN CASE WHEN round_even(TRY_CAST(trim(regexp_extract(lower(trim(raw)), '^([^-/–]*)', 1)) AS DOUBLE), 0) BETWEEN 1 AND 12 THEN CAST(round_even(TRY_CAST(trim(regexp_extract(lower(trim(raw)), '^([^-/–]*)', 1)) AS DOUBLE), 0) AS INT) END
  WHEN length(trim(regexp_extract(lower(trim(raw)), '^([^-/–]*)', 1))) >= 3
  THEN nullif(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(trim(regexp_extract(lower(trim(raw)), '^([^-/–]*)', 1)), 1, 3)), 0) END"""


def municipal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as municipal rows of their nation: (name, planting_month_raw)."""
    month = (F.col("c_custkey") * 7 + F.col("c_nationkey")) % 4 + F.when(F.col("c_custkey") % 29 == 0, 1).otherwise(5)
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_custkey") % 17 != 0, month.cast("string")).alias("planting_month_raw"))
    return rows.join(nation, "n_nationkey").select("name", "planting_month_raw")


MUNICIPAL = "SELECT n_name AS name, CASE WHEN c_custkey % 17 <> 0 THEN CAST((c_custkey * 7 + c_nationkey) % 4 + CASE WHEN c_custkey % 29 = 0 THEN 1 ELSE 5 END AS VARCHAR) END AS planting_month_raw FROM customer JOIN nation ON c_nationkey = n_nationkey"


def boxes(spark: SparkSession, sf_dir: str, table: str, key: str, prefix: str, size: float) -> DataFrame:
    """Deterministic boxes in a 10 x 10 degree square from a table's keys."""
    x, y = F.col(key) * 37 % 100 / 10.0, F.col(key) * 53 % 100 / 10.0
    return read(spark, sf_dir, table).select(F.col(key).alias(f"{prefix}id"), x.alias(f"{prefix}w"), y.alias(f"{prefix}s"), (x + size).alias(f"{prefix}e"), (y + size).alias(f"{prefix}n"))


def boxes_sql(table: str, key: str, prefix: str, size: float) -> str:
    return f"SELECT {key} AS {prefix}id, {key} * 37 % 100 / 10.0 AS {prefix}w, {key} * 53 % 100 / 10.0 AS {prefix}s, {key} * 37 % 100 / 10.0 + {size} AS {prefix}e, {key} * 53 % 100 / 10.0 + {size} AS {prefix}n FROM {table}"


#: Planting months of the regions in the run's wet season of 2026: two windows, and one that has not begun.
RUN_MONTHS = {0: "May", 1: "7", 2: "12", 3: "5", 4: "Jul-Aug"}
RUN_DAY = "2026-11-10"


def run_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as units."""
    raw = F.create_map(*(x for k, m in RUN_MONTHS.items() for x in (F.lit(k), F.lit(m))))
    return read(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("all").alias("region"), F.try_element_at(raw, F.col("r_regionkey")).alias("planting_month_raw"))


def run_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The growth curves of ``pixels`` as observations every ten days from 2026-04-01; none in region 3.

    Customers meet their region, of few rows, before their curves are made, so no table of their size is joined.
    """
    owner = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region").where("r_regionkey <> 3"), F.col("n_regionkey") == F.col("r_regionkey"))
    owner = owner.select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("unit"))
    own = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(owner, "c_nationkey").select("c_custkey", "unit")
    ts = F.expr("timestamp_ntz'2026-04-01' + make_dt_interval(k * 10)")
    return grid(_curves(own)).select("row", "col", "unit", ts.alias("ts"), F.col("v").alias("ndvi"))


def run_series(first: str, n: int, shift: int, keys: str) -> str:
    """The same as a series (pixel_id, k, t, v) whose k-th composite takes the observation k - shift, in the regions of these keys."""
    own = f"SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN ({keys})"
    seen = f"SELECT pixel_id, CAST(k + {shift} AS INT) AS k, v FROM ({PIXELS}) SEMI JOIN ({own}) o ON o.c_custkey = pixel_id WHERE v IS NOT NULL AND DATE '2026-04-01' + 10 * k <= DATE '{RUN_DAY}' AND k + {shift} BETWEEN 0 AND {n - 1}"
    return f"SELECT p.pixel_id, a.k, CAST(DATE '{first}' - DATE '1970-01-01' + 10 * a.k AS INT) AS t, s.v FROM (SELECT DISTINCT pixel_id FROM ({seen})) p CROSS JOIN (SELECT CAST(range AS INT) AS k FROM range({n})) a LEFT JOIN ({seen}) s ON s.pixel_id = p.pixel_id AND s.k = a.k"
