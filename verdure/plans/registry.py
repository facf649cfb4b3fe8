"""All registered queries of the time-series engine with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure import scratch, search
from verdure.config import DATES, NO_VALUE, QUALITY, STAGES, Phenology, Reflectance, Settings
from verdure.functions import calendar, masks, text
from verdure.operators import admin, composite, focal, grid, layers, mosaic, phenology, series, stages, summary
from verdure.plans import bindings as b
from verdure.plans.runner import STORED, Runner
from verdure.sources import catalog
from verdure.streaming import composites as streaming

QUERIES: dict = {}
SQL: dict[str, str] = {}
LOOSE = Phenology(min_obs=4, peak_search=(2, 27), pre_peak_days=11, post_peak_days=9, min_amplitude=0.05, min_peak=0.2, max_base=0.95, season_length=(1, 28))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in names else c for c in df.columns))


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) if kind == "date" else c for c, kind in df.dtypes))


def _round_sql(sql: str, names: tuple, keep: str, digits: int = 6) -> str:
    return f"SELECT {keep}, " + ", ".join(f"round({n}, {digits}) AS {n}" for n in names) + f" FROM ({sql})"


# ---- masks and observations ------------------------------------------------

_DN = "greatest((CAST({0} AS DOUBLE) - CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 10.0 ELSE 0.0 END) / 10000.0, 0.0001)"
_INDEX = "greatest(-1.0, least(1.0, ({1} - {0}) / ({1} + {0})))"


@query(f"SELECT event_id, round(CASE WHEN red > 0 AND nir > 0 AND cls <> 'error' AND list_contains({list(b.REFLECTANCE.clear_classes)}, cls) THEN {_INDEX.format(_DN.format('red'), _DN.format('nir'))} END, 9) AS ndvi FROM ({b.SCENES}) WHERE red > 0")
def scan_filter_ndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.scenes(spark, sf_dir).where("red > 0")
    ndvi = masks.ndvi_from_classes(F.col("red"), F.col("nir"), F.col("cls"), F.col("ts"), b.REFLECTANCE)
    return rows.select("event_id", F.round(ndvi, 9).alias("ndvi"))


_HLS = "greatest(CAST({0} AS DOUBLE) / 10000.0, 0.0001)"


@query(f"SELECT event_id, (qa & 31) = 0 AND ((qa >> 6) & 3) <> 3 AND qa <> 255 AS clear, round(CASE WHEN red <> -9999 AND nir <> -9999 AND (qa & 31) = 0 AND ((qa >> 6) & 3) <> 3 AND qa <> 255 THEN {_INDEX.format(_HLS.format('red'), _HLS.format('nir'))} END, 9) AS ndvi FROM ({b.SCENES})")
def qa_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = b.scenes(spark, sf_dir), Reflectance()
    return rows.select("event_id", masks.clear_bits(F.col("qa"), c).alias("clear"), F.round(masks.ndvi_from_bits(F.col("red"), F.col("nir"), F.col("qa"), c), 9).alias("ndvi"))


@query(f"SELECT pixel_id, min(event_id) AS event_id, CAST(day AS VARCHAR) AS day, arg_min(nir, event_id) AS nir FROM (SELECT *, CAST(ts AS DATE) AS day FROM ({b.SCENES}) WHERE cls <> 'error') GROUP BY pixel_id, day")
def same_day_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.scenes(spark, sf_dir).where("cls <> 'error'").withColumnRenamed("event_id", "scene_id")
    return composite.fuse(rows, ["nir"]).select("pixel_id", F.col("scene_id").alias("event_id"), F.col("day").cast("string").alias("day"), "nir")


@query(f"SELECT pixel_id, k, max(ndvi) AS v FROM ({b.BINNED}) WHERE k BETWEEN 0 AND 29 GROUP BY ALL")
def composite_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.composite(b.observations(spark, sf_dir), b.EVENT_FIRST, 1, b.EVENT_N, "max")


@query(f"SELECT pixel_id, k, round(median(ndvi), 9) AS v FROM ({b.BINNED}) WHERE k BETWEEN 0 AND 29 GROUP BY ALL")
def composite_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(composite.composite(b.observations(spark, sf_dir), b.EVENT_FIRST, 1, b.EVENT_N, "median"), "v", digits=9)


@query(b.EVENT_SERIES)
def composite_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.dense(b.observations(spark, sf_dir), b.EVENT_FIRST, 1, b.EVENT_N)


_ORDER_SPAN = "SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY o_custkey"


def _spans(spark, sf_dir):
    return b.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("s"), F.to_date(F.max("o_orderdate")).alias("e"))


@query(f"SELECT o_custkey, CAST(CAST(unnest(generate_series(s, e, INTERVAL 10 DAY)) AS DATE) AS VARCHAR) AS anchor FROM ({_ORDER_SPAN})")
def anchors_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("o_custkey", F.explode(composite.anchors(F.col("s"), F.col("e"), 10)).alias("anchor")).withColumn("anchor", F.col("anchor").cast("string"))


@query(f"SELECT o_custkey, CAST(CAST(unnest(generate_series(e - to_days(CAST(floor((e - s) / 10) * 10 AS INT)), e, INTERVAL 10 DAY)) AS DATE) AS VARCHAR) AS anchor FROM ({_ORDER_SPAN})")
def anchors_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("o_custkey", F.explode(composite.anchors(F.col("s"), F.col("e"), 10, "end")).alias("anchor")).withColumn("anchor", F.col("anchor").cast("string"))


# ---- series ------------------------------------------------------------------


def _events(spark, sf_dir):
    return composite.dense(b.observations(spark, sf_dir), b.EVENT_FIRST, 1, b.EVENT_N)


# the rules in SQL of their own, by joins and lists instead of windows

_C = Phenology()
_MOVED = "SELECT pixel_id, list(k ORDER BY k) AS ks FROM s WHERE v IS NOT NULL GROUP BY pixel_id"
_CLEAN = f"""WITH s AS ({b.EVENT_SERIES}),
a AS (SELECT s.pixel_id, s.k, s.v, coalesce(s.v, CASE WHEN p.k IS NULL THEN n.v WHEN n.k IS NULL THEN p.v ELSE p.v + (n.v - p.v) * (s.k - p.k) / (n.k - p.k) END) AS f0
      FROM s ASOF LEFT JOIN (SELECT * FROM s WHERE v IS NOT NULL) p ON s.pixel_id = p.pixel_id AND s.k >= p.k ASOF LEFT JOIN (SELECT * FROM s WHERE v IS NOT NULL) n ON s.pixel_id = n.pixel_id AND s.k <= n.k),
d AS (SELECT a.*, CASE WHEN least(p.f0, n.f0) > {_C.despike_neighbour} AND p.f0 IS NOT NULL AND n.f0 IS NOT NULL AND a.f0 < (p.f0 + n.f0) / 2 - {_C.despike_drop} THEN NULL ELSE a.v END AS d
      FROM a LEFT JOIN a p ON p.pixel_id = a.pixel_id AND p.k = a.k - 1 LEFT JOIN a n ON n.pixel_id = a.pixel_id AND n.k = a.k + 1),
c AS (SELECT d.pixel_id, d.k, CASE WHEN (SELECT count(*) FROM d o WHERE o.pixel_id = d.pixel_id AND o.v IS NOT NULL) < {_C.min_obs} THEN 0.0 ELSE coalesce(d.d, CASE WHEN p.k IS NULL THEN n.d WHEN n.k IS NULL THEN p.d ELSE p.d + (n.d - p.d) * (d.k - p.k) / (n.k - p.k) END) END AS f
      FROM d ASOF LEFT JOIN (SELECT * FROM d WHERE d IS NOT NULL) p ON d.pixel_id = p.pixel_id AND d.k >= p.k ASOF LEFT JOIN (SELECT * FROM d WHERE d IS NOT NULL) n ON d.pixel_id = n.pixel_id AND d.k <= n.k),
l AS (SELECT pixel_id, list(f ORDER BY k) AS x FROM c GROUP BY pixel_id),
g AS (SELECT pixel_id, f, k, CASE k WHEN 0 THEN list_dot_product([31, 9, -3, -5, 3]::DOUBLE[], x[1:5]) WHEN 1 THEN list_dot_product([9, 13, 12, 6, -5]::DOUBLE[], x[1:5])
        WHEN {b.EVENT_N - 2} THEN list_dot_product([-5, 6, 12, 13, 9]::DOUBLE[], x[{b.EVENT_N - 4}:{b.EVENT_N}]) WHEN {b.EVENT_N - 1} THEN list_dot_product([3, -5, -3, 9, 31]::DOUBLE[], x[{b.EVENT_N - 4}:{b.EVENT_N}])
        ELSE list_dot_product([-3, 12, 17, 12, -3]::DOUBLE[], x[k - 1 : k + 3]) END / 35 AS s FROM c JOIN l USING (pixel_id)),
y AS (SELECT pixel_id, list(s ORDER BY k) AS s FROM g GROUP BY pixel_id)"""


def _slope(x: str) -> str:
    """Central differences of a list, one-sided at its ends."""
    return f"list_transform(range(1, {b.EVENT_N} + 1), lambda i: ({x}[least(i + 1, {b.EVENT_N})] - {x}[greatest(i - 1, 1)]) / (least(i + 1, {b.EVENT_N}) - greatest(i - 1, 1)))"


@query(f"WITH s AS ({b.EVENT_SERIES}), l AS ({_MOVED}) SELECT pixel_id, len(ks) AS n_obs, ks[1] AS first_obs, ks[-1] AS last_obs, coalesce(list_max(list_transform(range(1, len(ks)), lambda i: ks[i + 1] - ks[i])), 0) AS max_gap, 19723 + ks[-1] AS last_obs_day FROM l")
def observation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.apply(_events(spark, sf_dir), series.observation_layers()).where("k = 0").select("pixel_id", "n_obs", "first_obs", "last_obs", "max_gap", "last_obs_day")


@query(f"{_CLEAN} SELECT pixel_id, k, round(f0, 6) AS f FROM a")
def gap_fill_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(layers.apply(_events(spark, sf_dir), series.fill_layers("v", "f")).select("pixel_id", "k", "f"), "f")


_DESPIKE = [*series.fill_layers("v", "f0"), *series.despike_layers("v", "f0", "d", Phenology())]


@query(f"{_CLEAN} SELECT pixel_id, k, v IS NOT NULL AND d IS NULL AS dropped, round(d, 6) AS d FROM d")
def despike(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = layers.apply(_events(spark, sf_dir), _DESPIKE)
    return done.select("pixel_id", "k", F.expr("v IS NOT NULL AND d IS NULL").alias("dropped"), F.round("d", 6).alias("d"))


@query(f"{_CLEAN} SELECT pixel_id, k, round(f, 6) AS f, round(s, 6) AS s FROM g")
def sg_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.smooth_series(_events(spark, sf_dir), b.EVENT_N).select("pixel_id", "k", "f", "s"), "f", "s")


_GRADIENTS = [*series.clean_layers(b.EVENT_N, Phenology()), *series.gradient_layers("s", "g", b.EVENT_N, 1), *series.gradient_layers("g", "gg", b.EVENT_N, 1)]


@query(f"{_CLEAN}, z AS (SELECT pixel_id, {_slope('s')} AS g FROM y) SELECT pixel_id, unnest(range({b.EVENT_N})) AS k, round(unnest(g), 9) AS g, round(unnest({_slope('g')}), 9) AS gg FROM z")
def gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(layers.apply(_events(spark, sf_dir), _GRADIENTS).select("pixel_id", "k", "g", "gg"), "g", "gg", digits=9)


# ---- cycles ------------------------------------------------------------------

MAX, LAST = Phenology(), Phenology(peak_select="last", peak_search=(30, 240))
OTHER = Phenology(base_mode="single", tiller_rule="norm", plant_from="raw")
_NUMBERS = (*DATES, "season_length", "ndvi_min", "ndvi_max", "ndvi15")


def _cycles(spark, sf_dir, c=MAX):
    return phenology.extract(b.pixels(spark, sf_dir), b.N, b.DAYS, b.FIRST_DAY, c)


def _cycles_sql(c=MAX):
    return phenology.extract_sql(b.PIXELS, b.N, b.DAYS, b.FIRST_DAY, c)


def _cycle_query(name: str, c: Phenology) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(_cycles(spark, sf_dir, c), *_NUMBERS, digits=4)

    run.__name__ = name
    query(_round_sql(_cycles_sql(c), _NUMBERS, "pixel_id, n_obs, max_gap_days, last_obs, qc", 4))(run)


_cycle_query("phenology_dates", MAX)
_cycle_query("phenology_last_cycle", LAST)
_cycle_query("phenology_variants", OTHER)


@query(_round_sql(phenology.extract_sql(b.EVENT_SERIES, b.EVENT_N, 1, 19723, LOOSE), _NUMBERS, "pixel_id, n_obs, max_gap_days, last_obs, qc", 4))
def phenology_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(phenology.extract(_events(spark, sf_dir), b.EVENT_N, 1, 19723, LOOSE), *_NUMBERS, digits=4)


def _peak(c):
    return f"SELECT pixel_id, ip, s_top IS NOT NULL AS in_range FROM ({layers.render(b.PIXELS, phenology.cycle_layers(b.N, b.DAYS, b.FIRST_DAY, c))}) WHERE k = 0"


@query(_peak(MAX))
def peak_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.apply(b.pixels(spark, sf_dir), phenology.cycle_layers(b.N, b.DAYS, b.FIRST_DAY, MAX)).where("k = 0").selectExpr("pixel_id", "ip", "s_top IS NOT NULL AS in_range")


@query(_peak(LAST))
def last_cycle_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.apply(b.pixels(spark, sf_dir), phenology.cycle_layers(b.N, b.DAYS, b.FIRST_DAY, LAST)).where("k = 0").selectExpr("pixel_id", "ip", "s_top IS NOT NULL AS in_range")


@query(f"SELECT qc, count(*) AS pixels FROM ({_cycles_sql()}) GROUP BY qc")
def qc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.quality_histogram(_cycles(spark, sf_dir))


@query("SELECT c.qc, q.name, c.pixels FROM (SELECT qc, count(*) AS pixels FROM (" + _cycles_sql() + ") GROUP BY qc) c JOIN (VALUES " + ", ".join(f"({c}, '{n}')" for c, n in QUALITY.items()) + ") q(qc, name) USING (qc)")
def quick_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(x for c, n in QUALITY.items() for x in (F.lit(c), F.lit(n))))
    return summary.quality_histogram(_cycles(spark, sf_dir)).select("qc", F.try_element_at(names, F.col("qc")).alias("name"), "pixels")


# ---- stages ------------------------------------------------------------------


def _stage_sql(day: str) -> str:
    return f"CAST(CASE WHEN qc IS NULL THEN -1 WHEN qc >= 10 THEN 0 WHEN harvest <= {day} THEN 5 WHEN peak <= {day} THEN 4 WHEN panicle_init <= {day} THEN 3 WHEN emergence <= {day} THEN 2 ELSE 1 END AS SMALLINT)"


def _dominant_sql(a: str, z: str) -> str:
    far, s = "CAST('Infinity' AS DOUBLE)", {1: "CAST('-Infinity' AS DOUBLE)"}
    s |= {c: f"coalesce(CAST({n} AS DOUBLE), CAST('Infinity' AS DOUBLE))" for c, n in ((2, "emergence"), (3, "panicle_init"), (4, "peak"), (5, "harvest"))}
    days = {c: f"greatest(least({', '.join([s[x] for x in s if x > c] + [far, z])}) - greatest({s[c]}, {a}), 0.0)" for c in s}
    top = f"greatest({', '.join(days.values())})"
    return f"CAST(CASE WHEN qc IS NULL THEN -1 WHEN qc >= 10 THEN 0 {' '.join(f'WHEN {days[c]} = {top} THEN {c}' for c in (5, 4, 3, 2, 1))} END AS SMALLINT)"


@query(f"SELECT pixel_id, {_stage_sql('20544')} AS growth_stage FROM ({_cycles_sql()})")
def stage_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cycles(spark, sf_dir).select("pixel_id", stages.stage_at(F.unix_date(F.lit("2026-04-01").cast("date"))).alias("growth_stage"))


_MONTHS = [("202512", "2025-12-01", "2026-01-01", 20423, 20454), ("202602", "2026-02-01", "2026-03-01", 20485, 20513), ("202605", "2026-05-01", "2026-06-01", 20574, 20605)]
_PERIODS = "(VALUES " + ", ".join(f"('{l}', {a}.0, {z}.0)" for l, _, _, a, z in _MONTHS) + ") p(label, a, z)"


def _periods(spark):
    return spark.createDataFrame([(l, s, e) for l, s, e, _, _ in _MONTHS], "label string, s string, e string").select("label", F.to_date("s").alias("p_start"), F.to_date("e").alias("p_end"))


@query(f"SELECT pixel_id, label, {_dominant_sql('a', 'z')} AS growth_stage FROM ({_cycles_sql()}) CROSS JOIN {_PERIODS}")
def stage_period_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.stage_maps(_cycles(spark, sf_dir), _periods(spark))


@query(f"SELECT pixel_id, label, {_stage_sql('(a + (z - a) / 2)')} AS growth_stage FROM ({_cycles_sql()}) CROSS JOIN {_PERIODS}")
def stage_period_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.stage_maps(_cycles(spark, sf_dir), _periods(spark), "midpoint")


@query(f"SELECT pixel_id, {_stage_sql('20499')} AS midmonth, {_dominant_sql('20485.0', '20513.0')} AS dominant FROM ({_cycles_sql()})")
def stage_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cycles(spark, sf_dir).select("pixel_id", stages.stage_in_month("2026-02", "midmonth").alias("midmonth"), stages.stage_in_month("2026-02").alias("dominant"))


@query(f"SELECT pixel_id, {_stage_sql('20544')} AS growth_stage, 20544 - last_obs AS data_age_days, qc FROM ({_cycles_sql(LAST)})")
def recent_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.recent(_cycles(spark, sf_dir, LAST), "2026-04-01")


_FIRST_2026 = 20454


def _pack(e: str) -> str:
    return f"CAST(coalesce(least(greatest(round_even({e}, 0), -32767), 32767), {NO_VALUE}) AS SMALLINT)"


_CODED = {n: _pack(f"{n} - {_FIRST_2026} + 1" if n in (*DATES, "last_obs") else f"{n} * 10000" if n.startswith("ndvi") else f"CAST({n} AS DOUBLE)") for n in phenology.OUTPUT[1:]}
_ENCODED = "SELECT pixel_id, " + ", ".join(f"{e} AS {n}" for n, e in _CODED.items()) + f" FROM ({_cycles_sql()})"


@query(_ENCODED)
def encode_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.encoded(_cycles(spark, sf_dir), 2026)


_DECODED = ", ".join(f"CASE WHEN {n} <> {NO_VALUE} THEN {n} + {_FIRST_2026 - 1} END AS {n}" for n in DATES)


@query(f"SELECT pixel_id, {_stage_sql('20544')} AS growth_stage FROM (SELECT pixel_id, qc, {_DECODED} FROM ({_ENCODED}))")
def stage_from_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stages.decoded(stages.encoded(_cycles(spark, sf_dir), 2026), 2026)
    return rows.select("pixel_id", stages.stage_at(F.unix_date(F.lit("2026-04-01").cast("date"))).alias("growth_stage"))


# ---- areas -------------------------------------------------------------------

_HA = "pow(0.01 * 111320, 2) * cos(radians(15 - CAST(floor(pixel_id / 40) AS INT) * 0.01)) / 10000"


def _stage_cells(spark, sf_dir):
    cells = _cycles(spark, sf_dir).select("pixel_id", stages.stage_at(F.lit(20544)).alias("growth_stage"))
    return b.grid(cells).withColumn("ha", grid.cell_area_ha(15 - F.col("row") * b.RES, b.RES))


_STAGE_CELLS = f"SELECT pixel_id, {_stage_sql('20544')} AS growth_stage, {b.GRID}, {_HA} AS ha FROM ({_cycles_sql()})"
_NAMES = "(VALUES " + ", ".join(f"({c}, '{n}')" for c, n in STAGES.items()) + ") n(growth_stage, name)"


@query(f"SELECT c.growth_stage, n.name, c.pixels, round_even(ha, 1) AS hectares, CASE WHEN sum(ha) OVER () > 0 THEN round_even(100 * ha / sum(ha) OVER (), 1) ELSE 0.0 END AS share_pct FROM (SELECT growth_stage, count(*) AS pixels, sum(ha) AS ha FROM ({_STAGE_CELLS}) WHERE growth_stage >= 0 GROUP BY ALL) c JOIN {_NAMES} USING (growth_stage)")
def area_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.shares(summary.counts(_stage_cells(spark, sf_dir), []), [])


_UNIT_CELLS = f"SELECT s.growth_stage, s.ha, n_name AS unit, r_name AS region FROM ({_STAGE_CELLS}) s JOIN customer ON c_custkey = pixel_id JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _unit_cells(spark, sf_dir):
    owner = b.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pixel_id"), F.col("c_nationkey").alias("n_nationkey"))
    names = b.units(spark, sf_dir).select("n_nationkey", F.col("name").alias("unit"), "region")
    return _stage_cells(spark, sf_dir).join(owner, "pixel_id").join(names, "n_nationkey")


@query(f"SELECT region, unit, growth_stage, count(*) AS pixels, round(sum(ha), 3) AS hectares FROM ({_UNIT_CELLS}) WHERE growth_stage >= 0 GROUP BY ROLLUP (region, unit, growth_stage)")
def area_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.rollup(_unit_cells(spark, sf_dir), ["region", "unit", "growth_stage"]), "hectares", digits=3)


@query(f"SELECT unit, growth_stage, count(*) AS pixels, round(sum(ha), 3) AS hectares FROM ({_UNIT_CELLS}) WHERE growth_stage >= 0 GROUP BY ALL")
def unit_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.counts(_unit_cells(spark, sf_dir), ["unit"]).select("unit", "growth_stage", "pixels", "hectares"), "hectares", digits=3)


# ---- neighbourhoods and grids ------------------------------------------------

_LAST_CELLS = f"SELECT {b.GRID}, max(CASE WHEN k = 12 THEN v END) AS v FROM ({b.PIXELS}) GROUP BY pixel_id"
_NEAR = "abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1"


def _cells(spark, sf_dir):
    return b.grid(b.pixels(spark, sf_dir).where("k = 12")).select("row", "col", "v")


@query(f"WITH c AS ({_LAST_CELLS}) SELECT a.row, a.col, round(CASE WHEN a.v IS NOT NULL THEN median(b.v) END, 7) AS v FROM c a JOIN c b ON {_NEAR} GROUP BY a.row, a.col, a.v")
def focal_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(focal.median(_cells(spark, sf_dir), ["v"]), "v", digits=7)


@query(f"WITH c AS (SELECT row, col, growth_stage AS g FROM ({_STAGE_CELLS})), m AS (SELECT a.row, a.col, a.g AS own, b.g, count(*) AS n FROM c a JOIN c b ON {_NEAR} WHERE b.g <> -1 GROUP BY ALL), t AS (SELECT row, col, own, g, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, g) AS r FROM m) SELECT row, col, g AS growth_stage FROM t WHERE r = 1")
def majority_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = focal.majority(_stage_cells(spark, sf_dir).select("row", "col", "growth_stage"), "growth_stage")
    return out.select("row", "col", F.col("growth_stage").cast("smallint").alias("growth_stage"))


_SMOOTH = f"WITH c AS (SELECT {b.GRID}, emergence, harvest FROM ({_cycles_sql()})), s AS (SELECT a.row, a.col, CASE WHEN a.emergence IS NOT NULL THEN median(b.emergence) END AS emergence, CASE WHEN a.harvest IS NOT NULL THEN median(b.harvest) END AS harvest FROM c a JOIN c b ON {_NEAR} GROUP BY a.row, a.col, a.emergence, a.harvest)"


@query(f"{_SMOOTH} SELECT row, col, round(emergence, 4) AS emergence, round(harvest, 4) AS harvest, round(harvest - emergence, 4) AS season_length FROM s")
def smooth_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = b.grid(_cycles(spark, sf_dir)).select("row", "col", "emergence", "harvest")
    return _rounded(focal.smooth_dates(cells, ["emergence", "harvest"]), "emergence", "harvest", "season_length", digits=4)


@query(f"WITH c AS ({_LAST_CELLS}) SELECT CAST(floor(row / 3) AS INT) AS row, CAST(floor(col / 3) AS INT) AS col, round(avg(v), 6) AS v FROM c GROUP BY ALL")
def resample_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grid.coarser(_cells(spark, sf_dir), 3, "v"), "v")


@query(f"WITH c AS (SELECT CAST(floor(row / 3) AS INT) AS row, CAST(floor(col / 3) AS INT) AS col, growth_stage AS g, count(*) AS n FROM ({_STAGE_CELLS}) GROUP BY ALL) SELECT row, col, g AS growth_stage FROM c QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, g) = 1")
def resample_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.coarser(_stage_cells(spark, sf_dir), 3, "growth_stage", "mode")


_XY = "p_partkey * 37 % 1000 / 100.0 AS x, p_partkey * 53 % 1000 / 100.0 AS y"


def _points(spark, sf_dir):
    return b.read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 1000 / 100.0).alias("x"), (F.col("p_partkey") * 53 % 1000 / 100.0).alias("y"))


@query(f"SELECT p_partkey, CAST(floor(x / 0.25) AS INT) AS col, CAST(floor(-y / 0.25) AS INT) AS row FROM (SELECT p_partkey, {_XY} FROM part)")
def grid_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    col, row = grid.cell(F.col("x"), F.col("y"), 0.25)
    return _points(spark, sf_dir).select("p_partkey", col.alias("col"), row.alias("row"))


_TILES = "SELECT w, s, w + 0.5 AS e, s + 0.5 AS n FROM (SELECT range * 0.5 AS w FROM range(20)) CROSS JOIN (SELECT range * 0.5 AS s FROM range(20))"


@query(f"SELECT w, s, count(*) AS points FROM (SELECT {_XY} FROM part) JOIN ({_TILES}) ON x >= w AND x < e AND y >= s AND y < n GROUP BY w, s")
def tile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point in one half-open tile, by arithmetic instead of a range join."""
    w, s = grid.tile_of(F.col("x"), F.col("y"), 0.5)
    return _points(spark, sf_dir).groupBy(w.alias("w"), s.alias("s")).agg(F.count("*").alias("points"))


@query(f"SELECT l_id, round(c0 * 0.07::DOUBLE, 6) AS west, round(r1 * 0.07::DOUBLE, 6) AS north, c1 - c0 AS cols, r1 - r0 AS rows FROM (SELECT l_id, CAST(floor((l_w + 7e-8) / 0.07) AS BIGINT) AS c0, CAST(ceil((l_e - 7e-8) / 0.07) AS BIGINT) AS c1, CAST(floor((l_s + 7e-8) / 0.07) AS BIGINT) AS r0, CAST(ceil((l_n - 7e-8) / 0.07) AS BIGINT) AS r1 FROM (SELECT l_id, l_w::DOUBLE AS l_w, l_s::DOUBLE AS l_s, l_e::DOUBLE AS l_e, l_n::DOUBLE AS l_n FROM ({b.boxes_sql('part', 'p_partkey', 'l_', 0.3)})))")
def grid_snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with edges at multiples of a step that holds each box."""
    at = grid.snap(F.col("l_w"), F.col("l_s"), F.col("l_e"), F.col("l_n"), 0.07)
    return _rounded(b.boxes(spark, sf_dir, "part", "p_partkey", "l_", 0.3).select("l_id", at.alias("g")).select("l_id", "g.*"), "west", "north")


_TRIANGLE = [(1.0, 1.0), (9.0, 1.0), (1.0, 9.0)]


@query("SELECT w, s, CAST(w + 0.5 AS DOUBLE) AS e, CAST(s + 0.5 AS DOUBLE) AS n FROM (SELECT CAST(range * 0.5 + 1 AS DOUBLE) AS w FROM range(16)) CROSS JOIN (SELECT CAST(range * 0.5 + 1 AS DOUBLE) AS s FROM range(16)) WHERE w + s < 10 - 1e-9")
def tiles_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of a triangle's box of which a part lies in the triangle; the table only says that it runs at every size."""
    return grid.tiles_within(_TRIANGLE, 0.5, spark)


_BOXES = "l_w < r_e AND l_e > r_w AND l_s < r_n AND l_n > r_s"


@query(f"SELECT l_id, r_id FROM ({b.boxes_sql('part', 'p_partkey', 'l_', 0.3)}) JOIN ({b.boxes_sql('supplier', 's_suppkey', 'r_', 0.7)}) ON {_BOXES}")
def bbox_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.join_boxes(b.boxes(spark, sf_dir, "part", "p_partkey", "l_", 0.3), b.boxes(spark, sf_dir, "supplier", "s_suppkey", "r_", 0.7), 1.0).select("l_id", "r_id")


@query(f"SELECT l_id FROM ({b.boxes_sql('part', 'p_partkey', 'l_', 0.3)}) SEMI JOIN ({b.boxes_sql('supplier', 's_suppkey', 'r_', 0.7)}) ON {_BOXES}")
def tile_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.join_boxes(b.boxes(spark, sf_dir, "part", "p_partkey", "l_", 0.3), b.boxes(spark, sf_dir, "supplier", "s_suppkey", "r_", 0.7), 1.0, "semi").select("l_id")


@query(f"WITH r AS (SELECT CAST(floor(s_suppkey * 37 % 1000 / 100.0 / 0.5 + 0.5) AS BIGINT) AS i, CAST(floor(s_suppkey * 53 % 1000 / 100.0 / 0.5 + 0.5) AS BIGINT) AS j, max(s_acctbal) AS s_acctbal FROM supplier GROUP BY ALL) SELECT p_partkey, s_acctbal FROM (SELECT p_partkey, {_XY} FROM part) LEFT JOIN r ON i = CAST(floor(x / 0.5 + 0.5) AS BIGINT) AND j = CAST(floor(y / 0.5 + 0.5) AS BIGINT)")
def nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = b.read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 37 % 1000 / 100.0).alias("x"), (F.col("s_suppkey") * 53 % 1000 / 100.0).alias("y"), "s_acctbal")
    return grid.nearest(_points(spark, sf_dir), right, "x", "y", "s_acctbal", 0.5).select("p_partkey", "s_acctbal")


_RING = [(0.05, -0.25), (0.33, -0.25), (0.33, -0.02), (0.05, -0.02)]


_HOLE = [(0.105, -0.155), (0.225, -0.155), (0.225, -0.085), (0.105, -0.085)]


@query("SELECT row, col FROM (SELECT CAST(floor(c_custkey / 40) AS INT) AS row, CAST(c_custkey % 40 AS INT) AS col FROM customer) WHERE col * 0.01 < 0.33 AND col * 0.01 + 0.01 > 0.05 AND -row * 0.01 > -0.25 AND -row * 0.01 - 0.01 < -0.02 AND NOT (col BETWEEN 11 AND 21 AND row BETWEEN 9 AND 14)")
def clip_cells_hole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring with a hole: cells that the hole holds whole go, those on its edge stay."""
    return grid.clip(_cells(spark, sf_dir).select("row", "col"), [_RING], b.RES, [_HOLE]).select("row", "col")


@query("SELECT row, col FROM (SELECT CAST(floor(c_custkey / 40) AS INT) AS row, CAST(c_custkey % 40 AS INT) AS col FROM customer) WHERE col * 0.01 < 0.33 AND col * 0.01 + 0.01 > 0.05 AND -row * 0.01 > -0.25 AND -row * 0.01 - 0.01 < -0.02")
def clip_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.clip(_cells(spark, sf_dir).select("row", "col"), [_RING], b.RES).select("row", "col")


_INPUTS = f"SELECT CAST(floor(pixel_id / 40) AS INT) + 3 * i AS row, CAST(pixel_id % 40 AS INT) AS col, i AS input_order, CASE WHEN (pixel_id + i) % 3 = 0 THEN CAST(-1 AS SMALLINT) ELSE growth_stage END AS growth_stage FROM ({_STAGE_CELLS}) CROSS JOIN (SELECT CAST(range AS INT) AS i FROM range(3))"


@query(f"SELECT row, col, arg_min(growth_stage, input_order) AS growth_stage FROM ({_INPUTS}) WHERE growth_stage <> -1 GROUP BY row, col")
def mosaic_first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _stage_cells(spark, sf_dir).withColumn("input_order", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    own = F.when((F.col("pixel_id") + F.col("input_order")) % 3 == 0, F.lit(-1).cast("smallint")).otherwise(F.col("growth_stage"))
    cells = cells.select((F.col("row") + 3 * F.col("input_order")).alias("row"), "col", "input_order", own.alias("growth_stage"))
    return focal.first_valid(cells, "input_order", ["growth_stage"], -1)


_FINE = f"SELECT row, col, CASE WHEN (row + col) % 4 = 0 THEN -1 ELSE CAST(v * 1000 AS INT) END AS a FROM ({_LAST_CELLS}) WHERE col < 20 AND v IS NOT NULL"
_COARSE = f"SELECT CAST(floor((row + 0.5) * 2) AS INT) AS row, CAST(floor((col + 0.5) * 2) AS INT) AS col, CAST(v * 100 AS INT) AS a FROM ({_LAST_CELLS}) WHERE v IS NOT NULL AND CAST(v * 100 AS INT) <> 40"


@query(f"SELECT row, col, arg_min(a, i) AS a FROM (SELECT *, 0 AS i FROM ({_FINE}) WHERE a <> -1 UNION ALL SELECT *, 1 AS i FROM ({_COARSE})) GROUP BY row, col")
def mosaic_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rasters of other resolutions and no-data values: the finer grid, the first input with data, one no-data value."""
    cells = _cells(spark, sf_dir).where("v is not null")
    fine = cells.where("col < 20").select("row", "col", F.when((F.col("row") + F.col("col")) % 4 == 0, -1).otherwise(F.round(F.col("v") * 1000).cast("int")).alias("a"))
    coarse = cells.select("row", "col", F.round(F.col("v") * 100).cast("int").alias("a"))
    return mosaic.mosaic([mosaic.Raster(fine, 0.01, -1), mosaic.Raster(coarse, 0.02, 40)]).cells


# ---- units, seasons and plans ------------------------------------------------


@query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE upper(trim(r_name)) IN (SELECT upper(trim(r_name)) FROM region WHERE r_regionkey IN (1, 3)) AND NOT regexp_matches(upper(trim(n_name)), 'NATION_1')")
def unit_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [r[0] for r in b.read(spark, sf_dir, "region").where("r_regionkey IN (1, 3)").select("r_name").collect()]
    return admin.select_units(b.units(spark, sf_dir), "regional", wanted, ["nation_1"]).select("name", "region")


@query("SELECT DISTINCT n_name AS name FROM nation WHERE upper(n_name) LIKE '%2%'")
def list_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.list_areas(b.units(spark, sf_dir), contains="2")


@query(f"SELECT n_nationkey, {b.MONTH.replace('raw', 'planting_month_raw')} AS month FROM ({b.UNITS})")
def parse_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.units(spark, sf_dir).select("n_nationkey", calendar.parse_month(F.col("planting_month_raw")).alias("month"))


_MUN = f"SELECT name, {b.MONTH.replace('raw', 'planting_month_raw')} AS month FROM ({b.MUNICIPAL})"
_KEPT = f"SELECT name, month, n, n >= greatest(1, 0.1 * sum(n) OVER (PARTITION BY name)) AS keep FROM (SELECT name, month, count(*) AS n FROM ({_MUN}) WHERE month IS NOT NULL GROUP BY ALL)"


@query(f"SELECT name, coalesce(string_agg(month, ',' ORDER BY month) FILTER (keep), '6') AS months, coalesce(string_agg(month, ',' ORDER BY month) FILTER (NOT keep), '') AS rare, string_agg(concat(month, ':', n), ',' ORDER BY month) AS counts FROM ({_KEPT}) GROUP BY name")
def planting_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = admin.planting(b.municipal(spark, sf_dir), 6, "wet")
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    pairs = F.concat_ws(",", F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e.key.cast("string"), e.value.cast("string"))))
    return found.select("name", joined("months").alias("months"), joined("rare").alias("rare"), pairs.alias("counts"))


_WIN = "SELECT name, CAST(make_date(2026, CAST(month AS BIGINT), 1) - INTERVAL 1 MONTH AS DATE) AS s, last_day(CAST(make_date(2026, CAST(month AS BIGINT), 1) + INTERVAL 6 MONTH AS DATE)) AS e, month FROM ({0})"
_WINDOWS = f"SELECT name, min(s) AS season_start, max(e) AS season_end, arg_min(month, s) AS plant_month FROM ({_WIN.format(f'SELECT name, month FROM ({_KEPT}) WHERE keep')}) GROUP BY name"


def _windows(spark, sf_dir):
    return admin.season_windows(admin.planting(b.municipal(spark, sf_dir), 6, "wet"), 2026, "wet")


@query(f"SELECT name, CAST(season_start AS DATE)::VARCHAR AS season_start, CAST(season_end AS DATE)::VARCHAR AS season_end, plant_month FROM ({_WINDOWS})")
def season_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates_as_text(_windows(spark, sf_dir))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m') || CASE WHEN day(o_orderdate) > 15 THEN 'H2' ELSE 'H1' END AS label, CAST(CASE WHEN day(o_orderdate) > 15 THEN date_trunc('month', o_orderdate) + INTERVAL 15 DAY ELSE date_trunc('month', o_orderdate) END AS DATE)::VARCHAR AS p_start, CAST(CASE WHEN CAST(o_orderdate AS DATE) = last_day(o_orderdate) THEN date_trunc('month', o_orderdate) ELSE date_trunc('month', o_orderdate) - INTERVAL 1 MONTH END AS DATE)::VARCHAR AS last_month, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END AS INT) AS dry_year FROM orders")
def period_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    start = calendar.period_start(day, "semimonthly")
    return _dates_as_text(b.read(spark, sf_dir, "orders").select("o_orderkey", calendar.period_label(start, "semimonthly").alias("label"), start.alias("p_start"), calendar.last_complete(day).alias("last_month"), calendar.default_season_year(day, "dry").alias("dry_year")))


@query(f"SELECT o_custkey, strftime(m, '%Y%m') AS label FROM (SELECT o_custkey, unnest(generate_series(date_trunc('month', s), date_trunc('month', e), INTERVAL 1 MONTH)) AS m FROM ({_ORDER_SPAN}))")
def periods_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir).select("o_custkey", F.explode(calendar.periods_between(F.col("s"), F.col("e"))).alias("p"))
    return rows.select("o_custkey", calendar.period_label(F.col("p")).alias("label"))


_PLAN = f"SELECT name, season_start, season_end, plant_month, strftime(p, '%Y%m') AS label, CAST(p AS DATE) AS p_start, CAST(p + INTERVAL 1 MONTH AS DATE) AS p_end FROM (SELECT *, unnest(generate_series(date_trunc('month', season_start), date_trunc('month', season_end), INTERVAL 1 MONTH)) AS p FROM ({_WINDOWS})) WHERE p + INTERVAL 1 MONTH <= TIMESTAMP '2026-09-11'"


def _plan(spark, sf_dir):
    return admin.unit_periods(_windows(spark, sf_dir), "2026-09-10", "season")


@query(f"SELECT name, plant_month, label, " + ", ".join(f"CAST({n} AS DATE)::VARCHAR AS {n}" for n in ("season_start", "season_end", "p_start", "p_end")) + f" FROM ({_PLAN})")
def plan_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates_as_text(_plan(spark, sf_dir).select("name", "season_start", "season_end", "plant_month", "label", "p_start", "p_end"))


@query(f"SELECT name, label FROM ({_PLAN}) WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = name AND n_nationkey % 3 = 0 AND label < '202607')")
def missing_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = b.read(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"))
    expected = _plan(spark, sf_dir).select("name", "label")
    return admin.missing(expected, expected.where("label < '202607'").join(saved, "name", "left_semi"))


# ---- catalog scans -----------------------------------------------------------


_SEARCH = "w < 6 AND w + 0.5 > 2 AND s < 7 AND s + 0.5 > 1.5 AND CAST(acq_ts AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND cloud_cover < 60"


def _search(spark, sf_dir, source):
    return catalog.search(b.catalog(spark, sf_dir), source, (2.0, 1.5, 6.0, 7.0), "1996-01-01", "1997-06-30", 60.0)


@query(f"SELECT scene_id, cloud_cover::DOUBLE AS cloud_cover FROM ({b.CATALOG}) WHERE collection = 'sentinel-2-l2a' AND {_SEARCH}")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog search of one collection: box, dates and cloud limit are plain columns for the scan."""
    return _search(spark, sf_dir, "s2").select("scene_id", "cloud_cover")


@query(f"SELECT scene_id, collection FROM ({b.CATALOG}) WHERE collection IN ('hls2-s30', 'hls2-l30') AND {_SEARCH}")
def catalog_scan_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "hls").select("scene_id", "collection")


@query("SELECT o_orderkey AS scene_id, 'r' || o_orderkey AS red_href, 'n' || o_orderkey AS nir_href, 'q' || o_orderkey AS qa_href FROM orders")
def scene_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first asset of each band's candidates that a scene has."""
    return catalog.with_bands(b.catalog(spark, sf_dir)).select("scene_id", "red_href", "nir_href", "qa_href")


@query(f"SELECT collection, count(*) AS scenes FROM ({b.CATALOG}) WHERE scene_id % 11 <> 0 AND scene_id % 13 <> 0 AND scene_id % 17 <> 0 GROUP BY collection")
def bad_asset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets with bad headers are found, and scenes that have one left out by an anti join."""
    bad = catalog.find_bad(b.headers(spark, sf_dir))
    return catalog.without_bad(b.catalog(spark, sf_dir), bad).groupBy("collection").agg(F.count("*").alias("scenes"))


_CROP = f"SELECT row, col FROM ({b.COVER}) WHERE x BETWEEN 0.0 AND 0.305 AND y BETWEEN -10.0 AND 0.0 GROUP BY row, col HAVING arg_max(cls, time) = 40"


def _crop(spark, sf_dir):
    return catalog.cropland(b.cover(spark, sf_dir), (0.0, -10.0, 0.305, 0.0))


@query(_CROP)
def latest_land_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a box whose newest class is cropland."""
    return _crop(spark, sf_dir)


@query(f"SELECT c.row, c.col, CASE WHEN m.row IS NOT NULL THEN round(v, 6) END AS v FROM ({_LAST_CELLS}) c LEFT JOIN ({_CROP}) m ON m.row = c.row AND m.col = c.col")
def mask_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells outside the cropland mask become null; the mask's side is left to the optimizer's size check."""
    return _rounded(catalog.masked(_cells(spark, sf_dir), _crop(spark, sf_dir), "v"), "v")


@query(f"SELECT c.row, c.col, round(v, 6) AS v FROM ({_LAST_CELLS}) c SEMI JOIN ({_CROP}) m ON m.row = c.row AND m.col = c.col")
def mask_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(catalog.masked(_cells(spark, sf_dir), _crop(spark, sf_dir)), "v")


@query(f"SELECT min(row) AS row0, max(row) AS row1, min(col) AS col0, max(col) AS col1 FROM ({_CROP})")
def mask_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.extent(_crop(spark, sf_dir))


@query("SELECT p_partkey, CAST(floor((p_partkey * 37 % 1000 / 100.0 - 0.01) / 0.05 + 0.5) AS INT) AS col, CAST(floor((10.02 - p_partkey * 53 % 1000 / 100.0) / 0.05 + 0.5) AS INT) AS row FROM part")
def reindex_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second sensor's observations on the first one's grid."""
    return catalog.on_grid(_points(spark, sf_dir), 0.01, 10.02, 0.05).select("p_partkey", "row", "col")


_BITS = f"round(CASE WHEN red <> -9999 AND nir <> -9999 AND (qa & 31) = 0 AND ((qa >> 6) & 3) <> 3 AND qa <> 255 THEN {_INDEX.format(_HLS.format('red'), _HLS.format('nir'))} END, 9)"


@query(f"SELECT CAST(floor(pixel_id / 40) AS INT) AS row, CAST(pixel_id % 40 AS INT) AS col, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, {_BITS} AS ndvi FROM ({b.SCENES})")
def ndvi_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sensors whose grids are a fifth of a step apart, as one stack of index values on the first one's grid."""
    rows = b.scenes(spark, sf_dir)
    k, second = F.col("pixel_id"), F.col("event_id") % 2
    rows = rows.select((k % 40 * 0.01 + second * 0.002).alias("x"), (-F.floor(k / 40) * 0.01 - second * 0.002).alias("y"), "ts", "red", "nir", "qa", second.alias("second"))
    parts = [rows.where(F.col("second") == i).drop("second") for i in (0, 1)]
    made = catalog.stack(parts, "hls", 0.0, 0.0, 0.01)
    return _rounded(made, "ndvi", digits=9).select("row", "col", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "ndvi")


# ---- search ------------------------------------------------------------------

_QUERY = "the theand of_the heat ouand heat"
_TOKENS = "list_filter(list_concat(regexp_extract_all(lower(text), '[a-z0-9_]+'), flatten(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: contains(w, '_')), lambda w: list_filter(string_split(w, '_'), lambda p: p <> '')))), lambda w: NOT list_contains(" + str(list(text.STOP)) + ", w))"


@query(f"SELECT doc_id, len({_TOKENS}) AS n_tokens, len(list_distinct({_TOKENS})) AS n_terms FROM documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.tokens(F.col("text"))
    return b.read(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_terms"))


_BM25 = f"""WITH d AS (SELECT doc_id, {_TOKENS} AS words FROM documents), q(term, qn) AS (VALUES ('theand', 1), ('of_the', 1), ('heat', 2), ('ouand', 1)),
s AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM d),
t AS (SELECT doc_id, len(words) AS len, term, qn, len(list_filter(words, lambda w: w = term)) AS tf FROM d CROSS JOIN q),
f AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM t GROUP BY term)
SELECT doc_id, round(sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM t JOIN f USING (term) CROSS JOIN s WHERE tf > 0 GROUP BY doc_id ORDER BY sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) DESC, doc_id DESC LIMIT 10"""


@query(_BM25)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(b.read(spark, sf_dir, "documents"), _QUERY, 10, "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"SELECT term, count(*) AS df, sum(tf) AS total FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.terms(b.read(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


# ---- streaming and runs ------------------------------------------------------


def _stream(spark, sf_dir):
    events = b.read(spark, sf_dir, "events")
    rows = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet*").parquet(f"{sf_dir}")
    k = F.when(F.col("event_type") != "error", F.col("value") / 500)
    return rows.select(F.col("user_id").alias("pixel_id"), "ts", k.alias("ndvi"))


@query(f"SELECT pixel_id, max(ts) AS last_obs FROM ({b.OBSERVATIONS}) WHERE ndvi IS NOT NULL GROUP BY pixel_id")
def streaming_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest clear observation of each pixel as updating state."""
    return streaming.run_once(streaming.freshness(_stream(spark, sf_dir)), scratch.shared_dir(spark, "stream"), "pixel_id")


@query(f"WITH c AS (SELECT pixel_id, k, max(ndvi) AS v FROM ({b.BINNED}) GROUP BY ALL), w AS (SELECT max(ts) - INTERVAL 24 HOUR AS mark FROM ({b.OBSERVATIONS}) WHERE ndvi IS NOT NULL) SELECT pixel_id, k, v FROM c CROSS JOIN w WHERE k BETWEEN 0 AND 29 AND TIMESTAMP '{b.EVENT_FIRST}' + to_hours(24 * k + 12) <= mark")
def streaming_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: the composites whose window the watermark has passed, from the file sink."""
    return streaming.append_once(streaming.composites(_stream(spark, sf_dir), b.EVENT_FIRST, 24, b.EVENT_N), scratch.shared_dir(spark, "stream"))


@query(f"SELECT pixel_id, k, max(ndvi) AS v FROM ({b.BINNED}) WHERE k BETWEEN 0 AND 29 GROUP BY ALL")
def streaming_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table read as a stream; the result equals the batch composites."""
    obs = _stream(spark, sf_dir)
    return streaming.run_once(streaming.composites(obs, b.EVENT_FIRST, 24, b.EVENT_N), scratch.shared_dir(spark, "stream"), "pixel_id", "k")


# the two windows of the run: first day, composites up to the day of the run, first observation's bin, regions, periods
_WINDOWS_RUN = (("2026-04-01", 23, 0, "0, 3", ("04", "05", "06", "07", "08", "09", "10")), ("2026-06-01", 17, -6, "1, 4", ("06", "07", "08", "09", "10")))


def _run_sql(first: str, n: int, shift: int, keys: str, months: tuple) -> str:
    start = (dt.date.fromisoformat(first) - dt.date(1970, 1, 1)).days
    days = lambda m: float((dt.date(2026, m, 1) - dt.date(1970, 1, 1)).days)
    spans = ", ".join(f"('2026{m}', {days(int(m))}, {days(int(m) + 1)})" for m in months)
    cycles = phenology.extract_sql(b.run_series(first, n, shift, keys), n, 10, start, MAX)
    return f"SELECT pixel_id, label, {_dominant_sql('a', 'z')} AS growth_stage FROM ({cycles}) CROSS JOIN (VALUES {spans}) p(label, a, z)"


_RUN = f"SELECT r_name AS unit, label, {b.GRID}, growth_stage FROM ({' UNION ALL '.join(_run_sql(*w) for w in _WINDOWS_RUN)}) JOIN customer ON c_custkey = pixel_id JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 3"


def _run(spark: SparkSession, sf_dir: str, **more):
    """A whole periodic run into a scratch folder: the runner and that folder."""
    own = Settings(season="wet", season_year=2026, which="season", median_radius=0, resolution_m=0.01 * 111_320, mosaic_after=False, **more)
    runner = Runner(spark, own, b.run_units(spark, sf_dir), b.run_observations(spark, sf_dir), log=lambda *_: None)
    out = scratch.shared_dir(spark, "run")
    runner.run_periodic(out, as_of=b.RUN_DAY)
    return runner, out


@query(_RUN)
def run_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage maps of all units and periods that are due, each unit over its own window up to the day of the run, as they were stored."""
    _, out = _run(spark, sf_dir)
    return spark.read.schema(STORED).parquet(f"{out}/stages").select("unit", "label", "row", "col", "growth_stage")


@query(f"SELECT unit AS unit_file, label, growth_stage, count(*) AS pixels FROM ({_RUN}) WHERE growth_stage >= 0 GROUP BY ALL")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored summaries of every unit and period."""
    runner, out = _run(spark, sf_dir)
    found = spark.read.option("header", True).csv(f"{out}/summary")
    return found.select(F.translate("unit_file", "_", " ").alias("unit_file"), F.col("label").cast("string").alias("label"), F.col("growth_stage").cast("int").alias("growth_stage"), F.col("pixels").cast("long").alias("pixels"))


@query("SELECT r_name AS name, CASE WHEN r_regionkey = 2 THEN 'out_of_season' WHEN r_regionkey = 3 OR NOT EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) THEN 'no_coverage' ELSE 'success' END AS status FROM region")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log that a whole run stored: one row a unit."""
    _, out = _run(spark, sf_dir)
    return spark.read.option("header", True).option("recursiveFileLookup", True).csv(f"{out}/logs").select("name", "status")


@query(f"SELECT label, row, col, growth_stage FROM ({_RUN}) WHERE growth_stage >= 0")
def run_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of a run joined into one map a period."""
    runner, out = _run(spark, sf_dir)
    at = runner.mosaic(out, as_of=b.RUN_DAY)["outputs"]
    return spark.read.schema("row int, col int, growth_stage smallint, label string").parquet(at).select("label", "row", "col", "growth_stage")


_RECENT_START = 20527  # 2026-03-15, 240 days before the day of the run
_RECENT = phenology.extract_sql(b.run_series("2026-03-15", 25, 2, "0, 1, 2, 4"), 25, 10, _RECENT_START, Phenology(peak_select="last", peak_search=(30, 240)))


@query(f"SELECT r_name AS unit, {b.GRID}, {_stage_sql('20767')} AS growth_stage, CAST(20767 - last_obs AS SMALLINT) AS data_age_days, CAST(qc AS SMALLINT) AS qc FROM ({_RECENT}) JOIN customer ON c_custkey = pixel_id JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def run_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage, data age and quality over the last 240 days, as they were stored."""
    own = Settings(season="wet", season_year=2026, median_radius=0, resolution_m=0.01 * 111_320)
    runner = Runner(spark, own, b.run_units(spark, sf_dir), b.run_observations(spark, sf_dir), log=lambda *_: None)
    at = runner.save_recent(scratch.shared_dir(spark, "run"), as_of=b.RUN_DAY)["outputs"]
    names = ("unit", "row", "col", "growth_stage", "data_age_days", "qc")
    return spark.read.schema("unit string, row int, col int, growth_stage smallint, data_age_days smallint, qc smallint").parquet(at).select(*names)


_CHECK = phenology.extract_sql(b.run_series("2026-04-01", 25, 0, "0, 1, 2, 4"), 25, 10, 20544, MAX)


@query(f"SELECT qc, count(*) AS pixels FROM ({_CHECK}) WHERE pixel_id % 40 < 30 AND pixel_id < 160 GROUP BY qc")
def quick_check_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality outcomes of a box over the season of a planting month."""
    own = Settings(season="wet", season_year=2026, resolution_m=0.01 * 111_320)
    runner = Runner(spark, own, b.run_units(spark, sf_dir), b.run_observations(spark, sf_dir).where(F.col("ts") <= F.lit(b.RUN_DAY).cast("timestamp_ntz")), log=lambda *_: None)
    found = runner.quick_check((0.0, -0.04, 0.3, 0.0), 5, 2026)["qc_counts"]
    codes = {name: code for code, name in QUALITY.items()}
    return spark.createDataFrame([(codes[n], x) for n, x in found.items()], "qc int, pixels long")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phenology_events(spark, sf_dir)
