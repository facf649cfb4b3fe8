"""Periodic and recent runs, their plans, outputs, mosaics and logs.

All units and periods of a run are one DataFrame plan: cycles once for each
distinct season window, stages for every period by the small calendar, one
partitioned write, one aggregation of areas.  Finished (unit, period) pairs are left out by an anti join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure.config import DATES, NO_STAGE, NO_VALUE, QUALITY, STAGES, Phenology, Settings
from verdure.functions import calendar
from verdure.functions.text import file_name, name_key
from verdure.operators import admin, composite, focal, grid, phenology, stages, summary


def _day(s: str | None) -> str:
    return str(dt.date.fromisoformat(s)) if s else str(dt.datetime.now(dt.UTC).date())


#: Columns of the stored stages.
STORED = "unit string, row int, col int, growth_stage smallint, label string, unit_file string"


class Runner:
    """Holds settings, unit tables and a folder of outputs.

    ``units``: (name, region, planting_month_raw), one row a unit or several.
    ``obs``: (row, col, unit, ts, ndvi) observations on cropland.
    ``places``: (name, w, s, e, n) boxes of small areas that recent runs can name.
    """

    def __init__(self, spark: SparkSession, settings: Settings, units: DataFrame, obs: DataFrame, log: Callable[[str], None] = print, places: DataFrame | None = None):
        self.spark, self.settings, self.units, self.obs, self.log = spark, settings, units, obs, log
        self.places = places
        self.last: dict | None = None

    # settings and areas
    def update(self, **changes) -> Settings:
        """All changes or, if one is not allowed, none."""
        self.settings = self.settings.updated(**changes)
        return self.settings

    def select(self, level: str | None = None, names: list[str] = ()) -> DataFrame:
        c = self.settings
        return admin.select_units(self.units, level or c.level, list(names), list(c.exclude))

    def areas(self, kind: str = "name", region: str | None = None, contains: str | None = None) -> DataFrame:
        if kind == "place":
            return admin.list_areas(self.places, "name", None, contains)
        return admin.list_areas(self.units, kind, region, contains)

    def known(self, names: list[str]) -> dict[str, tuple | None]:
        """The given names that exist: places with their boxes, units with None."""
        wanted = [n.strip().upper() for n in names]
        found: dict[str, tuple | None] = {r["name"]: None for r in self.units.where(name_key(F.col("name")).isin(wanted)).select("name").distinct().collect()}
        if self.places is not None:
            found |= {r["name"]: (r["w"], r["s"], r["e"], r["n"]) for r in self.places.where(name_key(F.col("name")).isin(wanted)).collect()}
        return found

    def window_for(self, month: int, as_of: str | None = None) -> tuple[dt.date, dt.date]:
        """First and last day of the season that a planting month gives."""
        return calendar.window(month, self.settings.planting_year(month, dt.date.fromisoformat(_day(as_of))))

    def plan(self, level: str | None = None, names: list[str] = (), as_of: str | None = None) -> DataFrame:
        """Units and periods that a run would make; touches no observation."""
        c, day = self.settings, _day(as_of)
        return admin.unit_periods(self.windows(level, names, day), day, c.which, c.period)

    def windows(self, level: str | None = None, names: list[str] = (), as_of: str | None = None) -> DataFrame:
        """Every selected unit with its season window, in or out of season."""
        c, day = self.settings, dt.date.fromisoformat(_day(as_of))
        return admin.season_windows(admin.planting(self.select(level, names), c.fallback, c.season), c.year_at(day), c.season)

    def plan_totals(self, plan: DataFrame, level: str | None = None, names: list[str] = (), as_of: str | None = None) -> dict:
        """Totals of a plan, and of all selected units if their number is asked for by ``level`` or ``names``; tiles are those of the units' cells."""
        c, day = self.settings, dt.date.fromisoformat(_day(as_of))
        row = plan.agg(F.count_distinct("name").alias("units_in_season"), F.count("*").alias("periods"), F.min("season_start").alias("first"), F.max("season_end").alias("last")).head()
        planted = admin.planting(self.select(level, names), c.fallback, c.season)
        notes = planted.where((F.size("rare") > 0) | (F.coalesce("unparsed", F.lit(0)) > 0) | (F.size("atypical") > 0))
        cells = max(1, round(c.tile_degrees / c.grid_degrees))
        tiles = self.obs.join(plan.select(F.col("name").alias("unit")).distinct(), "unit", "left_semi").select(F.floor(F.col("row") / cells), F.floor(F.col("col") / cells)).distinct()
        totals = {k: str(v) if isinstance(v, dt.date) else v for k, v in row.asDict().items()}
        return totals | {"units": planted.count(), "notes": notes.count(), "tiles": tiles.count(), "tile_deg": c.tile_degrees, "source": c.source, "period": c.period, "which": c.which, **c.summary(day)}

    # the pipeline
    def cycles(self, obs: DataFrame, start: str, end: str, config: Phenology | None = None, align: str = "start") -> DataFrame:
        """Cycle dates of every pixel that was seen, on the anchor grid of a window."""
        c = self.settings
        days = (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days
        n = days // c.interval_days + 1
        first = dt.date.fromisoformat(start) + dt.timedelta(days=days % c.interval_days if align == "end" else 0)
        pixel = F.struct("unit", "row", "col")
        rows = obs.select(pixel.alias("pixel_id"), "ts", "ndvi")
        if c.composite == "max":
            series = composite.dense(rows, str(first), c.interval_days, n)
        else:
            made = composite.composite(rows, str(first), c.interval_days, n, c.composite)
            t = F.unix_date(F.lit(str(first)).cast("date")) + F.col("k") * c.interval_days
            bins = made.select("pixel_id").distinct().select("pixel_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
            series = bins.join(made, ["pixel_id", "k"], "left").select("pixel_id", "k", t.alias("t"), "v")
        start_day = (dt.date.fromisoformat(start) - dt.date(1970, 1, 1)).days
        out = phenology.extract(series, n, c.interval_days, start_day, config or c.phenology)
        return out.select(F.col("pixel_id.unit").alias("unit"), F.col("pixel_id.row").alias("row"), F.col("pixel_id.col").alias("col"), *out.columns[1:])

    def smoothed(self, cycles: DataFrame) -> DataFrame:
        """Date medians over neighbours of the same unit on the whole grid."""
        radius = self.settings.median_radius
        if radius < 1:
            return cycles
        dates = list(DATES)
        kept = [c for c in cycles.columns if c not in dates and c != "season_length"]
        return cycles.select(*kept).join(focal.smooth_dates(cycles.select("unit", "row", "col", *dates), dates, radius, ("unit",)), ["unit", "row", "col"])

    def stages(self, cycles: DataFrame, due: DataFrame) -> DataFrame:
        """(unit, label, row, col, growth_stage) of all due periods (name, label, p_start, p_end)."""
        c = self.settings
        rows = cycles.join(due.select(F.col("name").alias("unit"), "label", "p_start", "p_end"), "unit")
        rows = rows.select("unit", "label", "row", "col", stages.stage_over(F.unix_date("p_start"), F.unix_date("p_end"), c.classify).alias("growth_stage"))
        if c.majority_radius < 1:
            return rows
        return focal.majority(rows, "growth_stage", c.majority_radius, NO_STAGE, ("unit", "label")).withColumn("growth_stage", F.col("growth_stage").cast("smallint"))

    def _areas(self, stage_rows: DataFrame, by: list[str]) -> DataFrame:
        res = self.settings.grid_degrees
        cells = stage_rows.withColumn("ha", grid.cell_area_ha(-(F.col("row") + 0.5) * res, res))
        return summary.shares(summary.counts(cells, by), by)

    def cycles_of(self, due: DataFrame, day: str) -> DataFrame:
        """Smoothed cycles of every due unit over its own window (name, season_start, season_end), up to the day.

        The few distinct windows, as planting months make them, become branches of one plan.
        """
        own = due.select(F.col("name").alias("unit"), "season_start", F.least("season_end", F.lit(day).cast("date")).alias("season_end")).distinct()
        obs = self.obs.where(F.to_date("ts") <= F.lit(day).cast("date"))
        parts = []
        for a, z in own.select("season_start", "season_end").distinct().orderBy("season_start", "season_end").collect():
            units = own.where((F.col("season_start") == F.lit(a)) & (F.col("season_end") == F.lit(z))).select("unit")
            parts.append(self.cycles(obs.join(units, "unit", "left_semi"), str(a), str(z)))
        return self.smoothed(reduce(DataFrame.unionByName, parts))

    def run_periodic(self, out_dir: str, level: str | None = None, names: list[str] = (), as_of: str | None = None, only: list[str] = (), start_from: str | None = None, skip_existing: bool | None = None, mosaic: bool | None = None) -> dict:
        """Runs all units and periods that are due and not saved; returns paths, outcome counts and, after a run of several units, the mosaic.

        Below ``out_dir``: ``stages`` and ``summary`` by period and unit, the ``manifest`` of
        what was made (with a reason where a unit had no cell), ``quality`` and ``logs``.
        """
        c, day = self.settings, _day(as_of)
        every = self.windows(level, names, day).select("name").distinct()
        if only:
            every = every.where(name_key(F.col("name")).isin([n.strip().upper() for n in only]))
        if start_from:
            if every.where(name_key(F.col("name")) == start_from.strip().upper()).isEmpty():
                raise admin.UnknownNames(f"{start_from} is not in the selection")
            every = every.where(name_key(F.col("name")) >= start_from.strip().upper())
        plan = self.plan(level, names, day).join(every, "name", "left_semi").select("name", "season_start", "season_end", "label", "p_start", "p_end")
        skip = c.skip_existing if skip_existing is None else skip_existing
        saved = self.saved(out_dir) if skip else None
        due = (plan if saved is None else admin.missing(plan, saved)).cache()
        try:
            status = F.when(F.col("planned").isNull(), "out_of_season").when(F.col("due").isNull(), "skipped")
            log = every.join(plan.select("name", F.lit(1).alias("planned")).distinct(), "name", "left").join(due.select("name", F.lit(1).alias("due")).distinct(), "name", "left")
            if due.isEmpty():
                log = log.select("name", status.alias("status"), F.lit(None).cast("string").alias("error"))
            else:
                try:
                    seen = self._make(due, day, out_dir)
                    log = log.join(seen.where("pixels > 0").select("name", F.lit(1).alias("seen")).distinct(), "name", "left")
                    log = log.select("name", status.when(F.col("seen").isNull(), "no_coverage").otherwise("success").alias("status"), F.lit(None).cast("string").alias("error"))
                except Exception as e:  # noqa: BLE001  reported for the units that were due, like any other outcome
                    self.log(f"periodic run: {e!r}"[:2000])
                    log = log.select("name", status.otherwise("failed").alias("status"), F.when(F.col("due").isNotNull(), F.lit(repr(e)[:500])).alias("error"))
            log = self._save_log(log, out_dir, "periodic")
            counts = {r["status"]: r["n"] for r in log.groupBy("status").agg(F.count("*").alias("n")).collect()}
        finally:
            due.unpersist()
        self.last = {"kind": "periodic", "as_of": day, "outputs": out_dir, "outcomes": counts}
        if (c.mosaic_after if mosaic is None else mosaic) and not only and sum(counts.values()) > 1 and counts.keys() & {"success", "skipped"}:
            try:
                self.last["mosaic"] = self.mosaic(out_dir, level, names, day)
            except Exception as e:  # noqa: BLE001  the maps are saved
                self.last["mosaic"] = {"error": repr(e)[:500]}
        return self.last

    def _make(self, due: DataFrame, day: str, out_dir: str) -> DataFrame:
        """Writes stages, summaries and the manifest of the due units and periods; returns the new manifest rows."""
        c = self.settings
        cycles = self.cycles_of(due, day)
        rows = self.stages(cycles, due).withColumn("unit_file", file_name(F.col("unit")))
        told = {"classes": "; ".join(f"{k}={v}" for k, v in STAGES.items()), "method": c.classify, "source": c.source, "season": c.name_at(dt.date.fromisoformat(day)), "nodata": NO_STAGE}
        rows = rows.withColumn("growth_stage", F.col("growth_stage").alias("growth_stage", metadata=told))
        # dealt anew, so that the sorts of the windows and of the writer don't share a task's memory
        rows.repartition("label", "unit_file", "row").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label", "unit_file").parquet(f"{out_dir}/stages")
        if c.save_quality:
            year = c.planting_year({"wet": 6, "dry": 12}[c.season], dt.date.fromisoformat(day))
            coded = stages.encoded(cycles.withColumn("pixel_id", F.struct("unit", "row", "col")).drop("unit", "row", "col"), year)
            coded.select(file_name(F.col("pixel_id.unit")).alias("unit_file"), "*").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unit_file").parquet(f"{out_dir}/quality-{year}")
        # only the partitions just written are read again
        own = due.select("name", "label", file_name(F.col("name")).alias("unit_file"))
        made = self.spark.read.schema(STORED).parquet(f"{out_dir}/stages").join(own.select("label", "unit_file"), ["label", "unit_file"], "left_semi")
        areas = self._areas(made, ["label", "unit_file"])
        areas.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("label", "unit_file").csv(f"{out_dir}/summary")
        pixels = made.groupBy("label", "unit_file").agg(F.count("*").alias("pixels"))
        seen = own.join(pixels, ["label", "unit_file"], "left").select("name", "label", F.coalesce("pixels", F.lit(0)).alias("pixels"), F.when(F.col("pixels").isNull(), "no_coverage").alias("reason"), F.lit(day).alias("as_of"))
        run = f"{out_dir}/manifest/run={dt.datetime.now(dt.UTC).strftime('%Y%m%dT%H%M%S%f')}"
        seen.coalesce(1).write.mode("overwrite").parquet(run)  # one row a unit and period
        return self.spark.read.parquet(run)

    def saved(self, out_dir: str) -> DataFrame | None:
        """(name, label) pairs with stored stages, from the manifest."""
        try:
            return self.spark.read.parquet(f"{out_dir}/manifest").where("pixels > 0").select("name", "label").distinct()
        except Exception as e:  # nothing stored yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
                return None
            raise

    def _save_log(self, log: DataFrame, out_dir: str, kind: str) -> DataFrame:
        """Stores one row a unit and reads it back; where that fails, the run does not."""
        try:
            path = f"{out_dir}/logs/{kind}_{dt.datetime.now(dt.UTC).strftime('%Y%m%dT%H%M%S%f')}"
            log.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
            return self.spark.read.schema(log.schema).csv(path, header=True)
        except Exception as e:  # noqa: BLE001
            self.log(f"the run log was not saved: {e}")
            return log

    def mosaic(self, out_dir: str, level: str | None = None, names: list[str] = (), as_of: str | None = None, periods: list[str] = ()) -> dict:
        """Joins the stored units of every period: the first unit with data wins a cell; lists what is missing."""
        plan = self.plan(level, names, as_of).select("name", "label")
        if periods:  # labels of other periods, for all selected units
            units = self.windows(level, names, as_of).select("name").distinct()
            plan = units.select("name", F.explode(F.array(*map(F.lit, periods))).alias("label"))
        saved = self.saved(out_dir)
        missing = admin.missing(plan, saved) if saved is not None else plan
        rows = self.spark.read.schema(STORED).parquet(f"{out_dir}/stages")
        rows = rows.join(plan.select(F.col("name").alias("unit"), "label"), ["unit", "label"], "left_semi").where("growth_stage >= 0")
        best = rows.groupBy("label", "row", "col").agg(F.min(F.struct("unit", "growth_stage")).alias("s")).select("label", "row", "col", F.col("s.growth_stage").alias("growth_stage"))
        best.write.mode("overwrite").partitionBy("label").parquet(f"{out_dir}/mosaic")
        made = self.spark.read.parquet(f"{out_dir}/mosaic").withColumn("label", F.col("label").cast("string"))
        self._areas(made, ["label"]).write.mode("overwrite").option("header", True).csv(f"{out_dir}/mosaic-summary")
        lack = {r["label"]: r["names"] for r in missing.groupBy("label").agg(F.sort_array(F.collect_list("name")).alias("names")).collect()}
        return {"outputs": f"{out_dir}/mosaic", "missing": lack}

    def in_box(self, bbox: tuple[float, float, float, float]) -> DataFrame:
        """Observations of the cells that share area with a box, by ranges of row and column that reach the scan."""
        res = self.settings.grid_degrees
        west, north, cols, rows = grid.snapped(bbox, res)
        left, top = round(west / res), round(-north / res)
        return self.obs.where(F.col("col").between(left, left + cols - 1) & F.col("row").between(top, top + rows - 1))

    def run_recent(self, names: list[str] = (), as_of: str | None = None, lookback_days: int | None = None, bbox: tuple | None = None) -> DataFrame:
        """Stage, data age and quality on a date from a rolling window that ends on it; always the latest cycle.

        Over whole units, the boxes of named places, or a box, which then is the unit's name.
        """
        c, day = self.settings, _day(as_of)
        back = lookback_days or c.lookback_days
        start = str(dt.date.fromisoformat(day) - dt.timedelta(days=back))
        boxes = {n: b for n, b in self.known(names).items() if b} if names else {}
        if bbox is not None:
            boxes["BBOX_" + "_".join(f"{v:.3f}" for v in bbox)] = bbox
        parts = [self.in_box(b).withColumn("unit", F.lit(n)) for n, b in boxes.items()]
        if units := [n for n in names if n not in boxes]:
            parts.append(self.obs.where(F.col("unit").isin(units)))
        obs = reduce(DataFrame.unionByName, parts) if parts else self.obs
        config = replace(c.phenology, peak_select="last", peak_search=(30, back))
        cycles = self.smoothed(self.cycles(obs.where(F.to_date("ts") <= F.lit(day).cast("date")), start, day, config, align="end"))
        at = F.unix_date(F.lit(day).cast("date"))
        return cycles.select("unit", "row", "col", stages.stage_at(at).alias("growth_stage"), (at - F.col("last_obs")).alias("data_age_days"), "qc")

    def save_recent(self, out_dir: str, names: list[str] = (), as_of: str | None = None, lookback_days: int | None = None, bbox: tuple | None = None) -> dict:
        """Runs and stores the recent stages by area and day as small whole numbers, with areas and a log."""
        day, base = _day(as_of), f"{out_dir}/{self.settings.recent_prefix}"
        asked = [*names, *(["BBOX_" + "_".join(f"{v:.3f}" for v in bbox)] if bbox is not None else [])]
        pack = lambda c: F.coalesce(F.least(F.greatest(F.bround(F.col(c).cast("double")), F.lit(-32767.0)), F.lit(32767.0)), F.lit(float(NO_VALUE))).cast("smallint").alias(c)
        rows = self.run_recent(names, as_of, lookback_days, bbox)
        rows = rows.select(file_name(F.col("unit")).alias("unit_file"), F.lit(day.replace("-", "")).alias("day"), "unit", "row", "col", pack("growth_stage"), pack("data_age_days"), pack("qc"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "unit_file").parquet(f"{base}/stages")
        made = self.spark.read.parquet(f"{base}/stages").withColumn("day", F.col("day").cast("string")).where((F.col("day") == day.replace("-", "")) & (F.col("unit").isin(asked) if asked else F.lit(True)))
        areas, ages = self.recent_summary(made.withColumn("data_age_days", F.when(F.col("data_age_days") != NO_VALUE, F.col("data_age_days"))))
        areas.write.mode("overwrite").option("header", True).csv(f"{base}/summary/{day}")
        seen = {r["unit"]: r["median_age"] for r in ages.collect()}  # one row an area
        log = self.spark.createDataFrame([(n, "success" if n in seen else "no_coverage") for n in asked or seen], "name string, status string")
        self._save_log(log, base, "recent")
        self.last = {"kind": "recent", "as_of": day, "outputs": f"{base}/stages", "success": sorted(seen), "no_coverage": sorted(set(asked) - set(seen)), "median_age": seen, "areas": [r.asDict() for r in areas.orderBy("unit", "growth_stage").limit(300).collect()]}
        return self.last

    def recent_summary(self, recent: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Areas per unit and stage, and the median data age per unit."""
        return self._areas(recent, ["unit"]), recent.groupBy("unit").agg(F.median("data_age_days").alias("median_age"))

    def quick_check(self, bbox: tuple[float, float, float, float], planting_month: int | None = None, year: int | None = None) -> dict:
        """Quality outcomes of a box over the season of a planting month (by default the fallback's), planted in a year."""
        month = planting_month or self.settings.fallback
        start, end = calendar.window(month, year) if year else self.window_for(month)
        found = {r["qc"]: r["pixels"] for r in summary.quality_histogram(self.cycles(self.in_box(bbox), str(start), str(end))).collect()}  # one row a code
        if not found:
            return {"status": "no observations on cropland in the box"}
        return {"crop_pixels": sum(found.values()), "cycle_pixels": sum(n for q, n in found.items() if q < 10), "qc_counts": {QUALITY[q]: n for q, n in sorted(found.items())}}

    def list_outputs(self, store, kind: str = "", contains: str = "", limit: int = 60) -> list[str]:
        """The last names that match."""
        return [n for n in store.list(kind) if contains.lower() in n.lower()][-limit:]

    def read_summary(self, path: str) -> list[dict]:
        return [r.asDict() for r in self.spark.read.csv(path, header=True, inferSchema=True).collect()]


def per_tile(obs: DataFrame, tile_cells: int, fn, schema) -> DataFrame:
    """A user function on the rows of each tile: fn(pandas frame) -> pandas frame."""
    tile = lambda c: F.floor(F.col(c) / tile_cells)
    return obs.withColumns({"tile_x": tile("col"), "tile_y": tile("row")}).groupBy("tile_x", "tile_y").applyInPandas(fn, schema)
