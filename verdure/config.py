"""Immutable settings.  Values here fix the semantics of the operators."""

from __future__ import annotations

import dataclasses
import datetime as dt
import hashlib
import json
from dataclasses import dataclass, field

from verdure.functions import calendar

#: Metres in a degree of latitude, native cell size, days between composites (fixed values).
METRES_PER_DEGREE, CELL_METRES, COMPOSITE_DAYS = 111_320, 30, 10
#: Stage classes by code; a class starts on the date of its band (fixed values).
STAGES = {0: "no rice cycle detected", 1: "pre-planting / transplanting", 2: "vegetative", 3: "reproductive", 4: "ripening / maturity", 5: "harvested / post-harvest"}
STAGE_STARTS = ((2, "emergence"), (3, "panicle_init"), (4, "peak"), (5, "harvest"))
NO_STAGE, NO_VALUE = -1, -32768
#: Dates of a cycle in their order (fixed values).
DATES = ("plant", "emergence", "tillering", "panicle_init", "heading", "peak", "maturity", "harvest")
#: The season whose planting months a table's column holds (fixed values).
COLUMN_SEASONS = {"Semester_1": "dry", "Semester_2": "wet"}
#: Quality codes (fixed values).
QUALITY = {
    0: "complete cycle",
    1: "ongoing, past peak",
    2: "ongoing, before / at peak (peak not confirmed)",
    10: "too few clear observations",
    11: "no interior peak",
    12: "amplitude too small",
    13: "peak NDVI too low",
    14: "base NDVI too high",
    15: "no rising 15% crossing",
    16: "season length implausible",
}


@dataclass(frozen=True)
class Reflectance:
    """How digital numbers become reflectance, and which observations count."""

    scale: float = 10_000.0
    offset: float = 1000.0
    offset_from: str = "2022-01-25"
    clear_classes: tuple = (4, 5, 6)
    fill: int = -9999
    qa_fill: int = 255
    bad_bits: int = 31
    aerosol_shift: int = 6
    aerosol_high: int = 3
    cropland_class: int = 40
    max_cloud: float = 80.0


@dataclass(frozen=True)
class Phenology:
    """Thresholds of the cycle detection."""

    threshold: float = 0.15
    heading: float = 0.90
    tiller_rule: str = "max_accel"
    tiller_norm: float = 0.30
    base_mode: str = "separate"
    plant_from: str = "smoothed"
    window: int = 5
    order: int = 2
    peak_search: tuple[int, int] = (45, 210)
    peak_select: str = "max"
    pre_peak_days: int = 110
    post_peak_days: int = 90
    min_obs: int = 6
    min_amplitude: float = 0.20
    min_peak: float = 0.50
    max_base: float = 0.45
    season_length: tuple[int, int] = (50, 180)
    peak_confirm: float = 0.10
    min_fall: float = 0.40
    despike_drop: float = 0.15
    despike_neighbour: float = 0.40

    def __post_init__(self):
        for name, allowed in (("tiller_rule", ("max_accel", "norm")), ("base_mode", ("separate", "single")), ("plant_from", ("smoothed", "raw")), ("peak_select", ("max", "last"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")


@dataclass(frozen=True)
class Settings:
    """Everything a run depends on; ``updated`` replaces fields atomically."""

    source: str = "hls"
    season: str = "dry"
    plant_column: str | None = None
    season_year: int | None = None
    fallback_month: int | None = None
    period: str = "monthly"
    which: str = "last_complete"
    classify: str = "dominant"
    composite: str = "max"
    interval_days: int = COMPOSITE_DAYS
    resolution_m: float = CELL_METRES
    tile_deg: float | None = None
    median_radius: int = 1
    majority_radius: int = 0
    level: str = "national"
    exclude: tuple = ()
    lookback_days: int = 240
    save_quality: bool = False
    mosaic_after: bool = True
    label: str | None = None
    prefix: str | None = None
    recent_prefix: str = "products/growth_stage/recent"
    out_dir: str = "outputs"
    targets: str = "local"
    skip_existing: bool = True
    reflectance: Reflectance = field(default_factory=Reflectance)
    phenology: Phenology = field(default_factory=Phenology)

    def __post_init__(self):
        for name, allowed in (("source", ("hls", "s2")), ("season", ("wet", "dry")), ("period", ("monthly", "semimonthly")), ("which", ("season", "current", "last_complete")), ("classify", ("dominant", "midpoint", "midmonth")), ("composite", ("max", "median")), ("level", ("national", "regional", "provincial")), ("targets", ("local", "gdrive", "gcs", "both"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if COLUMN_SEASONS.get(self.plant_column, self.season) != self.season:
            raise ValueError(f"column {self.plant_column} belongs to the {COLUMN_SEASONS[self.plant_column]} season")

    @property
    def column(self) -> str:
        return self.plant_column or next(c for c, s in COLUMN_SEASONS.items() if s == self.season)

    @property
    def tile_degrees(self) -> float:
        return self.tile_deg or (0.25 if self.resolution_m >= 20 else 0.1)

    def year_at(self, day: dt.date) -> int:
        """The season's harvest year, as set or as of a day."""
        return self.season_year or day.year + int(self.season == "dry" and day.month >= calendar.ROLLOVER)

    def planting_year(self, month: int, day: dt.date) -> int:
        return self.year_at(day) - int(self.season == "dry" and month >= calendar.ROLLOVER)

    def name_at(self, day: dt.date) -> str:
        return self.label or f"{self.season}{self.year_at(day)}"

    def prefix_at(self, day: dt.date) -> str:
        return self.prefix or f"products/growth_stage/{self.year_at(day)}/{self.season}"

    def summary(self, day: dt.date) -> dict:
        start, end = calendar.window(self.fallback, self.planting_year(self.fallback, day))
        return {"season": self.season, "season_year": self.year_at(day), "label": self.name_at(day), "planting_month_column": self.column, "fallback_planting_month": self.fallback, "window_for_fallback_month": f"{start}..{end}", "output_prefix": self.prefix_at(day)}

    @property
    def fallback(self) -> int:
        return self.fallback_month or {"wet": 6, "dry": 12}[self.season]

    @property
    def grid_degrees(self) -> float:
        return self.resolution_m / METRES_PER_DEGREE

    def updated(self, **changes) -> Settings:
        """A copy with other values; a season and its column follow each other unless both are given."""
        names = {f.name for f in dataclasses.fields(self)}
        if unknown := sorted(set(changes) - names):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        if isinstance(changes.get("phenology"), dict):
            changes["phenology"] = dataclasses.replace(self.phenology, **changes["phenology"])
        if "season" in changes and "plant_column" not in changes:
            changes["plant_column"] = None
        elif changes.get("plant_column") in COLUMN_SEASONS and "season" not in changes:
            changes["season"] = COLUMN_SEASONS[changes["plant_column"]]
        return dataclasses.replace(self, **changes)

    def public(self) -> dict:
        return dataclasses.asdict(self)

    def key(self) -> str:
        """Ten hex digits that name these settings."""
        return hashlib.md5(json.dumps(self.public(), sort_keys=True, default=str).encode(), usedforsecurity=False).hexdigest()[:10]
