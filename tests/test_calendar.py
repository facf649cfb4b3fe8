import datetime as dt

import pytest
from pyspark.sql import functions as F

from verdure.functions import calendar as c
from verdure.operators import composite, grid

D = dt.date


@pytest.mark.parametrize("raw,month", [("5", 5), ("5.0", 5), ("05", 5), (" May", 5), ("MAY", 5), ("5-6", 5), ("May-June", 5), ("June", 6), ("12.0", 12), ("Sept", 9), ("0", None), (None, None), ("NaN", None), ("n/a", None), ("13", None)])
def test_parse_month(spark, raw, month):
    assert spark.createDataFrame([(raw,)], "raw string").select(c.parse_month(F.col("raw"))).head()[0] == month


def one(spark, *cols):
    return spark.range(1).select(*cols).head()


def test_season_windows(spark):
    for season, year, month, start, end in (("wet", 2026, 6, D(2026, 5, 1), D(2026, 12, 31)), ("dry", 2026, 11, D(2025, 10, 1), D(2026, 5, 31)), ("dry", 2026, 12, D(2025, 11, 1), D(2026, 6, 30)), ("dry", 2026, 1, D(2025, 12, 1), D(2026, 7, 31))):
        own = c.planting_year(F.lit(year), F.lit(month), season)
        assert tuple(one(spark, c.season_start(F.lit(month), own), c.season_end(F.lit(month), own))) == (start, end)
    day = F.lit("2026-10-02").cast("date")
    assert tuple(one(spark, c.default_season_year(day, "dry"), c.default_season_year(day, "wet"))) == (2027, 2026)


def test_periods(spark):
    d = lambda s: F.lit(s).cast("date")
    label = lambda s, p: c.period_label(c.period_start(d(s), p), p)
    assert tuple(one(spark, label("2026-02-10", "semimonthly"), label("2026-02-16", "semimonthly"))) == ("202602H1", "202602H2")
    last = lambda s, p: c.period_label(c.last_complete(d(s), p), p)
    assert tuple(one(spark, last("2026-03-01", "monthly"), last("2026-02-28", "monthly"), last("2026-02-16", "semimonthly"))) == ("202602", "202602", "202602H1")  # a period is complete on its last day
    months = one(spark, c.periods_between(d("2025-11-01"), d("2026-01-31")), c.periods_between(d("2025-11-01"), d("2026-06-30"), "semimonthly"))
    assert [x.strftime("%Y%m") for x in months[0]] == ["202511", "202512", "202601"]
    assert len(months[1]) == 16


def test_anchors_and_tiles(spark):
    d = lambda s: F.lit(s).cast("date")
    row = one(spark, composite.anchors(d("2025-11-01"), d("2026-06-30"), 5), composite.anchors(d("2026-01-01"), d("2026-03-28"), 10, "end"))
    assert len(row[0]) == 49 and row[1][-1] == D(2026, 3, 28) and row[1][0] >= D(2026, 1, 1)
    assert len(grid.tiles((120, 10, 120.5, 10.5), 0.1)) == 25
    w, n, cols, rows = grid.snapped((120.004, 10.0, 120.0505, 10.03), 0.01)
    assert (round(w, 6), round(n, 6), cols, rows) == (120.0, 10.03, 6, 3)
