import datetime as dt
import math
from dataclasses import replace

import numpy as np
import pytest

from verdure.config import DATES, Phenology
from verdure.operators import phenology, series, stages

EPOCH = dt.date(1970, 1, 1)


def days(d: str) -> int:
    return (dt.date.fromisoformat(d) - EPOCH).days


def frame(spark, values: dict, first: int, step: int = 10):
    rows = [(p, k, first + step * k, None if v is None or math.isnan(v) else float(v)) for p, vs in values.items() for k, v in enumerate(vs)]
    return spark.createDataFrame(rows, "pixel_id long, k int, t int, v double")


def dates(first: str, last: str) -> list[int]:
    return list(range(days(first), days(last) + 1, 10))


def bell(t, centre, width=25.0, base=0.15, amp=0.7):
    return base + amp * math.exp(-0.5 * ((t - centre) / width) ** 2)


def run(spark, values, ts, config=None):
    return {r["pixel_id"]: r for r in phenology.extract(frame(spark, values, ts[0]), len(ts), 10, ts[0], config).collect()}


def test_single_season(spark):
    ts = dates("2025-11-01", "2026-06-30")
    out = phenology.extract(frame(spark, {1: [bell(t, days("2026-02-15")) for t in ts]}, ts[0]), len(ts), 10, ts[0])
    r = out.head()
    found = [r[d] for d in DATES if r[d] is not None]
    assert r["qc"] == 0 and found == sorted(found) and len(found) == 8
    assert abs(r["peak"] - days("2026-02-15")) <= 6 and 50 <= r["season_length"] <= 180
    recent = stages.recent(out, "2026-07-10").head()
    assert recent["data_age_days"] == days("2026-07-10") - ts[-1] and recent["growth_stage"] == 5


def two_crops(t: int) -> float:
    r = t - days("2026-01-25")
    return bell(t, days("2025-10-15")) + (0.6 / (1 + math.exp(-(r - 45) / 9)) if r > 0 else 0)


def test_last_or_highest_cycle(spark):
    ts = dates("2025-07-23", "2026-03-20")
    s = {1: [two_crops(t) for t in ts]}
    for select, stage in (("last", 2), ("max", 5)):
        c = Phenology(peak_search=(30, 240), peak_select=select)
        out = phenology.extract(frame(spark, s, ts[0]), len(ts), 10, ts[0], c)
        assert out.select(stages.stage_at(__import__("pyspark").sql.functions.lit(days("2026-03-20")))).head()[0] == stage


DRAWN = {
    "high_end": "05-01 .37, 05-20 .59, 06-20 .65, 07-10 .37, 08-01 .50, 09-01 .72, 09-20 .81, 09-28 .77",
    "full": "05-01 .23, 05-20 .22, 06-01 .24, 07-10 .72, 07-31 .85, 08-31 .77, 09-20 .71, 09-28 .44",
    "early": "05-01 .21, 05-10 .27, 06-01 .55, 06-21 .73, 07-21 .67, 09-20 .54, 09-28 .46",
}


def test_hand_drawn(spark):
    ts = dates("2026-05-01", "2026-12-31")
    values = {}
    for i, text in enumerate(DRAWN.values()):
        points = [(days("2026-" + p.split()[0]), float(p.split()[1])) for p in text.split(", ")]
        values[i] = [float(np.interp(t, *zip(*points, strict=True))) if t <= days("2026-09-28") else None for t in ts]
    r = run(spark, values, ts)
    assert r[0]["qc"] == 2 and r[0]["emergence"] is not None
    assert [r[0][d] for d in ("heading", "peak", "maturity", "harvest")] == [None] * 4
    full = [r[1][d] for d in DATES if d != "tillering"]
    assert r[1]["qc"] == 0 and None not in full and full == sorted(full)
    assert r[2]["plant"] is None and r[2]["emergence"] is not None and r[2]["peak"] is not None


@pytest.mark.parametrize("config", [Phenology(), Phenology(base_mode="single", plant_from="raw", tiller_rule="norm"), Phenology(peak_select="last", peak_search=(30, 240))])
def test_dates_never_decrease(spark, config):
    rng, ts = np.random.default_rng(0), dates("2026-05-01", "2026-12-31")
    values = {i: [bell(t, days("2026-07-25"), 22, 0.2, 0.6) + rng.normal(0, 0.06) if rng.random() > 0.3 else None for t in ts] for i in range(400)}
    seen = 0
    for r in run(spark, values, ts, config).values():
        found = [r[d] for d in DATES if r[d] is not None]
        assert found == sorted(found)
        seen += r["qc"] < 10
    assert seen > 100


def smooth_by_hand(v):
    x = np.array([np.nan if a is None else a for a in v], float)
    n, k = len(x), np.arange(len(x))
    fill = lambda y: np.interp(k, k[~np.isnan(y)], y[~np.isnan(y)])
    f, d = fill(x), x.copy()
    for i in range(1, n - 1):
        if min(f[i - 1], f[i + 1]) > 0.4 and f[i] < (f[i - 1] + f[i + 1]) / 2 - 0.15:
            d[i] = np.nan
    f = fill(d)
    out = [np.polyval(np.polyfit(np.arange(5), f[max(0, min(n - 5, i - 2)) :][:5], 2), i - max(0, min(n - 5, i - 2))) for i in range(n)]
    return f, np.array(out)


def test_cleaning_against_plain_code(spark):
    rng = np.random.default_rng(1)
    values = {i: [float(rng.random()) if rng.random() > 0.25 else None for _ in range(20)] for i in range(40)}
    got = {}
    for r in series.smooth_series(frame(spark, values, 0), 20, replace(Phenology(), min_obs=1)).collect():
        got[r["pixel_id"], r["k"]] = r
    for p, v in values.items():
        f, s = smooth_by_hand(v)
        assert np.allclose([got[p, k]["f"] for k in range(20)], f) and np.allclose([got[p, k]["s"] for k in range(20)], s)


def test_too_few_observations_and_short_series(spark):
    ts = dates("2026-05-01", "2026-12-31")
    r = run(spark, {1: [0.5] * 5 + [None] * (len(ts) - 5), 2: [None] * len(ts)}, ts)
    assert r[1]["qc"] == 10 and r[1]["last_obs"] == ts[4] and r[2]["qc"] == 10 and r[2]["last_obs"] is None
    short = frame(spark, {1: [0.1, 0.2, 0.3]}, 0)
    assert {x["s"] for x in series.smooth_series(short, 3).collect()} == {None}


def test_month_equals_period_and_ties(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(1, 0, 20490.0, 20499.0, None, None)], "pixel_id int, qc int, emergence double, panicle_init double, peak double, harvest double")
    a = F.lit(days("2026-02-01"))
    z = F.lit(days("2026-03-01"))
    got = row.select(stages.stage_in_month("2026-02"), stages.stage_over(a, z), stages.stage_over(F.lit(20481), F.lit(20508)), stages.stage_in_month("2026-02", "midmonth")).head()
    assert got[0] == got[1] and got[2] == 3 and got[3] == 3
