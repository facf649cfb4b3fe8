import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.config import Reflectance
from verdure.functions import masks
from verdure.operators import focal, grid, summary
from verdure.sources import catalog


def test_masks(spark):
    rows = spark.createDataFrame([(1500, 4000, 4, "2025-01-01 00:00:00"), (1500, 4000, 9, "2025-01-01 00:00:00"), (0, 4000, 4, "2025-01-01 00:00:00"), (1500, 4000, 4, "2021-01-01 00:00:00")], "red int, nir int, cls int, ts string")
    got = rows.select(masks.ndvi_from_classes(F.col("red"), F.col("nir"), F.col("cls"), F.col("ts").cast("timestamp_ntz"), Reflectance())).collect()
    assert got[0][0] == pytest.approx(0.25 / 0.35) and got[1][0] is None and got[2][0] is None and got[3][0] == pytest.approx(0.25 / 0.55)
    red, nir, qa = [500] * 5 + [-9999, 500, 300], [3000] * 7 + [200], [0, 2, 8, 4, 192, 0, 255, 32]
    rows = spark.createDataFrame(list(zip(range(8), red, nir, qa, strict=True)), "i int, red int, nir int, qa int").orderBy("i")
    got = [r[0] for r in rows.select(masks.ndvi_from_bits(F.col("red"), F.col("nir"), F.col("qa"), Reflectance())).collect()]
    assert got[0] == pytest.approx(2500 / 3500) and got[1:7] == [None] * 6 and got[7] == pytest.approx(-0.2)


def cells(spark, a, names="row int, col int, v double"):
    return spark.createDataFrame([(r, c, None if np.isnan(a[r, c]) else a[r, c].item()) for r in range(a.shape[0]) for c in range(a.shape[1])], names)


@pytest.mark.parametrize("radius", [1, 2])
def test_focal_median(spark, radius):
    rng = np.random.default_rng(2)
    a = rng.random((7, 9))
    a[rng.random(a.shape) < 0.3] = np.nan
    got = {(r["row"], r["col"]): r["v"] for r in focal.median(cells(spark, a), ["v"], radius).collect()}
    assert len(got) == a.size
    for (r, c), v in got.items():
        near = a[max(0, r - radius) : r + radius + 1, max(0, c - radius) : c + radius + 1]
        assert v is None if np.isnan(a[r, c]) else v == pytest.approx(np.nanmedian(near))


def test_majority(spark):
    rows = [(0, 0, 2), (0, 1, 1), (0, 2, -1), (1, 0, 2), (1, 1, 1), (1, 2, 1)]
    got = {(r["row"], r["col"]): r["g"] for r in focal.majority(spark.createDataFrame(rows, "row int, col int, g int"), "g").collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (0, 2): -1, (1, 0): 1, (1, 1): 1, (1, 2): 1}


def test_first_valid_and_two_bands(spark):
    rows = [(0, 0, 0, -32768, 7), (0, 0, 1, 9, 9), (0, 1, 0, -32768, -32768), (0, 1, 1, 9, 9)]
    got = {(r["row"], r["col"]): (r["a"], r["b"]) for r in focal.first_valid(spark.createDataFrame(rows, "row int, col int, i int, a int, b int"), "i", ["a", "b"], -32768).collect()}
    assert got == {(0, 0): (-32768, 7), (0, 1): (9, 9)}


def test_areas(spark):
    stage = np.full((200, 200), 2.0)
    stage[:50], stage[:, :10] = 3, -1
    rows = cells(spark, stage, "row int, col int, growth_stage double").withColumn("growth_stage", F.col("growth_stage").cast("int")).withColumn("ha", F.lit(0.09))
    got = {r["growth_stage"]: (r["pixels"], r["share_pct"]) for r in summary.shares(summary.counts(rows, []), []).collect()}
    assert got == {2: (28500, 75.0), 3: (9500, 25.0)}


def test_polygons(spark):
    all_cells = spark.range(100).select((F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"))
    triangle = [(0.5, -0.5), (4.5, -0.5), (0.5, -4.5)]
    got = {(r["row"], r["col"]) for r in grid.clip(all_cells, [triangle], 1.0).collect()}
    assert got == {(r, c) for r in range(5) for c in range(5) if r + c <= 4}
    tiny = [(7.2, -7.2), (7.3, -7.2), (7.3, -7.3)]
    assert {(r["row"], r["col"]) for r in grid.clip(all_cells, [tiny], 1.0).collect()} == {(7, 7)}


def test_box_join_excludes_touch(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 0.0, 0.0, 5.0, 5.0)], "l_id int, l_w double, l_s double, l_e double, l_n double")
    b = spark.createDataFrame([(7, 1.0, 0.0, 2.0, 1.0), (8, 0.5, 0.5, 3.0, 3.0)], "r_id int, r_w double, r_s double, r_e double, r_n double")
    got = sorted(tuple(r) for r in grid.join_boxes(a, b, 1.0).select("l_id", "r_id").collect())
    assert got == [(1, 8), (2, 7), (2, 8)]


def scenes(spark):
    rows = [("a", "hls2-s30", "2026-01-05 00:00:00", 10.0, (0.0, 0.0, 1.0, 1.0), {"B04": "u1", "B8A": "u2", "Fmask": "u3"}), ("b", "hls2-l30", "2026-01-06 00:00:00", 90.0, (0.0, 0.0, 1.0, 1.0), {"B04": "u4", "B05": "u5", "Fmask": "u6"}), ("c", "sentinel-2-l2a", "2026-01-06 00:00:00", 5.0, (0.0, 0.0, 1.0, 1.0), {"B04": "u7"}), ("d", "hls2-s30", "2026-01-07 00:00:00", 10.0, (1.0, 0.0, 2.0, 1.0), {"B04": "u8", "B8A": "u9", "Fmask": "u0"})]
    return spark.createDataFrame(rows, "scene_id string, collection string, acq_ts string, cloud_cover double, footprint struct<w:double,s:double,e:double,n:double>, assets map<string,string>").withColumn("acq_ts", F.col("acq_ts").cast("timestamp_ntz"))


def test_catalog(spark):
    s = scenes(spark)
    assert [r["scene_id"] for r in catalog.search(s, "hls", (0, 0, 1, 1), "2026-01-01", "2026-02-01").collect()] == ["a"]
    assert catalog.with_bands(s.where("scene_id = 'b'")).head()["nir_href"] == "u5"
    with pytest.raises(catalog.NoBand, match="B04"):
        catalog.with_bands(s.where("scene_id = 'c'"))
    bad = spark.createDataFrame([("u2",)], "href string")
    assert sorted(r["scene_id"] for r in catalog.without_bad(s, bad).collect()) == ["b", "c", "d"]
    waits = []
    with pytest.raises(catalog.NoLandCover):
        catalog.cropland(spark.createDataFrame([], "row int, col int, x double, y double, cls int, time int"), (0, 0, 1, 1), attempts=3, sleep=waits.append)
    assert waits == [1.0, 2.0]


def test_areas_of_any_form(spark):
    assert grid.box_of((1, 2, 3, 4)) == (1, 2, 3, 4)
    assert grid.box_of([(0, 0), (2, 1), (1, 5)]) == (0, 0, 2, 5)
    assert len(grid.rings_of([[(0, 0), (1, 0), (1, 1)], (5, 5, 6, 6)])) == 2
    inner = [(120.0, 10.0), (120.15, 10.0), (120.15, 10.15), (120.0, 10.15)]
    assert grid.tiles_within(inner, 0.1, spark).count() == 4
    assert catalog.normalised_axes(spark.createDataFrame([(1, 2, 3)], "lon int, latitude int, v int")).columns == ["x", "y", "v"]


def test_bands_of_sensors(spark):
    rows = [("a", 0, 0, "2026-01-01 00:00:00", 500, 3000, 0), ("b", 0, 1, "2026-01-01 00:00:00", 500, 3000, 2)]
    obs = spark.createDataFrame(rows, "scene_id string, row int, col int, ts string, red int, nir int, qa int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["col"]: r["ndvi"] for r in catalog.merged([catalog.ndvi(obs, "hls"), catalog.ndvi(obs.where("col = 5"), "hls")]).collect()}
    assert got[0] == pytest.approx(2500 / 3500) and got[1] is None
    cover = spark.createDataFrame([(0, 0, 1.0, 1.0, 10, 1), (0, 0, 1.0, 1.0, 40, 2), (0, 1, 1.0, 1.0, 40, 1)], "row int, col int, x double, y double, cls int, time int")
    crop = catalog.cropland(cover, (0, 0, 2, 2))
    assert crop.count() == 2 and catalog.masked(catalog.ndvi(obs, "hls"), crop).count() == 2


@pytest.mark.parametrize("kind,want", [("average", 2.0), ("mode", 1.0), ("nearest", 1.0)])
def test_resampling(spark, kind, want):
    a = np.array([[1.0, 1.0, 4.0], [2.0, 1.0, 3.0], [1.0, 2.0, 3.0]])
    assert grid.coarser(cells(spark, a), 3, "v", kind).head()["v"] == want
