import datetime as dt
import json
import math
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdure import search, store
from verdure.__main__ import main
from verdure.agent import Agent
from verdure.backends import Http, Scripted, Transient, Unavailable, make_backend
from verdure.config import Settings
from verdure.operators import admin
from verdure.plans import bindings, registry
from verdure.plans.runner import Runner
from verdure.streaming import composites
from verdure.tools import ToolRunner, coerced, public

SF = "/root/testdata/sf0.001"


def rows_of(df):
    def text(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "-"
        return f"{v:.6f}" if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, (float, bool)) else str(v)

    return Counter("|".join(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents").split():
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def units(spark):
    rows = [("ALPHA", "R1", "12"), ("BETA", "R1", None), ("PALAWAN", "R4", "May")]
    return spark.createDataFrame(rows, "name string, region string, planting_month_raw string")


def test_unit_selection(spark):
    u = units(spark)
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(admin.select_units(u, exclude=["palawan"])) == ["ALPHA", "BETA"]
    assert names(admin.select_units(u, "regional", ["r1"])) == ["ALPHA", "BETA"]
    with pytest.raises(admin.UnknownNames, match="NOPE"):
        admin.select_units(u, "provincial", ["NOPE"])
    layers = {"x": spark.createDataFrame([(1,)], "a int"), "y": spark.createDataFrame([("n", 1)], "`Pro Name` string, b int")}
    assert admin.resolve_table(layers, ["pro_name"]).columns == ["pro_name", "b"]
    with pytest.raises(ValueError, match="x: a"):
        admin.resolve_table(layers, ["zzz"])


def test_municipal_planting(spark):
    months = [10, 11, 11, 12, 12, 12, 11, 10, 11, 12] * 2 + [5]
    rows = spark.createDataFrame([("BOHOL", str(m)) for m in months], "name string, planting_month_raw string")
    planted = admin.planting(rows, 12, "dry")
    r = planted.head()
    assert r["counts"] == {5: 1, 10: 4, 11: 8, 12: 8} and r["months"] == [10, 11, 12] and r["rare"] == [5]
    w = admin.season_windows(planted, 2026, "dry").head()
    assert (str(w["season_start"]), str(w["season_end"]), w["plant_month"]) == ("2025-09-01", "2026-06-30", 10)
    got = admin.unit_periods(admin.season_windows(planted, 2026, "dry"), "2026-04-01", "last_complete").collect()
    assert [r["label"] for r in got] == ["202603"]
    even = spark.createDataFrame([("X", str(m)) for m in range(1, 13)], "name string, planting_month_raw string")
    assert admin.planting(even, 6, "wet").head()["months"] == [6]


def test_settings():
    assert (Settings().season, Settings().column, Settings().fallback, Settings().tile_degrees) == ("dry", "Semester_1", 12, 0.25)
    s = Settings().updated(season="wet")
    assert (s.column, s.fallback) == ("Semester_2", 6) and s.updated(plant_column="Semester_1").season == "dry"
    day = dt.date(2026, 10, 2)
    assert (s.year_at(day), Settings().year_at(day), Settings().planting_year(11, day), Settings().planting_year(2, day)) == (2026, 2027, 2026, 2027)
    assert Settings(season_year=2026).summary(day) == {"season": "dry", "season_year": 2026, "label": "dry2026", "planting_month_column": "Semester_1", "fallback_planting_month": 12, "window_for_fallback_month": "2025-11-01..2026-06-30", "output_prefix": "products/growth_stage/2026/dry"}
    for bad in ({"nope": 1}, {"season": "dry", "plant_column": "Semester_2"}, {"period": "weekly"}):
        with pytest.raises(ValueError):
            s.updated(**bad)
    assert s.key() != Settings().key() == Settings().key()


@pytest.fixture(scope="session")
def field_obs(spark):
    cells = spark.range(36).select(F.floor(F.col("id") / 6).cast("int").alias("row"), (F.col("id") % 6).cast("int").alias("col"))
    cells = cells.withColumn("unit", F.when(F.col("col") < 3, "ALPHA").otherwise("PALAWAN"))
    days = F.explode(F.sequence(F.lit(0), F.lit(56))).alias("i")
    rows = cells.select("*", days).withColumn("ts", F.expr("timestamp_ntz'2025-11-01' + make_dt_interval(i * 5)"))
    curve = F.expr("0.15 + 0.7 * exp(-0.5 * pow((i * 5 - 106) / 25.0, 2))")
    return rows.select("row", "col", "unit", "ts", curve.alias("ndvi"))


def test_units_run_over_their_own_windows(spark, tmp_path):
    months = spark.createDataFrame([("EARLY", "R", "10"), ("LATE", "R", "1")], "name string, region string, planting_month_raw string")
    days = spark.range(80).select(F.explode(F.array(F.lit("EARLY"), F.lit("LATE"))).alias("unit"), (F.col("id") * 5).cast("int").alias("d"))
    rows = days.withColumn("ts", F.expr("timestamp_ntz'2025-09-01' + make_dt_interval(d)")).withColumn("row", F.lit(0)).withColumn("col", F.when(F.col("unit") == "LATE", 50).otherwise(0))
    peak = F.when(F.col("unit") == "LATE", 250).otherwise(110)  # day 159 of the later unit's own window, past day 210 of the earlier one's
    obs = rows.select("row", "col", "unit", "ts", (0.15 + 0.7 * F.exp(-0.5 * F.pow((F.col("d") - peak) / 25.0, F.lit(2)))).alias("ndvi"))
    r = Runner(spark, Settings(season="dry", season_year=2026, which="season", level="provincial"), months, obs, log=lambda *_: None)

    def made(name, seen=obs, **how):
        r.obs = seen
        r.run_periodic(str(tmp_path / name), names=["EARLY", "LATE"], as_of="2026-06-20", **how)
        return {(x["unit"], str(x["label"])): x["growth_stage"] for x in spark.read.parquet(str(tmp_path / name / "stages")).collect()}

    both, late = made("both"), made("late", only=["LATE"])
    assert {k: v for k, v in both.items() if k[0] == "LATE"} == late and max(late.values()) > 0
    assert made("cut", obs.where("ts < timestamp_ntz'2026-06-21'")) == both  # nothing after the day of the run counts


def test_runs(spark, field_obs, tmp_path, capsys):
    c = Settings(season="dry", season_year=2026, which="season", level="provincial")
    r = Runner(spark, c, units(spark).where("name <> 'BETA'"), field_obs, log=lambda *_: None)
    plan = r.plan(names=["ALPHA"], as_of="2026-04-10")
    assert [x["label"] for x in plan.orderBy("label").collect()] == ["202511", "202512", "202601", "202602", "202603"]
    assert r.plan_totals(plan, names=["ALPHA"], as_of="2026-04-10")["units_in_season"] == 1 and r.window_for(12) == (dt.date(2025, 11, 1), dt.date(2026, 6, 30))
    out = r.run_periodic(str(tmp_path / "o"), names=["ALPHA"], as_of="2026-04-10")
    assert out["outcomes"] == {"success": 1}
    assert r.run_periodic(str(tmp_path / "o"), names=["ALPHA"], as_of="2026-04-10")["outcomes"] == {"skipped": 1}
    assert r.run_periodic(str(tmp_path / "o"), names=["ALPHA"], as_of="2026-04-10", skip_existing=False)["outcomes"] == {"success": 1}
    with pytest.raises(admin.UnknownNames):
        r.run_periodic(str(tmp_path / "o"), names=["ALPHA"], as_of="2026-04-10", start_from="ZZZ")
    several = r.run_periodic(str(tmp_path / "several"), names=["ALPHA", "PALAWAN"], as_of="2026-04-10")
    assert several["outcomes"] == {"success": 1, "out_of_season": 1} and several["mosaic"]["missing"] == {}
    empty = Runner(spark, c, units(spark).where("name <> 'BETA'"), field_obs.where("unit = 'NOWHERE'"), log=lambda *_: None)
    assert empty.run_periodic(str(tmp_path / "none"), names=["ALPHA"], as_of="2026-04-10")["outcomes"] == {"no_coverage": 1}
    assert {x["reason"] for x in spark.read.parquet(str(tmp_path / "none/manifest")).collect()} == {"no_coverage"} and empty.saved(str(tmp_path / "none")).isEmpty()
    broken = Runner(spark, c, units(spark).where("name <> 'BETA'"), field_obs.withColumn("ndvi", F.raise_error(F.lit("lost"))), log=lambda *_: None)
    assert broken.run_periodic(str(tmp_path / "broken"), names=["ALPHA"], as_of="2026-04-10")["outcomes"] == {"failed": 1}
    summed = spark.read.option("header", True).csv(str(tmp_path / "o/summary")).where("label = '202602' and unit_file = 'ALPHA'").collect()
    assert sum(int(x["pixels"]) for x in summed) == 18
    smooth = Runner(spark, c.updated(majority_radius=1), r.units, field_obs, log=lambda *_: None)
    smooth.run_periodic(str(tmp_path / "smooth"), names=["ALPHA"], as_of="2026-04-10")
    assert spark.read.parquet(str(tmp_path / "smooth/stages")).count() == 5 * 18
    made = spark.read.parquet(str(tmp_path / "o/stages"))
    assert {x["growth_stage"] for x in made.where("label = '202602'").collect()} <= {3, 4} and made.count() == 5 * 18
    mosaic = r.mosaic(str(tmp_path / "o"), names=["ALPHA", "PALAWAN"], as_of="2026-04-10")
    assert mosaic["missing"] == {}
    assert r.mosaic(str(tmp_path / "o"), names=["ALPHA", "PALAWAN"], as_of="2026-04-30")["missing"] == {"202604": ["ALPHA", "PALAWAN"]}
    assert r.mosaic(str(tmp_path / "o"), names=["ALPHA", "PALAWAN"], as_of="2026-04-10", periods=["202602"])["missing"] == {"202602": ["PALAWAN"]}
    recent = r.run_recent(as_of="2026-04-10")
    assert recent.count() == 36 and {x["data_age_days"] for x in recent.collect()} == {0}
    res = c.grid_degrees
    box = (0.0, -6 * res, 3 * res, 0.0)
    assert r.quick_check((0.0, -6 * res, 6 * res, 0.0), 12, 2025)["crop_pixels"] == 36 and r.quick_check((50.0, 0.0, 50.1, 0.1))["status"].startswith("no obs")
    checked = r.quick_check(box, 12, 2025)
    assert checked["crop_pixels"] == 18 == checked["cycle_pixels"] == sum(checked["qc_counts"].values())
    saved = r.save_recent(str(tmp_path / "o"), names=["ALPHA", "BETA"], bbox=box, as_of="2026-04-10")
    assert len(saved["success"]) == 2 and saved["no_coverage"] == ["BETA"] and set(saved["median_age"].values()) == {0}
    kept = spark.read.parquet(saved["outputs"])
    places = spark.createDataFrame([("Muñoz Town", 0.0, -2 * res, 2 * res, 0.0)], "name string, w double, s double, e double, n double")
    small = Runner(spark, c, units(spark), field_obs, log=lambda *_: None, places=places)
    assert small.run_recent(names=["muñoz town"], as_of="2026-04-10").groupBy("unit").count().collect()[0]["count"] == 4 and [x["name"] for x in small.areas("place").collect()] == ["Muñoz Town"]
    assert "classes" in spark.read.parquet(str(tmp_path / "o/stages")).schema["growth_stage"].metadata
    assert kept.count() == 36 and dict(kept.dtypes)["growth_stage"] == "smallint" and r.run_recent(bbox=box, as_of="2026-04-10").count() == 18
    tools = ToolRunner(r, str(tmp_path / "o"), store=store.LocalStore(str(tmp_path / "o")), confirm=lambda *_: False)
    assert "approve" in tools("run_periodic", {"names": "ALPHA", "as_of": "2026-04-10"})["error"]
    assert tools("zzz", {})["error"].startswith("unknown tool") and "bad arguments" in tools("quick_check", {"x": 1})["error"] and "bad arguments" in tools("quick_check", {})["error"]
    assert tools("run_recent", {"names": ["NOWHERE"]})["error"] == "unknown areas NOWHERE"
    assert tools("last_run", {"kind": "recent"})["success"] and tools("last_run", {"kind": "periodic"}).get("note") and "bbox" in tools("run_recent", {})["error"]
    assert tools("quick_check", {"bbox": [str(v) for v in box], "planting_month": 12.0, "year": "2025"})["crop_pixels"] == 18
    assert tools("list_areas", {"contains": "pal"})["names"] == ["PALAWAN"]
    assert "unknown settings" in tools("update_settings", {"changes": {"zzz": 1}})["error"]
    units(spark).write.parquet(str(tmp_path / "u"))
    field_obs.write.parquet(str(tmp_path / "f"))
    (tmp_path / "c.json").write_text(json.dumps({"season": "dry", "season_year": 2026}))
    args = ["--units", str(tmp_path / "u"), "--obs", str(tmp_path / "f"), "--config", str(tmp_path / "c.json"), "--level", "provincial", "--names", "ALPHA", "--as-of", "2026-04-10", "--out", str(tmp_path / "p"), "--which", "season"]
    assert main(["plan", *args], spark) == 0 and main(["periodic", *args, "--yes"], spark) == 0 and main(["settings"]) == 0
    assert '"success": 1' in capsys.readouterr().out
    replies = [{"text": "", "tool_calls": [{"id": "1", "name": "search_method_docs", "args": {"query": "median data age", "k": 2}}]}, {"text": "that is all", "tool_calls": []}]
    backend = Scripted(replies)
    assert main(["ask", "what is the data age?", *args, "--models", "m"], spark, backend) == 0 and "that is all" in capsys.readouterr().out
    assert "verdure" in backend.seen[1][1][-1]["content"]


class Bucket:
    def __init__(self):
        self.data, self.lists = {}, 0

    def put(self, b, k, v):
        self.data[k] = v

    def get(self, b, k):
        return self.data[k]

    def list(self, b, p):
        self.lists += 1
        return [k for k in self.data if k.startswith(p)]


@pytest.mark.parametrize(("name", "windows"), [("run_recent", 1), ("run_mosaic", 2), ("run_periodic", 2), ("run_summary", 2), ("run_log", 2)])
def test_runs_read_customers_once_a_window(spark, monkeypatch, name, windows):
    """A table of their size that is joined with itself is broadcast, which a driver of 1 GB can't hold at 60 times sf0.1."""
    frame, read = type(spark.range(1)), []
    write = frame.write.fget

    def recorded(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        read.append(sum("Relation [" in x and "c_custkey" in x for x in plan.splitlines()))
        return write(df)

    monkeypatch.setattr(frame, "write", property(recorded))
    registry.QUERIES[name](spark, SF)
    assert max(read) == windows


@pytest.mark.parametrize("name", ["run_mosaic", "run_periodic", "run_summary", "run_log"])
def test_runs_write_stages_apart_from_windows(spark, monkeypatch, name):
    """The sorts of the windows and of the writer in one task fail in a session of 1 GB at 60 times sf0.1."""
    frame, plans = type(spark.range(1)), []
    write = frame.write.fget
    monkeypatch.setattr(frame, "write", property(lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df)))
    registry.QUERIES[name](spark, SF)
    assert any("RepartitionByExpression" in p.splitlines()[0] and "Window" in p for p in plans)


def test_stores(tmp_path):
    (tmp_path / "a").write_text("hello")
    client = Bucket()
    s = store.make_store("both", str(tmp_path / "out"), "b", "p", client)
    s.put(str(tmp_path / "a"), "x/a.txt")
    assert s.exists("x/a.txt") and s.list("x") == ["x/a.txt"] and s.read_text("x/a.txt") == "hello" and client.data == {"p/x/a.txt": b"hello"}
    cloud = store.make_store("gcs", bucket="b", prefix="p", client=client)
    n = client.lists
    assert cloud.exists("x/a.txt") and not cloud.exists("x/b.txt") and client.lists == n + 1
    with pytest.raises(ValueError):
        store.make_store("gcs")
    with pytest.raises(RuntimeError):
        store.DriveStore(str(tmp_path), mount=str(tmp_path / "nowhere"))


def test_agent():
    call = {"text": "", "tool_calls": [{"id": "1", "name": "list_areas", "args": {}}]}
    waits, calls = [], []
    backend = Scripted([Transient("busy"), Unavailable("gone"), call, {"text": "done"}])
    agent = Agent(backend, lambda n, a: calls.append(n) or {"x": "y" * 30_000}, ["one", "two"], log=lambda *_: None, sleep=waits.append)
    assert agent.run("go") == "done" and waits == [2.0] and calls == ["list_areas"]
    assert [m for m, _ in backend.seen] == ["one", "one", "two", "two"]
    assert len(agent.messages[2]["content"]) < 20_100
    endless = Agent(Scripted([call] * 40), lambda *_: {}, ["m"], log=lambda *_: None)
    assert "too many" in endless.run("go")
    body = {}
    reply = {"choices": [{"message": {"content": None, "tool_calls": [{"id": "1", "function": {"name": "f", "arguments": "{bad"}}]}}]}
    http = make_backend("http", url="u", post=lambda u, h, b: body.update(b) or reply)
    assert isinstance(http, Http) and http.complete("m", "s", agent.messages, [])["tool_calls"] == [{"id": "1", "name": "f", "args": {}}]
    assert coerced({"k": 5.0, "x": "a, b"}, {"k": {"type": "integer"}, "x": {"type": "array"}}) == {"k": 5, "x": ["a", "b"]}
    assert public({"a": 1, "_b": 2, "c": [{"_d": 1, "e": 2}]}) == {"a": 1, "c": [{"e": 2}]}


def test_search(spark):
    parts = search.chunks_of("a.md", "# One\nheading date rules\n\n# Two\nNDVI_norm threshold of the heading date") + search.chunks_of("phenology.py", '"""Docs."""\n\ndef f():\n    return "NDVI_norm heading date"\n')
    assert [s for s, _ in parts] == ["a.md - One", "a.md - Two", "phenology.py", "phenology.py:f"]
    docs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(parts)], "id int, source string, text string")
    got = search.search(docs, "heading date NDVI_norm", 3).collect()
    assert len(got) == 3 and got[0]["id"] in (1, 3)
    assert len(search.split("a" * 700 + "\n\n" + "b" * 700)) == 2
    same = spark.createDataFrame([(1, "x y"), (2, "x y")], "id int, text string")
    assert [r["id"] for r in search.search(same, "x", 2).collect()] == [2, 1]


def test_http_codes(monkeypatch):
    import urllib.error

    def failing(code):
        def opened(*_, **__):
            raise urllib.error.HTTPError("u", code, "no", None, None)

        return opened

    kinds = {}
    for code in (404, 429, 503, 400):
        monkeypatch.setattr("urllib.request.urlopen", failing(code))
        try:
            Http("http://u").complete("m", "s", [], [])
        except Exception as e:  # noqa: BLE001
            kinds[code] = type(e)
    assert kinds == {404: Unavailable, 429: Transient, 503: Transient, 400: RuntimeError}  # 503 is worth another try


def test_backend_of_parts_and_fallback():
    sent = []
    replies = [{"candidates": [{"content": {"parts": [{"functionCall": {"name": "list_areas", "args": {"contains": "a"}}}, {"functionCall": {"name": "last_run"}}]}}]}, {"candidates": [{"content": {"parts": [{"text": "two areas"}]}}]}, {"candidates": []}]
    parts = make_backend("parts", url="http://h/{model}", key="k", post=lambda u, h, b: sent.append((u, h, b)) or replies[len(sent) - 1])
    agent = Agent(Scripted([Unavailable("gone")]), lambda n, a: {"names": ["A", "B"]}, ["first", (parts, "second")], log=lambda *_: None)
    assert agent.run("which?") == "two areas"
    url, head, body = sent[1]
    assert url == "http://h/second" and head == {"x-goog-api-key": "k"} and [t["role"] for t in body["contents"]] == ["user", "model", "user"]
    assert [p["functionResponse"]["name"] for p in body["contents"][2]["parts"]] == ["list_areas", "last_run"]
    assert all("parameters" not in t or t["parameters"]["properties"] for t in body["tools"][0]["functionDeclarations"])
    assert parts.complete("m", "s", [{"role": "user", "text": "x"}], [])["text"].startswith("The model gave")


def test_functions_in_sql(spark):
    import verdure

    assert set(verdure.register(spark)) == {"ndvi_classes", "ndvi_bits", "parse_month", "stage_at", "chunks"}
    got = spark.sql("SELECT ndvi_classes(1500, 4000, 4, timestamp_ntz'2025-01-01') a, ndvi_classes(1500, 4000, 9, timestamp_ntz'2025-01-01') b, ndvi_bits(500, 3000, 0) c, ndvi_bits(500, 3000, 2) d, ndvi_bits(-9999, 3000, 0) e, ndvi_bits(500, 3000, 32) f").head()
    assert [None if x is None else round(x, 6) for x in got] == [round(0.25 / 0.35, 6), None, round(2500 / 3500, 6), None, None, round(2500 / 3500, 6)]
    months = ["5", "5.0", "05", " May", "MAY", "5-6", "May-June", "June", "12.0", "Sept", "0", None, "NaN", "n/a", "13"]
    rows = spark.createDataFrame([(m,) for m in months], "raw string").selectExpr("parse_month(raw) AS m").collect()
    assert [r["m"] for r in rows] == [5, 5, 5, 5, 5, 5, 5, 6, 12, 9, None, None, None, None, None]
    assert spark.sql("SELECT stage_at(0, 1D, 2D, 3D, 4D, 3.5D)").head()[0] == 4
    spark.createDataFrame([(1, "a.md", "# One\ntext\n\n# Two\nmore")], "id int, name string, body string").createOrReplaceTempView("files")
    assert [tuple(r) for r in spark.sql("SELECT id, c.source FROM files, LATERAL chunks(name, body) c ORDER BY 2").collect()] == [(1, "a.md - One"), (1, "a.md - Two")]


def test_mosaic_of_inputs(spark):
    from verdure.operators import mosaic

    cells = lambda rows: spark.createDataFrame(rows, "row int, col int, a smallint, b smallint")
    fine = mosaic.Raster(cells([(0, 0, -32768, 7), (0, 1, -32768, -32768)]), 0.01, -32768)
    coarse = mosaic.Raster(cells([(0, 0, 9, 9), (1, 1, 5, 5), (2, 2, -1, -1)]), 0.02, -1)
    made = mosaic.mosaic([fine, coarse], -32768)
    assert made.res == 0.01 and made.nodata == -32768
    # the first input with a valid band wins the cell, the coarser input's cells go to the cell at their centre
    assert {(r["row"], r["col"], r["a"], r["b"]) for r in made.cells.collect()} == {(0, 0, -32768, 7), (1, 1, 9, 9), (3, 3, 5, 5)}
    assert mosaic.extent(made) == (0.0, -0.04, 0.04, 0.0)
    assert {(r["row"], r["col"]) for r in mosaic.mosaic([fine, coarse], bbox=(0.0, -0.02, 0.02, 0.0)).cells.collect()} == {(0, 0), (1, 1)}
    for bad in (coarse.replaced(crs="EPSG:32651"), coarse.replaced(cells=coarse.cells.drop("b")), coarse.replaced(cells=coarse.cells.withColumn("b", F.col("b").cast("int")))):
        with pytest.raises(ValueError):
            mosaic.mosaic([fine, bad])
    with pytest.raises(ValueError, match="nothing"):
        mosaic.mosaic([])


def test_catalog_is_opened_once(spark, tmp_path):
    from verdure.sources import catalog

    spark.range(3).write.parquet(str(tmp_path / "c"))
    one = catalog.open_catalog(spark, str(tmp_path / "c"))
    assert catalog.open_catalog(spark, str(tmp_path / "c")) is one and catalog.open_catalog(spark, str(tmp_path / "c"), fresh=True) is not one
    waits = []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        catalog.open_catalog(spark, str(tmp_path / "none"), attempts=3, sleep=waits.append)
    assert waits == [1.0, 2.0]
    assert [catalog.resampling(*x) for x in (("s2", 10, "red"), ("s2", 30, "red"), ("s2", 30, "qa"), ("hls", 30, "qa"), ("hls", 60, "nir"))] == ["nearest", "average", "mode", "nearest", "average"]


def test_freshness_stream(spark, tmp_path):
    schema = bindings.read(spark, SF, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    obs = rows.select(F.col("user_id").alias("pixel_id"), "ts", F.col("value").alias("ndvi"))
    got = composites.run_once(composites.freshness(obs), str(tmp_path / "fresh"), "pixel_id")
    want = bindings.read(spark, SF, "events").groupBy(F.col("user_id").alias("pixel_id")).agg(F.max("ts").alias("last_obs"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
