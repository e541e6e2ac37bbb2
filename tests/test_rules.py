"""Rules, sinks and tables that no query covers, against known values."""

import json
import math
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from embergrid.functions import records, solar
from embergrid.operators import calibration, contextual, cusum, lifecycle, masks, merge, report, validate
from embergrid.operators import series as ops
from embergrid.plans import catalog
from embergrid.sources import feeds
from embergrid.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def at(t, lat, lon):
    return F.lit(t).cast("timestamp"), F.lit(lat), F.lit(lon)


@pytest.mark.parametrize("t, lat, lon, elevation, azimuth", [
    # the published worked example of the solar position algorithm (no refraction): 17 October 2003 near Boulder
    ("2003-10-17 19:30:30", 39.742476, -105.1786, 39.888, 194.340),
])
def test_sun_stands_where_the_almanac_says(spark, t, lat, lon, elevation, azimuth):
    assert 90 - one(spark, solar.solar_zenith(*at(t, lat, lon))) == pytest.approx(elevation, abs=0.05)
    assert one(spark, solar.solar_azimuth(*at(t, lat, lon))) == pytest.approx(azimuth, abs=0.05)


def test_glint_is_the_angle_between_the_mirrored_sun_and_the_satellite(spark):
    t, lat, lon = "2026-01-15 02:00:00", -33.0, 150.0
    sza, saa = (math.radians(one(spark, f(*at(t, lat, lon)))) for f in (solar.solar_zenith, solar.solar_azimuth))
    la, dl = math.radians(lat), math.radians(solar.SATELLITE_LON - lon)
    up = math.cos(la) * math.cos(dl)
    r = (solar.EARTH_KM + solar.SATELLITE_KM) / solar.EARTH_KM
    # the satellite in local coordinates: east, north, up, seen from the surface
    east, north, high = r * math.sin(dl), -r * math.sin(la) * math.cos(dl), r * up - 1
    n = math.sqrt(east**2 + north**2 + high**2)
    sun = (math.sin(sza) * math.sin(saa), math.sin(sza) * math.cos(saa), math.cos(sza))
    # glint here compares azimuths as they stand (cos theta = cos cos - sin sin cos), as mirrored at the vertical
    dot = (-sun[0] * east - sun[1] * north + sun[2] * high) / n
    assert one(spark, solar.glint_angle(*at(t, lat, lon))) == pytest.approx(math.degrees(math.acos(dot)), abs=1e-6)


def test_harmonics_and_prediction(spark):
    assert one(spark, solar.harmonic_row(F.lit(6.0), F.lit(0.5))) == pytest.approx([1, 0, 1, -1, 0, 0.5], abs=1e-12)
    noise = cusum.CusumConfig().noise
    assert one(spark, cusum.predicted_btd(F.lit(5.0), F.lit(2.0), F.lit(True))) == pytest.approx(5 - 2 * math.sqrt(noise.day))
    assert one(spark, cusum.predicted_btd(F.lit(5.0), F.lit(None).cast("double"), F.lit(False))) == 5.0


def test_ranks_and_days(spark):
    assert one(spark, records.status_rank(F.lit("CONFIRMED"))) > one(spark, records.status_rank(F.lit("LIKELY"))) > one(spark, records.status_rank(F.lit("PROVISIONAL")))
    assert one(spark, records.local_day(F.lit("2026-01-01 20:00:00").cast("timestamp"))) == date(2026, 1, 2)
    assert [one(spark, lifecycle.min_frames_by_danger(F.lit(x))) for x in (12.0, 50.0, 80.0)] == [2, 1, 1]


def test_danger_index_of_a_hot_dry_day(spark):
    got = one(spark, ops.danger_index(F.lit(40.0), F.lit(10.0), F.lit(50.0), F.lit(10.0)))
    assert got == pytest.approx(2 * math.exp(-0.45 + 0.987 * math.log(10) - 0.345 + 1.352 + 1.17))


def test_effective_humidity_weighs_recent_days(spark):
    df = spark.createDataFrame([("a", date(2026, 1, d), h) for d, h in ((1, 50.0), (2, 40.0), (3, 80.0))], "station string, date date, humidity double")
    got = {r.date.day: r.effective_humidity for r in ops.effective_humidity(df).collect()}
    assert got == pytest.approx({1: 15.0, 2: 0.3 * (40 + 35), 3: 0.3 * (80 + 28 + 24.5)})


def test_interpolation_by_inverse_square(spark):
    points = spark.createDataFrame([(1, -33.0, 150.0)], "point_id long, lat double, lon double")
    stations = spark.createDataFrame([(-33.1, 150.0, 10.0), (-32.8, 150.0, 20.0), (-40.0, 150.0, 99.0)], "r_lat double, r_lon double, value double")
    row = lifecycle.interpolate(points, stations).first()
    assert row.n_stations == 2 and row.value == pytest.approx((10 * 4 + 20) / 5, rel=1e-6)


def test_raster_cells_are_clipped_at_the_edges(spark):
    raster = spark.createDataFrame([(r, c, r == 0) for r in range(2) for c in range(2)], "r_row int, r_col int, value boolean")
    px = spark.createDataFrame([(1, 10.0, 20.0), (2, 9.0, 21.0), (3, 99.0, -99.0), (4, -99.0, 99.0)], "i long, lat double, lon double")
    got = {r.i: r.is_water for r in masks.raster_lookup(px, raster, 10.0, 20.0, 1.0, 2, 2).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_background_partner_and_first_rows(spark):
    fires = spark.createDataFrame([("f", -33.0, 150.0), ("g", -35.0, 150.0)], "label string, lat double, lon double")
    others = spark.createDataFrame([("b", -33.005, 150.005), ("a", -32.995, 149.996), ("c", -33.02, 150.0)], "o_label string, o_lat double, o_lon double")
    assert [tuple(r) for r in calibration.background_partner(fires, others).collect()] == [("f", "a")]
    df = spark.createDataFrame([(1, 3), (1, 2), (2, 5)], "k int, v int")
    assert sorted(tuple(r) for r in merge.nearest_rows(df, "k", "v").collect()) == [(1, 2), (2, 5)]


def test_nearest_pixel_anywhere_equals_a_search_of_all(spark):
    grid = [(i, 0, -33 + i * 0.01, 150.0) for i in range(30)]
    targets = [("near", -32.95, 150.001), ("far", -10.0, 100.0), ("antipode", 33.0, -30.0), ("tie", -32.995, 150.0)]
    got = {r.label: (r.row, r.pixel_dist_deg) for r in calibration.nearest_pixel_anywhere(spark.createDataFrame(targets, "label string, lat double, lon double"), spark.createDataFrame(grid, "row int, col int, r_lat double, r_lon double")).collect()}
    for label, lat, lon in targets:
        far, row = min((math.hypot(lat - g[2], lon - g[3]), g[0]) for g in grid)
        assert got[label][0] == row and got[label][1] == pytest.approx(far)
    empty = spark.createDataFrame([], "row int, col int, r_lat double, r_lon double")
    assert calibration.nearest_pixel_anywhere(spark.createDataFrame(targets[:1], "label string, lat double, lon double"), empty).first().row is None


def test_state_is_stored_loaded_and_reset(spark, tmp_path):
    grid = spark.range(4).withColumnRenamed("id", "pixel_id")
    seen = cusum.first_state(grid).withColumn("n_obs", (F.col("pixel_id") * 30).cast("int")).withColumn("s_slow", F.lit(2.0))
    row = cusum.initialized_fraction(seen).first()
    assert (row.fraction, row.median_n_obs) == (0.5, 45.0)
    cusum.save_state(seen, str(tmp_path / "s"), 7)
    wider = spark.range(1, 6).withColumnRenamed("id", "pixel_id")
    got = {r.pixel_id: (r.n_obs, r.s_slow) for r in cusum.load_state(spark, str(tmp_path / "s"), wider, 7).collect()}
    assert got == {1: (30, 2.0), 2: (60, 2.0), 3: (90, 2.0), 4: (0, 0.0), 5: (0, 0.0)}
    reset = {r.pixel_id: r.n_obs for r in cusum.reset_pixels(seen, spark.createDataFrame([(2,), (9,)], "pixel_id long")).collect()}
    assert reset == {0: 0, 1: 30, 2: 0, 3: 90}


def test_detections_of_both_detectors(spark):
    base = {"lat": F.lit(-33.0), "lon": F.lit(150.0), "obs_time": F.lit("2026-01-02 03:00:00").cast("timestamp"), "bt7": F.lit(340.0), "bt14": F.lit(300.0), "is_day": F.lit(True), "confidence": F.lit(0.5)}
    df = spark.range(4).withColumns(base | {"candidate": F.col("id") == 1, "fire_mask": F.col("id").cast("int"), "frp": F.lit(None).cast("double"), "frame_id": F.lit(0), "row": F.lit(0), "col": F.lit(0)})
    got = cusum.to_detections(df).collect()
    assert len(got) == 1 and (got[0].confidence, got[0].source, got[0].daynight) == ("low", "HIMAWARI", "D")
    assert sorted(r.confidence for r in contextual.to_detections(df).collect()) == ["high", "low", "nominal"]


EVENTS = "event_seq long, status string, centroid_lat double, centroid_lon double, location_uncertainty_m double, detection_count long, max_frp double, source_set string"


def documents(path):
    """The part files one after the other, by name."""
    return json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))


def test_report_is_one_valid_document(spark, tmp_path):
    ev = spark.createDataFrame([(i, ("LIKELY", 'odd "name"')[i % 2], -33.0 - i, 150.0, 2000.0, i, None if i == 3 else float(i), "A,B") for i in range(1, 8)], EVENTS).repartition(4)
    report.save_report(ev, str(tmp_path), "2026-04-11")
    doc = documents(tmp_path / "report_date=2026-04-11" / "features")
    assert doc["type"] == "FeatureCollection" and doc["crs"]["properties"]["name"].endswith("EPSG::4326")
    assert doc["metadata"]["total_events"] == 7 and doc["metadata"]["status_summary"] == {"LIKELY": 3, 'odd "name"': 4} and doc["metadata"]["competition_day"] == 3
    assert [f["properties"]["event_seq"] for f in doc["features"]] == list(range(1, 8))
    ring = doc["features"][0]["geometry"]["geometries"][1]["coordinates"][0]
    assert len(ring) == 33 and ring[0] == ring[-1]
    report.save_report(ev.limit(0), str(tmp_path), "2026-04-12")
    assert documents(tmp_path / "report_date=2026-04-12" / "features")["features"] == []
    assert [(r.report_date, r.total_events) for r in report.list_reports(spark, str(tmp_path)).collect()] == [("2026-04-12", 0), ("2026-04-11", 7)]
    report.write_collection(ev, str(tmp_path / "live"))
    live = documents(tmp_path / "live")
    assert set(live) == {"type", "name", "features"} and live["features"][0]["geometry"] == {"type": "Point", "coordinates": [150.0, -34.0]}


def test_targets_and_weather_and_training(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"label":"a","lat":-33.1,"lon":150.2,"firms_first_dt":"2026-01-02","n_detections":4}]')
    row = feeds.read_targets(spark, str(tmp_path / "t.json")).first()
    assert (row.label, row.lat, row.n_detections, row.duration_hours) == ("a", -33.1, 4, None)
    (tmp_path / "w.json").write_text('[{"location":{"latitude":-33.5,"longitude":150,"elevation":12},"data":[{"date":"2026-01-02","variables":[{"variable_code":"max_temp","value":31.5,"source":25},{"variable_code":"rh_tmax","value":null,"source":25}]}]}]')
    got = feeds.read_weather(spark, str(tmp_path / "w.json")).orderBy("code").collect()
    assert [(r.code, r.value, r.source, r.date, r.lat) for r in got] == [("max_temp", 31.5, 25, date(2026, 1, 2), -33.5), ("rh_tmax", None, 25, date(2026, 1, 2), -33.5)]
    df = spark.createDataFrame([(1, datetime(2026, 1, 2, 23)), (2, datetime(2026, 1, 3, 1))], "id long, obs_time timestamp")
    feeds.write_training(df, str(tmp_path / "train"))
    feeds.write_training(df.where("id = 2"), str(tmp_path / "train"))
    assert sorted((r.id, r.obs_date) for r in spark.read.parquet(str(tmp_path / "train")).collect()) == [(1, date(2026, 1, 2)), (2, date(2026, 1, 3)), (2, date(2026, 1, 3))]


def test_windowed_counts_of_a_stream(spark, tmp_path):
    rows = [(datetime(2026, 1, 1, 0, m), b) for m, b in ((1, 400.0), (5, 200.0), (9, 400.0), (12, 400.0))] + [(datetime(2026, 1, 1, 5), 200.0)]
    spark.createDataFrame(rows, "obs_time timestamp, bt7 double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("obs_time timestamp, bt7 double").parquet(str(tmp_path / "in"))
    q = jobs.frame_counts(stream).writeStream.format("memory").queryName("frame_counts_test").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r.window.start.minute, r.n_pixels, r.n_hot) for r in spark.table("frame_counts_test").collect() if r.window.start.hour == 0)
    assert got == [(0, 3, 2), (10, 1, 1)]


def test_latency_is_that_of_matched_events(spark, sf, monkeypatch):
    lat = [-30.0, 10.0, 20.5, 40.0, 1000.0]
    rows = [(True, x) for x in lat] + [(True, None), (True, float("nan")), (False, 99999.0), (False, None)]
    m = spark.createDataFrame(rows, "matched boolean, latency_min double").withColumn("early_detection", F.col("latency_min") < 0)
    want = {f"latency_p{p}": pd.Series(lat).quantile(p / 100) for p in (10, 25, 50, 75, 90)} | {"latency_mean": sum(lat) / 5, "latency_min": -30.0, "latency_max": 1000.0}
    assert validate.latency(m).first().asDict() == pytest.approx(want)
    all_of = validate.summary(m, spark.range(2), spark.range(8)).first().asDict()
    assert {k: all_of[k] for k in want} == pytest.approx(want) and (all_of["n_truth"], all_of["n_matched"], all_of["n_early"]) == (9, 7, 1)
    assert set(validate.latency(m.where("not matched")).first()) == {None}
    # the query has its figures from the operator
    monkeypatch.setattr(validate, "latency", lambda matched: matched.agg(*[F.lit(7.0).alias(k) for k in want]))
    assert set(catalog.QUERIES["latency_quantiles"](spark, sf).first()) == {7.0}
