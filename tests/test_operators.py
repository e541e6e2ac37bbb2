"""Operators against plain restatements on small inputs."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from embergrid.config import ContextualConfig, CusumConfig
from embergrid.functions import geo, records, solar
from embergrid.operators import contextual, cusum, events, masks
from embergrid.operators import series as ops
from embergrid.operators.spatial import spatial_join
from embergrid.sources import feeds


def frame(spark, bt7, bt14, **more):
    """A pixel table from two planes."""
    rows = [(0, r, c, float(bt7[r, c]), float(bt14[r, c])) for r in range(bt7.shape[0]) for c in range(bt7.shape[1])]
    df = spark.createDataFrame(rows, "frame_id long, row long, col long, bt7 double, bt14 double")
    base = {"is_day": F.lit(False), "valid": F.lit(True), "is_water": F.lit(False), "is_industrial": F.lit(False), "glint": F.lit(None).cast("double")}
    return df.withColumns(base | more)


def uniform(n=40, seed=0):
    rnd = np.random.default_rng(seed)
    return 280 + rnd.normal(0, 0.5, (n, n)), 278 + rnd.normal(0, 0.5, (n, n))


def test_absolute_and_contextual_fires(spark):
    bt7, bt14 = uniform()
    bt7[5, 5] = 405.0
    bt7[20, 20], bt7[0, 0] = 310.0, 312.0
    out = {(r.row, r.col): r.fire_mask for r in contextual.detect(frame(spark, bt7, bt14)).where("fire_mask > 0").collect()}
    assert out == {(5, 5): 3, (20, 20): 2, (0, 0): 2}


def test_background_equals_plain_windows(spark):
    cfg = ContextualConfig()
    bt7, bt14 = uniform(30, 1)
    rnd = np.random.default_rng(2)
    for _ in range(60):
        bt7[rnd.integers(30), rnd.integers(30)] = 301.0
    px = contextual.classify(frame(spark, bt7, bt14), cfg)
    got = {(r.row, r.col): r for r in contextual.background_stats(px, cfg).collect()}
    back = bt7 < 300
    for r, c in zip(*np.where(bt7 >= 300)):
        for w in cfg.windows:
            h = w // 2
            box = np.s_[max(0, r - h) : r + h + 1, max(0, c - h) : c + h + 1]
            values = bt7[box][back[box]]
            if len(values) >= 0.25 * w * w:
                break
        row = got[(r, c)]
        assert (row.window, row.n_background) == (w, len(values))
        assert row.mu_bt7 == pytest.approx(values.mean())
        assert row.sd_bt7 == pytest.approx(max(values.std(), 2.0), abs=1e-6)


def test_early_exit_keeps_absolute_fires_at_sites(spark):
    bt7, bt14 = uniform(12)
    bt7[3, 3] = 405.0
    site = {"is_industrial": F.lit(True)}
    assert contextual.detect(frame(spark, bt7, bt14, **site)).agg(F.max("fire_mask")).first()[0] == 3
    bt7[8, 8] = 291.0
    bt14[8, 8] = 279.0
    assert contextual.detect(frame(spark, bt7, bt14, **site)).agg(F.max("fire_mask")).first()[0] == 1


def test_dilation_forms_agree(spark):
    rnd = np.random.default_rng(3)
    bt7, bt14 = uniform(20)
    df = frame(spark, bt7, bt14).withColumn("cloud", F.rand(4) < 0.02).cache()
    a = masks.dilate(df, "cloud", "x", 2).select("row", "col", "x").collect()
    b = masks.dilate_dense(df, "cloud", "x", 2).select("row", "col", "x").collect()
    assert sorted(a) == sorted(b)
    assert rnd is not None


def test_spatial_join_equals_all_pairs(spark):
    rnd = random.Random(1)
    pts = [(i, -38 + rnd.random(), 141 + rnd.random()) for i in range(300)]
    a = spark.createDataFrame(pts, "a long, lat double, lon double")
    b = spark.createDataFrame(pts[:150], "b long, r_lat double, r_lon double")
    got = sorted((r.a, r.b) for r in spatial_join(a, b, 5.0).select("a", "b").collect())
    want = sorted((p[0], q[0]) for p in pts for q in pts[:150] if events._km(p[1], p[2], q[1], q[2]) <= 5.0)
    assert got == want
    assert spatial_join(a, b, 5.0, "left_anti").count() == 300 - len({p for p, _ in want})


def plain_association(pdf, radius):
    """One pass over all detections in order of arrival, each against all events."""
    found, names = [], []
    for r in pdf.sort_values("seq").itertuples():
        best, at = radius, None
        for e in sorted(found, key=lambda e: e[4], reverse=True):
            d = events._km(r.lat, r.lon, e[1], e[2])
            if d < best:
                best, at = d, e
        if at is None:
            at = [r.seq, r.lat, r.lon, 0, r.acq]
            found.append(at)
        n = at[3]
        at[1:5] = (at[1] * n + r.lat) / (n + 1), (at[2] * n + r.lon) / (n + 1), n + 1, max(at[4], r.acq)
        names.append(at[0])
    return pd.DataFrame({"seq": sorted(pdf.seq), "event_seq": names})


def test_association_equals_one_sequential_pass(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(250):
        lat, lon = -33 + rnd.randrange(6) * 0.2, 150 + rnd.randrange(4) * 0.2
        rows.append((i, lat + rnd.random() * 0.04, lon + rnd.random() * 0.04, datetime(2026, 1, 1) + timedelta(minutes=rnd.randrange(5000))))
    df = spark.createDataFrame(rows, "seq long, lat double, lon double, acq timestamp")
    got = {r.seq: r.event_seq for r in events.associate(df).collect()}
    want = plain_association(df.toPandas(), 2.0)
    assert got == dict(zip(want.seq, want.event_seq, strict=True))


@pytest.mark.parametrize("minutes, sources, status", [((0,), 1, "PROVISIONAL"), ((0,), 2, "LIKELY"), ((0, 31), 1, "LIKELY"), ((0, 30), 1, "PROVISIONAL"), ((0, 20, 40), 1, "LIKELY"), ((0, 31, 62), 1, "CONFIRMED")])
def test_ladder(spark, minutes, sources, status):
    times = [datetime(2026, 1, 1) + timedelta(minutes=m) for m in minutes]
    df = spark.createDataFrame([(times,)], "t array<timestamp>")
    n = events.count_passes(F.col("t"))
    assert df.select(events.ladder(n, F.lit(sources))).first()[0] == status


def test_frames_equal_series_without_neighbours(spark):
    cfg = CusumConfig(require_adjacent=False, min_clear=3)
    rnd = random.Random(2)
    rows = [(p, f, p // 3, p % 3, 147.0, f * 600.0, rnd.gauss(2, 0.4) + (30 if f > 6 and p == 4 else 0), 285 + rnd.random(), rnd.random() > 0.2, f % 2 == 0, False) for p in range(9) for f in range(9)]
    px = spark.createDataFrame(rows, "pixel_id long, frame_id long, row int, col int, lon double, t double, btd double, bt14 double, clear boolean, is_day boolean, suppressed boolean")
    series = {(r.pixel_id, r.frame_id): r for r in cusum.run_series(px, cfg).collect()}
    state = cusum.first_state(px.select("pixel_id").distinct(), cfg)
    for f, out in enumerate(cusum.run_frames(state, [px.where(F.col("frame_id") == f) for f in range(9)], cfg)):
        for r in out.collect():
            s = series[(r.pixel_id, f)]
            assert (r.n_obs, r.candidate) == (s.n_obs, s.candidate)
            assert r.s_slow == pytest.approx(s.s_slow) and r.x == pytest.approx(s.x)
    assert any(s.candidate for s in series.values())


def test_kalman_step_equals_plain_algebra():
    import pandas as pd

    cfg = CusumConfig()
    x, p = np.arange(6) / 10, np.diag(cfg.start_variance)
    row = {"pixel_id": 1, "frame_id": 0, "row": 0, "col": 0, "x": x.tolist(), "p": p[cusum.UPPER].tolist(), "s_slow": 1.0, "s_fast": 0.5, "n_obs": 60, "last_clear": 0.0, "last_update": 0.0, "consecutive": 0, "ema": 284.0, "var_count": 0, "var_mean": 0.0, "var_m2": 0.0, "btd": 3.0, "bt14": 285.0, "clear": True, "is_day": True, "lon": 150.0, "t": 600.0}
    got = cusum.advance(pd.DataFrame([row]), cfg).iloc[0]
    p = p + np.diag(np.square(cfg.process_std))
    w = 2 * math.pi / 24 * (600 / 3600 + 10)
    h = np.array([1, math.cos(w), math.sin(w), math.cos(2 * w), math.sin(2 * w), 1.0])
    s = h @ p @ h + 0.25
    z = (3.0 - h @ x) / math.sqrt(s)
    slow = max(0, 1 + z - 0.5)
    conf = 1 / (1 + math.exp(-(math.log(1e-5 / (1 - 1e-5)) + 2 * max(slow, max(0, 0.5 + z - 1.5)))))
    gain = max(1 - conf, 0.01) * (p @ h) / s
    a = np.eye(6) - np.outer(gain, h)
    post = a @ p @ a.T + 0.25 * np.outer(gain, gain)
    assert got.z == pytest.approx(z) and got.s_slow == pytest.approx(slow) and got.confidence == pytest.approx(conf)
    assert got.x == pytest.approx(x + gain * (3.0 - h @ x)) and got.p == pytest.approx(post[cusum.UPPER])


def test_adjacent_candidates_are_reset(spark):
    cfg = CusumConfig(min_clear=0)
    rows = [(p, 0, 0, p, 147.0, 600.0, 100.0 if p in (0, 1, 3) else 0.0, 285.0, True, True, False) for p in range(5)]
    px = spark.createDataFrame(rows, "pixel_id long, frame_id long, row int, col int, lon double, t double, btd double, bt14 double, clear boolean, is_day boolean, suppressed boolean")
    out = {r.pixel_id: r for r in cusum.step(cusum.first_state(px.select("pixel_id"), cfg), px, cfg).collect()}
    assert [out[p].candidate for p in range(5)] == [True, True, False, False, False]
    assert out[0].s_slow == 0 and out[3].s_slow > 6


def test_full_query_equals_a_sequential_pass_with_neighbours(spark):
    import pandas as pd

    from embergrid.plans import catalog

    cfg, d = CusumConfig(min_clear=5), "/root/testdata/sf0.01"
    names = [c.split()[0] for c in cusum.STATE.split(", ")]
    px = catalog._kalman_input(spark, d).toPandas()
    state = cusum.first_state(spark.createDataFrame(px[["pixel_id"]].drop_duplicates()), cfg).toPandas().set_index("pixel_id", drop=False)
    want, lone = {}, 0
    for _, f in px.groupby(["t", "frame_id"]):
        f = f.set_index("pixel_id")
        now = cusum.advance(state.loc[f.index].join(f), cfg).set_index("pixel_id", drop=False)
        hot = {p for p in now.index if now.candidate[p] and not f.suppressed[p]}
        at = {(f.row[p], f.col[p]) for p in hot}
        kept = {p for p in hot if any((f.row[p] + i, f.col[p] + j) in at for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)}
        lone += len(hot - kept)
        now["candidate"] = [p in kept for p in now.index]
        now.loc[list(kept), ["s_slow", "s_fast", "consecutive"]] = 0
        state = pd.concat([state.drop(index=f.index), now[names]])
        want |= {(r.pixel_id, r.frame_id): r for r in now.itertuples()}
    # in one tile, and in tiles of two pixels, whose borders lie everywhere
    for got in (catalog.QUERIES["kalman_cusum_full"](spark, d).collect(), cusum.run_tiles(catalog._kalman_input(spark, d), cfg, side=2).collect()):
        assert lone > 0 and len(got) == len(want)
        for r in got:
            w = want[(r.pixel_id, r.frame_id)]
            assert (r.n_obs, r.candidate) == (w.n_obs, w.candidate)
            assert r.s_slow == pytest.approx(w.s_slow) and r.s_fast == pytest.approx(w.s_fast)


def test_solar_noon_and_midnight(spark):
    df = spark.createDataFrame([(datetime(2026, 3, 20, 12), 0.0, 0.0), (datetime(2026, 3, 20, 0), 0.0, 0.0), (datetime(2026, 6, 21, 12), 23.4, 0.0)], "t timestamp, lat double, lon double")
    got = [r[0] for r in df.select(solar.solar_zenith(F.col("t"), F.col("lat"), F.col("lon"))).collect()]
    assert got[0] == pytest.approx(0, abs=2.5) and got[1] == pytest.approx(180, abs=2.5) and got[2] == pytest.approx(0, abs=1)


def test_record_parsing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("latitude,longitude,acq_date,acq_time,satellite,confidence,frp,bright_ti4,daynight\n-33.1,150.2,2026-01-02,305,N,h,1.5,0,D\nx,150,2026-01-02,305,N,l,1,2,D\n")
    row = feeds.parse_csv(feeds.read_csv(spark, str(tmp_path / "a.csv"))).collect()
    assert len(row) == 1 and row[0].confidence == "high" and str(row[0].acq_datetime) == "2026-01-02 03:05:00"
    (tmp_path / "b.json").write_text('{"features":[{"geometry":{"coordinates":[150.1,-33.2]},"properties":{"datetime":"2026-01-02T03:04:05Z","confidence":85,"power":0,"frp":7.5}},{"geometry":{"coordinates":[]},"properties":{}}]}')
    row = feeds.read_geojson(spark, str(tmp_path / "b.json")).collect()
    assert len(row) == 1 and (row[0].confidence, row[0].frp, row[0].latitude) == ("high", 7.5, -33.2)


@pytest.mark.parametrize("raw, want", [("l", "low"), ("HIGH", "high"), ("n", "nominal"), ("80", "high"), ("79", "nominal"), ("29", "low"), ("?", "nominal"), (None, "nominal")])
def test_feed_confidence(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "c string").select(records.feed_confidence(F.col("c"))).first()[0] == want


def test_sample_is_stable_and_keeps_candidates(spark):
    df = spark.range(1000).select((F.col("id") % 4).alias("frame_id"), F.col("id").alias("pixel_id"), F.when(F.col("id") < 10, 0.5).otherwise(0.0).alias("probability"), F.lit(True).alias("clear"), F.lit(0.1).alias("z"))
    a, b = ops.training_sample(df), ops.training_sample(df.repartition(3))
    assert sorted(a.collect()) == sorted(b.collect())
    n = {r[0]: r[1] for r in a.groupBy("pixel_type").count().collect()}
    assert n == {"fire_candidate": 10, "background_sample": 8}


def test_point_grid(spark):
    g = ops.point_grid(spark, -38.0, -28.0, 141.0, 154.0, 0.5)
    assert g.count() == 21 * 27 and g.agg(F.max("lat"), F.max("lon")).first() == (-28.0, 154.0)


def test_archive_prefers_folders(spark):
    files = [("/a/20260101_0000/x_B07.DAT",), ("/a/HS_H09_20260101_0000_B07_FLDK_R20_S0810.DAT",), ("/a/HS_H09_20260102_0010_B14_FLDK_R20_S0910.DAT",), ("/a/readme",)]
    got = {r.frame: r.path for r in feeds.archive(spark.createDataFrame(files, "path string")).collect()}
    assert got == {"20260101_0000": files[0][0], "20260102_0010": files[2][0]}


@pytest.mark.parametrize("lat, lon", [(-33.0, 150.0), (0.0, 179.9), (71.0, -179.95), (-88.9, 10.0), (90.0, 0.0), (64.0, 0.0)])
def test_spatial_join_anywhere_on_the_globe(spark, lat, lon):
    """Beyond 60 degrees, at the poles and across the antimeridian, against all pairs."""
    rnd = random.Random(int(lat * 10 + lon))
    place = lambda: (max(-90.0, min(90.0, lat + rnd.uniform(-0.4, 0.4))), (lon + rnd.uniform(-2, 2) + 180) % 360 - 180)
    a, b = [place() for _ in range(60)], [place() for _ in range(60)]
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(a)], "i long, lat double, lon double")
    right = spark.createDataFrame([(j, *p) for j, p in enumerate(b)], "j long, r_lat double, r_lon double")
    got = [(r.i, r.j) for r in spatial_join(left, right, 20.0).select("i", "j").collect()]
    assert sorted(got) == [(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if events._km(*p, *q) <= 20.0] and got
    tiled = left.select("i", geo.tile(left.lat, left.lon, 20.0).alias("t")).collect()
    assert all(events._km(*a[x.i], *a[y.i]) <= 20.0 for x in tiled for y in tiled if x.t == y.t)


@pytest.mark.parametrize("lat, lon", [(-33.0, 150.0), (66.0, 20.0), (10.0, 179.99)])
def test_association_equals_one_pass_anywhere(spark, lat, lon):
    rnd = random.Random(4)
    rows = [(i, lat + rnd.uniform(-0.1, 0.1), (lon + rnd.uniform(-0.005, 0.005) * (20 if lon < 179 else 1) + 180) % 360 - 180, i // 3) for i in range(150)]
    df = spark.createDataFrame(rows, "seq long, lat double, lon double, n int").withColumn("acq", F.timestamp_seconds("n"))
    got = {r.seq: r.event_seq for r in events.associate(df).collect()}
    if lon < 179:
        want = plain_association(df.toPandas(), 2.0)
        assert got == dict(zip(want.seq, want.event_seq, strict=True)) and len(set(got.values())) < 150
    assert len(got) == 150
