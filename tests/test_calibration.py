"""Single series, heat map, forest and small sources against plain restatements."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from embergrid.config import CusumConfig
from embergrid.operators import calibration, classify
from embergrid.plans import catalog
from embergrid.sources import feeds


def plain_series(rows, cfg):
    """One target by plain algebra, row after row."""
    x, p = np.zeros(5), np.diag(cfg.start_variance[:5]).astype(float)
    total, learned, out = 0.0, 0, []
    for t, btd, cloud, day, lon in sorted(rows, key=lambda r: r[0]):
        if cloud != 0 or btd is None or math.isnan(btd):
            out.append((t, None, None, None, round(total, 3)))
            continue
        w = 2 * math.pi / 24 * ((t.hour + t.minute / 60 + lon / 15) % 24)
        h = np.array([1, math.cos(w), math.sin(w), math.cos(2 * w), math.sin(2 * w)])
        p = p + np.diag(np.square(cfg.process_std[:5]))
        spread = max(h @ p @ h + (cfg.noise.day if day else cfg.noise.night), 1e-6)
        expected = float(h @ x)
        z = (btd - expected) / math.sqrt(spread)
        total = max(0.0, total + z - cfg.k_slow) if learned >= cfg.min_clear else 0.0
        out.append((t, round(expected, 3), round(btd - expected, 3), round(z, 3), round(total, 3)))
        if abs(z) < 2.0:
            gain = p @ h / spread
            x, p, learned = x + gain * (btd - expected), p - np.outer(gain, h) @ p, learned + 1
    return out


def test_series_equal_plain_algebra(spark):
    rnd, start, rows = random.Random(17), datetime(2024, 1, 1), []
    for k in range(7):
        for i in range(139 if k == 3 else rnd.randrange(1, 140)):
            hot = 6.0 if k == 3 and i > 100 else 0.0
            rows.append((f"t{k}", start + timedelta(minutes=10 * i), rnd.choice([None, float("nan")]) if rnd.random() < 0.1 else 3 + rnd.gauss(0, 0.4) + hot, int(rnd.random() < 0.2), i % 144 < 72, 147.0 + k))
    cfg = CusumConfig(min_clear=20)
    df = spark.createDataFrame(rows, "label string, obs_time timestamp, btd double, cloud_flag int, is_day boolean, lon double")
    got = {}
    for r in calibration.follow_targets(df, cfg, together=3).collect():
        got.setdefault(r.label, []).append((r.obs_time, *(None if v is None or math.isnan(v) else v for v in (r.btd_predicted, r.residual, r.z_score)), r.cusum_s))
    raised = 0
    for k in range(7):
        want = plain_series([r[1:] for r in rows if r[0] == f"t{k}"], cfg)
        mine = sorted(got[f"t{k}"])
        assert len(mine) == len(want)
        for a, b in zip(mine, want, strict=True):
            assert a[0] == b[0] and all((x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=2e-3)) for x, y in zip(a[1:], b[1:], strict=True))
        raised += max(r[4] for r in want) > 10
    assert raised == 1
    assert calibration.follow_targets(df.limit(0), cfg).count() == 0


def test_calibration_query_equals_plain_algebra(spark, sf):
    rows = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "value", "event_type").collect():
        z = math.floor(r.value * 2 + 0.5) - 100
        rows.setdefault(str(r.user_id), []).append((datetime(1970, 1, 1) + timedelta(seconds=r.t), z / 100, int(r.event_type == "error"), r.event_id % 2 == 0, 147.0))
    got = {}
    for r in catalog.QUERIES["calibration_series"](spark, sf).collect():
        got.setdefault(r.label, []).append((r.obs_time, r.z_score, r.cusum_s))
    assert set(got) == set(rows)
    for k, mine in got.items():
        if len({r[0] for r in rows[k]}) == len(rows[k]):  # else rows of one second come in any order
            for a, b in zip(sorted(mine, key=lambda r: r[0]), plain_series(rows[k], CusumConfig()), strict=True):
                assert a[2] == pytest.approx(b[4], abs=2e-3) and (b[3] is None or a[1] == pytest.approx(b[3], abs=2e-3))


def test_heat_map_shows_the_model_s_probabilities(spark):
    d = "/root/testdata/sf0.01"
    rows = [r for r in catalog._kalman_frames(spark, d).select("row", "col", "confidence", "s_slow", "s_fast").collect() if r.confidence is not None and r.confidence >= 0.00001]
    want = sorted((r.row, r.col, round(r.confidence, 4), round(r.s_slow, 2), round(r.s_fast, 2)) for r in rows)
    got = sorted(map(tuple, catalog.QUERIES["cusum_heatmap"](spark, d).collect()))
    assert len(got) == len(want) > 0 and all(a == pytest.approx(b, abs=0.011) for a, b in zip(got, want, strict=True))


def test_forest_tells_held_out_fires(spark):
    """Fires exceed their background in two bands at once; either alone is weather."""
    rnd = random.Random(20)
    rows = []
    for i in range(1600):
        hot, wide = rnd.random() < 0.5, rnd.random() < 0.5
        x1, x3 = rnd.gauss(3 if hot else -3, 1), rnd.gauss(3 if wide else -3, 1)
        rows.append((i, x1, x1 + rnd.gauss(0, 0.5), x3, rnd.gauss(0, 1), int(hot and wide) if i % 50 else None))
    df = spark.createDataFrame(rows, "i long, x1 double, x2 double, x3 double, x4 double, label int")
    model = classify.fit_forest(df.where("i % 4 != 0"), classify.CONTEXT, trees=20, depth=8)
    held = df.where("i % 4 = 0 and label is not null")
    got = classify.forest_scores(held, model).collect()
    assert len(got) == held.count() and sum(r.predicted == r.label for r in got) > 0.97 * len(got)
    odd = spark.createDataFrame([(1, None, 1.0, 1.0, 1.0)], "i long, x1 double, x2 double, x3 double, x4 double")
    assert [(r.score, r.predicted) for r in classify.forest_scores(odd, model).collect()] == [(None, None)]
    assert classify.fit_forest(df.where("label = 1"), classify.CONTEXT) is None and classify.fit_forest(df.limit(0), classify.CONTEXT) is None
    assert [(r.score, r.predicted) for r in classify.forest_scores(odd, None).collect()] == [(None, None)]


def test_forest_learns_the_contextual_verdict(spark):
    rows = catalog.QUERIES["forest_verdicts"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out and r.score is not None]
    assert len(held) > 10 and sum(r.predicted == r.label for r in held) > 0.85 * len(held)


def test_recent_frames_and_stored_weather(spark, tmp_path):
    frames = spark.createDataFrame([("20260101_0000",), ("20260101_0010",), ("20260101_0020",), ("20260101_0040",)], "frame string")
    done = spark.createDataFrame([("20260101_0020",)], "frame string")
    got = [r.frame for r in feeds.recent_frames(frames, done, "2026-01-01 00:30:00", 20).collect()]
    assert got == ["20260101_0010"]
    (tmp_path / "w.csv").write_text("date,lat,lon,elevation_m,target_label,max_temp,max_temp_source\n2026-01-01,-33.1,150.2,10,a,30.5,25\nbad,-33.1,150.2,10,a,,x\n")
    rows = feeds.read_point_csv(spark, str(tmp_path / "w.csv"), ("max_temp", "radiation")).collect()
    assert [(str(r.date), r.code, r.value, r.source) for r in rows] == [("2026-01-01", "max_temp", 30.5, 25), ("2026-01-01", "radiation", None, None), ("None", "max_temp", None, None), ("None", "radiation", None, None)]
