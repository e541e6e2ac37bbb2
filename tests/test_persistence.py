"""The persistence rule: fixed cases, and random frames against a plain statement of it."""

import math
import random

import pytest

from embergrid.config import PersistenceConfig
from embergrid.operators.persistence import persistence, persistence_stats

SCHEMA = "det_id long, frame_no long, lat double, lon double, confidence string"


def judge(spark, frames, cfg=PersistenceConfig()):
    """frames: per frame a list of (lat, lon, confidence); returns stats rows by frame."""
    rows, n = [], 0
    for f, dets in enumerate(frames):
        for lat, lon, conf in dets:
            rows.append((n, f, lat, lon, conf))
            n += 1
        if not dets:
            rows.append((None, f, None, None, None))
    judged = persistence(spark.createDataFrame(rows, SCHEMA), cfg)
    return {r.frame_no: r.asDict() for r in persistence_stats(judged).collect()}, judged


P = (-33.0, 150.0)
CASES = {
    "high bypasses": ([[(*P, "high")]], {}, {0: {"passed": 1, "bypassed": 1, "held": 0}}),
    "single is held": ([[(*P, "nominal")]], {}, {0: {"passed": 0, "held": 1}}),
    "two in a row": ([[(*P, "nominal")], [(*P, "nominal")]], {}, {1: {"promoted": 1, "persistent": 1, "passed": 2}}),
    "disappears": ([[(*P, "nominal")], [(-35.0, 152.0, "nominal")]], {}, {1: {"discarded": 1, "promoted": 0, "held": 1, "passed": 0}}),
    "near by": ([[(-33.0, 150.0, "nominal")], [(-33.02, 150.0, "nominal")]], {}, {1: {"promoted": 1, "persistent": 1}}),
    "far away": ([[(-33.0, 150.0, "nominal")], [(-33.5, 150.0, "nominal")]], {}, {1: {"discarded": 1, "held": 1}}),
    "frames one and three": ([[(*P, "nominal")], [], [(*P, "nominal")]], {}, {1: {"discarded": 1}, 2: {"persistent": 1, "passed": 1}}),
    "mixed": ([[(*P, "high"), (-34.0, 150.0, "low"), (-35.0, 150.0, "nominal")]], {}, {0: {"passed": 1, "bypassed": 1, "held": 2}}),
    "window slides": ([[(*P, "nominal")], [], [], [], [(*P, "nominal")]], {}, {4: {"persistent": 0, "held": 1, "passed": 0}}),
    "third frame before still counts": ([[(*P, "nominal")], [], [], [(*P, "nominal")]], {}, {3: {"persistent": 1, "passed": 1}}),
    "no bypass": ([[(*P, "high")]], {"bypass_high": False}, {0: {"passed": 0, "bypassed": 0, "held": 1}}),
    "one frame is enough": ([[(*P, "nominal")]], {"min_frames": 1}, {0: {"passed": 1, "persistent": 1}}),
    "two match one": ([[(*P, "low")], [(*P, "low"), (-33.01, 150.0, "low")]], {}, {1: {"promoted": 1, "persistent": 2, "passed": 3}}),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name, spark):
    frames, cfg, want = CASES[name]
    got, _ = judge(spark, frames, PersistenceConfig(**cfg))
    for frame, values in want.items():
        row = got.get(frame, {})
        assert {k: row.get(k, 0) for k in values} == values


def test_empty_table(spark):
    assert persistence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_window_must_hold_the_frames():
    with pytest.raises(ValueError, match="cannot exceed"):
        PersistenceConfig(window=2, min_frames=3)


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_random_frames_equal_plain_rule(spark):
    rnd = random.Random(5)
    frames = [[(-33 + rnd.random() * 0.3, 150 + rnd.random() * 0.3, rnd.choice(["low", "nominal", "high"])) for _ in range(rnd.randrange(0, 9))] for _ in range(12)]
    _, judged = judge(spark, frames)
    got = {r.det_id: (r.n_prior, r.outcome) for r in judged.collect()}
    n = 0
    for f, dets in enumerate(frames):
        for d in dets:
            prior = sum(any(km(d, o) <= 4.0 for o in frames[g]) for g in range(max(0, f - 3), f))
            nxt = f + 1 < len(frames) and any(km(d, o) <= 4.0 for o in frames[f + 1])
            last = max(g for g in range(len(frames)))
            outcome = "bypass" if d[2] == "high" else "persistent" if prior else "promoted" if nxt else "discarded" if f < last else "held"
            assert got[n] == (prior, outcome)
            n += 1


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from embergrid.streaming.jobs import persist_stream, read_frames

    rnd = random.Random(9)
    frames = [[(-33 + rnd.random() * 0.1, 150 + rnd.random() * 0.1, rnd.choice(["low", "nominal", "high"])) for _ in range(rnd.randrange(1, 4))] for _ in range(4)]
    rows, n = [], 0
    for f, dets in enumerate(frames):
        part = [(n + i, f, *d) for i, d in enumerate(dets)]
        n += len(dets)
        rows += part
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = persist_stream(read_frames(spark, str(tmp_path / "in")), str(tmp_path / "buffer"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("det_id", "emit_frame").collect()
    want = persistence(spark.createDataFrame(rows, SCHEMA)).where(F.col("emit_frame").isNotNull()).select("det_id", "emit_frame").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
