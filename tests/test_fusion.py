"""Fusion of sensors against one pass over all detections, and matches against all pairs."""

import math
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from embergrid.config import FusionConfig
from embergrid.operators import events, fusion

CFG, START = FusionConfig(), datetime(2024, 1, 1)
SCHEMA = "seq long, lat double, lon double, acq timestamp, source string"


def shared_area(d, r, s):
    if d >= r + s:
        return 0.0
    if d <= abs(r - s):
        return math.pi * min(r, s) ** 2
    a, b = math.acos((d * d + r * r - s * s) / (2 * d * r)), math.acos((d * d + s * s - r * r) / (2 * d * s))
    return r * r * (a - math.sin(2 * a) / 2) + s * s * (b - math.sin(2 * b) / 2)


def one_pass(rows):
    live, name = {}, {}
    merged = 0
    for seq, lat, lon, acq, source in sorted(rows, key=lambda r: (r[3], r[0])):
        live = {k: e for k, e in live.items() if e["latest"] >= acq - timedelta(days=5)}
        coarse = source == "HIMAWARI"
        near = [(d, -e["latest"].timestamp(), k) for k, e in live.items() if (d := events._km(lat, lon, e["lat"], e["lon"])) < (5 if coarse else 2)]
        own = 4.0 if coarse else 2.0
        if near:
            k = min(near)[2]
            e, n = live[k], live[k]["n"]
            e |= {"lat": (e["lat"] * n + lat) / (n + 1), "lon": (e["lon"] * n + lon) / (n + 1), "n": n + 1, "latest": acq, "unc": min(e["unc"], own), "of": [*e["of"], seq]}
        else:
            k, e = seq, {"lat": lat, "lon": lon, "n": 1, "latest": acq, "unc": own, "of": [seq]}
            live[k] = e
        with_it = sorted((events._km(e["lat"], e["lon"], o["lat"], o["lon"]), -o["latest"].timestamp(), j) for j, o in live.items() if j != k and shared_area(events._km(e["lat"], e["lon"], o["lat"], o["lon"]), e["unc"], o["unc"]) > math.pi * min(e["unc"], o["unc"]) ** 2 / 2)
        del live[k]
        for _, _, j in with_it:
            o, merged = live.pop(j), merged + 1
            n = e["n"] + o["n"]
            e |= {"lat": (e["lat"] * e["n"] + o["lat"] * o["n"]) / n, "lon": (e["lon"] * e["n"] + o["lon"] * o["n"]) / n, "n": n, "unc": min(e["unc"], o["unc"]), "of": e["of"] + o["of"]}
            k = min(k, j)
        live[k] = e
        name |= {s: k for s in e["of"]}
    return name, merged


@pytest.mark.parametrize("lat,lon", [(-33.0, 150.0), (62.0, 20.0), (-88.0, -100.0)])
def test_fusion_equals_one_pass(spark, lat, lon):
    rnd = random.Random(int(lat))
    wide = 1 / max(0.05, math.cos(math.radians(lat)))
    rows = [(i * 7 % 401, lat + rnd.uniform(-0.15, 0.15), lon + rnd.uniform(-0.15, 0.15) * wide, START + timedelta(minutes=rnd.randrange(60 * 24 * 60)), rnd.choice(["HIMAWARI", "FIRMS", "DEA"])) for i in range(400)]
    rows += [(500 + i, lat, lon, START + timedelta(days=5 * i), "DEA") for i in range(3)] + [(510 + i, lat + 1, lon, START + timedelta(days=5.001 * i), "DEA") for i in range(3)]
    want, merged = one_pass(rows)
    got = {r.seq: r.event_seq for r in fusion.fuse(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and merged > 5 and len(set(want[510 + i] for i in range(3))) == 3


def test_fusion_across_the_antimeridian_and_odd_rows(spark):
    at = lambda m: START + timedelta(minutes=m)
    rows = [(1, 0.0, 179.999, at(0), "DEA"), (2, 0.0, -179.999, at(3), "DEA"), (3, None, 1.0, at(1), "DEA"), (4, 1.0, 1.0, None, "DEA"), (5, 1.0, 1.0, at(1), None), (5, 1.0, 1.0, at(1), None)]
    got = [(r.seq, r.event_seq) for r in fusion.fuse(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == [(1, 1), (2, 1), (3, None), (4, None), (5, 5), (5, 5)]
    assert fusion.fuse(spark.createDataFrame([], SCHEMA)).count() == 0


def test_half_covered_is_half_and_less_than_the_greater_radius():
    for r, s in ((4.0, 4.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0)):
        d = fusion.half_covered_km(r, s)
        assert shared_area(d, r, s) == pytest.approx(math.pi * min(r, s) ** 2 / 2) and d < max(r, s)


def test_matches_equal_all_pairs(spark):
    rnd = random.Random(5)
    place = lambda i: (i, -33 + rnd.uniform(-0.05, 0.05), 150 + rnd.uniform(-0.05, 0.05), START + timedelta(minutes=rnd.randrange(3000)))
    coarse = [place(i) for i in range(60)] + [(98, -33.0, 150.0, START), (99, None, 150.0, START)]
    fine = [(*place(i), rnd.choice(["DEA", "FIRMS", "OTHER", None])) for i in range(120)]
    fine += [(200, -33.0, 150.0, START + timedelta(hours=3), "DEA"), (201, -33.0, 150.0, START - timedelta(hours=6), "FIRMS"), (202, -33.0, 150.0, START + timedelta(hours=3, seconds=1), "DEA"), (203, -33.0, 150.0, None, "DEA")]
    left = spark.createDataFrame(coarse, "seq long, lat double, lon double, acq timestamp")
    right = spark.createDataFrame(fine, "r_seq long, r_lat double, r_lon double, r_acq timestamp, r_source string")
    pairs = fusion.cross_resolution(left, right)
    limit = {"DEA": 3, "FIRMS": 6}
    want = {(a[0], b[0]) for a in coarse for b in fine if None not in (*a, *b) and b[4] in limit and abs(b[3] - a[3]) <= timedelta(hours=limit[b[4]]) and events._km(*a[1:3], *b[1:3]) < 2.0}
    assert {(r.seq, r.r_seq) for r in pairs.collect()} == want and pairs.count() == len(want) and {(98, 200), (98, 201)} <= want and not {(98, 202), (98, 203)} & want
    got = {r.seq: r for r in fusion.refine(left, pairs).collect()}
    assert len(got) == 62 and got[99].match_seq is None and got[99].uncertainty_km == 4.0
    for a in coarse[:-1]:
        best = min(((events._km(*a[1:3], *b[1:3]), b[3], b[0]) for b in fine if (a[0], b[0]) in want), default=None)
        assert (got[a[0]].match_seq, got[a[0]].uncertainty_km) == ((best[2], 2.0) if best else (None, 4.0))


def test_recent_detections(spark):
    now = datetime(2024, 1, 2, tzinfo=UTC)
    df = spark.createDataFrame([(1, now - timedelta(hours=24)), (2, now - timedelta(hours=24, seconds=1)), (3, now + timedelta(hours=1)), (4, None)], "seq long, acq timestamp")
    assert sorted(r.seq for r in events.recent(df, F.lit(now)).collect()) == [1, 3]
    for hours in (0, 169):
        with pytest.raises(ValueError):
            events.recent(df, F.lit(now), hours)
