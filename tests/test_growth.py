"""Steps that must not grow faster than their input: the same results as all pairs, without sorting or repeating them."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from embergrid.config import FusionConfig
from embergrid.functions.geo import in_ellipse
from embergrid.operators import calibration, fusion, masks, merge, spatial, validate
from embergrid.operators import persistence as persist
from embergrid.operators.spatial import spatial_join
from embergrid.plans import catalog


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("lon", [150.0, 179.98])
def test_matches_by_tiles_equal_all_pairs(spark, lon):
    rng, t0 = random.Random(7), datetime(2024, 1, 1)
    wrap = lambda x: x - 360 if x > 180 else x
    truth = [(i, -33 + rng.uniform(-0.1, 0.1), wrap(lon + rng.uniform(-0.1, 0.1)), t0 + timedelta(days=2), 1.0, "D") for i in range(40)] + [(98, None, 150.0, t0, 1.0, "D"), (99, 10.0, 10.0, t0, 1.0, "N")]
    places = [(-33 + rng.uniform(-0.15, 0.15), wrap(lon + rng.uniform(-0.15, 0.15))) for _ in range(900)] + [(-33.01, lon)] * 600
    dets = [(i, a, b, t0 + timedelta(days=rng.randrange(4)), rng.choice(["contextual", "cusum", "both"]), 1) for i, (a, b) in enumerate(places)] + [(5000, None, lon, t0, "both", 1)]
    t = spark.createDataFrame(truth, "truth_id long, lat double, lon double, first_dt timestamp, frp double, daynight string")
    d = spark.createDataFrame(dets, "det_id long, r_lat double, r_lon double, obs_time timestamp, method string, level int")
    out = validate.match_truth(t, d)
    assert "min_by(" not in plan(out)  # a struct's least by struct has no buffer of fixed size: every pair was sorted for it
    for r in out.collect():
        lat, at = next((x[1], x[2]) for x in truth if x[0] == r.truth_id)
        met = [x for x in dets if lat is not None and x[1] is not None and km(lat, at, x[1], x[2]) <= 5.0]
        first = min(met, key=lambda x: (x[3], x[0]), default=None)
        want = (bool(met), first and first[3], first and first[4], sum(x[4] in ("contextual", "both") for x in met), sum(x[4] in ("cusum", "both") for x in met))
        assert (r.matched, r.our_first_dt, r.our_first_method, r.n_ctx_matches, r.n_cusum_matches) == want


def test_pairs_repeat_the_truth_alone(spark, sf):
    text = plan(catalog.QUERIES["haversine_pairs"](spark, sf))
    physical = text[text.index("== Physical Plan =="):]
    repeated = physical[physical.index("explode"):].split("Scan parquet")[1]
    assert "l_orderkey" not in repeated and "s_suppkey" in repeated


@pytest.mark.parametrize("places, join", [(75_000, "BroadcastHashJoin"), (-1, "SortMergeJoin")])
def test_all_pairs_come_cell_by_cell(spark, sf, monkeypatch, places, join):
    monkeypatch.setattr(spatial, "_BROADCAST_PLACES", places)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any larger size
    try:
        text = plan(catalog.QUERIES["haversine_pairs"](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    physical = text[text.index("== Physical Plan =="):]
    detections = physical[:physical.index("Scan parquet")]
    # of few places, the detections are sorted in their tasks, not shuffled
    assert join in physical and "Sort [__cy" in detections and ("Exchange hashpartitioning" in detections) == (places < 0)


@pytest.mark.parametrize("places", [75_000, -1])
@pytest.mark.parametrize("at", [(-33.0, 179.99), (70.0, -180.0), (89.98, 10.0), (-90.0, 0.0)])
def test_all_pairs_anywhere(spark, monkeypatch, at, places):
    monkeypatch.setattr(spatial, "_BROADCAST_PLACES", places)
    rng, nan = random.Random(23), float("nan")
    far = min(120.0, 0.2 / max(0.001, math.cos(math.radians(at[0]))))

    def place():
        return max(-90.0, min(90.0, at[0] + rng.uniform(-0.2, 0.2))), (at[1] + rng.uniform(-far, far) + 180) % 360 - 180

    left, right = [(i, *place()) for i in range(200)], [(i, *place()) for i in range(40)]
    left += [(i + 500, x[1], x[2]) for i, x in enumerate(right[:5])]  # the same places
    odd = [(900, None, at[1]), (901, at[0], None), (902, None, None), (903, nan, at[1]), (904, at[0], nan), (905, at[0], math.inf)]
    a, b = spark.createDataFrame(left + odd, "id long, lat double, lon double"), spark.createDataFrame(right + odd, "r_id long, r_lat double, r_lon double")
    out = spatial.pairs_within(a, b, 5.0)
    assert out.columns == ["id", "lat", "lon", "r_id", "r_lat", "r_lon"]
    want = sorted((x[0], y[0]) for x in left for y in right if km(*x[1:], *y[1:]) <= 5.0)
    assert want and sorted((r.id, r.r_id) for r in out.collect()) == want
    assert sorted((r.id, r.r_id) for r in spatial_join(a, b, 5.0).collect()) == want


def test_false_alarms_look_at_their_own_days(spark):
    t0 = datetime(2024, 1, 10, 6)
    hours = [-25, -24, -23, 0, 23, 24, 24.001, 49, None]
    d = spark.createDataFrame([(i, -33.0, 150.0, None if h is None else t0 + timedelta(hours=h)) for i, h in enumerate(hours)], "det_id long, lat double, lon double, obs_time timestamp")
    t = spark.createDataFrame([(-33.0, 150.01, t0), (-33.0, 150.01, None)], "r_lat double, r_lon double, r_dt timestamp")
    out = validate.false_alarms(d, t)
    assert out.columns == d.columns and "__rstep" in plan(out)
    assert sorted(r.det_id for r in out.collect()) == [0, 6, 7, 8]


def test_existence_is_settled_by_tiles_first(spark):
    rng, nan = random.Random(3), float("nan")
    left = [(i, rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3)) for i in range(400)] + [(900, None, 0.0), (901, nan, 0.0), (902, 0.01, 0.01), (902, 0.01, 0.01)]
    right = [(rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3)) for _ in range(30)] + [(None, 0.0), (nan, 0.0), (0.01, None), (0.011, 0.011)]
    a, b = spark.createDataFrame(left, "id long, lat double, lon double"), spark.createDataFrame(right, "r_lat double, r_lon double")
    ok = lambda v: v is not None and not math.isnan(v)
    near = sorted(x[0] for x in left if ok(x[1]) and any(ok(y[0]) and ok(y[1]) and km(x[1], x[2], *y) <= 5.0 for y in right))
    for how, want in (("left_semi", near), ("left_anti", sorted(x[0] for x in left if x[0] not in near))):
        out = spatial_join(a, b, 5.0, how)
        assert "__ty" in plan(out) and out.columns == a.columns
        assert sorted(r.id for r in out.collect()) == want


def test_nearest_of_a_crowd_equals_all_pairs(spark):
    rng = random.Random(5)
    c = [(f, 10 * i + f, -33 + rng.uniform(0, 0.06), 150 + rng.uniform(0, 0.06), "low") for f in (1, 2) for i in range(700)] + [(1, 90_000, -33.03, 150.5, "low"), (1, 80_000, -33.03, 150.5, "low")]
    t = [(f, 100_000 + 10 * i + f, -33 + rng.uniform(-0.03, 0.09), 150 + rng.uniform(-0.03, 0.09), "nominal") for f in (1, 2) for i in range(150)] + [(1, 200_001, -33.03, 150.519, "low"), (3, 200_003, -33.0, 150.0, "low")]
    names = "frame_id long, det_id long, lat double, lon double, confidence string"
    out = merge.merge_detections(spark.createDataFrame(c, names), spark.createDataFrame(t, names))
    got = {r.det_id: (r.confidence, r.method) for r in out.collect()}
    lifted, alone = set(), set()
    for f, i, la, lo, _ in t:
        best = min(((math.sqrt((la - x[2]) ** 2 + (lo - x[3]) ** 2), x[1]) for x in c if x[0] == f), default=(9, None))
        (lifted.add(best[1]) if best[0] <= 0.02 else alone.add(i))
    assert {i for i, (_, m) in got.items() if m == "temporal"} == alone and {i for i, (_, m) in got.items() if m == "both"} == lifted and 80_000 in lifted
    # a crowd's first look is a short one, so that few of the pairs within the distance are made
    grid = spark.createDataFrame([(i, 0, x[2], x[3]) for i, x in enumerate(c)], "row int, col int, r_lat double, r_lon double")
    near = calibration.nearest_pixel(spark.createDataFrame([(str(x[1]), x[2], x[3]) for x in t], "label string, lat double, lon double"), grid, 0.02)
    assert "step-" in plan(near)
    for r in near.collect():
        best = min((math.sqrt((r.lat - x[2]) ** 2 + (r.lon - x[3]) ** 2), i) for i, x in enumerate(c))
        assert r.row == (best[1] if best[0] <= 0.02 else None)


def test_repeated_ids_and_one_pass_of_statistics(spark):
    P = (-33.0, 150.0)
    rows = [(1, 0, *P, "low"), (2, 1, *P, "low"), (2, 3, *P, "low"), (3, 2, -40.0, 150.0, "low"), (2, 5, -20.0, 150.0, "low"), (None, 6, None, None, None)]
    judged = persist.persistence(spark.createDataFrame(rows, "det_id long, frame_no long, lat double, lon double, confidence string"))
    got = sorted((r.det_id, r.frame_no, r.n_prior, r.outcome) for r in judged.collect())
    # id 2 met frame 0 from frame 1 and frames 0 and 1 from frame 3
    assert got == [(1, 0, 0, "promoted"), (2, 1, 2, "persistent"), (2, 3, 2, "persistent"), (2, 5, 2, "persistent"), (3, 2, 0, "discarded")]
    scans = lambda df: plan(df).split("== Physical Plan ==")[1].count("Scan ExistingRDD")
    stats = persist.persistence_stats(judged)
    assert scans(stats) <= scans(judged)
    assert {r.frame_no: (r.received, r.held, r.promoted, r.discarded, r.passed) for r in stats.collect()} == {0: (1, 1, 0, 0, 0), 1: (1, 0, 1, 0, 2), 2: (1, 1, 0, 0, 0), 3: (1, 0, 0, 1, 1), 5: (1, 0, 0, 0, 1)}


def test_sites_by_cells_equal_all_ellipses(spark):
    rng, sites = random.Random(11), masks.INDUSTRIAL_SITES
    rows = [(i, *(s + rng.uniform(-0.06, 0.06) for s in sites[i % len(sites)])) for i in range(2000)] + [(-1, None, 150.0), (-2, -33.0, None), (-3, float("nan"), 150.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    want = F.lit(False)
    for lat, lon in sites:
        want = want | in_ellipse(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon), masks.INDUSTRIAL_KM)
    out = masks.industrial(df)
    assert out.columns == [*df.columns, "is_industrial"] and plan(out).count("POWER") < 20
    assert sorted(map(str, out.collect())) == sorted(map(str, df.withColumn("is_industrial", want).collect()))


def test_refinement_sorts_no_pairs(spark, sf):
    rng, t0 = random.Random(13), datetime(2024, 1, 1)
    place = lambda: (-33 + rng.randrange(6) * 0.004, 150 + rng.randrange(6) * 0.004)  # noqa: E731 - many equal distances
    coarse = spark.createDataFrame([(i, *place(), t0 + timedelta(minutes=rng.randrange(900))) for i in range(60)], "seq long, lat double, lon double, acq timestamp")
    fine = spark.createDataFrame([(i, *place(), t0 + timedelta(minutes=rng.randrange(900)), rng.choice(["FIRMS", "DEA", "HIMAWARI"])) for i in range(200)], "r_seq long, r_lat double, r_lon double, r_acq timestamp, r_source string")
    cfg = FusionConfig()
    pairs = fusion.cross_resolution(coarse, fine, cfg).collect()
    for r in fusion.match_and_refine(coarse, fine, cfg).collect():
        mine = [p for p in pairs if p.seq == r.seq]
        best = min(mine, key=lambda p: (p.km, p.r_acq, p.r_seq), default=None)
        assert (r.match_seq, r.n_sources) == (best and best.r_seq, len({p.r_source for p in mine}))


@pytest.mark.parametrize("path", ["broadcast", "shuffled"])
@pytest.mark.parametrize("at", [(0.0, 0.0), (-33.0, 179.99), (70.0, -180.0), (89.98, 10.0), (-90.0, 0.0)])
def test_existence_equals_all_pairs_anywhere(spark, monkeypatch, at, path):
    rng = random.Random(17)
    far = min(120.0, 0.2 / max(0.001, math.cos(math.radians(at[0]))))

    def place():
        lat, lon = max(-90.0, min(90.0, at[0] + rng.uniform(-0.2, 0.2))), at[1] + rng.uniform(-far, far)
        return lat, rng.choice([lon, (lon + 180) % 360 - 180])  # beyond 180 degrees, too

    left, right = [(i, *place()) for i in range(300)], [place() for _ in range(12)]
    left += [(900, 0.0, math.inf), (901, None, None)]
    right += [(0.0, math.inf), (None, 0.0)]
    a, b = spark.createDataFrame(left, "id long, lat double, lon double"), spark.createDataFrame(right, "r_lat double, r_lon double")
    near = {x[0] for x in left[:300] if any(km(x[1], x[2], *y) <= 5.0 for y in right[:12])}
    assert near
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if path == "shuffled":
        monkeypatch.setattr(spatial, "_BROADCAST_ROWS", -1)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how, want in (("left_semi", near), ("left_anti", {x[0] for x in left} - near)):
            out = spatial_join(a, b, 5.0, how)
            assert ("BroadcastHashJoin" in plan(out)) == (path == "broadcast")
            assert sorted(r.id for r in out.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("query", ["spatial_anti_join", "spatial_semi_join"])
def test_existence_is_one_pass_without_pairs(spark, sf, query):
    text = plan(catalog.QUERIES[query](spark, sf))
    physical = text[text.index("== Physical Plan =="):]
    detections = [x for x in physical.splitlines() if "Scan parquet" in x and "l_orderkey" in x]
    # detections are read once, meet one table, and no filter works their tiles out again
    assert len(detections) == 1 and physical.count("BroadcastHashJoin") == 1
    assert "DataFilters: []" in detections[0] and "explode" not in physical


def test_crowds_of_right_rows_leave_few_lists(spark):
    """Sixteen times the right rows in the same area: of the table that the left rows meet, only the lists around the area grow."""
    rng, sizes, left = random.Random(19), [], spark.createDataFrame([(0, 0.0, 0.0)], "id long, lat double, lon double")
    for n in (1000, 16000):
        right = spark.createDataFrame([(rng.uniform(-0.5, 0.5), rng.uniform(-0.5, 0.5)) for _ in range(n)], "r_lat double, r_lon double")
        path = spatial_join(left, right, 5.0, "left_anti").inputFiles()
        sizes.append(spark.read.parquet(*[p for p in path if "step-" in p]).count())
    assert sizes[1] < 4 * sizes[0]
