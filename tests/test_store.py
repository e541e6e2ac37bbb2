"""Versioned tables: upserts, killed writes, repeated batches, replays that stop and go on."""

import pytest
from pyspark.sql import functions as F

from embergrid.config import CusumConfig
from embergrid.operators import cusum
from embergrid.sources.store import VersionedTable
from embergrid.streaming.jobs import replay

SCHEMA = "id long, v string"


@pytest.fixture
def store(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, "id", buckets=4)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upserts_make_versions(spark, store):
    of = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert rows(store.read()) == [] and store.last_batch() is None
    assert store.upsert(of(*((i, "a") for i in range(9)), (None, "n")), 0)
    assert store.upsert(of((3, "b"), (20, "c"), (None, "m")), 1)
    want = sorted([*((i, "b" if i == 3 else "a") for i in range(9)), (20, "c"), (None, "m")], key=str)
    assert rows(store.read()) == want and rows(store.read(1)) == sorted([*((i, "a") for i in range(9)), (None, "n")], key=str)
    assert not store.upsert(of((3, "again")), 1) and not store.upsert(of((3, "again")), 0) and rows(store.read()) == want  # ran again
    assert store.upsert(of((3, "other")), 0, writer="other") and store.last_batch() == 1 and store.last_batch("other") == 0
    assert store.upsert(of(), 2) and store.versions() == [1, 2, 3, 4]
    assert store.upsert(of((7, "x"), (7, "z"), (7, "y")), 3, order=[F.desc("v")]) and (7, "z") in rows(store.read())
    now = rows(store.read())
    assert store.vacuum(1) > 0 and store.versions() == [5] and rows(store.read()) == now and store.vacuum(1) == 0


def test_only_touched_buckets_are_written(spark, store):
    store.upsert(spark.createDataFrame([(i, "a") for i in range(40)], SCHEMA), 0)
    before = store._manifest(1)["folders"]
    store.upsert(spark.createDataFrame([(5, "b")], SCHEMA), 1)
    after = store._manifest(2)["folders"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1


@pytest.mark.parametrize("where", ["write", "publish"])
def test_a_killed_write_leaves_the_old_version(spark, store, monkeypatch, where):
    store.upsert(spark.createDataFrame([(1, "a"), (2, "a")], SCHEMA), 0)
    bad = spark.createDataFrame([(1, "b"), (3, "b")], SCHEMA)
    if where == "write":
        fails = F.udf(lambda x: 1 / 0)
        with pytest.raises(Exception):
            store.upsert(bad.withColumn("v", fails("v")), 1)
    else:
        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            m.setattr(store, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
            store.upsert(bad, 1)
    assert rows(store.read()) == [(1, "a"), (2, "a")] and store.versions() == [1]
    assert store.upsert(bad, 1) and rows(store.read()) == [(1, "b"), (2, "a"), (3, "b")]  # the batch runs again


def test_two_writers_of_one_version(spark, store):
    store.upsert(spark.createDataFrame([(1, "a")], SCHEMA), 0)
    with pytest.raises(RuntimeError):
        store._publish(1, {"folders": {}, "writers": {}, "buckets": 4})
    assert rows(store.read()) == [(1, "a")]


def test_a_replay_that_stops_and_goes_on_equals_one_run(spark, tmp_path):
    cfg = CusumConfig(min_clear=2)
    px = [(r * 4 + c, f, r, c, 147.0, 600.0 * f, 3.0 + (8.0 if f > 3 and r < 2 else 0.1 * f), 285.0 + f % 3, (r + f) % 5 != 0, True, False) for f in range(8) for r in range(3) for c in range(4) if (f, r) != (5, 2)]
    df = spark.createDataFrame(px, "pixel_id long, frame_id long, row int, col int, lon double, t double, btd double, bt14 double, clear boolean, is_day boolean, suppressed boolean")
    names = ("pixel_id", "frame_id", "s_slow", "n_obs", "candidate")
    one = f"file://{tmp_path}/one"
    assert replay(df, one, cfg) == 8
    two = f"file://{tmp_path}/two"
    assert replay(df.where("frame_id < 5"), two, cfg, most=3) == 3 and replay(df.where("frame_id < 5"), two, cfg) == 2
    assert replay(df, two, cfg) == 3 and replay(df, two, cfg) == 0
    found = [rows(spark.read.parquet(f"{at}/out").select(*names)) for at in (one, two)]
    assert found[0] == found[1] == rows(cusum.run_tiles(df, cfg).select(*names))
    states = [rows(VersionedTable(spark, f"{at}/state", cusum.STATE, "pixel_id").read().select("pixel_id", "s_slow", "n_obs", "var_count")) for at in (one, two)]
    assert states[0] == states[1] and len(states[0]) == 12
