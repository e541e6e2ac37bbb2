"""Folds by scans of ranges against one pass over each key."""

import math
import random

import numpy as np
import pytest

from embergrid.operators import cusum, scans


@pytest.fixture(scope="module")
def series():
    rnd = random.Random(6)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.randrange(0, 40_000), rnd.randrange(3), rnd.choice([-1.0, 0.25, 2.0]), rnd.random() < 0.7) for _ in range(600)]
    return rows + [(4, 100, 0, 1.0, True)] * 30 + [(5, 7, 1, -3.0, False)]


def in_order(rows, key):
    return sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])


@pytest.mark.parametrize("partitions,batch", [(1, 10_000), (7, 10_000), (7, 5), (40, 3)])
def test_folds_equal_one_pass(spark, series, partitions, batch):
    """Keys that go over many ranges and Arrow batches, equal rows, out-of-order input, null keys."""
    tied = {}  # rows of one time and number in any order would differ: keep one value for each
    rows = [tied.setdefault(r[:3], r) for r in series]
    df = spark.createDataFrame(rows, "k long, t long, ord long, z double, clear boolean").repartition(5)
    for c, v in (("spark.sql.shuffle.partitions", partitions), ("spark.sql.execution.arrow.maxRecordsPerBatch", batch), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(c, v)
    try:
        decay = {r.k: (r.s, r.n) for r in cusum.decay_fold(df, "k", 0.5).collect()}
        ema = {r.k: r.ema for r in cusum.ema_fold(df, "k", "z", 0.125).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(decay) == set(ema) == {1, 2, 3, 4, 5, None}
    for k in decay:
        mine, s, last, mean = in_order(rows, k), 0.0, None, None
        for _, t, _, z, clear in mine:
            s = max(0.0, s + z - 0.5) if clear else s * math.exp(-max(t - (t if last is None else last), 0) / 10_800)
            last, mean = t, z if mean is None else mean + 0.125 * (z - mean)
        assert decay[k] == (pytest.approx(s), len(mine)) and ema[k] == pytest.approx(mean)


def test_steps_compose_in_any_grouping():
    rnd = np.random.default_rng(3)
    steps = (rnd.random(50), rnd.normal(size=50), np.where(rnd.random(50) < 0.5, rnd.normal(size=50), -np.inf))
    start = np.array([0] * 20 + [20] * 29 + [49])
    got = scans.compose(steps, start)
    for i in range(50):
        x = 1.5
        for j in range(start[i], i + 1):
            x = max(steps[2][j], steps[0][j] * x + steps[1][j])
        assert max(got[2][i], got[0][i] * 1.5 + got[1][i]) == pytest.approx(x)


def test_empty(spark):
    none = spark.createDataFrame([], "k long, t long, ord long, z double, clear boolean")
    assert cusum.decay_fold(none, "k", 0.5).count() == 0 == cusum.ema_fold(none, "k", "z", 0.5).count()
