"""Calendar windows on the days of a change of clocks, and interaction features by hand."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from embergrid.operators import report
from embergrid.operators.interaction import interaction_features


@pytest.mark.parametrize("day,hours", [("2024-04-07", 25), ("2024-10-06", 23), ("2024-06-01", 24)])
def test_report_windows_over_a_change_of_clocks(spark, day, hours):
    """The window of the day holds each of its half hours once, and its ends are 19:50 in Sydney."""
    noon = datetime.fromisoformat(f"{day}T02:00:00").replace(tzinfo=UTC)
    times = [(noon + timedelta(minutes=30 * k),) for k in range(-60, 60)]
    df = spark.createDataFrame([*times, (None,)], "t timestamp").select("t", report.report_window(F.col("t")).alias("w"))
    rows = [r for r in df.select("t", "w.*").collect() if str(r.report_date) == day]
    start, end = rows[0].from_utc, rows[0].to_utc
    assert len({(r.from_utc, r.to_utc) for r in rows}) == 1 and end - start == timedelta(hours=hours)
    inside = [t.replace(tzinfo=None) for (t,) in times if start <= t.replace(tzinfo=None) < end]
    assert len(inside) == len(rows) == 2 * hours
    edges = spark.createDataFrame([(start.replace(tzinfo=UTC),), (end.replace(tzinfo=UTC),), (end.replace(tzinfo=UTC) - timedelta(microseconds=1),)], "t timestamp")
    assert [str(r.d) == day for r in edges.select(report.report_window(F.col("t"))["report_date"].alias("d")).collect()] == [True, False, True]
    assert df.where("t is null").first().w is None


def test_interaction_features(spark):
    grid = {0: [[10, 10], [10, 10]], 1: [[10, 10], [10, 13]], 4: [[9, 9], [9, 20]], 9: [[9, 9], [9, None]]}
    rows = [(f, r, c, v) for f, g in grid.items() for r, line in enumerate(g) for c, v in enumerate(line)]
    got = {(r.frame_id, r.row, r.col): r for r in interaction_features(spark.createDataFrame(rows, "frame_id long, row int, col int, btd int")).collect()}
    hot = got[4, 1, 1]
    assert (hot.n_near, hot.anomaly, hot.gradient) == (3, 11.0, 11.0)
    assert (hot.anomaly_trend, hot.gradient_change, hot.diverging) == (8.0, 8.0, True)  # frame 1 lies in the last three, frame 0 does not
    first = got[0, 0, 0]
    assert (first.anomaly, first.anomaly_trend, first.gradient_change, first.diverging) == (0.0, None, None, None)
    assert got[4, 0, 0].diverging is False  # it cools while its neighbours warm
    gap = got[9, 1, 1]
    assert (gap.n_near, gap.anomaly, gap.gradient) == (None, None, None) and got[9, 0, 0].n_near == 2
