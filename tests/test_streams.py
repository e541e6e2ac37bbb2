"""Streams against their batch operators, across restarts."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from embergrid.operators import events, lifecycle
from embergrid.streaming import lifecycle as stream

START = datetime(2024, 1, 1)


def batch_status(spark, rows, as_of):
    """Statuses of all detections at once, by the batch operators."""
    df = spark.createDataFrame([(e, i, 0.0, 0.0, t, s, "low", None) for i, (e, t, s) in enumerate(rows)], "event_seq long, seq long, lat double, lon double, acq timestamp, source string, confidence string, frp double")
    ev = events.rollup(df)
    silent = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("latest_detection_time")
    out = lifecycle.transitions(ev.withColumn("missed_frames", F.floor(silent / 600_000_000)), F.lit(as_of))
    return {r.event_seq: (r.status, r.n_passes) for r in out.collect()}


def test_lifecycle_stream_ends_as_the_batch_does_across_restarts(spark, tmp_path):
    rnd = random.Random(3)
    at = lambda m: START + timedelta(minutes=m)
    rows = [(rnd.randrange(25), at(40 * k + rnd.randrange(50)), rnd.choice(["DEA", "FIRMS", "HIMAWARI"])) for k in range(90)]  # in time order but for the delay
    end = rows[-1][1]
    for e, before in ((100, 12 * 60), (101, 6 * 60), (102, 60), (103, 6 * 60 - 1), (104, 12 * 60 - 1)):  # silent just long enough, and not
        rows.insert(0, (e, end - timedelta(minutes=before), "DEA"))
    rows += [(105, end - timedelta(minutes=5), "DEA"), (105, end - timedelta(minutes=4), "FIRMS")]
    rows = sorted(rows, key=lambda r: (r[1] + timedelta(minutes=rnd.randrange(55)), r[0])) + [(200, max(r[1] for r in rows) + timedelta(hours=1), "DEA")]
    files = [rows[:30], rows[30:60], rows[60:61], rows[61:]]
    src, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    for part in files:
        spark.createDataFrame(part, stream.DETECTIONS).coalesce(1).write.mode("append").parquet(src)
        read = spark.readStream.schema(stream.DETECTIONS).parquet(src)
        stream.lifecycle_stream(read, out, check).awaitTermination()  # stops and goes on each time
    got = {r.event_seq: (r.status, r.n_passes) for r in stream.lifecycle_now(spark, out).collect()}
    assert got == batch_status(spark, rows, max(r[1] for r in rows) - timedelta(hours=1))
    assert {"RETRACTED", "CLOSED", "MONITORING", "LIKELY"} <= {s for s, _ in got.values()}
