"""The lifecycle of events as a stream: status by ladder and silence, with event-time timers."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from embergrid.config import EventConfig

DETECTIONS = "event_seq long, acq timestamp, source string"
CHANGES = "event_seq long, status string, n_passes int, n_sources int, latest long, turn long"
_STATE = "passes int, began bigint, pending array<bigint>, sources array<string>, latest bigint, turn bigint"
_HOUR = 3_600_000_000


class Lifecycle(StatefulProcessor):
    """One event: passes and sources so far, its last detection, and timers for what its silence will make of it.

    Times after the watermark stay pending, as earlier ones may still come between them; the others are folded into the
    number of passes and the start of the last one, so that what is held is bounded by the watermark's delay.
    """

    def __init__(self, gap_minutes: int, retract_hours: int, close_hours: int, missed_frames: int, frame_minutes: int):
        self.gap, self.retract, self.close_after = gap_minutes * 60_000_000, retract_hours * _HOUR, close_hours * _HOUR
        self.missed = missed_frames * frame_minutes * 60_000_000
        self.waits = (_HOUR + 1, max(self.retract, self.missed), self.close_after)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.event = handle, handle.getValueState("event", _STATE)

    def _fold(self, passes: int, began: int | None, times: list[int]) -> tuple[int, int | None]:
        for t in times:
            if began is None or t - began > self.gap:
                passes, began = passes + 1, t
        return passes, began

    def _status(self, passes: int, sources: int, silent: int) -> str:
        status = "CONFIRMED" if passes >= 3 else "LIKELY" if sources >= 2 or passes >= 2 else "PROVISIONAL"
        if status == "PROVISIONAL" and silent >= max(self.retract, self.missed):
            return "RETRACTED"
        if silent >= self.close_after:
            return "CLOSED"
        return "MONITORING" if status == "CONFIRMED" and silent > _HOUR else status

    def _told(self, key, passes, began, pending, sources, latest, turn, now):
        """Store the event and give its row as of the watermark."""
        done = [t for t in pending if t <= now]
        passes, began = self._fold(passes, began, done)
        pending = pending[len(done) :]
        self.event.update((passes, began, pending, sources, latest, turn + 1))
        n = self._fold(passes, began, pending)[0]
        return Row(event_seq=key[0], status=self._status(n, len(sources), now - latest), n_passes=n, n_sources=len(sources), latest=latest, turn=turn + 1)

    @staticmethod
    def _timer(at: int) -> int:
        """The timer (in milliseconds) that goes off once the watermark has reached ``at``: timers do when it is behind them."""
        return -(-at // 1000) - 1

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.event.get()
        passes, began, pending, sources, latest, turn = held if held else (0, None, [], [], None, 0)
        rows = list(rows)
        pending, sources = sorted([*pending, *(r.micros for r in rows)]), sorted({*sources, *(r.source for r in rows if r.source is not None)})
        last = max(t for t in (latest, *(r.micros for r in rows)) if t is not None)
        if last != latest:
            for wait in self.waits:
                if latest is not None and latest + wait > now:
                    self.handle.deleteTimer(self._timer(latest + wait))
                if last + wait > now:
                    self.handle.registerTimer(self._timer(last + wait))
        yield self._told(key, passes, began, pending, sources, last, turn, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.event.get()
        if held:
            yield self._told(key, *held, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def lifecycle_stream(dets: DataFrame, out_path: str, checkpoint: str, delay: str = "1 hour", cfg: EventConfig = EventConfig(), retract_hours: int = 6, close_hours: int = 12, missed_frames: int = 2, frame_minutes: int = 10) -> StreamingQuery:
    """Changes of events' statuses from a stream of their detections (event_seq, acq, source).

    An event has a row per micro-batch with news of it and per timer that its silence sets off, as of the watermark; a row's
    ``turn`` counts the event's rows. Detections in any order within ``delay`` count; later ones are late and dropped. A closed or
    retracted event that is seen again is open again. Each batch writes a folder of its own, so that one that runs again
    writes over itself; state and timers survive a restart with the same checkpoint. Rows without event or time are none.
    """
    spark = dets.sparkSession
    seen = dets.where("event_seq is not null and acq is not null").withWatermark("acq", delay).select("event_seq", "acq", "source", F.unix_micros("acq").alias("micros"))
    events = Lifecycle(cfg.pass_gap_minutes, retract_hours, close_hours, missed_frames, frame_minutes)
    changes = seen.groupBy("event_seq").transformWithState(events, CHANGES, "Update", "EventTime")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    with rocksdb(spark):
        return changes.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lifecycle_now(spark: SparkSession, out_path: str) -> DataFrame:
    """Each event as of the stream's last news of it."""
    rows = spark.read.schema(CHANGES).parquet(out_path)
    last = rows.groupBy("event_seq").agg(F.max_by(F.struct("status", "n_passes", "n_sources", "latest"), "turn").alias("x")).select("event_seq", "x.*")
    return last.withColumn("latest", F.timestamp_micros("latest"))


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)
