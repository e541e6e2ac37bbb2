"""Streams: frames from files, one micro-batch at a time, through persistence into stored events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from embergrid.config import Config, CusumConfig, PersistenceConfig
from embergrid.operators.cusum import OUT, STATE, first_state, step
from embergrid.operators.persistence import persistence
from embergrid.sources.store import VersionedTable

DETECTIONS = "det_id long, frame_no long, lat double, lon double, confidence string"


def read_frames(spark: SparkSession, path: str, schema: str = DETECTIONS, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as they arrive; the stream's checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def persist_stream(dets: DataFrame, buffer_path: str, out_path: str, checkpoint: str, cfg: PersistenceConfig = PersistenceConfig()) -> StreamingQuery:
    """Passing detections per frame, equal to the batch operator's.

    Each batch holds whole frames. The last window + 1 frames are kept as Parquet by batch number, and a batch that is
    run again writes over its own folders, so that results come once.
    """
    spark = dets.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        old = _buffer(spark, buffer_path, number, batch)
        both = old.unionByName(batch) if old is not None else batch
        judged = persistence(both, cfg).where(F.col("emit_frame").isNotNull())
        now = batch.select(F.col("frame_no").alias("emit_frame")).distinct()
        judged.join(now, "emit_frame", "left_semi").write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        last = both.agg(F.max("frame_no")).first()[0]
        # a batch that leaves nothing to keep writes an empty buffer, which the next one reads
        kept = both.where(F.col("frame_no") > last - cfg.window - 1) if last is not None else both
        kept.write.mode("overwrite").parquet(f"{buffer_path}/batch={number}")

    return dets.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _buffer(spark: SparkSession, path: str, number: int, like: DataFrame) -> DataFrame | None:
    if number == 0:
        return None
    return spark.read.schema(like.schema).parquet(f"{path}/batch={number - 1}")


def replay(pixels: DataFrame, folder: str, cfg: CusumConfig = CusumConfig(), most: int | None = None) -> int:
    """Run the temporal model over the frames that no earlier run has published, in order; how many were run.

    State is a versioned table, published frame by frame under the frame's number, after the frame's outputs are written to
    ``out/frame=N``; a frame that was cut short is run again from the state before it and writes over its outputs. Pixels
    that were not seen before start anew. At most ``most`` frames are run; frames before the last published one are not
    taken up any more, as their place in the order has passed. For live frames; whole archives go through ``run_tiles``.
    """
    state = VersionedTable(pixels.sparkSession, f"{folder}/state", STATE, "pixel_id")
    done = state.last_batch("replay")
    todo = pixels if done is None else pixels.where(F.col("frame_id") > done)
    frames = [r[0] for r in todo.select("frame_id").distinct().orderBy("frame_id").limit(most or 1 << 30).collect()]
    for number in frames:
        frame = pixels.where(F.col("frame_id") == number)
        known = state.read()
        fresh = first_state(frame.select("pixel_id").join(known.select("pixel_id"), "pixel_id", "left_anti"), cfg)
        out = f"{folder}/out/frame={number}"
        step(known.join(frame.select("pixel_id"), "pixel_id", "left_semi").unionByName(fresh), frame, cfg).write.mode("overwrite").parquet(out)
        state.upsert(pixels.sparkSession.read.schema(OUT).parquet(out), int(number), "replay")
    return len(frames)


def frame_counts(px: DataFrame, late: str = "30 minutes", width: str = "10 minutes") -> DataFrame:
    """Hot pixels per tumbling frame of event time, with late rows admitted for a while."""
    hot = px.withWatermark("obs_time", late)
    return hot.groupBy(F.window("obs_time", width)).agg(F.count("*").alias("n_pixels"), F.count_if(F.col("bt7") >= Config().contextual.candidate_bt7.day).alias("n_hot"))
