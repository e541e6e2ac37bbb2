"""Rules of the design papers around events: provenance, transitions, weather-dependent persistence, robust background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embergrid.functions.records import confidence_rank
from embergrid.operators.contextual import background_near
from embergrid.operators.spatial import spatial_join


def provenance(members: DataFrame) -> DataFrame:
    """One row per event and observation key: the most confident one stays, the others are marked derived."""
    w = Window.partitionBy("event_seq", "observation_key").orderBy(F.desc(confidence_rank(F.col("confidence"))), "seq")
    return members.withColumn("derived", F.row_number().over(w) > 1)


def transitions(events: DataFrame, as_of: Column, retract_hours: int = 6, close_hours: int = 12, missed_frames: int = 2) -> DataFrame:
    """Status at a moment: provisional events missed often and long enough are retracted, silent ones closed; confirmed
    ones with news are monitored."""
    silent = (as_of.cast("timestamp").cast("double") - F.col("latest_detection_time").cast("double")) / 3600
    status = (
        F.when((F.col("status") == "PROVISIONAL") & (F.col("missed_frames") >= missed_frames) & (silent >= retract_hours), "RETRACTED")
        .when(silent >= close_hours, "CLOSED").when((F.col("status") == "CONFIRMED") & (silent > 1), "MONITORING").otherwise(F.col("status"))
    )
    return events.withColumn("status", status)


def interpolate(points: DataFrame, stations: DataFrame, km: float = 100.0, power: float = 2.0) -> DataFrame:
    """Inverse-distance weighted mean of the station values (r_lat, r_lon, value) within ``km`` of each point."""
    from embergrid.functions.geo import haversine_km

    met = spatial_join(points, stations, km).withColumn("__w", 1 / F.pow(F.greatest(haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")), F.lit(0.001)), power))
    return met.groupBy("point_id").agg((F.sum(F.col("__w") * F.col("value")) / F.sum("__w")).alias("value"), F.count("*").alias("n_stations"))


def min_frames_by_danger(index: Column) -> Column:
    """Frames that a detection must be seen in: two in calm weather, one in severe."""
    return F.when(index >= 50, 1).otherwise(2)


def mad_background(px: DataFrame, value: str = "btd", window: int = 11, least: int = 10, tile: int = 32) -> DataFrame:
    """Median and median absolute deviation of the background around each candidate, where enough of it is there."""
    met = background_near(px, window // 2, value, tile)
    keys = ["frame_id", "row", "col"]
    middle = met.groupBy(*keys).agg(F.median("v").alias("median"), F.count("*").alias("n")).where(F.col("n") >= least)
    return met.join(middle, keys).groupBy(*keys, "n", "median").agg(F.median(F.abs(F.col("v") - F.col("median"))).alias("mad"))
