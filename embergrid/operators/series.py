"""Sampling, thinning, planning and weather tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def training_sample(px: DataFrame, rate: float = 0.01, floor: float = 0.01, seed: int = 42) -> DataFrame:
    """All rows whose probability exceeds ``floor`` and, per frame, a seeded uniform share (one row at least) of the clear
    rows with a finite z. The draw is by hash: the same on every run and cluster.

    No frame is sorted: rows are counted by the hash's first three digits, a running sum over those 4,096 buckets finds the
    one that the cut goes through, lower buckets pass whole and only that one is ranked.
    """
    p = F.coalesce(F.nanvl("probability", F.lit(None)), F.lit(0.0))
    hot = px.where(p > floor).withColumn("pixel_type", F.lit("fire_candidate"))
    pool = px.where((p <= floor) & F.col("clear") & F.col("z").isNotNull() & ~F.isnan("z"))
    pool = pool.withColumn("__h", F.md5(F.concat_ws(":", F.col("pixel_id").cast("string"), F.lit(str(seed))))).withColumn("__b", F.substring("__h", 1, 3))
    counts = pool.groupBy("frame_id", "__b").agg(F.count("*").alias("__c"))
    whole, so_far = Window.partitionBy("frame_id"), Window.partitionBy("frame_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("__sum", F.sum("__c").over(so_far)).withColumn("__want", F.greatest(F.lit(1), F.floor(F.sum("__c").over(whole) * rate)))
    cut = counts.where((F.col("__sum") >= F.col("__want")) & (F.col("__sum") - F.col("__c") < F.col("__want")))
    cut = cut.select("frame_id", F.col("__b").alias("__at"), (F.col("__want") - F.col("__sum") + F.col("__c")).alias("__left"))
    near = pool.join(cut, "frame_id").where(F.col("__b") <= F.col("__at"))
    names = [*px.columns, "__left"]
    below = near.where(F.col("__b") < F.col("__at")).select(*px.columns)
    edge = near.where(F.col("__b") == F.col("__at")).select(*names, F.row_number().over(Window.partitionBy("frame_id").orderBy("__h", "pixel_id")).alias("__rn"))
    drawn = below.unionByName(edge.where(F.col("__rn") <= F.col("__left")).select(*px.columns))
    return hot.unionByName(drawn.withColumn("pixel_type", F.lit("background_sample")))


def every_kth(df: DataFrame, key: list[str], order: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where((F.col("__rn") - 1) % k == 0).drop("__rn")


def missing_dates(spark: SparkSession, first: str, last: str, done: DataFrame) -> DataFrame:
    """Days from first to last that the manifest (day) lacks."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.join(done, "day", "left_anti")


def point_grid(spark: SparkSession, south: float, north: float, west: float, east: float, step: float) -> DataFrame:
    """Inclusive lattice, from whole steps so that it does not drift."""
    rows, cols = round((north - south) / step) + 1, round((east - west) / step) + 1
    return spark.range(rows * cols).select((F.floor(F.col("id") / cols) * step + south).alias("lat"), ((F.col("id") % cols) * step + west).alias("lon"))


def weather_pivot(long: DataFrame, codes: list[str]) -> DataFrame:
    """Long variables (date, lat, lon, code, value, source) as one row per point and day."""
    return long.groupBy("date", "lat", "lon").pivot("code", codes).agg(F.first("value", ignorenulls=True).alias("value"), F.first("source", ignorenulls=True).alias("source"))


def weather_summary(long: DataFrame) -> DataFrame:
    v = F.col("value")
    return long.groupBy("code").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"), F.count_if(v.isNull()).alias("n_missing"))


def weather_sources(long: DataFrame) -> DataFrame:
    """How many values of each variable come from each kind of source, and of how many places."""
    return long.groupBy("code", "source").agg(F.count("*").alias("n"), F.count_distinct("lat", "lon").alias("n_places"))


def places_to_fetch(wanted: DataFrame, stored: DataFrame, step: float = 0.05) -> DataFrame:
    """Wanted places (lat, lon) that the stored rows lack, both snapped to a grid and compared by whole steps."""
    at = [F.rint(F.col(c) / step).cast("long").alias(k) for c, k in (("lat", "__y"), ("lon", "__x"))]
    left = wanted.select("*", *at).join(stored.select(*at).distinct(), ["__y", "__x"], "left_anti")
    return left.withColumn("lat", F.col("__y") * step).withColumn("lon", F.col("__x") * step).drop("__y", "__x")


def effective_humidity(daily: DataFrame, r: float = 0.7, days: int = 7) -> DataFrame:
    """Weighted mean of a station's last days of humidity, each day's weight r of the following one's."""
    w = Window.partitionBy("station").orderBy("date")
    total: Column = F.lit(0.0)
    for i in range(days):
        total = total + F.coalesce(F.lag("humidity", i).over(w), F.lit(0.0)) * r**i
    return daily.withColumn("effective_humidity", (1 - r) * total)


def danger_index(temperature: Column, humidity: Column, wind: Column, drought: Column) -> Column:
    """Forest fire danger index (Mark 5)."""
    return 2 * F.exp(-0.45 + 0.987 * F.log(drought) - 0.0345 * humidity + 0.0338 * temperature + 0.0234 * wind)
