"""Sources: point feeds as CSV and GeoJSON, frame archives, targets, weather JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embergrid.functions.records import feed_confidence, feed_source_id, first_text, first_truthy, hhmm, number_confidence

CSV_SCHEMA = "latitude string, longitude string, acq_date string, acq_time string, satellite string, confidence string, frp string, bright_ti4 string, brightness string, daynight string"

#: Names of frames and segments in an archive.
FRAME = r"(\d{8})[_/](\d{4})"
SEGMENT = r"HS_H\d{2}_(\d{8})_(\d{4})_(B\d{2})_FLDK_R\d{2}_S(\d{4})"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a point feed by header; columns that a product lacks are null."""
    raw = spark.read.option("header", True).csv(path)
    names = [f.name for f in T._parse_datatype_string(CSV_SCHEMA)]
    return raw.select(*[F.col(n) if n in raw.columns else F.lit(None).cast("string").alias(n) for n in names])


def parse_csv(raw: DataFrame, source: str = "FIRMS", instrument: str = "VIIRS") -> DataFrame:
    """Detection records; rows whose place or time can't be read are dropped."""
    num = lambda c: F.col(c).try_cast("double")
    t = hhmm(F.col("acq_date"), F.col("acq_time"))
    return raw.select(
        num("latitude").alias("latitude"), num("longitude").alias("longitude"), t.alias("acq_datetime"), F.lit(source).alias("source"), F.col("satellite"), F.lit(instrument).alias("instrument"),
        feed_confidence(F.col("confidence")).alias("confidence"), num("frp").alias("frp"), first_truthy(num("bright_ti4"), num("brightness")).alias("brightness"), "daynight",
    ).where("latitude is not null and longitude is not null and acq_datetime is not null").withColumn("source_id", feed_source_id(source, F.coalesce("satellite", F.lit("")), F.col("latitude"), F.col("longitude"), F.col("acq_datetime")))


PROPERTIES = "datetime string, start_dt string, ingestion_datetime string, satellite string, instrument string, confidence string, power double, frp double, temp_kelvin double, brightness double, daynight string"
GEOJSON = f"features array<struct<geometry: struct<coordinates: array<double>>, properties: struct<{', '.join(p.replace(' ', ': ', 1) for p in PROPERTIES.split(', ')) }>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Detection records of a feature collection; features without a place or a time are dropped."""
    raw = spark.read.schema(GEOJSON).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    p = lambda c: F.col(f"f.properties.{c}")
    t = F.try_to_timestamp(first_text(p("datetime"), p("start_dt"), p("ingestion_datetime")))
    return raw.select(
        F.try_element_at("f.geometry.coordinates", F.lit(2)).alias("latitude"), F.try_element_at("f.geometry.coordinates", F.lit(1)).alias("longitude"), t.alias("acq_datetime"), F.lit("DEA").alias("source"),
        p("satellite").alias("satellite"), p("instrument").alias("instrument"), number_confidence(p("confidence"), p("confidence").rlike(r"^-?[0-9.]+$")).alias("confidence"),
        first_truthy(p("power"), p("frp")).alias("frp"), first_truthy(p("temp_kelvin"), p("brightness")).alias("brightness"), p("daynight").alias("daynight"),
    ).where("latitude is not null and longitude is not null and acq_datetime is not null").withColumn("source_id", feed_source_id("DEA", F.coalesce("satellite", F.lit("")), F.col("latitude"), F.col("longitude"), F.col("acq_datetime")))


def segments(files: DataFrame, bands=("B07", "B14"), numbers=("0810", "0910")) -> DataFrame:
    """Segment files (path) of the wanted bands and segments, with frame and band."""
    at = lambda i: F.regexp_extract("path", SEGMENT, i)
    out = files.select("path", F.concat_ws("_", at(1), at(2)).alias("frame"), at(3).alias("band"), at(4).alias("segment"))
    return out.where(F.col("band").isin(*bands) & F.col("segment").isin(*numbers))


def complete_frames(segs: DataFrame, need: int = 4) -> DataFrame:
    return segs.groupBy("frame").agg(F.count_distinct("band", "segment").alias("n")).withColumn("status", F.when(F.col("n") >= need, "ok").otherwise("incomplete"))


def recent_frames(frames: DataFrame, done: DataFrame, as_of: str, minutes: int = 30) -> DataFrame:
    """Frames (frame as yyyyMMdd_HHmm) of the last ``minutes`` before a moment that are not done yet, the oldest first."""
    t = F.to_timestamp("frame", "yyyyMMdd_HHmm")
    now = F.lit(as_of).cast("timestamp")
    return frames.where((t >= now - F.make_interval(mins=F.lit(minutes))) & (t <= now)).join(done.select("frame"), "frame", "left_anti").orderBy("frame")


def read_point_csv(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """Stored daily weather as CSV (date, lat, lon, elevation_m, target_label and, per variable, a value and a source), as long rows; cells
    that are empty or no numbers are null."""
    raw = spark.read.option("header", True).csv(path)
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    each = [F.struct(F.lit(c).alias("code"), (number(c) if c in raw.columns else F.lit(None).cast("double")).alias("value"), (number(f"{c}_source").cast("int") if f"{c}_source" in raw.columns else F.lit(None).cast("int")).alias("source")) for c in names]
    rows = raw.select(F.expr("try_cast(date AS date)").alias("date"), number("lat").alias("lat"), number("lon").alias("lon"), F.explode(F.array(*each)).alias("v"))
    return rows.select("date", "lat", "lon", "v.code", "v.value", "v.source")


def archive(files: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Frames of an archive (path): a folder per frame wins over loose files; bounds are text, both included."""
    folder, loose = F.regexp_extract("path", r"/(\d{8}_\d{4})/", 1), F.concat_ws("_", F.regexp_extract("path", SEGMENT, 1), F.regexp_extract("path", SEGMENT, 2))
    out = files.select("path", F.when(folder != "", folder).otherwise(loose).alias("frame"), F.when(folder != "", 0).otherwise(1).alias("rank")).where("frame != '_'")
    if first:
        out = out.where(F.substring("frame", 1, 8) >= first)
    if last:
        out = out.where(F.substring("frame", 1, 8) <= last)
    return out.groupBy("frame").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    schema = "label string, lat double, lon double, firms_first_dt string, firms_first_frp double, firms_first_conf string, firms_first_dn string, n_detections int, duration_hours double"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Daily point weather (location, data[date, variables[]]) as long rows."""
    schema = "location struct<latitude: double, longitude: double, elevation: double>, data array<struct<date: string, variables: array<struct<variable_code: string, value: double, source: int>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("location", F.explode("data").alias("d"))
    flat = rows.select("location", F.to_date("d.date").alias("date"), F.explode("d.variables").alias("v"))
    return flat.select("date", F.col("location.latitude").alias("lat"), F.col("location.longitude").alias("lon"), F.col("location.elevation").alias("elevation_m"), F.col("v.variable_code").alias("code"), F.col("v.value").alias("value"), F.col("v.source").alias("source"))


def write_training(df: DataFrame, path: str) -> None:
    """Append a day's samples, one folder per UTC date."""
    df.withColumn("obs_date", F.to_date("obs_time")).write.mode("append").partitionBy("obs_date").parquet(path)
