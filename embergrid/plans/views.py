"""Deterministic views that give the driver tables the shapes of pixels, series, detections and truth.

All numbers are whole (hundredths of Kelvin, millionths of degrees), so that any engine gets the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid.sources.tables import table


def pix(spark: SparkSession, d: str) -> DataFrame:
    """One frame a day, 15 pixels a row, bands in hundredths of Kelvin."""
    e = table(spark, d, "events").select(
        F.unix_date(F.to_date("ts")).cast("long").alias("frame_id"), F.floor(F.col("user_id") / 15).alias("row"), (F.col("user_id") % 15).alias("col"), "user_id", "event_type",
        F.round(F.col("value") * 100).cast("long").alias("v"), F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1).cast("long").alias("k"),
    )
    g = e.groupBy("frame_id", "row", "col", "user_id").agg(F.max("v").alias("v"), F.sum("k").alias("k"), (F.count_if(F.col("event_type") == "error") * 2 > F.count("*")).alias("cloud"))
    return g.select(
        "frame_id", "row", "col", F.col("user_id").alias("pixel_id"), (F.lit(27800) + F.floor(F.col("v") * 16 / 100)).alias("bt7"), (F.lit(27300) + F.pmod(F.col("k") * 37, F.lit(1000))).alias("bt14"),
        ((F.col("frame_id") + F.col("user_id")) % 2 == 0).alias("is_day"), "cloud", (F.col("user_id") % 11 == 0).alias("is_water"), (F.col("user_id") % 7 == 0).alias("is_industrial"),
        F.when(F.col("user_id") % 5 == 0, 6.0).otherwise(40.0).alias("glint"),
    )


PIX = r"""pix AS (SELECT frame_id, "row", col, u AS pixel_id, CAST(27800 + floor(v * 16 / 100) AS BIGINT) AS bt7, CAST(27300 + ((k * 37) % 1000 + 1000) % 1000 AS BIGINT) AS bt14,
 (frame_id + u) % 2 = 0 AS is_day, cloud, u % 11 = 0 AS is_water, u % 7 = 0 AS is_industrial, CASE WHEN u % 5 = 0 THEN 6.0 ELSE 40.0 END AS glint FROM (
 SELECT frame_id, user_id // 15 AS "row", user_id % 15 AS col, user_id AS u, max(v) AS v, sum(k) AS k, count(*) FILTER (event_type = 'error') * 2 > count(*) AS cloud FROM (
 SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS frame_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS v, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events) GROUP BY ALL))"""


def series(spark: SparkSession, d: str) -> DataFrame:
    """Per user a series of whole hundredths z100 of a standardised value."""
    return table(spark, d, "events").select(
        "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("ord"), (F.round(F.col("value") * 2) - 100).cast("long").alias("z100"), (F.col("event_type") != "error").alias("clear"),
    )


SERIES = """series AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS ord, CAST(round(value * 2) - 100 AS BIGINT) AS z100, event_type <> 'error' AS clear FROM events)"""


def det(spark: SparkSession, d: str) -> DataFrame:
    """Detections from lineitem: hashed places in a box of half a degree, in millionths of degrees, frame and source."""
    n = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 13) % 1000003
    m = (F.col("l_orderkey") * 31 + F.col("l_suppkey") * 7919 + F.col("l_linenumber") * 17) % 1000003
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("det_id"), (F.lit(-34000000) + n * 2).alias("lat_u"), (F.lit(150000000) + m * 2).alias("lon_u"), F.to_date("l_shipdate").alias("day"),
        (F.unix_date(F.to_date("l_shipdate")) % 40).cast("long").alias("frame_no"),
        F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "nominal").otherwise("low").alias("confidence"), F.when(F.col("l_linestatus") == "O", "HIMAWARI").otherwise("FIRMS").alias("source"),
        F.floor(F.col("l_extendedprice") / 1000).cast("long").alias("frp"), "l_orderkey", "l_linenumber",
    )


DET = """det AS (SELECT l_orderkey * 10 + l_linenumber AS det_id, -34000000 + ((l_orderkey * 7 + l_linenumber * 104729 + l_partkey * 13) % 1000003) * 2 AS lat_u,
 150000000 + ((l_orderkey * 31 + l_suppkey * 7919 + l_linenumber * 17) % 1000003) * 2 AS lon_u, CAST(l_shipdate AS DATE) AS day, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) % 40 AS BIGINT) AS frame_no,
 CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'nominal' ELSE 'low' END AS confidence, CASE l_linestatus WHEN 'O' THEN 'HIMAWARI' ELSE 'FIRMS' END AS source, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS frp, l_orderkey, l_linenumber FROM lineitem)"""


def truth(spark: SparkSession, d: str) -> DataFrame:
    """Truth events from supplier and the earliest order of each of their numbers' customers."""
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("truth_id"), (F.lit(-34000000) + (F.col("s_suppkey") * 982451 % 1000003) * 2).alias("lat_u"), (F.lit(150000000) + (F.col("s_suppkey") * 57885161 % 1000003) * 2).alias("lon_u"),
        F.date_add(F.lit("1993-01-01").cast("date"), (F.col("s_suppkey") * 37 % 2000).cast("int")).alias("first_day"), (F.col("s_suppkey") * 13 % 130).alias("frp"), F.when(F.col("s_suppkey") % 2 == 0, "D").otherwise("N").alias("daynight"),
    )


TRUTH = """truth AS (SELECT s_suppkey AS truth_id, -34000000 + (s_suppkey * 982451 % 1000003) * 2 AS lat_u, 150000000 + (s_suppkey * 57885161 % 1000003) * 2 AS lon_u,
 CAST(DATE '1993-01-01' + CAST(s_suppkey * 37 % 2000 AS INTEGER) AS DATE) AS first_day, s_suppkey * 13 % 130 AS frp, CASE WHEN s_suppkey % 2 = 0 THEN 'D' ELSE 'N' END AS daynight FROM supplier)"""



def km_sql(a: str, b: str) -> str:
    h = f"pow(sin(radians({b}.lat_u / 1e6 - {a}.lat_u / 1e6) / 2), 2) + cos(radians({a}.lat_u / 1e6)) * cos(radians({b}.lat_u / 1e6)) * pow(sin(radians({b}.lon_u / 1e6 - {a}.lon_u / 1e6) / 2), 2)"
    return f"(2 * 6371.0 * atan2(sqrt(least(1.0, greatest(0.0, {h}))), sqrt(1 - least(1.0, greatest(0.0, {h})))))"


def near_sql(a: str, b: str, km: float) -> str:
    """Distance test with a cheap box before it."""
    box = int(km / 111.19 * 1.3e6)
    return f"{b}.lat_u BETWEEN {a}.lat_u - {box} AND {a}.lat_u + {box} AND {b}.lon_u BETWEEN {a}.lon_u - {2 * box} AND {a}.lon_u + {2 * box} AND {km_sql(a, b)} <= {km}"


def sites(spark: SparkSession, d: str) -> DataFrame:
    """Detections around 301 sites from customer, in order of arrival."""
    c = F.col("c_custkey")
    s = c % 301
    return table(spark, d, "customer").select(
        c.alias("seq"), s.alias("site"), (F.lit(-37500000) + (s * 982451 % 9001) * 1000 + (c * 7919 % 301) * 60).alias("lat_u"), (F.lit(141500000) + (s * 57885161 % 12007) * 1000 + (c * 104729 % 307) * 60).alias("lon_u"),
        F.lit("2024-01-01").cast("timestamp").alias("__t0"), (c * 17 % 5003).alias("minute"), F.when(c % 3 == 0, "HIMAWARI").when(c % 3 == 1, "FIRMS").otherwise("DEA").alias("source"),
        F.when(c % 5 == 0, "high").when(c % 2 == 0, "nominal").otherwise("low").alias("confidence"), (c % 90).alias("frp"), F.when(c % 4 == 0, "dup").otherwise(c.cast("string")).alias("tag"),
    ).withColumn("acq", F.timestamp_seconds(F.unix_seconds("__t0") + F.col("minute") * 60)).drop("__t0")


SITES = """sites AS (SELECT c_custkey AS seq, c_custkey % 301 AS site, -37500000 + ((c_custkey % 301) * 982451 % 9001) * 1000 + (c_custkey * 7919 % 301) * 60 AS lat_u,
 141500000 + ((c_custkey % 301) * 57885161 % 12007) * 1000 + (c_custkey * 104729 % 307) * 60 AS lon_u, c_custkey * 17 % 5003 AS minute,
 CASE c_custkey % 3 WHEN 0 THEN 'HIMAWARI' WHEN 1 THEN 'FIRMS' ELSE 'DEA' END AS source, CASE WHEN c_custkey % 5 = 0 THEN 'high' WHEN c_custkey % 2 = 0 THEN 'nominal' ELSE 'low' END AS confidence, c_custkey % 90 AS frp FROM customer)"""
