"""Masks over pixel rows (frame_id, row, col, ...). Null stands for missing values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embergrid.config import Region
from embergrid.functions.geo import in_ellipse
from embergrid.operators.spatial import spread

#: Industrial heat sources (latitude, longitude).
INDUSTRIAL_SITES = (
    (-32.3958, 150.9492),
    (-33.0617, 151.5198),
    (-33.16, 151.5446),
    (-33.3586, 150.0316),
    (-34.4638, 150.8862),
    (-34.5226, 150.8071),
    (-32.8248, 151.7245),
    (-33.21, 151.5448),
    (-35.1802, 147.2157),
    (-32.8174, 151.4830),
    (-33.85, 150.9495),
    (-32.868, 151.774),
    (-33.766, 150.8498),
    (-34.5099, 150.3365),
    (-34.8497, 150.6109),
    (-32.3339, 150.8526),
    (-32.5237, 151.0066),
    (-32.607, 151.090),
    (-32.6835, 151.0827),
    (-32.3715, 150.978),
    (-28.3141, 153.4388),
    (-29.017, 153.433),
    (-29.4259, 153.2478),
)
INDUSTRIAL_KM = 4.0
SITE_CELL = 0.1  # degrees


def nan_to_null(df: DataFrame, *names: str) -> DataFrame:
    """Spark takes NaN for the largest number; missing values are null from here on."""
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def in_region(lat: Column, lon: Column, region: Region = Region()) -> Column:
    return lat.between(region.south, region.north) & lon.between(region.west, region.east)


def dilate(df: DataFrame, flag: str, out: str, reach: int = 2) -> DataFrame:
    """Whether a pixel lies in the square of ``reach`` around a flagged one; cost follows the flagged pixels."""
    near = spread(df.where(F.col(flag)).select("frame_id", "row", "col"), reach, "row", "col").distinct().withColumn(out, F.lit(True))
    return df.join(near, ["frame_id", "row", "col"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def dilate_dense(df: DataFrame, flag: str, out: str, reach: int = 2) -> DataFrame:
    """The same on frames without gaps, by two passes of running maxima."""
    across = Window.partitionBy("frame_id", "row").orderBy("col").rangeBetween(-reach, reach)
    down = Window.partitionBy("frame_id", "col").orderBy("row").rangeBetween(-reach, reach)
    return df.withColumn("__h", F.max(F.col(flag)).over(across)).withColumn(out, F.max("__h").over(down)).drop("__h")


def has_neighbour(df: DataFrame, flag: str, out: str) -> DataFrame:
    """Whether one of a pixel's eight neighbours is flagged."""
    near = spread(df.where(F.col(flag)).select("frame_id", "row", "col", F.col("row").alias("r0"), F.col("col").alias("c0")), 1, "row", "col")
    near = near.where((F.col("row") != F.col("r0")) | (F.col("col") != F.col("c0"))).select("frame_id", "row", "col").distinct().withColumn(out, F.lit(True))
    return df.join(near, ["frame_id", "row", "col"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def valid_pixels(df: DataFrame, cloud_bt14: float = 270.0, reach: int = 2) -> DataFrame:
    """Append cloud, cloud_adjacent and valid: in the region, off the clouds and with both bands."""
    df = dilate(df.withColumn("cloud", F.coalesce(F.col("bt14") < cloud_bt14, F.lit(False))), "cloud", "cloud_adjacent", reach)
    return df.withColumn("valid", F.col("in_roi") & ~F.col("cloud_adjacent") & F.col("bt7").isNotNull() & F.col("bt14").isNotNull())


def industrial(df: DataFrame, km: float = INDUSTRIAL_KM, sites=INDUSTRIAL_SITES) -> DataFrame:
    """Append is_industrial. The sites are a constant of some twenty rows: a broadcast of the few cells that their buffers
    touch tells which sites a row may lie in, and only those are tested."""
    names, held = df.columns, {}
    for lat, lon in sites:
        high, wide = km / 111.0 * 1.001, km / (111.0 * math.cos(math.radians(lat))) * 1.001
        for y in range(math.floor((lat - high) / SITE_CELL), math.floor((lat + high) / SITE_CELL) + 1):
            for x in range(math.floor((lon - wide) / SITE_CELL), math.floor((lon + wide) / SITE_CELL) + 1):
                held.setdefault((y, x), []).append((lat, lon))
    cells = df.sparkSession.createDataFrame([(y, x, near) for (y, x), near in held.items()], "__cy long, __cx long, __sites array<struct<lat: double, lon: double>>")
    at = lambda c: F.floor(F.col(c) / SITE_CELL).cast("long")
    inside = F.exists("__sites", lambda s: in_ellipse(F.col("lat"), F.col("lon"), s["lat"], s["lon"], km))
    out = df.withColumn("__cy", at("lat")).withColumn("__cx", at("lon")).join(F.broadcast(cells), ["__cy", "__cx"], "left")
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return out.select(*names, F.when(known, F.coalesce(inside, F.lit(False))).alias("is_industrial"))


def raster_lookup(df: DataFrame, raster: DataFrame, lat0: float, lon0: float, step: float, rows: int, cols: int, out: str = "is_water") -> DataFrame:
    """Nearest cell of a static raster (r_row, r_col, value), indices clipped at its edges."""
    def clipped(x, n):
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.round(x).cast("int")))

    keyed = df.withColumn("r_row", clipped((F.lit(lat0) - F.col("lat")) / step, rows)).withColumn("r_col", clipped((F.col("lon") - lon0) / step, cols))
    return keyed.join(raster.withColumnRenamed("value", out), ["r_row", "r_col"], "left").drop("r_row", "r_col").fillna(False, [out])
