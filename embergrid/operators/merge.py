"""Merging temporal detections into the contextual ones of the same frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embergrid.operators.spatial import nearest_within


def merge_detections(contextual: DataFrame, temporal: DataFrame, degrees: float = 0.02) -> DataFrame:
    """Each temporal detection looks for the nearest contextual one of its frame within ``degrees``.

    Found, it is dropped and lifts that one from low to nominal; otherwise it is appended. Inputs: frame_id, det_id, lat,
    lon, confidence; among equal distances the least det_id is nearest. Output adds method.
    """
    c = contextual.groupBy("frame_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")).agg(F.min("det_id").alias("c_id"))  # of one place only the least can be nearest
    nearest = nearest_within(temporal, c, degrees, "det_id", ["c_id"], on=["frame_id"]).select("det_id", "c_id")
    lifted = nearest.select(F.col("c_id").alias("det_id")).distinct().withColumn("__lift", F.lit(True))
    names = ["frame_id", "det_id", "lat", "lon", "confidence"]
    first = contextual.join(lifted, "det_id", "left").withColumn("confidence", F.when(F.col("__lift") & (F.col("confidence") == "low"), "nominal").otherwise(F.col("confidence")))
    first = first.select(*names, F.when(F.col("__lift"), "both").otherwise("contextual").alias("method"))
    rest = temporal.join(nearest, "det_id", "left_anti").select(*names, F.lit("temporal").alias("method"))
    return first.unionByName(rest)


def method_tags(contextual: DataFrame, temporal: DataFrame) -> DataFrame:
    """Pixels of either detector with the method that saw them."""
    key = ["frame_id", "row", "col"]
    a, b = contextual.select(*key, F.lit(True).alias("a")), temporal.select(*key, F.lit(True).alias("b"))
    both = a.join(b, key, "full_outer")
    return both.select(*key, F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "contextual").otherwise("temporal").alias("method"))


def nearest_rows(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")
