"""Features of how a pixel and its neighbours change together: a fire grows from a point, weather moves a region."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embergrid.operators.spatial import spread


def interaction_features(px: DataFrame, value: str = "btd", frames: int = 3, order: str = "frame_id") -> DataFrame:
    """Append, to pixels (frame_id, row, col and the value) of any frames:

    * n_near, the neighbours (of eight) with a value, and anomaly, the value less their mean;
    * gradient, the greatest difference from a neighbour;
    * anomaly_trend and gradient_change, each less its mean over the pixel's own rows of the last ``frames`` of ``order``;
    * diverging, whether the value rises above its mean over those while the neighbours' mean does not rise above theirs.

    Neighbours are sent to the pixels around them and summed before they are shuffled; the history is a range of ``order``,
    so that gaps between frames count. Without neighbours or history a feature is null; a null value has no features.
    """
    at = ["frame_id", "row", "col"]
    moved = spread(px.where(F.col(value).isNotNull()).select(*at, F.col("row").alias("r0"), F.col("col").alias("c0"), F.col(value).cast("double").alias("v")), 1, "row", "col")
    near = moved.where((F.col("row") != F.col("r0")) | (F.col("col") != F.col("c0"))).groupBy(*at).agg(F.count("*").alias("n_near"), F.avg("v").alias("near"), F.min("v").alias("near_least"), F.max("v").alias("near_most"))
    past = Window.partitionBy("row", "col").orderBy(order).rangeBetween(-frames, -1)
    v = F.col(value).cast("double")
    out = px.join(near, at, "left").withColumn("n_near", F.when(v.isNotNull(), F.coalesce("n_near", F.lit(0))))
    out = out.withColumn("anomaly", v - F.col("near")).withColumn("gradient", F.greatest(F.abs(v - F.col("near_least")), F.abs(F.col("near_most") - v)))
    before = lambda c: F.avg(c).over(past)
    out = out.withColumns({"anomaly_trend": F.col("anomaly") - before(F.col("anomaly")), "gradient_change": F.col("gradient") - before(F.col("gradient")), "diverging": (v > before(v)) & (F.col("near") <= before(F.col("near")))})
    return out.drop("near", "near_least", "near_most")
