"""Temporal persistence of detections (frame_no, det_id, lat, lon, confidence) over frames in processing order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embergrid.config import PersistenceConfig
from embergrid.functions.geo import tile
from embergrid.operators.spatial import spatial_join


def persistence(dets: DataFrame, cfg: PersistenceConfig = PersistenceConfig()) -> DataFrame:
    """Append n_prior (previous frames of the window with a detection near by) and outcome.

    Outcomes: bypass (high confidence), persistent, promoted (held, then met in the next frame), discarded (held, not
    met) and held (no next frame yet). ``emit_frame`` is the frame in which a passing row comes out; it keeps its time.
    ``det_id`` names a detection. Frames without detections advance the window by their number. The last frame's number is the table's greatest, or a
    frame_no of rows without det_id that only mark empty frames.
    """
    real = dets.where(F.col("det_id").isNotNull())
    steps = (-1, *range(1, cfg.window + 1))  # how far back a frame lies; -1 is the next one
    every = (1 << len(steps)) - 1
    # a detection in the same tile is near without a look at distances: that settles most frames of crowded places
    tiled = real.withColumn("__tile", tile(F.col("lat"), F.col("lon"), cfg.km))
    seen = tiled.select("frame_no", "__tile").distinct()
    bits = F.explode(F.array(*[F.struct((F.col("frame_no") + s).alias("f"), F.lit(1 << i).alias("bit")) for i, s in enumerate(steps)])).alias("m")
    seen = seen.select("__tile", bits).groupBy("__tile", F.col("m.f").alias("frame_no")).agg(F.bit_or("m.bit").alias("__bits"))
    tiled = tiled.join(seen, ["__tile", "frame_no"], "left").select(*dets.columns, F.coalesce("__bits", F.lit(0)).alias("__bits"))
    # what is open looks for any detection within the distance, frame by frame
    look = F.explode(F.filter(F.array(*[F.struct((F.col("frame_no") - s).alias("f"), F.lit(1 << i).alias("bit")) for i, s in enumerate(steps)]), lambda m: F.col("__bits").bitwiseAND(m["bit"]) == 0))
    open_ = tiled.where(F.col("__bits") != every).withColumn("__m", look).select("det_id", "frame_no", "lat", "lon", F.col("__m.f").alias("__f"), F.col("__m.bit").alias("__bits"))
    other = real.select(F.col("frame_no").alias("r_frame"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = spatial_join(open_, other, cfg.km, "left_semi", on=[("__f", "r_frame")], repeat="left")
    near = near.groupBy("det_id", "frame_no").agg(F.bit_or("__bits").alias("__more"))
    tiled = tiled.join(near, ["det_id", "frame_no"], "left").select(*dets.columns, F.col("__bits").bitwiseOR(F.coalesce("__more", F.lit(0))).alias("__bits"))
    # rows that share an id are one detection, which met the frames that any of them met
    back = F.array_compact(F.array(*[F.when(F.col("__bits").bitwiseAND(1 << i) != 0, F.col("frame_no") - s) for i, s in enumerate(steps) if s > 0]))
    own = Window.partitionBy("det_id")
    out = tiled.withColumn("n_prior", F.size(F.array_distinct(F.flatten(F.collect_list(back).over(own))))).withColumn("met_next", F.max((F.col("__bits").bitwiseAND(1) != 0)).over(own)).drop("__bits")
    last = dets.agg(F.max("frame_no").alias("__last"))
    out = out.crossJoin(F.broadcast(last))  # one row
    n = F.coalesce(F.col("n_prior"), F.lit(0))
    high = (F.col("confidence") == "high") if cfg.bypass_high else F.lit(False)
    outcome = (
        F.when(high, "bypass").when(n >= cfg.min_frames - 1, "persistent").when(F.coalesce("met_next", F.lit(False)), "promoted")
        .when(F.col("frame_no") < F.col("__last"), "discarded").otherwise("held")
    )
    out = out.withColumn("n_prior", n.cast("long")).withColumn("outcome", outcome)
    emit = F.when(F.col("outcome").isin("bypass", "persistent"), F.col("frame_no")).when(F.col("outcome") == "promoted", F.col("frame_no") + 1)
    return out.withColumn("emit_frame", emit).drop("met_next", "__last")


def persistence_stats(judged: DataFrame) -> DataFrame:
    """Per frame: received, bypassed, persistent and held now; promoted and discarded of the frame before; passed."""
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    zero = F.lit(0).cast("long")
    now = judged.groupBy("frame_no").agg(F.count("*").alias("received"), is_("bypass").alias("bypassed"), is_("persistent").alias("persistent"), is_("held", "promoted", "discarded").alias("held"), is_("promoted").alias("up"), is_("discarded").alias("gone"))
    # one row a frame for the frame itself and, where something came out later, one for the next
    names = ("received", "bypassed", "persistent", "held")
    this = F.struct("frame_no", *names, zero.alias("promoted"), zero.alias("discarded"))
    after = F.struct((F.col("frame_no") + 1).alias("frame_no"), *[zero.alias(c) for c in names], F.col("up").alias("promoted"), F.col("gone").alias("discarded"))
    both = now.select(F.explode(F.when(F.col("up") + F.col("gone") > 0, F.array(this, after)).otherwise(F.array(this))).alias("r")).select("r.*")
    sums = both.groupBy("frame_no").agg(*[F.sum(c).alias(c) for c in ("received", "bypassed", "persistent", "held", "promoted", "discarded")])
    return sums.withColumn("passed", F.col("bypassed") + F.col("persistent") + F.col("promoted"))
