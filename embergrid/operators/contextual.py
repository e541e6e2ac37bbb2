"""The spatial contextual detector: candidates against expanding windows of background pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embergrid.config import ContextualConfig, DayNight

PIXEL = ["frame_id", "row", "col"]


def pick(pair: DayNight, scale: float) -> Column:
    return F.when(F.col("is_day"), pair.day * scale).otherwise(pair.night * scale)


def classify(px: DataFrame, cfg: ContextualConfig = ContextualConfig(), scale: float = 1.0) -> DataFrame:
    """Append btd, land, absolute, candidate and background to pixels with bt7, bt14, is_day, valid and is_water.

    ``scale`` turns the thresholds' Kelvin to the bands' unit (100 for integer hundredths, which sum exactly).
    """
    btd = F.col("bt7") - F.col("bt14")
    absolute = (F.col("bt7") >= cfg.absolute_any * scale) | (F.col("bt7") >= pick(cfg.absolute, scale))
    cand = (F.col("bt7") >= pick(cfg.candidate_bt7, scale)) & (F.col("btd") >= pick(cfg.candidate_btd, scale))
    bg_fire = (F.col("bt7") >= pick(cfg.background_fire_bt7, scale)) & (F.col("btd") >= pick(cfg.background_fire_btd, scale))
    return (
        px.withColumn("btd", btd)
        .withColumn("land", F.col("valid") & ~F.col("is_water"))
        .withColumn("absolute", F.col("land") & absolute)
        .withColumn("candidate", F.col("land") & ~F.col("absolute") & cand)
        .withColumn("background", F.col("land") & ~F.col("absolute") & ~F.col("candidate") & ~bg_fire)
    )


def background_stats(px: DataFrame, cfg: ContextualConfig = ContextualConfig(), scale: float = 1.0, tile: int = 32) -> DataFrame:
    """Per candidate: count, mean and deviation of bt7, btd and bt14 over the first window with enough background.

    Candidates go to the tiles that their widest window touches and meet the background of a tile; one grouping sums
    all window sizes. Cost follows the candidates, and only they are repeated.
    """
    reach = max(cfg.windows) // 2
    t = lambda x, o: F.floor((F.col(x) + o) / tile)
    cand = px.where("candidate").select(*PIXEL)
    cand = cand.withColumn("tr", F.explode(F.sequence(t("row", -reach), t("row", reach)))).withColumn("tc", F.explode(F.sequence(t("col", -reach), t("col", reach))))
    back = px.where("background").select("frame_id", F.col("row").alias("b_row"), F.col("col").alias("b_col"), "bt7", "btd", "bt14", t("row", 0).alias("tr"), t("col", 0).alias("tc"))
    dist = F.greatest(F.abs(F.col("row") - F.col("b_row")), F.abs(F.col("col") - F.col("b_col")))
    met = cand.join(back, ["frame_id", "tr", "tc"]).withColumn("far", dist).where(F.col("far") <= reach)
    aggs = []
    for w in cfg.windows:
        near = F.col("far") <= w // 2
        aggs.append(F.count_if(near).alias(f"n_{w}"))
        for b in ("bt7", "btd", "bt14"):
            v = F.col(b).cast("double")
            aggs += [F.sum(F.when(near, v)).alias(f"s_{b}_{w}"), F.sum(F.when(near, v * v)).alias(f"q_{b}_{w}")]
    sums = met.groupBy(*PIXEL).agg(*aggs)
    enough = {w: F.col(f"n_{w}") >= cfg.min_background_share * w * w for w in cfg.windows}

    def first(value):
        return F.coalesce(*[F.when(enough[w], value(w)) for w in cfg.windows])

    out = {"window": first(lambda w: F.lit(w)), "n_background": first(lambda w: F.col(f"n_{w}"))}
    for b in ("bt7", "btd", "bt14"):
        mean = lambda w, b=b: F.col(f"s_{b}_{w}") / F.col(f"n_{w}")
        var = lambda w, b=b: F.col(f"q_{b}_{w}") / F.col(f"n_{w}") - (F.col(f"s_{b}_{w}") / F.col(f"n_{w}")) * (F.col(f"s_{b}_{w}") / F.col(f"n_{w}"))
        out[f"mu_{b}"] = first(mean)
        out[f"sd_{b}"] = F.greatest(F.sqrt(F.greatest(first(var), F.lit(0.0))), F.lit(cfg.std_floor * scale))
        out[f"sd_{b}"] = F.when(first(mean).isNotNull(), out[f"sd_{b}"])
    return sums.select(*PIXEL, *[c.alias(n) for n, c in out.items()])


def detect(px: DataFrame, cfg: ContextualConfig = ContextualConfig(), scale: float = 1.0) -> DataFrame:
    """Append fire_mask (0 none, 1 low, 2 nominal, 3 high) and the tests behind it.

    Needs is_industrial and glint (degrees, or null). A frame without candidates ends early: its absolute fires are not
    downgraded at industrial sites.
    """
    px = classify(px, cfg, scale)
    px = px.join(background_stats(px, cfg, scale), PIXEL, "left")
    k = F.when(F.col("is_day"), cfg.sigma.day).otherwise(cfg.sigma.night)
    tests = (
        (F.col("bt7") > F.col("mu_bt7") + k * F.col("sd_bt7"))
        & (F.col("btd") > F.col("mu_btd") + k * F.col("sd_btd"))
        & (F.col("btd") > F.col("mu_btd") + pick(cfg.btd_floor, scale))
        & (F.col("bt7") >= pick(cfg.bt7_floor, scale))
        & (~F.col("is_day") | (F.col("bt14") > F.col("mu_bt14") + F.col("sd_bt14") - cfg.bt14_margin * scale))
    )
    contextual = F.coalesce(F.col("candidate") & tests, F.lit(False))
    glint = F.coalesce(F.col("is_day") & (F.col("glint") < cfg.glint_degrees), F.lit(False))
    level = F.when(F.col("btd") - F.col("mu_btd") > cfg.nominal_btd * scale, 2).otherwise(1)
    level = F.when(glint & (level == 2), 1).otherwise(level)
    px = px.withColumn("contextual", contextual)
    # frames with a candidate, counted before they are shuffled: no task holds a frame
    px = px.join(px.where("candidate").select("frame_id").distinct().withColumn("__n", F.lit(1)), "frame_id", "left")
    mask = F.when(F.col("absolute"), 3).when(F.col("contextual"), level).otherwise(0)
    down = F.col("is_industrial") & F.col("__n").isNotNull()
    return px.withColumn("__mask", mask).withColumn("fire_mask", F.when((F.col("__mask") >= 2) & down, 1).otherwise(F.col("__mask"))).drop("__mask", "__n")


def background_near(px: DataFrame, reach: int, value: str, tile: int = 32) -> DataFrame:
    """Each candidate (frame_id, row, col) with the value v of every background pixel at most ``reach`` rows and columns away.

    Both meet on tiles of the frame, so that no frame is one task's; a candidate goes to the tiles that its square touches.
    """
    t = lambda x, o: F.floor((F.col(x) + o) / tile)
    cand = px.where("candidate").select("frame_id", "row", "col")
    cand = cand.withColumn("tr", F.explode(F.sequence(t("row", -reach), t("row", reach)))).withColumn("tc", F.explode(F.sequence(t("col", -reach), t("col", reach))))
    back = px.where("background").select("frame_id", F.col("row").alias("b_row"), F.col("col").alias("b_col"), F.col(value).cast("double").alias("v"), t("row", 0).alias("tr"), t("col", 0).alias("tc"))
    return cand.join(back, ["frame_id", "tr", "tc"]).where((F.abs(F.col("row") - F.col("b_row")) <= reach) & (F.abs(F.col("col") - F.col("b_col")) <= reach))


def frame_counters(detected: DataFrame) -> DataFrame:
    """One row per frame: pixels, valid, water rejected, candidates, absolute, contextual, without background, fires."""
    n = lambda c: F.count_if(c).alias
    return detected.groupBy("frame_id").agg(
        F.count("*").alias("n_pixels"), n(F.col("valid"))("n_valid"), n(F.col("valid") & F.col("is_water"))("n_water_rejected"),
        n(F.col("candidate"))("n_candidates"), n(F.col("absolute"))("n_absolute"), n(F.col("contextual"))("n_contextual"),
        n(F.col("candidate") & F.col("n_background").isNull())("n_insufficient_bg"), n(F.col("absolute") | F.col("contextual"))("n_fires"),
    )


def to_detections(detected: DataFrame, source: str = "HIMAWARI") -> DataFrame:
    """Rows of the detection record for the flagged pixels (needs lat, lon, obs_time)."""
    from embergrid.functions.records import decode_confidence, grid_source_id

    return detected.where("fire_mask > 0").select(
        grid_source_id(source, F.col("lat"), F.col("lon"), F.col("obs_time")).alias("source_id"), F.lit(source).alias("source"), "frame_id", "row", "col",
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("obs_time").alias("acq_datetime"), decode_confidence(F.col("fire_mask")).alias("confidence"),
        F.lit(None).cast("double").alias("frp"), F.col("bt7").cast("double").alias("brightness"), F.when(F.col("is_day"), "D").otherwise("N").alias("daynight"),
    )
