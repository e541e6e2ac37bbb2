"""Scoring of detections against ground-truth events."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embergrid.config import EventConfig
from embergrid.functions.geo import haversine_km, tile
from embergrid.operators.spatial import spatial_join
from embergrid.sources.tables import cut

FRP_EDGES = (0, 2, 5, 10, 25, 50, 100, 1000)
LATENCY_PERCENTS = (10, 25, 50, 75, 90)


def match_truth(truth: DataFrame, dets: DataFrame, cfg: EventConfig = EventConfig()) -> DataFrame:
    """One row per truth event with its earliest detection within the radius (no time bound), counts by method, latency.

    truth: truth_id, lat, lon, first_dt, frp, daynight; dets: det_id (a whole number), r_lat, r_lon, obs_time, method, level.
    """
    # (time, id) as one number: the least of a struct would sort every pair
    order = F.unix_micros(F.col("obs_time").cast("timestamp")).cast("decimal(18,0)") * F.lit("18446744073709551616").cast("decimal(20,0)") + F.col("det_id").cast("decimal(20,0)")
    dets = dets.where(F.col("r_lat").isNotNull() & F.col("r_lon").isNotNull()).withColumn("order", order.cast("decimal(38,0)"))
    met = cut(_met(truth.select("truth_id", "lat", "lon"), dets, cfg.match_km))
    named = dets.select("order", F.struct("obs_time", "method", "level").alias("row")).join(met.select("truth_id", "order"), "order")
    first = named.groupBy("truth_id").agg(F.min("row").alias("first"))  # repeated ids give the least of their rows
    out = truth.join(met.drop("order"), "truth_id", "left").join(first, "truth_id", "left")
    latency = (F.col("first.obs_time").cast("timestamp").cast("double") - F.col("first_dt").cast("timestamp").cast("double")) / 60
    return out.select(
        *truth.columns, F.col("n_met").isNotNull().alias("matched"), F.col("first.obs_time").alias("our_first_dt"), F.col("first.method").alias("our_first_method"), F.col("first.level").alias("our_first_level"),
        latency.alias("latency_min"), F.coalesce(latency < 0, F.lit(False)).alias("early_detection"),
        F.coalesce("n_ctx_matches", F.lit(0)).alias("n_ctx_matches"), F.coalesce("n_cusum_matches", F.lit(0)).alias("n_cusum_matches"),
    )


def _parts(dets: DataFrame, km: float) -> int:
    """How many times smaller than the radius a tile should be where a typical detection lies, so that looks at tiles and at
    the rows of the rim balance: the cube root of the detections in a square of the radius."""
    t = tile(F.col("r_lat"), F.col("r_lon"), km * math.sqrt(2))
    n = dets.groupBy(t["y"], t["x"]).agg(F.count("*").cast("double").alias("n"))
    k = n.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("k")).first()["k"] or 1.0
    return max(3, min(64, round(0.43 * k ** (1 / 3))))


def _met(truth: DataFrame, dets: DataFrame, km: float) -> DataFrame:
    """Per truth event that has detections within ``km``: their number, counts by method and least order.

    Detections are summed by small tiles. A tile that lies within the radius counts as a whole; only those that the circle's
    rim may cut are looked into, row by row. All sums have buffers of fixed size, so that no pair is ever sorted.
    """
    parts = _parts(dets, km)
    t = tile(F.col("r_lat"), F.col("r_lon"), km / parts)
    one = lambda *methods: F.coalesce(F.col("method").isin(*methods).cast("long"), F.lit(0).cast("long"))
    rows = dets.select(t["y"].alias("ty"), t["x"].alias("tx"), F.col("r_lat").alias("d_lat"), F.col("r_lon").alias("d_lon"), "order", one("contextual", "both").alias("ctx"), one("cusum", "both").alias("cus"))
    tiles = rows.groupBy("ty", "tx").agg(F.min("d_lat").alias("s"), F.max("d_lat").alias("n"), F.min("d_lon").alias("w"), F.max("d_lon").alias("e"), F.count("*").alias("met"), F.sum("ctx").alias("ctx"), F.sum("cus").alias("cus"), F.min("order").alias("order"))
    tiles = tiles.withColumn("lat", (F.col("s") + F.col("n")) / 2).withColumn("lon", (F.col("w") + F.col("e")) / 2)
    reach = F.greatest(*[haversine_km(F.col("lat"), F.col("lon"), F.col(c), F.col("w")) for c in ("s", "n")]) * (1 + 1e-9)  # from the middle to the farthest corner
    tiles = cut(tiles.select("ty", "tx", "lat", "lon", reach.alias("reach"), "met", "ctx", "cus", "order"))
    near = spatial_join(tiles, truth.select("truth_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")), km * (1 + 1 / parts))
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    inside = far + F.col("reach") <= km * (1 - 1e-9)
    sums = ["truth_id", "met", "ctx", "cus", "order"]
    rim = near.where(~inside & (far - F.col("reach") <= km * (1 + 1e-9))).select("ty", "tx", "truth_id", "r_lat", "r_lon")
    cut_by_rim = rows.join(rim, ["ty", "tx"]).where(haversine_km(F.col("r_lat"), F.col("r_lon"), F.col("d_lat"), F.col("d_lon")) <= km)
    every = near.where(inside).select(*sums).unionByName(cut_by_rim.withColumn("met", F.lit(1).cast("long")).select(*sums))
    return every.groupBy("truth_id").agg(F.sum("met").alias("n_met"), F.sum("ctx").alias("n_ctx_matches"), F.sum("cus").alias("n_cusum_matches"), F.min("order").alias("order"))


def false_alarms(dets: DataFrame, truth: DataFrame, cfg: EventConfig = EventConfig()) -> DataFrame:
    """Detections (lat, lon, obs_time) without a truth event (r_lat, r_lon, r_dt) near by within the hours."""
    seconds = F.abs(F.col("obs_time").cast("timestamp").cast("double") - F.col("r_dt").cast("timestamp").cast("double"))
    step = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (max(cfg.match_hours, 1) * 3_600_000_000)).cast("long")
    # an event meets three steps of time, so that a detection looks at few events however many lie around it
    right = truth.withColumn("__rstep", F.explode(F.sequence(step("r_dt") - 1, step("r_dt") + 1)))
    left = dets.withColumn("__step", step("obs_time"))
    return spatial_join(left, right, cfg.match_km, "left_anti", on=[("__step", "__rstep")], residual=seconds <= cfg.match_hours * 3600).drop("__step")


def latency(matched: DataFrame) -> DataFrame:
    """One row: mean, range and exact quantiles (linear between ranks) of the latency of matched events; null if none has one."""
    return matched.agg(*_latency())


def _latency() -> list[Column]:
    lat = F.when(F.col("matched"), F.nanvl(F.col("latency_min"), F.lit(None).cast("double")))
    q = F.percentile(lat, [p / 100 for p in LATENCY_PERCENTS])  # one buffer for all of them
    return [F.avg(lat).alias("latency_mean"), F.min(lat).alias("latency_min"), F.max(lat).alias("latency_max"), *[q[i].alias(f"latency_p{p}") for i, p in enumerate(LATENCY_PERCENTS)]]


def summary(matched: DataFrame, n_alarms: DataFrame, n_dets: DataFrame) -> DataFrame:
    """Detection, early and false-alarm rates, and the figures of ``latency``."""
    one = matched.agg(F.count("*").alias("n_truth"), F.count_if("matched").alias("n_matched"), F.count_if("early_detection").alias("n_early"), *_latency())
    out = one.crossJoin(n_alarms.agg(F.count("*").alias("n_false_alarms"))).crossJoin(n_dets.agg(F.count("*").alias("n_detections")))  # one row each
    return out.withColumns({"detection_rate": F.col("n_matched") / F.col("n_truth"), "early_rate": F.col("n_early") / F.col("n_truth"), "false_alarm_rate": F.col("n_false_alarms") / F.col("n_detections")})


def frp_histogram(matched: DataFrame) -> DataFrame:
    """Events and matches by radiative power, bins closed on the left; values outside them are dropped."""
    b = F.lit(None).cast("int")
    for i in range(len(FRP_EDGES) - 1):
        b = F.when((F.col("frp") >= FRP_EDGES[i]) & (F.col("frp") < FRP_EDGES[i + 1]), FRP_EDGES[i]).otherwise(b)
    return matched.withColumn("frp_from", b).where("frp_from is not null").groupBy("frp_from").agg(F.count("*").alias("n"), F.count_if("matched").alias("n_matched"))


def sigma_exceedance(series: DataFrame, ks: tuple[int, ...] = (2, 3, 4, 5)) -> DataFrame:
    """First time that btd exceeds the clear background by k deviations, per label and k (ts, btd, is_background)."""
    stats = series.where("is_background").groupBy("label").agg(F.avg("btd").alias("mu"), F.stddev_samp("btd").alias("sd"))
    k = F.explode(F.array(*[F.lit(x) for x in ks]))
    joined = series.where(~F.col("is_background")).join(stats, "label").withColumn("k", k)
    return joined.groupBy("label", "k").agg(F.min(F.when(F.col("btd") > F.col("mu") + F.col("k") * F.col("sd"), F.col("ts"))).alias("first_ts"))


def lead_hours(first: DataFrame, truth: DataFrame) -> DataFrame:
    """Hours from the first exceedance (label, k, first_ts) to the feed's first report (label, first_dt): positive where the
    exceedance came before it, null where there was none."""
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return first.join(truth.select("label", "first_dt"), "label").withColumn("hours_before", (seconds("first_dt") - seconds("first_ts")) / 3600)


def clear_sky_stats(series: DataFrame) -> DataFrame:
    """Mean, sample deviation and range of clear btd overall, by day and by night, and the cloud share, per label."""
    aggs = []
    for name, when in (("all", F.lit(True)), ("day", F.col("is_day")), ("night", ~F.col("is_day"))):
        v = F.when(~F.col("cloud") & when, F.col("btd"))
        aggs += [F.count(v).alias(f"n_{name}"), F.avg(v).alias(f"mean_{name}"), F.stddev_samp(v).alias(f"std_{name}"), F.min(v).alias(f"min_{name}"), F.max(v).alias(f"max_{name}")]
    return series.groupBy("label").agg(*aggs, F.avg(F.col("cloud").cast("int")).alias("cloud_fraction"))
