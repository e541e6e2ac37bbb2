"""Calibration of the temporal model on single series, and lookups of targets on the grid."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embergrid.config import CusumConfig
from embergrid.operators.spatial import nearest_within

SERIES = "label string, obs_time timestamp, btd double, btd_predicted double, residual double, z_score double, cusum_s double"


def follow(pdf: pd.DataFrame, cfg: CusumConfig = CusumConfig(), gate: float = 2.0) -> pd.DataFrame:
    """Series of any number of targets in time, all targets' next rows together: five harmonic terms, learning only from
    scores inside the gate; rows without a clear value carry the CUSUM on."""
    pdf = pdf.sort_values(["label", "obs_time"], kind="stable", ignore_index=True)
    target = pdf.groupby("label", sort=False, dropna=False).ngroup().to_numpy()
    nth = pdf.groupby("label", sort=False, dropna=False).cumcount().to_numpy()
    n, m = len(pdf), int(target.max()) + 1 if len(pdf) else 0
    x, p = np.zeros((m, 5)), np.tile(np.diag(cfg.start_variance[:5]), (m, 1, 1)).astype(float)
    q, total, learned = np.diag(np.square(cfg.process_std[:5])), np.zeros(m), np.zeros(m, int)
    btd, t = pdf["btd"].to_numpy(float), pdf["obs_time"].dt
    clear = (pdf["cloud_flag"].to_numpy() == 0) & ~np.isnan(btd)
    w = 2 * math.pi / 24 * np.mod(t.hour.to_numpy() + t.minute.to_numpy() / 60 + pdf["lon"].to_numpy(float) / 15, 24)
    terms = np.stack([np.ones(n), np.cos(w), np.sin(w), np.cos(2 * w), np.sin(2 * w)], axis=1)
    noise = np.where(pdf["is_day"].to_numpy(bool), cfg.noise.day, cfg.noise.night)
    out = {c: np.full(n, np.nan) for c in ("btd_predicted", "residual", "z_score")} | {"cusum_s": np.zeros(n)}
    order = np.argsort(nth, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(nth[order])) + 1):
        rows_clear = rows[clear[rows]]
        k, h = target[rows_clear], terms[rows_clear]
        p[k] += q
        ph = np.einsum("nij,nj->ni", p[k], h)
        spread = np.maximum(np.einsum("ni,ni->n", h, ph) + noise[rows_clear], 1e-6)
        expected = np.einsum("ni,ni->n", h, x[k])
        left = btd[rows_clear] - expected
        z = left / np.sqrt(spread)
        total[k] = np.where(learned[k] >= cfg.min_clear, np.maximum(0.0, total[k] + z - cfg.k_slow), 0.0)
        out["btd_predicted"][rows_clear], out["residual"][rows_clear], out["z_score"][rows_clear] = expected.round(3), left.round(3), z.round(3)
        out["cusum_s"][rows_clear] = total[k].round(3)
        hidden = rows[~clear[rows]]
        out["cusum_s"][hidden] = total[target[hidden]]
        inside = np.abs(z) < gate
        k, h, gain = k[inside], h[inside], (ph / spread[:, None])[inside]
        x[k] += gain * left[inside, None]
        p[k] -= np.einsum("ni,nj,njk->nik", gain, h, p[k])
        learned[k] += 1
    return pdf[["label", "obs_time", "btd"]].assign(**out)[[c.split()[0] for c in SERIES.split(", ")]]


def follow_targets(series: DataFrame, cfg: CusumConfig = CusumConfig(), together: int = 64) -> DataFrame:
    """Every target's series on its own (label, obs_time, btd, cloud_flag, is_day, lon); a task takes some of ``together`` groups of targets."""
    return series.groupBy(F.pmod(F.xxhash64("label"), F.lit(together)).alias("__group")).applyInPandas(lambda pdf: follow(pdf, cfg), SERIES)


def nearest_pixel(targets: DataFrame, grid: DataFrame, degrees: float = 0.1) -> DataFrame:
    """Each target's nearest pixel (by degrees, then row and column) among those within ``degrees``; null beyond.

    targets: label, lat, lon; grid: row, col, r_lat, r_lon.
    """
    best = nearest_within(targets, grid, degrees, "label", ["row", "col"])
    return targets.join(best, "label", "left").select(*targets.columns, "row", "col", F.col("far").alias("pixel_dist_deg"))


def nearest_pixel_anywhere(targets: DataFrame, grid: DataFrame, degrees: float = 0.1) -> DataFrame:
    """Each target's nearest pixel however far away it is: what finds none within ``degrees`` looks eight times as far,
    until all have one. Null only for an empty grid or a target without a place. At most nine rounds, each over the
    targets that are left."""
    from embergrid.sources.tables import cut

    found, left = None, targets
    while True:
        met = cut(nearest_pixel(left, grid, degrees))
        done = met if degrees > 510 else met.where(F.col("pixel_dist_deg").isNotNull())  # no two places are farther apart
        found = done if found is None else found.unionByName(done)
        left = met.where(F.col("pixel_dist_deg").isNull()).select(*targets.columns)
        if degrees > 510 or left.isEmpty():
            return found
        degrees *= 8


def background_partner(fires: DataFrame, others: DataFrame, degrees: float = 0.01) -> DataFrame:
    """For each fire target the first other target (by o_label) within ``degrees`` in both coordinates."""
    cells = lambda df, la, lo: df.withColumn("cy", F.floor(F.col(la) / degrees)).withColumn("cx", F.floor(F.col(lo) / degrees))
    from embergrid.operators.spatial import spread

    met = spread(cells(fires, "lat", "lon"), 1, "cy", "cx").join(cells(others, "o_lat", "o_lon"), ["cy", "cx"])
    near: Column = (F.abs(F.col("lat") - F.col("o_lat")) < degrees) & (F.abs(F.col("lon") - F.col("o_lon")) < degrees)
    return met.where(near).groupBy("label").agg(F.min("o_label").alias("background"))


def eligible_truth(truth: DataFrame, observed: DataFrame, hours: int = 24) -> DataFrame:
    """Truth events (first_dt) within ``hours`` of the observed period (obs_time); the bounds are one row."""
    pad = F.expr(f"INTERVAL {hours} HOURS")
    bounds = observed.agg((F.min("obs_time").cast("timestamp") - pad).alias("__lo"), (F.max("obs_time").cast("timestamp") + pad).alias("__hi"))
    return truth.crossJoin(F.broadcast(bounds)).where(F.col("first_dt").cast("timestamp").between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
