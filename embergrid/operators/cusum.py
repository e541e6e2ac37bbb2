"""The temporal detector: a diurnal Kalman model per pixel with two one-sided CUSUMs.

Four forms: the plain CUSUM as window functions; keyed folds as scans of sorted ranges; the full model frame by frame
(``run_frames``, for live frames); and the full model by tiles (``run_tiles``, for whole series), in which a tile runs all its frames by
itself and only what tiles tell their neighbours is exchanged.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embergrid.config import CusumConfig
from embergrid.operators.masks import has_neighbour
from embergrid.operators.scans import fold_runs, range_steps
from embergrid.operators.spatial import spread
from embergrid.sources.tables import cut

STATE = (
    "pixel_id long, x array<double>, p array<double>, s_slow double, s_fast double, n_obs int, last_clear double, last_update double, "
    "consecutive int, ema double, var_count int, var_mean double, var_m2 double"
)
OUT = STATE + ", frame_id long, row int, col int, clear boolean, z double, confidence double, anomaly double, z14 double, candidate boolean"
UPPER = np.triu_indices(6)


def cusum_by_windows(df: DataFrame, key: str, order: list[str], z: str, k: float, out: str) -> DataFrame:
    """S = max(0, S + z - k) from running sums: S is the sum less its least value so far (or zero)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__p", F.sum(F.col(z) - k).over(w)).withColumn(out, F.col("__p") - F.least(F.lit(0), F.min("__p").over(w))).drop("__p")


def consecutive_anomalies(df: DataFrame, key: str, order: list[str], flag: Column, out: str) -> DataFrame:
    """Length of the run of flagged rows that ends at each row."""
    w = Window.partitionBy(key).orderBy(*order)
    run = F.sum(F.when(flag, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("__run", run)
    inside = Window.partitionBy(key, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.when(flag, 1).otherwise(0)).over(inside)).drop("__run")


def decay_fold(df: DataFrame, key: str, k: float, tau: float = 10_800.0) -> DataFrame:
    """Final CUSUM per key with clouds: clear rows add z - k, cloudy ones decay by the time passed (t, ord, z, clear)."""

    def steps(pdf: pd.DataFrame, before: np.ndarray):
        clear, gone = pdf["clear"].to_numpy(bool), np.maximum(pdf["t"].to_numpy(float) - before, 0)
        return np.where(clear, 1.0, np.exp(-gone / tau)), np.where(clear, pdf["z"].to_numpy(float) - k, 0.0), np.zeros(len(pdf))

    def head(acc: Column, r: Column) -> Column:
        gone = F.greatest(F.coalesce(r["t"] - acc["last"], F.lit(0.0)), F.lit(0.0))  # no time has passed before the first row
        return F.when(r["clear"], F.greatest(F.lit(0.0), acc["x"] + r["z"] - k)).otherwise(acc["x"] * F.exp(-gone / tau))

    runs = range_steps(df.select(key, "t", "ord", "z", "clear"), key, ["t", "ord"], steps)
    return fold_runs(runs, key, F.lit(0.0), head).withColumnRenamed("x", "s")


def ema_fold(df: DataFrame, key: str, value: str, alpha: float) -> DataFrame:
    """Final exponential mean per key, from the first value on (t, ord)."""

    def steps(pdf: pd.DataFrame, before: np.ndarray):
        n = len(pdf)
        return np.full(n, 1 - alpha), alpha * pdf["v"].to_numpy(float), np.full(n, -np.inf)

    runs = range_steps(df.select(key, "t", "ord", F.col(value).cast("double").alias("v")), key, ["t", "ord"], steps)
    return fold_runs(runs, key, F.lit(None), lambda acc, r: F.coalesce(acc["x"] + alpha * (r["v"] - acc["x"]), r["v"])).select(key, F.col("x").alias("ema"))


def first_state(grid: DataFrame, cfg: CusumConfig = CusumConfig()) -> DataFrame:
    """State rows of pixels that were never seen."""
    p = np.diag(cfg.start_variance)[UPPER].tolist()
    null = F.lit(None).cast("double")
    return grid.select(
        "pixel_id", F.array(*[F.lit(0.0)] * 6).alias("x"), F.array(*map(F.lit, p)).alias("p"), F.lit(0.0).alias("s_slow"), F.lit(0.0).alias("s_fast"), F.lit(0).alias("n_obs"),
        null.alias("last_clear"), null.alias("last_update"), F.lit(0).alias("consecutive"), null.alias("ema"), F.lit(0).alias("var_count"), F.lit(0.0).alias("var_mean"), F.lit(0.0).alias("var_m2"),
    )


_SCALARS = ("s_slow", "s_fast", "n_obs", "last_clear", "last_update", "consecutive", "ema", "var_count", "var_mean", "var_m2")


def fresh_arrays(n: int, cfg: CusumConfig) -> dict[str, np.ndarray]:
    """State arrays of pixels that were never seen."""
    out = {c: np.full(n, np.nan) if c in ("last_clear", "last_update", "ema") else np.zeros(n, int if c in ("n_obs", "consecutive", "var_count") else float) for c in _SCALARS}
    return out | {"x": np.zeros((n, 6)), "p": np.tile(np.diag(cfg.start_variance), (n, 1, 1)).astype(float)}


def advance_arrays(s: dict[str, np.ndarray], f: dict[str, np.ndarray], cfg: CusumConfig) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """One frame for a batch of pixels: new state and outputs from state arrays and the frame's btd, bt14, clear, is_day,
    lon and t (UNIX seconds).

    Batched 6 x 6 algebra; cloudy pixels only predict and decay.
    """
    clear = f["clear"] & ~np.isnan(f["btd"]) & ~np.isnan(f["bt14"])
    t, day, bt14, n = f["t"], f["is_day"], f["bt14"], len(f["t"])
    ema = np.where(clear & np.isnan(s["ema"]), bt14, s["ema"])
    anomaly = np.where(clear, np.nan_to_num(bt14 - ema), 0.0)
    p = s["p"] + np.diag(np.square(cfg.process_std))
    hour = np.mod(np.mod(t, 86_400) / 3600 + f["lon"] / 15, 24) * 2 * math.pi / 24
    h = np.stack([np.ones(n), np.cos(hour), np.sin(hour), np.cos(2 * hour), np.sin(2 * hour), anomaly], axis=1)
    noise = np.where(day, cfg.noise.day, cfg.noise.night)
    ph = np.einsum("nij,nj->ni", p, h)
    spread = np.maximum(np.einsum("ni,ni->n", h, ph) + noise, 1e-6)
    v = np.where(clear, f["btd"] - np.einsum("ni,ni->n", h, s["x"]), 0.0)
    z = v / np.sqrt(spread)
    n_obs = s["n_obs"]
    ready = clear & (n_obs >= cfg.min_clear)
    keep = np.exp(-np.maximum(np.nan_to_num(t - s["last_update"]), 0) / cfg.decay_seconds)
    slow = np.where(ready, np.maximum(0, s["s_slow"] + z - cfg.k_slow), np.where(clear, s["s_slow"], s["s_slow"] * keep))
    fast = np.where(ready, np.maximum(0, s["s_fast"] + z - cfg.k_fast), np.where(clear, s["s_fast"], s["s_fast"] * keep))
    run = np.where(ready, np.where(z > cfg.anomaly_z, s["consecutive"] + 1, 0), np.where(clear, s["consecutive"], 0))
    odds = np.clip(math.log(cfg.prior / (1 - cfg.prior)) + cfg.log_odds_scale * np.maximum(slow, fast), -50, 50)
    conf = np.where(n_obs >= cfg.min_clear, 1 / (1 + np.exp(-odds)), np.nan)
    weight = np.where(np.isnan(conf), 1.0, np.maximum(1 - conf, cfg.min_weight))
    gain = weight[:, None] * ph / spread[:, None]
    a = np.eye(6) - np.einsum("ni,nj->nij", gain, h)
    post = np.einsum("nij,njk,nlk->nil", a, p, a) + noise[:, None, None] * np.einsum("ni,nj->nij", gain, gain)
    post = (post + post.transpose(0, 2, 1)) / 2
    count, mean, m2 = s["var_count"], s["var_mean"], s["var_m2"]
    var = np.where(count >= 2, np.maximum(m2 / np.maximum(count, 1), 1.0), 1.0)
    z14 = anomaly / np.sqrt(var)
    learn = clear & ~(conf >= cfg.ema_max_confidence)
    since = np.maximum(np.nan_to_num(t - s["last_clear"], nan=1.0), 1.0) if cfg.ema_dt_fix else np.ones(n)
    count = count + learn
    delta = bt14 - mean
    new_mean = np.where(learn, mean + delta / np.maximum(count, 1), mean)
    new = {
        "x": np.where(clear[:, None], s["x"] + gain * v[:, None], s["x"]), "p": np.where(clear[:, None, None], post, p), "s_slow": slow, "s_fast": fast, "n_obs": n_obs + clear,
        "last_clear": np.where(clear, t, s["last_clear"]), "last_update": t, "consecutive": run, "ema": np.where(learn, ema + (1 - np.exp(-since / cfg.ema_seconds)) * (bt14 - ema), ema),
        "var_count": count, "var_mean": new_mean, "var_m2": np.where(learn, m2 + delta * (bt14 - new_mean), m2),
    }
    hot = ready & (conf >= cfg.confidence) & ~((z14 > cfg.z14_low) & (z14 < cfg.z14_high))
    return new, {"clear": clear, "z": np.where(ready, z, np.nan), "confidence": conf, "anomaly": anomaly, "z14": z14, "candidate": hot}


_FRAME = ("t", "btd", "bt14", "clear", "is_day", "lon")


def _frame_arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: pdf[c].to_numpy(bool if c in ("clear", "is_day") else float) for c in _FRAME}


def _rows(ids: pd.DataFrame, state: dict[str, np.ndarray], out: dict[str, np.ndarray]) -> pd.DataFrame:
    """Output rows: pixel_id, frame_id, row and col with state and outputs."""
    p = state["p"][:, UPPER[0], UPPER[1]]
    return ids.assign(**(state | {"x": list(state["x"]), "p": list(p)} | out))[[c.split()[0] for c in OUT.split(", ")]]


def advance(s: pd.DataFrame, cfg: CusumConfig) -> pd.DataFrame:
    """One frame for a batch of pixels: state columns with the columns of ``advance_arrays``."""
    n = len(s)
    p = np.zeros((n, 6, 6))
    p[:, UPPER[0], UPPER[1]] = np.array(s["p"].tolist(), float).reshape(n, 21)
    state = {c: s[c].to_numpy(int if c in ("n_obs", "consecutive", "var_count") else float) for c in _SCALARS}
    state |= {"x": np.array(s["x"].tolist(), float).reshape(n, 6), "p": p + np.triu(p, 1).transpose(0, 2, 1)}
    return _rows(s[["pixel_id", "frame_id", "row", "col"]], *advance_arrays(state, _frame_arrays(s), cfg))


def step(state: DataFrame, frame: DataFrame, cfg: CusumConfig = CusumConfig()) -> DataFrame:
    """One frame for all pixels: model, neighbours, resets. Returns state and outputs, the S shown after the reset.

    frame: pixel_id, frame_id, row, col, lon, t, btd, bt14, clear, is_day, suppressed.
    """
    def run(batches):
        for pdf in batches:
            yield advance(pdf, cfg)

    joined = state.join(frame, "pixel_id")
    out = joined.mapInPandas(run, OUT).join(frame.select("pixel_id", "suppressed"), "pixel_id").withColumn("candidate", F.col("candidate") & ~F.col("suppressed")).drop("suppressed")
    if cfg.require_adjacent:
        out = has_neighbour(out, "candidate", "__near").withColumn("candidate", F.col("candidate") & F.col("__near")).drop("__near")
    zero = lambda c: F.when(F.col("candidate"), F.lit(0)).otherwise(F.col(c))
    return out.withColumns({"s_slow": zero("s_slow").cast("double"), "s_fast": zero("s_fast").cast("double"), "consecutive": zero("consecutive").cast("int")})


def run_frames(state: DataFrame, frames: list[DataFrame], cfg: CusumConfig = CusumConfig()):
    """All frames in order; yields each one's outputs, written once in the shared folder (resume from any of them)."""
    names = [c.split()[0] for c in STATE.split(", ")]
    for frame in frames:
        out = cut(step(state, frame, cfg))
        unseen = state.join(out.select("pixel_id"), "pixel_id", "left_anti")
        state = cut(out.select(*names).unionByName(unseen.select(*names)))
        yield out


def _run_tile(px: pd.DataFrame, beside: pd.DataFrame, cfg: CusumConfig):
    """All frames of a tile in order, with the hot pixels ``beside`` it (frame_id, row, col) given; yields (rows, state,
    outputs, alert) a frame, where alert marks the hot pixels that are not suppressed."""
    px = px.sort_values(["t", "frame_id", "row", "col"], kind="stable")
    ids, index = np.unique(px["pixel_id"].to_numpy(), return_inverse=True)
    state = fresh_arrays(len(ids), cfg)
    top, left = int(px["row"].min()) - 1, int(px["col"].min()) - 1
    high, wide = int(px["row"].max()) - top + 2, int(px["col"].max()) - left + 2
    near_by = {f: g for f, g in beside.groupby("frame_id")} if len(beside) else {}
    arrays, suppressed = _frame_arrays(px), px["suppressed"].to_numpy(bool)
    frame, row, col = px["frame_id"].to_numpy(), px["row"].to_numpy() - top, px["col"].to_numpy() - left
    cuts = np.flatnonzero((np.diff(frame) != 0) | (np.diff(arrays["t"]) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(px)], strict=True):
        on = index[a:b]
        new, out = advance_arrays({k: v[on] for k, v in state.items()}, {k: v[a:b] for k, v in arrays.items()}, cfg)
        alert = out["candidate"] & ~suppressed[a:b]
        reset = alert
        if cfg.require_adjacent and alert.any():
            grid = np.zeros((high, wide), np.int32)
            np.add.at(grid, (row[a:b][alert], col[a:b][alert]), 1)
            if (g := near_by.get(frame[a])) is not None:
                r, c = g["row"].to_numpy() - top, g["col"].to_numpy() - left
                inside = (r >= 0) & (r < high) & (c >= 0) & (c < wide)
                np.add.at(grid, (r[inside], c[inside]), 1)
            # pixels of one place do not make each other neighbours
            grid = np.minimum(grid, 1)
            sums = np.pad(grid, 1)
            sums = sum(sums[i : i + high, j : j + wide] for i in range(3) for j in range(3)) - grid
            reset = alert & (sums[row[a:b], col[a:b]] > 0)
        for c in ("s_slow", "s_fast", "consecutive"):
            new[c] = np.where(reset, 0, new[c])
        for k, v in new.items():
            state[k][on] = v
        yield px.iloc[a:b][["pixel_id", "frame_id", "row", "col"]], new, out | {"candidate": reset}, alert


def tile_side(pixels: DataFrame, rows: int = 1 << 20) -> int:
    """Side of square tiles whose whole series have about ``rows`` rows at most, between 4 and 64 pixels."""
    frames = pixels.groupBy("pixel_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    return max(4, min(64, math.isqrt(max(1, rows // frames))))


def run_tiles(pixels: DataFrame, cfg: CusumConfig = CusumConfig(), side: int | None = None) -> DataFrame:
    """The whole model over whole series, equal to running all frames in order.

    Tiles of ``side`` pixels run all their frames at once, with neighbours inside the tile decided as they go. What depends
    on pixels of other tiles starts from the guess that none of them is hot; then the tiles beside changed border pixels run again
    with the news, until nothing changes. A decision depends on earlier frames and on neighbours' heat of the same frame,
    which itself depends on earlier frames alone: each round settles at least one frame more, so the rounds end, and what they
    end with is the only solution. Rounds follow fires that cross tiles, not frames. A task holds one tile.

    pixels: pixel_id, frame_id, row, col, lon, t, btd, bt14, clear, is_day, suppressed; one row per pixel and frame.
    """
    side = side or tile_side(pixels)
    tile, edge = ("ty", "tx"), "ty long, tx long, frame_id long, row long, col long"
    at = lambda c: F.floor(F.col(c) / side).cast("long")
    px = pixels.withColumn("ty", at("row")).withColumn("tx", at("col"))
    nothing = px.sparkSession.createDataFrame([], edge)

    def border(key, mine: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        found = [rows[alert][["frame_id", "row", "col"]] for rows, _, _, alert in _run_tile(mine, beside, cfg) if alert.any()] if len(mine) else []
        hot = pd.concat(found) if found else pd.DataFrame({"frame_id": [], "row": [], "col": []}, dtype="int64")
        hot = hot[hot["row"].mod(side).isin((0, side - 1)) | hot["col"].mod(side).isin((0, side - 1))]
        return hot.assign(ty=key[0], tx=key[1])[["ty", "tx", "frame_id", "row", "col"]]

    def whole(key, mine: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        found = [_rows(rows, new, out) for rows, new, out, _ in _run_tile(mine, beside, cfg)] if len(mine) else []
        return pd.concat(found) if found else pd.DataFrame(columns=[c.split()[0] for c in OUT.split(", ")])

    def told(hot: DataFrame) -> DataFrame:
        """Border pixels, for each tile that they touch from outside."""
        near = spread(hot.withColumn("y", F.col("row")).withColumn("x", F.col("col")), 1, "y", "x").where((at("y") != F.col("ty")) | (at("x") != F.col("tx")))
        return near.select(at("y").alias("ty"), at("x").alias("tx"), "frame_id", "row", "col").distinct()

    def run(mine: DataFrame, beside: DataFrame, f, schema: str) -> DataFrame:
        return mine.groupBy(*tile).cogroup(beside.groupBy(*tile)).applyInPandas(f, schema)

    if not cfg.require_adjacent:
        return run(px, nothing, whole, OUT)
    px = cut(px)
    hot = cut(run(px, nothing, border, edge))
    beside = cut(told(hot))
    changed = cut(beside.select(*tile).distinct())
    while changed.limit(1).count():
        again = run(px.join(changed, list(tile), "left_semi"), beside.join(changed, list(tile), "left_semi"), border, edge)
        hot = cut(hot.join(changed, list(tile), "left_anti").unionByName(again))
        new = cut(told(hot))
        apart = beside.exceptAll(new).unionByName(new.exceptAll(beside))
        changed, beside = cut(apart.select(*tile).distinct()), new
    return run(px, beside, whole, OUT)


def run_series(pixels: DataFrame, cfg: CusumConfig = CusumConfig()) -> DataFrame:
    """Whole series per pixel, where neighbours have no say (require_adjacent False)."""
    return run_tiles(pixels, replace(cfg, require_adjacent=False))


def heatmap(out: DataFrame, floor: float = 0.05) -> DataFrame:
    """Display rows: finite probabilities from the floor on, rounded."""
    p = F.col("confidence")
    return out.where(p.isNotNull() & ~F.isnan(p) & (p >= floor)).select("row", "col", F.round(p, 4).alias("probability"), F.round("s_slow", 2).alias("s_slow"), F.round("s_fast", 2).alias("s_fast"))


def initialized_fraction(state: DataFrame, min_clear: int = 48) -> DataFrame:
    return state.agg(F.avg((F.col("n_obs") >= min_clear).cast("int")).alias("fraction"), F.median("n_obs").alias("median_n_obs"))


def reset_pixels(state: DataFrame, pixels: DataFrame, cfg: CusumConfig = CusumConfig()) -> DataFrame:
    """State with the given pixels (pixel_id) as never seen."""
    fresh = first_state(state.join(pixels, "pixel_id", "left_semi").select("pixel_id"), cfg)
    return state.join(pixels, "pixel_id", "left_anti").unionByName(fresh)


def to_detections(out: DataFrame, source: str = "HIMAWARI_CUSUM") -> DataFrame:
    """Detection records of the candidates, all of low confidence (needs lat, lon, obs_time, bt7 and is_day)."""
    from embergrid.functions.records import grid_source_id

    return out.where("candidate").select(
        grid_source_id(source, F.col("lat"), F.col("lon"), F.col("obs_time")).alias("source_id"), F.lit("HIMAWARI").alias("source"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        F.col("obs_time").alias("acq_datetime"), F.lit("low").alias("confidence"), F.col("bt7").alias("brightness"), F.when(F.col("is_day"), "D").otherwise("N").alias("daynight"),
    )


def predicted_btd(btd: Column, z: Column, is_day: Column, cfg: CusumConfig = CusumConfig()) -> Column:
    """What the model had expected, taken back from the score with the noise alone (an approximation)."""
    return btd - F.coalesce(z, F.lit(0.0)) * F.sqrt(F.when(is_day, cfg.noise.day).otherwise(cfg.noise.night))


def save_state(state: DataFrame, path: str, frame_no: int, version: int = 3) -> None:
    """A state table by version and frame; earlier frames stay, so that a failed write loses nothing."""
    state.select(*[c.split()[0] for c in STATE.split(", ")]).write.mode("overwrite").parquet(f"{path}/version={version}/frame_no={frame_no}")


def load_state(spark, path: str, grid: DataFrame, frame_no: int, version: int = 3, cfg: CusumConfig = CusumConfig()) -> DataFrame:
    """State of the grid's pixels at a frame; pixels that it lacks start anew, those off the grid go."""
    state = spark.read.schema(STATE).parquet(f"{path}/version={version}/frame_no={frame_no}").join(grid.select("pixel_id"), "pixel_id", "left_semi")
    return state.unionByName(first_state(grid.select("pixel_id").join(state.select("pixel_id"), "pixel_id", "left_anti"), cfg))
