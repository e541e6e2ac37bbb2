"""Fire events: association of detections, the confidence ladder, aggregates and upserts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embergrid.config import INACTIVE, EventConfig
from embergrid.functions.records import confidence_rank
from embergrid.operators.spatial import cells_near, home_cell, spread


def count_passes(times: Column, gap_minutes: int = 30) -> Column:
    """Observation passes in an array of timestamps: a new one begins over ``gap_minutes`` after the last one's start."""
    seconds = F.transform(F.array_sort(F.filter(times, lambda t: t.isNotNull())), lambda t: t.cast("double"))
    start = F.struct(F.lit(0).alias("n"), F.lit(float("-inf")).alias("last"))

    def step(acc, t):
        new = t - acc["last"] > gap_minutes * 60
        return F.struct((acc["n"] + F.when(new, 1).otherwise(0)).alias("n"), F.when(new, t).otherwise(acc["last"]).alias("last"))

    return F.aggregate(seconds, start, step, lambda acc: acc["n"])


def ladder(n_passes: Column, n_sources: Column) -> Column:
    return F.when(n_passes >= 3, "CONFIRMED").when((n_sources >= 2) | (n_passes >= 2), "LIKELY").otherwise("PROVISIONAL")


def _km(lat1, lon1, lat2, lon2) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    a = max(0.0, min(1.0, a))
    return 2 * 6371.0 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def fold_component(pdf: pd.DataFrame, radius_km: float) -> pd.DataFrame:
    """Detections of one component in order of arrival: each joins the nearest event strictly within the radius (the
    most recently seen one first among equals, then the older one) or opens one. Events are named by their first
    detection and found through the cell of their centroid, so that a detection meets only those around it."""
    pdf = pdf.sort_values("seq")
    high = radius_km / 111.19 * 1.001
    flat = pdf.lon.max() - pdf.lon.min() > 180 or pdf.lat.abs().max() > 85  # cells of all longitudes
    wide = 1e9 if flat else high / math.cos(math.radians(min(89.0, pdf.lat.abs().max() + high))) * 1.01
    cells: dict[tuple[int, int], dict[int, list]] = {}
    names, n_events = [], 0
    for seq, lat, lon, acq in zip(pdf.seq.tolist(), pdf.lat.tolist(), pdf.lon.tolist(), pdf.acq.tolist(), strict=True):
        y, x = math.floor(lat / high), math.floor(lon / wide)
        best = None
        for cy in (y - 1, y, y + 1):
            for cx in (x - 1, x, x + 1):
                for number, e in cells.get((cy, cx), {}).items():
                    d = _km(lat, lon, e[1], e[2])
                    if d < radius_km and (best is None or (d, -e[4], number) < best[0]):
                        best = (d, -e[4], number), (cy, cx), e
        if best is None:
            number, e = n_events, [seq, lat, lon, 1, acq]
            n_events += 1
        else:
            (_, _, number), old, e = best
            del cells[old][number]
            n = e[3]
            e[1:5] = (e[1] * n + lat) / (n + 1), (e[2] * n + lon) / (n + 1), n + 1, max(e[4], acq)
        cells.setdefault((math.floor(e[1] / high), math.floor(e[2] / wide)), {})[number] = e
        names.append(e[0])
    return pd.DataFrame({"seq": pdf.seq.to_numpy(), "event_seq": names})


def cell_components(places: DataFrame, km: float, step: str | None = None, most: int = 200) -> DataFrame:
    """(id, label) of the cells that hold places (lat, lon), joined where places of them may be ``km`` apart.

    With a column ``step`` of whole numbers, cells are those of one step of time and reach into the steps beside it, so that
    components end where a step stays empty. Labels run along whole components with pointer jumping over cell numbers;
    rounds are written to the shared folder.
    """
    from embergrid.sources.tables import cut

    at = ["cy", "cx", *([step] if step else [])]
    own = home_cell(places.select("lat", "lon", *at[2:]).distinct(), km).withColumn("id", F.xxhash64(*at)).drop("cy", "cx")
    ids = cut(own.select("id").distinct())
    around = spread(cells_near(own, km), 1, step) if step else cells_near(own, km)
    near = around.select("id", F.xxhash64(*at).alias("other")).where("id != other").distinct()
    near = near.join(ids.withColumnRenamed("id", "other"), "other", "left_semi")
    near = cut(near.union(near.select(F.col("id").alias("other"), F.col("other").alias("id")).select("other", "id")).distinct())
    labels = cut(ids.select("id", F.col("id").alias("label")))
    for _ in range(most):
        least = near.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("least"))
        new = labels.join(least, "id", "left").select("id", "label", F.least("label", "least").alias("l1"))
        jump = labels.select(F.col("id").alias("l1"), F.col("label").alias("l2"))
        new = cut(new.join(jump, "l1").select("id", "label", F.least("l1", "l2").alias("new")))
        labels, done = new.select("id", F.col("new").alias("label")), not new.where("new != label").limit(1).count()
        if done:
            return labels
    raise RuntimeError("cell components did not settle")


def associate(dets: DataFrame, cfg: EventConfig = EventConfig()) -> DataFrame:
    """Append event_seq, the arrival number of the detection that opened the row's event.

    An event's members stay within twice the radius of its last one, so events never leave a component of cells that wide;
    components are folded in parallel, each in order of arrival, with the result of one sequential pass. Input: seq
    (unique), lat, lon, acq. A component is as large as a connected burning area, which a task must hold.
    """
    km = 2 * cfg.radius_km * 1.02
    keyed = home_cell(dets, km).withColumn("id", F.xxhash64("cy", "cx"))
    labelled = keyed.join(cell_components(dets, km), "id")
    radius = cfg.radius_km
    folded = labelled.select("label", "seq", "lat", "lon", F.unix_micros(F.col("acq").cast("timestamp")).alias("acq")).groupBy("label").applyInPandas(lambda pdf: fold_component(pdf, radius), "seq long, event_seq long")
    return dets.join(folded, "seq")


def rollup(members: DataFrame, cfg: EventConfig = EventConfig()) -> DataFrame:
    """Events from their members (event_seq, seq, lat, lon, acq, source, confidence, frp)."""
    first = F.min_by("source", "seq")
    out = members.groupBy("event_seq").agg(
        F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"),
        F.when(first == "HIMAWARI", cfg.hotspot_uncertainty_m).otherwise(cfg.point_uncertainty_m).alias("location_uncertainty_m"),
        F.min("acq").alias("first_detection_time"), F.max("acq").alias("latest_detection_time"), F.count("*").alias("detection_count"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.max("frp").alias("max_frp"),
        F.max_by("confidence", F.struct(confidence_rank(F.col("confidence")), -F.col("seq"))).alias("max_confidence"),
        F.collect_list("acq").alias("__times"),
    )
    passes = count_passes(F.col("__times"), cfg.pass_gap_minutes)
    return out.withColumn("n_passes", passes).withColumn("status", ladder(F.col("n_passes"), F.size("sources"))).withColumn("source_set", F.array_join("sources", ",")).drop("__times", "sources")


def numbered(events: DataFrame, offset: int = 0) -> DataFrame:
    """Ids in order of creation. Creation numbers are unique, so ranges can be counted apart: no single sorting task."""
    from embergrid.sources.tables import cut

    parts = cut(events.repartitionByRange("event_seq").withColumn("__part", F.spark_partition_id()))
    local = parts.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy("event_seq")))
    sizes = parts.groupBy("__part").count()
    # one row a partition: a table whose size does not grow with the rows
    before = sizes.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    return local.join(F.broadcast(before), "__part").withColumn("id", F.col("__n") + F.col("__first") + offset).drop("__n", "__part", "__first")


def active(events: DataFrame) -> DataFrame:
    return events.where(~F.col("status").isin(*INACTIVE))


def running_centroid(members: DataFrame) -> DataFrame:
    w = Window.partitionBy("event_seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return members.withColumn("run_lat", F.avg("lat").over(w)).withColumn("run_lon", F.avg("lon").over(w))


def recent(dets: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Detections seen in the last ``hours`` (1 to 168) before a moment, or later."""
    if not 1 <= hours <= 168:
        raise ValueError(f"hours {hours} is not between 1 and 168")
    return dets.where(F.col("acq") >= as_of.cast("timestamp") - F.make_interval(hours=F.lit(hours)))


def insert_ignore(stored: DataFrame, new: DataFrame, key: str = "source_id", order: str = "seq") -> DataFrame:
    """Rows of ``new`` whose key is not stored, the first of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return new.join(stored.select(key), key, "left_anti").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")



def ingest_summary(stored: DataFrame, batch: DataFrame, key: str = "source_id") -> DataFrame:
    """One row: rows of the batch, those that are new, and duplicates (stored before, or repeated in the batch)."""
    fresh = batch.select(key).distinct().join(stored.select(key), key, "left_anti").agg(F.count("*").alias("new"))
    return batch.agg(F.count("*").alias("total")).crossJoin(fresh).select("total", "new", (F.col("total") - F.col("new")).alias("duplicates"))  # one row each


def system_status(detections: DataFrame, events: DataFrame) -> DataFrame:
    """One row: stored detections, events and active events."""
    e = events.agg(F.count("*").alias("total_events"), F.count_if(~F.col("status").isin(*INACTIVE)).alias("active_events"))
    return detections.agg(F.count("*").alias("total_detections")).crossJoin(e)  # one row each
