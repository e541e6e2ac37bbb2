"""Several sensors on one fire: association with radii by sensor, expiry and merging of events, and matches across resolutions."""

from __future__ import annotations

import math
from collections import OrderedDict
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embergrid.config import FusionConfig
from embergrid.functions.geo import haversine_km
from embergrid.operators.events import _km, cell_components
from embergrid.operators.spatial import home_cell, spatial_join
from embergrid.sources.tables import cut

_MINUTE = 60_000_000


@lru_cache(maxsize=64)
def half_covered_km(r1: float, r2: float) -> float:
    """How near the centres of two circles are when just half of the smaller one lies in the other. It is less than the
    greater radius: a centre on the other's rim has less than half of its circle inside."""
    small, big = min(r1, r2), max(r1, r2)

    def shared(d: float) -> float:
        if d <= big - small:
            return math.pi * small * small
        if d >= big + small:
            return 0.0
        x, y = (d * d + small * small - big * big) / (2 * d * small), (d * d + big * big - small * small) / (2 * d * big)
        return small * small * (math.acos(x) - x * math.sqrt(1 - x * x)) + big * big * (math.acos(y) - y * math.sqrt(1 - y * y))

    low, high = 0.0, big + small
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if shared(middle) > math.pi * small * small / 2 else (low, middle)
    return low


class Fold:
    """Events of one component in order of time. An event is silent for at most the window, else it is forgotten, so that
    what is held is bounded by the events of one window, however long the component burns."""

    def __init__(self, cfg: FusionConfig):
        self.cfg = cfg
        self.high = max(cfg.coarse_km, cfg.fine_km, cfg.coarse_uncertainty_km, cfg.fine_uncertainty_km) / 111.19 * 1.001
        self.events: OrderedDict[int, list] = OrderedDict()  # the longest silent first: [lat, lon, n, latest, uncertainty, absorbed]
        self.cells: dict[tuple[int, int], dict[int, None]] = {}  # events by their centroids' cells

    def _cell(self, y: int, lon: float, aside: int = 0) -> tuple[int, int]:
        """The cell of a longitude in row y, or one beside it; rows close at the antimeridian."""
        reach = min(90.0, (max(abs(y), abs(y + 1)) + 1) * self.high)
        around = max(1, math.floor(360 * math.cos(math.radians(reach)) / (self.high * 1.05)))
        return y, (math.floor((lon + 180) / 360 * around) + aside) % around

    def _near(self, lat: float, lon: float, km) -> list[tuple[float, int, int]]:
        """(distance, -latest, event) of the events nearer than ``km(event)``, the nearest first."""
        y = math.floor(lat / self.high)
        found = []
        for key in {self._cell(cy, lon, o) for cy in (y - 1, y, y + 1) for o in (-1, 0, 1)}:
            for number in self.cells.get(key, ()):
                e = self.events[number]
                if (d := _km(lat, lon, e[0], e[1])) < km(e):
                    found.append((d, -e[3], number))
        return sorted(found)

    def _take(self, number: int) -> list:
        e = self.events.pop(number)
        key = self._cell(math.floor(e[0] / self.high), e[1])
        del self.cells[key][number]
        if not self.cells[key]:
            del self.cells[key]
        return e

    def _put(self, number: int, e: list) -> None:
        self.events[number] = e
        self.cells.setdefault(self._cell(math.floor(e[0] / self.high), e[1]), {})[number] = None

    def forget(self, before: float) -> list[tuple[int, int]]:
        """Drop events silent since before; (absorbed event, final event) of each."""
        out = []
        while self.events:
            number = next(iter(self.events))
            if self.events[number][3] >= before:
                break
            out += [(a, number) for a in self._take(number)[5]]
        return out

    def add(self, seq: int, lat: float, lon: float, acq: int, coarse: bool) -> int:
        """The event that the detection joins or opens."""
        radius, own = (self.cfg.coarse_km, self.cfg.coarse_uncertainty_km) if coarse else (self.cfg.fine_km, self.cfg.fine_uncertainty_km)
        best = self._near(lat, lon, lambda e: radius)
        if best:
            number = best[0][2]
            e = self._take(number)
            e = [(e[0] * e[2] + lat) / (e[2] + 1), (e[1] * e[2] + lon) / (e[2] + 1), e[2] + 1, acq, min(e[4], own), e[5]]
        else:
            number, e = seq, [lat, lon, 1, acq, own, []]
        joined = number
        for _, _, other in self._near(e[0], e[1], lambda o: half_covered_km(e[4], o[4])):
            o = self._take(other)
            n = e[2] + o[2]
            e = [(e[0] * e[2] + o[0] * o[2]) / n, (e[1] * e[2] + o[1] * o[2]) / n, n, acq, min(e[4], o[4]), e[5] + o[5] + [max(number, other)]]
            number = min(number, other)
        self._put(number, e)
        return joined


def fuse(dets: DataFrame, cfg: FusionConfig = FusionConfig()) -> DataFrame:
    """Append event_seq to detections (seq, lat, lon, acq, source): the first detection of the row's final event.

    In order of time (acq, then seq), a detection joins the nearest event within its sensor's radius that was seen within the
    window (the most recently seen one first among equals, then the older one), or opens one. The event's circle has the
    least uncertainty of its members. Events whose circles then share over half of the smaller one with the joined event's
    become one with it, named by the older.

    A centroid lies within the radius R of the last member, and within R + u behind a merge, u being the greatest
    uncertainty; so only detections within 2 (R + u) and one window of each other have to do with each other. Cells
    of that size and window are joined to components, each is folded by one task in sorted order, as a stream of batches.
    Repeated seqs are one detection's; rows without place or time have no event (null). An empty table gives an empty one.
    """
    radius, most = max(cfg.coarse_km, cfg.fine_km), max(cfg.coarse_uncertainty_km, cfg.fine_uncertainty_km)
    km, step = 2 * (radius + most) * 1.02, cfg.window_days * 1440 * _MINUTE
    micros = F.unix_micros(F.col("acq").cast("timestamp"))
    keyed = dets.where("lat is not null and lon is not null and acq is not null").select("seq", "lat", "lon", micros.alias("acq"), (F.col("source") == cfg.coarse_source).alias("coarse")).dropDuplicates(["seq"])
    keyed = keyed.withColumn("step", F.floor(F.col("acq") / step).cast("long"))
    homes = home_cell(keyed, km).withColumn("id", F.xxhash64("cy", "cx", "step"))
    labelled = homes.join(cell_components(keyed, km, "step"), "id").select("label", "seq", "lat", "lon", "acq", "coarse")
    told = lambda rows: pd.DataFrame(rows, columns=["seq", "event", "absorbed"]).astype({"seq": "int64", "event": "int64", "absorbed": bool})

    def run(batches):
        fold, label = None, None
        for pdf in batches:
            members, final = [], []
            for r in pdf.itertuples(index=False):
                if r.label != label:
                    final += fold.forget(math.inf) if fold else []
                    fold, label = Fold(cfg), r.label
                final += fold.forget(r.acq - step)
                members.append((r.seq, fold.add(r.seq, r.lat, r.lon, r.acq, bool(r.coarse)), False))
            yield told(members + [(a, e, True) for a, e in final])
        if fold:
            yield told([(a, e, True) for a, e in fold.forget(math.inf)])

    folded = cut(labelled.repartition("label").sortWithinPartitions("label", "acq", "seq").mapInPandas(run, "seq long, event long, absorbed boolean"))
    final = folded.where("absorbed").select(F.col("seq").alias("event"), F.col("event").alias("into"))
    named = folded.where("not absorbed").join(final, "event", "left").select("seq", F.coalesce("into", "event").alias("event_seq"))
    return dets.join(named, "seq", "left")


def cross_resolution(coarse: DataFrame, fine: DataFrame, cfg: FusionConfig = FusionConfig()) -> DataFrame:
    """Pairs of a coarse detection (seq, lat, lon, acq) and a fine one (r_seq, r_lat, r_lon, r_acq, r_source) that may be one fire:
    nearer than the coarse one's buffer, and no further apart in time than the fine one's source allows.

    An interval join on cells and time steps: a coarse row has one step, a fine row all steps that it may meet. Appends km and
    minutes (positive if the fine one is later). Rows without place or time, or of a source without a limit, meet none.
    """
    limits = {k: h * 60 * _MINUTE for k, h in cfg.match_hours}
    step = max(limits.values())
    limit = F.coalesce(*[F.when(F.col("r_source") == k, F.lit(m).cast("long")) for k, m in limits.items()])
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda t: F.floor(t / step).cast("long")
    left = coarse.withColumn("__t", at("acq")).withColumn("__step", bucket(F.col("__t")))
    right = fine.withColumn("__rt", at("r_acq")).withColumn("__limit", limit).where("__limit is not null and __rt is not null")
    right = right.withColumn("__rstep", F.explode(F.sequence(bucket(F.col("__rt") - F.col("__limit")), bucket(F.col("__rt") + F.col("__limit")))))
    in_time = F.abs(F.col("__rt") - F.col("__t")) <= F.col("__limit")
    met = spatial_join(left, right, cfg.buffer_km, on=[("__step", "__rstep")], residual=in_time, strict=True)
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    return met.withColumn("km", km).withColumn("minutes", (F.col("__rt") - F.col("__t")) / _MINUTE).drop("__t", "__rt", "__step", "__rstep", "__limit")


def refine(coarse: DataFrame, pairs: DataFrame, cfg: FusionConfig = FusionConfig()) -> DataFrame:
    """Coarse detections with the place and uncertainty of the nearest fine match (the earliest, then the least r_seq, among
    equals), or their own, and how many sources confirm them."""
    least = pairs.groupBy("seq", "r_source").agg(F.min("km").alias("km")).groupBy("seq").agg(F.min("km").alias("__km"), F.count("r_source").alias("n_sources"))
    return _refined(coarse, pairs.join(least.select("seq", "__km"), "seq"), least, cfg)


def match_and_refine(coarse: DataFrame, fine: DataFrame, cfg: FusionConfig = FusionConfig()) -> DataFrame:
    """``refine`` over the pairs of ``cross_resolution``. The pairs are never sorted: a first pass keeps the least distance by
    sums of fixed size, a second one only the pairs that have it."""
    pairs = cross_resolution(coarse, fine, cfg)
    least = cut(pairs.groupBy("seq", "r_source").agg(F.min("km").alias("km")).groupBy("seq").agg(F.min("km").alias("__km"), F.count("r_source").alias("n_sources")))
    return _refined(coarse, cross_resolution(coarse.join(least.select("seq", "__km"), "seq"), fine, cfg), least, cfg)


def _refined(coarse: DataFrame, pairs: DataFrame, least: DataFrame, cfg: FusionConfig) -> DataFrame:
    best = F.min(F.struct("km", F.col("r_acq").alias("t"), "r_seq", F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon"))).alias("m")
    found = pairs.where(F.col("km") <= F.col("__km") * (1 + 1e-12)).groupBy("seq").agg(best).join(least, "seq")
    out = coarse.join(found, "seq", "left")
    return out.select(
        *[F.col(c) for c in coarse.columns], F.col("m.r_seq").alias("match_seq"), F.coalesce("m.lat", coarse["lat"]).alias("refined_lat"), F.coalesce("m.lon", coarse["lon"]).alias("refined_lon"),
        F.when(F.col("m").isNull(), cfg.coarse_uncertainty_km).otherwise(cfg.fine_uncertainty_km).alias("uncertainty_km"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
    )
