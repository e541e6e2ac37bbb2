"""Spatial joins as equi-joins on cells with the exact distance as residual."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embergrid.functions.geo import EARTH_KM, cell, cell_in_row, cells_around, degrees_apart, haversine_km, row_degrees, tile, tile_high, tile_wide
from embergrid.sources.tables import cut

_BROADCAST_ROWS = 500_000  # tiles and places of a table that goes to every executor; larger ones are shuffled
_BROADCAST_PLACES = 75_000  # right rows of all pairs that go to every executor, each in nine cells; more are shuffled
_NOWHERE = -(1 << 40)  # the tile of rows without coordinates


def spread(df: DataFrame, reach: int, *names: str) -> DataFrame:
    """Each row once for every neighbouring cell: the named integer columns take all offsets up to ``reach``."""
    for n in names:
        df = df.withColumn(n, F.explode(F.sequence(F.col(n) - reach, F.col(n) + reach)))
    return df


def _known(cell_of: Column, sentinel: int) -> Column:
    """A cell that is never null, so that no join infers a filter that would work the whole expression out once more, in a
    method too large to be compiled. The sentinel stands for places without coordinates, which no distance admits."""
    return F.coalesce(cell_of, F.lit(sentinel).cast("long"))


def home_cell(df: DataFrame, km: float, lat: str = "lat", lon: str = "lon", y: str = "cy", x: str = "cx") -> DataFrame:
    """Append the cell of each row's place. Rows of cells are as wide as their latitude asks for."""
    high = row_degrees(km)
    return df.withColumn(y, _known(cell(F.col(lat), high), -(1 << 40))).withColumn(x, _known(cell_in_row(F.col(lon), cells_around(F.col(y), high)), -1))


def cells_near(df: DataFrame, km: float, lat: str = "lat", lon: str = "lon", y: str = "cy", x: str = "cx") -> DataFrame:
    """Each row once for every cell that may hold a place at most ``km`` away, across the antimeridian, too."""
    high = row_degrees(km)
    df = spread(df.withColumn(y, _known(cell(F.col(lat), high), 1 << 40)), 1, y).withColumn("__n", cells_around(F.col(y), high))
    own = cell_in_row(F.col(lon), F.col("__n"))
    return df.withColumn(x, F.explode(F.array_distinct(F.array(*[_known(F.pmod(own + o, F.col("__n")), -2) for o in (-1, 0, 1)])))).drop("__n")


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    km: float,
    how: str = "inner",
    on: list[tuple[str, str]] | None = None,
    residual: Column | None = None,
    strict: bool = False,
    repeat: str = "right",
) -> DataFrame:
    """Join rows (lat, lon on the left; r_lat, r_lon on the right) at most ``km`` apart.

    A left row lies in one cell and meets the right rows of the nine cells around it, so no pair comes twice; the right side is
    the one that is repeated and should be the smaller one. Rows of cells
    are as wide as their latitude asks for and close at the antimeridian, so that any place on the globe will do. ``how``
    is inner, left, left_semi or left_anti; ``on`` adds equalities, ``residual`` any condition over both sides. Where existence by
    distance alone is asked for, rows whose own tile holds a right row are settled without a look at distances.
    """
    if repeat == "left":  # of a small left side; a semi join may then give a row once for every cell, which the caller has to fold
        return _cell_join(left, right, km, how, on, residual, strict, repeat)
    if how in ("left_semi", "left_anti") and not on and residual is None:
        return _exists(left, right, km, how, strict)
    return _cell_join(left, right, km, how, on, residual, strict)


def _exists(left: DataFrame, right: DataFrame, km: float, how: str, strict: bool) -> DataFrame:
    """Existence by distance alone, in one pass over the left side. A tile that holds a right row settles its rows; only the other
    tiles near right rows list the places that their rows have to look at. The denser the right side, the fewer such tiles are left.
    The right side is worked out at once, so that the table's true size decides whether it is broadcast."""
    high = row_degrees(km)
    places = _tiled(right.select("r_lat", "r_lon").distinct(), km, "r_lat", "r_lon", "__sy", "__sx").where(F.col("__sy") != _NOWHERE)
    full = cut(places.select("__sy", "__sx").distinct())
    lists = _tiles_near(places.select("r_lat", "r_lon"), km, "r_lat", "r_lon", "__sy", "__sx").join(full, ["__sy", "__sx"], "left_anti").withColumn("__sure", F.lit(False))
    looks = cut(lists.unionByName(full.withColumn("__sure", F.lit(True)), allowMissingColumns=True))
    if looks.count() <= _BROADCAST_ROWS:
        looks = F.broadcast(looks)
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    near = F.col("__sure") | ((F.abs(F.col("lat") - F.col("r_lat")) <= high) & ((far < km) if strict else (far <= km)))
    mine = _tiled(left, km, "lat", "lon", "__ty", "__tx")
    return mine.join(looks, (F.col("__ty") == F.col("__sy")) & (F.col("__tx") == F.col("__sx")) & near, how).select(*left.columns)


def _turned(lon: Column) -> Column:
    """The longitude from -180 to 180."""
    return F.when(F.abs(lon) <= 180, lon).otherwise(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0)


def _tiled(df: DataFrame, km: float, lat: str, lon: str, y: str, x: str) -> DataFrame:
    """Append the tile of each row's place, all of whose places are within ``km`` of each other; never null (see ``_known``)."""
    known = (F.abs(F.col(lat)) < math.inf) & (F.abs(F.col(lon)) < math.inf)  # not a number is above all numbers
    at = tile(F.col(lat), _turned(F.col(lon)), km)
    return df.withColumn(y, _known(F.when(known, at["y"]), _NOWHERE)).withColumn(x, _known(F.when(known, at["x"]), _NOWHERE))


def _tiles_near(df: DataFrame, km: float, lat: str, lon: str, y: str, x: str) -> DataFrame:
    """Each row once or more for every tile of ``_tiled`` that may hold a place at most ``km`` away, across antimeridian and poles, too."""
    high, wide = tile_high(km), tile_wide(F.col(y), km)
    pad = row_degrees(km)
    # how far east a circle reaches; all around where it holds a pole
    turn = F.when(F.abs(F.col(lat)) + pad < 90, F.degrees(F.asin(math.sin(math.radians(min(pad, 90.0))) / F.cos(F.radians(F.col(lat))))) * 1.0001).otherwise(180.0)
    df = df.withColumn(y, F.explode(F.sequence(cell(F.col(lat) - pad, high), cell(F.col(lat) + pad, high))))
    df = df.withColumn("__turn", F.explode(F.array(*[_turned(F.col(lon)) + t for t in (-360.0, 0.0, 360.0)])))
    west, east = F.greatest(F.lit(-180.0), F.col("__turn") - turn), F.least(F.lit(180.0), F.col("__turn") + turn)
    return df.withColumn("__west", west).withColumn("__east", east).where("__west <= __east").withColumn(x, F.explode(F.sequence(F.floor(F.col("__west") / wide).cast("long"), F.floor(F.col("__east") / wide).cast("long")))).drop("__turn", "__west", "__east")


def _cell_join(left: DataFrame, right: DataFrame, km: float, how: str, on: list[tuple[str, str]] | None = None, residual: Column | None = None, strict: bool = False, repeat: str = "right") -> DataFrame:
    high = row_degrees(km)
    first, second = (home_cell, cells_near) if repeat == "right" else (cells_near, home_cell)
    a, b = first(left, km, y="__cy", x="__cx"), second(right, km, "r_lat", "r_lon", "__ry", "__rx")
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    # the cheap tests first: most pairs of neighbouring cells differ too much in latitude alone
    cond = (F.col("__cy") == F.col("__ry")) & (F.col("__cx") == F.col("__rx")) & (F.abs(F.col("lat") - F.col("r_lat")) <= high)
    for x, y in on or []:
        cond = cond & (F.col(x) == F.col(y))
    if residual is not None:
        cond = cond & residual
    return a.join(b, cond & ((far < km) if strict else (far <= km)), how).drop("__cy", "__cx", "__ry", "__rx")


def pairs_within(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """All pairs of rows (lat, lon on the left; r_lat, r_lon on the right) at most ``km`` apart, as an inner ``spatial_join`` has them.

    The result may grow with both sides, so little else takes disk: up to a bound, the right rows go to every task, as one list a
    cell, and the left ones are not moved; a task takes them cell by cell, so that neighbouring pairs repeat each other's ids, which
    columnar files hold in a fraction of the space. Beyond the bound both sides are shuffled and sorted by cells. The straight line
    through the globe settles a pair without a look at the distance, but for those at the very rim.
    """
    high, most = row_degrees(km), 4 * math.sin(min(km / EARTH_KM, math.pi) / 2) ** 2
    a = home_cell(left, km, y="__cy", x="__cx")
    b = _on_globe(cells_near(right, km, "r_lat", "r_lon", "__ry", "__rx"), "r_lat", "r_lon", "__b", -9.0)
    here = (F.col("__cy") == F.col("__ry")) & (F.col("__cx") == F.col("__rx"))
    if right.count() <= _BROADCAST_PLACES:
        cells = b.groupBy("__ry", "__rx").agg(F.collect_list(F.struct(*right.columns, "__b0", "__b1", "__b2")).alias("__all"))
        # Spark drops an order below a join, unless a column numbers the rows in it
        a = a.sortWithinPartitions("__cy", "__cx").withColumn("__cy", F.when(F.monotonically_increasing_id() >= 0, F.col("__cy")))
        met = _on_globe(a, "lat", "lon", "__a", 9.0).join(F.broadcast(cells), here).select(*left.columns, "__a0", "__a1", "__a2", F.inline("__all"))
    else:
        met = _on_globe(a, "lat", "lon", "__a", 9.0).join(b.hint("merge"), here)
    x, y, z = (F.col(f"__a{i}") - F.col(f"__b{i}") for i in range(3))
    line, far = x * x + y * y + z * z, haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    near = (F.abs(F.col("lat") - F.col("r_lat")) <= high) & (line <= most * (1 + 1e-6)) & ((line <= most * (1 - 1e-6)) | (far <= km))
    return met.where(near).select(*left.columns, *right.columns)


def _on_globe(df: DataFrame, lat: str, lon: str, name: str, nowhere: float) -> DataFrame:
    """Append the place on a globe of radius 1; without coordinates one far off, and never null (see ``_known``)."""
    la, lo = F.radians(F.col(lat)), F.radians(F.col(lon))
    at = (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))
    return df.withColumns({f"{name}{i}": F.coalesce(c, F.lit(nowhere)) for i, c in enumerate(at)})


def nearest_within(points: DataFrame, others: DataFrame, degrees: float, key: str, order: list[str], on: list[str] | None = None) -> DataFrame:
    """The nearest other place (r_lat, r_lon; then by ``order``) within ``degrees`` of each key's places (lat, lon), among
    those equal in ``on``: key, far and the order's columns; keys without one are left out.

    The first look goes only as far as holds four other rows where a typical one lies, and what finds none looks four times as
    far, up to ``degrees``. So the pairs that are looked at grow with the points, not with the density of the others.
    """
    on = on or []
    points, others = points.select(key, *on, "lat", "lon"), others.select(*on, "r_lat", "r_lon", *order)
    crowd = others.groupBy(*on, F.floor(F.col("r_lat") / degrees).alias("cy"), F.floor(F.col("r_lon") / degrees).alias("cx")).agg(F.count("*").cast("double").alias("n"))
    crowd = crowd.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("k")).first()["k"] or 1.0
    reach, found = min(degrees, degrees * math.sqrt(4 / (math.pi * crowd))), None
    if reach > degrees / 2:
        reach = degrees
    while True:
        best = _nearest_at(points, others, reach, key, order, on)
        if reach < degrees:
            best = cut(best)
        found = best if found is None else found.unionByName(best)
        if reach >= degrees:
            return found
        points = cut(points.join(best, key, "left_anti"))
        if points.isEmpty():
            return found
        reach = min(degrees, reach * 4)


def _nearest_at(points: DataFrame, others: DataFrame, reach: float, key: str, order: list[str], on: list[str]) -> DataFrame:
    wide, pad = 4 * reach, reach * 1.0001
    at = lambda c: F.floor(c / wide).cast("long")
    for y, c in (("cy", F.col("lat")), ("cx", F.col("lon"))):
        points = points.withColumn(y, F.explode(F.sequence(at(c - pad), at(c + pad))))
    met = points.join(others.withColumn("cy", at(F.col("r_lat"))).withColumn("cx", at(F.col("r_lon"))), [*on, "cy", "cx"])
    met = met.withColumn("far", degrees_apart(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))).where(F.col("far") <= reach)
    return met.groupBy(key).agg(F.min(F.struct("far", *order)).alias("m")).select(key, "m.*")
