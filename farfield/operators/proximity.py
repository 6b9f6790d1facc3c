"""Which points lie within a distance of others: whole cells are settled by their least and greatest distance.

Distinct points stand in cells of the unit sphere's space, one distance wide at first. Two cells whose bounding boxes are
nowhere farther apart settle all points of the one at once; cells that are nowhere close enough drop out. Pairs of cells that
the border of the distance crosses are halved in each direction, and only pairs with few points are compared point by point.
So points that crowd together cost no pairs, and what is compared grows with the border alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.functions.columns import EARTH_KM, finite, haversine_km, sphere
from farfield.sources.scratch import cut

FEW = 1024  # pairs of points of two cells that are compared as they are
MARGIN = 1e-9  # of squared distances, between boxes and the great circle
_AXES = "xyz"


def _points(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Distinct places with finite coordinates, on the unit sphere."""
    places = rows.where(finite(F.col("lat")).isNotNull() & finite(F.col("lon")).isNotNull()).select(*by, "lat", "lon").distinct()
    return places.withColumns(dict(zip(_AXES, sphere(F.col("lat"), F.col("lon")), strict=True)))


def _boxes(points: DataFrame, by: tuple[str, ...], size: float, side: str) -> DataFrame:
    """A row for each occupied cell: its place, the place it came from, its bounding box and its number of points."""
    cell = [F.floor((F.col(a) + 1) / size).alias(f"{side}{a}") for a in _AXES]
    box = [f(a).alias(f"{side}{a}_{n}") for a in _AXES for n, f in (("low", F.min), ("high", F.max))]
    boxes = points.select(*by, *_AXES, *cell).groupBy(*by, *[f"{side}{a}" for a in _AXES]).agg(F.count("*").alias(f"{side}_n"), *box)
    return boxes.withColumns({f"{side}{a}_up": F.floor(F.col(f"{side}{a}") / 2) for a in _AXES})


def _gaps() -> tuple[Column, Column]:
    """Squared least and greatest distance of two boxes."""
    least, most = F.lit(0.0), F.lit(0.0)
    for a in _AXES:
        up, down = F.col(f"s{a}_high") - F.col(f"t{a}_low"), F.col(f"t{a}_high") - F.col(f"s{a}_low")
        gap = F.greatest(-up, -down, F.lit(0.0))
        least, most = least + gap * gap, most + F.pow(F.greatest(up, down), 2)
    return least, most


def _cells(side: str) -> list[str]:
    return [f"{side}{a}" for a in _AXES]


def close_places(source: DataFrame, target: DataFrame, radius_km: float, by: tuple[str, ...] = (), few: int = FEW) -> tuple[DataFrame, int]:
    """(by, lat, lon) of the places of ``source`` at most ``radius_km`` from a place of ``target``, and how many pairs of places were compared."""
    chord = 2 * math.sin(min(radius_km / (2 * EARTH_KM), math.pi / 2))
    size = max(chord, 1e-7)
    s, t = cut(_points(source, by), "places"), cut(_points(target, by), "places")
    least, most = _gaps()
    square = chord * chord
    found, compared, pairs = None, 0, None
    while True:
        left, right = _boxes(s, by, size, "s"), _boxes(t, by, size, "t")
        if pairs is None:
            around = F.explode(F.array(*[F.struct(*[(F.col(f"t{a}") + d).alias(f"s{a}") for a, d in zip(_AXES, step, strict=True)]) for step in ((i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))]))
            met = left.join(right.withColumn("near", around).select("*", "near.*").drop("near"), [*by, *_cells("s")])
        else:
            up = lambda side: [F.col(f"{side}{a}_up").alias(f"{side}{a}_in") for a in _AXES]
            links = pairs.select(*by, *[F.col(c).alias(f"{c}_in") for c in (*_cells("s"), *_cells("t"))])
            met = links.join(left.select("*", *up("s")), [*by, *[f"{c}_in" for c in _cells("s")]]).join(right.select("*", *up("t")), [*by, *[f"{c}_in" for c in _cells("t")]])
        state = F.when(most <= square * (1 - MARGIN), "near").when(least <= square * (1 + MARGIN), "open")
        judged = cut(met.select(*by, *_cells("s"), *_cells("t"), "s_n", "t_n", state.alias("state")).where("state is not null"), "cells")
        settled = judged.where("state = 'near'").select(*by, *_cells("s")).distinct()
        at = lambda points, side: points.withColumns({f"{side}{a}": F.floor((F.col(a) + 1) / size) for a in _AXES})  # noqa: E731, B023
        inside = at(s, "s").join(settled, [*by, *_cells("s")]).select(*by, "lat", "lon")
        open_ = judged.where("state = 'open'").join(settled, [*by, *_cells("s")], "left_anti")
        small = open_.where(F.col("s_n") * F.col("t_n") <= few)
        other = at(t, "t").select(*by, *_cells("t"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
        looked = small.join(at(s, "s").select(*by, *_cells("s"), "lat", "lon"), [*by, *_cells("s")]).join(other, [*by, *_cells("t")])
        hit = looked.where(haversine_km(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon")) <= radius_km).select(*by, "lat", "lon")
        level = cut(inside.union(hit).distinct(), "close")
        found = level if found is None else found.union(level)
        compared += small.agg(F.sum(F.col("s_n") * F.col("t_n"))).first()[0] or 0
        pairs = cut(open_.where(F.col("s_n") * F.col("t_n") > few), "open")
        if pairs.isEmpty():
            return found.distinct(), compared
        s = cut(at(s, "s").join(pairs.select(*by, *_cells("s")).distinct(), [*by, *_cells("s")], "left_semi").select(*by, "lat", "lon", *_AXES), "places")
        t = cut(at(t, "t").join(pairs.select(*by, *_cells("t")).distinct(), [*by, *_cells("t")], "left_semi").select(*by, "lat", "lon", *_AXES), "places")
        size /= 2


def purged(source: DataFrame, target: DataFrame, key: str, radius_km: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, key): source rows at most ``radius_km`` from any target row. Rows without finite coordinates are near nothing."""
    places, _ = close_places(source, target, radius_km, by)
    return source.select(*by, "lat", "lon", key).join(places, [*by, "lat", "lon"]).select(*by, key).distinct()
