"""Distance purge, footprints and coordinate clusters for located samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.functions.columns import EARTH_KM, finite, haversine_km, hash_order, sphere
from farfield.operators.proximity import close_places
from farfield.sources.scratch import cut


def require_finite(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``df`` itself; a row without finite coordinates raises when it is read."""
    bad = finite(F.col(lat)).isNull() | finite(F.col(lon)).isNull()
    return df.withColumn(lat, F.when(bad, F.raise_error(F.lit("coordinates are not finite")).cast("double")).otherwise(F.col(lat)))


def _cell(lat: Column, step: float) -> Column:
    return F.floor((lat + 90) / step).cast("int")


def near_pairs(source: DataFrame, target: DataFrame, key: str, radius_km: float, lat: str = "lat", lon: str = "lon", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, key, target_key, km) for every source and target point at most ``radius_km`` apart, by a grid join.

    The globe is cut into bands one radius high; in each band columns are wide enough, at its end nearest to a pole, that
    a partner lies in the same or the next column. Targets go to the 3 x 3 cells around theirs, modulo a full turn. Rows
    without finite coordinates pair with nothing.
    """
    step = math.degrees(radius_km / EARTH_KM) * 1.0001
    bands = math.ceil(180 / step)

    def columns(band: Column) -> Column:
        """How many columns a band has: each spans the radius at the band's narrower edge, one step further out."""
        edge = F.least(F.greatest(F.abs(band * step - 90), F.abs((band + 1) * step - 90)) + step, F.lit(90.0))
        width = F.lit(step) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-9))
        return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1)).cast("int")

    def turn(x: str) -> Column:
        return F.pmod(F.col(x) + 180, F.lit(360.0))

    ok = lambda d: d.where(finite(F.col(lat)).isNotNull() & finite(F.col(lon)).isNotNull())
    s = ok(source).withColumn("__band", _cell(F.col(lat), step)).withColumn("__n", columns(F.col("__band")))
    s = s.withColumn("__col", F.least(F.floor(turn(lon) / 360 * F.col("__n")).cast("int"), F.col("__n") - 1)).alias("s")
    t = ok(target).select(*by, F.col(key).alias("__tk"), F.col(lat).alias("__tlat"), F.col(lon).alias("__tlon"))
    t = t.withColumn("__band", F.explode(F.array(*[_cell(F.col("__tlat"), step) + k for k in (-1, 0, 1)]))).where(f"__band >= 0 and __band <= {bands}")
    t = t.withColumn("__n", columns(F.col("__band")))
    t = t.withColumn("__home", F.least(F.floor(turn("__tlon") / 360 * F.col("__n")).cast("int"), F.col("__n") - 1))
    t = t.withColumn("__col", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("__home") + k, F.col("__n")) for k in (-1, 0, 1)])))).alias("t")
    same = (F.col("s.__band") == F.col("t.__band")) & (F.col("s.__col") == F.col("t.__col"))
    for b in by:
        same = same & (F.col(f"s.{b}") == F.col(f"t.{b}"))
    km = haversine_km(F.col(f"s.{lat}"), F.col(f"s.{lon}"), F.col("t.__tlat"), F.col("t.__tlon"))
    joined = s.join(t, same).withColumn("km", km).where(F.col("km") <= radius_km)
    return joined.select(*[F.col(f"s.{b}") for b in by], F.col(f"s.{key}"), F.col("__tk").alias("target_key"), "km")


def leave_one_out(samples: DataFrame, key: str, domain: str, radius_km: float) -> tuple[DataFrame, DataFrame]:
    """For each domain in turn as the holdout: (holdout, key, role) of source and target rows, and (holdout, key) purged.

    One row of a pair for each holdout: the number of domains is small. A row without a domain takes no part. Places, not
    rows, are compared; a row then carries the holdouts that it is purged from, so that pairs of row and holdout are made at
    the end and never sorted or joined.
    """
    known = samples.where(F.col(domain).isNotNull() & ~F.col(domain).isin("unknown", "nan", ""))
    known_places = known.where(finite(F.col("lat")).isNotNull() & finite(F.col("lon")).isNotNull()).select(F.col(domain).alias("holdout"), "lat", "lon")
    places = cut(known_places.distinct(), "domains")
    holdouts = known.select(F.col(domain).alias("holdout")).distinct()
    names = F.broadcast(holdouts.agg(F.array_sort(F.collect_list("holdout")).alias("__holdouts")))
    sources = places.groupBy("lat", "lon").agg(F.min("holdout").alias("__a"), F.max("holdout").alias("__b")).crossJoin(F.broadcast(holdouts))
    sources = sources.where("__a != holdout or __b != holdout").select("holdout", "lat", "lon")  # a place of one domain is no source of it
    here, at = places.select("holdout", "lat", "lon"), ["holdout", "lat", "lon"]
    around, _ = close_places(sources.join(here, at, "left_anti"), places, radius_km, ("holdout",))
    around = around.unionByName(sources.join(here, at, "left_semi")).groupBy("lat", "lon").agg(F.collect_set("holdout").alias("__near"))
    near = known.select(key, domain, "lat", "lon").join(around, ["lat", "lon"]).select(key, F.explode(F.filter("__near", lambda h: h != F.col(domain))).alias("holdout"))
    near = cut(near.groupBy(key).agg(F.array_sort(F.collect_set("holdout")).alias("__gone")), "purged")
    rows = known.join(near, key, "left").crossJoin(names)
    left = F.filter("__holdouts", lambda h: ~F.array_contains(F.coalesce("__gone", F.array().cast(near.schema["__gone"].dataType)), h))
    kept = rows.withColumn("holdout", F.explode(left)).drop("__holdouts", "__gone").withColumn("role", F.when(F.col(domain) == F.col("holdout"), "target").otherwise("source"))
    return kept.select("holdout", key, *[c for c in samples.columns if c != key], "role"), near.select(F.explode("__gone").alias("holdout"), key)


def _hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of points in the plane, counter-clockwise, by monotone chains."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(rows) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(half(pts)[:-1] + half(pts[::-1])[:-1])


def _plane(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Azimuthal equidistant coordinates (km) around a centre."""
    a, b, c = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    cosine = F.least(F.greatest(F.sin(b) * F.sin(a) + F.cos(b) * F.cos(a) * F.cos(c), F.lit(-1.0)), F.lit(1.0))
    angle = F.acos(cosine)
    k = F.when(angle < 1e-12, F.lit(EARTH_KM)).otherwise(F.lit(EARTH_KM) * angle / F.greatest(F.sin(angle), F.lit(1e-15)))
    return k * F.cos(a) * F.sin(c), k * (F.cos(b) * F.sin(a) - F.sin(b) * F.cos(a) * F.cos(c))


def footprints(target: DataFrame, by: str = "holdout") -> DataFrame:
    """(by, lat0, lon0, hull): the convex hull of each target's points around their mean direction.

    Hulls are taken within partitions first; the hull of those is the hull of all, so no group meets in one place whole.
    """
    x, y, z = sphere(F.col("lat"), F.col("lon"))
    centre = target.groupBy(by).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(z).alias("z"))
    centre = centre.select(by, F.degrees(F.atan2("z", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))).alias("lat0"), F.degrees(F.atan2("y", "x")).alias("lon0"))
    px, py = _plane(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    flat = target.join(F.broadcast(centre), by).select(F.col(by).cast("string").alias("g"), "lat0", "lon0", px.alias("px"), py.alias("py"))

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for f in frames:
            for key, rows in f.groupby(["g", "lat0", "lon0"]):
                points = rows[["px", "py"]].to_numpy()
                held[key] = _hull(np.concatenate([held[key], points]) if key in held else points)
        for (g, a, b), h in held.items():
            yield pd.DataFrame({"g": g, "lat0": a, "lon0": b, "px": h[:, 0], "py": h[:, 1]})

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h = _hull(rows[["px", "py"]].to_numpy())
        return pd.DataFrame({by: [key[0]], "lat0": [key[1]], "lon0": [key[2]], "hull": [[{"x": float(p), "y": float(q)} for p, q in h]]})

    corners = flat.mapInPandas(part, "g string, lat0 double, lon0 double, px double, py double")
    return corners.groupBy("g", "lat0", "lon0").applyInPandas(whole, f"{by} string, lat0 double, lon0 double, hull array<struct<x:double,y:double>>")


def footprint_distance(source: DataFrame, hulls: DataFrame, by: str = "holdout") -> DataFrame:
    """Adds hull_km: how far each source row lies outside its holdout's hull; 0 inside and on the border."""
    px, py = _plane(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    rows = source.join(F.broadcast(hulls), by).withColumns({"__x": px, "__y": py})
    ring = F.zip_with("hull", F.concat(F.slice("hull", 2, 1_000_000), F.slice("hull", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    dx, dy = (lambda e: e["b"]["x"] - e["a"]["x"]), (lambda e: e["b"]["y"] - e["a"]["y"])
    inside = F.forall("__ring", lambda e: dx(e) * (F.col("__y") - e["a"]["y"]) - dy(e) * (F.col("__x") - e["a"]["x"]) >= -1e-9) & (F.size("hull") > 2)

    def distance(e: Column) -> Column:
        length = dx(e) * dx(e) + dy(e) * dy(e)
        t = F.when(length > 0, ((F.col("__x") - e["a"]["x"]) * dx(e) + (F.col("__y") - e["a"]["y"]) * dy(e)) / length).otherwise(0.0)
        t = F.greatest(F.least(t, F.lit(1.0)), F.lit(0.0))
        return F.sqrt((F.col("__x") - e["a"]["x"] - t * dx(e)) ** 2 + (F.col("__y") - e["a"]["y"] - t * dy(e)) ** 2)

    out = rows.withColumn("__ring", ring).withColumn("hull_km", F.when(inside, 0.0).otherwise(F.array_min(F.transform("__ring", distance))))
    return out.drop("__x", "__y", "__ring", "lat0", "lon0", "hull")


def in_footprint(source: DataFrame, hulls: DataFrame, buffer_km: float, by: str = "holdout") -> DataFrame:
    """The source rows inside the hull or within ``buffer_km`` of it."""
    return footprint_distance(source, hulls, by).where(F.col("hull_km") <= buffer_km)


def _located() -> Column:
    return finite(F.col("lat")).isNotNull() & finite(F.col("lon")).isNotNull()


def cell_labels(samples: DataFrame, key: str, k: int = 5, seed: int = 0, rounds: int = 25) -> Column:
    """The coordinate cell of a row by its finite lat and lon, ``cluster_00`` and on by mean latitude, then longitude.

    Lloyd's rounds over unit vectors as plain aggregates; the k centres are the only thing on the driver. Rows are read twice:
    for the first row in hash order, which is the first centre, and for the distinct places with their numbers of rows, over
    which all rounds go. Each further centre is the place farthest from those there are, so the result doesn't depend on
    partitioning. Fewer than k distinct points, or an empty cell, raise.
    """
    located = samples.where(_located())
    axes = sphere(F.col("lat"), F.col("lon"))

    def gap(c: tuple, at: tuple[Column, ...]) -> Column:
        return F.round(sum(((a - v) ** 2 for a, v in zip(at[1:], c[1:], strict=True)), (at[0] - c[0]) ** 2), 12)

    first = located.orderBy(hash_order(seed, "cells", F.col(key)), key).select(*[a.alias(n) for a, n in zip(axes, "xyz", strict=True)]).first()
    if first is None:
        raise ValueError("no point to cluster")
    counted = located.groupBy("lat", "lon").agg(F.count("*").alias("n"))
    places = cut(counted.withColumns(dict(zip("xyz", axes, strict=True))), "clusters")
    xyz = tuple(F.col(a) for a in "xyz")
    centres = [tuple(first)]
    while len(centres) < k:
        far = places.select("x", "y", "z", F.least(*[gap(c, xyz) for c in centres], F.lit(9.0)).alias("g")).agg(F.max_by(F.struct("x", "y", "z", "g"), F.struct("g", "x", "y", "z")).alias("m")).first()["m"]
        if far["g"] <= 0:
            raise ValueError(f"there are fewer than {k} distinct points")
        centres.append((far["x"], far["y"], far["z"]))

    def nearest(at: tuple[Column, ...]) -> Column:
        return F.array_min(F.array(*[F.struct(gap(c, at).alias("g"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))["i"]

    def means(*columns: str) -> list:
        return places.withColumn("c", nearest(xyz)).groupBy("c").agg(*[(F.sum(F.col(a) * F.col("n")) / F.sum("n")).alias(a) for a in columns]).collect()

    for _ in range(rounds):
        found = means(*"xyz")
        if len(found) < k:
            raise ValueError("a cell is empty")
        new = [tuple(round(r[a], 12) for a in "xyz") for r in sorted(found, key=lambda r: r["c"])]
        if new == centres:
            break
        centres = new
    order = sorted(means("lat", "lon"), key=lambda r: (round(r["lat"], 9), round(r["lon"], 9)))
    names = {r["c"]: f"cluster_{i:02d}" for i, r in enumerate(order)}
    return F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), nearest(axes))


def cluster_cells(samples: DataFrame, key: str, k: int = 5, seed: int = 0, rounds: int = 25) -> DataFrame:
    """(key, cluster): the coordinate cell of each row with finite coordinates."""
    return in_cells(samples, key, k, seed, rounds).select(key, "cluster")


def in_cells(samples: DataFrame, key: str, k: int = 5, seed: int = 0, rounds: int = 25) -> DataFrame:
    """The rows with finite coordinates and their coordinate cell as ``cluster``."""
    return samples.where(_located()).withColumn("cluster", cell_labels(samples, key, k, seed, rounds))


def geography_audit(source: DataFrame, target: DataFrame, hulls: DataFrame, key: str, buffer_km: float, search_km: float, by: str = "holdout") -> DataFrame:
    """(by, n_source, n_in_hull, n_in_buffer, min_km): how close each holdout's source comes; min_km is null beyond ``search_km``."""
    away = footprint_distance(source, hulls, by)
    counts = away.groupBy(by).agg(F.count("*").alias("n_source"), F.sum(F.when(F.col("hull_km") == 0, 1).otherwise(0)).alias("n_in_hull"), F.sum(F.when(F.col("hull_km") <= buffer_km, 1).otherwise(0)).alias("n_in_buffer"))
    close = near_pairs(source, target, key, search_km, by=(by,)).groupBy(by).agg(F.min("km").alias("min_km"))
    return counts.join(close, by, "left")
