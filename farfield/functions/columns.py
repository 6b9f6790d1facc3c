"""Column expressions: safe ratios, finite values, hash order, calendar, geography."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: edges of ten calibration bins, as floating-point steps give them
TEN_BINS = tuple(k * 0.1 for k in range(1, 10))


def ratio(n: Column, d: Column, otherwise: float | None = None) -> Column:
    """n / d where d is not 0; else ``otherwise`` (null by default). Never raises under ANSI rules."""
    return F.when(d != 0, n.cast("double") / d).otherwise(F.lit(otherwise).cast("double"))


def finite(c: Column) -> Column:
    """c as double where it is a number; NaN and both infinities become null."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def scrubbed(c: Column) -> Column:
    """c with null, NaN and infinities as 0."""
    return F.coalesce(finite(c), F.lit(0.0))


def hash_order(seed: int | str, operation: str, *keys: Column) -> Column:
    """A key to sort by in place of a random draw: the same on every engine and for every partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(operation), *[k.cast("string") for k in keys]))


def calibration_bin(p: Column, edges: tuple[float, ...] = TEN_BINS) -> Column:
    """The number of edges at or below p: bins are closed on the left, the last one on both sides."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(p >= F.lit(e), 1).otherwise(0)
    return out


def ndvi(near_infrared: Column, red: Column, positive_only: bool = True) -> Column:
    """(nir - red) / (nir + red), 0 where the sum is not above 0 (or, if not ``positive_only``, where it is 0)."""
    d = near_infrared + red
    return F.when(d > 0 if positive_only else d != 0, (near_infrared - red) / d).otherwise(F.lit(0.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The unit vector of a point in degrees."""
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def spatial_block(lat: Column, lon: Column, degrees: float = 2.0) -> Column:
    """The name of the block of ``degrees`` by ``degrees``; ``unknown`` without a finite position."""
    row, col = F.floor((finite(lat) + 90) / degrees), F.floor((finite(lon) + 180) / degrees)
    return F.coalesce(F.concat(F.lit("block_"), row.cast("string"), F.lit("_"), col.cast("string")), F.lit("unknown"))


def synthetic_day_of_year(slot: Column) -> Column:
    """Day of year of the 15th of month slot 0 to 11 in a leap year; null outside."""
    days = [15, 46, 75, 106, 136, 167, 197, 228, 259, 289, 320, 350]
    return F.when((slot >= 0) & (slot < 12), F.element_at(F.array(*map(F.lit, days)), slot.cast("int") + 1))


def month_of_day(doy: Column) -> Column:
    """Month slot of a day of a year without a leap day; a day outside 1 to 365 counts as the first."""
    day = F.when((doy >= 1) & (doy <= 365), doy).otherwise(1).cast("int")
    return F.month(F.date_add(F.lit("2001-01-01").cast("date"), day - 1)) - 1


def window_year(end: Column, half_window_days: int = 183) -> Column:
    """Year of the middle of a yearly window that ends on a date given as text; 0 where it can't be read."""
    return F.coalesce(F.year(F.date_sub(F.to_date(F.try_to_timestamp(end)), half_window_days)), F.lit(0))


def half_up(x: Column) -> Column:
    """The nearest integer, halves up."""
    return F.floor(x + F.lit(0.5)).cast("long")


def ceil_div(n: Column, d: int) -> Column:
    return F.ceil(n / F.lit(d)).cast("long")


LOG2 = math.log(2)
