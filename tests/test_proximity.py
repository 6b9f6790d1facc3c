"""Closeness by cells against brute force, near poles and the date line, and with crowded cells."""

from __future__ import annotations

import math
import random

import pytest

from farfield.functions.columns import EARTH_KM
from farfield.operators import proximity


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1, h)))


def table(spark, points):
    return spark.createDataFrame([(k, g, *p) for k, (g, p) in enumerate(points)], "id long, g string, lat double, lon double")


@pytest.mark.parametrize(("radius", "few"), [(0.0, 4), (150.0, 4), (2500.0, 64), (30_000.0, 1)])
def test_close_rows_are_those_of_brute_force(spark, radius, few, monkeypatch):
    rng = random.Random(radius)
    place = lambda: (rng.choice([rng.uniform(-90, 90), rng.uniform(88, 90), rng.uniform(-2, 2), 45.0]), rng.choice([rng.uniform(-180, 180), rng.uniform(179, 180), rng.uniform(-180, -179), 10.0]))
    a = [(rng.choice("uv"), place()) for _ in range(220)]
    b = [(rng.choice("uv"), place()) for _ in range(120)] + a[:5]
    want = {(g, k) for k, (g, p) in enumerate(a) if any(h == g and km(p, q) <= radius for h, q in b)}
    monkeypatch.setattr(proximity.close_places, "__defaults__", ((), few))
    odd = [("u", (None, 1.0)), ("u", (float("nan"), 1.0)), ("v", (1.0, float("inf")))]
    got = {(r["g"], r["id"]) for r in proximity.purged(table(spark, a + odd), table(spark, b + odd), "id", radius, ("g",)).collect()}
    assert got == want and (radius or len(want) >= 5)


def test_crowds_cost_no_pairs(spark):
    rng = random.Random(4)
    crowd = [("u", (10 + rng.random() / 100, 20 + rng.random() / 100)) for _ in range(3000)]
    far = [("u", (10.45 + rng.random() / 100, 20 + rng.random() / 100)) for _ in range(3000)]
    source, target = table(spark, crowd + far), table(spark, [("u", (10 + rng.random() / 100, 20 + rng.random() / 100)) for _ in range(3000)])
    places, compared = proximity.close_places(source, target, 49.7, ("g",))
    got = {(r["lat"], r["lon"]) for r in places.collect()}
    border = [p for _, p in far if p in got]
    assert {p for _, p in crowd} <= got and 0 < len(border) < 3000  # the far crowd lies across the border
    assert compared < 3000 * 6000 / 20


def test_nothing_is_near_nothing(spark):
    some, none = table(spark, [("u", (1.0, 1.0))]), table(spark, [("u", (1.0, 1.0))]).where("false")
    assert proximity.purged(some, none, "id", 10.0).count() == 0 and proximity.purged(none, some, "id", 10.0).count() == 0
    assert proximity.purged(some, some, "id", 0.0).count() == 1
