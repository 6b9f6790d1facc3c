"""Purge by places that many rows share, clusters over places, and folds counted in parts."""

from __future__ import annotations

import hashlib
import math
import random

from farfield.operators import catalogue, proximity, spatial


def _shared(spark, n=600):
    rng = random.Random(7)
    spots = [(rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(20)]
    rows = [(k, rng.choice(["u", "v", "w", "unknown", None]), *(spots[rng.randrange(20)] if k % 17 else (float("nan"), 1.0))) for k in range(n)]
    return spark.createDataFrame(rows, "k long, d string, lat double, lon double")


def test_rows_of_shared_places_cost_no_pairs(spark, monkeypatch):
    rows, seen, plain = _shared(spark), [], spatial.close_places
    want = {(h, r["k"]) for h in "uvw" for r in rows.where(f"d in ('u', 'v', 'w') and d <> '{h}'").join(proximity.purged(rows, rows.where(f"d = '{h}'"), "k", 60.0), "k").collect()}
    monkeypatch.setattr(spatial, "close_places", lambda s, t, *a: (seen.extend((s.count(), t.count())), plain(s, t, *a))[1])
    kept, gone = spatial.leave_one_out(rows, "k", "d", 60.0)
    assert {(r["holdout"], r["k"]) for r in gone.collect()} == want and len(want) == gone.count()
    every = {(h, r["k"]) for h in "uvw" for r in rows.where("d in ('u', 'v', 'w')").collect()}
    assert {(r["holdout"], r["k"]) for r in kept.collect()} == every - want and kept.count() == len(every - want)
    assert max(seen) <= 60  # 20 places of 3 domains, not 600 rows


def test_folds_are_counted_in_parts(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("id % 3 as f", "if(id % 50 = 0, null, id % 90) as p", "cast(id % 4 as int) as t", "cast(id % 5 as int) as y")
    monkeypatch.setattr(catalogue, "PART_ROWS", 300)
    got = {r["f"]: (r["n_pixels"], r["n_patches"], r["n_tiles"]) for r in catalogue.fold_stats(rows, ["f"], "p", ["t"], "y").collect()}
    want = rows.selectExpr("f", "p", "t").groupBy("f").agg({"*": "count"}).collect()
    plain = {r["f"]: (r["a"], r["b"], r["c"]) for r in spark.sql("select f, count(*) a, count(distinct p) b, count(distinct p, t) c from {r} group by f", r=rows).collect()}
    assert got == plain and len(want) == 3


def test_cells_are_found_over_places_and_weigh_rows(spark, monkeypatch):
    rng = random.Random(3)
    spots = [(rng.uniform(-60, 60), rng.uniform(-180, 180)) for _ in range(30)]
    rows = [(k, *spots[min(int(rng.expovariate(0.15)), 29)]) for k in range(900)] + [(900, None, 1.0), (901, 1.0, float("nan"))]
    df, sizes, plain = spark.createDataFrame(rows, "k long, lat double, lon double").repartition(5), {}, spatial.cut

    def counted(frame, label):
        out = plain(frame, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(spatial, "cut", counted)
    got = {r["k"]: r["cluster"] for r in spatial.cluster_cells(df, "k", 3).collect()}

    def vector(p):
        a, b = math.radians(p[1]), math.radians(p[2])
        return math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)

    def gap(p, c):
        return round(sum((x - y) ** 2 for x, y in zip(vector(p), c, strict=True)), 12)

    def nearest(p):
        return min(range(3), key=lambda i: gap(p, centres[i]))

    def means(f):  # row by row
        own = [[f(p) for p in rows[:900] if nearest(p) == i] for i in range(3)]
        return [tuple(sum(v) / len(v) for v in zip(*o, strict=True)) for o in own]

    centres = [vector(min(rows[:900], key=lambda p: hashlib.md5(f"0|cells|{p[0]}".encode()).hexdigest()))]
    while len(centres) < 3:
        centres.append(vector(max(rows[:900], key=lambda p: (min(gap(p, c) for c in centres), vector(p)))))
    for _ in range(25):
        centres = [tuple(round(v, 12) for v in c) for c in means(vector)]
    order = sorted(range(3), key=lambda i: means(lambda p: p[1:])[i])
    assert got == {p[0]: f"cluster_{order.index(nearest(p)):02d}" for p in rows[:900]}
    assert sizes == {"clusters": len({p[1:] for p in rows[:900]})}  # the rounds go over places, not over rows
