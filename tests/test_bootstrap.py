"""The replicate bootstrap against a plain loop over the same draws."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from farfield.operators import bootstrap as B


def table(spark, n=260):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        p = round(min(1.0, max(0.0, rng.gauss(0.35 + 0.3 * y, 0.2))), 1)  # few scores, so many ties
        rows.append(("a" if i % 4 else None, i % 2, f"r{i % 5}" if i % 2 else "one", ("id", "ood")[i % 3 > 0], i, y, p))
    rows += [("b", 0, "x", "id", k, 1, 0.5) for k in range(6)] + [("b", 0, "x", "ood", k, k % 2, 0.1 * k) for k in range(6)]
    return rows, spark.createDataFrame(rows, "c string, seed int, region string, side string, id int, y int, p double").repartition(4)


def area(y, p, w):
    up = sum(w[i] * w[j] * (p[i] > p[j] or 0.5 * (p[i] == p[j])) for i in range(len(y)) if y[i] for j in range(len(y)) if not y[j])
    return up / (w[y == 1].sum() * w[y == 0].sum()) if w[y == 1].sum() * w[y == 0].sum() else math.nan


def gap(y, p, w):
    bins = np.searchsorted(np.arange(1, 10) * 0.1, p, side="right")
    return sum(abs((w * (y - p))[bins == k].sum()) for k in range(10)) / w.sum() if w.sum() else math.nan


def plain(spark, rows, replicates, draw):
    """Replicate by replicate: {group: (estimates, replicate means)} of AUC, ECE and accuracy at a half."""
    out = {}
    for c in {r[0] for r in rows}:
        g = spark.range(1).select(F.xxhash64(F.lit(draw), F.lit(c).cast("string"))).first()[0]
        mine = [r for r in rows if r[0] == c]
        seeds = sorted({r[1] for r in mine if r[3] == "id"} & {r[1] for r in mine if r[3] == "ood"})
        cells = {}
        for s in seeds:
            for side, name in enumerate(("id", "ood")):
                own = [r for r in mine if r[1] == s and r[3] == name]
                regions = sorted({r[2] for r in own})
                keys = spark.createDataFrame([(k, side, s, r[2], r[4]) for k, r in enumerate(own)], "k int, side int, seed int, region string, id int")
                h = np.array([r[1] for r in keys.select("k", F.xxhash64("side", "seed", "region", "id")).orderBy("k").collect()])
                cells[s, side] = (np.array([r[5] for r in own]), np.array([r[6] for r in own]), np.array([regions.index(r[2]) for r in own]), len(regions), h)

        def scores(s, side, w):
            y, p = cells[s, side][:2]
            return [area(y, p, w), gap(y, p, w), (w * ((p >= 0.5) == y)).sum() / w.sum() if w.sum() else math.nan]

        deltas = []
        for b in range(replicates):
            got = []
            for j in range(len(seeds)):
                k = int(B.picked(B.mixed(draw, 1, g, np.array([b]), np.array([j])), len(seeds))[0])
                pair = []
                for side in (0, 1):
                    y, p, region, n, h = cells[seeds[k], side]
                    w = np.zeros(len(y))
                    for i in range(n):
                        r = int(B.picked(B.mixed(draw, 2, g, side, np.array([b]), np.array([j]), np.array([i])), n)[0])
                        w += np.where(region == r, B.poisson(B.mixed(draw, 3, h, np.full(len(h), b), np.full(len(h), j), np.full(len(h), i))), 0)
                    pair.append(scores(seeds[k], side, w))
                got.append(np.subtract(*pair))
            deltas.append(np.nanmean(np.array(got), axis=0) if got else None)
        full = [np.subtract(*(scores(s, side, np.ones(len(cells[s, side][0]))) for side in (0, 1))) for s in seeds]
        out[c] = (np.nanmean(full, axis=0), np.array(deltas))
    return out


@pytest.mark.parametrize(("replicates", "partitions"), [(30, 3), (140, 7)])
def test_replicates_are_those_of_a_plain_loop(spark, replicates, partitions):
    rows, df = table(spark)
    want = plain(spark, rows, replicates, 5)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        metrics = {"auc": F.col("auc"), "ece": F.col("ece"), "right": F.col("right") / F.when(F.col("n") > 0, F.col("n"))}
        sums = {"right": ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int"), "n": F.lit(1)}
        out = B.sample_bootstrap(df, ["c"], F.col("side"), "seed", "region", ["id"], "id", sums, metrics, replicates, 5, (F.col("y"), F.col("p"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {(r["c"], r["metric"]): r for r in out}
    assert set(got) == {(c, m) for c in ("a", None) for m in metrics} | {("b", "ece"), ("b", "right")}
    for c in ("a", None):
        estimate, deltas = want[c]
        for k, m in enumerate(metrics):
            r = got[c, m]
            assert r["delta"] == pytest.approx(estimate[k]) and r["n_seeds"] == (2 if c else 1)
            mine = deltas[:, k][~np.isnan(deltas[:, k])]
            assert (r["lo"], r["hi"]) == (pytest.approx(np.percentile(mine, 2.5)), pytest.approx(np.percentile(mine, 97.5)))


def test_no_rows_and_one_side(spark):
    _, df = table(spark)
    for rows in (df.where("false"), df.where("side = 'id'")):
        assert B.sample_bootstrap(rows, ["c"], F.col("side"), "seed", "region", ["id"], "id", {"n": F.lit(1)}, F.col("n"), 10).count() == 0


def test_sums_without_a_score_are_those_of_a_plain_loop(spark):
    rows = [("a", k % 3, f"r{k % 4}", ("id", "ood")[k % 5 > 1], k, k * 37 % 100 / 100) for k in range(300)]
    df = spark.createDataFrame(rows, "c string, seed int, region string, side string, id int, v double").repartition(3)
    r = B.sample_bootstrap(df, ["c"], F.col("side"), "seed", "region", ["id"], "id", {"t": F.col("v"), "n": F.lit(1)}, F.col("t") / F.when(F.col("n") > 0, F.col("n")), 150, 2).first()
    g = spark.range(1).select(F.xxhash64(F.lit(2), F.lit("a"))).first()[0]
    h = {k[0]: k[1] for k in df.select("id", F.xxhash64(F.when(F.col("side") == "id", 0).otherwise(1), "seed", "region", "id")).collect()}
    cells = {(s, x): [q for q in rows if q[1] == s and q[3] == x] for s in range(3) for x in ("id", "ood")}
    means = []
    for b in range(150):
        got = []
        for j in range(3):
            s, pair = int(B.picked(B.mixed(2, 1, g, np.array([b]), np.array([j])), 3)[0]), []
            for side, x in enumerate(("id", "ood")):
                own = cells[s, x]
                hashes, place, v = np.array([h[q[4]] for q in own]), np.array([int(q[2][1]) for q in own]), np.array([q[5] for q in own])
                w = np.zeros(len(own))
                for i in range(4):
                    at = int(B.picked(B.mixed(2, 2, g, side, np.array([b]), np.array([j]), np.array([i])), 4)[0])
                    w += np.where(place == at, B.poisson(B.mixed(2, 3, hashes, b, j, i)), 0)
                pair.append((w * v).sum() / w.sum())
            got.append(pair[0] - pair[1])
        means.append(np.mean(got))
    delta = np.mean([np.mean([q[5] for q in cells[s, "id"]]) - np.mean([q[5] for q in cells[s, "ood"]]) for s in range(3)])
    assert r["delta"] == pytest.approx(delta) and (r["lo"], r["hi"]) == (pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5)))


@pytest.mark.parametrize("scored", [{}, {"scored": False}])
def test_a_task_holds_only_the_slots_that_draw_its_seed(scored):
    rows = pd.DataFrame({"g": 5, "side": 1, "s": 1, "n_seeds": 3, "r": np.repeat([0, 1], 300), "n_regions": 2, "h": np.arange(600), "y": 0.0, "p": 0.5, "f_n": 1.0})
    out = pd.concat(B._partials(iter([rows[:450], rows[450:]]), ["f_n"], 140, 0, **scored))
    for block, n in ((0, 128), (1, 12)):
        own = (B._Draws(0, 5, 3, block * 128, block * 128 + n).seed == 1).sum()
        assert len(np.frombuffer(out[out.block == block].sums.item())) == own * (1 if scored else 31)


def test_draws_by_first_bits_are_poisson_draws():
    edges = (B._BELOW * (1 << 53)).astype(np.uint64) << np.uint64(11)
    draws, row = B._Draws(0, 5, 3, 0, 128), np.arange(4000)
    slot, i = draws.entries(1, 1, 0, 4)
    want = B.poisson(B.mixed(0, 3, row[None, :], draws.b[slot][:, None], draws.j[slot][:, None], i[:, None]))
    assert (draws.drawn(slot, i, row) == want).all() and want.max() > 5
    near = np.concatenate([edges + np.uint64(k << 11) for k in (0, 1)] + [edges - np.uint64(1 << 11)])
    fast = B._DRAWN[(near >> np.uint64(52)).astype(int)]
    assert (np.isnan(fast) | (fast == B.poisson(near))).all()
