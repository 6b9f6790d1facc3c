"""Probes of many cells fitted together: against single fits, numeric gradients and plain votes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from farfield.operators import cells, joint, probes


def blobs(n, classes, seed, d=6):
    """Normal clouds whose centres lie 1.5 apart in each of six dimensions."""
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    return rng.normal(size=(n, d)) + y[:, None] * 1.5, y


def frame(spark, x, y, first=0):
    return spark.createDataFrame([(first + k, int(c), int(k % 3), [float(v) for v in row]) for k, (row, c) in enumerate(zip(x, y, strict=True))], "k long, y int, grp int, x array<double>").repartition(3, "k")


def cell(name, df):
    return df.select(F.lit(name).alias("cell"), "k")


@pytest.mark.parametrize("classes", [2, 4])
def test_predictions_are_those_of_single_fits(spark, classes):
    rng = np.random.default_rng(4)
    x, y = blobs(300, classes, 0)
    x = x * [1, 5, 0.1, 1, 1, 2] + [0, 1000, 0, 3, 0, 0] + rng.normal(size=x.shape)
    rows = frame(spark, x, y)
    members = cell("all", rows).union(cell("half", rows.where("k % 2 = 0 or k < 40"))).union(cell("few", rows.where("k < 24")))
    test = rows.where("k % 5 = 1")
    out = {(r["cell"], r["sample_id"]): r["probs"] for r in cells.run_cells(rows, members, test, "y", "k").predictions.collect()}
    for name, where in (("all", "true"), ("half", "k % 2 = 0 or k < 40"), ("few", "k < 24")):
        for r in probes.fit(rows.where(where), "y").predict(test).select("k", "probs").collect():
            assert np.allclose(out[name, r["k"]], r["probs"], atol=4e-3)


def test_passes_do_not_grow_with_cells(spark):
    rows = frame(spark, *blobs(400, 3, 1))
    members = rows.select(F.explode(F.sequence(F.lit(0), F.lit(89))).alias("c"), "k").where("k % 90 >= c % 45 or k < 30").select(F.format_string("c%02d", "c").alias("set"), "k")
    j = joint.joint(rows, members, "y", "k")
    assert len(j.names) == 90 and [m.n for m in j.moments[:2]] == [400, 400 - sum(k % 90 < 1 and k >= 30 for k in range(400))]
    models = [joint.Model(p, v) for p in range(90) for v in (0.1, 1.0)]
    joint.fit(j, models, "logistic")
    assert j.passes < 60 and all(np.isfinite(m.params).all() for m in models)
    found = joint.predict(j, models[-2:], rows, "logistic", carry=("y",))
    assert found.where("pred = y").count() > 0.9 * found.count()


def test_models_beyond_the_bound_are_fitted_in_turns(spark, monkeypatch):
    rows = frame(spark, *blobs(90, 3, 1))
    j = joint.joint(rows, rows.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("set"), "k"), "y", "k")
    fits = []
    for size in (1 << 24, 1):
        monkeypatch.setattr(joint, "MODEL_BYTES", size)
        monkeypatch.setattr(joint, "DIRECT_TASKS", 8 if size > 1 else 1)
        models = [joint.Model(0, 1.0), joint.Model(1, 10.0)]
        joint.fit(j, models, "logistic")
        fits.append(joint.predict(j, models, rows, "logistic").orderBy("model", "k").collect())
    assert len(fits[0]) == 180
    assert np.allclose([r["probs"] for r in fits[0]], [r["probs"] for r in fits[1]], atol=1e-4)


@pytest.mark.parametrize(("kind", "classes"), [(joint.Linear, 2), (joint.Linear, 3), (joint.Network, 2), (joint.Network, 4)])
def test_gradients(kind, classes):
    rng = np.random.default_rng(1)
    model = kind(5, classes) if kind is joint.Linear else kind(5, classes, (7, 4))
    z, y, w = rng.normal(size=(30, 5)), rng.integers(0, classes, 30), rng.uniform(0.5, 2, 30)
    p = model.start(3) + rng.normal(size=len(model.start(3))) * 0.1
    got = model.loss(p, z, y, w)
    for k in range(0, len(p), 3):
        e = np.zeros(len(p))
        e[k] = 1e-6
        assert got[1 + k] == pytest.approx((model.loss(p + e, z, y, w)[0] - model.loss(p - e, z, y, w)[0]) / 2e-6, rel=1e-3, abs=1e-5)
    assert np.allclose(model.probabilities(p, z).sum(axis=1), 1)


def test_synthetic_clouds_reach_the_recorded_scores(spark):
    """The recorded scores of a linear probe are 0.9655 (F1 of two classes) and 0.9666 (macro F1 of three)."""
    for classes, n, task, column, want in ((2, 80, "binary", "f1", 0.9655), (3, 90, "multiclass", "macro_f1", 0.9666)):
        train, test = frame(spark, *blobs(n, classes, 0)), frame(spark, *blobs(60, classes, 2), first=1000)
        for family in ("logistic", "mlp"):
            out = cells.run_cells(train, cell("c", train), test, "y", "k", task=task, family=family)
            row = cells.score_cells(out, task).first()
            # they were recorded for linear probes; a network of 40,000 parameters fits 80 rows too closely
            assert row[column] == pytest.approx(want, abs=0.02) if family == "logistic" else row[column] > 0.8
            assert cells.fit_facts(spark, out).first()["probe_family"] == family


def test_network_learns_what_is_not_linear_and_its_grid_matters(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    rows = frame(spark, x, y)
    train, test = rows.where("k % 4 > 0"), rows.where("k % 4 = 0")
    j = joint.joint(train, train.select(F.lit("s").alias("set"), "k"), "y", "k")
    nets = [joint.Model(0, v) for v in (1e-4, 1.0, 100.0)]
    joint.fit(j, nets, "mlp", max_iter=80, still=1e-5)
    right = {r["model"]: r["n"] / 100 for r in joint.predict(j, nets, test, "mlp", carry=("y",)).where("pred = y").groupBy("model").agg(F.count("*").alias("n")).collect()}
    assert right[0] > 0.9 and right.get(2, 0) < right[0]
    kind = joint.Network(2, 2)
    sizes = [np.square(kind.decayed(m.params)).sum() for m in nets]
    assert sizes[0] > sizes[1] > sizes[2]
    line = [joint.Model(0, 1.0)]
    joint.fit(j, line, "logistic")
    assert joint.predict(j, line, test, "logistic", carry=("y",)).where("pred = y").count() < 75


def islands(spark):
    """Small clusters of six, each of one class: more than five neighbours reach into others."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 8))
    x = np.concatenate([centres + 0.02 * rng.normal(size=centres.shape) for _ in range(8)])
    return frame(spark, x, np.tile(np.arange(60) % 2, 8))


def test_the_best_number_of_neighbours_is_found(spark):
    rows = islands(spark)
    train, held, test = rows.where("k < 360"), rows.where("k between 360 and 419"), rows.where("k >= 420")
    predict, facts = cells.fit_multiclass(train, held, "y", "k", family="knn", tuning=True)
    assert facts["probe_value"] == 5.0 and facts["grid_size"] == 5
    assert cells.balanced_accuracy(predict(test), "y") == 1.0


@pytest.mark.parametrize("limit", [64 << 20, 4000])
def test_votes_are_prefixes_of_one_search(spark, monkeypatch, limit):
    monkeypatch.setattr(joint, "BLOCK_BYTES", limit)
    rows = islands(spark)
    train, test = rows.where("k % 6 > 0"), rows.where("k % 6 = 0")
    j = joint.joint(rows, train.select(F.lit("a").alias("set"), "k").union(train.where("k % 5 > 0").select(F.lit("b"), "k")), "y", "k")
    models = [joint.Model(p, v) for p in (0, 1) for v in (5.0, 20.0, 100.0)]
    got = {(r["model"], r["k"]): (r["pred"], [round(p, 7) for p in r["probs"]]) for r in joint.predict(j, models, test, "knn").collect()}
    assert len(got) == 6 * test.count()
    for m, (where, k) in enumerate([("true", 5), ("true", 20), ("true", 100), ("k % 5 > 0", 5), ("k % 5 > 0", 20), ("k % 5 > 0", 100)]):
        for r in probes.neighbours(train.where(where), test, "y", "k", k=k).collect():
            assert got[m, r["k"]] == (r["pred"], [round(p, 7) for p in r["probs"]])


@pytest.mark.parametrize("family", ["logistic", "mlp", "knn"])
def test_binary_cells_take_any_family(spark, family):
    rows = frame(spark, *blobs(240, 2, 5))
    train, held, test = rows.where("k % 8 > 3"), rows.where("k % 8 < 2"), rows.where("k % 8 between 2 and 3")
    members = cell("all", train).union(cell("few", train.where("k < 16"))).union(cell("none", train.where("y = 1")))
    for validation, sources in ((None, {"all": "internal", "few": "train"}), (held, {"all": "validation", "few": "validation"})):
        out = cells.run_cells(rows, members, test, "y", "k", task="binary", family=family, validation=validation, tuning=family != "mlp")
        facts = {r["cell"]: r for r in cells.fit_facts(spark, out).collect()}
        assert {c: r["tuned_on"] for c, r in facts.items()} == sources and all(r["probe_family"] == family and 0 <= r["threshold"] <= 1 for r in facts.values())
        scores = {r["cell"]: r for r in cells.score_cells(out, "binary").collect()}
        # a network's threshold comes from four fifths of 120 rows, and moves when it is fitted again on all
        assert scores["all"]["auc"] > 0.97 and scores["all"]["calibrated_f1"] > (0.75 if family == "mlp" else 0.9)
        assert [r["cell"] for r in cells.failure_log(spark, out).collect()] == ["none"]


def test_errors_that_no_fit_raises_end_the_run(spark):
    rows = frame(spark, *blobs(60, 2, 5))
    with pytest.raises(ValueError, match="unknown probe family"):
        cells.run_cells(rows, cell("c", rows), rows, "y", "k", family="forest")
    with pytest.raises(Exception, match="nothing"):
        cells.run_cells(rows, cell("c", rows), rows, "y", "k", x="nothing")
