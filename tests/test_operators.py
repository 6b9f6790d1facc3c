"""Small cases with known answers, invariants and errors of the engine's own operators."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from farfield.functions import columns as C
from farfield.operators import analytics, bootstrap, budgets, cells, dense, metrics, policies, probes, series, spatial, splits
from farfield.sources import files


@pytest.mark.parametrize("seed", range(12))
def test_allocation_meets_sizes_and_marginals(seed):
    rng = random.Random(seed)
    counts = {(c, r): rng.randint(0, 60) for c in range(rng.randint(2, 12)) for r in range(rng.randint(2, 8))}
    counts = {k: v for k, v in counts.items() if v}
    n = sum(counts.values())
    sizes = splits.source_sizes(n)
    share = splits.allocate(counts, sizes)
    assert [sum(x[p] for x in share.values()) for p in range(3)] == list(sizes)
    assert all(sum(share[c]) == counts[c] for c in counts)
    for a in (0, 1):
        for v in {c[a] for c in counts}:
            of = sum(n_ for c, n_ in counts.items() if c[a] == v)
            for p in range(3):
                have = sum(x[p] for c, x in share.items() if c[a] == v)
                assert of * sizes[p] // n <= have <= -(-of * sizes[p] // n)


def test_sizes():
    assert splits.source_sizes(706661) == (565327, 70667, 70667)
    assert splits.target_sizes(431138) == (344910, 86228)
    assert splits.official_sizes(19) == (18, 1)
    with pytest.raises(ValueError):
        splits.source_sizes(2)


@pytest.mark.parametrize("seed", range(3))
def test_target_split_holds_each_class_on_both_sides(spark, seed):
    rows = [(i, "a") for i in range(60)] + [(i, "b") for i in range(60, 98)] + [(98, "c"), (99, "d"), (100, "d")]
    out = splits.partition_target(spark.createDataFrame(rows, "id long, y string"), [], "y", "id", seed).toPandas()
    test = out[out.partition == "target_test"]
    assert len(out) == 101 and len(test) == 21
    assert set(out[out.y == "c"].partition) == {"target_test"}
    assert all(set(out[out.y == y].partition) == {"target_test", "target_label_pool"} for y in "abd")


def test_unseen_classes_make_log_loss_infinite(spark):
    rows = [(1, 0, [0, 1], [0.75, 0.25]), (1, 2, [0, 1], [0.5, 0.5])]
    r = metrics.multiclass_calibration(spark.createDataFrame(rows, "c int, y_true int, classes array<int>, probs array<double>"), ["c"]).first()
    assert r["nll"] == math.inf and r["unseen_prevalence"] == 0.5
    assert r["union_brier"] == pytest.approx((0.125 + 1.5) / 2) and r["shared_nll"] == pytest.approx(-math.log(0.75))


def test_threshold_prefers_the_lowest_of_equals_and_falls_back(spark):
    rows = [("two", 1, 0.9), ("two", 0, 0.4), ("two", 1, 0.4), ("one", 1, 0.3), ("nan", 1, float("nan")), ("nan", 0, 0.2)]
    got = {r["c"]: r["threshold"] for r in metrics.f1_thresholds(spark.createDataFrame(rows, "c string, y_true int, prob double"), ["c"]).collect()}
    assert got == {"two": 0.4, "one": 0.5, "nan": 0.5}


def test_running_totals_match_a_plain_sum(spark):
    rng = random.Random(1)
    values = sorted({round(rng.random(), 4) for _ in range(500)} | {0.0, 1.0, 7.5, -3.0})
    df = spark.createDataFrame([("x", v, 1) for v in values], "c string, p double, n long")
    for down in (True, False):
        got = {r["p"]: r["run_n"] for r in metrics.running_totals(df, ["c"], "p", ["n"], descending=down).collect()}
        order = values[::-1] if down else values
        assert got == {v: i + 1 for i, v in enumerate(order)}


def test_non_finite_confidence_raises(spark):
    df = spark.createDataFrame([("x", 1, float("nan"))], "c string, correct int, confidence double")
    with pytest.raises((PySparkException, Py4JJavaError)):
        metrics.risk_coverage(df, ["c"]).collect()


def test_distance_join_matches_brute_force_near_poles_and_the_date_line(spark):
    rng = random.Random(3)
    points = [(i, rng.choice([rng.uniform(-90, 90), rng.uniform(88, 90), rng.uniform(-2, 2)]), rng.choice([rng.uniform(-180, 180), rng.uniform(179, 180), rng.uniform(-180, -179)])) for i in range(400)]
    source, target = points[:250], points[250:]
    a, b = (spark.createDataFrame(x, "id long, lat double, lon double") for x in (source, target))
    got = {(r["id"], r["target_key"]) for r in spatial.near_pairs(a, b, "id", 150.0).collect()}

    def km(p, q):
        h = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * C.EARTH_KM * math.asin(math.sqrt(min(1, h)))

    assert got == {(p[0], q[0]) for p in source for q in target if km(p, q) <= 150.0}


def test_footprint_ring(spark):
    ring = [("t", 1.5 * math.sin(a), 1.5 * math.cos(a)) for a in np.linspace(0, 2 * math.pi, 24, endpoint=False)]
    target = spark.createDataFrame(ring, "holdout string, lat double, lon double")
    source = spark.createDataFrame([("t", "centre", 0.0, 0.0), ("t", "edge", 1.8, 0.0), ("t", "far", 5.0, 5.0)], "holdout string, name string, lat double, lon double")
    got = {r["name"] for r in spatial.in_footprint(source, spatial.footprints(target), 50.0).collect()}
    assert got == {"centre", "edge"}


def test_clusters_find_far_blobs(spark):
    rng = random.Random(5)
    centres = [(-50, -120), (-20, 20), (10, 100), (40, -60), (65, 30)]
    rows = [(i * 40 + j, c[0] + rng.gauss(0, 0.1), c[1] + rng.gauss(0, 0.1)) for i, c in enumerate(centres) for j in range(40)]
    out = spatial.cluster_cells(spark.createDataFrame(rows, "id long, lat double, lon double"), "id").toPandas()
    assert {f"cluster_{i // 40:02d}" for i in range(200)} == set(out.cluster)
    assert all(out[out.id == i].cluster.item() == f"cluster_{i // 40:02d}" for i in range(200))
    with pytest.raises(ValueError):
        spatial.cluster_cells(spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "id long, lat double, lon double"), "id")


def test_resampling_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(1, [10, 20, 30, 40, 50, 60]), (2, [7])], "id int, v array<int>")
    got = {r["id"]: r["v"] for r in series.resampled(df, "v", 3).collect()}
    assert got == {1: [10, 30, 60], 2: [7, 7, 7]}  # 2.5 goes to 2


def test_bucketed_length(spark):
    df = spark.createDataFrame([(n, list(range(n))) for n in (0, 3, 8, 9, 300)], "id int, v array<int>")
    got = {r["id"]: r["v"] for r in series.bucketed(df, "v").collect()}
    assert [len(got[n]) for n in (0, 3, 8, 9, 300)] == [0, 8, 8, 16, 256]
    assert got[3] == sorted([0, 1, 2] + [round(i * 2 / 4) for i in range(5)])
    assert got[300] == [int(c[len(c) // 2]) for c in np.array_split(np.arange(300), 256)]


def test_permuted_band_has_no_fixed_order(spark):
    df = spark.createDataFrame([(i, "r", float(i)) for i in range(6)] + [(i, "g", 0.5) for i in range(6)], "s int, band string, v double")
    out = series.perturbed(df, "s", "band", "v", "r").toPandas()
    red = out[out.band == "r"].sort_values("s").v.tolist()
    assert sorted(red) == [0, 1, 2, 3, 4, 5] and red != [0, 1, 2, 3, 4, 5]
    assert set(out[out.band == "g"].v) == {0.5}


def test_contrasts_refuse_a_missing_operand(spark):
    rows = [("m", "target_full", 0.8)]
    df = spark.createDataFrame(rows, "model string, route string, value double")
    with pytest.raises((PySparkException, Py4JJavaError)):
        analytics.paired_contrast(df, ["model"], "route", "value", "target_full", "source_full", "f").collect()
    df = spark.createDataFrame([*rows, ("m", "source_full", 0.5)], "model string, route string, value double")
    assert analytics.paired_contrast(df, ["model"], "route", "value", "target_full", "source_full", "f").first()["difference"] == pytest.approx(0.3)


def test_bootstrap_needs_three_units(spark):
    df = spark.createDataFrame([("a", f"r{i}", float(i)) for i in range(5)] + [("b", "r", 1.0)], "c string, r string, v double")
    got = {r["c"]: r for r in analytics.bootstrap_mean(df, ["c"], "r", "v", replicates=400, least=3).collect()}
    assert got["b"]["lo"] is None and got["a"]["mean"] == 2.0 and got["a"]["lo"] < 2.0 < got["a"]["hi"]


def test_torn_last_line_is_left_out_and_corruption_raises(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": 3')
    assert sorted(r["a"] for r in files.torn_lines(spark, str(tmp_path / "ok.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": x}\n{"a": 2}\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.torn_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.strict_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_checked_csv_refuses_another_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("stable_id,partition,status,domain,reason\n1,source_train,assigned,x,\n")
    assert files.checked_csv(spark, str(tmp_path / "a.csv"), files.ASSIGNMENTS).count() == 1
    (tmp_path / "b.csv").write_text("stable_id,part,status,domain,reason\n1,source_train,assigned,x,\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.checked_csv(spark, str(tmp_path / "b.csv"), files.ASSIGNMENTS).collect()


def test_array_files_and_json_sources(spark, tmp_path):
    np.savez(tmp_path / "s1.npz", data=np.arange(6.0).reshape(3, 2), dates=np.array(["2020-01-05", "2020-02-05", "2020-03-05"], "datetime64[D]"), center=np.array([1.0, 2.0]))
    np.savez(tmp_path / "odd.npz", data=np.arange(6.0), dates=np.array([], "datetime64[D]"))
    got = files.array_files(spark, str(tmp_path)).toPandas()
    assert len(got) == 6 and set(got.sample_id) == {"s1"} and got.value.sum() == 15
    (tmp_path / "labels.geojson").write_text(json.dumps({"features": [{"properties": {"index": 1, "dataset": "togo", "is_crop": 1, "lat": None, "lon": 3.0, "export_end_date": "2021-02-01"}}]}))
    r = files.geojson_labels(spark, str(tmp_path / "labels.geojson")).first()
    assert math.isnan(r["lat"]) and r["window_year"] == 2020
    (tmp_path / "split.json").write_text(json.dumps({"train": ["a"], "val": [], "test": ["b", "c"]}))
    assert files.release_splits(spark, str(tmp_path / "split.json")).count() == 3


def test_folder_digest_depends_on_content_and_names(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.bin").write_bytes(b"1")
    same = [files.folder_digest(files.file_digests(spark, str(tmp_path / n)), n).first()["sha256"] for n in ("one", "two")]
    (tmp_path / "two" / "x.bin").write_bytes(b"2")
    assert same[0] == same[1] != files.folder_digest(files.file_digests(spark, str(tmp_path / "two")), "two").first()["sha256"]


def test_label_access_problems(spark):
    good = [("r", "a", "source", 0, None), ("r", "b", "source", 1, None), ("r", "c", "test", None, None)]
    schema = "region string, stable_id string, population string, source_rank int, target_rank int"
    assert budgets.label_access_problems(spark.createDataFrame(good, schema), ["region"]).count() == 0
    bad = [("r", "a", "source", 0, None), ("r", "b", "source", 2, None), ("r", "c", "test", 1, None), ("r", "a", "target", None, 0)]
    assert {r["problem"] for r in budgets.label_access_problems(spark.createDataFrame(bad, schema), ["region"]).collect()} == {"ranks are not contiguous", "wrong column", "id in two places"}


def test_half_up_and_bins(spark):
    df = spark.createDataFrame([(0.3,), (0.6,), (0.7,), (1.0,)], "p double")
    assert [r[0] for r in df.select(C.calibration_bin(F.col("p"))).collect()] == [2, 5, 6, 9]
    assert [r[0] for r in spark.createDataFrame([(2.5,), (3.5,)], "x double").select(C.half_up(F.col("x"))).collect()] == [3, 4]


def test_sample_bootstrap_keeps_seeds_and_regions(spark):
    # regions and seeds decide the value: rows alone would give an interval of no width
    rows = [("m", s, x, f"{x}{g}", i, t, s / 10 + (g / 10 if x == "ood" else 0.5)) for s in range(3) for x in ("id", "ood") for g in range(4 if x == "ood" else 1) for i in range(20) for t in (0, 1)]
    rows = [(*r[:6], r[6] if r[5] else 99.0) for r in rows]  # of repeated rows the last counts
    df = spark.createDataFrame(rows, "c string, seed int, side string, region string, id int, t int, v double")
    got = bootstrap.sample_bootstrap(df, ["c"], F.col("side"), "seed", "region", ["id"], "t", {"s": F.col("v"), "n": F.lit(1)}, F.col("s") / F.col("n")).first()
    assert got["n_seeds"] == 3 and abs(got["id"] - 0.6) < 1e-9 and abs(got["ood"] - 0.25) < 1e-9 and abs(got["delta"] - 0.35) < 1e-9
    # each seed's mean of four drawn regions has a deviation of 0.056, three of them 0.032
    assert 0.25 < got["lo"] < 0.32 < 0.38 < got["hi"] < 0.45


def test_lines_are_numbered_by_ranges(spark):
    import __spark_entry__ as entry

    ids = [(str(i), p, "assigned") for i, p in zip(random.Random(3).sample(range(10_000), 300), ["source_val", "source_train", "target_test"] * 100, strict=True)] + [(f"x{i}", "", s) for i in range(20) for s in ("purged", "excluded")]
    df = spark.createDataFrame(ids, "stable_id string, partition string, status string")
    got = [r["stable_id"] for r in sorted(files.numbered(df).collect(), key=lambda r: r["line"])]
    place = lambda r: {"source_train": 0, "source_val": 1, "target_test": 4}.get(r[1], 5 if r[2] == "purged" else 6)
    assert got == [r[0] for r in sorted(ids, key=lambda r: (place(r), not r[0].isdigit(), int(r[0]) if r[0].isdigit() else 0, r[0]))]
    # the only window without a partition adds up the counts of ranges
    plan = entry.queries()["a14_assignment_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "Window [row_number" in x] and all("__range" in x or "__spread" in x for x in plan.splitlines() if "Window [row_number" in x)


@pytest.mark.parametrize("name", ["d14_footprint_exclusion", "d27_geography_audit"])
def test_geography_reads_all_samples(spark, monkeypatch, name):
    seen, plain = [], spatial.leave_one_out
    monkeypatch.setattr(spatial, "leave_one_out", lambda df, *a: (seen.append(df), plain(df, *a))[1])
    __import__("__spark_entry__").queries()[name](spark, "/root/testdata/sf0.001")
    assert seen[0].count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()


def _separable(spark, n=240):
    rng = random.Random(5)
    rows = [(i, i % 3, i % 4, [float(rng.gauss(4 * (i % 3 == k), 1)) for k in range(3)] + [1.0]) for i in range(n)]
    return spark.createDataFrame(rows, "k long, y int, grp int, x array<double>")


def test_neighbours_in_blocks_are_those_of_one_block(spark, monkeypatch):
    rows = _separable(spark)
    train, test = rows.where("k % 3 != 1 or k % 4 = 1"), rows.where("k % 5 = 0")
    one = {r["k"]: (r["pred"], [round(p, 9) for p in r["probs"]]) for r in probes.neighbours(train, test, "y", "k", k=7).collect()}
    monkeypatch.setattr(probes, "BLOCK_BYTES", 800)
    assert {r["k"]: (r["pred"], [round(p, 9) for p in r["probs"]]) for r in probes.neighbours(train, test, "y", "k", k=7).collect()} == one


def test_cells_are_fitted_scored_and_failures_logged(spark):
    rows = _separable(spark)
    train, test = rows.where("k % 4 != 0"), rows.where("k % 4 = 0")
    cell = lambda name, d: d.select(F.lit(name).alias("cell"), "k")
    members = cell("source_full", train).union(cell("allocation@50", train.where("k % 2 = 1"))).union(cell("source_plus_target@50", train.where("y = 1")))
    for family in ("logistic", "knn"):
        out = cells.run_cells(rows, members, test, "y", "k", family=family)
        scores = {r["cell"]: r["macro_f1"] for r in cells.score_cells(out, "multiclass").collect()}
        assert set(scores) == {"source_full", "allocation@50"} and min(scores.values()) > 0.9
        log = cells.failure_log(spark, out).collect()
        assert [(r["cell"], r["probe_family"]) for r in log] == [("source_plus_target@50", family)] and "two classes" in log[0]["reason"]
    assert {r["cell"]: r["n_train"] for r in cells.fit_facts(spark, out).collect()} == {"source_full": 180, "allocation@50": 120}
    predict, facts = cells.fit_multiclass(train, test, "y", "k", tuning=True)
    assert facts["tuned_on"] == "validation" and facts["grid_size"] == 5 and facts["probe_value"] in cells.FAMILIES["logistic"].grid
    assert cells.balanced_accuracy(predict(test), "y") > 0.9
    assert cells.fit_multiclass(train, None, "y", "k", tuning=True, tune_internal=True)[1]["tuned_on"] == "internal"
    with pytest.raises(ValueError, match="unknown probe family"):
        cells.fit_family(train, "y", "k", "x", "forest", 1.0, 0)


def test_sizes_policies_documents_and_collections(spark, tmp_path):
    policies.check_sizes(10, [("a", 4), ("b", 6)])
    for bad in ([("a", 4), ("a", 6)], [("a", -1), ("b", 11)], [("a", 4), ("b", 5)]):
        with pytest.raises(ValueError):
            policies.check_sizes(10, bad)
    table = {r["benchmark"]: r for r in policies.policy_table(spark, {"pastis": 99}).collect()}
    assert table["pastis"]["max_budget"] == 99 and table["pastis"]["label_unit"] == "patches" and table["eurocropsml"]["max_budget"] is None
    document = {"seeds": [0, 1], "roles": {"f1": "diagnostic"}}
    policies.write_document(spark, f"{tmp_path}/log", document)
    policies.write_document(spark, f"{tmp_path}/log", document | {"more": None})
    assert policies.read_document(spark, f"{tmp_path}/log") == document | {"more": None}
    rows = spark.createDataFrame([("m", "b", 0, 1.5, "gone")], "model string, benchmark string, seed int, importance double, extra string")
    policies.append_importance(rows, f"{tmp_path}/importance")
    policies.append_importance(rows, f"{tmp_path}/importance")
    back = spark.read.option("header", True).csv(f"{tmp_path}/importance")
    assert back.columns == policies.IMPORTANCE and back.count() == 2 and back.first()["importance"] == "1.5"
    known = policies.Collections()
    known.register("numbers", lambda s, root: s.range(int(root)))
    assert known.load(spark, "numbers", "7").count() == 7
    with pytest.raises(ValueError, match="no collection"):
        known.load(spark, "letters", "")
    with pytest.raises(ValueError, match="there already"):
        known.register("numbers", None)


def test_patch_metadata_and_files(spark, tmp_path):
    feature = '{"type": "Feature", "properties": {"ID_PATCH": %d, "Fold": %d, "TILE": "t31tfm"}, "geometry": {"type": "Polygon", "coordinates": [[[2.0, 45.0], [2.1, 45.0], [2.1, 45.1]]]}}'
    (tmp_path / "metadata.geojson").write_text('{"type": "FeatureCollection", "features": [' + ", ".join(feature % (i, i % 3 + 1) for i in range(6)) + "]}")
    (tmp_path / "data").mkdir()
    for i in (0, 1, 4, 5):
        (tmp_path / "data" / f"S2_{i}.npy").write_bytes(b"x")
    patches = dense.patch_metadata(spark, str(tmp_path / "metadata.geojson"))
    files = dense.listing(spark, str(tmp_path / "data"), "*.npy")
    have, gone = dense.present_patches(patches, files, "patch", F.concat(F.lit("S2_"), F.col("patch").cast("string"), F.lit(".npy")), [1, 2])
    assert {r["patch"] for r in have.collect()} == {0, 1, 4} and [(r["patch"], r["file"]) for r in gone.collect()] == [(3, "S2_3.npy")]
    named = spark.createDataFrame([("/e/fold_1/a_7_1_0.labels.npy",), ("/e/fold_1/12_1_0.labels.npy",), ("/e/x.npy",)], "path string").select(dense.tile_identity(F.col("path")).alias("t")).collect()
    assert [r["t"] and tuple(r["t"]) for r in named] == [(None, 1, 0), (12, 1, 0), None]
