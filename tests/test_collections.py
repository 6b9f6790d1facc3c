"""Array collections as a data source: rows, pruned columns, files left out by name, rejects, partitions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from farfield.sources import collections, files


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    collections.collection_format(spark)
    top = tmp_path_factory.mktemp("arrays")
    (top / "deep").mkdir()
    rng = np.random.default_rng(0)
    for k in range(6):
        t = 3 + k
        arrays = {"data": rng.normal(size=(t, 2)).astype(np.float32), "dates": np.datetime64("2021-03-01") + np.arange(t)}
        np.savez(top / ("deep" if k % 2 else "") / f"p{k}.npz", **arrays, **({"center": np.array([k, -k])} if k else {}))
    np.savez(top / "flat.npz", data=np.zeros(4), dates=np.arange(4))
    np.savez(top / "short.npz", data=np.zeros((4, 2)), dates=np.zeros(3))
    (top / "torn.npz").write_bytes(b"PK\x03\x04 not a file")
    np.save(top / "S2_7.npy", np.arange(2 * 3 * 2 * 2).reshape(2, 3, 2, 2))
    np.save(top / "TARGET_7.npy", np.arange(3 * 2 * 2).reshape(3, 2, 2))
    np.save(top / "odd.npy", np.zeros((2, 2)))
    np.save(top / "S2_8.npy", np.zeros((2, 2)))
    return str(top)


def load(spark, root, name, **options):
    return spark.read.format("collection").option("name", name).options(**options).load(root)


def test_series(spark, root):
    got = load(spark, root, "eurocropsml")
    assert got.count() == 2 * sum(3 + k for k in range(6))
    wide = {(r["sample_id"], r["t"], r["band"]): (str(r["date"]), round(r["value"], 5)) for r in got.collect()}
    with np.load(f"{root}/deep/p3.npz") as z:
        assert all(wide["p3", t, b] == (str(z["dates"][t]), round(float(z["data"][t, b]), 5)) for t in range(6) for b in range(2))
    centres = {r["sample_id"]: (r["lat"], r["lon"]) for r in got.select("sample_id", "lat", "lon").distinct().collect()}
    assert centres["p3"] == (3.0, -3.0) and np.isnan(centres["p0"][0])


def test_uris_and_the_reader_of_spark_agree(spark, root):
    mine = load(spark, f"file://{root}/deep", "series").orderBy("sample_id", "t", "band").collect()
    other = files.array_files(spark, f"{root}/deep").select(*load(spark, root, "series").columns).orderBy("sample_id", "t", "band").collect()
    assert mine == other and len(mine) > 20


def test_only_asked_columns_are_decoded(spark, tmp_path):
    collections.collection_format(spark)
    np.savez(tmp_path / "a.npz", data=np.zeros((2, 2)), dates=np.array(["not a date", "either"]))
    pruned = spark.read.format("collection").schema("band int, sample_id string").option("name", "series").load(str(tmp_path))
    assert pruned.columns == ["band", "sample_id"] and sorted(r["band"] for r in pruned.collect()) == [0, 0, 1, 1]
    assert load(spark, str(tmp_path), "series").count() == 0  # its dates can't be read


def test_tiles(spark, root):
    got = load(spark, root, "pastis")
    cube = {(r["modality"], r["t"], r["row"], r["col"]): r["bands"] for r in got.where("patch = 7").collect()}
    assert len(cube) == 8 + 4 and cube["S2", 1, 0, 1] == [13.0, 17.0, 21.0] and cube["TARGET", 0, 1, 1] == [3.0, 7.0, 11.0]


def test_rejects_are_named(spark, root):
    assert {r["sample_id"] for r in load(spark, root, "series", rejects=True).collect()} == {"flat", "short", "torn"}
    assert {r["sample_id"]: r["reason"] for r in load(spark, root, "tiles", rejects="true").collect()} == {"odd": "the name isn't <modality>_<patch>", "S2_8": "a cube of 2 dimensions"}


def test_files_are_left_out_by_name_and_dealt_by_bytes(spark, root):
    one = load(spark, root, "series", partition_bytes=1).where("sample_id = 'p4'")
    assert one.count() == 14 and one.rdd.getNumPartitions() == 1
    assert load(spark, root, "series", partition_bytes=1).rdd.getNumPartitions() == 9
    assert load(spark, root, "series").where(F.col("sample_id").isin("p1", "p2")).select("sample_id").distinct().count() == 2


def test_unknown_names(spark, root):
    with pytest.raises(Exception, match="no collection"):
        load(spark, root, "letters").count()
