"""Cells that are committed whole, and streams that keep the newest prediction, with writers that fail."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from farfield.functions.columns import calibration_bin
from farfield.sources import commits
from farfield.streaming import incremental, newest


def test_a_lost_writer_leaves_nothing_to_read(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    rows = spark.range(5).withColumn("v", F.col("id") * 2)
    with pytest.raises(ValueError, match="no cell"):
        commits.committed(spark, path)
    commits.stage(rows, path, {"model": "a", "seed": 0})  # lost before its line
    assert commits.manifest(spark, path).count() == 0
    assert commits.append_cell(rows, path, {"model": "a", "seed": 1})
    with pytest.raises(Exception, match="USER_RAISED|half"):  # lost while it writes: some tasks are done, one fails
        commits.append_cell(spark.range(0, 40, 1, 4).withColumn("v", F.when(F.col("id") == 39, F.raise_error(F.lit("half"))).otherwise(F.col("id"))), path, {"model": "a", "seed": 2})
    assert sorted((r["id"], r["v"], r["model"], r["seed"]) for r in commits.committed(spark, path).collect()) == [(k, 2 * k, "a", 1) for k in range(5)]
    assert commits.append_cell(spark.range(2).withColumn("v", F.lit(7)).withColumn("w", F.lit("x")), path, {"model": "a", "seed": 2})
    back = commits.committed(spark, path)
    assert back.count() == 7 and back.where("w = 'x'").count() == 2


def test_a_second_attempt_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    cell = {"model": "a'b\"c", "seed": None}
    assert commits.append_cell(spark.range(3), path, cell) and not commits.append_cell(spark.range(9), path, cell)
    assert commits.committed(spark, path).count() == 3
    # two writers that both saw the cell open: one of them counts, for all readers the same
    for n in (4, 6):
        commits.commit(spark, path, {"model": "z"}, *commits.stage(spark.range(n), path, {"model": "z"}))
    one = commits.committed(spark, path).where("model = 'z'").count()
    assert one in (4, 6) and commits.committed(spark, path).where("model = 'z'").count() == one
    planned = spark.createDataFrame([("z",), ("y",)], "model string")
    assert [r["model"] for r in commits.open_cells(planned, spark, path, ["model"]).collect()] == ["y"]


def test_an_empty_cell_is_a_cell(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    assert commits.append_cell(spark.range(0), path, {"k": 1}) and not commits.append_cell(spark.range(5), path, {"k": 1})
    assert commits.committed(spark, path).count() == 0


def predictions(spark, rng, first, n=60):
    rows = [(f"c{k % 3}", k % 40, first + k, int(rng.random() < 0.5), round(rng.random(), 3)) for k in range(n)]
    return rows + [rows[3], ("c0", None, first, 1, 0.25), ("c1", 7, None, 1, 0.5), ("c1", 7, first, 1, None)]


def plain(spark, rows):
    """The scores of the last version of each (cell, sample)."""
    df = spark.createDataFrame(rows, "cell string, sample long, version long, y_true int, prob double").dropna(subset=["version", "y_true", "prob"])
    last = df.groupBy("cell", "sample").agg(F.max_by(F.struct("y_true", "prob"), "version").alias("z")).select("cell", "z.*").withColumn("bin", calibration_bin(F.col("prob")))
    p, y = F.col("prob"), F.col("y_true")
    sums = last.groupBy("cell", "bin").agg(F.count("*").alias("n"), F.sum(y.cast("double")).alias("hits"), F.sum(p).alias("confidence"), F.sum((p - y) * (p - y)).alias("brier"))
    return {r["cell"]: [round(x, 9) for x in r[1:]] for r in incremental.calibration_scores(sums, ["cell"]).collect()}


def test_batch_and_stream_agree_after_a_crash_and_a_second_append(spark, tmp_path):
    rng = random.Random(2)
    source, path, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "changes", "checkpoint"))
    schema = "cell string, sample long, version long, y_true int, prob double"
    seen = []

    def arrive(rows):
        seen.extend(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def take(after=None):
        newest.follow(incremental.prediction_stream(spark, source, schema, 1), path, checkpoint, ["cell"], "sample", "version", after_commit=after)
        return {r["cell"]: [round(x, 9) for x in r[1:]] for r in newest.scores(spark, path, ["cell"]).collect()}

    arrive(predictions(spark, rng, 0))
    assert take() == plain(spark, seen)
    arrive(predictions(spark, rng, 1000))
    arrive(seen[:20])  # appended again by a restarted writer: older versions

    def crash(number):
        if number == 1:
            raise RuntimeError("lost after the commit, before the checkpoint")

    with pytest.raises(Exception, match="STREAM_FAILED"):
        take(crash)
    arrive(predictions(spark, rng, 500))
    assert take() == plain(spark, seen)
    assert take() == plain(spark, seen)  # nothing new
