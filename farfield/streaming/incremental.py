"""Scores that follow prediction files as they arrive.

The state of each query is a row of sums for a cell (or a confusion entry), never the predictions themselves; final scores
come from those sums in ``foreachBatch`` or from the table that the query keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farfield.functions.columns import calibration_bin
from farfield.operators import metrics as M


def prediction_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """Parquet prediction files of a folder, in the order they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def without_repeats(stream: DataFrame, cell: list[str], sample: str, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Predictions less those that a restarted writer appended again; the first of each (cell, sample) stays.

    With an ingest time the state is dropped once ``delay`` has passed; without one it holds every key.
    """
    if time:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([*cell, sample])
    return stream.dropDuplicates([*cell, sample])


def calibration_sums(stream: DataFrame, cell: list[str], y: str = "y_true", p: str = "prob") -> DataFrame:
    """(cell, bin, n, hits, confidence, brier): sufficient statistics of the binary calibration scores."""
    rows = stream.withColumn("bin", calibration_bin(F.col(p)))
    return rows.groupBy(*cell, "bin").agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("hits"), F.sum(p).alias("confidence"), F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))


def calibration_scores(sums: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, n, ece, brier, test_pos_rate) from the sums."""
    n = F.sum("n")
    return sums.groupBy(*cell).agg(n.alias("n"), (F.sum(F.abs(F.col("hits") - F.col("confidence"))) / n).alias("ece"), (F.sum("brier") / n).alias("brier"), (F.sum("hits") / n).alias("test_pos_rate"))


def confusion_stream(stream: DataFrame, cell: list[str], tile: list[str] = (), y: str = "y_true", pred: str = "pred") -> DataFrame:
    """(cell, tile, y, pred, n) as running counts."""
    return M.confusion(stream, [*cell, *tile], y, pred)


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run the stream over what there is now and return its table: for aggregates, whose size is that of the cells."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write newly arrived, planned rows once each; a restart goes on where the last run stopped."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
