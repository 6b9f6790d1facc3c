"""Scores that follow predictions which may be corrected later: the newest of each (cell, sample) counts.

State holds the newest prediction of a key. A newer one is passed on as two changes, one that takes the old prediction out of
the sums and one that puts the new one in; a repeated or an older one changes nothing. Each micro-batch commits its changes,
summed by cell and bin, as one cell of a table (``sources/commits.py``), so a batch that runs again after a crash counts once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from farfield.functions.columns import TEN_BINS
from farfield.sources import commits
from farfield.streaming.incremental import calibration_scores

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SUMS = ("n", "hits", "confidence", "brier")
_HELD = StructType([StructField("version", LongType()), StructField("y", DoubleType()), StructField("p", DoubleType())])


class Newest(StatefulProcessor):
    """Changes of the sums by key; state that isn't renewed for ``keep_ms`` goes."""

    def __init__(self, cell: list[str], keep_ms: int | None):
        self.cell, self.keep_ms = cell, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("newest", _HELD, self.keep_ms) if self.keep_ms else handle.getValueState("newest", _HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = tuple(self.held.get()) if self.held.exists() else None
        new = old
        for r in rows:
            if new is None or r["version"] >= new[0]:
                new = (r["version"], float(r["y"]), float(r["p"]))
        if new == old:
            return
        self.held.update(new)
        if old is None or new[1:] != old[1:]:
            for sign, (_, y, p) in ((-1, old), (1, new)) if old else ((1, new),):
                sums = {"n": sign, "hits": sign * y, "confidence": sign * p, "brier": sign * (p - y) ** 2}
                yield Row(**dict(zip(self.cell, key, strict=False)), bin=bisect_right(TEN_BINS, p), **sums)

    def close(self) -> None:
        pass


def changes(stream: DataFrame, cell: list[str], sample: str, version: str, y: str = "y_true", p: str = "prob", keep_ms: int | None = None) -> DataFrame:
    """(cell, bin, n, hits, confidence, brier): what each micro-batch adds to the sums; rows with nulls there are left out."""
    rows = stream.select(*cell, sample, F.col(version).cast("long").alias("version"), F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")).dropna(subset=["version", "y", "p"])
    out = StructType([*[rows.schema[c] for c in cell], StructField("bin", IntegerType()), StructField("n", LongType()), *[StructField(c, DoubleType()) for c in _SUMS[1:]]])
    return rows.groupBy(*cell, sample).transformWithState(Newest(cell, keep_ms), out, "Update", "ProcessingTime" if keep_ms else "None")


def follow(stream: DataFrame, path: str, checkpoint: str, cell: list[str], sample: str, version: str, keep_ms: int | None = None, after_commit: Callable[[int], None] | None = None) -> None:
    """Take in what has arrived. ``path`` is the table of changes; a restart goes on where the checkpoint stands."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def keep(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*cell, "bin").agg(*[F.sum(c).alias(c) for c in _SUMS])
        if not commits.append_cell(sums, path, {"batch": number}):
            sums.write.format("noop").mode("overwrite").save()  # the state must take the batch in all the same
        if after_commit:
            after_commit(number)

    try:
        query = changes(stream, cell, sample, version, keep_ms=keep_ms).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def scores(spark: SparkSession, path: str, cell: list[str]) -> DataFrame:
    """(cell, n, ece, brier, test_pos_rate) as of the last committed batch."""
    sums = commits.committed(spark, path).groupBy(*cell, "bin").agg(*[F.sum(c).alias(c) for c in _SUMS]).where("n > 0")
    return calibration_scores(sums, cell)
