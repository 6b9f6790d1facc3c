"""Probes: cheap classifiers over feature vectors, fitted by Spark ML, and the prediction tables they give."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from farfield.functions.columns import ratio
from farfield.operators import metrics as M
from farfield.operators.nearest import CHUNK_ROWS, Nearest, meeting, searched, unit, vectors
from farfield.operators.ranks import systematic_order

BLOCK_BYTES = 64 << 20  # asked vectors and their nearest rows that one task holds


def balance_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds weight = n / (classes x rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("__c"))
    facts = counts.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k"))
    return df.join(counts, label).crossJoin(F.broadcast(facts)).withColumn("weight", F.col("__n") / (F.col("__k") * F.col("__c"))).drop("__c", "__n", "__k")


def weight_summary(df: DataFrame, weight: str = "weight") -> DataFrame:
    """(w_min, w_max, w_std, effective_n)."""
    w = F.col(weight)
    return df.agg(F.min(w).alias("w_min"), F.max(w).alias("w_max"), F.stddev_pop(w).alias("w_std"), (F.pow(F.sum(w), 2) / F.sum(w * w)).alias("effective_n"))


def standardiser(train: DataFrame, x: str) -> DataFrame:
    """(means, stds): population moments of each dimension of the training vectors; a constant one gets 1.

    One aggregate over vectors: what is shuffled are partial sums, a row for each task.
    """
    vectors = train.select(array_to_vector(F.col(x).cast("array<double>")).alias("v"))
    m = vectors.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("m"))
    pair = F.arrays_zip(vector_to_array("m.mean").alias("m"), vector_to_array("m.variance").alias("s"))
    scale = lambda z: F.sqrt(z["s"] * (n - 1) / n)  # noqa: E731 - the variance is that of a sample
    n = F.col("m.count").cast("double")
    return m.select(F.transform(pair, lambda z: z["m"]).alias("means"), F.transform(pair, lambda z: F.when(scale(z) > 0, scale(z)).otherwise(1.0)).alias("stds"))


def standardised(df: DataFrame, moments: DataFrame, x: str) -> DataFrame:
    """``x`` in standard units, as doubles."""
    scaled = F.transform(F.arrays_zip(F.col(x).alias("v"), F.col("means").alias("m"), F.col("stds").alias("s")), lambda z: (z["v"] - z["m"]) / z["s"])
    return df.crossJoin(F.broadcast(moments)).withColumn(x, scaled).drop("means", "stds")


class Probe:
    """A fitted probe: ``predict`` adds classes, probs and pred to rows with the feature column."""

    def __init__(self, model, moments: DataFrame, classes: list, x: str):
        self.model, self.moments, self.classes, self.x = model, moments, classes, x

    def predict(self, df: DataFrame) -> DataFrame:
        ready = standardised(df, self.moments, self.x).withColumn("__f", array_to_vector(self.x))
        out = self.model.transform(ready).withColumn("probs", vector_to_array("__p"))
        names = F.array(*[F.lit(c) for c in self.classes])
        best = F.element_at(names, F.array_position("probs", F.array_max("probs")).cast("int"))
        return out.withColumns({"classes": names, "pred": best}).drop("__f", "__p", "__r", "__i", "__y", self.x)


def fit(train: DataFrame, label: str, x: str = "x", c: float = 1.0, max_iter: int = 200) -> Probe:
    """Standardise and fit one linear probe by Spark ML: L2, weighted by inverse class frequency. ``joint`` fits many, and networks."""
    moments = standardiser(train, x)
    classes = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]
    if len(classes) < 2:
        raise ValueError("a probe needs two classes")
    index = F.array_position(F.array(*[F.lit(k) for k in classes]), F.col(label)) - 1
    ready = standardised(balance_weights(train, label), moments, x).select(array_to_vector(x).alias("__f"), index.cast("double").alias("__i"), "weight").cache()
    try:
        total = ready.agg(F.sum("weight")).first()[0]
        est = LogisticRegression(featuresCol="__f", labelCol="__i", weightCol="weight", probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y", standardization=False, regParam=1 / (c * total), maxIter=max_iter)
        return Probe(est.fit(ready), moments, classes, x)
    finally:
        ready.unpersist()


def _votes(d: np.ndarray, labels: np.ndarray, classes: Iterable) -> np.ndarray:
    """Class shares by 1 / distance; an exact match leaves only exact matches."""
    exact = d <= 1e-15
    weight = np.where(exact.any(axis=1, keepdims=True), exact.astype(float), 1 / np.maximum(d, 1e-15))
    p = np.stack([(weight * (labels == c)).sum(axis=1) for c in classes], axis=1)
    return p / p.sum(axis=1, keepdims=True)


def neighbours(train: DataFrame, test: DataFrame, label: str, key: str, x: str = "x", k: int = 20) -> DataFrame:
    """(key, classes, probs, pred): cosine k-nearest neighbours on standardised features, votes weighted by 1 / distance.

    Chunks of test rows meet all training rows, which stream past them (``operators/nearest.py``). ``key`` tells the test rows apart.
    """
    n = train.count()
    if n < 2:
        raise ValueError("a neighbour probe takes two training rows")
    moments = standardiser(train, x)
    depth, width = min(k, n - 1), train.agg(F.max(F.size(x))).first()[0]
    classes = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]
    kind, label_kind = test.schema[key].dataType.simpleString(), train.schema[label].dataType
    place = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1).cast("int")
    held = standardised(train, moments, x).select(place.alias("__y"), F.col(x).alias("__x"))
    asked = standardised(test, moments, x).select(key, F.col(x).alias("__x"))
    names, names_type = np.array(classes, dtype=object), to_arrow_type(label_kind)

    def begin(rows: pa.Table) -> tuple:
        near = Nearest(unit(vectors(rows, "__x")), depth)

        def found() -> Iterator[pa.RecordBatch]:
            p = _votes(near.d, near.y, range(len(classes)))
            ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(classes))
            lists = [pa.ListArray.from_arrays(ends, pa.array(classes * len(p), names_type)), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))]
            out = pa.Table.from_arrays([rows.column(key).combine_chunks(), *lists, pa.array(names[p.argmax(axis=1)], names_type)], names=[key, "classes", "probs", "pred"])
            yield from out.to_batches()

        return lambda b: near.see(unit(vectors(b, "__x")), np.asarray(b.column("__y"))), found

    met = meeting(asked, held, key, min(CHUNK_ROWS, BLOCK_BYTES // (16 * width + 12 * depth)))
    return met.mapInArrow(lambda batches: searched(batches, begin), f"{key} {kind}, classes array<{label_kind.simpleString()}>, probs array<double>, pred {label_kind.simpleString()}")


def binary_predictions(predicted: DataFrame, threshold: float, positive=1) -> DataFrame:
    """Adds prob, pred_default and pred_calibrated from the class probabilities."""
    p = F.element_at("probs", F.array_position("classes", F.lit(positive)).cast("int"))
    return predicted.withColumns({"prob": p, "pred_default": F.when(p >= 0.5, 1).otherwise(0), "pred_calibrated": F.when(p >= threshold, 1).otherwise(0)})


def calibrated(train: DataFrame, validation: DataFrame | None, label: str, key: str, x: str = "x", grid: tuple[float, ...] = (1.0,), seed: int = 0) -> tuple[Probe, float, str]:
    """(probe, threshold, source): the threshold is set on the validation rows if they have both classes, else on a
    stratified fifth of the training rows, else on the training rows; over a grid the first best validation AUC wins."""
    source, fit_rows, tune = "validation", train, validation
    if validation is None or validation.select(label).distinct().count() < 2:
        counts = [r[0] for r in train.groupBy(label).agg(F.count("*")).select("count(1)").collect()]
        if sum(counts) >= 20 and len(counts) == 2 and min(counts) >= 4:
            order = systematic_order(train, [], [label], seed, "internal", key, "__o").withColumn("__v", F.col("__o") % 5 == 0)
            source, fit_rows, tune = "internal", order.where("not __v").drop("__o", "__v"), order.where("__v").drop("__o", "__v")
        else:
            source, fit_rows, tune = "train", train, train
    best = None
    for c in grid:
        probe = fit(fit_rows, label, x, c=c)
        scored = binary_predictions(probe.predict(tune), 0.5).withColumn("__cell", F.lit(1)).withColumn("y_true", F.col(label).cast("int"))
        score = M.auc(scored, ["__cell"]).first()
        value = score["auc"] if score and score["auc"] is not None else 0.0
        if best is None or value > best[0]:
            best = (value, probe, scored)
    threshold = M.f1_thresholds(best[2], ["__cell"]).first()["threshold"]
    return best[1], float(threshold), source


def prediction_rows(predicted: DataFrame, identity: dict[str, object], key: str, label: str, group: str) -> DataFrame:
    """Prediction rows with the cell's identity: the probability of the prediction and of the truth (NaN for an unseen class)."""
    at = F.array_position("classes", F.col(label))
    p_true = F.when(at > 0, F.element_at("probs", F.when(at > 0, at.cast("int")).otherwise(1))).otherwise(F.lit(float("nan")))
    return predicted.select(*[F.lit(v).alias(k) for k, v in identity.items()], F.col(key).alias("sample_id"), F.col(group).alias("group"), F.col(label).alias("y_true"), "pred", F.array_max("probs").alias("prob_pred"), p_true.alias("prob_true"), "classes", "probs")


def permutation_drop(score: float, permuted: dict[str, float]) -> list[tuple[str, float]]:
    """(band, drop): how much each perturbed score lies below the score itself."""
    return [(band, score - s) for band, s in permuted.items()]


def effective_share(df: DataFrame, weight: str = "weight") -> DataFrame:
    """(share): effective over actual number of rows."""
    w = F.col(weight)
    return df.agg(ratio(F.pow(F.sum(w), 2), F.sum(w * w) * F.count("*")).alias("share"))
