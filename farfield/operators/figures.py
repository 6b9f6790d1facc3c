"""Tables behind the figures of a study: deployment cells, means by family, budget, regime and region, gaps between inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: the score that counts for each benchmark
PRIMARY = {"cropharvest": "calibrated_f1", "eurocropsml": "macro_f1", "breizhcrops": "macro_f1", "pastis": "miou"}
#: what tells result cells apart
CELL = ["model", "bench", "probe_family", "split_regime", "evaluation_split", "label_budget", "holdout", "seed"]


def primary(bench: Column, rows: DataFrame) -> Column:
    """The primary score of a row's benchmark; a suffix after two underscores (as of a view) is no part of its name."""
    base = F.substring_index(bench, "__", 1)
    out = F.lit(None).cast("double")
    for name, metric in PRIMARY.items():
        out = F.when(base == name, F.col(metric)).otherwise(out)
    return F.when(base.isin(*PRIMARY), out).otherwise(F.col("macro_f1") if "macro_f1" in rows.columns else F.lit(None).cast("double"))


def ood_cell(regime: str = "geographic_ood", budget: float = 0) -> Column:
    return (F.col("split_regime") == regime) & (F.col("evaluation_split") == "full") & (F.col("label_budget") == budget)


def deployment_cell() -> Column:
    """Within the distribution the test with all source labels; elsewhere the whole target without a label."""
    within = F.col("split_regime") == "random_id"
    return F.when(within, (F.col("evaluation_split") == "test") & (F.col("label_budget") == 1.0)).otherwise((F.col("evaluation_split") == "full") & (F.col("label_budget") == 0))


def last_of_cell(rows: DataFrame, order: str, by: list[str] = ()) -> DataFrame:
    """One row for each cell (of each ``by``): the last in ``order``, where a cell was run on several machines."""
    keys = [*by, *CELL]
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__l")).select(*keys, "__l.*")


def means(rows: DataFrame, where: Column, by: list[str]) -> DataFrame:
    """(by, score, n): the mean primary score of the cells that qualify; cells without a score don't count."""
    scored = rows.where(where).withColumn("__v", primary(F.col("bench"), rows))
    return scored.groupBy(*by).agg(F.avg("__v").alias("score"), F.count("__v").alias("n")).where("n > 0")


def budget_swing(rows: DataFrame, budget: str) -> DataFrame:
    """(probe_family, max_swing): over the models, the largest spread of a family's mean scores between sample budgets."""
    per = means(rows, ood_cell(), ["probe_family", "model", budget])
    spread = per.groupBy("probe_family", "model").agg((F.max("score") - F.min("score")).alias("swing"))
    return spread.groupBy("probe_family").agg(F.max("swing").alias("max_swing"))


def scaling(rows: DataFrame, budget: str, first: str, last: str) -> DataFrame:
    """(probe_family, from_score, to_score, delta) between two sample budgets."""
    per = means(rows, ood_cell(), ["probe_family", budget])
    at = lambda b: F.max(F.when(F.col(budget) == b, F.col("score")))
    return per.groupBy("probe_family").agg(at(first).alias("from_score"), at(last).alias("to_score")).withColumn("delta", F.col("to_score") - F.col("from_score"))


def region_means(rows: DataFrame) -> DataFrame:
    """(bench, holdout, score, place, mean_of_regions): regions from the worst on, and their plain mean."""
    per = means(rows, ood_cell(), ["bench", "holdout"])
    listed = per.groupBy("bench").agg(F.array_sort(F.collect_list(F.struct("score", "holdout"))).alias("e"), F.avg("score").alias("mean_of_regions"))  # as many as regions
    return listed.select("bench", "mean_of_regions", F.posexplode("e").alias("place", "r")).select("bench", "r.holdout", "r.score", "place", "mean_of_regions")


def calibration_gap(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(model, metric, id, ood): calibration within and outside of the distribution, for models that have both."""
    side = F.when((F.col("split_regime") == "random_id") & deployment_cell(), "id").when(ood_cell(), "ood")
    long = rows.withColumn("__s", side).where("__s is not null").select("model", "__s", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("z"))
    per = long.groupBy("model", "z.metric").agg(*[F.avg(F.when(F.col("__s") == s, F.col("z.v"))).alias(s) for s in ("id", "ood")])
    return per.where("id is not null and ood is not null")


def native_against_optical(native: DataFrame, optical: DataFrame) -> DataFrame:
    """(model, native, optical, difference): mean scores with all inputs and with the optical ones alone."""
    a, b = (means(d, ood_cell(), ["model"]).select("model", F.col("score").alias(n)) for d, n in ((native, "native"), (optical, "optical")))
    return a.join(b, "model").withColumn("difference", F.col("native") - F.col("optical"))
