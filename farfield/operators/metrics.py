"""Scores from prediction tables, one grouped query for all cells.

``by`` names the columns of a cell. Ranked quantities (thresholds, midranks, coverage) need running totals over the
distinct scores of a cell. A cell may hold a third of all rows, so totals run in two levels: over ranges of the score,
of which there are few, and within each range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farfield.functions.columns import calibration_bin, finite, ratio

RANGES = 512
_EPS = 1e-15


def running_totals(df: DataFrame, by: list[str], order: str, sums: list[str], descending: bool, strictly_before: bool = False) -> DataFrame:
    """Adds ``run_<c>``: for each c of ``sums`` the total of the rows of the cell up to and with this one (or before it).

    ``df`` has one row for each value of ``order`` in a cell; values lie in [0, 1] or fall into the outer ranges.
    """
    part = F.greatest(F.least(F.floor(F.col(order) * RANGES), F.lit(RANGES)), F.lit(-1)).cast("int")
    df = df.withColumn("__range", part)
    totals = df.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    key = F.desc("__range") if descending else F.asc("__range")
    above = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__range", *[F.coalesce(F.sum(f"__{c}").over(above), F.lit(0)).alias(f"__{c}") for c in sums])
    inner = Window.partitionBy(*by, "__range").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, -1 if strictly_before else 0)
    joined = df.join(offsets, [*by, "__range"])
    out = joined.withColumns({f"run_{c}": F.col(f"__{c}") + F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in sums})
    return out.drop("__range", *[f"__{c}" for c in sums])


def f1_thresholds(df: DataFrame, by: list[str], y: str = "y_true", p: str = "prob") -> DataFrame:
    """(by, threshold, f1): the score cut (p >= t) with the best F1, the lowest of equals; 0.5 for one class or no hit."""
    whole = df.groupBy(*by).agg(F.sum(y).alias("positives"), F.count("*").alias("n"))
    levels = df.where(finite(F.col(p)).isNotNull()).groupBy(*by, p).agg(F.sum(y).alias("pos"), F.count("*").alias("cnt"))
    seen = levels.groupBy(*by).agg(F.sum("pos").alias("seen_pos"))
    run = running_totals(levels, by, p, ["pos", "cnt"], descending=True).join(seen, by)
    f1 = ratio(2 * F.col("run_pos"), F.col("run_cnt") + F.col("seen_pos"), 0.0)
    best = run.withColumn("f1", f1).groupBy(*by).agg(F.max_by(F.struct(F.col(p).alias("t"), "f1"), F.struct("f1", -F.col(p))).alias("b"))
    known = (F.col("positives") > 0) & (F.col("positives") < F.col("n")) & (F.col("b.f1") > 0)
    return whole.join(best, by, "left").select(*by, F.when(known, F.col("b.t")).otherwise(0.5).alias("threshold"), F.coalesce(F.col("b.f1"), F.lit(0.0)).alias("f1"))


def calibration_error(df: DataFrame, by: list[str], hit: str = "y_true", p: str = "prob", name: str = "ece") -> DataFrame:
    """(by, ece): mean distance of hit rate and confidence over ten bins, weighted by their rows."""
    bins = df.withColumn("__bin", calibration_bin(F.col(p))).groupBy(*by, "__bin").agg(F.sum(F.col(hit).cast("double")).alias("__h"), F.sum(p).alias("__c"), F.count("*").alias("__n"))
    return bins.groupBy(*by).agg((F.sum(F.abs(F.col("__h") - F.col("__c"))) / F.sum("__n")).alias(name))


def auc(df: DataFrame, by: list[str], y: str = "y_true", p: str = "prob") -> DataFrame:
    """(by, auc) by midranks; null where a cell has one class."""
    levels = df.groupBy(*by, p).agg(F.sum(y).alias("pos"), F.count("*").alias("cnt"))
    run = running_totals(levels, by, p, ["cnt"], descending=False, strictly_before=True)
    sums = run.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("run_cnt") + (F.col("cnt") + 1) / 2)).alias("ranks"), F.sum("pos").alias("n1"), F.sum("cnt").alias("n"))
    n1, n0 = F.col("n1").cast("double"), (F.col("n") - F.col("n1")).cast("double")
    return sums.select(*by, F.when((n1 > 0) & (n0 > 0), (F.col("ranks") - n1 * (n1 + 1) / 2) / F.when(n1 * n0 > 0, n1 * n0)).alias("auc"))


def _counts(pred: Column, y: Column) -> dict[str, Column]:
    on = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return {"tp": on((pred == 1) & (y == 1)), "fp": on((pred == 1) & (y == 0)), "fn": on((pred == 0) & (y == 1)), "tn": on((pred == 0) & (y == 0))}


def _f1(prefix: str = "") -> Column:
    c = lambda x: F.col(prefix + x)
    return ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"), 0.0)


def _balanced(prefix: str = "") -> Column:
    """Mean recall of the classes that occur."""
    c = lambda x: F.col(prefix + x)
    r1, r0 = ratio(c("tp"), c("tp") + c("fn")), ratio(c("tn"), c("tn") + c("fp"))
    return F.coalesce((r1 + r0) / 2, r1, r0)


def binary_scorecard(df: DataFrame, by: list[str], y: str = "y_true", p: str = "prob", default: str = "pred_default", calibrated: str = "pred_calibrated") -> DataFrame:
    """All binary scores of each cell: F1 and balanced accuracy of both cuts and of the best cut, AUC, ECE, Brier, log loss."""
    best = f1_thresholds(df, by, y, p).withColumnRenamed("threshold", "diagnostic_optimal_threshold_test").withColumnRenamed("f1", "__best")
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.when(F.col(y) == 1, F.log(clipped)).otherwise(F.log(1 - clipped))
    aggregates = {
        **{f"d_{k}": v for k, v in _counts(F.col(default), F.col(y)).items()},
        **{f"c_{k}": v for k, v in _counts(F.col(calibrated), F.col(y)).items()},
        "brier": F.avg(F.pow(F.col(p) - F.col(y), 2)),
        "nll": F.avg(loss),
        "test_pos_rate": F.avg(F.col(y).cast("double")),
        "n_test": F.count("*"),
    }
    sums = df.groupBy(*by).agg(*[v.alias(k) for k, v in aggregates.items()])
    out = sums.join(best, by).join(auc(df, by, y, p), by).join(calibration_error(df, by, y, p), by)
    # at the cut of 0.5 that stands in for a cell without a best one, F1 is that of predictions at 0.5
    at_half = df.groupBy(*by).agg(*[v.alias(f"h_{k}") for k, v in _counts(F.when(F.col(p) >= 0.5, 1).otherwise(0), F.col(y)).items()])
    one_class = (F.col("test_pos_rate") == 0) | (F.col("test_pos_rate") == 1)
    out = out.join(at_half, by)
    return out.select(
        *by,
        "n_test",
        _f1("d_").alias("f1"),
        "auc",
        _balanced("d_").alias("balanced_accuracy"),
        _f1("c_").alias("calibrated_f1"),
        _balanced("c_").alias("calibrated_balanced_accuracy"),
        F.when(one_class | (F.col("__best") <= 0), _f1("h_")).otherwise(F.col("__best")).alias("diagnostic_calibrated_f1_target_optimal"),
        "diagnostic_optimal_threshold_test",
        "ece",
        "brier",
        "nll",
        "test_pos_rate",
    )


def confusion(df: DataFrame, by: list[str], y: str = "y_true", pred: str = "pred") -> DataFrame:
    """(by, y, pred, n)."""
    return df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_scores(matrix: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, tp, rows, cols, f1, recall, iou) for every label of truth or prediction; iou is null without truth."""
    rows = matrix.groupBy(*by, F.col("y").alias("label")).agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    cols = matrix.groupBy(*by, F.col("pred").alias("label")).agg(F.sum("n").alias("cols"))
    both = rows.join(cols, [*by, "label"], "full").fillna(0, ["rows", "tp", "cols"])
    tp, r, c = F.col("tp"), F.col("rows"), F.col("cols")
    return both.select(*by, "label", "tp", "rows", "cols", ratio(2 * tp, r + c, 0.0).alias("f1"), ratio(tp, r).alias("recall"), F.when(r > 0, ratio(tp, r + c - tp, 0.0)).alias("iou"))


def multiclass_scorecard(df: DataFrame, by: list[str], y: str = "y_true", pred: str = "pred", classes: str | None = "classes") -> DataFrame:
    """Macro and weighted F1, balanced accuracy, accuracy, class counts, and the same over rows whose class was trained."""

    def scores(part: DataFrame, prefix: str) -> DataFrame:
        per = class_scores(confusion(part, by, y, pred), by)
        return per.groupBy(*by).agg(
            F.avg("f1").alias(f"{prefix}macro_f1"),
            (F.sum(F.col("f1") * F.col("rows")) / F.sum("rows")).alias(f"{prefix}weighted_f1"),
            F.avg("recall").alias(f"{prefix}balanced_accuracy"),
            (F.sum("tp") / F.sum("rows")).alias(f"{prefix}accuracy"),
            *([F.sum(F.when(F.col("rows") > 0, 1).otherwise(0)).alias("n_classes_test"), (F.max("rows") / F.sum("rows")).alias("majority_rate")] if not prefix else []),
        )

    out = scores(df, "")
    if classes is None:
        return out
    seen = F.array_contains(classes, F.col(y))
    shared = scores(df.where(seen), "shared_").select(*by, "shared_macro_f1", "shared_weighted_f1", "shared_balanced_accuracy", "shared_accuracy")
    share = df.groupBy(*by).agg(F.avg(F.when(seen, 0.0).otherwise(1.0)).alias("unseen_prevalence"))
    return out.join(share, by).join(shared, by, "left")


def one_vs_rest_auc(df: DataFrame, by: list[str], y: str = "y_true", classes: str = "classes", probs: str = "probs") -> DataFrame:
    """(by, macro_auc): the mean over classes of each class against the rest; null where truth and classes differ."""
    pairs = df.select(*by, y, F.explode(F.arrays_zip(F.col(classes).alias("k"), F.col(probs).alias("q"))).alias("z")).select(*by, F.col("z.k").alias("k"), F.col("z.q").alias("prob"), F.when(F.col(y) == F.col("z.k"), 1).otherwise(0).alias("hit"))
    mean = auc(pairs, [*by, "k"], "hit", "prob").groupBy(*by).agg(F.avg("auc").alias("a"), F.count("auc").alias("have"), F.count("*").alias("want"))
    unseen = df.groupBy(*by).agg(F.max(F.when(F.array_contains(classes, F.col(y)), 0).otherwise(1)).alias("unseen"))
    return mean.join(unseen, by).select(*by, F.when((F.col("have") == F.col("want")) & (F.col("unseen") == 0), F.col("a")).alias("macro_auc"))


def multiclass_rows(df: DataFrame, y: str = "y_true", classes: str = "classes", probs: str = "probs") -> DataFrame:
    """Adds what calibration needs of each row: seen, p_true (0 for an unseen class), p_top, correct, squares."""
    at = F.array_position(classes, F.col(y))
    top = F.array_max(probs)
    return df.withColumns(
        {
            "seen": (at > 0).cast("int"),
            "p_true": F.when(at > 0, F.element_at(probs, F.when(at > 0, at.cast("int")).otherwise(1))).otherwise(0.0),
            "p_top": top,
            "correct": F.when(F.element_at(classes, F.array_position(probs, top).cast("int")) == F.col(y), 1).otherwise(0),
            "squares": F.aggregate(probs, F.lit(0.0), lambda a, x: a + x * x),
        }
    )


def multiclass_calibration(df: DataFrame, by: list[str], y: str = "y_true", classes: str = "classes", probs: str = "probs") -> DataFrame:
    """Calibration where some true classes have no column: log loss is infinite if any row is unseen, the union Brier score
    charges the missing unit, ``shared_`` scores leave unseen rows out, ECE of the top label covers all rows."""
    rows = multiclass_rows(df, y, classes, probs)
    seen = F.col("seen") == 1
    brier = F.col("squares") - 2 * F.col("p_true") + 1
    clipped = F.least(F.greatest(F.col("p_true"), F.lit(_EPS)), F.lit(1.0))
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n_test"),
        F.sum("seen").alias("n_seen"),
        F.avg(brier).alias("union_brier"),
        F.avg(F.when(seen, brier)).alias("shared_brier"),
        F.avg(F.when(seen, -F.log(clipped))).alias("shared_nll"),
        (1 - F.avg(F.col("seen").cast("double"))).alias("unseen_prevalence"),
    )
    all_ece = calibration_error(rows, by, "correct", "p_top", "top_label_ece_all")
    shared_ece = calibration_error(rows.where(seen), by, "correct", "p_top", "shared_ece")
    nll = F.when(F.col("n_seen") == F.col("n_test"), F.col("shared_nll")).otherwise(F.lit(float("inf")))
    out = sums.join(all_ece, by).join(shared_ece, by, "left")
    return out.select(*by, "n_test", "n_seen", F.col("top_label_ece_all").alias("ece"), "top_label_ece_all", nll.alias("nll"), F.col("union_brier").alias("brier"), "union_brier", "shared_ece", "shared_nll", "shared_brier", "unseen_prevalence")


def segmentation_scores(matrix: DataFrame, by: list[str]) -> DataFrame:
    """(by, miou, pixel_accuracy, macro_f1, weighted_f1) from a confusion table; mIoU over classes with truth."""
    per = class_scores(matrix, by)
    return per.groupBy(*by).agg(
        F.avg("iou").alias("miou"),
        (F.sum("tp") / F.sum("rows")).alias("pixel_accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("rows")) / F.sum("rows")).alias("weighted_f1"),
    )


def tile_scores(df: DataFrame, by: list[str], tile: list[str], y: str = "y_true", pred: str = "pred") -> DataFrame:
    """(by, tile_miou_mean, tile_miou_worst, n_tiles): mIoU of each tile, then over the tiles of a cell."""
    per = class_scores(confusion(df, [*by, *tile], y, pred), [*by, *tile]).groupBy(*by, *tile).agg(F.avg("iou").alias("miou"))
    return per.groupBy(*by).agg(F.avg("miou").alias("tile_miou_mean"), F.min("miou").alias("tile_miou_worst"), F.count("*").alias("n_tiles"))


def unknown_labels(df: DataFrame, known: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """(label, column, n): labels in any of ``columns`` that the class table doesn't hold."""
    parts = [df.groupBy(F.col(c).alias(label)).agg(F.count("*").alias("n")).withColumn("column", F.lit(c)) for c in columns]
    return reduce(DataFrame.unionByName, parts).join(known.select(label).distinct(), label, "left_anti").select(label, "column", "n")


def worst_groups(scores: DataFrame, by: list[str], group: str, metrics: list[str]) -> DataFrame:
    """(by, metric, worst, worst_group, n_groups): the least finite value of each metric over groups, the first group on ties."""
    long = scores.select(*by, group, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), finite(F.col(m)).alias("value")) for m in metrics])).alias("z")).select(*by, group, "z.*").where("value is not null")
    return long.groupBy(*by, "metric").agg(F.min("value").alias("worst"), F.min_by(group, F.struct("value", group)).alias("worst_group"), F.count("*").alias("n_groups"))


def risk_coverage(df: DataFrame, by: list[str], correct: str = "correct", confidence: str = "confidence") -> DataFrame:
    """(by, confidence, coverage, risk): a point for each distinct confidence, ties kept together; a confidence that is no
    number raises."""
    checked = F.when(finite(F.col(confidence)).isNull(), F.raise_error(F.lit("confidence is not finite"))).otherwise(F.col(confidence))
    levels = df.groupBy(*by, checked.cast("double").alias("confidence")).agg(F.sum(1 - F.col(correct).cast("int")).alias("err"), F.count("*").alias("cnt"))
    total = levels.groupBy(*by).agg(F.sum("cnt").alias("total"))
    run = running_totals(levels, by, "confidence", ["err", "cnt"], descending=True).join(total, by)
    return run.select(*by, "confidence", (F.col("run_cnt") / F.col("total")).alias("coverage"), (F.col("run_err") / F.col("run_cnt")).alias("risk"))


def selective_summary(df: DataFrame, by: list[str], correct: str = "correct", confidence: str = "confidence", grid: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0)) -> DataFrame:
    """(by, n, n_skipped, base_error, aurc, risk_at_<coverage>...): rows without a finite confidence are skipped and counted.

    The area needs each point's neighbour; points are paired within ranges of confidence and over their borders by the
    last point of the range before.
    """
    good = df.where(finite(F.col(confidence)).isNotNull())
    base = df.groupBy(*by).agg(F.count(finite(F.col(confidence))).alias("n"), F.sum(F.when(finite(F.col(confidence)).isNull(), 1).otherwise(0)).alias("n_skipped"))
    errors = good.groupBy(*by).agg((1 - F.avg(F.col(correct).cast("double"))).alias("base_error"))
    curve = risk_coverage(good, by, correct, confidence)
    area = curve_area(curve, by)
    name = lambda g: f"risk_at_{int(round(g * 100))}"
    at = curve.groupBy(*by).agg(*[F.max_by(F.when(F.col("coverage") <= g + 1e-12, F.col("risk")), F.when(F.col("coverage") <= g + 1e-12, F.col("coverage"))).alias(name(g)) for g in grid])
    return base.join(errors, by, "left").join(area, by, "left").join(at, by, "left")


def curve_area(curve: DataFrame, by: list[str]) -> DataFrame:
    """(by, aurc): the trapezoid area over the span of coverage; null for a single point."""
    part = F.floor(F.col("coverage") * RANGES).cast("int")
    c = curve.withColumn("__range", part)
    inner = Window.partitionBy(*by, "__range").orderBy("coverage")
    ends = c.groupBy(*by, "__range").agg(F.max_by(F.struct("coverage", "risk"), "coverage").alias("last"))
    before = ends.select(*by, "__range", F.lag("last").over(Window.partitionBy(*by).orderBy("__range")).alias("__before"))
    own = F.lag(F.struct("coverage", "risk")).over(inner)
    steps = c.join(before, [*by, "__range"]).withColumn("__p", F.coalesce(own, "__before"))
    width = F.col("coverage") - F.col("__p.coverage")
    out = steps.groupBy(*by).agg(F.sum(width * (F.col("risk") + F.col("__p.risk")) / 2).alias("a"), F.max("coverage").alias("hi"), F.min("coverage").alias("lo"))
    return out.select(*by, ratio(F.col("a"), F.col("hi") - F.col("lo")).alias("aurc"))


def rescored(df: DataFrame, by: list[str], epsilons: tuple[float, ...] = (1e-6, 1e-9, 1e-12, 1e-15)) -> DataFrame:
    """Calibration again from saved predictions, with the log loss that each clipping constant would have reported."""
    rows = multiclass_rows(df)
    sweep = rows.groupBy(*by).agg(*[F.avg(-F.log(F.least(F.greatest(F.col("p_true"), F.lit(e)), F.lit(1.0)))).alias(f"nll_eps_{e:g}".replace("-", "m")) for e in epsilons], F.avg(F.col("squares") - F.when(F.col("seen") == 1, 2 * F.col("p_true") - 1).otherwise(0.0)).alias("old_brier"))
    return multiclass_calibration(df, by).join(sweep, by)


def rescore_problems(new: DataFrame, old: DataFrame, by: list[str], metrics: dict[str, str], tolerance: float = 1e-6) -> DataFrame:
    """Cells that are missing on one side, or whose row count or metrics (old name to new name) don't agree."""
    a, b = new.alias("a"), old.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in by])
    far = [F.when(F.abs(F.col(f"a.{n}") - F.col(f"b.{o}")) > tolerance, F.lit(o)) for o, n in metrics.items()]
    missing = F.when(F.col(f"a.{by[0]}").isNull(), "missing_new").when(F.col(f"b.{by[0]}").isNull(), "missing_old")
    size = F.when(F.col("a.n_test") != F.col("b.n_test"), F.lit("n_test"))
    problems = F.filter(F.array(missing, size, *far), lambda x: x.isNotNull())
    return a.join(b, same, "full").select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in by], problems.alias("problems")).where(F.size("problems") > 0)


#: fixed values: the metrics of each task, which of them decide on deployment and which only explain, and their direction
CALIBRATION = "ece top_label_ece_all nll brier union_brier shared_ece shared_nll shared_brier unseen_prevalence"
METRICS = {
    "binary": "f1 auc balanced_accuracy calibrated_f1 calibrated_balanced_accuracy ece brier nll worst_group_f1 worst_group_balanced_accuracy worst_group_calibrated_f1 worst_group_calibrated_balanced_accuracy worst_group_score",
    "multiclass": "macro_f1 weighted_f1 balanced_accuracy accuracy macro_auc worst_group_macro_f1 worst_group_weighted_f1 worst_group_balanced_accuracy worst_group_accuracy worst_group_score shared_macro_f1 shared_balanced_accuracy shared_accuracy n_classes_unseen n_classes_seen " + CALIBRATION,
    "segmentation": "miou pixel_accuracy macro_f1 weighted_f1 mean_per_tile_miou worst_tile_miou n_tiles_scored " + CALIBRATION,
}
DEPLOYMENT = {
    "binary": "calibrated_f1 calibrated_balanced_accuracy worst_group_calibrated_f1 worst_group_calibrated_balanced_accuracy",
    "multiclass": "macro_f1 balanced_accuracy worst_group_macro_f1 worst_group_balanced_accuracy",
    "segmentation": "miou mean_per_tile_miou worst_tile_miou",
}
DIAGNOSTIC = {
    "binary": "f1 auc balanced_accuracy diagnostic_calibrated_f1_target_optimal diagnostic_optimal_threshold_test ece brier nll",
    "multiclass": "weighted_f1 accuracy macro_auc shared_macro_f1 shared_balanced_accuracy shared_accuracy n_classes_unseen n_classes_seen " + CALIBRATION,
    "segmentation": "pixel_accuracy macro_f1 weighted_f1 n_tiles_scored " + CALIBRATION,
}
LOWER = "ece brier nll top_label_ece_all union_brier shared_ece shared_nll shared_brier unseen_prevalence n_classes_unseen"
STRUCTURAL = "n_classes_seen n_tiles_scored"


def direction(metric: Column) -> Column:
    """higher_is_better, lower_is_better or structural (a count); a metric outside of the universe is unknown."""
    universe = {m for names in METRICS.values() for m in names.split()}
    higher = sorted(universe - {*LOWER.split(), *STRUCTURAL.split()})
    known = F.when(metric.isin(*LOWER.split()), "lower_is_better").when(metric.isin(*STRUCTURAL.split()), "structural")
    return known.when(metric.isin(*higher), "higher_is_better").otherwise("unknown")


def role(task: Column, metric: Column) -> Column:
    """deployment or diagnostic, by task; null where a task has no such role for the metric."""
    out = F.lit(None).cast("string")
    for name, table in (("deployment", DEPLOYMENT), ("diagnostic", DIAGNOSTIC)):
        for t, metrics in table.items():
            out = F.when((task == t) & metric.isin(*metrics.split()), name).otherwise(out)
    return out
