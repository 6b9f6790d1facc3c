"""Fit and score probes cell by cell: families and their grids, tuning, budgets and routes, and a log of what failed.

A cell is a named set of training rows. All cells and all values of the grid are fitted together (``operators/joint.py``): a
pass over the joined features serves every model, whatever their number. Predictions of all cells form one table, scored
together at the end; the driver holds parameters, moments and scores of cells, never rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farfield.operators import joint as J
from farfield.operators import metrics as M
from farfield.operators import probes as P
from farfield.operators.ranks import systematic_order
from farfield.sources.scratch import cut


@dataclass(frozen=True)
class Family:
    """A probe family: the values it may be tuned over, the one without tuning, and its limit of iterations."""

    name: str
    grid: tuple[float, ...]
    default: float
    max_iter: int

    def values(self, tuning: bool) -> tuple[float, ...]:
        return self.grid if tuning else (self.default,)


#: fixed values: penalty of the linear probe, weight decay of the network, neighbours
FAMILIES = {f.name: f for f in (Family("logistic", (0.01, 0.1, 1.0, 10.0, 100.0), 1.0, 200), Family("mlp", (1e-4, 1e-3, 1e-2, 1e-1, 1.0), 1e-3, 500), Family("knn", (5.0, 10.0, 20.0, 50.0, 100.0), 20.0, -1))}

#: a fit ends once a step gains no more than this of the mean loss; ten epochs of mini-batches that gain 1e-4 each end a network's
STILL = {"logistic": 1e-9, "mlp": 1e-3}

Predict = Callable[[DataFrame], DataFrame]


def family_of(name: str) -> Family:
    if name not in FAMILIES:
        raise ValueError(f"unknown probe family {name!r}; known: {sorted(FAMILIES)}")
    return FAMILIES[name]


def fit_family(train: DataFrame, label: str, key: str, x: str, family: str, value: float, seed: int) -> Predict:
    """A function that adds classes, probs and pred to rows: one probe of one value on all of ``train``."""
    kind = family_of(family)
    j = J.joint(train, train.select(F.lit("").alias("set"), key), label, key, x)
    if len(j.moments[0].classes) < 2:
        raise ValueError("a probe needs two classes")
    model = J.Model(0, value)
    if family != "knn":
        J.fit(j, [model], family, seed, kind.max_iter, still=STILL[family])
    return lambda df: J.predict(j, [model], df, family, x, carry=tuple(c for c in df.columns if c not in (key, x))).drop("model")


def balanced_accuracy(scored: DataFrame, label: str) -> float:
    """The mean recall over the classes that the truth has."""
    return _recalls(scored.withColumn("model", F.lit(0)), label).get(0, 0.0)


def _recalls(scored: DataFrame, label: str) -> dict[int, float]:
    """Balanced accuracy of each model."""
    per = scored.groupBy("model", label).agg(F.avg(F.when(F.col("pred") == F.col(label), 1.0).otherwise(0.0)).alias("recall"))
    return {r["model"]: r["value"] for r in per.groupBy("model").agg(F.avg("recall").alias("value")).collect()}


def fit_multiclass(train: DataFrame, validation: DataFrame | None, label: str, key: str, x: str = "x", family: str = "logistic", tuning: bool = False, tune_internal: bool = False, seed: int = 0) -> tuple[Predict, dict]:
    """(predict, facts) of one cell: the first value of the grid with the best balanced accuracy on the validation rows.

    Without validation rows, and with ``tune_internal``, a stratified fifth of at least 20 training rows takes their place, and
    the chosen value is fitted again on all; otherwise the default is used.
    """
    cells = _Cells(train, train.select(F.lit("").alias("cell"), key), label, key, x, "multiclass", family, validation, tuning, tune_internal, seed)
    if cells.failed:
        raise ValueError(cells.failed[""])
    found = cells.chosen[""]
    facts = {"probe_family": family, "probe_max_iter": FAMILIES[family].max_iter, "n_classes_train": len(cells.joint.moments[found.model.place].classes)}
    facts |= {"probe_value": found.model.value, "grid_size": found.grid, "tuned_on": found.source}
    return lambda df: J.predict(cells.joint, [found.model], df, family, x, carry=tuple(c for c in df.columns if c not in (key, x))).drop("model"), facts


FAILURES = "cell string, task string, probe_family string, seed int, reason string"
FACTS = "cell string, n_train long, probe_family string, probe_value double, tuned_on string, threshold double"


@dataclass
class Outcome:
    """Predictions of all cells (cell, sample_id, group, y_true, pred, ...), facts of the fits, and cells that failed."""

    predictions: DataFrame | None = None
    facts: list[tuple] = field(default_factory=list)
    failures: list[tuple] = field(default_factory=list)


@dataclass
class Chosen:
    model: J.Model
    source: str
    grid: int
    threshold: float | None = None


class _Cells:
    """The fitted probes of all cells: which value each cell takes, and for binary cells the threshold."""

    def __init__(self, features: DataFrame, members: DataFrame, label: str, key: str, x: str, task: str, family: str, validation: DataFrame | None, tuning: bool, tune_internal: bool, seed: int):
        kind = family_of(family)
        self.label, self.key, self.x, self.task, self.family, self.seed, self.max_iter = label, key, x, task, family, seed, kind.max_iter
        self.failed: dict[str, str] = {}
        self.chosen: dict[str, Chosen] = {}
        external = validation is not None and (validation.select(label).distinct().count() == 2 if task == "binary" else not validation.isEmpty())
        sets = members.select(F.struct(F.col("cell"), F.lit("all").alias("part")).alias("set"), key)
        split = not external and (tune_internal or task == "binary")
        if split:
            order = systematic_order(features.select(key, label).join(members, key), ["cell"], [label], seed, "internal", key, "__o")
            part = F.when(F.col("__o") % 5 == 0, "held").otherwise("fit")
            sets = sets.union(order.select(F.struct(F.col("cell"), part.alias("part")), key))
        self.joint = j = J.joint(features, cut(sets.select(F.concat_ws("\n", "set.part", "set.cell").alias("set"), key), "sets"), label, key, x)
        grid = kind.values(tuning)
        tuned: dict[str, tuple[str, list[J.Model]]] = {}
        for name in j.names:
            part, cell = name.split("\n", 1)
            if part != "all":
                continue
            moments = j.moments[j.place(name)]
            counts = moments.counts[moments.classes]
            if len(counts) < 2:
                self.failed[cell] = "a probe needs two classes"
            elif external:
                tuned[cell] = ("validation", [J.Model(j.place(name), v) for v in grid])
            elif split and moments.n >= 20 and (task != "binary" or counts.min() >= 4) and len(j.moments[j.place(f"fit\n{cell}")].classes) == len(counts) and (tune_internal and len(grid) > 1 or task == "binary"):
                tuned[cell] = ("internal", [J.Model(j.place(f"fit\n{cell}"), v) for v in (grid if tune_internal else (kind.default,))])
            else:
                self.chosen[cell] = Chosen(J.Model(j.place(name), kind.default), "train" if task == "binary" else "default", 1)
        candidates = [(cell, source, m) for cell, (source, models) in tuned.items() for m in models]
        self._fit([m for _, _, m in candidates])
        scored, best = self._tuning_scores(candidates, validation), {}
        for k, (cell, source, model) in enumerate(candidates):
            if cell not in best or scored.get(k, 0.0) > best[cell][0]:
                best[cell] = (scored.get(k, 0.0), k, source, model)
        thresholds = self._thresholds([b[1] for b in best.values()])
        again = []
        for cell, (_, k, source, model) in best.items():
            if source == "internal" and tune_internal:
                model = J.Model(j.place(f"all\n{cell}"), model.value)
                again.append(model)
            self.chosen[cell] = Chosen(model, source, len(tuned[cell][1]), thresholds.get(k))
        rest = [c for c in self.chosen.values() if c.source in ("train", "default")]
        self._fit(again + [c.model for c in rest])
        if task == "binary" and rest:
            own = J.predict(j, [c.model for c in rest], self._with_label(j.rows), family, among={k: c.model.place for k, c in enumerate(rest)}, carry=("y_true",))
            for k, threshold in self._cuts(own).items():
                rest[k].threshold = threshold
        for cell in [cell for cell, c in self.chosen.items() if c.model.broken]:
            self.failed[cell] = "the loss isn't finite"
            del self.chosen[cell]

    def _fit(self, models: list[J.Model]) -> None:
        if models and self.family != "knn":
            J.fit(self.joint, models, self.family, self.seed, self.max_iter, still=STILL[self.family])

    def _with_label(self, rows: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(c) for c in self.joint.classes])
        return rows.withColumn("y_true", F.element_at(names, F.col("y") + 1))

    def _tuning_scores(self, candidates: list, validation: DataFrame | None) -> dict[int, float]:
        """Of each candidate, balanced accuracy (AUC for binary cells) on the validation rows or the held-out part of its cell."""
        self.tables: list[tuple[list[int], DataFrame]] = []
        scores: dict[int, float] = {}
        for wanted in ("validation", "internal"):
            own = [k for k, (_, source, _) in enumerate(candidates) if source == wanted]
            if not own:
                continue
            models = [candidates[k][2] for k in own]
            if wanted == "validation":
                found = J.predict(self.joint, models, validation.withColumn("y_true", F.col(self.label)), self.family, self.x, carry=("y_true",))
            else:
                held = {k: self.joint.place("held\n" + candidates[i][0]) for k, i in enumerate(own)}
                found = J.predict(self.joint, models, self._with_label(self.joint.rows), self.family, among=held, carry=("y_true",))
            found = cut(found, "tuning")
            self.tables.append((own, found))
            if self.task == "binary":
                table = M.auc(P.binary_predictions(found, 0.5), ["model"]).collect()
                scores |= {own[r["model"]]: r["auc"] for r in table if r["auc"] is not None}
            else:
                scores |= {own[k]: v for k, v in _recalls(found, "y_true").items()}
        return scores

    def _cuts(self, found: DataFrame) -> dict[int, float]:
        return {r["model"]: float(r["threshold"]) for r in M.f1_thresholds(P.binary_predictions(found, 0.5), ["model"]).collect()}

    def _thresholds(self, wanted: list[int]) -> dict[int, float]:
        if self.task != "binary" or not wanted:
            return {}
        out: dict[int, float] = {}
        for own, found in self.tables:
            out |= {own[k]: v for k, v in self._cuts(found.where(F.col("model").isin([k for k, i in enumerate(own) if i in wanted]))).items()}
        return out


def run_cells(features: DataFrame, members: DataFrame, test: DataFrame, label: str, key: str, x: str = "x", group: str = "grp", task: str = "multiclass", family: str = "logistic", validation: DataFrame | None = None, tuning: bool = False, seed: int = 0, tune_internal: bool = True) -> Outcome:
    """Fits each cell of ``members`` (cell, key) and predicts ``test`` (key, x, label, group).

    ``cell`` names the route, the budget and all else that tells cells apart, so two routes of equal budget fail apart. A cell
    whose training rows have one class, or whose loss isn't finite, is logged and the others go on; errors of other kinds end
    the run. Values are chosen on ``validation``, or on a held-out fifth of the cell's own rows and then fitted on all of them.
    ``binary`` cells of every family take their threshold from the rows that the value was chosen on (classes 0 and 1);
    ``segmentation`` is multiclass over pixels.
    """
    if task not in ("binary", "multiclass", "segmentation"):
        raise ValueError(f"no task {task!r}")
    cells = _Cells(features, members, label, key, x, task, family, validation, tuning, tune_internal, seed)
    out = Outcome(failures=[(cell, task, family, seed, reason) for cell, reason in sorted(cells.failed.items())])
    chosen = sorted(cells.chosen.items())
    out.facts = [(cell, cells.joint.moments[cells.joint.place(f"all\n{cell}")].n, family, c.model.value, c.source, c.threshold) for cell, c in chosen]
    if chosen:
        rows = test.select(F.col(key), F.col(x), F.col(group).alias("group"), F.col(label).alias("y_true"))
        found = J.predict(cells.joint, [c.model for _, c in chosen], rows, family, x, carry=("group", "y_true"))
        facts = test.sparkSession.createDataFrame([(k, cell, c.threshold) for k, (cell, c) in enumerate(chosen)], "model int, cell string, threshold double")
        found = found.join(F.broadcast(facts), "model").withColumnRenamed(key, "sample_id")  # a row for each cell
        if task == "binary":
            p = F.element_at("probs", F.array_position("classes", F.lit(1)).cast("int"))
            found = found.withColumns({"prob": p, "pred_default": (p >= 0.5).cast("int"), "pred_calibrated": (p >= F.col("threshold")).cast("int")})
            columns = ["prob", "pred_default", "pred_calibrated"]
        else:
            columns = ["classes", "probs"]
        out.predictions = cut(found.select("cell", "sample_id", "group", "y_true", "pred", *columns), "predictions")
    return out


def score_cells(outcome: Outcome, task: str) -> DataFrame | None:
    """(cell, metrics): the scorecard of the task over all cells at once; None if every cell failed."""
    if outcome.predictions is None:
        return None
    if task == "binary":
        return M.binary_scorecard(outcome.predictions, ["cell"])
    return M.multiclass_scorecard(outcome.predictions, ["cell"])


def failure_log(spark, outcome: Outcome) -> DataFrame:
    return spark.createDataFrame(outcome.failures, FAILURES)


def fit_facts(spark, outcome: Outcome) -> DataFrame:
    return spark.createDataFrame(outcome.facts, FACTS)
