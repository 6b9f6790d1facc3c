"""Queries over prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farfield.functions.columns import TEN_BINS
from farfield.operators import metrics as M
from farfield.plans.fixtures import BINARY, MULTI, PIXELS, load, plain, rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = plain(sql)
        return f

    return register


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load(spark, sf_dir, MULTI)
    probs = F.array(*[F.col(f"p{i}") for i in range(8)])
    return raw.select("sample_id", "cell", "grp", "y_true", F.array(*map(F.lit, range(8))).alias("classes"), probs.alias("probs"), (F.array_position(probs, F.array_max(probs)) - 1).cast("int").alias("pred"))


_TOP = "greatest(" + ", ".join(f"p{i}" for i in range(8)) + ")"
_PRED = "case " + " ".join(f"when p{i} = {_TOP} then {i}" for i in range(8)) + " end"
_M = f"m0 as ({MULTI}), m as (select *, {_TOP} as p_top, {_PRED} as pred, case when y_true < 8 then 1 else 0 end as seen, case y_true {' '.join(f'when {i} then p{i}' for i in range(8))} else 0e0 end as p_true, {' + '.join(f'p{i} * p{i}' for i in range(8))} as squares from m0)"
_B = f"b as ({BINARY})"
_BIN = " + ".join(f"case when {{p}} >= {e!r}e0 then 1 else 0 end" for e in TEN_BINS)


def _ece(source: str, hit: str, p: str, by: str = "cell", where: str = "true") -> str:
    return f"(select {by}, sum(abs(h - c)) / sum(n) as ece from (select {by}, {_BIN.format(p=p)} as bin, sum(cast({hit} as double)) as h, sum({p}) as c, count(*) as n from {source} where {where} group by 1, 2) group by 1)"


_THRESHOLD = """lv as (select cell, prob, sum(y_true) as pos, count(*) as cnt from b group by 1, 2),
    rn as (select *, sum(pos) over (partition by cell order by prob desc) as tp, sum(cnt) over (partition by cell order by prob desc) as pp, sum(pos) over (partition by cell) as ap, sum(cnt) over (partition by cell) as an from lv),
    fs as (select *, cast(2 * tp as double) / (pp + ap) as f1 from rn),
    bt as (select cell, case when ap > 0 and ap < an and f1 > 0 then prob else 5e-1 end as threshold, f1 from (select *, row_number() over (partition by cell order by f1 desc, prob) as k from fs) where k = 1)"""


@query(f"with {_B}, {_THRESHOLD} select cell, round(threshold, 6) as threshold, round(f1, 6) as f1 from bt")
def g1_best_f1_threshold(spark, sf_dir):
    return rounded(M.f1_thresholds(load(spark, sf_dir, BINARY), ["cell"]))


@query(f"with {_B} select cell, round(ece, 6) as ece from {_ece('b', 'y_true', 'prob')}")
def g2_calibration_error(spark, sf_dir):
    return rounded(M.calibration_error(load(spark, sf_dir, BINARY), ["cell"]))


_AUC = """au as (select cell, (sum(pos * (less + (cnt + 1) / 2e0)) - sum(pos) * (sum(pos) + 1) / 2e0) / (sum(pos) * (sum(cnt) - sum(pos))) as auc from (
    select *, coalesce(sum(cnt) over (partition by cell order by prob rows between unbounded preceding and 1 preceding), 0) as less from lv) group by cell having sum(pos) > 0 and sum(pos) < sum(cnt))"""


def _f1(pred: str) -> str:
    return f"2e0 * sum(case when {pred} = 1 and y_true = 1 then 1 else 0 end) / (sum({pred}) + sum(y_true))"


def _bal(pred: str) -> str:
    return f"(sum(case when {pred} = 1 and y_true = 1 then 1e0 else 0e0 end) / sum(y_true) + sum(case when {pred} = 0 and y_true = 0 then 1e0 else 0e0 end) / sum(1 - y_true)) / 2e0"


@query(
    f"""with {_B}, {_THRESHOLD}, {_AUC},
    s as (select cell, count(*) as n_test, {_f1("pred_default")} as f1, {_bal("pred_default")} as balanced_accuracy, {_f1("pred_calibrated")} as calibrated_f1, {_bal("pred_calibrated")} as calibrated_balanced_accuracy,
        avg((prob - y_true) * (prob - y_true)) as brier, avg(-case when y_true = 1 then ln(least(greatest(prob, 1e-15), 1e0 - 1e-15)) else ln(1e0 - least(greatest(prob, 1e-15), 1e0 - 1e-15)) end) as nll, avg(cast(y_true as double)) as test_pos_rate from b group by cell)
    select s.cell, n_test, round(s.f1, 6) as f1, round(auc, 6) as auc, round(balanced_accuracy, 6) as balanced_accuracy, round(calibrated_f1, 6) as calibrated_f1, round(calibrated_balanced_accuracy, 6) as calibrated_balanced_accuracy,
        round(bt.f1, 6) as diagnostic_calibrated_f1_target_optimal, round(threshold, 6) as diagnostic_optimal_threshold_test, round(ece, 6) as ece, round(brier, 6) as brier, round(nll, 6) as nll, round(test_pos_rate, 6) as test_pos_rate
    from s join bt on s.cell = bt.cell join au on s.cell = au.cell join {_ece("b", "y_true", "prob")} e on s.cell = e.cell"""
)
def g3_binary_scorecard(spark, sf_dir):
    return rounded(M.binary_scorecard(load(spark, sf_dir, BINARY), ["cell"]))


@query(f"with {_B}, {_THRESHOLD}, {_AUC} select cell, round(auc, 6) as auc from au")
def g4_auc_midrank(spark, sf_dir):
    return rounded(M.auc(load(spark, sf_dir, BINARY), ["cell"]))


_CLASSES = """cf as (select cell, y_true as y, pred, count(*) as n from {src} group by 1, 2, 3),
    pc as (select coalesce(r.cell, c.cell) as cell, coalesce(r.label, c.label) as label, coalesce(rows, 0) as rows, coalesce(tp, 0) as tp, coalesce(cols, 0) as cols
        from (select cell, y as label, sum(n) as rows, sum(case when y = pred then n else 0 end) as tp from cf group by 1, 2) r
        full join (select cell, pred as label, sum(n) as cols from cf group by 1, 2) c on r.cell = c.cell and r.label = c.label)"""
_C = _CLASSES.replace("{src}", "m")


@query(
    f"""with {_M}, {_C}, m2 as (select * from m where seen = 1), {_CLASSES.replace("{src}", "m2").replace("cf ", "cg ").replace("from cf", "from cg").replace("pc as", "pd as")},
    a as (select cell, avg(2e0 * tp / (rows + cols)) as macro_f1, sum(2e0 * tp / (rows + cols) * rows) / sum(rows) as weighted_f1, avg(case when rows > 0 then cast(tp as double) / rows end) as balanced_accuracy, sum(cast(tp as double)) / sum(rows) as accuracy,
        sum(case when rows > 0 then 1 else 0 end) as n_classes_test, cast(max(rows) as double) / sum(rows) as majority_rate from pc group by cell),
    s as (select cell, avg(2e0 * tp / (rows + cols)) as shared_macro_f1, sum(2e0 * tp / (rows + cols) * rows) / sum(rows) as shared_weighted_f1, avg(case when rows > 0 then cast(tp as double) / rows end) as shared_balanced_accuracy, sum(cast(tp as double)) / sum(rows) as shared_accuracy from pd group by cell),
    u as (select cell, avg(1e0 - seen) as unseen_prevalence from m group by cell)
    select a.cell, round(macro_f1, 6) as macro_f1, round(weighted_f1, 6) as weighted_f1, round(balanced_accuracy, 6) as balanced_accuracy, round(accuracy, 6) as accuracy, cast(n_classes_test as bigint) as n_classes_test, round(majority_rate, 6) as majority_rate,
        round(unseen_prevalence, 6) as unseen_prevalence, round(shared_macro_f1, 6) as shared_macro_f1, round(shared_weighted_f1, 6) as shared_weighted_f1, round(shared_balanced_accuracy, 6) as shared_balanced_accuracy, round(shared_accuracy, 6) as shared_accuracy
    from a join u on a.cell = u.cell left join s on a.cell = s.cell"""
)
def g6_multiclass_scorecard(spark, sf_dir):
    return rounded(M.multiclass_scorecard(_multi(spark, sf_dir), ["cell"]))


@query(
    f"""with {_M}, w as (select * from m union all select * replace (cell + 10 as cell) from m where seen = 1 union all select * replace (cell + 20 as cell) from m where y_true < 4),
    x as (select cell, k, p, case when y_true = k then 1 else 0 end as hit from ({" union all ".join(f"select cell, y_true, {i} as k, p{i} as p from w" for i in range(8))})),
    lv as (select cell, k, p, sum(hit) as pos, count(*) as cnt from x group by 1, 2, 3),
    rk as (select *, coalesce(sum(cnt) over (partition by cell, k order by p rows between unbounded preceding and 1 preceding), 0) as less from lv),
    au as (select cell, k, case when sum(pos) > 0 and sum(pos) < sum(cnt) then (sum(pos * (less + (cnt + 1) / 2e0)) - sum(pos) * (sum(pos) + 1) / 2e0) / (sum(pos) * (sum(cnt) - sum(pos))) end as auc from rk group by 1, 2),
    u as (select cell, min(seen) as seen from w group by 1)
    select au.cell, round(case when count(auc) = count(*) and min(u.seen) = 1 then avg(auc) end, 6) as macro_auc from au join u on au.cell = u.cell group by 1"""
)
def g6_one_vs_rest_auc(spark, sf_dir):
    """Cells with unseen classes, the same with seen ones only, and with four classes: the first and last have no macro AUC."""
    rows = _multi(spark, sf_dir)
    cell = lambda d, k: d.withColumn("cell", F.col("cell") + k)
    return rounded(M.one_vs_rest_auc(rows.unionByName(cell(rows.where("y_true < 8"), 10)).unionByName(cell(rows.where("y_true < 4"), 20)), ["cell"]))


@query(
    f"""with {_M}, c as (select *, case when pred = y_true then 1 else 0 end as correct from m),
    s as (select cell, count(*) as n_test, sum(seen) as n_seen, avg(squares - 2 * p_true + 1) as union_brier, avg(case when seen = 1 then squares - 2 * p_true + 1 end) as shared_brier, avg(case when seen = 1 then -ln(least(greatest(p_true, 1e-15), 1e0)) end) as shared_nll, 1e0 - avg(cast(seen as double)) as unseen_prevalence from c group by cell)
    select s.cell, n_test, cast(n_seen as bigint) as n_seen, round(e.ece, 6) as ece, round(e.ece, 6) as top_label_ece_all, case when n_seen = n_test then round(shared_nll, 6) else cast('inf' as double) end as nll, round(union_brier, 6) as brier, round(union_brier, 6) as union_brier, round(h.ece, 6) as shared_ece, round(shared_nll, 6) as shared_nll, round(shared_brier, 6) as shared_brier, round(unseen_prevalence, 6) as unseen_prevalence
    from s join {_ece("c", "correct", "p_top")} e on s.cell = e.cell left join {_ece("c", "correct", "p_top", where="seen = 1")} h on s.cell = h.cell"""
)
def g7_multiclass_calibration(spark, sf_dir):
    return rounded(M.multiclass_calibration(_multi(spark, sf_dir), ["cell"]))


_P = f"px as ({PIXELS})"


@query(f"with {_P}, {_CLASSES.replace('{src}', 'px')} select cell, cast(label as int) as label, cast(tp as bigint) as tp, cast(rows as bigint) as rows, cast(cols as bigint) as cols, round(2e0 * tp / (rows + cols), 6) as f1, round(case when rows > 0 then cast(tp as double) / rows end, 6) as recall, round(case when rows > 0 then cast(tp as double) / (rows + cols - tp) end, 6) as iou from pc")
def g8_per_class_iou(spark, sf_dir):
    return rounded(M.class_scores(M.confusion(load(spark, sf_dir, PIXELS), ["cell"]), ["cell"]))


@query(f"with {_P}, {_CLASSES.replace('{src}', 'px')} select cell, round(avg(case when rows > 0 then cast(tp as double) / (rows + cols - tp) end), 6) as miou, round(sum(cast(tp as double)) / sum(rows), 6) as pixel_accuracy, round(avg(2e0 * tp / (rows + cols)), 6) as macro_f1, round(sum(2e0 * tp / (rows + cols) * rows) / sum(rows), 6) as weighted_f1 from pc group by cell")
def g9_segmentation_scores(spark, sf_dir):
    return rounded(M.segmentation_scores(M.confusion(load(spark, sf_dir, PIXELS), ["cell"]), ["cell"]))


@query(
    f"""with {_P}, cf as (select cell, tile, y_true as y, pred, count(*) as n from px group by 1, 2, 3, 4),
    r as (select cell, tile, y as label, sum(n) as rows, sum(case when y = pred then n else 0 end) as tp from cf group by 1, 2, 3),
    c as (select cell, tile, pred as label, sum(n) as cols from cf group by 1, 2, 3),
    t as (select r.cell, r.tile, avg(cast(tp as double) / (rows + coalesce(cols, 0) - tp)) as miou from r left join c on r.cell = c.cell and r.tile = c.tile and r.label = c.label group by 1, 2)
    select cell, round(avg(miou), 6) as tile_miou_mean, round(min(miou), 6) as tile_miou_worst, count(*) as n_tiles from t group by cell"""
)
def g10_tile_miou(spark, sf_dir):
    return rounded(M.tile_scores(load(spark, sf_dir, PIXELS), ["cell"], ["tile"]))


@query(f"with {_P} select pred as label, 'pred' as \"column\", count(*) as n from px where pred > 2 group by 1")
def g11_unknown_labels(spark, sf_dir):
    pixels = load(spark, sf_dir, PIXELS)
    known = pixels.select(F.col("y_true").alias("label")).distinct()
    return M.unknown_labels(pixels, known, ["y_true", "pred"])


_GROUP_SCORES = f"gs as (select cell, grp, coalesce({_f1('pred_calibrated')}, 0e0) as calibrated_f1, avg((prob - y_true) * (prob - y_true)) as brier, avg(cast(y_true as double)) as test_pos_rate from b group by 1, 2)"


@query(
    f"""with {_B}, gs as (select cell, grp, case when sum(pred_calibrated) + sum(y_true) > 0 then {_f1("pred_calibrated")} else 0e0 end as calibrated_f1, avg((prob - y_true) * (prob - y_true)) as brier from b group by 1, 2),
    lg as (select cell, grp, 'calibrated_f1' as metric, calibrated_f1 as value from gs union all select cell, grp, 'brier', brier from gs),
    rk as (select *, row_number() over (partition by cell, metric order by round(value, 12), grp) as k, count(*) over (partition by cell, metric) as n_groups from lg)
    select cell, metric, round(value, 6) as worst, grp as worst_group, n_groups from rk where k = 1"""
)
def g12_worst_group(spark, sf_dir):
    scores = M.binary_scorecard(load(spark, sf_dir, BINARY), ["cell", "grp"])
    scores = scores.withColumns({m: F.round(m, 12) for m in ("calibrated_f1", "brier")})
    return rounded(M.worst_groups(scores, ["cell"], "grp", ["calibrated_f1", "brier"]))


_RC = """lv as (select cell, p_top as confidence, sum(1 - correct) as err, count(*) as cnt from c group by 1, 2),
    rc as (select cell, confidence, cast(sum(cnt) over (partition by cell order by confidence desc) as double) / sum(cnt) over (partition by cell) as coverage, cast(sum(err) over (partition by cell order by confidence desc) as double) / sum(cnt) over (partition by cell order by confidence desc) as risk from lv)"""
_CORRECT = f"{_M}, c as (select *, case when pred = y_true then 1 else 0 end as correct from m)"


def _selective(spark, sf_dir):
    rows = M.multiclass_rows(_multi(spark, sf_dir))
    return rows.select("cell", "sample_id", "correct", F.col("p_top").alias("confidence"))


@query(f"with {_CORRECT}, {_RC} select cell, round(confidence, 6) as confidence, round(coverage, 6) as coverage, round(risk, 6) as risk from rc")
def h17_risk_coverage(spark, sf_dir):
    return rounded(M.risk_coverage(_selective(spark, sf_dir), ["cell"]))


_AREA = "ar as (select cell, sum((coverage - pc) * (risk + pr) / 2) / (max(coverage) - min(coverage)) as aurc from (select *, lag(coverage) over (partition by cell order by coverage) as pc, lag(risk) over (partition by cell order by coverage) as pr from rc) group by cell)"


@query(f"with {_CORRECT}, {_RC}, {_AREA} select cell, round(aurc, 6) as aurc from ar")
def h18_aurc(spark, sf_dir):
    return rounded(M.curve_area(M.risk_coverage(_selective(spark, sf_dir), ["cell"]), ["cell"]))


_GRID = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0)


@query(
    f"""with {_CORRECT}, {_RC}, {_AREA}, ba as (select cell, count(*) as n, 1e0 - avg(cast(correct as double)) as base_error from c group by cell),
    rg as (select cell, {", ".join(f"arg_max(risk, coverage) filter (where coverage <= {g + 1e-12!r}e0) as risk_at_{round(g * 100)}" for g in _GRID)} from rc group by cell)
    select ba.cell, n, 0 as n_skipped, round(base_error, 6) as base_error, round(aurc, 6) as aurc, {", ".join(f"round(risk_at_{round(g * 100)}, 6) as risk_at_{round(g * 100)}" for g in _GRID)} from ba join ar on ba.cell = ar.cell join rg on ba.cell = rg.cell"""
)
def h20_selective_summary(spark, sf_dir):
    return rounded(M.selective_summary(_selective(spark, sf_dir), ["cell"]).withColumn("n_skipped", F.col("n_skipped").cast("int")))


@query(
    f"""with {_M} select cell, {", ".join(f"round(avg(-ln(least(greatest(p_true, {e!r}), 1e0))), 6) as nll_eps_{f'{e:g}'.replace('-', 'm')}" for e in (1e-6, 1e-9, 1e-12, 1e-15))}, round(avg(squares - case when seen = 1 then 2 * p_true - 1 else 0e0 end), 6) as old_brier from m group by cell"""
)
def h15_rescoring(spark, sf_dir):
    found = M.rescored(_multi(spark, sf_dir), ["cell"])
    return rounded(found.select("cell", *[c for c in found.columns if c.startswith("nll_eps")], "old_brier"))


@query("select * from (values ('0', 'shared_nll'), ('1', 'missing_old'), ('2', 'n_test'), ('9', 'missing_new')) as t(cell, problems)")
def h16_rescore_validation(spark, sf_dir):
    """Planted in the old scores: a metric that is off, a cell left out, a row count that is off, a cell that isn't there now."""
    rows = _multi(spark, sf_dir)
    new, old = M.rescored(rows, ["cell"]), M.multiclass_calibration(rows.repartition(3, "grp"), ["cell"])
    old = old.withColumns({"shared_nll": F.col("shared_nll") + F.when(F.col("cell") == 0, 0.1).otherwise(0.0), "n_test": F.col("n_test") + F.when(F.col("cell") == 2, 1).otherwise(0)})
    old = old.where("cell != 1").union(old.where("cell = 3").withColumn("cell", F.lit(9).cast(old.schema["cell"].dataType)))
    problems = M.rescore_problems(new, old, ["cell"], {"shared_nll": "shared_nll", "union_brier": "brier"})
    return problems.select(F.col("cell").cast("string").alias("cell"), F.array_join("problems", ",").alias("problems"))
