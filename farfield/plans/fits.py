"""Queries that fit probes or follow streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farfield.operators import cells as X
from farfield.operators import metrics as M
from farfield.operators import probes as P
from farfield.plans.fixtures import BINARY, PIXELS, load, plain, rounded
from farfield.sources.scratch import shared_folder
from farfield.streaming import incremental as I

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = plain(sql)
        return f

    return register


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, sf_dir, "select vec_id, label, vec_id % 5 as grp, embedding as x from {embeddings}")
    return rows.where("vec_id % 5 != 0"), rows.where("vec_id % 5 = 0")


@query("with c as (select label, count(*) as c from {embeddings} group by 1), f as (select sum(c) as n, count(*) as k from c) select label, c as n, round(n / (k * cast(c as double)), 6) as weight from c, f")
def f4_balance_weights(spark, sf_dir):
    rows = P.balance_weights(load(spark, sf_dir, "select label from {embeddings}"), "label")
    return rounded(rows.groupBy("label").agg(F.count("*").alias("n"), F.max("weight").alias("weight")))


@query("with v as (select unnest(embedding) as v, unnest(range(len(embedding))) as d from {embeddings}) select cast(d as int) as d, round(avg(cast(v as double)), 5) as mean, round(stddev_pop(cast(v as double)), 5) as std from v group by 1")
def f1_standardiser(spark, sf_dir):
    moments = P.standardiser(load(spark, sf_dir, "select embedding as x from {embeddings}"), "x")
    return rounded(moments.select(F.posexplode(F.arrays_zip("means", "stds")).alias("d", "z")).select("d", F.col("z.means").alias("mean"), F.col("z.stds").alias("std")), 5)


@query()
def f1_logistic_probe(spark, sf_dir):
    train, test = _features(spark, sf_dir)
    out = P.fit(train, "label").predict(test)
    return P.prediction_rows(out, {"probe_family": "logistic"}, "vec_id", "label", "grp")


#: the votes of the k nearest training rows of each cell for each asked row; {members}: (cell, vec_id), {asked}: a condition, {ks}: (k)
_VOTES = """mem as ({members}), tr as (select cell, e.* from mem join {embeddings} e on e.vec_id = mem.vec_id),
    mo as (select cell, d, avg(v) as m, stddev_pop(v) as s from (select cell, unnest(embedding)::double as v, unnest(range(len(embedding))) as d from tr) group by 1, 2),
    mm as (select cell, list(m order by d) as ms, list(case when s > 0 then s else 1 end order by d) as ss from mo group by 1),
    za as (select cell, vec_id, label, list_transform(range(1, len(ms) + 1), lambda i: (embedding[i]::double - ms[i]) / ss[i]) as z from tr join mm using (cell)),
    zb as (select cell, vec_id, label, list_transform(range(1, len(ms) + 1), lambda i: (embedding[i]::double - ms[i]) / ss[i]) as z from {embeddings}, mm where {asked}),
    near as (select b.cell, b.vec_id, b.label as truth, a.label, greatest(1 - list_cosine_similarity(a.z, b.z), 1e-15) as dist, row_number() over (partition by b.cell, b.vec_id order by list_cosine_similarity(a.z, b.z) desc) as place from zb b join za a using (cell)),
    kk as ({ks}), votes as (select cell, vec_id, truth, k, label, sum(1 / dist) as w from near, kk where place <= k group by 1, 2, 3, 4, 5),
    share as (select *, w / sum(w) over (partition by cell, vec_id, k) as p, row_number() over (partition by cell, vec_id, k order by w desc, label) as best from votes)"""


def _votes(members: str, asked: str, ks: str) -> str:
    return _VOTES.replace("{members}", members).replace("{asked}", asked).replace("{ks}", ks)


_CELLS = "select 'source_full' as cell, vec_id from {embeddings} where vec_id % 5 <> 0 union all select 'allocation@50', vec_id from {embeddings} where vec_id % 5 <> 0 and vec_id % 2 = 0"


@query(f"with {_votes('select 1 as cell, vec_id from {embeddings} where vec_id % 5 <> 0', 'vec_id % 5 = 0', 'select 20 as k')} select vec_id, label, round(p, 6) as prob, cast(best = 1 as int) as is_pred from share")
def f3_neighbour_probe(spark, sf_dir):
    train, test = _features(spark, sf_dir)
    out = P.neighbours(train, test, "label", "vec_id").select("vec_id", "pred", F.explode(F.arrays_zip("classes", "probs")).alias("z"))
    return rounded(out.where("z.probs > 0").select("vec_id", F.col("z.classes").alias("label"), F.col("z.probs").alias("prob"), F.when(F.col("z.classes") == F.col("pred"), 1).otherwise(0).alias("is_pred")))


@query(f"with {_votes(_CELLS, 'vec_id % 5 = 0', 'select 20 as k')} select cell, vec_id as sample_id, label as pred from share where best = 1")
def f8_neighbour_cells(spark, sf_dir):
    """Two cells by one search; each standardises and votes by its own members."""
    _, out = cell_run(spark, sf_dir, "multiclass", "knn")
    return out.predictions.select("cell", "sample_id", F.col("pred").cast("int").alias("pred"))


@query(
    f"""with {_votes("select 1 as cell, vec_id from {embeddings} where vec_id % 5 > 1", "vec_id % 5 < 2", "select unnest([5, 10, 20, 50, 100]) as k")},
    recall as (select k, truth, avg(cast(label = truth as int)) as r from share where best = 1 and vec_id % 5 = 1 group by 1, 2),
    chosen as (select k from recall group by 1 order by round(avg(r), 9) desc, k limit 1)
    select vec_id, cast(k as double) as probe_value, label as pred from share where best = 1 and vec_id % 5 = 0 and k = (select k from chosen)"""
)
def f6_tuned_neighbours(spark, sf_dir):
    """The number of neighbours is chosen on validation rows: votes of 5 to 100 are prefixes of one search."""
    rows = load(spark, sf_dir, "select vec_id, label, embedding as x from {embeddings}")
    train, held, test = rows.where("vec_id % 5 > 1"), rows.where("vec_id % 5 = 1"), rows.where("vec_id % 5 = 0")
    predict, facts = X.fit_multiclass(train, held, "label", "vec_id", family="knn", tuning=True)
    return predict(test).select("vec_id", F.lit(facts["probe_value"]).alias("probe_value"), F.col("pred").cast("int").alias("pred"))


@query()
def f2_network_probe(spark, sf_dir):
    """Two rectified layers with weight decay and class weights, trained by gradients that tasks add up."""
    train, test = _features(spark, sf_dir)
    return X.fit_family(train, "label", "vec_id", "x", "mlp", 1e-3, 0)(test)


def cell_run(spark, sf_dir, task: str, family: str):
    rows = load(spark, sf_dir, "select vec_id, label, cast(vec_id % 5 as int) as grp, embedding as x from {embeddings}")
    if task == "binary":
        rows = rows.withColumn("label", F.when(F.col("label") < 5, 1).otherwise(0))
    train, test = rows.where("vec_id % 5 != 0"), rows.where("vec_id % 5 = 0")
    one = F.col("label") == (1 if task == "binary" else 0)
    members = train.select(F.lit("source_full").alias("cell"), "vec_id").union(train.where("vec_id % 2 = 0").select(F.lit("allocation@50"), "vec_id")).union(train.where(one).select(F.lit("one_class@50"), "vec_id"))
    return test, X.run_cells(rows, members, test, "label", "vec_id", task=task, family=family)


@query()
def f5_calibrated_probe(spark, sf_dir):
    train, test = _features(spark, sf_dir)
    binary = lambda d: d.withColumn("y", F.when(F.col("label") < 5, 1).otherwise(0))
    probe, threshold, source = P.calibrated(binary(train), None, "y", "vec_id")
    scored = P.binary_predictions(probe.predict(binary(test)), threshold).withColumns({"y_true": F.col("y"), "source": F.lit(source)})
    return M.binary_scorecard(scored, ["source"])


def _arriving(spark: SparkSession, df: DataFrame) -> tuple[str, str]:
    """``df`` as the files of a folder that a stream reads."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, ", ".join(f"{n} {k}" for n, k in df.dtypes)


_BIN = " + ".join(f"case when prob >= {k * 0.1!r}e0 then 1 else 0 end" for k in range(1, 10))


@query(f"with b as ({BINARY}), x as (select cell, {_BIN} as bin, count(*) as n, sum(cast(y_true as double)) as h, sum(prob) as c, sum((prob - y_true) * (prob - y_true)) as q from b group by 1, 2) select cell, cast(sum(n) as bigint) as n, round(sum(abs(h - c)) / sum(n), 6) as ece, round(sum(q) / sum(n), 6) as brier, round(sum(h) / sum(n), 6) as test_pos_rate from x group by 1")
def j1_incremental_calibration(spark, sf_dir):
    """Predictions arrive twice, as after a restart; repeats are dropped and the sums followed as a stream."""
    rows = load(spark, sf_dir, BINARY).select("cell", "sample_id", "y_true", "prob")
    path, schema = _arriving(spark, rows.union(rows))
    stream = I.without_repeats(I.prediction_stream(spark, path, schema), ["cell"], "sample_id")
    sums = I.drained(I.calibration_sums(stream, ["cell"]), f"calibration_{uuid.uuid4().hex}")
    return rounded(I.calibration_scores(sums, ["cell"]))


@query(f"select cell, tile, y_true as y, pred, count(*) as n from ({PIXELS}) group by 1, 2, 3, 4")
def j3_incremental_confusion(spark, sf_dir):
    path, schema = _arriving(spark, load(spark, sf_dir, PIXELS).select("cell", "tile", "y_true", "pred"))
    stream = I.prediction_stream(spark, path, schema)
    return I.drained(I.confusion_stream(stream, ["cell"], ["tile"]), f"confusion_{uuid.uuid4().hex}")
