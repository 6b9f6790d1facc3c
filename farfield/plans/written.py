"""Queries over files: given tables are written to the shared folder in the shape that a source reads, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from farfield.operators import analytics as A
from farfield.operators import budgets as B
from farfield.operators import catalogue as K
from farfield.operators import probes as P
from farfield.operators import spatial as G
from farfield.plans.fixtures import ACQUISITIONS, BINARY, SAMPLES, load, plain, rounded
from farfield.sources import commits, files
from farfield.sources.scratch import shared_folder
from farfield.streaming import incremental as I
from farfield.streaming import newest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = plain(sql)
        return f

    return register


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_LABELS = """select c_custkey as index, case when c_nationkey % 3 = 0 then 'togo' else 'kenya' end as dataset, cast(c_custkey % 2 as int) as is_crop, case when c_custkey % 10 > 0 then cast(c_custkey % 90 as double) end as lat, cast(c_custkey % 170 as double) as lon,
    case when c_custkey % 7 > 0 then concat(cast(2015 + c_custkey % 6 as {s}), case when c_custkey % 4 < 2 then '-02-01' else '-11-30' end) end as export_end_date, c_nationkey from {customer}"""


@query(f"with l as ({_LABELS.replace('{s}', 'varchar')}) select index, dataset, is_crop, coalesce(lat, 'nan'::double) as lat, lon, cast(coalesce(year(cast(export_end_date as date) - interval 183 day), 0) as int) as window_year from l")
def a1_geojson_labels(spark, sf_dir):
    """A feature collection for each nation, a document a file."""
    rows = load(spark, sf_dir, _LABELS.replace("{s}", "string"))
    feature = F.struct(F.struct("index", "dataset", "is_crop", "lat", "lon", "export_end_date").alias("properties"))
    path = _folder(spark, "geojson")
    rows.groupBy("c_nationkey").agg(F.collect_list(feature).alias("features")).drop("c_nationkey").write.option("maxRecordsPerFile", 1).json(path)
    return files.geojson_labels(spark, path)


@query("select case c_custkey % 10 when 8 then 'val' when 9 then 'test' else 'train' end as role, concat('s', cast(c_custkey as varchar)) as sample_id from {customer}")
def a7_release_splits(spark, sf_dir):
    """Lists of ids by role, a document for each nation."""
    rows = load(spark, sf_dir, "select c_nationkey, concat('s', cast(c_custkey as string)) as sample_id, c_custkey % 10 as k from {customer}")
    ids = lambda condition: F.collect_list(F.when(F.expr(condition), F.col("sample_id")))
    path = _folder(spark, "release")
    rows.groupBy("c_nationkey").agg(ids("k < 8").alias("train"), ids("k = 8").alias("val"), ids("k = 9").alias("test")).drop("c_nationkey").write.option("maxRecordsPerFile", 1).json(path)
    return files.release_splits(spark, path)


_ORDERS = "select o_orderkey, o_orderstatus, o_totalprice from {orders}"
_ORDER_FIELDS = "o_orderkey long, o_orderstatus string, o_totalprice double"


@query(_ORDERS)
def a8_torn_lines(spark, sf_dir):
    """Lines of many writers, one of which was cut off: its last line is left out."""
    rows, path = load(spark, sf_dir, _ORDERS), _folder(spark, "torn")
    rows.write.json(path)
    rows.limit(1).select(F.concat(F.to_json(F.struct("*")), F.lit("\n{\"o_orderkey\": 1, \"o_ord"))).write.mode("append").text(path)
    whole = files.torn_lines(spark, path, _ORDER_FIELDS)
    return whole.groupBy(*whole.columns).count().select(*whole.columns)


@query(_ORDERS)
def a9_strict_lines(spark, sf_dir):
    path = _folder(spark, "strict")
    load(spark, sf_dir, _ORDERS).write.json(path)
    return files.strict_lines(spark, path, _ORDER_FIELDS)


_LINES = "select l_orderkey, l_linenumber, l_quantity, l_returnflag from {lineitem}"


@query(f"{_LINES} where l_returnflag <> 'N'")
def a10_atomic_cells(spark, sf_dir):
    """Three cells are staged; the writer of one is lost before its line in the manifest, that of another tries twice."""
    rows, path = load(spark, sf_dir, _LINES), _folder(spark, "cells")
    part = lambda flag: rows.where(F.col("l_returnflag") == flag).drop("l_returnflag")
    commits.append_cell(part("A"), path, {"l_returnflag": "A"})
    commits.stage(part("N"), path, {"l_returnflag": "N"})
    for _ in range(2):
        commits.append_cell(part("R"), path, {"l_returnflag": "R"})
    return commits.committed(spark, path)


_ASSIGNED = "select cast(c_custkey as {s}) as stable_id, case c_custkey % 5 when 0 then '' when 1 then 'target_test' else 'source_train' end as partition, case when c_custkey % 5 = 0 then 'purged' else 'assigned' end as status, c_mktsegment as domain, case when c_custkey % 5 = 0 then 'near_ood' else '' end as reason from {customer}"


@query(_ASSIGNED.replace("{s}", "varchar"))
def a13_checked_csv(spark, sf_dir):
    rows, path = load(spark, sf_dir, _ASSIGNED.replace("{s}", "string")), _folder(spark, "assignments")
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    back = files.checked_csv(spark, path, files.ASSIGNMENTS)
    return back.fillna("", ["partition", "reason"])


@query("select sum(length) > 0 as has_bytes, count(*) as n from (select c_nationkey, 1 as length from {customer} group by 1)")
def a16_folder_digest(spark, sf_dir):
    """The digest of a folder of a file for each nation is that of its copy, and not that of a copy with a file less."""
    rows = load(spark, sf_dir, "select c_nationkey, cast(c_custkey as string) as line from {customer}")
    texts = rows.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("t")).withColumn("name", F.format_string("n%02d", "c_nationkey"))
    digests = texts.select(F.concat(F.lit("/x/top/"), "name").alias("path"), F.length("t").cast("long").alias("length"), F.sha2("t", 256).alias("sha256"))
    one, two, less = (files.folder_digest(d, "top") for d in (digests, digests.repartition(3), digests.where("path <> '/x/top/n00'")))
    same = one.join(two, ["sha256", "n"]).join(less.select(F.col("sha256").alias("other")), F.col("other") != F.col("sha256"))
    return same.select((F.length("sha256") == 64).alias("has_bytes"), "n")


_RUNS = "select o_orderkey, o_totalprice, case o_orderkey % 3 when 0 then 'raw' when 1 then 'presto' else 'galileo' end as model, case when o_custkey % 2 = 0 then 'pastis' else 'breizhcrops' end as benchmark from {orders}"


@query(_RUNS)
def a18_runs(spark, sf_dir):
    """Results in a folder for each model and benchmark, both read from the path."""
    path = _folder(spark, "runs")
    load(spark, sf_dir, _RUNS).withColumns({"m": F.col("model"), "b": F.col("benchmark")}).drop("model", "benchmark").write.partitionBy("m", "b").json(path)
    return files.runs(spark, f"{path}/*/*/*.json", r"m=([^/]+)/b=([^/]+)/[^/]+$").select("o_orderkey", "o_totalprice", "model", "benchmark")


_MODAL = f"select sample_id, case when b4 < 25 then 's2' else 's1' end as modality, count(*) as n from ({ACQUISITIONS}) a group by 1, 2"


@query(f"with m as ({_MODAL}) select sample_id, n, 0e0 as lat, 0e0 as lon from m where modality = 's2'")
def b19_optical_only(spark, sf_dir):
    series, samples = K.optical_only(load(spark, sf_dir, _MODAL), load(spark, sf_dir, SAMPLES))
    return series.join(samples.select("sample_id", "lat", "lon"), "sample_id").select("sample_id", "n", "lat", "lon")


@query("select vec_id, 'logistic' as method, 1e0 as value, 'none' as tuned_on from {embeddings}")
def b28_constant_columns(spark, sf_dir):
    return K.with_constants(load(spark, sf_dir, "select vec_id from {embeddings}"), method="logistic", value=1.0, tuned_on="none")


@query("with p as (select p_partkey as patch, concat('T', cast(p_size % 6 as varchar)) as tile from {part}), t as (select distinct tile as holdout from p) select holdout, patch, case when tile = holdout then 'target' else 'source' end as role from p cross join t where not (tile <> holdout and patch % 2 = 0 and ((holdout = 'T0' and tile = 'T1') or (holdout = 'T1' and tile = 'T0')))")
def d11_dense_leave_one_out(spark, sf_dir):
    """Tiles a few degrees apart, but for two whose even patches lie within two kilometres of each other."""
    rows = load(spark, sf_dir, "select p_partkey as patch, p_size % 6 as k from {part}")
    near = (F.col("k") < 2) & (F.col("patch") % 2 == 0)
    lat = F.when(near, F.lit(45.0) + F.col("k") * 0.01).otherwise(F.lit(45.0) + F.col("k") * 2 + 1)
    patches = rows.select("patch", F.concat(F.lit("T"), F.col("k").cast("string")).alias("tile"), lat.alias("lat"), F.lit(3.0).alias("lon"))
    return K.dense_leave_one_out(patches, "patch", "tile", 2.0)[0].select("holdout", "patch", "role")


@query(f"select sample_id, lat, lon from ({SAMPLES})")
def d16_finite_coordinates(spark, sf_dir):
    return G.require_finite(load(spark, sf_dir, SAMPLES)).select("sample_id", "lat", "lon")


_DECLARED = "select n_name as holdout, k as seed from {nation} cross join (select 0 as k union all select 1 union all select 2) s"
_RAN = "select n.n_name as holdout, cast(c_custkey % 3 as int) as seed from {customer} join {nation} n on c_nationkey = n_nationkey where c_custkey % 3 <= n_nationkey % 3"


@query(f"select d.holdout, d.seed, 'regime_not_run' as kind from ({_DECLARED}) d anti join ({_RAN}) r on d.holdout = r.holdout and d.seed = r.seed")
def d30_regime_ledger(spark, sf_dir):
    return K.regime_ledger(load(spark, sf_dir, _DECLARED), load(spark, sf_dir, _RAN), ["holdout", "seed"])


@query(f"select d.holdout, d.seed from ({_DECLARED}) d anti join ({_RAN}) r on d.holdout = r.holdout and d.seed = r.seed")
def h25_open_cells(spark, sf_dir):
    return A.remaining(load(spark, sf_dir, _DECLARED), load(spark, sf_dir, _RAN), ["holdout", "seed"])


@query("with o as (select c_custkey as key, c_mktsegment as value from {customer} where c_custkey % 11 > 0), n as (select c_custkey as key, case when c_custkey % 10 = 0 then 'OTHER' else c_mktsegment end as value from {customer} where c_custkey % 13 > 0) select cast(coalesce(o.key, n.key) as varchar) as key, o.value as old, n.value as new from o full join n on o.key = n.key where o.value is distinct from n.value")
def h28_changed_entries(spark, sf_dir):
    """Entries that changed, that only the old manifest has, and that only the new one has."""
    rows = load(spark, sf_dir, "select c_custkey, cast(c_custkey as string) as key, c_mktsegment as value from {customer}")
    new = rows.where("c_custkey % 13 > 0").withColumn("value", F.when(F.col("c_custkey") % 10 == 0, "OTHER").otherwise(F.col("value")))
    return A.manifest_difference(rows.where("c_custkey % 11 > 0").drop("c_custkey"), new.drop("c_custkey"))


@query("with c as (select c_mktsegment as m, count(*) as n from {customer} where c_custkey % 3 = 0 group by 1) select (select count(*) from {customer}) as n_before, (select count(*) from {customer} where c_custkey % 3 = 0) as n_after, string_agg(m || ':' || n, ';' order by m) as per_class from c")
def e5_cap_description(spark, sf_dir):
    rows = load(spark, sf_dir, "select c_custkey, c_mktsegment from {customer}")
    return B.cap_description(rows, rows.where("c_custkey % 3 = 0"), "c_mktsegment")


@query(f"with b as ({BINARY}) select sample_id, grp as \"group\", y_true, cast(prob >= 5e-1 as int) as pred, round(greatest(prob, 1 - prob), 6) as prob_pred, round(case when y_true = 1 then prob else 1 - prob end, 6) as prob_true, round(1 - prob, 6) as p0, round(prob, 6) as p1 from b")
def f10_prediction_rows(spark, sf_dir):
    """The columns of prediction rows, with the probability of each class."""
    rows = load(spark, sf_dir, BINARY)
    predicted = rows.select("sample_id", "grp", "y_true", F.array(F.lit(0), F.lit(1)).alias("classes"), F.array(1 - F.col("prob"), F.col("prob")).alias("probs"), F.when(F.col("prob") >= 0.5, 1).otherwise(0).alias("pred"))
    out = P.prediction_rows(predicted, {"method": "erm"}, "sample_id", "y_true", "grp")
    return rounded(out.select("sample_id", "group", "y_true", "pred", "prob_pred", "prob_true", F.col("probs")[0].alias("p0"), F.col("probs")[1].alias("p1")))


_BIN = " + ".join(f"case when prob >= {k * 0.1!r}e0 then 1 else 0 end" for k in range(1, 10))
_CORRECTED = f"select cell, sample_id, y_true, case when sample_id % 3 = 0 then 1 - prob else prob end as prob from ({BINARY})"


@query(f"with b as ({_CORRECTED}), x as (select cell, {_BIN} as bin, count(*) as n, sum(cast(y_true as double)) as h, sum(prob) as c, sum((prob - y_true) * (prob - y_true)) as q from b group by 1, 2) select cell, cast(sum(n) as bigint) as n, round(sum(abs(h - c)) / sum(n), 6) as ece, round(sum(q) / sum(n), 6) as brier, round(sum(h) / sum(n), 6) as test_pos_rate from x group by 1")
def j2_newest_predictions(spark, sf_dir):
    """A third of the predictions is corrected later, and old ones are appended again: the newest count."""
    rows = load(spark, sf_dir, BINARY).select("cell", "sample_id", F.lit(1).cast("long").alias("version"), "y_true", "prob")
    corrected = rows.where("sample_id % 3 = 0").withColumns({"version": F.lit(2).cast("long"), "prob": 1 - F.col("prob")})
    source, path = _folder(spark, "arriving"), _folder(spark, "changes")
    for part in (rows, corrected, rows.where("sample_id % 2 = 0")):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = I.prediction_stream(spark, source, ", ".join(f"{n} {k}" for n, k in rows.dtypes), 1)
    newest.follow(stream, path, _folder(spark, "checkpoint"), ["cell"], "sample_id", "version")
    return rounded(newest.scores(spark, path, ["cell"]))


@query("select n_name as holdout from {nation} where n_nationkey % 5 > 1")
def j4_open_cells(spark, sf_dir):
    """What a restart still has to do: planned cells less those that were committed."""
    rows, path = load(spark, sf_dir, "select n_name as holdout, n_nationkey from {nation}"), _folder(spark, "resumed")
    planned = rows.select("holdout")
    done = [r[0] for r in rows.where("n_nationkey % 5 <= 1").select("holdout").collect()]
    for name in done:
        attempt, n = commits.stage(rows.where(F.col("holdout") == name).drop("holdout"), path, {"holdout": name})
        commits.commit(spark, path, {"holdout": name}, attempt, n)
    return commits.open_cells(planned, spark, path, ["holdout"])
