"""Queries for dense patches and tiles, policies, roles and seeds, and for probes fitted cell by cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from farfield.operators import cells as X
from farfield.operators import dense as D
from farfield.operators import figures as G
from farfield.operators import policies as P
from farfield.operators import splits as S
from farfield.plans.fits import cell_run
from farfield.plans.fixtures import load, plain, rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = plain(sql)
        return f

    return register


#: patches are orders; two of three have a file
_PATCHES = "select o_orderkey as patch, cast(o_orderkey % 5 as int) + 1 as fold from {orders}"


@query(f"with p as ({_PATCHES}) select patch, case when patch % 3 = 0 then 'skipped' else 'present' end as status from p where fold in (1, 2, 4)")
def a2_patch_files(spark, sf_dir):
    files = load(spark, sf_dir, "select concat('/data/fold/S2_', cast(o_orderkey as string), '.npy') as path from {orders} where o_orderkey % 3 <> 0")
    have, gone = D.present_patches(load(spark, sf_dir, _PATCHES), files, "patch", F.concat(F.lit("S2_"), F.col("patch").cast("string"), F.lit(".npy")), [1, 2, 4])
    return have.select("patch", F.lit("present").alias("status")).union(gone.select("patch", F.lit("skipped").alias("status")))


@query("select p_partkey, p_brand, case when p_brand in ('Brand#11', 'Brand#23') then 'excluded' else '' end as reason from {part}")
def a6_exclusion_list(spark, sf_dir):
    rows = load(spark, sf_dir, "select p_partkey, p_brand from {part}")
    kept, gone = D.excluded(rows, "p_brand", ["Brand#11", "Brand#23"])
    why = gone.distinct()
    return kept.withColumn("reason", F.lit("")).union(rows.join(F.broadcast(why), "p_brand").select("p_partkey", "p_brand", "reason"))  # as many rows as the list has names


_TILES = "select concat('/emb/fold_', cast(l_orderkey % 5 as {s}), '/', cast(l_orderkey as {s}), '_', cast(l_linenumber % 2 as {s}), '_', cast(l_partkey % 2 as {s}), case when l_suppkey % 10 = 0 then '.npy' else '.labels.npy' end) as path, cast(l_orderkey % 5 as int) as fold, l_orderkey, l_linenumber, l_partkey, l_suppkey from {lineitem}"


@query(f"select path, cast(l_orderkey as bigint) as patch, cast(l_linenumber % 2 as int) as tile_row, cast(l_partkey % 2 as int) as tile_col from ({_TILES.replace('{s}', 'varchar')}) where fold in (0, 3) and l_suppkey % 10 <> 0 and l_orderkey in (select o_orderkey from {{orders}} where o_orderstatus = 'F')")
def a21_dense_tiles(spark, sf_dir):
    tiles = load(spark, sf_dir, _TILES.replace("{s}", "string")).select("path", "fold")
    patches = load(spark, sf_dir, "select cast(o_orderkey as bigint) as patch from {orders} where o_orderstatus = 'F'")
    return D.dense_tiles(tiles, [0, 3], patches).select("path", "patch", "tile_row", "tile_col")


_DAYS = "select o_orderkey, cast(o_custkey % 380 as int) - 5 as d, cast(1990 + o_custkey % 9 as int) as y from {orders}"


@query(f"with x as ({_DAYS}), z as (select o_orderkey, y, cast('2001-01-01' as date) + cast(case when d between 1 and 365 then d else 1 end - 1 as int) as t from x) select o_orderkey, cast(day(t) as int) as day, cast(month(t) - 1 as int) as month, y as year from z")
def b25_timestamps(spark, sf_dir):
    return load(spark, sf_dir, _DAYS).select("o_orderkey", D.timestamp_parts(F.col("d"), F.col("y")).alias("t")).select("o_orderkey", "t.*")


_CLIMATE = "select l_orderkey as sample, cast(l_linenumber - 1 as int) as month, cast(l_quantity as double) as elevation, cast(l_discount as double) as slope, cast(l_tax as double) as temperature from {lineitem}"


@query(f"with c as ({_CLIMATE}) select c.sample, c.month, s.elevation, s.slope, c.temperature from c left join (select * from c where month = 0) s on c.sample = s.sample")
def b26_terrain_and_weather(spark, sf_dir):
    terrain, weather = D.terrain_and_weather(load(spark, sf_dir, _CLIMATE), "sample", "month", ["elevation", "slope"], ["temperature"])
    return weather.join(terrain, "sample", "left").select("sample", "month", "elevation", "slope", "temperature")


_PIXELS = "select l_orderkey, l_linenumber, l_partkey % 30 as month, cast(l_quantity as double) as b4, case when l_suppkey % 11 = 0 then -cast(l_quantity as double) else cast(l_extendedprice as double) end as b8, l_returnflag = 'R' as void from {lineitem}"


@query(
    f"""with p as ({_PIXELS}), k as (select *, cast(month % 12 as int) as m from p where not void)
    select l_orderkey, l_linenumber, b4, b8, round(case when b8 + b4 <> 0 then (b8 - b4) / (b8 + b4) else 0e0 end, 6) as ndvi, m as month, cast(dayofyear(make_date(2000, m + 1, 15)) as int) as doy, 2019 as year from k"""
)
def c10_pixel_series(spark, sf_dir):
    return rounded(D.pixel_series(load(spark, sf_dir, _PIXELS), ["l_orderkey", "l_linenumber"], "month", "b4", "b8", "void"))


#: declared sizes of the parts of each customer's orders, with a part named twice, a negative size, or a wrong sum in some
_SIZES = """select o_custkey, case when o_custkey % 7 = 1 then 'train' else part end as part, case when o_custkey % 7 = 2 and part = 'test' then -size when o_custkey % 7 = 3 and part = 'test' then size + 1 else size end as size, n from (
    select o_custkey, 'train' as part, count(*) * 2 as size, count(*) * 3 as n from {orders} group by o_custkey union all select o_custkey, 'test', count(*), count(*) * 3 from {orders} group by o_custkey) as t"""


@query("select o_custkey, case o_custkey % 7 when 1 then 'a part comes twice' when 2 then 'a size is negative' else 'the sizes don''t sum up' end as problem from {orders} where o_custkey % 7 in (1, 2, 3) group by o_custkey")
def d7_size_problems(spark, sf_dir):
    return P.size_problems(load(spark, sf_dir, _SIZES), ["o_custkey"], "part", "size", "n")


#: leaves of customers: which parts they hold and what they claim
_CLAIMS = """select c_custkey as holdout, c_custkey % 2 = 0 as has_target, c_custkey % 3 = 0 as supports_target_labels, c_custkey % 5 <> 0 as p0, c_custkey % 4 < 3 as p1, c_custkey % 7 < 3 as p2 from {customer}"""


@query(
    f"""with c as ({_CLAIMS}), x as (
        select holdout, 0 as k, 'no source_train' as problem from c where not p0
        union all select holdout, 1, 'no target_test' from c where has_target and not p1
        union all select holdout, 2, 'target rows without a target' from c where not has_target and (p1 or p2)
        union all select holdout, 3, 'no target_label_pool' from c where supports_target_labels and not p2
        union all select holdout, 4, 'target_label_pool is not allowed' from c where not supports_target_labels and p2)
    select holdout, string_agg(problem, '; ' order by k) as problems from x group by 1"""
)
def d18_role_problems(spark, sf_dir):
    parts = F.expr("filter(array(if(p0, 'source_train', null), if(p1, 'target_test', null), if(p2, 'target_label_pool', null)), x -> x is not null)")
    found = S.role_problems(load(spark, sf_dir, _CLAIMS).withColumn("parts", parts))
    return found.select("holdout", F.array_join("problems", "; ").alias("problems"))


_UNITS = "select o_orderkey, case o_orderkey % 4 when 0 then 'cropharvest' when 1 then 'eurocropsml' when 2 then 'breizhcrops' else 'pastis' end as benchmark, case o_custkey % 6 when 0 then 'togo' when 1 then 'uganda' when 2 then 'croplands' when 3 then 'Latvia' when 4 then 'frh02' else 'T31TFM' end as unit from {orders}"


@query(
    f"""with u as ({_UNITS}) select o_orderkey, benchmark, unit, case when benchmark = 'cropharvest' and unit = 'togo' or benchmark = 'eurocropsml' and unit = 'Latvia' or benchmark = 'breizhcrops' and unit = 'frh02' or benchmark = 'pastis' and unit = 'T31TFM' then 'headline'
        when benchmark = 'cropharvest' and unit = 'uganda' then 'supplementary_stress' when benchmark = 'cropharvest' and unit = 'croplands' then 'source_only' else 'unlisted' end as role,
        case benchmark when 'cropharvest' then 5e1 when 'eurocropsml' then 25e0 when 'breizhcrops' then 5e0 else 2e0 end as purge_km, case benchmark when 'pastis' then 'patches' else 'samples' end as label_unit from u"""
)
def d28_target_roles(spark, sf_dir):
    policies = P.policy_table(spark)
    units = load(spark, sf_dir, _UNITS)
    roles = P.target_role(policies, units.select("benchmark", "unit").distinct(), "unit")
    return units.join(F.broadcast(roles), ["benchmark", "unit"]).join(F.broadcast(policies.select("benchmark", "purge_km", "label_unit")), "benchmark").select("o_orderkey", "benchmark", "unit", "role", "purge_km", "label_unit")  # both are tables of policies


@query("select o_orderkey, cast('0x' || substr(sha1(concat_ws('|', 'b', cast(o_orderkey % 3 as varchar), o_orderpriority, coalesce(case when o_custkey % 4 > 0 then o_orderstatus end, 'None'), 'source', cast(o_custkey as varchar))), 1, 12) as bigint) as cap_seed from {orders}")
def e3_cap_seeds(spark, sf_dir):
    rows = load(spark, sf_dir, "select o_orderkey, o_orderkey % 3 as seed, o_orderpriority, case when o_custkey % 4 > 0 then o_orderstatus end as holdout, o_custkey from {orders}")
    return rows.select("o_orderkey", P.cap_seed(F.lit("b"), F.col("seed"), F.col("o_orderpriority"), F.col("holdout"), F.lit("source"), F.col("o_custkey")).alias("cap_seed"))


@query("select * from (values ('allocation@50', 'ok'), ('one_class@50', 'failed'), ('source_full', 'ok')) as t(cell, status) where (select count(*) from {embeddings}) > 0")
def f8_multiclass_cells(spark, sf_dir):
    """Two cells are fitted and scored; the third has one class and is in the failure log."""
    _, out = cell_run(spark, sf_dir, "multiclass", "logistic")
    scored = X.score_cells(out, "multiclass").select("cell", F.when(F.col("balanced_accuracy").between(0, 1), "ok").otherwise("no score").alias("status"))
    return scored.union(X.failure_log(spark, out).select("cell", F.lit("failed").alias("status")))


@query()
def f8_binary_cells(spark, sf_dir):
    _, out = cell_run(spark, sf_dir, "binary", "logistic")
    return X.score_cells(out, "binary").select("cell", "auc", "f1", "calibrated_f1", "n_test")


#: result rows with all that tells cells apart; some cells come twice, some scores are missing
_RESULTS = """select l_orderkey * 10 + l_linenumber as row_id, case l_partkey % 4 when 0 then 'cropharvest' when 1 then 'eurocropsml' when 2 then 'breizhcrops' else 'pastis' end as bench, case l_suppkey % 3 when 0 then 'raw' when 1 then 'presto' else 'galileo' end as model,
    case l_orderkey % 3 when 0 then 'logistic' when 1 then 'mlp' else 'knn' end as probe_family, case l_partkey % 3 when 0 then 'random_id' when 1 then 'geographic_ood' else 'official' end as split_regime, case when l_linenumber % 2 = 0 then 'full' else 'test' end as evaluation_split,
    case l_orderkey % 2 when 0 then 0e0 else 1e0 end as label_budget, concat('region', cast(l_suppkey % 5 as {s})) as holdout, cast(l_orderkey % 4 as int) as seed, case l_quantity % 3 when 0 then '25k' when 1 then '50k' else '100k' end as cap,
    cast(l_quantity as double) / 50 as calibrated_f1, case when l_partkey % 11 > 0 then cast(l_discount as double) end as macro_f1, cast(l_tax as double) as miou, cast(l_discount as double) / 2 as ece, cast(l_tax as double) * 3 as nll from {lineitem}"""
_RESULTS_SPARK, _RESULTS_SQL = _RESULTS.replace("{s}", "string"), _RESULTS.replace("{s}", "varchar")
_SCORE = "case bench when 'cropharvest' then calibrated_f1 when 'pastis' then miou else macro_f1 end"
_OOD = "split_regime = 'geographic_ood' and evaluation_split = 'full' and label_budget = 0"
_DEPLOY = "case when split_regime = 'random_id' then evaluation_split = 'test' and label_budget = 1 else evaluation_split = 'full' and label_budget = 0 end"


def _results(spark, sf_dir):
    return load(spark, sf_dir, _RESULTS_SPARK)


@query(f"with r as ({_RESULTS_SQL}) select bench, model, probe_family, round(avg({_SCORE}), 6) as score, count({_SCORE}) as n from r where {_OOD} group by 1, 2, 3 having count({_SCORE}) > 0")
def h29_family_means(spark, sf_dir):
    return rounded(G.means(_results(spark, sf_dir), G.ood_cell(), ["bench", "model", "probe_family"]))


@query(
    f"""with r as ({_RESULTS_SQL}), u as (select * from (select *, row_number() over (partition by cap, model, bench, probe_family, split_regime, evaluation_split, label_budget, holdout, seed order by row_id desc) as k from r) where k = 1),
    m as (select probe_family, model, cap, avg({_SCORE}) as score from u where {_OOD} group by 1, 2, 3 having count({_SCORE}) > 0), w as (select probe_family, model, max(score) - min(score) as swing from m group by 1, 2)
    select probe_family, round(max(swing), 6) as max_swing from w group by 1"""
)
def h29_budget_swing(spark, sf_dir):
    return rounded(G.budget_swing(G.last_of_cell(_results(spark, sf_dir), "row_id", ["cap"]), "cap"))


@query(f"with r as ({_RESULTS_SQL}) select bench, split_regime, round(avg({_SCORE}), 6) as score, count({_SCORE}) as n from r where {_DEPLOY} and probe_family = 'logistic' group by 1, 2 having count({_SCORE}) > 0")
def h29_regime_means(spark, sf_dir):
    return rounded(G.means(_results(spark, sf_dir), G.deployment_cell() & (F.col("probe_family") == "logistic"), ["bench", "split_regime"]))


@query(f"with r as ({_RESULTS_SQL}), p as (select bench, holdout, avg({_SCORE}) as score from r where {_OOD} group by 1, 2 having count({_SCORE}) > 0) select bench, holdout, round(score, 6) as score, cast(row_number() over (partition by bench order by score, holdout) - 1 as int) as place, round(avg(score) over (partition by bench), 6) as mean_of_regions from p")
def h29_region_means(spark, sf_dir):
    return rounded(G.region_means(_results(spark, sf_dir)))


_GAP = " union all ".join(f"select model, '{m}' as metric, round(avg({m}) filter (where split_regime = 'random_id' and {_DEPLOY}), 6) as id, round(avg({m}) filter (where {_OOD}), 6) as ood from r group by 1" for m in ("ece", "nll"))


@query(f"with r as ({_RESULTS_SQL}) select * from ({_GAP}) where id is not null and ood is not null")
def h29_calibration_gap(spark, sf_dir):
    return rounded(G.calibration_gap(_results(spark, sf_dir), ["ece", "nll"]))


@query(f"with r as ({_RESULTS_SQL}), a as (select model, avg({_SCORE}) as native from r where {_OOD} and seed < 2 group by 1), b as (select model, avg({_SCORE}) as optical from r where {_OOD} and seed > 1 group by 1) select a.model, round(native, 6) as native, round(optical, 6) as optical, round(native - optical, 6) as difference from a join b on a.model = b.model")
def h29_native_against_optical(spark, sf_dir):
    rows = _results(spark, sf_dir)
    return rounded(G.native_against_optical(rows.where("seed < 2"), rows.where("seed > 1").withColumn("bench", F.concat("bench", F.lit("__s2only")))))


@query(f"with r as ({_RESULTS_SQL}), p as (select probe_family, cap, avg({_SCORE}) as score from r where {_OOD} group by 1, 2) select a.probe_family, round(a.score, 6) as from_score, round(b.score, 6) as to_score, round(b.score - a.score, 6) as delta from p a join p b on a.probe_family = b.probe_family where a.cap = '25k' and b.cap = '100k'")
def h29_budget_scaling(spark, sf_dir):
    return rounded(G.scaling(_results(spark, sf_dir), "cap", "25k", "100k"))
