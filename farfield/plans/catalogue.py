"""Queries for catalogue columns, further regimes and rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from farfield.functions import columns as C
from farfield.operators import budgets as B
from farfield.operators import catalogue as K
from farfield.operators import metrics as M
from farfield.plans.design import GREAT_CIRCLE_KM
from farfield.plans.fixtures import BINARY, PIXELS, SAMPLES, load, plain, rounded
from farfield.plans.results import ROWS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = plain(sql)
        return f

    return register


_S = f"s as ({SAMPLES})"


@query("select c_custkey, substr(c_name, instr(c_name, '#') + 1) as source from {customer}")
def b2_provenance(spark, sf_dir):
    rows = load(spark, sf_dir, "select c_custkey, concat('17_', substr(c_name, instr(c_name, '#') + 1), '.h5') as id from {customer}")
    return rows.select("c_custkey", K.provenance(F.col("id")).alias("source"))


@query("select c_custkey, case substr(n_name, 1, 2) when 'CH' then 'china' when 'GE' then 'germany' else substr(n_name, 1, 2) end as country from {customer} join {nation} on c_nationkey = n_nationkey")
def b3_country_prefix(spark, sf_dir):
    rows = load(spark, sf_dir, "select c_custkey, n_name from {customer} join {nation} on c_nationkey = n_nationkey")
    return rows.select("c_custkey", K.by_prefix(F.col("n_name"), {"CH": "china", "GE": "germany"}).alias("country"))


@query("select cast(month(d) - 1 as int) as slot, cast(case when year(d) > 0 then dayofyear(make_date(2000, month(d), 15)) end as int) as doy, count(*) as n from (select cast(o_orderdate as date) as d from {orders}) group by 1, 2")
def b8_synthetic_day(spark, sf_dir):
    rows = load(spark, sf_dir, "select cast(o_orderdate as date) as d from {orders}").withColumn("slot", F.month("d") - 1)
    return rows.groupBy("slot", C.synthetic_day_of_year(F.col("slot")).alias("doy")).agg(F.count("*").alias("n"))


@query("with a as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i, count(*) over (partition by o_custkey) as t from {orders}) select o_custkey, o_orderkey, cast(greatest(least(round_even(cast(i as double) / greatest(t - 1, 1) * 11, 0), 11), 0) as int) as month from a")
def b11_spread_months(spark, sf_dir):
    from pyspark.sql import Window

    rows = load(spark, sf_dir, "select o_custkey, o_orderkey from {orders}")
    w = Window.partitionBy("o_custkey")
    rows = rows.withColumns({"i": F.row_number().over(w.orderBy("o_orderkey")) - 1, "t": F.count("*").over(w)})
    return rows.select("o_custkey", "o_orderkey", K.spread_month(F.col("i"), F.col("t")).alias("month"))


@query("select o_orderpriority, round(sum(case when o_orderkey % 7 = 0 then 0e0 else o_totalprice end), 2) as total from {orders} group by 1")
def b12_scrubbed(spark, sf_dir):
    rows = load(spark, sf_dir, "select o_orderpriority, case o_orderkey % 7 when 0 then double('NaN') else o_totalprice end as v from {orders}")
    return rows.groupBy("o_orderpriority").agg(F.round(F.sum(C.scrubbed(F.col("v"))), 2).alias("total"))


@query(f"with {_S} select sample_id, round(lat + 5e-1, 6) as lat, round(lon + case when lon < 17e1 then 1e0 else -1e0 end, 6) as lon from s")
def b14_box_centre(spark, sf_dir):
    rows = load(spark, sf_dir, SAMPLES).withColumn("far", F.col("lon") + F.when(F.col("lon") < 170, 2).otherwise(-2))
    ring = F.array(F.array(F.array("lon", "lat"), F.array(F.col("far"), F.col("lat")), F.array(F.col("far"), F.col("lat") + 1)))
    lat, lon = K.box_centre(ring)
    return rounded(rows.select("sample_id", lat.alias("lat"), lon.alias("lon")))


@query("select c_custkey, 'T' || lpad(cast(c_custkey % 60 + 1 as varchar), 2, '0') || 'ABC' as tile from {customer}")
def b15_tile_code(spark, sf_dir):
    rows = load(spark, sf_dir, "select c_custkey, concat(case when c_custkey % 2 = 0 then ' t' else '' end, lpad(cast(c_custkey % 60 + 1 as string), 2, '0'), 'abc ') as raw from {customer}")
    return rows.select("c_custkey", K.tile_code(F.col("raw")).alias("tile"))


#: bands of both spellings, among them names that count in one modality alone
_BANDS = [("s2", "B4"), ("s2", "b8a"), ("s1", "VV"), ("climate", "tmean"), ("s2", "B11"), ("s2", "b5"), ("s2", "NDVI"), ("climate", "slope"), ("climate", "DEM"), ("s2", "slope"), ("s2", "B8"), ("s2", "NDWI"), ("s1", "B4"), ("climate", "B2"), ("srtm", "elevation"), ("s2", "B1")]


def _banded(orders: str) -> str:
    pick = lambda i: " ".join(f"when {k} then '{b[i]}'" for k, b in enumerate(_BANDS))
    return f"select o_orderkey, case o_orderkey % {len(_BANDS)} {pick(0)} end as modality, case o_orderkey % {len(_BANDS)} {pick(1)} end as band from {orders}"


@query(
    f"""with b as ({_banded("{orders}")}) select o_orderkey, modality, band, case when modality = 's1' then 'sar' when modality = 'climate' and upper(band) in ('ELEVATION', 'SLOPE', 'DEM') then 'topography'
    when modality = 'climate' then 'climate' when upper(band) in ('B2', 'B3', 'B4') then 'visible' when upper(band) in ('B5', 'B6', 'B7', 'B8A') then 'red_edge' when upper(band) = 'B8' then 'nir'
    when upper(band) in ('B11', 'B12') then 'swir' when upper(band) = 'NDVI' then 'index' else 'other' end as band_group from b"""
)
def b17_band_group(spark, sf_dir):
    return load(spark, sf_dir, _banded("{orders}")).withColumn("band_group", K.band_group(F.col("modality"), F.col("band")))


_MODALITIES = "select c_nationkey as bench, case c_custkey % 3 when 0 then 's2' when 1 then 's1' else 'climate' end as modality from {customer} where c_nationkey % 4 <> 0 or c_custkey % 3 = 0"


_PLACED = "select c_nationkey as bench, case when c_nationkey % 2 = 0 and c_custkey % 5 = 0 then 1e0 else 0e0 end as lat, 0e0 as lon from {customer}"


@query(f"with x as (select bench, modality from ({_MODALITIES}) union select bench, 'latlon' from ({_PLACED}) where lat <> 0), b as (select bench from ({_PLACED}) union select bench from ({_MODALITIES})) select b.bench, coalesce(string_agg(modality, ',' order by modality), '') as modalities from b left join x on b.bench = x.bench group by 1")
def b18_available_modalities(spark, sf_dir):
    found = K.available_modalities(load(spark, sf_dir, _MODALITIES), load(spark, sf_dir, _PLACED), "bench")
    return found.select("bench", F.array_join("modalities", ",").alias("modalities"))


_RANKED = "select c_custkey, case when c_custkey % 10 > 0 then cast(c_custkey % 10 as int) end as r from {customer}"


@query(f"with q as ({_RANKED}) select c_custkey, case when r is null then 'unranked' when r between 1 and 2 then 'native' when r between 3 and 4 then 'minor_adaptation' when r between 5 and 6 then 'moderate_adaptation' else 'major_adaptation' end as severity from q")
def b20_severity(spark, sf_dir):
    return load(spark, sf_dir, _RANKED).select("c_custkey", K.severity(F.col("r")).alias("severity"))


@query("with l as (select o_custkey, count(*) as a, count(distinct o_orderpriority) as b from {orders} group by 1) select a, b, count(*) as n from l group by 1, 2")
def c6_length_groups(spark, sf_dir):
    lengths = load(spark, sf_dir, "select o_custkey, count(*) as a, count(distinct o_orderpriority) as b from {orders} group by 1")
    return K.length_groups(lengths, ["a", "b"], "o_custkey")


@query("select c_custkey from {customer} where c_custkey in (select o_custkey from {orders} where o_orderstatus = 'P')")
def c13_subset(spark, sf_dir):
    return load(spark, sf_dir, "select c_custkey from {customer}").join(load(spark, sf_dir, "select o_custkey as c_custkey from {orders} where o_orderstatus = 'P'"), "c_custkey", "left_semi")


@query(f"with {_S} select case when region = 'ASIA' then 'target_test' else 'x' end as partition, count(*) as n from s where region = 'ASIA' group by 1 union all select 'source_train', cast(count(*) - count(*) // 10 as bigint) from s where region <> 'ASIA' union all select 'source_val', cast(count(*) // 10 as bigint) from s where region <> 'ASIA'")
def d9_official_provenance(spark, sf_dir):
    parts = K.official_provenance(load(spark, sf_dir, SAMPLES), "region", ["ASIA"], "sample_id", "label", 0)
    return parts.groupBy("partition").agg(F.count("*").alias("n"))


@query(f"with {_S} select sample_id, case region when 'ASIA' then 'target_test' when 'AFRICA' then 'source_val' else 'source_train' end as partition from s where region in ('ASIA', 'AFRICA', 'EUROPE')")
def d9_official_regions(spark, sf_dir):
    return K.official_regions(load(spark, sf_dir, SAMPLES), "region", {"ASIA": "target_test", "AFRICA": "source_val", "EUROPE": "source_train"}, "sample_id")


@query()
def d12_spatial_cluster_regime(spark, sf_dir):
    kept, _ = K.spatial_cluster_regime(load(spark, sf_dir, SAMPLES), "sample_id", 50.0)
    return kept.groupBy("holdout", "role").agg(F.count("*").alias("n"))


@query(f"with p as ({PIXELS}) select cell, count(*) as n_pixels, count(distinct l_orderkey) as n_patches, count(distinct (l_orderkey, tile)) as n_tiles from p group by 1")
def d22_fold_stats(spark, sf_dir):
    return K.fold_stats(load(spark, sf_dir, PIXELS), ["cell"], "l_orderkey", ["tile"], "y_true").drop("classes")


@query("select c_custkey, 'missing' as problem from {customer} where c_custkey % 100 = 0 union all select c_custkey, 'duplicate' from {customer} where c_custkey % 100 = 1 union all select c_custkey + 100000000, 'unexpected' from {customer} where c_custkey % 100 = 2")
def d24_population_problems(spark, sf_dir):
    population = load(spark, sf_dir, "select c_custkey from {customer}")
    rows = load(spark, sf_dir, "select c_custkey from {customer} where c_custkey % 100 <> 0 union all select c_custkey from {customer} where c_custkey % 100 = 1 union all select c_custkey + 100000000 from {customer} where c_custkey % 100 = 2")
    return K.population_problems(rows, population, "c_custkey")


_EXPECTED = "select c_nationkey as tile, count(*) + case when c_nationkey = 7 then 1 else 0 end as expected from {customer} where c_nationkey <> 4 group by c_nationkey"


@query(f"with h as (select c_nationkey as tile, count(*) as n from {{customer}} where c_nationkey <> 9 group by 1), e as ({_EXPECTED}) select coalesce(h.tile, e.tile) as tile, n, expected from h full join e on h.tile = e.tile where n is distinct from expected")
def d26_universe_problems(spark, sf_dir):
    tiles = load(spark, sf_dir, "select c_nationkey as tile from {customer} where c_nationkey <> 9")
    return K.universe_problems(tiles, load(spark, sf_dir, _EXPECTED), "tile")


@query(
    f"""with {_S}, n as (select count(*) as n from s), g as (select a.region as holdout, count(distinct b.sample_id) as gone from s a join s b on a.region <> b.region and {GREAT_CIRCLE_KM} <= 25e0 group by 1),
    h as (select 'random_id' as regime, 'all' as holdout, n as total from n union all select 'geographic_ood', d.region, n - coalesce(gone, 0) from (select distinct region from s) d cross join n left join g on g.holdout = d.region)
    select cast(k.k as int) as seed, regime, holdout, total from h cross join (select 0 as k union all select 1) k"""
)
def d31_generated_splits(spark, sf_dir):
    made = K.generate(load(spark, sf_dir, SAMPLES), "sample_id", "label", "region", [0, 1], 25.0)
    return made.groupBy("seed", "regime", "holdout").agg(F.count_distinct("sample_id").alias("total"))


#: an order of each region's samples, with one fault a region: an id that isn't there, one left out, one twice, a gap
_ORDERS = f"""select region, case when region = 'AFRICA' and o = 0 then -1 when region = 'ASIA' and o = 1 then first_id else sample_id end as stable_id, case when region = 'EUROPE' and o > 2 then o + 1 else o end as place
    from (select region, sample_id, row_number() over (partition by region order by sample_id) - 1 as o, min(sample_id) over (partition by region) as first_id from ({SAMPLES})) where not (region = 'AMERICA' and o = 5)"""


@query("select * from (values ('AFRICA', 'unknown ids'), ('AMERICA', 'size'), ('ASIA', 'repeated ids'), ('EUROPE', 'places')) as t(region, problem)")
def e16_order_problems(spark, sf_dir):
    population = load(spark, sf_dir, SAMPLES).select("region", F.col("sample_id").alias("stable_id"))
    return K.order_problems(load(spark, sf_dir, _ORDERS), population, ["region"], "stable_id", "place")


@query("with p as (select distinct l_orderkey as k, cast(l_orderkey % 4 as int) as g from {lineitem}), r as (select *, row_number() over (partition by g order by md5(concat_ws('|', '0', 'patches', cast(k as varchar))), k) - 1 as r, md5(concat_ws('|', '0', 'patch-group', cast(g as varchar))) as h from p), o as (select *, row_number() over (order by r, h, k) as o from r) select k, g from o where o <= 50")
def e6_balanced_patches(spark, sf_dir):
    patches = load(spark, sf_dir, "select distinct l_orderkey as k, cast(l_orderkey % 4 as int) as g from {lineitem}")
    return K.balanced_patches(patches, "g", "k", 50, 0)


@query(f"with {_S} select region, sample_id as stable_id, case when sample_id % 3 = 0 then 'target_label_pool' else 'source_train' end as partition from s")
def e20_positions(spark, sf_dir):
    rows = load(spark, sf_dir, SAMPLES).withColumn("partition", F.when(F.col("sample_id") % 3 == 0, "target_label_pool").otherwise("source_train"))
    access = B.label_access(rows, ["region"], "sample_id", 0)
    return K.positions(access, rows, ["region"], "sample_id").select("region", "stable_id", "partition")


@query(f"with b as ({BINARY}) select cell, round(avg((prob - y_true) * (prob - y_true)), 6) as value from b group by 1")
def g5_named_metric(spark, sf_dir):
    return rounded(K.named_metric(load(spark, sf_dir, BINARY), ["cell"], "brier"))


_DIRECTIONS = {
    "higher_is_better": "f1 auc balanced_accuracy calibrated_f1 calibrated_balanced_accuracy worst_group_f1 worst_group_balanced_accuracy worst_group_calibrated_f1 worst_group_calibrated_balanced_accuracy worst_group_score macro_f1 weighted_f1 accuracy macro_auc worst_group_macro_f1 worst_group_weighted_f1 worst_group_accuracy shared_macro_f1 shared_balanced_accuracy shared_accuracy miou pixel_accuracy mean_per_tile_miou worst_tile_miou",
    "lower_is_better": "ece brier nll top_label_ece_all union_brier shared_ece shared_nll shared_brier unseen_prevalence n_classes_unseen",
    "structural": "n_classes_seen n_tiles_scored",
}
#: metrics of result rows: all of the universe, and one that isn't in it
_NAMES = sorted({m for names in _DIRECTIONS.values() for m in names.split()}) + ["some_new_metric"]
_MEASURED = f"select o_orderkey, element_at(split('{','.join(_NAMES)}', ','), cast(o_orderkey % {len(_NAMES)} as int) + 1) as metric from {{orders}}"
_MEASURED_SQL = f"select o_orderkey, string_split('{','.join(_NAMES)}', ',')[cast(o_orderkey % {len(_NAMES)} as int) + 1] as metric from {{orders}}"


@query(f"with m as ({_MEASURED_SQL}) select o_orderkey, metric, case {' '.join(f'when metric in ({chr(39)}' + (chr(39) + ', ' + chr(39)).join(n.split()) + f'{chr(39)}) then {chr(39)}{d}{chr(39)}' for d, n in _DIRECTIONS.items())} else 'unknown' end as direction from m")
def g13_metric_direction(spark, sf_dir):
    return load(spark, sf_dir, _MEASURED).withColumn("direction", M.direction(F.col("metric")))


_ROLE_ROWS = "select l_orderkey, l_linenumber, element_at(array('binary', 'multiclass', 'segmentation'), cast(l_orderkey % 3 as int) + 1) as task, element_at(array('f1', 'calibrated_f1', 'macro_f1', 'miou', 'ece', 'worst_tile_miou', 'balanced_accuracy'), cast(l_linenumber as int)) as metric from {lineitem}"
_ROLE_SQL = _ROLE_ROWS.replace("element_at(array(", "list_extract(list_value(")


@query(
    f"""with m as ({_ROLE_SQL}) select l_orderkey, l_linenumber, task, metric, case
    when task = 'binary' then case when metric = 'calibrated_f1' then 'deployment' when metric in ('f1', 'balanced_accuracy', 'ece') then 'diagnostic' end
    when task = 'multiclass' then case when metric in ('macro_f1', 'balanced_accuracy') then 'deployment' when metric = 'ece' then 'diagnostic' end
    when metric in ('miou', 'worst_tile_miou') then 'deployment' when metric in ('macro_f1', 'ece') then 'diagnostic' end as role from m"""
)
def g13_metric_role(spark, sf_dir):
    return load(spark, sf_dir, _ROLE_ROWS).withColumn("role", M.role(F.col("task"), F.col("metric")))


@query(f"with r as ({ROWS}) select model, 'gaps are missing' as problem from r where model = 'ASIA' group by 1")
def h27_presence_problems(spark, sf_dir):
    rows = load(spark, sf_dir, ROWS)
    gaps = rows.where("model != 'ASIA' and regime != 'random_id'")
    return K.presence_problems(rows, gaps, ["model"])
