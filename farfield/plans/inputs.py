"""Queries for derived columns, series and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farfield.functions import columns as C
from farfield.operators import series as T
from farfield.operators import splits as S
from farfield.plans.fixtures import ACQUISITIONS, SAMPLES, load, plain, rounded
from farfield.sources import files as A

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
_A = f"a as (select sample_id, cast(month(t) as int) - 1 as month, t, b4, b8, b11 from ({ACQUISITIONS}))"


def _acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, f"select sample_id, cast(month(t) as int) - 1 as month, t, b4, b8, b11 from ({ACQUISITIONS})")


@query("select o_orderkey as sample_id from {orders} order by md5(concat_ws('|', '0', 'take', cast(o_orderkey as varchar))), o_orderkey limit 300")
def a4_select_files(spark, sf_dir):
    return S.take_ranked(load(spark, sf_dir, "select o_orderkey as sample_id from {orders}"), [], 0, "sample_id", 300)


@query("select case when o_totalprice < 50000 then 'price' when o_orderstatus = 'P' then 'status' end as reason, count(*) as n from {orders} where o_totalprice < 50000 or o_orderstatus = 'P' group by 1")
def a5_rejects(spark, sf_dir):
    _, bad = A.with_rejects(load(spark, sf_dir, "select * from {orders}"), {"price": "o_totalprice >= 50000", "status": "o_orderstatus != 'P'"})
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query("select count(*) as dropped, (select count(*) from {orders}) - count(*) as kept from {orders} where o_orderstatus = 'F'")
def a11_dropping(spark, sf_dir):
    kept, dropped = A.dropping(load(spark, sf_dir, "select * from {orders}"), "o_orderstatus = 'F'")
    return dropped.crossJoin(kept.agg(F.count("*").alias("kept"))).select("dropped", "kept")


@query("select n_name as name, n_regionkey as region, cast(null as double) as balance from {nation} union all select c_name, null, c_acctbal from {customer}")
def a12_heterogeneous_union(spark, sf_dir):
    nations = load(spark, sf_dir, "select n_name as name, n_regionkey as region from {nation}")
    customers = load(spark, sf_dir, "select c_name as name, c_acctbal as balance from {customer}")
    return A.union_of([nations, customers])


@query("with s as (select c_custkey as k, case c_custkey % 6 when 0 then 'target_test' when 1 then 'source_val' when 2 then 'source_test' when 3 then 'target_label_pool' when 4 then '' else 'source_train' end as p, case when c_custkey % 6 = 4 then case when c_custkey % 4 = 0 then 'purged' else 'excluded' end else 'assigned' end as st from {customer}) select cast(k as varchar) as stable_id, cast(row_number() over (order by case when st = 'assigned' then case p when 'source_train' then 0 when 'source_val' then 1 when 'source_test' then 2 when 'target_label_pool' then 3 else 4 end when st = 'purged' then 5 else 6 end, k) as int) as line from s")
def a14_assignment_order(spark, sf_dir):
    rows = load(spark, sf_dir, "select cast(c_custkey as string) as stable_id, case c_custkey % 6 when 0 then 'target_test' when 1 then 'source_val' when 2 then 'source_test' when 3 then 'target_label_pool' when 4 then '' else 'source_train' end as partition, case when c_custkey % 6 = 4 then case when c_custkey % 4 = 0 then 'purged' else 'excluded' end else 'assigned' end as status from {customer}")
    return A.numbered(rows).select("stable_id", F.col("line").cast("int").alias("line"))


_ROW = "md5(concat_ws('|', cast(o_orderkey as varchar), cast(o_custkey as varchar), o_orderpriority))"


@query(f"select o_orderstatus, count(*) as n, sha256(concat_ws('|', cast(count(*) as varchar), cast(sum(cast('0x' || substr({_ROW}, 1, 15) as bigint)) as varchar), cast(sum(cast('0x' || substr({_ROW}, 16, 15) as bigint)) as varchar))) as digest from {{orders}} group by 1")
def a17_table_digest(spark, sf_dir):
    return A.row_digest(load(spark, sf_dir, "select * from {orders}"), ["o_orderstatus"], ["o_orderkey"], ["o_custkey", "o_orderpriority"])


_RULES = "case when lower(n_name) like '%united%' then 'anglo' when lower(n_name) like '%ina%' then 'ina' else lower(n_name) end"


@query(f"select c_custkey, {_RULES} as canonical from {{customer}} join {{nation}} on c_nationkey = n_nationkey")
def b1_canonical_region(spark, sf_dir):
    name = F.lower("n_name")
    canonical = F.when(name.contains("united"), "anglo").when(name.contains("ina"), "ina").otherwise(name)
    return load(spark, sf_dir, "select c_custkey, n_name from {customer} join {nation} on c_nationkey = n_nationkey").select("c_custkey", canonical.alias("canonical"))


@query("select p_partkey, cast(dense_rank() over (order by substr(p_brand, 1, 7)) - 1 as int) as class_id from {part}")
def b4_label_codes(spark, sf_dir):
    return T.label_codes(load(spark, sf_dir, "select p_partkey, p_brand from {part}"), "p_brand", 7).select("p_partkey", "class_id")


@query("with c as (select p_brand, count(*) as n from {part} group by 1) select p_partkey from {part} join c using (p_brand) where n >= 80")
def b5_without_rare_classes(spark, sf_dir):
    return T.without_rare(load(spark, sf_dir, "select p_partkey, p_brand from {part}"), "p_brand", 80).select("p_partkey")


@query(f"with {_A} select sample_id, month, round(avg(case when b8 + b4 > 0 then (b8 - b4) / (b8 + b4) else 0e0 end), 6) as ndvi from a group by 1, 2")
def b6_ndvi(spark, sf_dir):
    rows = _acquisitions(spark, sf_dir).withColumn("v", C.ndvi(F.col("b8"), F.col("b4")))
    return rounded(rows.groupBy("sample_id", "month").agg(F.avg("v").alias("ndvi")))


@query("select cast(month(o_orderdate) - 1 as int) as month, cast(dayofyear(o_orderdate) as int) as doy, cast(year(o_orderdate) as int) as year, count(*) as n from {orders} group by 1, 2, 3")
def b7_calendar(spark, sf_dir):
    rows = load(spark, sf_dir, "select o_orderdate as d from {orders}")
    return rows.groupBy((F.month("d") - 1).alias("month"), F.dayofyear("d").alias("doy"), F.year("d").alias("year")).agg(F.count("*").alias("n"))


@query("select o_orderkey, cast(month(cast('2001-01-01' as date) + cast(case when d between 1 and 365 then d else 1 end - 1 as int)) - 1 as int) as month from (select o_orderkey, cast(o_orderkey % 400 as int) as d from {orders})")
def b9_month_of_day(spark, sf_dir):
    rows = load(spark, sf_dir, "select o_orderkey, cast(o_orderkey % 400 as int) as d from {orders}")
    return rows.select("o_orderkey", C.month_of_day(F.col("d")).alias("month"))


@query("select o_orderkey, cast(year(cast(o_orderdate as date) - 183) as int) as year from {orders}")
def b10_window_year(spark, sf_dir):
    return load(spark, sf_dir, "select o_orderkey, cast(cast(o_orderdate as date) as string) as d from {orders}").select("o_orderkey", C.window_year(F.col("d")).alias("year"))


@query(f"with {_S} select sample_id, 'block_' || cast(floor((lat + 9e1) / 2e0) as bigint) || '_' || cast(floor((lon + 18e1) / 2e0) as bigint) as block from s")
def b13_spatial_block(spark, sf_dir):
    return load(spark, sf_dir, SAMPLES).select("sample_id", C.spatial_block(F.col("lat"), F.col("lon")).alias("block"))


@query(f"with {_S} select sample_id, round(cos(radians(lat)) * cos(radians(lon)), 6) as x, round(cos(radians(lat)) * sin(radians(lon)), 6) as y, round(sin(radians(lat)), 6) as z from s")
def b16_unit_sphere(spark, sf_dir):
    x, y, z = C.sphere(F.col("lat"), F.col("lon"))
    return rounded(load(spark, sf_dir, SAMPLES).select("sample_id", x.alias("x"), y.alias("y"), z.alias("z")))


_COMPOSITE = "m as (select sample_id, month, avg(b4) as v from a group by 1, 2), g as (select sample_id, cast(month as int) as month from (select distinct sample_id from a) cross join (select unnest(range(12)) as month)), c as (select g.sample_id, g.month, coalesce(v, 0e0) as value, case when v is null then 0 else 1 end as available from g left join m on g.sample_id = m.sample_id and g.month = m.month)"


@query(f"with {_A}, {_COMPOSITE} select sample_id, month, round(value, 6) as value, available from c")
def c1_monthly_composite(spark, sf_dir):
    return rounded(T.monthly_composite(_acquisitions(spark, sf_dir), ["sample_id"], "month", "b4"))


@query(f"with {_A}, {_COMPOSITE} select sample_id, cast((month + 4) % 12 as int) as slot, round(value, 6) as value from c")
def c2_month_order(spark, sf_dir):
    composite = T.monthly_composite(_acquisitions(spark, sf_dir), ["sample_id"], "month", "b4")
    return rounded(T.reordered(composite, [(k + 8) % 12 for k in range(12)]).select("sample_id", "slot", "value"))


@query(f"with {_A} select sample_id, count(*) as n_acquisitions, min(t) as first_t, max(t) as last_t from a group by 1")
def c3_native_series(spark, sf_dir):
    series = T.ragged(_acquisitions(spark, sf_dir), ["sample_id"], "t", ["b4", "b8"])
    return series.select("sample_id", F.size("series").cast("long").alias("n_acquisitions"), F.element_at("series", 1)["t"].alias("first_t"), F.element_at("series", -1)["t"].alias("last_t"))


@query("with l as (select sample_id, list_sort(list(b4)) as v from (select o_custkey as sample_id, l_quantity as b4 from {orders} join {lineitem} on o_orderkey = l_orderkey) group by 1), i as (select sample_id, v, unnest(range(8)) as i from l) select sample_id, cast(i as int) as i, v[cast(round_even(i * (len(v) - 1) / 7e0, 0) as int) + 1] as value from i")
def c4_resample(spark, sf_dir):
    rows = load(spark, sf_dir, "select o_custkey as sample_id, l_quantity as b4 from {orders} join {lineitem} on o_orderkey = l_orderkey")
    listed = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list("b4")).alias("v"))
    return T.resampled(listed, "v", 8).select("sample_id", F.posexplode("v").alias("i", "value"))


@query("with l as (select o_custkey as sample_id, count(*) as n from {orders} join {lineitem} on o_orderkey = l_orderkey group by 1) select sample_id, cast(case when n <= 8 then 8 when n <= 16 then 16 when n <= 32 then 32 when n <= 64 then 64 when n <= 128 then 128 else 256 end as int) as length from l")
def c5_bucketed_length(spark, sf_dir):
    rows = load(spark, sf_dir, "select o_custkey as sample_id, l_quantity as b4 from {orders} join {lineitem} on o_orderkey = l_orderkey")
    listed = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list("b4")).alias("v"))
    return T.bucketed(listed, "v").select("sample_id", F.size("v").alias("length"))


@query(f"with {_A}, {_COMPOSITE} select sample_id, cast(12 as int) as width, round(sum(value * (month + 1)), 4) as weighted from c group by 1")
def c7_flat_features(spark, sf_dir):
    composite = T.monthly_composite(_acquisitions(spark, sf_dir), ["sample_id"], "month", "b4").withColumns({"modality": F.lit(0), "band": F.lit("b4")})
    flat = T.flat_features(composite, "sample_id", "modality", "band")
    weighted = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return flat.select("sample_id", F.size("x").alias("width"), F.round(weighted, 4).alias("weighted"))


@query(f"with {_A}, {_COMPOSITE} select sample_id, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(min(value), 6) as min, round(max(value), 6) as max, round(max(value) - min(value), 6) as range from c group by 1")
def c8_stat_features(spark, sf_dir):
    return rounded(T.stat_features(T.monthly_composite(_acquisitions(spark, sf_dir), ["sample_id"], "month", "b4"), ["sample_id"]))


_LONG = "select l_orderkey, l_linenumber, l_returnflag as band, l_quantity as v from {lineitem}"


@query("with k as (select * from (values ('A', 1e0, 2e0), ('N', 2e1, 5e0), ('R', 0e0, 1e1)) as t(band, a, b)) select l_orderkey, l_linenumber, round((v - a) / (b + 1e-9), 6) as v from (select l_orderkey, l_linenumber, l_returnflag as band, l_quantity as v from {lineitem}) join k using (band)")
def b22_normalised_bands(spark, sf_dir):
    constants = spark.createDataFrame([("A", 1.0, 2.0), ("N", 20.0, 5.0), ("R", 0.0, 10.0)], "band string, a double, b double")
    return rounded(T.normalised(load(spark, sf_dir, _LONG), constants, "band", "v", "z").select("l_orderkey", "l_linenumber", "v"))


@query("with m as (select l_orderkey as k, l_returnflag as band, sum(l_quantity) as v from {lineitem} group by 1, 2) select k, round(coalesce(max(case when band = 'R' then v end), 0e0) * 100 + coalesce(max(case when band = 'A' then v end), 0e0), 4) as code from m where band in ('R', 'A') group by 1")
def b23_band_order(spark, sf_dir):
    rows = load(spark, sf_dir, "select l_orderkey as k, l_returnflag as band, sum(l_quantity) as v from {lineitem} group by 1, 2")
    ordered = T.in_band_order(rows, ["k"], ["R", "A"], "band", "v")
    return ordered.select("k", F.round(F.element_at("x", 1) * 100 + F.element_at("x", 2), 4).alias("code"))


@query("with r as (select l_suppkey as s, l_orderkey, l_linenumber, l_quantity * case when l_suppkey % 2 = 0 then 1 else 10 end as v from {lineitem}), p as (select s, quantile_cont(abs(v), 95e-2) as q from r group by 1) select l_orderkey, l_linenumber, round(case when q < 100 then greatest(least((v + 50) * 200, 32767e0), 0e0) else v end, 4) as v from r join p using (s)")
def b24_decibel_detection(spark, sf_dir):
    rows = load(spark, sf_dir, "select l_suppkey as s, l_orderkey, l_linenumber, l_quantity * case when l_suppkey % 2 = 0 then 1 else 10 end as v from {lineitem}")
    return rounded(T.rescaled_decibels(rows, "s", "v").select("l_orderkey", "l_linenumber", "v"), 4)


@query("select l_orderkey as patch, count(*) as n, min(l_linenumber % 3) as low, max(l_linenumber % 3) as high, count(distinct l_linenumber % 3) as k from {lineitem} group by 1")
def c11_class_sets(spark, sf_dir):
    rows = load(spark, sf_dir, "select l_orderkey as patch, l_linenumber % 3 as label from {lineitem}")
    n = rows.groupBy("patch").agg(F.count("*").alias("n"))
    sets = T.class_sets(rows, ["patch"], "label")
    return n.join(sets, "patch").select("patch", "n", F.array_min("classes").alias("low"), F.array_max("classes").alias("high"), F.size("classes").cast("long").alias("k"))


@query("select l_orderkey % 200 as patch, cast(floor(r / 64) as int) as tile_row, cast(floor(c / 64) as int) as tile_col, count(*) as n, cast(sum(r % 64 * 64 + c % 64) as bigint) as index_sum from (select l_orderkey, l_partkey % 128 as r, l_suppkey * 7 % 128 as c, l_linenumber as label from {lineitem}) where label <> 3 group by 1, 2, 3")
def c9_tiles(spark, sf_dir):
    rows = load(spark, sf_dir, "select l_orderkey % 200 as patch, l_partkey % 128 as r, l_suppkey * 7 % 128 as c, l_linenumber as label from {lineitem}")
    return T.tiles(rows, "r", "c", "label", void=3).groupBy("patch", "tile_row", "tile_col").agg(F.count("*").alias("n"), F.sum("pixel_index").alias("index_sum"))


@query(
    """with v as (select c_custkey as s, c_mktsegment as band, c_acctbal as v from {customer}), own as (select * from v where band = 'BUILDING'),
    p as (select s, v, row_number() over (order by md5(concat_ws('|', '0', 'perturb-from', cast(s as varchar))), s) - 1 as f, row_number() over (order by md5(concat_ws('|', '0-to', 'perturb-to', cast(s as varchar))), s) - 1 as t, count(*) over () as n from own),
    k as (select max(case when f = t then 0 else 1 end) as moved from p), d as (select a.s, b.v from p a cross join k join p b on b.f = (a.t + 1 - k.moved) % a.n)
    select v.s, v.band, cast(coalesce(d.v, v.v) as double) as v from v left join d on v.s = d.s"""
)
def c12_permuted_band(spark, sf_dir):
    rows = load(spark, sf_dir, "select c_custkey as s, c_mktsegment as band, c_acctbal as v from {customer}")
    return T.perturbed(rows, "s", "band", "v", "BUILDING").select("s", "band", "v")


@query("select o_custkey as key, arg_min(o_orderpriority, o_orderkey) as name from {orders} group by 1")
def b27_first_names(spark, sf_dir):
    return T.first_name(load(spark, sf_dir, "select o_custkey as key, o_orderpriority as name, o_orderkey as o from {orders}"), "key", "name", "o")

