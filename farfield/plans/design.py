"""Queries for splits, budgets and geography over located samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farfield.functions import columns as C
from farfield.operators import budgets as B
from farfield.operators import spatial as G
from farfield.operators import splits as S
from farfield.operators.ranks import sized, systematic_order
from farfield.plans.fixtures import PIXELS, SAMPLES, load, plain, rounded
from farfield.sources.scratch import cut

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SEED, KM = 0, 300.0


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = plain(sql)
        return f

    return register


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, SAMPLES)


_S = f"s as ({SAMPLES})"


def _h(op: str, *keys: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', '{op}', {', '.join(f'cast({k} as varchar)' for k in keys)}))"


def _systematic(source: str, by: str, stratum: str, op: str, name: str) -> str:
    """CTEs that rank rows of ``source`` in the systematic order, as ``name``.o."""
    part = f"{by}, {stratum}" if by else stratum
    over = f"partition by {by} " if by else ""
    return f"""{name}_a as (select *, row_number() over (partition by {part} order by {_h(op, 'sample_id')}, sample_id) - 1 as slot, count(*) over (partition by {part}) as n_in from {source}),
    {name} as (select *, row_number() over ({over}order by (slot + 5e-1) / n_in, {stratum}, sample_id) - 1 as o from {name}_a)"""


@query(f"with {_S} select region, count(*) as n, cast(count(*) - 2 * ceil(count(*) / 10e0) as bigint) as source_train, cast(ceil(count(*) / 10e0) as bigint) as source_val, cast(count(*) - ceil(count(*) / 5e0) as bigint) as target_pool, cast(ceil(count(*) / 5e0) as bigint) as target_test from s group by region")
def d1_partition_sizes(spark, sf_dir):
    n = _samples(spark, sf_dir).groupBy("region").agg(F.count("*").alias("n"))
    tenth, fifth = C.ceil_div(F.col("n"), 10), C.ceil_div(F.col("n"), 5)
    return n.select("region", "n", (F.col("n") - 2 * tenth).alias("source_train"), tenth.alias("source_val"), (F.col("n") - fifth).alias("target_pool"), fifth.alias("target_test"))


@query(f"with {_S}, {_systematic('s', 'region', 'label', 'order', 'q')} select region, sample_id, cast(o as bigint) as rank from q")
def d2_systematic_order(spark, sf_dir):
    return systematic_order(_samples(spark, sf_dir), ["region"], ["label"], SEED, "order", "sample_id").select("region", "sample_id", "rank")


@query(
    f"""with {_S}, r as (select *, row_number() over (partition by domain, label order by {_h("target-reserve", "sample_id")}, sample_id) - 1 as r, count(*) over (partition by domain, label) as k from s),
    e as (select *, case when k = 1 then 'target_test' when r = 0 then 'target_label_pool' when r = 1 then 'target_test' end as side from r),
    z as (select domain, count(*) - ceil(count(*) / 5e0) - sum(case when side = 'target_label_pool' then 1 else 0 end) as left_n from e group by domain),
    f as (select sample_id, domain, label from e where side is null), {_systematic("f", "domain", "label", "target-order", "q")}
    select domain, sample_id, side as partition from e where side is not null
    union all select q.domain, sample_id, case when o < left_n then 'target_label_pool' else 'target_test' end from q join z on q.domain = z.domain"""
)
def d3_partition_target(spark, sf_dir):
    return S.partition_target(_samples(spark, sf_dir), ["domain"], "label", "sample_id", SEED).select("domain", "sample_id", "partition")


@query(f"with {_S} select 'source_train' as partition, cast(count(*) - 2 * ceil(count(*) / 10e0) as bigint) as n from s union all select 'source_val', cast(ceil(count(*) / 10e0) as bigint) from s union all select 'source_test', cast(ceil(count(*) / 10e0) as bigint) from s")
def d4_partition_source_sizes(spark, sf_dir):
    rows = S.partition_source(_samples(spark, sf_dir), "label", "region", "sample_id", SEED)
    return rows.groupBy("partition").agg(F.count("*").alias("n"))


_DEALT = "case sample_id % 10 when 0 then 'source_val' when 1 then 'source_test' else 'source_train' end"
_QUOTAS = " union all ".join(
    f"""select v.value, c.partition, coalesce(h.n, 0) as n, cast(v.nv * c.cap // t.total as bigint) as low, cast((v.nv * c.cap + t.total - 1) // t.total as bigint) as high
        from (select {x} as value, count(*) as nv from x group by 1) v cross join (select partition, count(*) as cap from x group by 1) c cross join (select count(*) as total from x) t
        left join (select {x} as value, partition, count(*) as n from x group by 1, 2) h on h.value = v.value and h.partition = c.partition"""
    for x in ("label", "region")
)


@query(f"with {_S}, x as (select *, {_DEALT} as partition from s) select 'dealt' as rows, * from ({_QUOTAS}) where n < low or n > high")
def d5_marginal_audit(spark, sf_dir):
    """Rows dealt out by id miss quotas; rows that the partition dealt out miss none."""
    samples = _samples(spark, sf_dir)
    tables = {"dealt": samples.withColumn("partition", F.expr(_DEALT)), "partition": cut(S.partition_source(samples, "label", "region", "sample_id", SEED).select("label", "region", "partition"), "parts")}
    found = [S.marginal_problems(rows, by).withColumn("rows", F.lit(name)) for name, rows in tables.items() for by in ("label", "region")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query()
def d8_random_split(spark, sf_dir):
    return S.random_split(_samples(spark, sf_dir), "label", "region", "sample_id", SEED).select("sample_id", "partition")


_PATCH = f"px as ({PIXELS}), pl as (select distinct l_orderkey as sample_id, y_true as label from px), pc as (select label, count(*) as c from pl group by label), ps as (select sample_id, arg_min(label, c * 100 + label) as stratum from pl join pc using (label) group by sample_id)"


@query(f"with {_PATCH}, {_systematic('ps', '', 'stratum', 'multilabel', 'q')}, n as (select count(*) as n from ps) select sample_id, case when o < n - 2 * (n // 10) then 'train' when o < n - n // 10 then 'val' else 'test' end as partition from q, n")
def d6_partition_multilabel(spark, sf_dir):
    sets = load(spark, sf_dir, PIXELS).groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.array_sort(F.collect_set("y_true")).alias("labels"))
    n = sets.count()
    return S.partition_by_rarest(sets, "labels", "sample_id", {"train": n - 2 * (n // 10), "val": n // 10, "test": n // 10}, SEED).select("sample_id", "partition")


_SETS = "select cast(p_size % 7 as int) as a, cast(p_partkey % 5 + 3 as int) as b, cast(p_partkey % 11 as int) as c, p_partkey from {part}"


@query(
    f"""with p as ({_SETS}), l as (select p_partkey, unnest(list_distinct(case when p_partkey % 13 = 0 then [] when c > 7 then [a] when c > 4 then [a, b] else [a, b, c] end)) as label from p),
    n as (select count(*) as n from p), s as (select 'train' as partition, n - 2 * (n // 10) as size, n from n union all select 'val', n // 10, n from n union all select 'test', n // 10, n from n)
    select partition, label, count(*) as n_label, cast(max(size) as bigint) as size, true as within from l cross join s group by 1, 2"""
)
def d6_iterative_shares(spark, sf_dir):
    """Label sets dealt out round by round: in every part each label is within four rows, or a hundredth of it, of its quota."""
    rows = load(spark, sf_dir, _SETS)
    sets = F.expr("array_distinct(case when p_partkey % 13 = 0 then cast(array() as array<int>) when c > 7 then array(a) when c > 4 then array(a, b) else array(a, b, c) end)")
    rows = rows.select("p_partkey", sets.alias("labels"))
    n = rows.count()
    sizes = {"train": n - 2 * (n // 10), "val": n // 10, "test": n // 10}
    out = S.partition_multilabel(rows, "labels", "p_partkey", sizes, SEED).select("partition", F.explode("labels").alias("label"))
    have = out.groupBy("label").pivot("partition", list(sizes)).count().fillna(0)
    have = have.withColumn("n_label", sum((F.col(p) for p in sizes), F.lit(0).cast("long")))
    parts = F.explode(F.array(*(F.struct(F.lit(p).alias("partition"), F.col(p).alias("k"), F.lit(size).cast("long").alias("size")) for p, size in sizes.items())))
    out = have.select("label", "n_label", parts.alias("z")).select("label", "n_label", "z.*")
    return out.select("partition", "label", "n_label", "size", (F.abs(F.col("k") - F.col("n_label") * F.col("size") / n) <= F.greatest(F.lit(4.0), F.col("n_label") / 100)).alias("within"))


GREAT_CIRCLE_KM = "2e0 * 6371.0088e0 * asin(sqrt(least(1e0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"with {_S} select a.domain as holdout, b.sample_id from s a join s b on a.domain <> b.domain and {GREAT_CIRCLE_KM} <= {KM}e0 group by 1, 2")
def d13_distance_purge(spark, sf_dir):
    return G.leave_one_out(_samples(spark, sf_dir), "sample_id", "domain", KM)[1]


@query(
    f"""with {_S}, g as (select a.domain as holdout, b.sample_id from s a join s b on a.domain <> b.domain and {GREAT_CIRCLE_KM} <= {KM}e0 group by 1, 2)
    select d.domain as holdout, s.sample_id, case when s.domain = d.domain then 'target' else 'source' end as role from s cross join (select distinct domain from s) d left join g on g.holdout = d.domain and g.sample_id = s.sample_id where g.sample_id is null"""
)
def d10_leave_one_domain_out(spark, sf_dir):
    return G.leave_one_out(_samples(spark, sf_dir), "sample_id", "domain", KM)[0].select("holdout", "sample_id", "role")


#: samples whose domains lie side by side, so that their outer points are near each other
NEARBY = """select c.c_custkey as sample_id, n.n_name as domain, r.r_name as region, c.c_mktsegment as label,
    cast(c.c_nationkey % 5 as double) * 2e0 + cast((c.c_custkey * 3701) % 240 as double) / 1e2 + 4e1 as lat, cast(c.c_nationkey // 5 as double) * 3e0 + cast((c.c_custkey * 9101) % 350 as double) / 1e2 - 1e1 as lon
    from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey"""
_NEARBY_SPARK, _N, NEAR_KM = NEARBY.replace("c.c_nationkey // 5", "c.c_nationkey div 5"), f"s as ({NEARBY})", 25.0
_NEAR = f"g as (select a.domain as holdout, b.sample_id from s a join s b on a.domain <> b.domain and abs(a.lat - b.lat) < 1 and {GREAT_CIRCLE_KM} <= {NEAR_KM}e0 group by 1, 2)"


def _nearby(spark, sf_dir):
    return load(spark, sf_dir, _NEARBY_SPARK)


@query(f"with {_N}, {_NEAR} select * from g")
def d13_border_purge(spark, sf_dir):
    """Domains that touch: the source points along the borders are purged, by cells and not by pairs."""
    return G.leave_one_out(_nearby(spark, sf_dir), "sample_id", "domain", NEAR_KM)[1]


@query(f"with {_N}, {_NEAR} select d.domain as holdout, s.sample_id, case when s.domain = d.domain then 'target' else 'source' end as role from s cross join (select distinct domain from s) d left join g on g.holdout = d.domain and g.sample_id = s.sample_id where g.sample_id is null")
def d10_border_roles(spark, sf_dir):
    return G.leave_one_out(_nearby(spark, sf_dir), "sample_id", "domain", NEAR_KM)[0].select("holdout", "sample_id", "role")


@query(
    f"""with s as (select * replace (case when sample_id % 97 = 0 then null else lat end as lat, case when sample_id % 89 = 0 then null else domain end as domain) from ({NEARBY})),
    g as (select a.domain as holdout, b.sample_id from s a join s b on a.domain <> b.domain and abs(a.lat - b.lat) < 1 and {GREAT_CIRCLE_KM} <= {NEAR_KM}e0 group by 1, 2)
    select d.domain as holdout, case when s.domain is null then 'excluded' when g.sample_id is not null then 'purged' when s.lat is null then 'excluded' else 'assigned' end as status,
        case when s.domain is null then 'unknown_domain' when g.sample_id is not null then 'near_ood' when s.lat is null then 'no_coords' else '' end as reason, count(*) as n
    from s cross join (select distinct domain from s where domain is not null) d left join g on g.holdout = d.domain and g.sample_id = s.sample_id group by 1, 2, 3"""
)
def d19_border_leaves(spark, sf_dir):
    """Leaves with all three states: rows without coordinates or domain are excluded, border rows purged, the rest assigned."""
    samples = _nearby(spark, sf_dir).withColumns({"lat": F.when(F.col("sample_id") % 97 != 0, F.col("lat")), "domain": F.when(F.col("sample_id") % 89 != 0, F.col("domain"))})
    kept, gone = G.leave_one_out(samples, "sample_id", "domain", NEAR_KM)
    placed = kept.where("lat is not null")
    assigned = placed.select("holdout", "sample_id", F.when(F.col("role") == "source", "source_train").otherwise("target_test").alias("partition"))
    nothing = gone.where("false").withColumn("reason", F.lit(""))
    rows = S.leaves(samples, cut(assigned, "assigned"), gone.withColumn("reason", F.lit("near_ood")), nothing, "sample_id", "domain")
    return rows.groupBy("holdout", "status", "reason").agg(F.count("*").alias("n"))


def _leaves(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    kept, gone = G.leave_one_out(samples, "sample_id", "region", KM)
    target = S.partition_target(kept.where("role = 'target'"), ["holdout"], "label", "sample_id", SEED)
    assigned = kept.where("role = 'source'").select("holdout", "sample_id", F.lit("source_train").alias("partition")).unionByName(target.select("holdout", "sample_id", "partition"))
    nothing = gone.where("false").withColumn("reason", F.lit(""))
    return S.leaves(samples, cut(assigned, "assigned"), gone.withColumn("reason", F.lit("near_ood")), nothing, "sample_id", "region")


@query(
    f"""with {_S}, g as (select a.region as holdout, b.sample_id from s a join s b on a.region <> b.region and {GREAT_CIRCLE_KM} <= {KM}e0 group by 1, 2)
    select d.region as holdout, case when g.sample_id is null then 'assigned' else 'purged' end as status, case when g.sample_id is null then '' else 'near_ood' end as reason, count(*) as n
    from s cross join (select distinct region from s) d left join g on g.holdout = d.region and g.sample_id = s.sample_id group by 1, 2, 3"""
)
def d19_leaf_status(spark, sf_dir):
    return _leaves(spark, sf_dir).groupBy("holdout", "status", "reason").agg(F.count("*").alias("n"))


#: leaf rows with planted faults: an id twice, an unknown state, an assigned row without a part, a blank domain, a purge without a reason
_FAULTY = f"""select region as holdout, sample_id as stable_id, case when sample_id % 50 in (1, 2, 4, 6) then '' else 'source_train' end as partition, case sample_id % 50 when 1 then 'lost' when 4 then 'purged' when 6 then 'purged' else 'assigned' end as status,
    case when sample_id % 50 = 3 then ' ' else domain end as domain, case when sample_id % 50 in (1, 6) then 'near_ood' else '' end as reason from ({SAMPLES})"""
_TWICE = f"{_FAULTY} union all select region, sample_id, 'source_train', 'assigned', domain, '' from ({SAMPLES}) where sample_id % 50 = 5"


@query(f"with {_S} select region as holdout, sample_id as stable_id, case sample_id % 50 when 1 then 'status' when 2 then 'partition' when 3 then 'domain' when 4 then 'reason' else 'repeated' end as problem from s where sample_id % 50 between 1 and 5")
def d20_leaf_problems(spark, sf_dir):
    """The faults that were planted, and none in the leaves that the regimes made."""
    return S.leaf_problems(load(spark, sf_dir, _TWICE)).unionByName(S.leaf_problems(_leaves(spark, sf_dir)))


@query(f"with l as ({_FAULTY}), c as (select holdout, partition, status, domain, count(*) as c from l group by 1, 2, 3, 4) select holdout, partition, status, cast(sum(c) as bigint) as n, string_agg(domain || ':' || c, ',' order by domain) as domains from c group by 1, 2, 3")
def d21_leaf_summary(spark, sf_dir):
    found = S.leaf_summary(load(spark, sf_dir, _FAULTY), ["holdout"])
    listed = F.transform(F.map_entries("domains"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return found.withColumn("domains", F.array_join(listed, ","))


@query()
def d14_footprint_exclusion(spark, sf_dir):
    kept, _ = G.leave_one_out(_samples(spark, sf_dir), "sample_id", "domain", KM)
    hulls = G.footprints(kept.where("role = 'target'"))
    return G.in_footprint(kept.where("role = 'source'"), hulls, 50.0).groupBy("holdout").agg(F.count("*").alias("n_inside"))


@query()
def d15_spatial_clusters(spark, sf_dir):
    return G.cluster_cells(_samples(spark, sf_dir), "sample_id")


@query()
def d27_geography_audit(spark, sf_dir):
    kept, _ = G.leave_one_out(_samples(spark, sf_dir), "sample_id", "region", 5.0)
    target = kept.where("role = 'target'")
    return rounded(G.geography_audit(kept.where("role = 'source'"), target, G.footprints(target), "sample_id", 50.0, 200.0))


@query(f"with {_S} select region, label, count(*) as k, cast(count(distinct domain) as bigint) as n_domains from s group by 1, 2")
def d23_domain_counts(spark, sf_dir):
    return _samples(spark, sf_dir).groupBy("region", "label").agg(F.count("*").alias("k"), F.count_distinct("domain").alias("n_domains"))


@query(f"with {_S}, q as (select region, domain, count(distinct label) as k from s group by 1, 2) select region, count(*) as n_domains, cast(sum(case when k < 5 then 1 else 0 end) as bigint) as n_partial from q group by 1")
def d23_domain_census(spark, sf_dir):
    per = _samples(spark, sf_dir).groupBy("region", "domain").agg(F.count_distinct("label").alias("k"))
    return per.groupBy("region").agg(F.count("*").alias("n_domains"), F.sum(F.when(F.col("k") < 5, 1).otherwise(0)).alias("n_partial"))


_MADE = "select c_nationkey, c_mktsegment from {customer} where not (c_nationkey = 3 and c_mktsegment = 'BUILDING') group by 1, 2 union all select c_nationkey, c_mktsegment from {customer} where c_nationkey = 4 group by 1, 2 union all select 99, c_mktsegment from {customer} group by 2"


@query(f"with e as (select distinct c_nationkey, c_mktsegment from {{customer}}), r as (select c_nationkey, c_mktsegment, count(*) as c from ({_MADE}) group by 1, 2) select coalesce(e.c_nationkey, r.c_nationkey) as c_nationkey, coalesce(e.c_mktsegment, r.c_mktsegment) as c_mktsegment, case when c is null then 'missing' when e.c_nationkey is null then 'unexpected' else 'duplicate' end as problem from e full join r on e.c_nationkey = r.c_nationkey and e.c_mktsegment = r.c_mktsegment where c is null or c > 1 or e.c_nationkey is null")
def d17_coverage(spark, sf_dir):
    expected = load(spark, sf_dir, "select c_nationkey, c_mktsegment from {customer}")
    return S.coverage_problems(expected, load(spark, sf_dir, _MADE), ["c_nationkey", "c_mktsegment"])


@query("select cast(c_custkey as varchar) as id, 'region' as \"column\", r_name as frozen, 'EAST' as current from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey where r_name = 'ASIA'")
def d25_structure_drift(spark, sf_dir):
    frozen = load(spark, sf_dir, "select cast(c_custkey as string) as id, r_name as region from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey")
    current = frozen.withColumn("region", F.when(F.col("region") == "ASIA", "EAST").otherwise(F.col("region")))
    return S.structure_drift(frozen, current, "id", ["region"])


@query(f"with {_S}, {_systematic('s', 'region', 'label', 'fraction', 'q')}, n as (select region, count(*) as n from s group by 1) select q.region, sample_id from q join n on q.region = n.region where o < least(n - 1, greatest(2, cast(round_even(n * 25e-2, 0) as bigint)))")
def e1_stratified_fraction(spark, sf_dir):
    return B.stratified_fraction(_samples(spark, sf_dir), ["region"], "label", "sample_id", 0.25, SEED).select("region", "sample_id")


_CAP = 400


@query(
    f"""with {_S}, c as (select label, count(*) as c, sum(count(*)) over () as t from s group by label),
    q as (select label, c * {_CAP} // t as f, row_number() over (order by c * {_CAP} % t desc, label) as place, {_CAP} - sum(c * {_CAP} // t) over () as free from c),
    r as (select *, row_number() over (partition by label, domain order by {_h("cap", "sample_id")}, sample_id) - 1 as round_n, {_h("cap-group", "domain")} as gh from s),
    o as (select *, row_number() over (partition by label order by round_n, gh, sample_id) - 1 as o from r)
    select o.label, o.sample_id from o join q on o.label = q.label where o.o < f + case when place <= free then 1 else 0 end"""
)
def e4_capped_stratified(spark, sf_dir):
    return B.capped_stratified(_samples(spark, sf_dir), "label", "domain", "sample_id", _CAP, SEED).select("label", "sample_id")


@query(f"with px as ({PIXELS}), h as (select *, row_number() over (partition by cell, tile order by {_h('pixel', 'cell * 10 + tile', 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber) as k from px) select cell, tile, l_orderkey, l_linenumber from h where k <= 50")
def e8_patch_pixel_cap(spark, sf_dir):
    pixels = load(spark, sf_dir, PIXELS).withColumn("patch", (F.col("cell") * 10 + F.col("tile")).cast("int"))
    return B.patch_pixel_cap(pixels, "patch", ["l_orderkey", "l_linenumber"], 50, SEED).select("cell", "tile", "l_orderkey", "l_linenumber")


@query(f"with px as ({PIXELS}) select l_orderkey, l_linenumber from px order by {_h('sample', 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber limit 500")
def e7_exact_pixel_sample(spark, sf_dir):
    return B.exact_sample(load(spark, sf_dir, PIXELS), ["l_orderkey", "l_linenumber"], 500, SEED).select("l_orderkey", "l_linenumber")


_ASSIGN = f"x as (select region, label, sample_id, case sample_id % 10 when 0 then 'target_test' when 1 then 'target_label_pool' when 2 then 'target_label_pool' else 'source_train' end as partition from s)"
_ACCESS = f"ac as (select region, sample_id as stable_id, label, case partition when 'source_train' then 'source' when 'target_test' then 'test' else 'target' end as population, row_number() over (partition by region, partition order by {_h('label-access', 'sample_id')}, sample_id) - 1 as o from x)"


def _access(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    part = F.when(F.col("sample_id") % 10 == 0, "target_test").when(F.col("sample_id") % 10 <= 2, "target_label_pool").otherwise("source_train")
    return B.label_access(rows.withColumn("partition", part), ["region"], "sample_id", SEED), rows


@query(f"with {_S}, {_ASSIGN}, {_ACCESS} select region, stable_id, population, case when population = 'source' then cast(o as bigint) end as source_rank, case when population = 'target' then cast(o as bigint) end as target_rank from ac")
def e9_label_access(spark, sf_dir):
    return _access(spark, sf_dir)[0]


@query("select * from (values ('AFRICA', 'source', 'ranks are not contiguous'), ('ASIA', 'target', 'wrong column'), ('EUROPE', 'test', 'id in two places')) as t(region, population, problem)")
def e10_label_access_problems(spark, sf_dir):
    """Planted: a region without its first rank, one with ranks in the other column, one with a test id twice."""
    access = cut(_access(spark, sf_dir)[0], "access")
    bad = access.where("not (region = 'AFRICA' and population = 'source' and source_rank = 0)")
    swap = (F.col("region") == "ASIA") & (F.col("population") == "target")
    bad = bad.withColumns({"source_rank": F.when(swap, F.col("target_rank")).otherwise(F.col("source_rank")), "target_rank": F.when(~swap, F.col("target_rank"))})
    twice = access.where("region = 'EUROPE' and population = 'test'").groupBy("region", "population").agg(F.min("stable_id").alias("stable_id"))
    return B.label_access_problems(bad.unionByName(twice, allowMissingColumns=True), ["region"])


_POOLS = "po as (select region, 0 as seed, sum(case when partition = 'source_train' then 1 else 0 end) as n_source, sum(case when partition = 'target_label_pool' then 1 else 0 end) as n_target from x group by 1)"


def _pools(spark, sf_dir):
    access = _access(spark, sf_dir)[0]
    on = lambda p: F.sum(F.when(F.col("population") == p, 1).otherwise(0))
    return access.groupBy("region").agg(F.lit(0).alias("seed"), on("source").alias("n_source"), on("target").alias("n_target"))


@query(f"with {_S}, {_ASSIGN}, {_POOLS} select region, n_target >= 60 and n_source >= 60 as eligible from po")
def e11_region_eligibility(spark, sf_dir):
    return B.region_eligibility(_pools(spark, sf_dir), 60).select("region", "eligible")


@query(f"with {_S}, {_ASSIGN}, {_POOLS} select cast(least(min(n_source), min(n_target), 200) as bigint) as budget from po where n_target >= 40 and n_source >= 40")
def e12_benchmark_budget(spark, sf_dir):
    pools = _pools(spark, sf_dir)
    return B.benchmark_budget(pools, B.region_eligibility(pools, 40), 200)


_BUDGET = 50


@query(
    f"""with {_S}, {_ASSIGN}, {_ACCESS}, rt as (select * from (values {", ".join(f"('allocation@{f}', {100 - f}, {f}, 'budget')" for f in (0, 25, 50, 75, 100))}, {", ".join(f"('source_plus_target@{f}', 100, {f}, 'pool')" for f in (5, 10, 25, 50))}, ('source_full', 100, 0, 'pool'), ('target_full', 0, 100, 'pool')) as t(route, sp, tp, kind)),
    z as (select region, population, count(*) as n from ac group by 1, 2),
    g as (select ac.region, route, population, stable_id, o, case when kind = 'budget' then case when population = 'target' then floor({_BUDGET} * tp / 100e0 + 5e-1) else {_BUDGET} - floor({_BUDGET} * tp / 100e0 + 5e-1) end else floor(n * case when population = 'source' then sp else tp end / 100e0 + 5e-1) end as k
        from ac join z using (region, population) cross join rt where population <> 'test')
    select region, route, population, stable_id from g where o < k"""
)
def e15_route_sizes(spark, sf_dir):
    members = B.route_members(_access(spark, sf_dir)[0], ["region"], B.route_table(spark), _BUDGET)
    return members.select("region", "route", "population", "stable_id")


@query(
    f"""with {_S}, {_ASSIGN}, {_ACCESS}, g as (select percent, floor(percent / 100e0 * {_BUDGET} + 5e-1) as k from (values (0), (25), (50), (75), (100)) as t(percent)),
    d as (select region, percent, label from ac cross join g where population <> 'test' and o < case when population = 'target' then k else {_BUDGET} - k end)
    select region, cast(percent as int) as percent, count(*) as n, count(distinct label) as n_classes, count(*) = {_BUDGET} and count(distinct label) >= 2 as ok from d group by 1, 2"""
)
def e14_allocation_audit(spark, sf_dir):
    access, rows = _access(spark, sf_dir)
    return B.allocation_audit(access, rows, ["region"], "sample_id", "label", _BUDGET)


@query(f"with {_S}, {_ASSIGN}, y as (select * from x where partition = 'source_train'), {_systematic('y', 'region', 'label', 'sweep', 'q')}, n as (select region, count(*) as n from y group by 1), f as (select * from (values (1e-1), (5e-1), (1e0)) as t(fraction)) select q.region, fraction, sample_id from q join n on q.region = n.region cross join f where o < case when fraction >= 1 then n else least(n - 1, greatest(2, cast(round_even(n * fraction, 0) as bigint))) end")
def e17_source_budget_sweep(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    part = F.when(F.col("sample_id") % 10 == 0, "target_test").when(F.col("sample_id") % 10 <= 2, "target_label_pool").otherwise("source_train")
    swept = B.budget_sweep(rows.withColumn("partition", part), ["region"], "label", "sample_id", (0.1, 0.5, 1.0), SEED)
    return swept.select("region", "fraction", "sample_id")


@query(f"with {_S}, {_ASSIGN}, {_POOLS}, b as (select * from (values (0e0), (5e0), (2e-1), (-1e0)) as t(budget)), g as (select region, budget, 'source' as origin, n_source as n from po cross join b where budget <> -1 union all select region, budget, 'target', case when budget = -1 then n_target when budget = 0 then 0 when budget < 1 then greatest(1, cast(round_even(n_target * budget, 0) as bigint)) else least(n_target, cast(budget as bigint)) end from po cross join b) select region, budget, origin, cast(n as bigint) as n from g where n > 0")
def e18_target_budget_sweep(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    part = F.when(F.col("sample_id") % 10 == 0, "target_test").when(F.col("sample_id") % 10 <= 2, "target_label_pool").otherwise("source_train")
    swept = B.target_sweep(rows.withColumn("partition", part), ["region"], "label", "sample_id", (0, 5, 0.2, -1), SEED)
    return swept.groupBy("region", "budget", "origin").agg(F.count("*").alias("n"))


@query(f"with {_S} select region, count(*) as n from s group by 1")
def d29_domain_basis(spark, sf_dir):
    return sized(_samples(spark, sf_dir), ["region"], "n").select("region", "n").distinct()
