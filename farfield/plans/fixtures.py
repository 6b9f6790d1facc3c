"""Tables in the shapes the operators expect, derived from the given tables by SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: one scored sample a row: cell, group, truth, probability, predictions at two cuts
BINARY = """select sample_id, cell, grp, y_true, prob, case when prob >= 5e-1 then 1 else 0 end as pred_default, case when prob >= 6e-1 then 1 else 0 end as pred_calibrated from (
    select l.doc_id as sample_id, d.lang as cell, d.source as grp, l.quality as y_true, cast(l.quality * 300 + (l.doc_id * 7919) % 700 as double) / 1e3 as prob
    from {labels} l join {documents} d on l.doc_id = d.doc_id)"""

#: probabilities of classes 0 to 7 where truth has 0 to 9
_WEIGHT = "(((vec_id * {k} * 31) % 97) + 1 + case when label = {i} then 60 else 0 end)"
_WEIGHTS = [_WEIGHT.replace("{k}", str(i + 3)).replace("{i}", str(i)) for i in range(8)]
MULTI = (
    "select vec_id as sample_id, vec_id % 5 as cell, cast(vec_id % 3 as int) as grp, label as y_true, "
    + ", ".join(f"cast({w} as double) / ({' + '.join(_WEIGHTS)}) as p{i}" for i, w in enumerate(_WEIGHTS))
    + " from {embeddings}"
)

#: dense predictions: a patch of orders, a tile, truth and prediction as class codes
PIXELS = """select cast(l_orderkey % 4 as int) as cell, cast(l_linenumber % 4 as int) as tile, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as y_true,
    case when l_partkey % 5 = 0 then 3 when l_linestatus = 'O' then 1 when l_suppkey % 2 = 0 then 0 else 2 end as pred, l_orderkey, l_linenumber from {lineitem}"""

#: located samples with a class and a domain
SAMPLES = """select c.c_custkey as sample_id, n.n_name as domain, r.r_name as region, c.c_mktsegment as label,
    cast((c.c_custkey * 3701) % 12000 as double) / 1e2 - 6e1 as lat, cast((c.c_custkey * 9101) % 36000 as double) / 1e2 - 18e1 as lon
    from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey"""

#: acquisitions: a sample's dated values of three bands
ACQUISITIONS = """select o.o_custkey as sample_id, o.o_orderdate as t, l.l_quantity as b4, l.l_extendedprice as b8, l.l_discount as b11
    from {orders} o join {lineitem} l on o.o_orderkey = l.l_orderkey"""


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def plain(sql: str) -> str:
    """The same SQL over views named as the tables."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` decimals, so that the order of summation doesn't show."""
    from pyspark.sql import functions as F

    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
