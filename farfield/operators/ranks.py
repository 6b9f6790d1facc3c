"""Exact ranks over very large groups, in two levels: over ranges of the sort key, and within each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farfield.functions.columns import hash_order


def hash_range(h: str | Column) -> Column:
    """The range (0 to 4095) of a hexadecimal sort key; ranges ascend with the key."""
    return F.conv(F.substring(h, 1, 3), 16, 10).cast("int")


def unit_range(x: str | Column, ranges: int = 4096) -> Column:
    """The range of a sort key in [0, 1]."""
    return F.floor((F.col(x) if isinstance(x, str) else x) * ranges).cast("int")


def ranked(df: DataFrame, by: list[str], order: list[str], spread: Column, name: str = "rank") -> DataFrame:
    """Adds the 0-based rank of each row among the rows with equal ``by``, in ``order``; ``spread`` ascends with the order.

    No task sees more than one range of a group.
    """
    df = df.withColumn("__spread", spread)
    counts = df.groupBy(*by, "__spread").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*by).orderBy("__spread").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__spread", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    inner = Window.partitionBy(*by, "__spread").orderBy(*order)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*by, "__spread"]]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    local = df.withColumn("__local", F.row_number().over(inner) - 1)
    joined = local.alias("a").join(offsets.alias("b"), condition)
    return joined.select("a.*", (F.col("b.__before") + F.col("a.__local")).cast("long").alias(name)).drop("__spread", "__local")


def sized(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds the number of rows with equal ``by`` (all rows if there is none), aggregated before the shuffle."""
    if not by:
        return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))
    return df.join(df.groupBy(*by).agg(F.count("*").alias(name)), by)


def shuffled(df: DataFrame, by: list[str], seed: int | str, operation: str, key: str, name: str = "rank") -> DataFrame:
    """Adds the rank of each row in the hash order of its group: a seeded permutation."""
    return ranked(df.withColumn("__h", hash_order(seed, operation, F.col(key))), by, ["__h", key], hash_range("__h"), name).drop("__h")


def systematic_order(df: DataFrame, by: list[str], stratum: list[str], seed: int | str, operation: str, key: str, name: str = "rank") -> DataFrame:
    """Adds a rank under which every prefix holds each stratum within one of its share.

    Rows are shuffled within their stratum; row k of n sorts at (k + 0.5) / n, then by stratum and key.
    """
    slots = sized(shuffled(df, [*by, *stratum], seed, operation, key, "__slot"), [*by, *stratum], "__strata")
    slots = slots.withColumn("__at", (F.col("__slot") + 0.5) / F.col("__strata"))
    return ranked(slots, by, ["__at", *stratum, key], unit_range("__at"), name).drop("__slot", "__strata", "__at")
