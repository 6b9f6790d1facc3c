"""Label budgets: exact subsamples, nested frozen orders, routes as membership tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.functions.columns import half_up, hash_order
from farfield.operators.ranks import hash_range, ranked, shuffled, sized, systematic_order


def fraction_count(n: Column, fraction: float) -> Column:
    """How many of n rows a fraction takes: all from 1 on, else at least 2 and fewer than n."""
    if fraction >= 1:
        return n
    return F.least(n - 1, F.greatest(F.lit(2), F.bround(n * fraction, 0).cast("long")))


def target_count(n: Column, budget: float) -> Column:
    """A budget under 1 is a share of the pool (one row at least), from 1 on a number of rows."""
    return F.greatest(F.lit(1), F.bround(n * budget, 0).cast("long")) if 0 < budget < 1 else F.least(n, F.lit(int(budget)))


def allocation_count(total: Column, percent: int) -> Column:
    return half_up(total * percent / F.lit(100))


def stratified_fraction(df: DataFrame, by: list[str], label: str, key: str, fraction: float, seed: int) -> DataFrame:
    """An exact stratified share of each group."""
    order = systematic_order(sized(df, by, "__n"), by, [label], seed, "fraction", key, "__o")
    return order.where(F.col("__o") < fraction_count(F.col("__n"), fraction)).drop("__o", "__n")


def capped_stratified(df: DataFrame, label: str, group: str, key: str, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows: classes by largest remainder, and within a class round by round over the groups."""
    counts = df.groupBy(label).agg(F.count("*").alias("__c"))
    total = df.agg(F.count("*").alias("__t"))
    quota = counts.crossJoin(F.broadcast(total)).withColumn("__cap", F.least(F.lit(cap), F.col("__t")))
    quota = quota.withColumn("__floor", F.expr("__c * __cap div __t")).withColumn("__rest", F.expr("__c * __cap % __t"))
    left = quota.agg((F.max("__cap") - F.sum("__floor")).alias("__left"))
    # as many rows as classes: the classes with the largest remainders take one more
    places = quota.select(label, "__floor", F.row_number().over(_small().orderBy(F.desc("__rest"), label)).alias("__place")).crossJoin(F.broadcast(left))
    places = places.select(label, (F.col("__floor") + F.when(F.col("__place") <= F.col("__left"), 1).otherwise(0)).alias("__quota"))
    rounds = shuffled(df, [label, group], seed, "cap", key, "__round").withColumn("__g", hash_order(seed, "cap-group", F.col(group)))
    order = ranked(rounds, [label], ["__round", "__g", key], F.floor(F.log2(F.col("__round") + 1)).cast("int"), "__o")
    return order.join(F.broadcast(places), label).where("__o < __quota").drop("__round", "__g", "__o", "__quota")


def _small():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def cap_description(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """(n_before, n_after, per_class): per_class reads ``class:n;class:n``."""
    per = after.groupBy(label).agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(label).alias("c"), "n"))), lambda x: F.concat(x["c"].cast("string"), F.lit(":"), x["n"].cast("string"))), ";")
    sizes = before.agg(F.count("*").alias("n_before")).crossJoin(after.agg(F.count("*").alias("n_after")))
    return sizes.crossJoin(per.agg(text.alias("per_class")))


def patch_pixel_cap(df: DataFrame, patch: str, key: list[str], cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows of each patch, by a hash of seed, patch and pixel alone."""
    rows = df.withColumn("__h", hash_order(seed, "pixel", F.col(patch), *map(F.col, key)))
    return ranked(rows, [patch], ["__h", *key], hash_range("__h"), "__o").where(F.col("__o") < cap).drop("__h", "__o")


def exact_sample(df: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (all if there are fewer) by hash order."""
    rows = df.withColumn("__h", hash_order(seed, "sample", *map(F.col, key)))
    return rows.orderBy("__h", *key).limit(n).drop("__h")


def label_access(assignments: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """(by, stable_id, population, source_rank, target_rank): one frozen order for each pool that sees no label; the test has no rank."""
    names = F.create_map(*[F.lit(x) for kv in {"source_train": "source", "target_label_pool": "target", "target_test": "test"}.items() for x in kv])
    rows = assignments.withColumn("population", names[F.col("partition")]).where("population is not null").select(*by, F.col(key).alias("stable_id"), "population")
    order = shuffled(rows, [*by, "population"], seed, "label-access", "stable_id", "__o")
    rank = lambda p: F.when(F.col("population") == p, F.col("__o"))
    return order.select(*by, "stable_id", "population", rank("source").alias("source_rank"), rank("target").alias("target_rank"))


def label_access_problems(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, population, problem): ranks that don't run from 0 to n - 1, ranks in the wrong column, ids that come twice."""
    r = F.coalesce("source_rank", "target_rank")
    per = rows.groupBy(*by, "population").agg(
        F.count("*").alias("n"), F.count_distinct(r).alias("d"), F.min(r).alias("lo"), F.max(r).alias("hi"), F.count("source_rank").alias("s"), F.count("target_rank").alias("t")
    )
    ranked_ok = (F.col("d") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)
    columns_ok = F.when(F.col("population") == "source", (F.col("s") == F.col("n")) & (F.col("t") == 0)).when(F.col("population") == "target", (F.col("t") == F.col("n")) & (F.col("s") == 0)).otherwise((F.col("s") == 0) & (F.col("t") == 0))
    problem = F.when(~columns_ok, "wrong column").when((F.col("population") != "test") & ~ranked_ok, "ranks are not contiguous")
    twice = rows.groupBy(*by, "stable_id").agg(F.count("*").alias("n"), F.min("population").alias("population")).where("n > 1").select(*by, "population", F.lit("id in two places").alias("problem"))
    return per.select(*by, "population", problem.alias("problem")).where("problem is not null").unionByName(twice)


def region_eligibility(pools: DataFrame, minimum: int) -> DataFrame:
    """(region, eligible, reasons) from (region, seed, n_source, n_target): all seeds of a region qualify or none."""
    bad = F.when(F.col("n_target") < minimum, F.concat_ws(" ", F.lit("seed"), "seed", F.lit("target"), "n_target")).when(F.col("n_source") < minimum, F.concat_ws(" ", F.lit("seed"), "seed", F.lit("source"), "n_source"))
    return pools.withColumn("__bad", bad).groupBy("region").agg(F.bool_and(F.col("__bad").isNull()).alias("eligible"), F.array_sort(F.collect_list("__bad")).alias("reasons"))


def benchmark_budget(pools: DataFrame, eligible: DataFrame, cap: int) -> DataFrame:
    """(budget): the least pool of the eligible regions, at most ``cap``."""
    held = pools.join(eligible.where("eligible").select("region"), "region")
    return held.agg(F.least(F.min("n_source"), F.min("n_target"), F.lit(cap).cast("long")).alias("budget"))


def route_table(spark, budget_percents=(0, 25, 50, 75, 100), additive_percents=(5, 10, 25, 50)) -> DataFrame:
    """(route, source_percent, target_percent, of): how each route draws from the two ranked pools; ``of`` is budget or pool."""
    rows = [(f"allocation@{f}", 100 - f, f, "budget") for f in budget_percents]
    rows += [(f"source_plus_target@{f}", 100, f, "pool") for f in additive_percents]
    rows += [("source_full", 100, 0, "pool"), ("target_full", 0, 100, "pool")]
    return spark.createDataFrame(rows, "route string, source_percent int, target_percent int, of string")


def route_members(access: DataFrame, by: list[str], routes: DataFrame, budget: int) -> DataFrame:
    """(by, route, stable_id, population): the training set of each route, a prefix of each frozen order."""
    pools = access.where("population != 'test'").withColumn("__r", F.coalesce("source_rank", "target_rank"))
    sizes = pools.groupBy(*by, "population").agg(F.count("*").alias("__n"))
    base = pools.join(sizes, [*by, "population"]).crossJoin(F.broadcast(routes))
    percent = F.when(F.col("population") == "source", F.col("source_percent")).otherwise(F.col("target_percent"))
    target = half_up(F.lit(budget) * F.col("target_percent") / 100)
    of_budget = F.when(F.col("population") == "target", target).otherwise(F.lit(budget) - target)
    k = F.when(F.col("of") == "budget", of_budget).otherwise(half_up(F.col("__n") * percent / 100))
    return base.where(F.col("__r") < k).select(*by, "route", "stable_id", "population")


def allocation_audit(access: DataFrame, labels: DataFrame, by: list[str], key: str, label: str, budget: int, percents=(0, 25, 50, 75, 100)) -> DataFrame:
    """(by, percent, n, n_classes, ok): each mixed prefix can be drawn and holds two classes or more."""
    rows = access.where("population != 'test'").join(labels.select(F.col(key).alias("stable_id"), F.col(label).alias("__y")), "stable_id")
    grid = access.sparkSession.createDataFrame([(p, int(p / 100 * budget + 0.5)) for p in percents], "percent int, k long")
    r = F.coalesce("source_rank", "target_rank")
    k = F.when(F.col("population") == "target", F.col("k")).otherwise(F.lit(budget) - F.col("k"))
    drawn = rows.crossJoin(F.broadcast(grid)).where(r < k)
    return drawn.groupBy(*by, "percent").agg(F.count("*").alias("n"), F.count_distinct("__y").alias("n_classes")).withColumn("ok", (F.col("n") == budget) & (F.col("n_classes") >= 2))


def budget_sweep(assignments: DataFrame, by: list[str], label: str, key: str, fractions: tuple[float, ...], seed: int) -> DataFrame:
    """(by, fraction, key): nested stratified shares of ``source_train``."""
    rows = sized(assignments.where("partition = 'source_train'"), by, "__n")
    order = systematic_order(rows, by, [label], seed, "sweep", key, "__o")
    k = F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), fraction_count(F.col("__n"), f).alias("k")) for f in fractions]))
    return order.withColumn("__z", k).where(F.col("__o") < F.col("__z.k")).select(*by, F.col("__z.fraction").alias("fraction"), key)


def target_sweep(assignments: DataFrame, by: list[str], label: str, key: str, budgets: tuple[float, ...], seed: int) -> DataFrame:
    """(by, budget, key, origin): 0 is the source alone, -1 the target pool alone, others add a nested target prefix."""
    source = assignments.where("partition = 'source_train'").select(*by, key)
    pool = sized(assignments.where("partition = 'target_label_pool'"), by, "__n")
    order = systematic_order(pool, by, [label], seed, "target-sweep", key, "__o")
    out = None
    for b in budgets:
        few = order if b == -1 else order.where(F.col("__o") < target_count(F.col("__n"), b)) if b else order.where("false")
        part = few.select(*by, F.lit(float(b)).alias("budget"), key, F.lit("target").alias("origin"))
        if b != -1:
            part = part.unionByName(source.select(*by, F.lit(float(b)).alias("budget"), key, F.lit("source").alias("origin")))
        out = part if out is None else out.unionByName(part)
    return out
