"""Deterministic, exact-size train, validation and test splits, and the checks that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.functions.columns import ceil_div, hash_order
from farfield.operators.allocation import allocate
from farfield.operators.ranks import ranked, shuffled, sized, systematic_order
from farfield.sources.scratch import cut


def source_sizes(n: int) -> tuple[int, int, int]:
    """(train, val, test): a tenth each for val and test, rounded up."""
    part = -(-n // 10)
    if n - 2 * part <= 0:
        raise ValueError(f"{n} samples are too few for three parts")
    return n - 2 * part, part, part


def target_sizes(n: int) -> tuple[int, int]:
    """(pool, test): a fifth, rounded up, for the test."""
    test = -(-n // 5)
    if n - test <= 0:
        raise ValueError(f"{n} samples are too few for two parts")
    return n - test, test


def official_sizes(n: int) -> tuple[int, int]:
    """(train, val): a tenth, rounded down, for val."""
    if n - n // 10 <= 0:
        raise ValueError(f"{n} samples are too few")
    return n - n // 10, n // 10


def partition_target(df: DataFrame, by: list[str], label: str, key: str, seed: int) -> DataFrame:
    """Adds partition: ``target_label_pool`` or ``target_test``, 80 to 20 in exact sizes for each ``by``.

    A class with one row goes to the test; of every other class one row is kept for each side, and the rest follows the
    systematic order over classes. Raises where the sides can't hold what they must.
    """
    rows = sized(shuffled(df, [*by, label], seed, "target-reserve", key, "__r"), [*by, label], "__k")
    rows = rows.withColumn("__side", F.when(F.col("__k") == 1, "target_test").when(F.col("__r") == 0, "target_label_pool").when(F.col("__r") == 1, "target_test"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.sum(F.when(F.col("__side") == "target_test", 1).otherwise(0)).alias("__t"), F.sum(F.when(F.col("__side") == "target_label_pool", 1).otherwise(0)).alias("__p"))
    test = ceil_div(F.col("__n"), 5)
    fits = (F.col("__t") <= test) & (F.col("__p") <= F.col("__n") - test)
    sizes = sizes.withColumn("__left", F.when(fits, F.col("__n") - test - F.col("__p")).otherwise(F.raise_error(F.lit("a side is too small for its reserved classes")).cast("long")))
    held = rows.where(F.col("__side").isNotNull()).withColumnRenamed("__side", "partition").drop("__r", "__k")
    free = systematic_order(rows.where(F.col("__side").isNull()).drop("__side", "__r", "__k"), by, [label], seed, "target-order", key, "__o")
    sizes = sizes.select(*by, "__left")
    free = free.join(sizes, by) if by else free.crossJoin(F.broadcast(sizes))
    free = free.withColumn("partition", F.when(F.col("__o") < F.col("__left"), "target_label_pool").otherwise("target_test")).drop("__o", "__left")
    return held.unionByName(free)


def partition_source(df: DataFrame, label: str, region: str, key: str, seed: int, names: tuple[str, ...] = ("source_train", "source_val", "source_test"), sizes: tuple[int, ...] | None = None) -> DataFrame:
    """Adds partition: exact sizes, with each class and each region within one of its quota in every part.

    Only the table of (class, region) counts reaches the driver; rows are dealt out by their hash order in the cell.
    """
    counts = {(r[0], r[1]): r[2] for r in df.groupBy(label, region).agg(F.count("*")).collect()}
    total = sum(counts.values())
    share = allocate(counts, sizes or source_sizes(total))
    spark = df.sparkSession
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    bounds = spark.createDataFrame([(*c, *[sum(x[: i + 1]) for i in range(len(x))]) for c, x in share.items()], f"__l {fields[label]}, __g {fields[region]}, " + ", ".join(f"__b{i} long" for i in range(len(names))))
    rows = shuffled(df, [label, region], seed, "source", key, "__o")
    rows = rows.join(F.broadcast(bounds), F.col(label).eqNullSafe(F.col("__l")) & F.col(region).eqNullSafe(F.col("__g")))
    part: Column = F.lit(names[-1])
    for i in range(len(names) - 2, -1, -1):
        part = F.when(F.col("__o") < F.col(f"__b{i}"), names[i]).otherwise(part)
    return rows.withColumn("partition", part).drop("__l", "__g", "__o", *[f"__b{i}" for i in range(len(names))])


def marginal_problems(df: DataFrame, attribute: str, partition: str = "partition") -> DataFrame:
    """(value, partition, n, low, high): values whose count in a part lies outside floor and ceiling of the quota."""
    total = df.agg(F.count("*").alias("total"))
    sizes = df.groupBy(partition).agg(F.count("*").alias("cap"))
    values = df.groupBy(F.col(attribute).alias("value")).agg(F.count("*").alias("nv"))
    have = df.groupBy(F.col(attribute).alias("value"), partition).agg(F.count("*").alias("n"))
    grid = values.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(total)).join(have, ["value", partition], "left").fillna(0, ["n"])
    quota = F.col("nv") * F.col("cap")
    low, high = F.expr("nv * cap div total"), F.expr("(nv * cap + total - 1) div total")
    del quota
    return grid.select("value", partition, "n", low.alias("low"), high.alias("high")).where("n < low or n > high")


def rarest_label(df: DataFrame, labels: str, key: str) -> DataFrame:
    """(key, stratum): the label of each row's set that the fewest rows have; the least label on ties."""
    long = df.select(key, F.explode(labels).alias("label"))
    counts = long.groupBy("label").agg(F.count("*").alias("c"))
    return long.join(counts, "label").groupBy(key).agg(F.min(F.struct("c", "label"))["label"].alias("stratum"))


def partition_by_rarest(df: DataFrame, labels: str, key: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """Adds partition: label sets dealt out at exact sizes, by the systematic order over each row's rarest label."""
    rows = df.join(rarest_label(df, labels, key), key, "left")
    order = systematic_order(rows, [], ["stratum"], seed, "multilabel", key, "__o")
    part, start = F.lit(None).cast("string"), 0
    for name, n in sizes.items():
        part = F.when((F.col("__o") >= start) & (F.col("__o") < start + n), name).otherwise(part)
        start += n
    return order.withColumn("partition", part).drop("__o", "stratum")


def dealt(count: int, wants: dict[str, float], room: dict[str, int]) -> dict[str, int]:
    """How many of ``count`` rows each part gets, if they go one by one to the part that wants most and has room.

    Parts are brought down to one level of what they still want, and the few rows left go one by one; on ties to the part
    with more room, then to the first.
    """
    low, high = min(wants.values()) - count - 1, max(wants.values())
    fill = lambda level: {p: max(0, min(room[p], int(-(-(wants[p] - level) // 1)))) for p in wants}
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if sum(fill(middle).values()) <= count else (middle, high)
    got = fill(high)
    for _ in range(count - sum(got.values())):
        best = max((p for p in wants if got[p] < room[p]), key=lambda p: (wants[p] - got[p], room[p] - got[p]))
        got[best] += 1
    return got


def _by_labels(rows: DataFrame, label, rarest: list, key: str, seed: int) -> DataFrame:
    """Adds __o: the place of each row by its two rarest labels besides ``label``, then by hash."""
    none = len(rarest)
    if none:
        place = F.create_map(*[F.lit(x) for k, v in enumerate(rarest) for x in (v, k)])
        others = F.array_sort(F.transform(F.filter("__set", lambda x: x != F.lit(label)), lambda x: place[x]))
    else:
        others = F.array().cast("array<int>")
    rows = rows.withColumns({"__a": F.coalesce(F.get(others, F.lit(0)), F.lit(none)), "__b": F.coalesce(F.get(others, F.lit(1)), F.lit(none)), "__h": hash_order(seed, "multilabel", F.col(key))})
    spread = (F.col("__a") * (none + 1) + F.col("__b")) * 256 + F.conv(F.substring("__h", 1, 2), 16, 10).cast("int")
    return ranked(rows, [], ["__a", "__b", "__h", key], spread, "__o").drop("__a", "__b", "__h")


def _spread(place: Column, n: int, got: dict[str, int], seed: int) -> Column:
    """The part of each place below ``n``: parts have ``got`` places each, as evenly spaced as can be, smallest parts first."""
    parts = sorted(got, key=lambda p: (got[p], p))
    out = F.lit(None).cast("string")
    for k, p in enumerate(parts[:-1]):
        start = (seed * 7919 + k * 104729) % n
        before, after = (F.call_function("div", x * got[p] + start, F.lit(n)) for x in (place, place + 1))
        out = F.when(out.isNotNull(), out).when(after > before, p)
        place, n = place - before, n - got[p]
        if n == 0:
            return out
    return F.coalesce(out, F.lit(parts[-1]))


def partition_multilabel(df: DataFrame, labels: str, key: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """Adds partition: iterative stratification of label sets at exact sizes.

    In each round the label that the fewest rows without a part have (on ties the least) is dealt out: the parts that want
    most of it get its rows, spread evenly over an order in which rows with the same next rarest labels stand together. What
    parts want of all labels follows from what they got. Rows without labels come last. A round works on the rows of one label and leaves
    the rest as they are; only counts by label and part reach the driver. Rows are as many as the sizes together, or it raises.
    """
    rows = df.withColumn("__set", F.array_sort(F.array_distinct(F.coalesce(labels, F.array().cast(df.schema[labels].dataType)))))
    rows = cut(rows, "unplaced")
    total = rows.count()
    if total != sum(sizes.values()):
        raise ValueError(f"the sizes sum to {sum(sizes.values())}, the rows are {total}")
    left = {r["label"]: r["n"] for r in rows.select(F.explode("__set").alias("label")).groupBy("label").agg(F.count("*").alias("n")).collect()}
    wants = {label: {p: n * size / max(1, total) for p, size in sizes.items()} for label, n in left.items()}
    room = dict(sizes)
    done = None
    while total:
        label = min((x for x in left if left[x]), key=lambda x: (left[x], x), default=None)
        has = F.array_contains("__set", F.lit(label)) if label is not None else F.lit(True)
        now = rows.where(has)
        n = left[label] if label is not None else total
        got = dealt(n, wants[label] if label is not None else {p: float(r) for p, r in room.items()}, room)
        order = _by_labels(now, label, sorted((x for x in left if left[x]), key=lambda x: (left[x], x)), key, seed)
        part = _spread(F.col("__o"), n, got, seed)
        placed = cut(order.withColumn("partition", part).drop("__o"), "placed")
        for p, k in got.items():
            room[p] -= k
        for r in placed.select("partition", F.explode("__set").alias("label")).groupBy("partition", "label").agg(F.count("*").alias("n")).collect():
            wants[r["label"]][r["partition"]] -= r["n"]
            left[r["label"]] -= r["n"]
        done = placed if done is None else done.unionByName(placed)
        total -= n
        if total:
            rows = cut(rows.where(~has), "unplaced")
    if done is None:
        done = rows.withColumn("partition", F.lit(None).cast("string"))
    return done.drop("__set")


def random_split(df: DataFrame, label: str, region: str, key: str, seed: int) -> DataFrame:
    """The whole population as source parts, no target."""
    return partition_source(df, label, region, key, seed)


def official_anchor(df: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """(key, holdout, partition) from release lists (holdout, role, key); ids that the population lacks are dropped."""
    names = F.create_map(*[F.lit(x) for kv in {"train": "source_train", "val": "source_val", "test": "target_test"}.items() for x in kv])
    return splits.join(df.select(key).distinct(), key).select(key, "holdout", names[F.col("role")].alias("partition")).where("partition is not null")


def leaves(population: DataFrame, assigned: DataFrame, purged: DataFrame, excluded: DataFrame, key: str, domain: str) -> DataFrame:
    """(holdout, stable_id, partition, status, domain, reason): every unit once, as assigned, purged or excluded.

    A unit that a holdout doesn't mention is excluded: for want of a domain or of coordinates, or as unassigned.
    """
    holdouts = assigned.select("holdout").distinct()
    base = population.select(F.col(key).alias("stable_id"), F.col(domain).alias("domain"), "lat", "lon").crossJoin(F.broadcast(holdouts))
    marks = [x.select("holdout", F.col(key).alias("stable_id"), F.col(c).alias(n)) for x, c, n in ((assigned, "partition", "partition"), (purged, "reason", "purge"), (excluded, "reason", "why"))]
    out = base
    for m in marks:
        out = out.join(m, ["holdout", "stable_id"], "left")
    status = F.when(F.col("partition").isNotNull(), "assigned").when(F.col("purge").isNotNull(), "purged").otherwise("excluded")
    unknown = F.when(F.col("domain").isNull() | F.col("domain").isin("unknown", "nan", ""), "unknown_domain")
    nowhere = F.when(F.col("lat").isNull() | F.col("lon").isNull() | F.isnan("lat") | F.isnan("lon"), "no_coords")
    reason = F.when(status == "assigned", "").when(status == "purged", F.col("purge")).otherwise(F.coalesce("why", unknown, nowhere, F.lit("unassigned")))
    return out.select("holdout", "stable_id", F.coalesce("partition", F.lit("")).alias("partition"), status.alias("status"), "domain", reason.alias("reason"))


def leaf_problems(rows: DataFrame) -> DataFrame:
    """(holdout, stable_id, problem): repeated ids, unknown states, parts that don't go with the state, blank fields."""
    rules = {
        "status": "status is null or status not in ('assigned', 'purged', 'excluded')",
        "partition": "(status = 'assigned') != (partition in ('source_train', 'source_val', 'source_test', 'target_label_pool', 'target_test'))",
        "domain": "domain is null or trim(domain) = ''",
        "reason": "status != 'assigned' and (reason is null or trim(reason) = '')",
    }
    per = rows.groupBy("holdout", "stable_id").agg(F.count("*").alias("n"), *[F.max(F.when(F.expr(rule), F.lit(name))).alias(f"p_{name}") for name, rule in rules.items()])
    problems = F.filter(F.array(F.when(F.col("n") > 1, F.lit("repeated")), *[F.col(f"p_{name}") for name in rules]), lambda x: x.isNotNull())
    return per.select("holdout", "stable_id", F.explode(problems).alias("problem"))


def leaf_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, partition, status, n, domains): counts, and the count of each domain as a map."""
    per = rows.groupBy(*by, "partition", "status", "domain").agg(F.count("*").alias("c"))
    return per.groupBy(*by, "partition", "status").agg(F.sum("c").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("domain", "c")))).alias("domains"))


def coverage_problems(expected: DataFrame, realised: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): expected leaves or cells that are missing, unexpected ones, and those that come twice."""
    have = realised.groupBy(*keys).agg(F.count("*").alias("have"))
    both = expected.select(*keys).distinct().withColumn("want", F.lit(1)).join(have, keys, "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("have") > 1, "duplicate")
    return both.select(*keys, problem.alias("problem")).where("problem is not null")


def structure_drift(frozen: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, frozen, current): units whose domain, fold or tile is no longer what it was."""
    a, b = frozen.alias("a"), current.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"))
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").cast("string").alias("frozen"), F.col(f"b.{c}").cast("string").alias("current")) for c in columns]))
    return joined.select(F.col(f"a.{key}").alias(key), parts.alias("z")).select(key, "z.*").where("not (frozen <=> current)")


def domain_census(rows: DataFrame, keys: list[str], order: str, label: str, domain: str) -> DataFrame:
    """(keys, n_domains, n_one_class, one_class): the last row of each (keys, domain, label) counts."""
    last = rows.groupBy(*keys, domain, label).agg(F.max(order).alias("o"))
    per = last.groupBy(*keys, domain).agg(F.count("*").alias("k"))
    return per.groupBy(*keys).agg(F.count("*").alias("n_domains"), F.sum(F.when(F.col("k") < 2, 1).otherwise(0)).alias("n_one_class"), F.array_sort(F.collect_list(F.when(F.col("k") < 2, F.col(domain)))).alias("one_class"))


def role_problems(summary: DataFrame) -> DataFrame:
    """(holdout, problems) from (holdout, has_target, supports_target_labels, parts): what a split claims but doesn't have."""
    has = lambda p: F.array_contains("parts", p)
    problems = F.filter(
        F.array(
            F.when(~has("source_train"), F.lit("no source_train")),
            F.when(F.col("has_target") & ~has("target_test"), F.lit("no target_test")),
            F.when(~F.col("has_target") & (has("target_test") | has("target_label_pool")), F.lit("target rows without a target")),
            F.when(F.col("supports_target_labels") & ~has("target_label_pool"), F.lit("no target_label_pool")),
            F.when(~F.col("supports_target_labels") & has("target_label_pool"), F.lit("target_label_pool is not allowed")),
        ),
        lambda x: x.isNotNull(),
    )
    return summary.select("holdout", problems.alias("problems")).where(F.size("problems") > 0)


def take_ranked(df: DataFrame, by: list[str], seed: int, key: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group in hash order."""
    return shuffled(df, by, seed, "take", key, "__o").where(F.col("__o") < k).drop("__o")


