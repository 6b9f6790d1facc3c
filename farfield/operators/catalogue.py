"""Catalogue columns and regimes: identities, bands, modalities, official and dense splits, budgets by unit, rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.functions.columns import finite, hash_order
from farfield.operators import metrics as M
from farfield.operators import spatial, splits
from farfield.operators.ranks import ranked, shuffled
from farfield.sources.scratch import cut

#: fixed values: terrain among the climate bands, groups of the optical bands, and the last rank of each adaptation bucket
TERRAIN = ("elevation", "slope", "dem")
OPTICAL = {"visible": ("b2", "b3", "b4"), "red_edge": ("b5", "b6", "b7", "b8a"), "nir": ("b8",), "swir": ("b11", "b12"), "index": ("ndvi",)}
BUCKETS = {"native": 2, "minor_adaptation": 4, "moderate_adaptation": 6}


PART_ROWS = 500_000  # pixels that a task counts at a time

def provenance(stable_id: Column) -> Column:
    """The source of an id ``<index>_<source>.h5``."""
    stem = F.regexp_replace(stable_id, r"\.h5$", "")
    return F.when(F.instr(stem, "_") > 0, F.regexp_replace(stem, "^[^_]*_", "")).otherwise(stem)


def by_prefix(code: Column, names: dict[str, str], length: int = 2) -> Column:
    """The name of a code's prefix, or the prefix itself."""
    prefix = F.substring(code, 1, length)
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, prefix), prefix)


def spread_month(i: Column, length: Column) -> Column:
    """The month slot of acquisition i of a series without dates, spread evenly over a year."""
    slot = F.rint(i / F.greatest(length - 1, F.lit(1)) * 11)
    return F.greatest(F.least(slot, F.lit(11)), F.lit(0)).cast("int")


def tile_code(raw: Column) -> Column:
    """A tile name as ``T31ABC``; blank is null, anything else raises."""
    text = F.upper(F.trim(raw))
    named = F.when(text.startswith("T"), text).otherwise(F.concat(F.lit("T"), text))
    return F.when(raw.isNull() | (text == ""), F.lit(None).cast("string")).when(named.rlike(r"^T\d{2}[A-Z]{3}$"), named).otherwise(F.raise_error(F.concat(F.lit("not a tile: "), raw)).cast("string"))


def box_centre(rings: Column) -> tuple[Column, Column]:
    """(lat, lon) of the middle of the box around rings of (lon, lat); coordinates that aren't degrees raise."""
    flat = F.flatten(rings)
    xs, ys = F.transform(flat, lambda p: p[0]), F.transform(flat, lambda p: p[1])
    lon, lat = (F.array_min(xs) + F.array_max(xs)) / 2, (F.array_min(ys) + F.array_max(ys)) / 2
    ok = (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    bad = F.raise_error(F.lit("coordinates are not degrees")).cast("double")
    return F.when(ok, lat).otherwise(bad), F.when(ok, lon).otherwise(bad)


def band_group(modality: Column, band: Column) -> Column:
    """The group of a band: radar and climate by modality, all else by the band's name whatever its case."""
    b = F.lower(band)
    out = F.when(modality == "s1", "sar").when((modality == "climate") & b.isin(*TERRAIN), "topography").when(modality == "climate", "climate")
    for group, names in OPTICAL.items():
        out = out.when(b.isin(*names), group)
    return out.otherwise("other")


def severity(rank: Column) -> Column:
    """How much a model's inputs must be adapted, from its compatibility rank (1 is best); a pair without a rank is unranked."""
    out = F.when(rank.isNull(), "unranked")
    for bucket, last in BUCKETS.items():
        out = out.when(rank <= last, bucket)
    return out.otherwise("major_adaptation")


def available_modalities(acquisitions: DataFrame, samples: DataFrame, by: str) -> DataFrame:
    """(by, modalities): those with acquisitions; ``latlon`` if any position is finite and not at zero."""
    has = acquisitions.groupBy(by).agg(F.collect_set("modality").alias("m"))
    placed = finite(F.col("lat")).isNotNull() & finite(F.col("lon")).isNotNull() & ((F.col("lat") != 0) | (F.col("lon") != 0))
    where = samples.groupBy(by).agg(F.bool_or(placed).alias("p"))
    return has.join(where, by, "full").select(by, F.array_sort(F.concat(F.coalesce("m", F.array().cast("array<string>")), F.when(F.coalesce("p", F.lit(False)), F.array(F.lit("latlon"))).otherwise(F.array().cast("array<string>")))).alias("modalities"))


def optical_only(acquisitions: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The view without other modalities and with positions at zero."""
    return acquisitions.where("modality = 's2'"), samples.withColumns({"lat": F.lit(0.0), "lon": F.lit(0.0)})


def with_constants(df: DataFrame, **values: object) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def length_groups(lengths: DataFrame, columns: list[str], sample: str) -> DataFrame:
    """(columns, n): how many samples share their series' lengths, for batching."""
    return lengths.groupBy(*columns).agg(F.count_distinct(sample).alias("n"))


def official_provenance(samples: DataFrame, source: str, fixed: list[str], key: str, label: str, seed: int) -> DataFrame:
    """(key, partition): sources in ``fixed`` are the evaluation; the rest is 90 to 10 train and val, by class."""
    rest = samples.where(~F.col(source).isin(*fixed))
    n = rest.count()
    parts = splits.partition_source(rest, label, source, key, seed, ("source_train", "source_val"), splits.official_sizes(n))
    return parts.select(key, "partition").unionByName(samples.where(F.col(source).isin(*fixed)).select(key, F.lit("target_test").alias("partition")))


def official_regions(samples: DataFrame, region: str, roles: dict[str, str], key: str) -> DataFrame:
    """(key, partition): each region or fold has its role; rows of others are left out."""
    table = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    return samples.select(key, F.try_element_at(table, F.col(region).cast("string")).alias("partition")).where("partition is not null")


def dense_leave_one_out(patches: DataFrame, key: str, tile: str, radius_km: float) -> tuple[DataFrame, DataFrame]:
    """Leave-one-tile-out over patches, with the same purge as for samples."""
    return spatial.leave_one_out(patches, key, tile, radius_km)


def spatial_cluster_regime(samples: DataFrame, key: str, radius_km: float, k: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Each coordinate cell in turn as a target without labels: (holdout, key, role) and what the purge removed."""
    return spatial.leave_one_out(cut(spatial.in_cells(samples, key, k, seed), "cells"), key, "cluster", radius_km)


def fold_stats(pixels: DataFrame, by: list[str], patch: str, tile: list[str], label: str) -> DataFrame:
    """(by, n_pixels, n_patches, n_tiles, classes): a fold's size, and the count of each class as a map."""
    # patches are dealt out once, in parts of about PART_ROWS rows, and each is counted where it lies
    parts = max(1, -(-pixels.count() // PART_ROWS))
    per = pixels.select(*by, patch, *tile, label).repartition(parts, *by, patch).groupBy(*by, patch, *tile, label).agg(F.count("*").alias("c"))
    named = F.when(F.greatest(*[F.col(t).isNull().cast("int") for t in (patch, *tile)], F.lit(0)) == 0, 1).otherwise(0)
    tiles = per.groupBy(*by, patch, *tile).agg(F.sum("c").alias("c")).withColumn("t", named)
    patches = tiles.groupBy(*by, patch).agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    sizes = patches.groupBy(*by).agg(F.sum("c").alias("n_pixels"), F.count(patch).alias("n_patches"), F.sum("t").alias("n_tiles"))
    classes = per.groupBy(*by, label).agg(F.sum("c").alias("c")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "c")))).alias("classes"))
    return sizes.join(classes, by)


def population_problems(rows: DataFrame, population: DataFrame, key: str) -> DataFrame:
    """(key, problem): ids of a stored split that come twice, are missing or are not in the population."""
    return splits.coverage_problems(population, rows, [key])


def universe_problems(tiles: DataFrame, expected: DataFrame, tile: str) -> DataFrame:
    """(tile, n, expected): tiles whose count isn't what it must be, or that only one side has."""
    have = tiles.groupBy(tile).agg(F.count("*").alias("n"))
    return have.join(expected, tile, "full").where("not (n <=> expected)").select(tile, "n", "expected")


def regime_ledger(declared: DataFrame, ran: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """(keys, kind): declared regimes that didn't run; with ``strict`` such a row raises."""
    gone = declared.join(ran.select(*keys).distinct(), keys, "left_anti")
    return gone.select(*keys, (F.raise_error(F.lit("a declared regime did not run")).cast("string") if strict else F.lit("regime_not_run")).alias("kind"))


def generate(samples: DataFrame, key: str, label: str, region: str, seeds: list[int], radius_km: float) -> DataFrame:
    """(seed, regime, holdout, key, partition): random and leave-one-out splits of all seeds in one table."""
    kept, _ = spatial.leave_one_out(samples, key, region, radius_km)
    out: list[DataFrame] = []
    for seed in seeds:
        tag = lambda d, regime: d.select(F.lit(seed).alias("seed"), F.lit(regime).alias("regime"), "holdout", key, "partition")  # noqa: B023, E731
        out.append(tag(splits.random_split(samples, label, region, key, seed).withColumn("holdout", F.lit("all")), "random_id"))
        target = splits.partition_target(kept.where("role = 'target'"), ["holdout"], label, key, seed)
        source = kept.where("role = 'source'").withColumn("partition", F.lit("source_train"))
        out.append(tag(source.select("holdout", key, "partition").unionByName(target.select("holdout", key, "partition")), "geographic_ood"))
    return reduce(DataFrame.unionByName, out)


def balanced_patches(patches: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    """k patches taken round by round over the groups."""
    rounds = shuffled(patches, [group], seed, "patches", key, "__r").withColumn("__g", hash_order(seed, "patch-group", F.col(group)))
    order = ranked(rounds, [], ["__r", "__g", key], F.floor(F.log2(F.col("__r") + 1)).cast("int"), "__o")
    return order.where(F.col("__o") < k).drop("__r", "__g", "__o")


def order_problems(order: DataFrame, population: DataFrame, by: list[str], key: str, place: str) -> DataFrame:
    """(by, problem): an order must hold each id of its population once, at places 0 to n - 1."""
    a = order.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"), F.min(place).alias("lo"), F.max(place).alias("hi"), F.count_distinct(place).alias("p"))
    b = population.groupBy(*by).agg(F.count_distinct(key).alias("want"))
    extra = order.join(population, [*by, key], "left_anti").groupBy(*by).agg(F.count("*").alias("extra"))
    both = a.join(b, by, "full").join(extra, by, "left")
    problem = F.when(F.col("extra") > 0, "unknown ids").when(~(F.col("n").eqNullSafe(F.col("want"))), "size").when(F.col("d") != F.col("n"), "repeated ids").when((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("p") != F.col("n")), "places")
    return both.select(*by, problem.alias("problem")).where("problem is not null")


def positions(access: DataFrame, assignments: DataFrame, by: list[str], key: str) -> DataFrame:
    """Ranked ids with the partition that holds them; an id outside its partition raises."""
    want = F.when(F.col("population") == "source", "source_train").when(F.col("population") == "target", "target_label_pool").otherwise("target_test")
    joined = access.join(assignments.select(*by, F.col(key).alias("stable_id"), F.col("partition").alias("__p")), [*by, "stable_id"], "left")
    bad = F.raise_error(F.concat(F.lit("id is outside its partition: "), F.col("stable_id").cast("string"))).cast("string")
    return joined.withColumn("partition", F.when(F.col("__p").eqNullSafe(want), want).otherwise(bad)).drop("__p")


def check_budgets(fractions: list[float], targets: list[float]) -> None:
    if any(not 0 < f <= 1 for f in fractions) or len(set(fractions)) != len(fractions):
        raise ValueError("source budgets are distinct fractions in (0, 1]")
    if any(t < -1 or -1 < t < 0 for t in targets) or len(set(targets)) != len(targets):
        raise ValueError("target budgets are -1, 0, fractions or counts, each once")


def budget_seed(seed: int, fraction: float) -> int:
    return abs(seed + round(fraction * 1000))


def named_metric(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by, value): one binary score by its name."""
    if name == "auc":
        return M.auc(df, by).withColumnRenamed("auc", "value")
    if name == "ece":
        return M.calibration_error(df, by, name="value")
    card = M.binary_scorecard(df, by)
    if name not in card.columns:
        raise ValueError(f"no metric {name!r}")
    return card.select(*by, F.col(name).alias("value"))


def presence_problems(rows: DataFrame, gaps: DataFrame, by: list[str]) -> DataFrame:
    """(by, problem): a model with in-distribution and other rows must have gaps; one without must have none."""
    need = rows.groupBy(*by).agg(F.bool_or(F.col("regime") == "random_id").alias("i"), F.bool_or(F.col("regime") != "random_id").alias("o"))
    have = gaps.groupBy(*by).agg(F.count("*").alias("n"))
    problem = F.when(F.col("i") & F.col("o") & F.col("n").isNull(), "gaps are missing").when(~(F.col("i") & F.col("o")) & (F.col("n") > 0), "gaps without rows")
    return need.join(have, by, "left").select(*by, problem.alias("problem")).where("problem is not null")
