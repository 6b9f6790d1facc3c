"""Acquisition series: composites, resampling, features, tiles and perturbations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farfield.functions.columns import finite, scrubbed
from farfield.operators.ranks import shuffled

MONTHS = 12


def monthly_composite(df: DataFrame, by: list[str], month: str, value: str) -> DataFrame:
    """(by, month, value, available): the mean of each month slot 0 to 11; a month without acquisitions is 0 and not available."""
    means = df.groupBy(*by, F.col(month).cast("int").alias("month")).agg(F.avg(finite(F.col(value))).alias("value"))
    grid = means.select(*by).distinct().withColumn("month", F.explode(F.sequence(F.lit(0), F.lit(MONTHS - 1))))
    out = grid.join(means, [*by, "month"], "left")
    return out.select(*by, "month", F.coalesce("value", F.lit(0.0)).alias("value"), F.when(F.col("value").isNotNull(), 1).otherwise(0).alias("available"))


def reordered(composite: DataFrame, permutation: list[int]) -> DataFrame:
    """The composite with slot k showing month permutation[k]; anything but a permutation of the months raises."""
    if sorted(permutation) != list(range(MONTHS)):
        raise ValueError("the order must name each month once")
    slot = F.element_at(F.array(*[F.lit(permutation.index(m)) for m in range(MONTHS)]), F.col("month") + 1)
    return composite.withColumn("slot", slot)


def ragged(df: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """(by, series): a sample's acquisitions in time order, as long as they are."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("series"))


def linspace_index(n: Column, i: Column, length: int) -> Column:
    """Which of n elements stands at place i of a series of fixed length; halves go to the even neighbour."""
    return F.rint(i * (n - 1) / F.lit(max(length - 1, 1))).cast("int") if length > 1 else F.lit(0)


def resampled(series: DataFrame, column: str, length: int) -> DataFrame:
    """``column`` brought to exactly ``length`` elements by repeating or leaving out; empty stays empty."""
    n = F.size(column)
    out = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.element_at(column, linspace_index(n, i, length) + 1))
    return series.withColumn(column, F.when(n > 0, out).otherwise(F.col(column)))


def bucket_length(n: Column) -> Column:
    """The first of 8, 16, ... 256 that holds n; longer series get 256."""
    out = F.lit(256)
    for b in (128, 64, 32, 16, 8):
        out = F.when(n <= b, b).otherwise(out)
    return out


def bucketed(series: DataFrame, column: str) -> DataFrame:
    """``column`` at its bucket's length: middle elements of even chunks when longer, even repeats when shorter."""
    n, k = F.size(column), bucket_length(F.size(column))
    extra = k - n
    # chunk i of k holds elements from start(i) on; the first n mod k chunks hold one more
    base, more = F.floor(n / k), n % k
    start = lambda i: i * base + F.least(i, more)
    middle = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.element_at(column, (start(i) + F.floor((base + F.when(i < more, 1).otherwise(0)) / 2)).cast("int") + 1))
    repeats = F.transform(F.sequence(F.lit(0), extra - 1), lambda i: F.element_at(column, F.when(extra > 1, F.rint(i * (n - 1) / F.when(extra > 1, extra - 1))).otherwise(0).cast("int") + 1))
    longer = F.array_sort(F.concat(F.col(column), F.when(extra > 0, repeats).otherwise(F.slice(column, 1, 0))))
    return series.withColumn(column, F.when(n == 0, F.col(column)).when(n > k, middle).otherwise(longer))


def stat_features(composite: DataFrame, by: list[str]) -> DataFrame:
    """(by, mean, std, min, max, range) over the 12 slots, those without acquisitions included as zeros."""
    return composite.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), (F.max("value") - F.min("value")).alias("range"))


def flat_features(composite: DataFrame, sample: str, modality_order: str, band: str) -> DataFrame:
    """(sample, x): the composite as one vector, by month, then modality, then band."""
    entry = F.struct("month", modality_order, band, "value")
    return composite.groupBy(sample).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["value"]).alias("x"))


def normalised(df: DataFrame, constants: DataFrame, band: str, value: str, mode: str) -> DataFrame:
    """Per-band normalisation by a constants table (band, a, b); masked or odd values become 0.

    ``affine``: (x + a) / b; ``z``: (x - a) / (b + 1e-9); ``sigma``: (x - (a - 2b)) / 4b, the value itself for b = 0.
    """
    joined = df.join(F.broadcast(constants.select(F.col(band).alias("__band"), "a", "b")), F.col(band) == F.col("__band"), "left")
    x, a, b = F.col(value), F.col("a"), F.col("b")
    safe = F.when(b != 0, b)
    out = {"affine": (x + a) / safe, "z": (x - a) / (b + 1e-9), "sigma": F.when(b == 0, x).otherwise((x - (a - 2 * b)) / (4 * safe))}[mode]
    return joined.withColumn(value, scrubbed(F.when(F.col("__band").isNull(), F.raise_error(F.concat(F.lit("no constants for band "), F.col(band).cast("string"))).cast("double")).otherwise(out))).drop("__band", "a", "b")


def in_band_order(df: DataFrame, by: list[str], bands: list[str], band: str, value: str, missing: str = "zero") -> DataFrame:
    """(by, x): the named bands in their order; a band without a value is 0, or raises if ``missing`` is 'error'."""
    have = df.where(F.col(band).isin(*bands)).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(band, value))).alias("m"))
    absent = lambda b: F.raise_error(F.lit(f"band {b} is missing")).cast("double") if missing == "error" else F.lit(0.0)
    return have.select(*by, F.array(*[F.coalesce(F.col("m")[b].cast("double"), absent(b)) for b in bands]).alias("x"))


def rescaled_decibels(df: DataFrame, sample: str, value: str) -> DataFrame:
    """Samples whose 95th percentile of magnitude is below 100 hold decibels: clip((x + 50) * 200) to 0 ... 32767."""
    p95 = df.groupBy(sample).agg(F.percentile(F.abs(finite(F.col(value))), 0.95).alias("__p"))
    scaled = F.greatest(F.least((F.col(value) + 50) * 200, F.lit(32767.0)), F.lit(0.0))
    return df.join(p95, sample).withColumn(value, F.when(F.col("__p") < 100, scaled).otherwise(F.col(value).cast("double"))).drop("__p")


def tiles(pixels: DataFrame, row: str, col: str, label: str, side: int = 64, void: int = 19) -> DataFrame:
    """Adds tile_row, tile_col and the index in the tile; void pixels go, and with them tiles that hold nothing else."""
    kept = pixels.where(F.col(label) != void)
    return kept.withColumns({"tile_row": F.floor(F.col(row) / side).cast("int"), "tile_col": F.floor(F.col(col) / side).cast("int"), "pixel_index": (F.col(row) % side * side + F.col(col) % side).cast("int")})


def class_sets(pixels: DataFrame, patch: list[str], label: str) -> DataFrame:
    """(patch, classes): the sorted labels that occur."""
    return pixels.groupBy(*patch).agg(F.array_sort(F.collect_set(label)).alias("classes"))


def perturbed(df: DataFrame, sample: str, band: str, value: str, name: str, mode: str = "permute", seed: int = 0) -> DataFrame:
    """Band ``name`` set to 0, or taken from another sample by a hash permutation without a fixed order.

    ``df`` has one value for each (sample, band). If the permutation is the identity, each sample takes its neighbour's.
    """
    if mode == "zero":
        return df.withColumn(value, F.when(F.col(band) == name, F.lit(0.0)).otherwise(F.col(value).cast("double")))
    own = df.where(F.col(band) == name).select(sample, F.col(value).cast("double").alias("__v"))
    place = shuffled(shuffled(own, [], seed, "perturb-from", sample, "__from"), [], f"{seed}-to", "perturb-to", sample, "__to")
    facts = place.agg(F.count("*").alias("__n"), F.min(F.when(F.col("__from") == F.col("__to"), 1).otherwise(0)).alias("__same"))
    donors = place.select(F.col("__from").alias("__at"), F.col("__v").alias("__d"))
    taking = place.crossJoin(F.broadcast(facts)).withColumn("__at", F.pmod(F.col("__to") + F.col("__same"), F.col("__n")))
    swapped = taking.join(donors, "__at").select(sample, "__d")
    out = df.join(swapped, sample, "left")
    return out.withColumn(value, F.when(F.col(band) == name, F.col("__d")).otherwise(F.col(value).cast("double"))).drop("__d")


def label_codes(df: DataFrame, code: str, digits: int | None = None) -> DataFrame:
    """Adds class_id: sorted distinct codes (cut to ``digits``) as 0, 1, 2 and on."""
    cut = F.substring(F.col(code).cast("string"), 1, digits) if digits else F.col(code)
    rows = df.withColumn("__c", cut)
    ids = rows.select("__c").distinct().withColumn("class_id", F.row_number().over(Window.orderBy("__c")) - 1)
    return rows.join(ids, "__c").drop("__c")


def without_rare(df: DataFrame, label: str, least: int = 10) -> DataFrame:
    """The rows of classes with ``least`` rows or more."""
    return df.join(df.groupBy(label).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(label), label, "left_semi")


def first_name(df: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """(key, name): the first name of each id."""
    return df.groupBy(key).agg(F.min_by(name, order).alias(name))
