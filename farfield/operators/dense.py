"""Dense tiles and patches: metadata against a file listing, tile identities, pixel series, observation dates, terrain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farfield.functions.columns import synthetic_day_of_year


def patch_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(patch, fold, tile, rings) from a feature collection; rings are lists of (lon, lat)."""
    schema = "features array<struct<properties:struct<ID_PATCH:long,Fold:int,TILE:string>,geometry:struct<coordinates:array<array<array<double>>>>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select(F.col("f.properties.ID_PATCH").alias("patch"), F.col("f.properties.Fold").alias("fold"), F.col("f.properties.TILE").alias("tile"), F.col("f.geometry.coordinates").alias("rings"))


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path) of the files under a folder, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path")


def present_patches(patches: DataFrame, files: DataFrame, key: str, name: Column, folds: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(patches whose file exists, skipped (key, file)), of the folds asked for; ``name`` is the file name that a patch needs."""
    wanted = (patches if folds is None else patches.where(F.col("fold").isin(*folds))).withColumn("file", name)
    have = files.select(F.regexp_extract("path", "[^/]*$", 0).alias("file")).distinct().withColumn("__have", F.lit(True))
    both = wanted.join(have, "file", "left")
    return both.where("__have").select(*patches.columns), both.where("__have is null").select(key, "file")


def excluded(df: DataFrame, column: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, (column, reason) of those on a frozen exclusion list), apart from rows that are corrupt."""
    listed = F.col(column).isin(*names)
    return df.where(~F.coalesce(listed, F.lit(False))), df.where(listed).select(column, F.lit("excluded").alias("reason"))


def tile_identity(path: Column) -> Column:
    """(patch, row, col) of a label file ``<patch>_<row>_<col>.labels.npy``; null for any other name."""
    pattern = r"([^/]*)_([0-9]+)_([0-9]+)\.labels\.npy$"
    parts = [F.regexp_extract(path, pattern, k) for k in (1, 2, 3)]
    found = F.struct(parts[0].try_cast("long").alias("patch"), parts[1].try_cast("int").alias("tile_row"), parts[2].try_cast("int").alias("tile_col"))
    return F.when(parts[0] != "", found)


def dense_tiles(tiles: DataFrame, folds: list[int], patches: DataFrame | None = None) -> DataFrame:
    """Tiles (path, fold, ...) of some folds, and of some patches if a table of them is given, with their identity as columns."""
    rows = tiles.where(F.col("fold").isin(*folds)).withColumn("__t", tile_identity(F.col("path"))).where("__t is not null")
    rows = rows.select("*", "__t.patch", "__t.tile_row", "__t.tile_col").drop("__t")
    return rows if patches is None else rows.join(patches.select("patch").distinct(), "patch", "left_semi")


def fold_patches(tiles: DataFrame, folds: list[int]) -> DataFrame:
    """(patch): the patches of some folds."""
    return dense_tiles(tiles, folds).select("patch").distinct()


def pixel_series(pixels: DataFrame, keys: list[str], month: str, red: str, near: str, void: str, year: int = 2019) -> DataFrame:
    """Acquisitions of the pixels that aren't void: ``keys``, bands and month, with ndvi, the middle day of the month and a year."""
    total = F.col(near) + F.col(red)
    ndvi = F.when(total != 0, (F.col(near) - F.col(red)) / F.when(total != 0, total)).otherwise(0.0)
    slot = F.pmod(F.col(month), F.lit(12)).cast("int")
    held = pixels.where(~F.col(void))
    return held.select(*keys, red, near, ndvi.alias("ndvi"), slot.alias("month"), synthetic_day_of_year(slot).alias("doy"), F.lit(year).alias("year"))


def timestamp_parts(day_of_year: Column, year: Column) -> Column:
    """(day, 0-based month, year) of an observation; a day of the year outside of 1 to 365 counts as the first."""
    day = F.when((day_of_year >= 1) & (day_of_year <= 365), day_of_year).otherwise(1).cast("int")
    date = F.date_add(F.lit("2001-01-01").cast("date"), day - 1)
    return F.struct(F.dayofmonth(date).alias("day"), (F.month(date) - 1).alias("month"), year.cast("int").alias("year"))


def terrain_and_weather(climate: DataFrame, sample: str, month: str, terrain: list[str], weather: list[str]) -> tuple[DataFrame, DataFrame]:
    """(static terrain: the values of month 0 of each sample, monthly weather: the other bands)."""
    return climate.where(F.col(month) == 0).select(sample, *terrain), climate.select(sample, month, *weather)
