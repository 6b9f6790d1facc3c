"""Sources and sinks: nested JSON, strict and torn line files, array files, checked CSV, digests of files and tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farfield.functions.columns import window_year
from farfield.operators.ranks import ranked
from farfield.sources.scratch import cut

ASSIGNMENTS = "stable_id string, partition string, status string, domain string, reason string"
LABEL_ACCESS = "stable_id string, population string, source_rank int, target_rank int"


def geojson_labels(spark: SparkSession, path: str) -> DataFrame:
    """(index, dataset, is_crop, lat, lon, window_year) from a feature collection; null coordinates become NaN."""
    schema = "features array<struct<properties:struct<index:long,dataset:string,is_crop:int,lat:double,lon:double,export_end_date:string>>>"
    p = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.properties.*")
    nan = F.lit(float("nan"))
    return p.select("index", "dataset", "is_crop", F.coalesce("lat", nan).alias("lat"), F.coalesce("lon", nan).alias("lon"), window_year(F.col("export_end_date")).alias("window_year"))


def release_splits(spark: SparkSession, path: str) -> DataFrame:
    """(role, sample_id) from a JSON document that maps roles to lists of ids."""
    doc = spark.read.option("multiLine", True).schema("train array<string>, val array<string>, test array<string>, target_train array<string>").json(path)
    parts = [doc.select(F.lit(c).alias("role"), F.explode(c).alias("sample_id")) for c in doc.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def array_files(spark: SparkSession, path: str, glob: str = "*.npz") -> DataFrame:
    """(sample_id, t, date, band, value, lat, lon) from files of arrays data (T, C), dates and centre; odd shapes are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    data, dates = z["data"], z["dates"]
                    centre = z["center"] if "center" in z else np.array([np.nan, np.nan])
                if data.ndim != 2 or len(data) != len(dates):
                    continue
                t, c = data.shape
                yield pd.DataFrame({"sample_id": name.rsplit("/", 1)[-1].rsplit(".", 1)[0], "t": np.repeat(np.arange(t), c), "date": np.repeat(pd.to_datetime(dates).date, c), "band": np.tile(np.arange(c), t), "value": data.ravel().astype(float), "lat": float(centre[0]), "lon": float(centre[1])})

    return files.mapInPandas(read, "sample_id string, t int, date date, band int, value double, lat double, lon double")


def strict_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; any broken row fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def torn_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of which only a last, unfinished one may be broken: it is left out, any other broken row raises.

    A torn row can't end like a finished object; a row that does and still isn't readable is corruption.
    """
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    bad = F.col("_corrupt_record")
    checked = rows.withColumn("__ok", F.when(bad.isNull(), True).when(F.trim(bad).endswith("}"), F.raise_error(F.concat(F.lit("corrupt row: "), F.substring(bad, 1, 200))).cast("boolean")).otherwise(False))
    return checked.where("__ok").drop("__ok", "_corrupt_record")


def runs(spark: SparkSession, glob: str, pattern: str = r"([^/]+)/([^/]+)/[^/]+$") -> DataFrame:
    """Result rows of many runs, with model and benchmark taken from the path; broken lines are left out."""
    rows = spark.read.option("mode", "DROPMALFORMED").json(glob).withColumn("__p", F.col("_metadata.file_path"))
    return rows.withColumns({"model": F.regexp_extract("__p", pattern, 1), "benchmark": F.regexp_extract("__p", pattern, 2)}).drop("__p")


def checked_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose header must be the schema's names, in order."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def append_cells(rows: DataFrame, path: str, cell: list[str]) -> None:
    """Append result rows, a folder for each cell."""
    rows.write.mode("append").partitionBy(*cell).parquet(path)


def dropping(rows: DataFrame, condition: str) -> tuple[DataFrame, DataFrame]:
    """(kept, count): the rows that don't meet the condition, and a one-row table with the number of those that do."""
    hit = F.coalesce(F.expr(condition), F.lit(False))
    return rows.where(~hit), rows.agg(F.sum(F.when(hit, 1).otherwise(0)).alias("dropped"))


def union_of(tables: list[DataFrame]) -> DataFrame:
    """Rows with differing columns in one table; the header is the union in order of appearance."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def assignment_order() -> list[Column]:
    """Partition rank, then purged, then excluded, then ids with numbers first and by value."""
    ranks = F.create_map(*[F.lit(x) for kv in zip(("source_train", "source_val", "source_test", "target_label_pool", "target_test"), range(5), strict=True) for x in kv])
    place = F.when(F.col("status") == "assigned", ranks[F.col("partition")]).when(F.col("status") == "purged", 5).otherwise(6)
    number = F.col("stable_id").rlike(r"^\d{1,18}$")
    return [place, F.when(number, 0).otherwise(1), F.when(number, F.col("stable_id")).cast("long"), F.col("stable_id")]


def numbered(rows: DataFrame) -> DataFrame:
    """Adds the 1-based ``line`` of each row in the assignment order: counts of ranges of the order, and ranks within each.

    The ranges are stored, as a second sampling of them may differ.
    """
    dealt = cut(rows.repartitionByRange(*assignment_order()).withColumn("__range", F.spark_partition_id()), "ranges")
    return ranked(dealt, [], assignment_order(), F.col("__range"), "line").drop("__range").withColumn("line", F.col("line") + 1)


def with_rejects(rows: DataFrame, rules: dict[str, str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with a reason): the first rule that a row breaks; with ``strict`` a reject raises."""
    reason = F.coalesce(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    marked = rows.withColumn("reason", reason)
    if strict:
        marked = marked.withColumn("reason", F.when(reason.isNotNull(), F.raise_error(F.concat(F.lit("rejected: "), reason))))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def row_digest(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """(by, n, digest): a digest of rows and of the keys that order them. Rows are hashed one by one (MD5 of the keys and
    columns as text) and two parts of the hashes are added up, so no group is brought together whole."""
    text = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in [*order, *columns]]))
    part = lambda at: F.sum(F.conv(F.substring(text, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), part(1), part(16)), 256).alias("digest"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def folder_digest(digests: DataFrame, root: str) -> DataFrame:
    """(sha256, n): relative path, NUL, digest and a line feed for each file, in path order, folded into one digest."""
    relative = F.regexp_replace("path", f"^.*?{root}/", "")
    listed = digests.agg(F.array_sort(F.collect_list(F.struct(relative.alias("p"), "sha256"))).alias("l"), F.count("*").alias("n"))
    text = F.array_join(F.transform("l", lambda e: F.concat(e["p"], F.lit("\0"), e["sha256"], F.lit("\n"))), "")
    return listed.select(F.sha2(text.cast("binary"), 256).alias("sha256"), "n")
