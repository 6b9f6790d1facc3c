"""Tables that grow by whole cells: a cell's rows are all there or not at all, whatever becomes of the writer.

A writer stages its rows in a folder of its own, and then adds one line to the manifest. Readers take the manifest's word
alone, so what a lost writer left is never read, and a second attempt at a cell that is committed changes nothing. Should
two attempts at a cell both reach the manifest, all readers take the same one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LINE = "cell string, attempt string, n long, fields string"


def _name(cell: dict) -> str:
    return json.dumps(cell, sort_keys=True, default=str)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(cell, attempt, n, fields) of the committed cells, one attempt each."""
    try:
        lines = spark.read.schema(_LINE).json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LINE)
    return lines.groupBy("cell").agg(F.min(F.struct("attempt", "n", "fields")).alias("z")).select("cell", "z.*")


def stage(rows: DataFrame, path: str, cell: dict) -> tuple[str, int]:
    """Write the rows of a cell where no reader looks; returns the attempt and its number of rows."""
    attempt = uuid.uuid4().hex
    folder = f"{path}/data/attempt={attempt}"
    rows.withColumns({c: F.lit(v) for c, v in cell.items()}).write.parquet(folder)
    return attempt, rows.sparkSession.read.parquet(folder).count()


def commit(spark: SparkSession, path: str, cell: dict, attempt: str, n: int) -> None:
    """One line of the manifest; a file comes into being whole."""
    fields = spark.read.parquet(f"{path}/data/attempt={attempt}").schema.json()
    spark.createDataFrame([(_name(cell), attempt, n, fields)], _LINE).coalesce(1).write.mode("append").json(f"{path}/manifest")


def append_cell(rows: DataFrame, path: str, cell: dict) -> bool:
    """Add a cell with its rows; False if it is there already. ``cell`` gives the columns that name it."""
    spark = rows.sparkSession
    if not manifest(spark, path).where(F.col("cell") == _name(cell)).isEmpty():
        return False
    attempt, n = stage(rows, path, cell)
    commit(spark, path, cell, attempt, n)
    return True


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed cells; columns that only some cells have are null elsewhere."""
    known = manifest(spark, path)
    kinds = [StructType.fromJson(json.loads(r[0])) for r in known.select("fields").distinct().orderBy("fields").collect()]
    if not kinds:
        raise ValueError(f"no cell is committed in {path}")
    fields = {f.name: f for kind in kinds for f in kind.fields}
    data = spark.read.schema(StructType(list(fields.values()))).option("basePath", f"{path}/data").parquet(f"{path}/data")
    return data.join(known.select("attempt"), "attempt").drop("attempt")


def open_cells(planned: DataFrame, spark: SparkSession, path: str, cell: list[str]) -> DataFrame:
    """The planned cells that aren't committed yet: where a restart goes on."""
    done = manifest(spark, path).select(F.from_json("cell", "map<string,string>").alias("c")).select(*[F.col("c")[c].alias(f"__{c}") for c in cell])
    same = [F.col(c).cast("string").eqNullSafe(F.col(f"__{c}")) for c in cell]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return planned.join(done, condition, "left_anti")
