"""Raw collections of array files as a data source: ``spark.read.format("collection").option("name", ...).load(root)``.

``collection_format(spark)`` makes the format known to a session. The name of the collection tells how its files are laid
out. Files are listed on the driver and dealt into partitions by their bytes; each task opens its own. Only the columns of
the schema that is asked for are made, so arrays that none of them needs aren't decoded; a filter on ``sample_id`` leaves
out files by their names. A file of another shape gives no row; with ``option("rejects", True)`` the rows are those files
and the reasons instead.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PARTITION_BYTES = 64 << 20
FILE_BYTES = 1 << 20  # what opening a file counts as
BATCH_ROWS = 1 << 16
REJECTS = "path string, sample_id string, reason string"

Columns = dict[str, np.ndarray | pa.Array]


class Reject(ValueError):
    """A file whose shape isn't that of its collection."""


@dataclass(frozen=True)
class Layout:
    """Which files a collection has, their columns, and how one file becomes columns (of those that are wanted)."""

    suffix: str
    schema: str
    read: Callable[[str, bytes, set[str]], Columns]


def _array(z: zipfile.ZipFile, name: str, shape_only: bool = False):
    if f"{name}.npy" not in z.namelist():
        raise Reject(f"no array {name}")
    with z.open(f"{name}.npy") as f:
        if not shape_only:
            return np.lib.format.read_array(io.BytesIO(f.read()), allow_pickle=False)
        version = np.lib.format.read_magic(f)
        return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)[0]


def _series(name: str, content: bytes, wanted: set[str]) -> Columns:
    """A file of arrays ``data`` (time, band), ``dates`` and, if there is one, ``center``."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shape = _array(z, "data", shape_only=True)
        if len(shape) != 2:
            raise Reject(f"data has {len(shape)} dimensions")
        t, c = shape
        if (n := _array(z, "dates", shape_only=True)) != (t,):
            raise Reject(f"{t} steps, dates of shape {n}")
        out: Columns = {"sample_id": np.full(t * c, name), "t": np.repeat(np.arange(t, dtype=np.int32), c), "band": np.tile(np.arange(c, dtype=np.int32), t)}
        if "value" in wanted:
            out["value"] = _array(z, "data").astype(np.float64).ravel()
        if "date" in wanted:
            out["date"] = np.repeat(_array(z, "dates").astype("datetime64[D]"), c)
        if wanted & {"lat", "lon"}:
            centre = _array(z, "center").astype(float) if "center.npy" in z.namelist() else np.full(2, np.nan)
            if centre.shape != (2,):
                raise Reject(f"center of shape {centre.shape}")
            out |= {"lat": np.full(t * c, centre[0]), "lon": np.full(t * c, centre[1])}
    return out


def _tiles(name: str, content: bytes, wanted: set[str]) -> Columns:
    """A cube ``<modality>_<patch>.npy`` of (time, band, row, column), or (band, row, column) without time: a row a pixel and step."""
    modality, _, patch = name.partition("_")
    if not patch.isdigit():
        raise Reject("the name isn't <modality>_<patch>")
    f = io.BytesIO(content)
    if wanted <= {"sample_id", "modality", "patch", "t", "row", "col"}:
        version = np.lib.format.read_magic(f)
        shape, cube = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)[0], None
    else:
        cube = np.lib.format.read_array(f, allow_pickle=False)
        shape = cube.shape
    if len(shape) == 3:
        shape, cube = (1, *shape), cube if cube is None else cube[None]
    if len(shape) != 4:
        raise Reject(f"a cube of {len(shape)} dimensions")
    t, c, h, w = shape
    n = t * h * w
    out: Columns = {"sample_id": np.full(n, name), "modality": np.full(n, modality), "patch": np.full(n, int(patch)), "t": np.repeat(np.arange(t, dtype=np.int32), h * w), "row": np.tile(np.repeat(np.arange(h, dtype=np.int32), w), t), "col": np.tile(np.arange(w, dtype=np.int32), t * h)}
    if "bands" in wanted:
        values = np.moveaxis(cube, 1, -1).reshape(n, c).astype(np.float64)
        out["bands"] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * c), pa.array(values.ravel()))
    return out


_SERIES = Layout(".npz", "sample_id string, t int, date date, band int, value double, lat double, lon double", _series)
_TILES = Layout(".npy", "sample_id string, modality string, patch long, t int, row int, col int, bands array<double>", _tiles)
#: names of collections and the layout of their files
LAYOUTS = {"eurocropsml": _SERIES, "series": _SERIES, "pastis": _TILES, "tiles": _TILES}


def layout_of(name: str | None) -> Layout:
    if name not in LAYOUTS:
        raise ValueError(f"no collection {name!r}; known: {sorted(LAYOUTS)}")
    return LAYOUTS[name]


@dataclass
class Files(InputPartition):
    paths: list[str]


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


class CollectionReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.layout, self.root, self.schema = layout_of(options.get("name")), options["path"], schema
        self.rejects = str(options.get("rejects", "false")).lower() == "true"
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("sample_id",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = named if self.only is None else self.only & named
            yield f  # Spark looks at the rows again

    def partitions(self) -> list[Files]:
        system, root = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(self.layout.suffix)]
        out, size = [Files([])], 0
        for f in sorted(found, key=lambda f: f.path):
            if self.only is None or _stem(f.path) in self.only:
                if out[-1].paths and size + f.size + FILE_BYTES > self.bytes:
                    out.append(Files([]))
                    size = 0
                out[-1].paths.append(f.path)
                size += f.size + FILE_BYTES
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root or self.root.startswith("file:") else fs.LocalFileSystem()
        shape = to_arrow_schema(self.schema)
        wanted = set(shape.names)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                content = f.read()
            try:
                columns, reason = self.layout.read(_stem(path), content, wanted), None
            except (Reject, ValueError, KeyError, zipfile.BadZipFile, EOFError) as e:
                columns, reason = None, str(e)[:200] or type(e).__name__
            if self.rejects:
                if reason is not None:
                    yield pa.RecordBatch.from_pylist([{"path": path, "sample_id": _stem(path), "reason": reason}], schema=shape)
            elif columns is not None:
                whole = pa.table([pa.array(columns[n]).cast(shape.field(n).type) if isinstance(columns[n], np.ndarray) else columns[n].cast(shape.field(n).type) for n in shape.names], schema=shape)
                yield from whole.to_batches(max_chunksize=BATCH_ROWS)


class Collection(DataSource):
    @classmethod
    def name(cls) -> str:
        return "collection"

    def schema(self) -> str:
        return REJECTS if str(self.options.get("rejects", "false")).lower() == "true" else layout_of(self.options.get("name")).schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return CollectionReader(dict(self.options), schema)


def collection_format(spark: SparkSession) -> None:
    """Make ``collection`` a format of the session, filters on ``sample_id`` included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Collection)
