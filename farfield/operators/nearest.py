"""The nearest of many rows to each of many others: chunks of asked rows stay in a task, held rows stream past them.

The asked rows are dealt into chunks, and each chunk meets all held rows in one task. A task keeps its chunk and the nearest
rows so far; the held rows come by batch by batch and are dropped again, so what it holds doesn't grow with either table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 8192  # asked rows that one task holds at most
SMALL_CHUNK = 256  # chunks are no smaller than this for the sake of parallel tasks
PRODUCT_ROWS = 256  # rows whose distances to a batch are taken at a time


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def vectors(batch: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    """A column of arrays as the rows of a matrix."""
    c = batch.column(column)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return np.asarray(c.flatten()).reshape(batch.num_rows, -1)


def meeting(asked: DataFrame, held: DataFrame, key: str, rows: int) -> DataFrame:
    """Every chunk of about ``rows`` asked rows at most with all held rows, for ``searched``; a side lacks the columns of the
    other as nulls. ``key`` spreads the asked rows."""
    n, cores = asked.count(), asked.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-n // max(1, rows)), min(cores, -(-n // SMALL_CHUNK)))
    left = asked.withColumns({"__c": F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int"), "__held": F.lit(False)})
    right = held.withColumns({"__c": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))), "__held": F.lit(True)})
    return left.unionByName(right, allowMissingColumns=True).repartitionById(chunks, "__c").sortWithinPartitions("__c", "__held")


def searched(batches: Iterator[pa.RecordBatch], begin: Callable) -> Iterator[pa.RecordBatch]:
    """What each chunk's search gives: ``begin`` takes the asked rows and returns (see, found), for each held batch and the end."""
    chunk, asked, search = None, [], None
    for batch in batches:
        c, held = np.asarray(batch.column("__c")), np.asarray(batch.column("__held").cast(pa.int8()))
        starts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (held[1:] != held[:-1])]) if batch.num_rows else []
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            if c[a] != chunk:
                if search:
                    yield from search[1]()
                chunk, asked, search = c[a], [], None
            if not held[a]:
                asked.append(batch.slice(a, b - a))
            elif asked:
                search = search or begin(pa.Table.from_batches(asked))
                search[0](batch.slice(a, b - a))
    if search:
        yield from search[1]()


class Nearest:
    """The ``depth`` nearest rows of those seen so far to each row of ``q``, by cosine and in order; rows are of length 1."""

    def __init__(self, q: np.ndarray, depth: int):
        self.q, self.depth = q, depth
        self.d, self.y = np.full((len(q), depth), np.inf), np.zeros((len(q), depth), np.int32)

    def see(self, v: np.ndarray, labels: np.ndarray) -> None:
        for k in range(0, len(self.q), PRODUCT_ROWS):
            d, y = self.d[k : k + PRODUCT_ROWS], self.y[k : k + PRODUCT_ROWS]
            far = np.maximum(1 - self.q[k : k + PRODUCT_ROWS] @ v.T, 0)
            if np.isinf(d[:, -1]).any() and far.shape[1] > self.depth:
                at = np.argpartition(far, self.depth - 1, axis=1)[:, : self.depth].ravel()
                row = np.repeat(np.arange(len(d)), self.depth)
            else:
                row, at = np.nonzero(far < d[:, -1:])
            if not len(row):
                continue
            row_of, all_d, all_y = np.r_[np.repeat(np.arange(len(d)), self.depth), row], np.r_[d.ravel(), far[row, at]], np.r_[y.ravel(), labels[at]]
            order = np.lexsort((all_y, all_d, row_of))
            counts = np.bincount(row_of)
            keep = order[np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts) < self.depth]
            d[:], y[:] = all_d[keep].reshape(d.shape), all_y[keep].reshape(y.shape)
