"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes hashed counts: byte pairs, word shapes, word endings, and how often words repeat. Damped and weighted by
inverse document frequency, the counts of a bounded sample of labelled rows give, by singular value decomposition, the
latent axes. The labelled vectors (at most ``sample_rows`` x ``RANK`` numbers) are broadcast; every text is compared with
all of them by blocked cosine products, and its nearest ones vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farfield.llm import text as T
from farfield.llm.scratch import crc_mod

PAIRS, SHAPES, ENDS, EXTRA = 2048, 512, 512, 32
WIDTH = PAIRS + SHAPES + ENDS + EXTRA
RANK = 48
NEIGHBOURS = 31
SAMPLE_ROWS = 4096
PRODUCT_ROWS = 128
BLOCK = {"limit": 1 << 19, "most": 512}  # what is counted at a time
_CLASS = np.full(256, 5, np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1
_CLASS[[44, 46]] = 4


def counts(block: T.Block) -> np.ndarray:
    """Hashed counts (documents x WIDTH), as shares of each kind's total."""
    rows, data = block.rows, block.data
    n = len(data)
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(block.offsets))
    out = np.zeros((rows, WIDTH), np.float32)

    def add(at: int, width: int, who: np.ndarray, what: np.ndarray) -> None:
        got = np.bincount(who * width + what, minlength=rows * width).reshape(rows, width)
        out[:, at : at + width] = got / np.maximum(got.sum(axis=1, keepdims=True), 1)

    if n > 1:
        pair = (data[:-1].astype(np.uint32) * 256 + data[1:]) * np.uint32(2654435761)
        same = owner[:-1] == owner[1:]
        add(0, PAIRS, owner[:-1][same], (pair >> np.uint32(21))[same].astype(np.int64))
    word_owner = block.document_of_word()
    if len(word_owner):
        # a word's shape: the classes of its first two and last three bytes, and its length up to 15
        first, last = block.starts, block.ends - 1
        length = np.minimum(block.ends - block.starts, 15).astype(np.uint64)
        kinds = [_CLASS[data[np.minimum(first + k, last)]] for k in (0, 1)] + [_CLASS[data[np.maximum(last - k, first)]] for k in (0, 1, 2)]
        shape = length // 3
        for k in kinds:
            shape = shape * np.uint64(6) + k
        add(PAIRS, SHAPES, word_owner, (T.mix(shape) % np.uint64(SHAPES)).astype(np.int64))
        end = (data[last].astype(np.uint64) << np.uint64(16)) | (data[np.maximum(last - 1, first)].astype(np.uint64) << np.uint64(8)) | data[np.maximum(last - 2, first)]
        add(PAIRS + SHAPES, ENDS, word_owner, (T.mix(end) % np.uint64(ENDS)).astype(np.int64))
        hashes = block.word_hashes(lower=True)
        grams = T.gram_hashes(hashes, 3)
        for k, (a, b) in enumerate(zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True)):
            if b > a:
                unlike = len(np.unique(hashes[a:b])) / (b - a)
                three = len(np.unique(grams[a : b - 2])) / (b - a - 2) if b - a > 2 else 1.0
                bins = (min(7, int(unlike * 8)), 8 + min(7, int(three * 8)), 16 + min(15, int(np.log2(b - a))))
                out[k, [PAIRS + SHAPES + ENDS + x for x in bins]] = 1 / 3
    return out


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # per count
    axes: np.ndarray  # WIDTH x rank
    vectors: np.ndarray  # rank x labelled rows, of length 1
    labels: np.ndarray
    neighbours: int

    def score(self, x: np.ndarray) -> np.ndarray:
        v = _unit(np.sqrt(x) * self.weight @ self.axes)
        out = np.empty(len(v))
        k = min(self.neighbours, len(self.labels))
        for at in range(0, len(v), PRODUCT_ROWS):
            close = v[at : at + PRODUCT_ROWS] @ self.vectors
            top = np.argpartition(-close, k - 1, axis=1)[:, :k]
            near = np.maximum(np.take_along_axis(close, top, axis=1), 0) ** 8 + 1e-9
            out[at : at + PRODUCT_ROWS] = (near * self.labels[top]).sum(axis=1) / near.sum(axis=1)
        return np.clip(out, 0, 1)


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def train(x: np.ndarray, labels: list[int], rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model | None:
    """A model of labelled counts (rows x WIDTH)."""
    if not len(x):
        return None
    weight = (np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 1).astype(np.float32)
    np.sqrt(x, out=x)
    x *= weight
    # the leading axes by subspace iteration: no matrix as wide as the counts is ever squared
    width = min(rank, len(x))
    basis = np.random.default_rng(3).normal(size=(WIDTH, min(width + 16, len(x)))).astype(np.float32)
    for _ in range(8):
        basis = np.linalg.qr(x.T @ np.linalg.qr(x @ basis)[0])[0]
    axes = np.ascontiguousarray(basis @ np.linalg.svd(x @ basis, full_matrices=False)[2].T[:, :width])
    return Model(weight, axes, np.ascontiguousarray(_unit(x @ axes).T), np.asarray(labels, np.float64), neighbours)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        for batch in batches:
            scores = [m.score(counts(block)) if m else np.full(block.rows, 0.5) for block in T.blocks(batch.column(2), **BLOCK)]
            values = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64()), pa.array((values >= 0.3).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in T.blocks(batch.column(1), **BLOCK):
            rows = slice(block.first, block.first + block.rows)
            yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(2)[rows], *T.sparse(counts(block))], names=["o", "quality", "at", "x"])


def fit(docs: DataFrame, labels: DataFrame, held_mod: int = 5, held_rest: int = 0, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of at most ``sample_rows`` labelled rows, picked by a hash of the id; only their counts, of at most WIDTH
    numbers each, reach the driver, however long the texts are."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = marks.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_mod("doc_id", held_mod) != held_rest))
    picked = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = rows.join(F.broadcast(picked), "doc_id").select(F.xxhash64("doc_id", "text").alias("o"), "text", "quality")
    found = sample.mapInArrow(_counted, "o long, quality int, at array<int>, x array<float>").orderBy("o").limit(sample_rows).toArrow().to_pandas()
    return train(T.dense(found["at"].tolist(), found["x"].tolist(), WIDTH), found["quality"].tolist())


def score(docs: DataFrame, labels: DataFrame, held_mod: int = 5, held_rest: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; learns only where crc32(doc_id) mod ``held_mod`` is not ``held_rest``.

    Null text reads as empty; an empty text is scored by its neighbours like any other. No labelled row: score 0.5. A
    null doc_id is not held out. Repeated rows are answered alike; labels of ids that repeat count once, the higher.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, held_mod, held_rest, sample_rows))
    held = F.coalesce(crc_mod("doc_id", held_mod) == held_rest, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", held.alias("held_out"), "text").mapInArrow(_score(shared), "doc_id long, held_out boolean, score double, predicted int")


def _keep(model, text_at: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        for batch in batches:
            scores = [m.score(counts(block)) if m else np.ones(block.rows) for block in T.blocks(batch.column(text_at), **BLOCK)]
            yield batch.filter(pa.array(np.concatenate(scores) >= least)) if scores else batch

    return run


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, **how) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``least`` or more; all of them if nothing is labelled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))
    return docs.mapInArrow(_keep(shared, docs.columns.index("text"), least), docs.schema)
