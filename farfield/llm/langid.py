"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (orders 2 to 4, A-Z lower-cased, ASCII other than letters
as one separator); a softmax over a linear map of the mean gives the languages. Both are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows. A temperature fitted on rows kept out of the descent calibrates
the probability, and the least probability that keeps the share of errors below ``max_error`` there marks rejections.
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

BUCKETS = 1 << 13
ORDERS = (2, 3, 4)
DIM = 16
SAMPLE_ROWS = 3000
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not (97 <= b <= 122 or 65 <= b <= 90)]] = 32


def bags(block: T.Block) -> np.ndarray:
    """Mean counts (documents x buckets) of the hashed subwords; n-grams never cross documents."""
    data = _FOLD[block.data]
    n, rows = len(data), block.rows
    out = np.zeros(rows * BUCKETS, np.float32)
    lengths = np.diff(block.offsets)
    owner = np.repeat(np.arange(rows, dtype=np.int64) * BUCKETS, lengths)
    left = np.repeat(block.offsets[1:], lengths) - np.arange(n)
    for order in ORDERS:
        if n < order:
            continue
        h = np.full(n - order + 1, 2166136261 + order, np.uint32)
        for j in range(order):
            h = (h ^ data[j : n - order + 1 + j]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        ok = left[: n - order + 1] >= order
        out += np.bincount((owner[: n - order + 1] + (h & np.uint32(BUCKETS - 1)))[ok], minlength=rows * BUCKETS).astype(np.float32)
    out = out.reshape(rows, BUCKETS)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.table + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, langs: list[str], epochs: int = 30, rate: float = 4.0, batch: int = 32, max_error: float = 0.005, seed: int = 7) -> Model | None:
    """Descent on four fifths of the rows (bags and their languages), calibration on the rest (on all rows if there are under 50)."""
    if not len(x):
        return None
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = len(y) * 4 // 5 if len(y) >= 50 else len(y)
    fit, held = order[:cut], order[cut:] if len(y) >= 50 else order
    scale = np.float32(np.sqrt(BUCKETS))
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs) / 10)
        for at in range(0, len(fit), batch):
            rows = rng.permutation(fit)[:batch] if at == 0 and len(fit) <= batch else fit[at : at + batch]
            xb = x[rows] * scale
            mean = xb @ embed
            grad = _softmax(mean @ weights + bias)
            grad[np.arange(len(rows)), y[rows]] -= 1
            grad /= len(rows)
            back = grad @ weights.T
            weights -= step * (mean.T @ grad)
            bias -= step * grad.sum(axis=0)
            embed -= step * (xb.T @ back)
        fit = rng.permutation(fit)
    table = (embed @ weights) * scale
    logits = x[held] @ table + bias
    grid = np.geomspace(0.1, 10, 60)
    losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    p = _softmax(logits / temperature)
    best, wrong = p.max(axis=1), p.argmax(axis=1) != y[held]
    ranked = np.argsort(-best)
    errors = np.cumsum(wrong[ranked]) / np.arange(1, len(ranked) + 1)
    good = np.flatnonzero(errors <= max_error)
    return Model(names, table.astype(np.float32), bias, temperature, float(best[ranked][good[-1]]) if len(good) else 1.0)


def has_letter(raw: bytes) -> bool:
    lower = np.frombuffer(raw, np.uint8) | 32
    return bool(((lower >= 97) & (lower <= 122)).any()) or (not raw.isascii() and any(c.isalpha() for c in raw.decode("utf-8", "replace")))


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        for batch in batches:
            pred, score, rejected = [], [], []
            for block in T.blocks(batch.column(2), most=256):
                p = m.probabilities(bags(block)) if m else np.zeros((block.rows, 1))
                for k, row in enumerate(p):
                    if m is None or not has_letter(block.text_bytes(k)):
                        pred.append("und"), score.append(0.0), rejected.append(True)
                    else:
                        best = int(row.argmax())
                        pred.append(m.langs[best]), score.append(min(1.0, float(row[best]))), rejected.append(bool(row[best] < m.reject_below))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in T.blocks(batch.column(1), most=256):
            rows = slice(block.first, block.first + block.rows)
            yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(2)[rows], *T.sparse(bags(block))], names=["o", "lang", "at", "x"])


def fit(docs: DataFrame, held_mod: int = 4, held_rest: int = 2, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of at most ``sample_rows`` labelled rows, picked by a hash of the id; only their bags, of at most BUCKETS numbers
    each, reach the driver, however long the texts are."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = rows.where("doc_id is not null and lang is not null and text is not null").where(crc_mod("doc_id", held_mod) != held_rest)
    picked = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = known.join(F.broadcast(picked.distinct()), "doc_id").select(F.xxhash64("doc_id", "text").alias("o"), "text", "lang")
    found = sample.mapInArrow(_bagged, "o long, lang string, at array<int>, x array<float>").orderBy("o").limit(sample_rows).toArrow().to_pandas()
    return train(T.dense(found["at"].tolist(), found["x"].tolist(), BUCKETS), found["lang"].tolist())


def identify(docs: DataFrame, held_mod: int = 4, held_rest: int = 2, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row; ``docs`` has doc_id, text and lang.

    Learns from at most ``sample_rows`` labelled rows, picked by a hash of the id, whose crc32(doc_id) mod ``held_mod`` is
    not ``held_rest``. Null text, a text without a letter, or no labelled row at all: ``und`` with score 0. Very long
    texts are read whole. A null doc_id is never held out and never learned from. Repeated rows are answered alike.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(crc_mod("doc_id", held_mod) == held_rest, F.lit(False))
    model = fit(docs, held_mod, held_rest, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.select("doc_id", held.alias("held_out"), "text").mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
