"""Many probes fitted at once: every pass over the features serves all of them.

A member set is a named set of training rows (a cell, or the part of a cell that is fitted or held out). Each feature row is
stored once, with a bit for each set that it is in. A pass takes the loss and the gradient of all models that are still
descending: tasks add them up over their rows, the sums of the tasks are added by model, and only those reach the driver,
which moves each model by its own limited-memory quasi-Newton step. So a hundred cells take as many passes as the slowest of
them, not a hundred times as many. Models whose parameters are more than ``MODEL_BYTES`` together are fitted in turns.

The linear probe and the network (rectified layers) weigh rows by inverse class frequency and standardise by the moments of
their own set. Neighbours are found once, ``DEPTH`` of them; the votes of fewer are a prefix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farfield.operators.nearest import CHUNK_ROWS, Nearest, meeting, searched, unit, vectors
from farfield.operators.probes import BLOCK_BYTES, _votes, standardiser
from farfield.sources.scratch import cut

MODEL_BYTES = 16 << 20  # parameters that are sent to the tasks at once
DIRECT_TASKS = 8  # sums of more tasks are added in Spark first
BLOCK_ROWS = 4096
HISTORY = 8
DEPTH = 100
HIDDEN = (256, 128)
BATCH = 200  # rows that share one weight decay in mini-batch training; keeps the scale of the decay



def _signs(words: np.ndarray, place: int) -> np.ndarray:
    """Which rows have the bit of a set."""
    return (words[:, place // 64] >> np.int64(place % 64)) & 1 == 1


def _decoded(batch: pa.RecordBatch, shift: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (class places, shifted features, set words) of a batch with columns y, x, m."""
    for a in range(0, batch.num_rows, BLOCK_ROWS):
        b = batch.slice(a, BLOCK_ROWS)
        y, x, m = (b.column(b.schema.get_field_index(c)) for c in ("y", "x", "m"))
        yield np.asarray(y), np.asarray(x.flatten()).reshape(b.num_rows, -1) - shift, np.asarray(m.flatten()).reshape(b.num_rows, -1)


def _packed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slot", "v"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            v = np.frombuffer(v)
            sums[slot] = sums[slot] + v if slot in sums else v
    yield _packed(sums)


def _summed(rows: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The sums over all tasks of the vectors that ``task`` gives by slot."""
    parts = rows.mapInArrow(lambda batches: iter([_packed(task(batches))]), "slot int, v binary")
    tasks = rows.rdd.getNumPartitions()
    if tasks > DIRECT_TASKS:
        parts = parts.repartition(max(1, tasks // DIRECT_TASKS), "slot").mapInArrow(_added, "slot int, v binary")
    out: dict[int, np.ndarray] = {}
    for slot, v in parts.collect():
        v = np.frombuffer(v)
        out[slot] = out[slot] + v if slot in out else v
    return out


@dataclass
class Moments:
    """Of one member set: rows by class, mean and deviation of each dimension (of the shifted features)."""

    counts: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    @property
    def classes(self) -> np.ndarray:
        return np.flatnonzero(self.counts)

    @property
    def n(self) -> int:
        return int(self.counts.sum())

    def weights(self, y: np.ndarray) -> np.ndarray:
        return (self.n / (len(self.classes) * np.maximum(self.counts, 1)))[y]

    def ready(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.std


class Linear:
    """Softmax over the classes of the set, or one logit for two classes; the value is the inverse of the penalty."""

    def __init__(self, width: int, classes: int):
        self.shapes = [(width, 1 if classes == 2 else classes)]

    def start(self, seed: int) -> np.ndarray:
        return np.zeros(sum(a * b + b for a, b in self.shapes))

    def penalty(self, value: float, n: int) -> float:
        return 1 / (value * n)

    def layers(self, p: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in self.shapes:
            out.append((p[at : at + a * b].reshape(a, b), p[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def decayed(self, p: np.ndarray) -> np.ndarray:
        """The parameters that are penalised: all but the intercepts."""
        out = p.copy()
        for _, b in self.layers(out):
            b[:] = 0
        return out

    def forward(self, p: np.ndarray, z: np.ndarray) -> list[np.ndarray]:
        seen = [z]
        layers = self.layers(p)
        for k, (w, b) in enumerate(layers):
            z = z @ w + b
            if k + 1 < len(layers):
                z = np.maximum(z, 0)
            seen.append(z)
        return seen

    def probabilities(self, p: np.ndarray, z: np.ndarray) -> np.ndarray:
        z = self.forward(p, z)[-1]
        if z.shape[1] == 1:
            one = 0.5 * (1 + np.tanh(z / 2))
            return np.hstack([1 - one, one])
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def loss(self, p: np.ndarray, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The weighted log loss of the rows and its gradient, as one vector."""
        seen = self.forward(p, z)
        out = seen[-1]
        if out.shape[1] == 1:
            loss = w @ (np.logaddexp(0, out[:, 0]) - y * out[:, 0])
            back = (w * (0.5 * (1 + np.tanh(out[:, 0] / 2)) - y))[:, None]
        else:
            top = out.max(axis=1, keepdims=True)
            log = out - top - np.log(np.exp(out - top).sum(axis=1, keepdims=True))
            loss = -w @ log[np.arange(len(y)), y]
            back = np.exp(log)
            back[np.arange(len(y)), y] -= 1
            back *= w[:, None]
        parts: list[np.ndarray] = []
        layers = self.layers(p)
        for k in range(len(layers) - 1, -1, -1):
            parts[:0] = [(seen[k].T @ back).ravel(), back.sum(axis=0)]
            if k:
                back = (back @ layers[k][0].T) * (seen[k] > 0)
        return np.concatenate([[loss], *parts])


class Network(Linear):
    """Rectified layers; the value is the weight decay, as a batch of BATCH rows feels it."""

    def __init__(self, width: int, classes: int, hidden: tuple[int, ...] = HIDDEN):
        sizes = [width, *hidden, 1 if classes == 2 else classes]
        self.shapes = list(zip(sizes[:-1], sizes[1:], strict=True))

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([rng.uniform(-1, 1, a * b + b) * np.sqrt(6 / (a + b)) for a, b in self.shapes])

    def penalty(self, value: float, n: int) -> float:
        return value / min(BATCH, n)


KINDS = {"logistic": Linear, "mlp": Network}


class Descent:
    """Limited-memory quasi-Newton descent of one function; each value it is told is one pass over the rows."""

    def __init__(self, x: np.ndarray, max_iter: int, flat: float = 1e-6, still: float = 1e-9):
        self.x, self.max_iter, self.flat, self.still = x, max_iter, flat, still
        self.f, self.g, self.step, self.t = np.inf, np.zeros_like(x), np.zeros_like(x), 0.0
        self.past: list[tuple[np.ndarray, np.ndarray]] = []
        self.moves = self.refused = 0
        self.done = False

    def trial(self) -> np.ndarray:
        return self.x + self.t * self.step

    def told(self, f: float, g: np.ndarray) -> None:
        if np.isfinite(self.f) and not f <= self.f + 1e-4 * self.t * (self.step @ self.g):
            self.t /= 4
            self.refused += 1
            self.done = self.refused > 20
            return
        if not np.isfinite(f):
            self.done = True
            return
        moved, turned, gain = self.t * self.step, g - self.g, self.f - f
        if self.moves and moved @ turned > 1e-14:
            self.past = [*self.past[1 - HISTORY :], (moved, turned)]
        self.x, self.f, self.g, self.refused = self.trial(), f, g, 0
        self.done = np.abs(g).max() <= self.flat or gain <= self.still * max(1.0, abs(f)) or self.moves >= self.max_iter
        self.moves += 1
        q, rates = g.copy(), []
        for s, y in reversed(self.past):
            a = (s @ q) / (s @ y)
            q -= a * y
            rates.append(a)
        if self.past:
            s, y = self.past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.past, reversed(rates), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        self.step = -q
        if self.step @ g >= 0:
            self.step, self.past = -g, []
        self.t = 1.0 if self.past else min(1.0, 1 / max(np.abs(g).sum(), 1e-12))


@dataclass
class Model:
    """A probe of one member set and one value; ``params`` once it is fitted (neighbours have none)."""

    place: int
    value: float
    params: np.ndarray | None = None
    passes: int = 0
    broken: bool = False


@dataclass
class Joint:
    """Feature rows with their sets, and the moments of each set."""

    rows: DataFrame  # key, y (place of the class), x, m (words of set bits)
    names: list
    classes: list
    shift: np.ndarray
    moments: list[Moments]
    key: str
    passes: int = 0

    def place(self, name) -> int:
        return self.names.index(name)


def _bits(members: DataFrame, names: list, key: str) -> DataFrame:
    """(key, m): the words of bits of the sets that each key is in; combined before the shuffle."""
    places = members.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names)], "set string, place int")
    at = members.join(F.broadcast(places), "set")  # a row for each set
    words = range(-(-len(names) // 64))
    bit = F.expr("shiftleft(1L, place % 64)")
    return at.groupBy(key).agg(F.array(*(F.bit_or(F.when(F.floor(F.col("place") / 64) == w, bit).otherwise(F.lit(0).cast("long"))) for w in words)).alias("m"))


def joint(features: DataFrame, members: DataFrame, label: str, key: str, x: str = "x") -> Joint:
    """Joins ``features`` with the sets of ``members`` (set, key), and takes the moments of all sets in one pass."""
    names = [r[0] for r in members.select("set").distinct().orderBy("set").collect()]
    classes = [r[0] for r in features.select(label).distinct().orderBy(label).collect()]
    y = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1).cast("int")
    rows = features.select(key, y.alias("y"), F.col(x).cast("array<double>").alias("x")).join(_bits(members, names, key), key)
    rows = cut(rows, "joint")
    middle = standardiser(rows, "x").first()
    shift = np.array(middle["means"] if middle["means"] is not None else [])
    out = Joint(rows, names, classes, shift, [], key)
    width, k = len(shift), len(classes)

    def moments(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        sums = {s: np.zeros(k + 2 * width) for s in range(len(names))}
        for batch in batches:
            for labels, v, m in _decoded(batch, shift):
                for s, total in sums.items():
                    own = _signs(m, s)
                    total[:k] += np.bincount(labels[own], minlength=k)
                    total[k : k + width] += v[own].sum(axis=0)
                    total[k + width :] += np.square(v[own]).sum(axis=0)
        return sums

    found = _summed(rows.select("y", "x", "m"), moments) if width else {}
    for s in range(len(names)):
        total = found.get(s, np.zeros(k + 2 * width))
        n = max(1.0, total[:k].sum())
        mean = total[k : k + width] / n
        spread = np.sqrt(np.maximum(0, total[k + width :] / n - mean**2))
        out.moments.append(Moments(total[:k].astype(np.int64), mean, np.where(spread > 1e-12, spread, 1.0)))
    out.passes = 1
    return out


def _kind(j: Joint, model: Model, family: str) -> Linear:
    return KINDS[family](len(j.shift), len(j.moments[model.place].classes))


def fit(j: Joint, models: list[Model], family: str, seed: int = 0, max_iter: int = 200, still: float = 1e-9) -> None:
    """Fits all models, as many at a time as fit into MODEL_BYTES; sets ``params`` of each."""
    waiting = list(models)
    spark, shift = j.rows.sparkSession, j.shift
    rows = j.rows.select("y", "x", "m").persist()
    try:
        while waiting:
            turn, size = [], 0
            while waiting and (not turn or size < MODEL_BYTES):
                turn.append((waiting[0], _kind(j, waiting[0], family)))
                size += turn[-1][1].start(seed).nbytes
                waiting.pop(0)
            descents = [Descent(kind.start(seed), max_iter, still=still) for _, kind in turn]
            while any(not d.done for d in descents):
                open_ = [k for k, d in enumerate(descents) if not d.done]
                moments = {turn[k][0].place: j.moments[turn[k][0].place] for k in open_}
                sent = spark.sparkContext.broadcast(([(k, turn[k][0].place, turn[k][1], descents[k].trial()) for k in open_], moments))

                def losses(batches: Iterator[pa.RecordBatch], sent=sent) -> dict[int, np.ndarray]:
                    todo, own_moments = sent.value
                    sums: dict[int, np.ndarray] = {}
                    for batch in batches:
                        for y, v, m in _decoded(batch, shift):
                            for place, mo in own_moments.items():
                                own = _signs(m, place)
                                if not own.any():
                                    continue
                                z, labels, w = mo.ready(v[own]), np.searchsorted(mo.classes, y[own]), mo.weights(y[own])
                                for k, s, kind, p in todo:
                                    if s == place:
                                        got = kind.loss(p, z, labels, w)
                                        sums[k] = sums[k] + got if k in sums else got
                    return sums

                found = _summed(rows, losses)
                j.passes += 1
                sent.unpersist()
                for k in open_:
                    (model, kind), d = turn[k], descents[k]
                    n, p = j.moments[model.place].n, d.trial()
                    decay, rate = kind.decayed(p), kind.penalty(model.value, n)
                    d.told(found[k][0] / n + 0.5 * rate * (decay @ decay), found[k][1:] / n + rate * decay)
                    model.params, model.passes, model.broken = d.x, model.passes + 1, not np.isfinite(d.f)
    finally:
        rows.unpersist()


def predict(j: Joint, models: list[Model], targets: DataFrame, family: str, x: str = "x", among: dict[int, int] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(model, key, *carry, classes, probs, pred) of each target row by each model: ``model`` is its place in ``models``.

    ``among`` names, for each model, the set whose members it predicts; the targets are then ``j.rows``. Rows and models are
    not paired by a join: each task scores its rows by the parameters it was sent, in turns of MODEL_BYTES.
    """
    if family == "knn":
        return _by_neighbours(j, models, targets, x, among, carry)
    out, first = None, 0
    spark = targets.sparkSession
    label_type = "string" if j.classes and isinstance(j.classes[0], str) else "long"
    kept = [j.key, *carry]
    asked = targets.select(*kept, F.col(x).cast("array<double>").alias("x"), *(["m"] if among else []))
    fields = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in kept)
    schema = f"model int, {fields}, classes array<{label_type}>, probs array<double>, pred {label_type}"
    names = np.array(j.classes)
    while first < len(models):
        last, size = first, 0
        while last < len(models) and (last == first or size < MODEL_BYTES):
            size += models[last].params.nbytes
            last += 1
        chosen = [(k, _kind(j, models[k], family), models[k].params, j.moments[models[k].place], among and among[k]) for k in range(first, last)]
        sent, shift = spark.sparkContext.broadcast(chosen), j.shift

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, BLOCK_ROWS):
                    b = batch.slice(a, BLOCK_ROWS)
                    v = np.asarray(b.column(len(kept)).flatten()).reshape(b.num_rows, -1) - shift
                    m = np.asarray(b.column(len(kept) + 1).flatten()).reshape(b.num_rows, -1) if among else None
                    for k, kind, p, mo, place in sent.value:
                        own = np.flatnonzero(_signs(m, place)) if among else np.arange(b.num_rows)
                        if len(own):
                            yield _scored(b, kept, k, own, kind.probabilities(p, mo.ready(v[own])), names[mo.classes])

        part = asked.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
        first = last
    return out


def _scored(b: pa.RecordBatch, kept: list[str], model: int, own: np.ndarray, probs: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(names))
    kind = pa.string() if names.dtype.kind == "U" else pa.int64()
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.tile(names, len(own)), kind)), pa.ListArray.from_arrays(ends, pa.array(probs.ravel()))]
    columns = [pa.array(np.full(len(own), model, np.int32)), *(b.column(k).take(pa.array(own)) for k in range(len(kept))), *lists, pa.array(names[probs.argmax(axis=1)], kind)]
    return pa.RecordBatch.from_arrays(columns, names=["model", *kept, "classes", "probs", "pred"])


def _by_neighbours(j: Joint, models: list[Model], targets: DataFrame, x: str, among: dict[int, int] | None, carry: tuple[str, ...]) -> DataFrame:
    """Votes of the nearest rows by cosine, weighted by 1 / distance; an exact match leaves only exact matches.

    Chunks of targets meet all training rows, which stream past them (``operators/nearest.py``); a task keeps as many nearest
    rows of each (set, target) as the models of the set ask for.
    """
    kept, shift = [j.key, *carry], j.shift
    asked = targets.select(*kept, F.col(x).cast("array<double>").alias("__x"), *([F.col("m").alias("__m")] if among else []))
    held = j.rows.select(F.col("y").alias("__y"), F.col("x").alias("__x"), F.col("m").alias("__m"))
    fields = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in kept)
    depths: dict[tuple[int, int], int] = {}
    for k, model in enumerate(models):
        pair = model.place, among[k] if among else -1
        depths[pair] = max(depths.get(pair, 1), min(int(model.value), j.moments[model.place].n - 1, DEPTH))
    moments = {p: j.moments[p] for p, _ in depths}

    def begin(rows: pa.Table) -> tuple:
        q, bits = vectors(rows, "__x") - shift, vectors(rows, "__m") if among else None
        searches = {}
        for (place, of), depth in depths.items():
            own = np.flatnonzero(_signs(bits, of)) if among else np.arange(len(q))
            if len(own) and moments[place].n:
                searches[place, of] = own, Nearest(unit(moments[place].ready(q[own])), depth)

        def see(b: pa.RecordBatch) -> None:
            y, v, m = np.asarray(b.column("__y")), vectors(b, "__x") - shift, vectors(b, "__m")
            for place in {p for p, _ in searches}:
                if (mine := _signs(m, place)).any():
                    units, labels = unit(moments[place].ready(v[mine])), y[mine]
                    for (p, _), (_, near) in searches.items():
                        if p == place:
                            near.see(units, labels)

        def found() -> Iterator[pa.RecordBatch]:
            only = rows.select(kept).combine_chunks()
            for (place, of), (own, near) in searches.items():
                for a in range(0, len(own), BLOCK_ROWS):
                    part = only.take(pa.array(own[a : a + BLOCK_ROWS])).combine_chunks()
                    b = pa.RecordBatch.from_arrays([c.combine_chunks() for c in part.columns], names=kept)
                    yield from votes(b, place, of, near.d[a : a + BLOCK_ROWS], near.y[a : a + BLOCK_ROWS])

        return see, found

    label_type = "string" if isinstance(j.classes[0], str) else "long"
    names = np.array(j.classes)
    wanted = [(k, models[k].place, among[k] if among else -1, int(models[k].value), j.moments[models[k].place]) for k in range(len(models))]

    def votes(b: pa.RecordBatch, place: int, of: int, d: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, p, o, depth, mo in wanted:
            if (p, o) == (place, of):
                depth = max(1, min(depth, mo.n - 1, DEPTH))
                probs = _votes(d[:, :depth], y[:, :depth], mo.classes)
                yield _scored(b, kept, k, np.arange(b.num_rows), probs, names[mo.classes])

    size = 8 * len(shift) + sum(8 * len(shift) + 12 * depth for depth in depths.values())
    met = meeting(asked, held, j.key, min(CHUNK_ROWS, BLOCK_BYTES // max(1, size)))
    return met.mapInArrow(lambda batches: searched(batches, begin), f"model int, {fields}, classes array<{label_type}>, probs array<double>, pred {label_type}")
