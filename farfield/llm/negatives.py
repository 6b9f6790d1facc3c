"""Hard negatives by bounds over a spanning tree of the anchors.

Vectors become whole numbers, so scores are exact. The anchors are dealt into trees of near ones (minimum spanning trees
of at most ``TREE`` anchors, built in tasks). For a block of rows the score of each row with the root is computed; at a
child it lies within edge length times the row's norm of the parent's, so only rows whose interval meets a window of the
child are scored anew. One pass over the rows finds the positives: the window is what may still be among the first of the
same label. A second finds the negatives: the windows are those of the positives. Windows narrow as rows are seen, and
begin with what the anchors of the tree are to each other. Trees are dealt into passes of at most ``ANCHORS`` anchors; each
pass sends its trees, and nothing else, to all tasks, and each task returns at most the first rows of each window.

Defined results: rows with a null id, label or vector, or with a component that is null or not finite, take no part; nor
do rows whose scaled norm is 2**26 or more, as their scores wouldn't be exact. A vector shorter than the longest reads as
followed by zeros. Repeated rows count once; if rows of one id differ, each is a row of its own and counts with its best
score. An anchor without others of its label, or without rows in a window, gives no rows, as does an empty table. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farfield.llm.scratch import stored

SCALE = 256
SHIFT_EVERY, CLASSES = 7, 10  # where 7 divides the id, the label is the next of 10
ANCHOR_EVERY = 100
POSITIVES = NEGATIVES = 5
LOW, HIGH, WHOLE = 80, 100, 100  # LOW * positive <= WHOLE * negative <= HIGH * positive
TREE = 512
ANCHORS = 1 << 14
BLOCK = 1024
DENSE = 0.25  # share of a block above which all its rows are scored at once
LIMIT = float(1 << 26)  # norms below give scores that doubles hold exactly

_NONE = np.iinfo(np.int64).min


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of floor(SCALE * x), and which rows have a vector without null, non-finite or too large components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ok = ~np.asarray(column.is_null())
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    with np.errstate(over="ignore", invalid="ignore"):
        out[row, at] = np.floor(SCALE * values)
        norms = np.sqrt(np.einsum("ij,ij->i", out, out))
    ok &= np.isfinite(norms) & (norms < LIMIT)
    out[~ok] = 0
    return out, ok


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of the rows that take part; columns: id, label, vector."""
    x, ok = _vectors(batch.column(2))
    ok &= ~np.asarray(batch.column(0).is_null()) & ~np.asarray(batch.column(1).is_null())
    ids = np.asarray(batch.column(0).fill_null(0))[ok].astype(np.int64)
    labels = np.asarray(batch.column(1).fill_null(0))[ok].astype(np.int64)
    return ids, np.where(ids % SHIFT_EVERY == 0, (labels + 1) % CLASSES, labels), x[ok]


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order (each parent before its children), parent (as a place in the order, -1 for the root) and edge length."""
    n = len(x)
    square = np.einsum("ij,ij->i", x, x)
    near, parent = np.full(n, np.inf), np.full(n, -1)
    place, order, edges, out = np.full(n, -1), [], [], []
    k = 0
    for step in range(n):
        order.append(k)
        place[k] = step
        out.append(-1 if parent[k] < 0 else place[parent[k]])
        edges.append(0.0 if parent[k] < 0 else float(np.sqrt(max(0.0, near[k]))))
        distance = np.maximum(0.0, square + square[k] - 2 * (x @ x[k]))
        closer = (place < 0) & (distance < near)
        near[closer], parent[closer] = distance[closer], k
        k = int(np.argmin(np.where(place < 0, near, np.inf)))
    return np.array(order, np.int64), np.array(out, np.int64), np.array(edges)


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: ids, labels, vectors, parents and edges, as bytes, in the tree's order."""
    seen: dict[tuple, tuple] = {}

    def tree() -> pa.RecordBatch:
        ids, labels = (np.array(list(c), np.int64) for c in zip(*((i, l) for i, l, _ in seen.values()), strict=True))
        width = max(len(v) for _, _, v in seen.values())
        x = np.stack([np.pad(v, (0, width - len(v))) for _, _, v in seen.values()])
        order, parent, edge = spanning_tree(x)
        cells = [ids[order], labels[order], x[order], parent, edge]
        cells = {n: c.tobytes() for n, c in zip(("ids", "labels", "vectors", "parents", "edges"), cells, strict=True)}
        name = hashlib.md5(cells["ids"] + cells["labels"] + cells["vectors"]).hexdigest()
        return pa.RecordBatch.from_pylist([{"name": name, "size": len(ids), "width": width} | cells])

    for batch in batches:
        for i, label, v in zip(*_rows(batch), strict=True):
            if len(seen) == TREE:
                yield tree()
                seen.clear()
            v = np.trim_zeros(v, "b")
            seen[int(i), int(label), v.tobytes()] = (int(i), int(label), v)
    if seen:
        yield tree()


_TREE = "name string, size long, width long, ids binary, labels binary, vectors binary, parents binary, edges binary"


def plant(rows: DataFrame, every: int = ANCHOR_EVERY) -> DataFrame:
    """The trees of all anchors. Anchors of like directions come together: they are dealt by the signs of their first components."""
    anchors = rows.where(F.col("id") % every == 0).dropna(subset=["id", "label"]).distinct()
    parts = max(1, -(-anchors.count() // TREE))
    if parts == 1:
        return anchors.coalesce(1).mapInArrow(_planted, _TREE)
    signs = F.concat(*(F.when(F.get("vector", F.lit(k)) > 0, "1").otherwise("0") for k in range(16)))
    return anchors.repartitionByRange(parts, signs, "id").sortWithinPartitions(signs, "id").mapInArrow(_planted, _TREE)


class Tree:
    def __init__(self, row, width: int):
        self.ids, self.labels, self.parent = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "parents"))
        self.edge = np.frombuffer(row["edges"], np.float64)
        own = np.frombuffer(row["vectors"], np.float64).reshape(len(self.ids), -1)
        self.x = _widened(own, width)

    def scores(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(anchor, rows, scores, rows scored) for each anchor: the exact scores of all rows of ``x`` that lie between low and high.

        Other rows are left out, but for some that were scored all the same.
        """
        norms = np.sqrt(np.einsum("ij,ij->i", x, x)) * (1 + 1e-12)
        least, most = np.empty((len(self.ids), len(x))), np.empty((len(self.ids), len(x)))
        all_rows = np.arange(len(x))
        for k, (p, e) in enumerate(zip(self.parent, self.edge, strict=True)):
            if p < 0:
                rows = all_rows
            else:
                slack = e * (1 + 1e-12) * norms
                np.subtract(least[p], slack, out=least[k])
                np.add(most[p], slack, out=most[k])
                rows = np.flatnonzero((most[k] >= low[k]) & (least[k] <= high[k]))
            if len(rows) > DENSE * len(x):
                rows = all_rows
            exact = x[rows] @ self.x[k] if len(rows) < len(x) else x @ self.x[k]
            least[k, rows] = most[k, rows] = exact
            yield k, rows, exact, len(rows)


class Best:
    """The first rows by (score, least id) of each window (anchor of a tree, place), whose scores lie between low and high."""

    def __init__(self, low: np.ndarray, high: np.ndarray, keep: int):
        self.low, self.high, self.keep = low.astype(float), high.astype(float), keep
        self.window, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.n = self.low.shape[1] if self.low.ndim == 2 else 1

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        w, s, i = (np.concatenate(p) for p in ((self.window, window), (self.score, score), (self.id, ids)))
        order = np.lexsort((i, -s, w))
        w, s, i = w[order], s[order], i[order]
        new = np.ones(len(w), bool)  # an id counts once in a window, with its best score
        by_id = np.lexsort((-s, i, w))
        same = (w[by_id][1:] == w[by_id][:-1]) & (i[by_id][1:] == i[by_id][:-1])
        new[by_id[1:][same]] = False
        w, s, i = w[new], s[new], i[new]
        rank = np.arange(len(w)) - np.searchsorted(w, w)
        first = rank < self.keep
        self.window, self.score, self.id = w[first], s[first], i[first]
        full = self.window[rank[first] == self.keep - 1]
        last = self.score[rank[first] == self.keep - 1]
        flat = self.low.reshape(-1)
        flat[full] = np.maximum(flat[full], last)


def _search(trees: list, width: int, windows: Callable, same: bool, keep: int) -> Callable:
    """A function over batches of rows (id, label, vector): the first ``keep`` rows of each window of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planted = [Tree(t, width) for t in trees.value]
        kept = [Best(*windows(t, number), keep) for number, t in enumerate(planted)]
        # the anchors of a tree are rows too, so their places among each other bound the last that counts
        for tree, best in zip(planted, kept, strict=True):
            _look(tree, best, tree.ids, tree.labels, tree.x, same)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                ids, labels, x = _rows(batch.slice(a, BLOCK))
                if len(ids):
                    x = _widened(x, width) if x.shape[1] <= width else x[:, :width]
                    for tree, best in zip(planted, kept, strict=True):
                        _look(tree, best, ids, labels, x, same)
        for number, (tree, best) in enumerate(zip(planted, kept, strict=True)):
            anchor = best.window // best.n
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(anchor), number)), pa.array(tree.ids[anchor]), pa.array(tree.labels[anchor]), pa.array(anchor), pa.array(best.window % best.n), pa.array(best.score), pa.array(best.id)],
                names=["tree", "anchor_id", "label", "anchor", "place", "score", "id"],
            )

    return run


_FOUND = "tree long, anchor_id long, label long, anchor long, place long, score long, id long"


def _look(tree: Tree, best: Best, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, same: bool) -> int:
    """Add what a block of rows has to the windows; returns how many scores were computed."""
    scored = 0
    windows, scores, found = [], [], []
    low, high = best.low.min(axis=1), best.high.max(axis=1)
    for k, rows, exact, n in tree.scores(x, low, high):
        scored += n
        may = (labels[rows] == tree.labels[k]) & (ids[rows] != tree.ids[k]) if same else labels[rows] != tree.labels[k]
        may &= (exact >= low[k]) & (exact <= high[k])
        rows, exact = rows[may], exact[may]
        for place in range(best.n):
            inside = (exact >= best.low[k, place]) & (exact <= best.high[k, place])
            if inside.any():
                windows.append(np.full(int(inside.sum()), k * best.n + place))
                scores.append(exact[inside].astype(np.int64))
                found.append(ids[rows[inside]])
    if windows:
        best.add(np.concatenate(windows), np.concatenate(scores), np.concatenate(found))
    return scored


def _first(found: DataFrame, keep: int) -> DataFrame:
    """Of what the tasks found, the first rows of each window, with their rank. A window has at most ``keep`` rows a task."""
    one = found.groupBy("anchor_id", "label", "anchor", "tree", "place", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("tree", "anchor", "place").orderBy(F.desc("score"), "id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _passes(trees: DataFrame) -> Iterator[tuple[list, int]]:
    """The trees by passes of at most ANCHORS anchors, and the width of their vectors."""
    sizes = [(r["name"], r["size"]) for r in trees.select("name", "size").orderBy("name").collect()]
    while sizes:
        n, size = 0, 0
        while n < len(sizes) and (n == 0 or size + sizes[n][1] <= ANCHORS):
            size += sizes[n][1]
            n += 1
        rows = trees.where(F.col("name").isin([name for name, _ in sizes[:n]])).orderBy("name").collect()
        yield [r.asDict() for r in rows], max(r["width"] for r in rows)
        sizes = sizes[n:]


def mine(embeddings: DataFrame, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``embeddings`` (vec_id, embedding, label)."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    trees = stored(plant(rows, every), "trees")
    out = None
    for planted, width in _passes(trees):
        sent = spark.sparkContext.broadcast(planted)
        widest = width

        def above(tree: Tree, number: int) -> tuple[np.ndarray, np.ndarray]:
            return np.full((len(tree.ids), 1), -np.inf), np.full((len(tree.ids), 1), np.inf)

        near = _first(rows.mapInArrow(_search(sent, widest, above, True, positives), _FOUND), positives)
        near = stored(near.select("tree", "anchor", "anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        scores = spark.sparkContext.broadcast([(r["tree"], r["anchor"], r["place"], r["positive_score"]) for r in near.select("tree", "anchor", "place", "positive_score").collect()])

        def between(tree: Tree, number: int) -> tuple[np.ndarray, np.ndarray]:
            low, high = np.full((len(tree.ids), positives), np.inf), np.full((len(tree.ids), positives), -np.inf)
            for t, anchor, place, score in scores.value:
                if t == number:
                    low[anchor, place - 1], high[anchor, place - 1] = -(-LOW * score // WHOLE), HIGH * score // WHOLE
            return low, high

        far = _first(rows.mapInArrow(_search(sent, widest, between, False, negatives), _FOUND), negatives)
        far = far.select("tree", "anchor", (F.col("place") + 1).alias("place"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        got = stored(near.join(far, ["tree", "anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
        out = got if out is None else out.union(got)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
