"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farfield.llm.scratch import stored

FEW = 1 << 16  # edges that one task may finish


def roots(links: DataFrame) -> DataFrame:
    """(node, component) of a forest: ``links`` (a, b) has each b once, with a < b; component is the root above b.

    Pointers are doubled; a row is followed only until its pointer is a root, so rows of a star are joined once.
    """
    pointers = links.select(F.col("b").alias("node"), F.col("a").alias("up"))
    done, going = None, pointers
    while True:
        above = pointers.select(F.col("node").alias("up"), F.col("up").alias("over"))
        step = stored(going.join(above, "up", "left").select("node", "up", "over"), "roots")
        ended = step.where("over is null").select("node", "up")
        done = ended if done is None else done.union(ended)
        going = step.where("over is not null").select("node", F.col("over").alias("up"))
        if going.isEmpty():
            return done.withColumnRenamed("up", "component")
        pointers = done.union(going)


def _lowest(edges: DataFrame) -> DataFrame:
    """For each end u of an edge, the least of u and its neighbours. Aggregated before the shuffle, so a hub is no hot key."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = both.where("v > u").join(_lowest(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = _lowest(edges)
    out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _unfinished(edges: DataFrame) -> DataFrame:
    """(v): the lower ends of edges that aren't all of a star: v has a lower neighbour, or a neighbour of v has one besides v or a higher one."""
    lower = edges.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    more = lower.where("low < high").select("u").union(edges.select(F.col("v").alias("u"))).distinct()
    return edges.join(more, "u").select("v").union(lower.select("u")).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of a task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """(node, component) for every node in ``links``: component is the least node that it reaches.

    By alternating large-star and small-star steps. Each round's edges are written to the shared folder; their number
    never grows, and components that are stars already leave the rounds. A path of n nodes takes about log(n) rounds.
    Once at most ``few`` edges are left, one task finishes them. Nodes without a link are not returned; no links give no rows.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    edges = stored(links.select(hi.alias("u"), lo.alias("v")).where("u > v").distinct(), "edges")
    stars = edges.where("false")
    while edges.count() > few:
        open_ = _unfinished(edges).withColumn("open", F.lit(True))
        marked = stored(edges.join(open_, "v", "left").select("u", "v", F.coalesce("open", F.lit(False)).alias("open")), "marked")
        stars = stars.union(marked.where("not open").select("u", "v"))
        edges = stored(_small_star(_large_star(marked.where("open").select("u", "v"))), "edges")
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(centres).union(edges.coalesce(1).mapInArrow(_joined, "node long, component long"))
