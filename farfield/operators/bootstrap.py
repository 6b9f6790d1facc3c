"""A hierarchical bootstrap (seed, region, row) of ID minus OOD, for metrics of sums and for metrics of ranks.

No row is ever copied for a replicate. The rows of each side and seed stand in ranges of their score; a task carries, for a
block of rows, the weights of all replicates as a matrix, and adds up weighted sums, the sums of ten calibration bins, and
for each replicate how much weight of positives stands above how much of negatives. What tasks emit is a few vectors over
replicates; the vectors of consecutive ranges are merged in order, with the ties that meet at their borders. Without a
score there are no ranks: rows stand in ranges of their region, and only the weighted sums are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farfield.functions.columns import TEN_BINS, finite
from farfield.sources.scratch import cut

BLOCK_ROWS = 256
REPLICATES = 128  # replicates that a task weighs at a time
_MASK = (1 << 64) - 1
_BELOW = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(12)])  # Poisson, mean 1


def _stir(h: np.ndarray, p: np.ndarray | int, spare: np.ndarray) -> np.ndarray:
    """A round of ``mixed`` in place."""
    h ^= p
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= np.right_shift(h, np.uint64(29), out=spare)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= np.right_shift(h, np.uint64(32), out=spare)
    return h


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of whole numbers, element by element."""
    with np.errstate(over="ignore"):
        h = np.uint64(0x9E3779B97F4A7C15)
        for p in parts:
            p = np.asarray(p).astype(np.int64).view(np.uint64) if isinstance(p, np.ndarray) else np.uint64(int(p) & _MASK)
            h = (h ^ p) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(32))
    return h


def picked(h: np.ndarray, n: int) -> np.ndarray:
    """One of n things by a hash."""
    return ((h >> np.uint64(11)) % np.uint64(n)).astype(np.int64)


def poisson(h: np.ndarray) -> np.ndarray:
    return np.searchsorted(_BELOW, (h >> np.uint64(11)).astype(np.float64) / float(1 << 53), side="right").astype(np.float64)


def _by_first_bits() -> np.ndarray:
    """The Poisson draw of all hashes with the same first 12 bits; NaN where they differ."""
    low = np.arange(1 << 12, dtype=np.uint64) << np.uint64(52)
    least, most = poisson(low), poisson(low | np.uint64((1 << 52) - 1))
    return np.where(least == most, least, np.nan)


_DRAWN = _by_first_bits()


class _Draws:
    """Which (replicate, slot, draw) take a region of a seed: the entries of a block of replicates, by slot."""

    def __init__(self, draw: int, group: int, seeds: int, first: int, last: int):
        self.draw, self.group, self.first, self.n, self.seeds = draw, group, first, last - first, seeds
        b, j = np.divmod(np.arange(self.n * seeds), seeds)
        self.b, self.j = b + first, j
        self.seed = picked(mixed(draw, 1, group, self.b, self.j), seeds)
        self.known: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def entries(self, side: int, seed: int, region: int, regions: int) -> tuple[np.ndarray, np.ndarray]:
        """(slot, draw) of each time that the region is drawn, by slot; slot is the place of (replicate, slot of a seed)."""
        key = (side, seed, region, regions)
        if key not in self.known:
            slots = np.flatnonzero(self.seed == seed)
            i = np.arange(regions)
            drawn = picked(mixed(self.draw, 2, self.group, side, self.b[slots][:, None], self.j[slots][:, None], i[None, :]), regions)
            at, i = np.nonzero(drawn == region)
            self.known[key] = slots[at], i
        return self.known[key]

    def own(self, seed: int) -> np.ndarray:
        """The slots that draw a seed; vectors over replicates hold these alone."""
        return np.flatnonzero(self.seed == seed)

    def drawn(self, slot: np.ndarray, i: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Entries by rows: the weights of ``mixed(draw, 3, row, b, j, i)``. Rounds over b and j are taken once for equal ones."""
        new_slot = np.r_[True, slot[1:] != slot[:-1]]
        b, j = (x[slot[new_slot]].astype(np.uint64) for x in (self.b, self.j))
        new_b = np.r_[True, b[1:] != b[:-1]]
        h = np.repeat(mixed(self.draw, 3, row)[None, :], new_b.sum(), axis=0)
        spare = np.empty((len(slot), len(row)), np.uint64)
        h = _stir(h, b[new_b][:, None], spare[: len(h)])[np.cumsum(new_b) - 1]
        h = _stir(h, j[:, None], spare[: len(h)])[np.cumsum(new_slot) - 1]
        h = _stir(h, i.astype(np.uint64)[:, None], spare)
        w = _DRAWN[np.right_shift(h, np.uint64(52), out=spare).view(np.int64)]
        open_ = np.isnan(w)
        w[open_] = poisson(h[open_])
        return w

    def weights(self, side: int, seed: int, region: np.ndarray, regions: int, row: np.ndarray) -> np.ndarray:
        """Rows by own slots: how often each slot takes each row."""
        slots = self.own(seed)
        out = np.zeros((len(row), len(slots)))
        for r in np.unique(region):
            slot, i = self.entries(side, seed, int(r), regions)
            if len(slot):
                rows = np.flatnonzero(region == r)
                starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                out[np.ix_(rows, np.searchsorted(slots, slot[starts]))] = np.add.reduceat(self.drawn(slot, i, row[rows]), starts, axis=0).T
        return out

    def add_sums(self, sums: np.ndarray, side: int, seed: int, region: np.ndarray, regions: int, row: np.ndarray, features: np.ndarray) -> None:
        """Adds to ``sums`` (features by own slots) the weighted features of rows that come by region."""
        slots = self.own(seed)
        edges = np.flatnonzero(np.r_[True, region[1:] != region[:-1], True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            slot, i = self.entries(side, seed, int(region[a]), regions)
            if len(slot):
                starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                places = np.searchsorted(slots, slot[starts])
                for k in range(a, b, BLOCK_ROWS):
                    end = min(b, k + BLOCK_ROWS)
                    sums[:, places] += np.add.reduceat(self.drawn(slot, i, row[k:end]) @ features[k:end], starts, axis=0).T


class _Ranks:
    """Weights of positives above negatives, of rows that come by ascending score; equal scores count a half."""

    def __init__(self, slots: int):
        zero = lambda: np.zeros(slots)
        self.first = self.last = None  # scores of the border ties
        self.head, self.tail = (zero(), zero()), (zero(), zero())  # (positives, negatives) of the first and last score
        self.above, self.pos, self.neg = zero(), zero(), zero()  # of all but an open last score

    def add(self, score: float, pos: np.ndarray, neg: np.ndarray) -> None:
        """The weights of all rows of a score, or of some of the last one."""
        if self.first is None:
            self.first = score
        if score == self.last:
            self.tail = (self.tail[0] + pos, self.tail[1] + neg)
            return
        self.close()
        self.last, self.tail = score, (pos, neg)

    def close(self) -> None:
        pos, neg = self.tail
        if self.last == self.first and self.last is not None:
            self.head = (pos.copy(), neg.copy())
        self.above += pos * (self.neg + 0.5 * neg)
        self.pos, self.neg = self.pos + pos, self.neg + neg
        self.tail = (np.zeros_like(pos), np.zeros_like(neg))


def _partials(frames: Iterator[pd.DataFrame], names: list[str], replicates: int, draw: int, scored: bool = True) -> Iterator[pd.DataFrame]:
    """Rows by (group, side, seed) and score: for each, and each block of replicates, sums and ranks. Block -1: every row once.

    If not ``scored``, rows come by (group, side, seed) and region, and ranks and bins stay empty.
    """
    edges = np.array(TEN_BINS)
    state: dict[tuple, dict] = {}
    place = 0

    def emit(key: tuple) -> pd.DataFrame:
        rows = []
        for block, s in state.pop(key)["blocks"].items():
            ranks = s["ranks"]
            ranks.close()
            vectors = [s["sums"], ranks.above, ranks.pos, ranks.neg, *ranks.head, *s["tail"]]
            rows.append((*key[:4], block, place, ranks.first, ranks.last, *(v.tobytes() for v in vectors)))
        return pd.DataFrame(rows, columns=["g", "side", "s", "n_seeds", "block", "at", "first", "last", "sums", "above", "pos", "neg", "hp", "hn", "tp", "tn"])

    for f in frames:
        for key, rows in f.groupby(["g", "side", "s", "n_seeds"], sort=False):
            key = tuple(int(k) for k in key)
            for old in [k for k in state if k != key]:
                yield emit(old)
                place += 1
            own = state.setdefault(key, {"blocks": {}, "draws": {}})
            for block in range(-(-replicates // REPLICATES)):
                if block not in own["draws"]:
                    own["draws"][block] = _Draws(draw, key[0], key[3], block * REPLICATES, min(replicates, (block + 1) * REPLICATES))
            used = [-1, *(block for block, d in own["draws"].items() if len(d.own(key[2])))]
            if not scored:
                features = rows[names].to_numpy(float)
                region, h, regions = rows["r"].to_numpy(), rows["h"].to_numpy(), int(rows["n_regions"].iloc[0])
                for block in used:
                    n = 1 if block < 0 else len(own["draws"][block].own(key[2]))
                    s = own["blocks"].setdefault(block, {"sums": np.zeros((len(names), n)), "ranks": _Ranks(n), "tail": (np.zeros(n), np.zeros(n))})
                    if block < 0:
                        s["sums"] += features.sum(axis=0)[:, None]
                    else:
                        own["draws"][block].add_sums(s["sums"], key[1], key[2], region, regions, h, features)
                continue
            for a in range(0, len(rows), BLOCK_ROWS):
                part = rows.iloc[a : a + BLOCK_ROWS]
                y, p = part["y"].to_numpy(float), part["p"].to_numpy(float)
                bins = np.searchsorted(edges, p, side="right")
                hot = np.eye(10)[bins]
                features = np.hstack([part[names].to_numpy(float), hot, hot * y[:, None], hot * p[:, None]])
                for block in used:
                    if block < 0:
                        w = np.ones((len(part), 1))
                    else:
                        w = own["draws"][block].weights(key[1], key[2], part["r"].to_numpy(), int(part["n_regions"].iloc[0]), part["h"].to_numpy())
                    s = own["blocks"].setdefault(block, {"sums": np.zeros((features.shape[1], w.shape[1])), "ranks": _Ranks(w.shape[1]), "tail": None})
                    s["sums"] += features.T @ w
                    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                    pos, neg = (np.add.reduceat(w * side[:, None], starts, axis=0) for side in (y, 1 - y))
                    for k, at in enumerate(starts):
                        s["ranks"].add(float(p[at]), pos[k], neg[k])
                    s["tail"] = s["ranks"].tail
    for key in list(state):
        yield emit(key)
        place += 1


def _merged(rows: pd.DataFrame, n_sums: int, scored: bool = True) -> dict[str, np.ndarray]:
    """The sums and the area of ordered partial results of one (group, side, seed, block)."""
    rows = rows.sort_values(["range", "at"])
    vectors = lambda r, *c: [np.frombuffer(r[x]) for x in c]
    sums = above = pos = neg = None
    last, tail = None, None
    for r in rows.to_dict("records"):
        s = np.frombuffer(r["sums"]).reshape(n_sums, -1)
        a, p, n, hp, hn, tp, tn = vectors(r, "above", "pos", "neg", "hp", "hn", "tp", "tn")
        if sums is None:
            sums, above, pos, neg = s.copy(), a.copy(), p.copy(), n.copy()
        else:
            above = above + a + p * neg
            if r["first"] == last:  # the ties of both: positives of the later part count half of the earlier negatives, and the other way
                above += 0.5 * (tail[0] * hn - hp * tail[1])
            sums, pos, neg = sums + s, pos + p, neg + n
        tail = (tail[0] + tp, tail[1] + tn) if tail is not None and r["first"] == r["last"] == last else (tp, tn)
        last = r["last"]
    if not scored:
        nothing = np.full(sums.shape[1], np.nan)
        return {"sums": sums, "auc": nothing, "ece": nothing, "n": nothing}
    with np.errstate(invalid="ignore", divide="ignore"):
        auc = np.where(pos * neg > 0, above / (pos * neg), np.nan)
        n, hits, conf = (sums[n_sums - 30 + 10 * k : n_sums - 20 + 10 * k] for k in range(3))
        ece = np.abs(hits - conf).sum(axis=0) / n.sum(axis=0)
    return {"sums": sums[: n_sums - 30], "auc": auc, "ece": ece, "n": n.sum(axis=0)}


def _same(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows that agree in ``on``, nulls included; columns of ``on`` once."""
    other = b.withColumnsRenamed({c: f"__on_{c}" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__on_{c}"))
    return a.join(other, condition).drop(*[f"__on_{c}" for c in on])


def sample_bootstrap(
    rows: DataFrame, by: list[str], side: Column, seed: str, region: str, key: list[str], order: str, sums: dict[str, Column], metric: Column | dict[str, Column],
    replicates: int = 1000, draw: int = 0, scored: tuple[Column, Column] | None = None,
) -> DataFrame:
    """(by, metric, id, ood, delta, lo, hi, n_seeds) for each metric; without the column metric if one is given, not a dict.

    ``side`` is 'id', 'ood' or null (not used). A metric is a function of the sums of ``sums`` and, if ``scored`` gives truth
    (0 or 1) and probability, of ``auc`` and ``ece`` (ten bins). Rows are first reduced to the last of each (region, key)
    within a seed; seeds are never merged. The estimate is the mean over the seeds that have both sides. A replicate draws
    seeds with replacement, and for each drawn seed and side its regions with replacement; the rows of each drawn region
    weigh by hashed Poisson draws. The interval holds the middle 95 of 100 of the replicates whose metric is defined.
    """
    y, p = scored if scored else (F.lit(0), F.lit(0.0))
    names = list(sums)
    held = rows.withColumn("__side", F.when(side == "id", 0).when(side == "ood", 1)).where("__side is not null")
    held = held.select(*by, "__side", F.col(seed).alias("__seed"), F.col(region).alias("__region"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col(order).alias("__order"), F.struct(*[c.cast("double").alias(n) for n, c in sums.items()], y.cast("double").alias("__y"), p.cast("double").alias("__p")).alias("__v"))
    keys = [f"__k{i}" for i in range(len(key))]
    last = held.groupBy(*by, "__side", "__seed", "__region", *keys).agg(F.max_by("__v", "__order").alias("v"))
    last = cut(last, "bootstrap")
    group = F.xxhash64(F.lit(draw), *by)
    # the places of seeds and regions: as many rows as there are (seed, region)
    places = last.select(*by, "__side", "__seed", "__region").distinct()
    both = places.groupBy(*by, "__seed").agg(F.count_distinct("__side").alias("k")).where("k = 2").drop("k")
    seeds = both.withColumns({"s": F.row_number().over(Window.partitionBy(*by).orderBy("__seed")) - 1, "n_seeds": F.count("*").over(Window.partitionBy(*by))})
    here = [*by, "__side", "__seed"]
    places = places.withColumns({"r": F.dense_rank().over(Window.partitionBy(*here).orderBy("__region")) - 1, "n_regions": F.count("*").over(Window.partitionBy(*here))})
    places = cut(_same(places, seeds, [*by, "__seed"]), "places")
    full = _same(last, places, [*by, "__side", "__seed", "__region"])
    ready = full.select(
        group.alias("g"), F.col("__side").cast("long").alias("side"), F.col("s").cast("long").alias("s"), F.col("n_seeds").cast("long").alias("n_seeds"), F.col("r").cast("long").alias("r"), F.col("n_regions").cast("long").alias("n_regions"),
        F.xxhash64("__side", "__seed", "__region", *keys).alias("h"), F.col("v.__y").alias("y"), F.col("v.__p").alias("p"), *[F.col(f"v.{n}").alias(f"f_{n}") for n in names],
    )
    fields = [f"f_{n}" for n in names]
    has_score = scored is not None
    n_sums = len(names) + (30 if has_score else 0)
    # equal scores (or regions) may lie on both sides of a border, so that one is no hot range
    place = ["g", "side", "s", "p" if has_score else "r", "h"]
    ranged = ready.repartitionByRange(*place).sortWithinPartitions(*place)
    ranged = ranged.withColumn("range", F.spark_partition_id())

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = None

        def seen() -> Iterator[pd.DataFrame]:
            nonlocal number
            for f in frames:
                if len(f):
                    number = int(f["range"].iloc[0])
                    yield f

        for out in _partials(seen(), fields, replicates, draw, has_score):
            yield out.assign(range=number)

    vectors = ", ".join(f"{c} binary" for c in ("sums", "above", "pos", "neg", "hp", "hn", "tp", "tn"))
    parts = ranged.mapInPandas(partial, f"g long, side long, s long, n_seeds long, block int, at int, first double, last double, {vectors}, range int")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        got = _merged(rows, n_sums, has_score)
        g, side_, s, n_seeds, block = (int(rows[c].iloc[0]) for c in ("g", "side", "s", "n_seeds", "block"))
        if block < 0:
            b, j = np.array([-1]), np.array([s])
        else:
            draws = _Draws(draw, g, n_seeds, block * REPLICATES, min(replicates, (block + 1) * REPLICATES))
            own = draws.own(s)
            b, j = draws.b[own], draws.j[own]
        columns = {"g": g, "side": side_, "b": b, "j": j, "auc": got["auc"], "ece": got["ece"]}
        return pd.DataFrame(columns | {n: got["sums"][k] for k, n in enumerate(names)})

    found = parts.groupBy("g", "side", "s", "n_seeds", "block").applyInPandas(merge, "g long, side long, b long, j long, auc double, ece double" + "".join(f", `{n}` double" for n in names))
    metrics = metric if isinstance(metric, dict) else {"": metric}
    each = cut(found.withColumn("m", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), finite(c.cast("double")).alias("value")) for n, c in metrics.items()]))).select("g", "side", "b", "j", "m.*").where("value is not null"), "replicates")
    pairs = each.groupBy("g", "metric", "b", "j").agg(*[F.max(F.when(F.col("side") == k, F.col("value"))).alias(n) for k, n in enumerate(("id", "ood"))]).where("id is not null and ood is not null")
    point = pairs.where("b < 0").groupBy("g", "metric").agg(F.avg("id").alias("id"), F.avg("ood").alias("ood"), F.avg(F.col("id") - F.col("ood")).alias("delta"), F.count("*").alias("n_seeds"))
    means = pairs.where("b >= 0").groupBy("g", "metric", "b").agg(F.avg(F.col("id") - F.col("ood")).alias("m"))
    bounds = means.groupBy("g", "metric").agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    groups = places.select(*by).distinct().withColumn("g", group)
    out = groups.join(point.join(bounds, ["g", "metric"], "left"), "g")
    return out.select(*by, *(["metric"] if isinstance(metric, dict) else []), "id", "ood", "delta", "lo", "hi", "n_seeds")
