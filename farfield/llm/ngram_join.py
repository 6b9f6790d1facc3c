"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

The columns (n-grams) are dealt into blocks by hash. Two sets of sizes s and t with similarity num/den or more differ in
at most D = (s + t)(den - num) // (den + num) columns, so of more than D blocks at least one holds the same columns in
both rows: only rows that agree on a whole block can reach the bound. Each row emits one signature a block, for the
number of blocks that its size class and the next larger one need; equal signatures are the candidate products. Overlap
counts of the candidates are then accumulated block by block, and a pair is dropped as soon as what is left cannot reach
the overlap that its sizes ask for. Rows with equal sets are one class from the start; a class is compared with the hub that
shares most of its signatures, and after that only with rows of other components, so that a group of copies makes a star
and not all its pairs, while no link between components is lost.

Hashes have 64 bits; equal hashes count as equal n-grams and sets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farfield.llm import text as T
from farfield.llm.components import components, roots
from farfield.llm.scratch import free_names, id_text, stored

OVERLAP_BLOCKS = 8
HOT = 32
#: which rows of an entry may pair: all, those that don't link with their hub, those that do with those that don't
ALONE, PEERS, AROUND = 0, 1, 2
KEY = ["kind", "hub", "gram", "class"]
ORDERS = ("d", "xxhash64(node, 1)")
PARTS = 2
SEEN = 1 << 18
_SET, _PART, _LEVEL = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def shingle_sets(block: T.Block, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each document; a shorter document is one shingle, an empty one none."""
    words = block.word_hashes(lower=True)
    grams = T.gram_hashes(words, k)
    out = []
    for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(T.mix(T.gram_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


class Bounds:
    """What sizes allow at a similarity of num/den: size classes, and the number of blocks each needs."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the similarity must be above 0 and at most 1")
        self.num, self.den, self.edges = num, den, [1]

    def level(self, size: int) -> int:
        """Sets that link lie in the same class or in adjacent ones."""
        while self.edges[-1] <= size:
            at = self.edges[-1]
            self.edges.append(max(at + 1, (at - 1) * self.den // self.num + 1))
        return bisect_right(self.edges, size) - 1

    def differ(self, s: int, t: int) -> int:
        return (s + t) * (self.den - self.num) // (self.den + self.num)

    def overlap(self, s: int, t: int) -> int:
        """The least overlap with den * overlap >= num * (s + t - overlap)."""
        return -(-self.num * (s + t) // (self.den + self.num))

    def blocks(self, level: int) -> tuple[int, int]:
        """The most columns that two sets up to this class may differ in, and the number of blocks."""
        while len(self.edges) < level + 2:
            self.level(self.edges[-1])
        top = self.edges[level + 1] - 1
        most = self.differ(top, top)
        return most, most + 2 + most // 4


@lru_cache(maxsize=64)
def _bounds(num: int, den: int) -> Bounds:
    return Bounds(num, den)


@lru_cache(maxsize=4096)
def _salts(level: int, blocks: int) -> np.ndarray:
    return T.mix(np.arange(1, blocks + 1, dtype=np.uint64) * _PART + np.array([level + 1], np.uint64) * _LEVEL)


def signatures(found: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, need): a hash of the columns in each block, for this set's size class and the next.

    Blocks without a column are left out if more blocks have one than may differ: some of those are then shared with any
    set that links, and that set emits them as well. ``need`` is how many signatures of the class at least are shared with
    each set that links there. The lowest bit of a signature tells the two classes apart.
    """
    out, need = [found[:0]], [np.zeros(0, np.int32)]
    for level in (own := bounds.level(len(found)), own + 1) if len(found) else ():
        most, n = bounds.blocks(level)
        if not most:
            continue  # only equal sets link
        part = (found % np.uint64(n)).astype(np.int64)
        sums = np.zeros(n, np.uint64)
        np.add.at(sums, part, T.mix(found ^ _PART))
        full = np.bincount(part, minlength=n) > 0
        signed = (T.mix(sums ^ _salts(level, n)) & ~np.uint64(1)) | np.uint64(level & 1)
        spare = int(full.sum()) - most
        out.append(signed[full] if spare > 0 else signed)
        need.append(np.full(len(out[-1]), max(1, spare), np.int32))
    return np.concatenate(out), np.concatenate(need)


def _rows(k: int, num: int, den: int, part: int | None):
    """(doc_id, th, n, check, node) of every row; with a part, only (node, sigs, needs) of rows with a set and an id: the
    signatures of that part. Sets that a task has had already are left out as far as it remembers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, seen = _bounds(num, den), set()
        for batch in batches:
            for block in T.blocks(batch.column(1)):
                sets = shingle_sets(block, k)
                ids = batch.column(0).slice(block.first, block.rows)
                hashes = batch.column(2).slice(block.first, block.rows)
                with np.errstate(over="ignore"):
                    one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                    two = np.array([T.mix(s ^ _SET).sum(dtype=np.uint64) for s in sets], np.uint64)
                node = T.signed(T.mix(one ^ T.mix(two)))
                if part is None:
                    columns = [ids, hashes, pa.array([len(s) for s in sets], pa.int64()), pa.array(T.signed(one)), pa.array(node)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n", "check", "node"])
                    continue
                new = []
                for i, (x, named) in enumerate(zip(node.tolist(), ids.is_valid().to_pylist(), strict=True)):
                    if named and len(sets[i]) and x not in seen:
                        seen.add(x)
                        new.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                each = []
                for i in new:
                    sigs, needs = signatures(sets[i], bounds)
                    held = (sigs >> np.uint64(1)) % np.uint64(PARTS) == part
                    each.append((sigs[held], needs[held]))
                ends = pa.array(np.cumsum([0, *(len(x) for x, _ in each)]), pa.int32())
                columns = [pa.array(node[new])]
                for k_, kind in ((0, np.uint64), (1, np.int32)):
                    values = np.concatenate([np.zeros(0, kind), *(x[k_] for x in each)])
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(T.signed(values) if not k_ else values)))
                yield pa.RecordBatch.from_arrays(columns, names=["node", "sigs", "needs"])

    return run


def overlap(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """The overlap of two sorted sets, or -1 as soon as it cannot reach ``need``; accumulated over blocks of columns."""
    if need > min(len(a), len(b)):
        return -1
    cuts = (np.arange(1, OVERLAP_BLOCKS, dtype=np.uint64) * np.uint64(2**64 // OVERLAP_BLOCKS)).astype(np.uint64)
    at, bt = [0, *np.searchsorted(a, cuts).tolist(), len(a)], [0, *np.searchsorted(b, cuts).tolist(), len(b)]
    have = 0
    for k in range(OVERLAP_BLOCKS):
        x, y = a[at[k] : at[k + 1]], b[bt[k] : bt[k + 1]]
        if len(x) and len(y):
            where = np.minimum(np.searchsorted(y, x), len(y) - 1)
            have += int(np.count_nonzero(y[where] == x))
        if have + min(len(a) - at[k + 1], len(b) - bt[k + 1]) < need:
            return -1
    return have


def _distinct_sets(nodes: pa.Array, texts: pa.Array, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets of the distinct nodes of a batch, and each row's place among them."""
    _, first, place = np.unique(nodes.to_numpy(), return_index=True, return_inverse=True)
    return [s for block in T.blocks(texts.take(pa.array(first))) for s in shingle_sets(block, k)], place


def _verify(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(num, den)
        for batch in batches:
            (one, at), (two, bt) = (_distinct_sets(batch.column(i), batch.column(i + 2), k) for i in (0, 1))
            keep = []
            for i, j in zip(at.tolist(), bt.tolist(), strict=True):
                x, y = one[i], two[j]
                o = overlap(x, y, bounds.overlap(len(x), len(y)))
                keep.append(o >= 0 and den * o >= num * (len(x) + len(y) - o))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


ENTRIES = "hub long, node long, component long, linked boolean, n long, h long, d long, level int, gram long"


def _entries(k: int, num: int, den: int):
    """``ENTRIES``: one row for each element of the difference between a row's set and its hub's (no hub: the empty set).

    n, h and d are the sizes of the set, of the hub's set and of the difference; level is the size class; linked says
    whether the row links with the hub.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(num, den)
        names = [x.split()[0] for x in ENTRIES.split(", ")]
        for batch in batches:
            hubs = batch.column(3)
            sets, place = (None, None) if not batch.num_rows else _distinct_sets(hubs, batch.column(4), k)
            for block in T.blocks(batch.column(2)):
                found = shingle_sets(block, k)
                rows = range(block.first, block.first + block.rows)
                of = [sets[place[i]] for i in rows]
                differ = [np.setxor1d(x, y, assume_unique=True) if len(y) else x for x, y in zip(found, of, strict=True)]
                n, h, d = (np.array([len(s) for s in x], np.int64) for x in (found, of, differ))
                linked = (den + num) * d <= (den - num) * (n + h)
                level = np.array([bounds.level(int(x)) for x in n], np.int32)
                node, component, hub = (batch.column(i).slice(block.first, block.rows).to_numpy() for i in (0, 1, 3))
                gram = T.signed(np.concatenate(differ))
                columns = [pa.array(np.repeat(x, d)) for x in (hub, node, component, linked, n, h, d, level)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(gram)], names=names)

    return run


class JaccardJoin:
    """The links and components of a table of documents; see ``near_groups``."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den
        self.rows = id_text(docs).withColumn("th", F.xxhash64("text"))

    def _sets(self) -> DataFrame:
        return self.rows.select("doc_id", "text", "th").mapInArrow(_rows(self.k, self.num, self.den, None), "doc_id long, th long, n long, check long, node long")

    def _met_signatures(self, part: int) -> DataFrame:
        """(sig, node, need): the signatures of a part that more than one node has."""
        found = self.rows.select("doc_id", "text", "th").mapInArrow(_rows(self.k, self.num, self.den, part), "node long, sigs array<long>, needs array<int>")
        each = found.select("node", F.explode(F.arrays_zip("sigs", "needs")).alias("z")).select("node", F.col("z.sigs").alias("sig"), F.col("z.needs").alias("need"))
        return _several(each, "sig", "node").drop("low").distinct()

    def _texts(self, keys: DataFrame) -> DataFrame:
        """(node, text) of the nodes in ``keys`` (node, rep, th)."""
        found = self.rows.join(keys.select(F.col("rep").alias("doc_id"), "th", "node"), ["doc_id", "th"]).select("node", "text")
        return found.dropDuplicates(["node"])

    def _linked(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
        return both.mapInArrow(_verify(self.k, self.num, self.den), "a long, b long")

    def _ranked(self, entries: DataFrame) -> DataFrame:
        """The entries that more than one row of the hub holds, with their place ``at`` in the row's order from rare to frequent."""
        often = entries.groupBy("hub", "gram").agg(F.count("*").alias("df")).where("df > 1")
        row = Window.partitionBy("hub", "node")
        place = F.col("d") - F.count("*").over(row) + F.row_number().over(row.orderBy("df", "gram")) - 1
        return entries.join(often, ["hub", "gram"]).withColumn("at", place)

    def _shown(self, ranked: DataFrame, required: str, kind: int) -> DataFrame:
        """Prefix entries by size class: what a row needs to hold in common with any partner decides how many it shows."""
        each = ranked.withColumn("required", F.expr(required)).where("at + greatest(1, required) <= d")
        columns = ["hub", "gram", "node", "component", "linked", "n", "d", "level", "at"]
        return each.select(F.lit(kind).alias("kind"), *columns, F.explode(F.expr("array(level, level + 1)")).alias("class"))

    def _fits(self) -> str:
        """Whether two entries x and y that meet may belong to rows that link.

        Sets of sizes s and t link if they differ in at most (s + t)(den - num)/(den + num) elements. They differ in
        d_x + d_y less twice what their differences from the hub share, and what comes after the entry bounds that.
        """
        num, den = self.num, self.den
        return f"""x.component != y.component and greatest(x.level, y.level) = x.class and {num} * x.n <= {den} * y.n and {num} * y.n <= {den} * x.n
            and 2 * {den + num} * least(x.d - x.at, y.d - y.at) >= {den + num} * (x.d + y.d) - {den - num} * (x.n + y.n)"""

    def _contract(self, shown: DataFrame, tested: DataFrame, texts: DataFrame, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """One comparison for each row: with the first row, by ``order``, of the entries that it shows, the one it meets most often.

        Returns the entries with the components that result, the pairs compared so far, and the merged components.
        """
        first = F.struct(((F.col("kind") == AROUND) & ~F.col("linked")).alias("apart"), F.expr(order).alias("place"), "node", "component", "linked", "n", "d", "level", "at", "class")
        ends = shown.groupBy(KEY).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(first).alias("y")).where("low < high")
        x = F.struct("node", "component", "linked", "n", "d", "level", "at", "class")
        near = shown.join(ends, KEY).select("kind", x.alias("x"), "y").where(self._fits()).where(f"kind != {AROUND} or y.linked and not x.linked")
        pair = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]
        ends = [F.col("x.node").alias("node"), F.col("x.component").alias("ca"), F.col("y.component").alias("cb")]
        counts = near.select(*pair, *ends).join(tested, ["a", "b"], "left_anti").groupBy("node", "a", "b", "ca", "cb").agg(F.count("*").alias("times"))
        best = counts.groupBy("node").agg(F.max(F.struct("times", "a", "b", "ca", "cb")).alias("p")).select("p.a", "p.b", "p.ca", "p.cb").distinct()
        best = stored(best, "compared")
        merged = components(self._linked(best.select("a", "b").distinct(), texts).join(best, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        merged = stored(merged, "merged")
        return self._renamed(shown, merged), tested.union(best.select("a", "b")), merged

    def _renamed(self, shown: DataFrame, merged: DataFrame) -> DataFrame:
        """Entries with their components after a merge, without those that meet no other component any more."""
        top = merged.select(F.col("node").alias("component"), F.col("component").alias("top"))
        named = shown.join(top, "component", "left").withColumn("component", F.coalesce("top", "component")).drop("top")
        ends = named.groupBy(KEY).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(KEY)
        return stored(named.join(ends, KEY), "open")

    def _rest(self, held: DataFrame, texts: DataFrame, tested: DataFrame) -> DataFrame:
        """(a, b): components among ``held`` (node, component) that links join.

        The columns are ordered from rare to frequent; a row shows its first ones, as many as any partner must share one
        of. Rows that meet in a column of at most ``HOT`` rows may be paired. A column that more rows show belongs to a family
        of texts, and its rows are recentred: each is compared with the least row of the column (of its size class), and
        its difference from that hub takes the place of its set. What the family has in common drops out, so that
        its rows meet only in what they have changed alike. Two rows that both link with the hub need no pair. Before all
        that meet are paired, ``ORDERS`` rounds compare each row with one other and merge what links.
        """
        num, den = self.num, self.den
        both, apart = den + num, den - num
        # the least that a row shares with a partner of the size that allows most, for a row that doesn't link with its hub
        size = f"least(greatest(h, ({num} * n + {den - 1}) div {den}), {den} * n div {num})"
        open_ = f"ceil(({both} * (d + abs({size} - h)) - {apart} * (n + {size})) / {2 * both})"
        # the same if the partner doesn't link with the hub
        other = f"floor(({both} * d + {apart} * (h - n)) / {2 * both}) + 1"
        make = _entries(self.k, num, den)
        start = held.join(texts, "node").select("node", "component", "text", F.lit(0).cast("long").alias("hub"), F.lit("").alias("hub_text"))
        shown = stored(self._shown(self._ranked(stored(start.mapInArrow(make, ENTRIES), "entries")), open_, ALONE), "shown")
        ends = shown.groupBy(KEY).agg(F.count("*").alias("rows"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("least")).where("low < high")
        shown = stored(shown.join(ends.drop("low", "high"), KEY), "shown")
        members = stored(shown.where(F.col("rows") > HOT).where("node != least").select("node", "component", F.col("least").alias("hub")).distinct(), "members")
        hub_texts = texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text"))
        around = members.join(texts, "node").join(hub_texts, "hub").select("node", "component", "text", "hub", "hub_text")
        entries = stored(around.mapInArrow(make, ENTRIES), "entries")
        ranked = stored(self._ranked(entries), "ranked")
        far = ranked.where("not linked")
        shown = shown.where(F.col("rows") <= HOT).select(*(few := self._shown(far, other, PEERS)).columns).union(few)
        shown = shown.union(self._shown(ranked.where("linked"), other, AROUND)).union(self._shown(far, open_, AROUND))
        of_hub = held.select(F.col("node").alias("hub"), F.col("component").alias("b"))
        merged = [stored(components(entries.where("linked").select("hub", F.col("component").alias("a")).distinct().join(of_hub, "hub")), "merged")]
        shown = self._renamed(shown, merged[0])
        for order in ORDERS:
            shown, tested, more = self._contract(shown, tested, texts, order)
            merged.append(more)
        x, y = (shown.select(*KEY, F.struct("node", "component", "linked", "n", "d", "level", "at", "class").alias(side)) for side in "xy")
        which = f"if(kind = {AROUND}, x.linked and not y.linked, x.node < y.node)"
        pairs = x.join(y, KEY).where(f"{self._fits()} and {which}")
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.col("x.component").alias("ca"), F.col("y.component").alias("cb"))
        pairs = stored(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        links = self._linked(pairs.select("a", "b").distinct(), texts).join(pairs, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        for each in merged:
            links = links.union(each.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        return links

    def groups(self) -> DataFrame:
        """(doc_id, th, n_shingles, component_id) for every row; th is a hash of the text."""
        sets = stored(self._sets(), "sets")
        # signatures are dealt into parts that are joined one after the other, so that a part of them is on disk at a time
        met = reduce(DataFrame.union, [stored(self._met_signatures(part), "met") for part in range(PARTS)])
        side = F.col("sig").bitwiseAND(1).alias("side")
        enough = met.groupBy("node", side).agg(F.count("*").alias("c"), F.max("need").alias("need")).where("c >= need").select("node", "side")
        shared = stored(_several(met.select("sig", "node", side).join(enough, ["node", "side"]).select("sig", "node"), "sig", "node").withColumnRenamed("low", "hub"), "shared")
        places = sets.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min_by("th", "doc_id").alias("th"))
        texts = stored(self._texts(shared.select("node").distinct().join(places, "node")), "texts")
        # one pair for each row: the hub with which it shares the most signatures; all others are decided below
        best = shared.where("node > hub").groupBy("hub", "node").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("hub", F.struct("n", "hub")).alias("a"))
        pairs = stored(best.select("a", F.col("node").alias("b")), "pairs")
        label = roots(stored(self._linked(pairs, texts), "links"))
        # what the hubs left open: rows that share a signature and lie in different components
        named = shared.select("sig", "node").join(label, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
        held = stored(_several(named, "sig", "component").select("node", "component").distinct(), "held")
        links = self._rest(held, texts, pairs)
        merged = components(links).select(F.col("node").alias("root"), F.col("component").alias("top"))
        whole = sets.select("doc_id", "th", "n", "node").join(label, "node", "left").withColumn("root", F.coalesce("component", "node"))
        whole = whole.join(merged, "root", "left").withColumn("root", F.coalesce("top", "root"))
        least = whole.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
        lone = whole.where("n = 0 or doc_id is null").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        rows = whole.where("n > 0 and doc_id is not null").join(least, "root")
        return rows.select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("least").alias("component_id")).union(lone)


def _several(rows: DataFrame, key: str, what: str) -> DataFrame:
    """The rows whose key holds more than one value of ``what``, with the least one as ``low``.

    Aggregated before the shuffle and joined back, so that a join, which can be split, carries a hot key.
    """
    ends = rows.groupBy(key).agg(F.min(what).alias("low"), F.max(what).alias("high")).where("low < high").drop("high")
    return rows.join(ends, key)


def near_groups(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the least doc_id that links reach.

    Two rows link when den * |intersection| >= num * |union| of their sets of k-word shingles (A-Z lower-cased).
    Null or wordless text: no shingles, linked with nothing, its own component. Null doc_id: component null, linked with
    nothing. Repeated rows are returned as often as they come. Other columns are ignored. No rows give no rows.
    """
    return JaccardJoin(docs, k, num, den).groups().drop("th")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, less near-duplicates: of each group the row with the least doc_id stays.

    A row that comes more than once (same id and text) stays once; rows with a null doc_id all stay.
    """
    at, th, copies = free_names(docs, "at", "th", "copies")
    stay = JaccardJoin(docs, k, num, den).groups().where("doc_id = component_id").groupBy("doc_id", "th").agg(F.count("*").alias(copies))
    stay = stored(stay.select(F.col("doc_id").alias(at), F.col("th").alias(th), copies), "stay")
    keyed = docs.withColumns({at: F.col("doc_id").cast("long"), th: F.xxhash64(F.col("text").cast("string"))})
    once = keyed.join(stay.where(F.col(copies) == 1), [at, th])
    often = keyed.join(stay.where(F.col(copies) > 1), [at, th]).dropDuplicates([at, th])
    return once.union(often).select(*docs.columns).union(docs.where("doc_id is null"))
