"""Benchmark decontamination by spaced-seed hashing.

A fixed mask lays some token positions of a short span open and ignores the others, so that a substitution at an ignored
position leaves the hash as it is. Test items and documents are hashed under each mask, and the hashes are joined. A document
and an item that share one are compared on all diagonals (place in the document less place in the item) that hold a hit:
matches count up, others down, and every stretch that comes out positive counts. An item of fewer than ``MIN_WORDS`` words is
one hash over all its words.

Before the join, a bit field of the test hashes (at most ``FILTER_BITS``, whatever the size of the benchmark) is broadcast,
so that of a document only hashes that may be in the benchmark are shuffled. Items of equal words are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farfield.llm import text as T
from farfield.llm.scratch import free_names, id_text, stored

#: fixed masks of span 8 to 11; 1 is compared, 0 is ignored
MASKS = ("11101101", "11011011", "1100101011", "10110100111")
MIN_WORDS = 8  # an item with fewer words must be there word by word
ALONE = 4  # an item with fewer words than that must be the whole document
MIN_COVER = 0.5  # share of an item's words that must match
LONG_STRETCH = 13  # matched words of one stretch that are enough, however long the item is
MISMATCH = 2
FILTER_BITS = 1 << 27
DENSE = 1 << 22  # products of places over which diagonals are counted by Fourier transform

_LETTERS = T._LOWER.copy()
_LETTERS[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = 0


def tokens(block: T.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without ASCII punctuation (words of it alone are left out), and bounds by document."""
    hashes = block.word_hashes(table=_LETTERS)
    blank = T.mix(np.zeros(1, np.uint64))[0]
    keep = hashes != blank
    before = np.concatenate([[0], np.cumsum(keep)])
    return hashes[keep], before[block.bounds]


def spaced(hashes: np.ndarray, mask: str) -> np.ndarray:
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            out += hashes[j : j + n] * T.powers(T._Q, len(mask) + 1)[j + 1]
    return T.mix(out)


def _masks(lengths: list[int]) -> list[str]:
    return [*MASKS, *("1" * n for n in sorted(lengths))]


def seeds(words: np.ndarray, bounds: np.ndarray, masks: list[str], whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of the seeds of each mask. A mask of ones stands for an item of that many words: with ``whole`` for rows
    that have exactly as many, otherwise for all places, but below ``ALONE`` words again for whole rows alone."""
    size = np.diff(bounds)
    for mask in masks:
        h = spaced(words, mask)
        if not len(h):
            continue
        row = np.repeat(np.arange(len(size)), size)[: len(h)]
        ok = np.arange(len(h)) + len(mask) <= bounds[row + 1]
        if "0" not in mask and (whole or len(mask) < ALONE):
            ok &= size[row] == len(mask)
        elif whole:
            ok &= size[row] >= MIN_WORDS
        yield row[ok], h[ok]


def _item_seeds(lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in T.blocks(batch.column(1)):
                words, bounds = tokens(block)
                for row, h in seeds(words, bounds, _masks(lengths), whole=True):
                    yield pa.RecordBatch.from_arrays([pa.array(T.signed(h)), batch.column(0).take(pa.array(row + block.first))], names=["seed", "item"])

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, item, n_words, text): item is a hash of the words."""
    for batch in batches:
        for block in T.blocks(batch.column(1)):
            words, bounds = tokens(block)
            item = [T.mix_int(int(T.gram_hashes(words[a:b], b - a)[0]) + b - a) if b > a else 0 for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            rows = slice(block.first, block.first + block.rows)
            yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(T.signed(np.array(item, np.uint64))), pa.array(np.diff(bounds)), batch.column(1)[rows]], names=["item_id", "item", "n_words", "text"])


def _slots(seed, bits: int):
    """Two places of a hash in the bit field, for numpy and for columns alike (longs are signed)."""
    mask = bits - 1
    if isinstance(seed, np.ndarray):
        return (seed & np.uint64(mask)).astype(np.int64), ((seed >> np.uint64(32)) & np.uint64(mask)).astype(np.int64)
    return seed.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(seed, 32).bitwiseAND(F.lit(mask))


def _field(keys: DataFrame) -> np.ndarray:
    """The bit field of the distinct hashes of ``keys`` (seed): 16 bits a hash as a power of two, at most ``FILTER_BITS``."""
    n = keys.count()
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    slots = keys.select(F.explode(F.array(*_slots(F.col("seed"), bits))).alias("s"))
    words = slots.groupBy(F.shiftright("s", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("w")).toArrow()
    field = np.zeros(bits >> 6, np.int64)
    field[words.column("at").to_numpy()] = words.column("w").to_numpy()
    return np.unpackbits(field.view(np.uint8), bitorder="little").view(bool) if bits <= 1 << 22 else field.view(np.uint8)


def _probe(field: np.ndarray, at: np.ndarray) -> np.ndarray:
    if field.dtype == bool:
        return field[at]
    return (field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _doc_seeds(shared, lengths: list[int]):
    """(seed, key): the distinct hashes of each document that may be in the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        bits = len(field) * (1 if field.dtype == bool else 8)
        for batch in batches:
            for block in T.blocks(batch.column(1)):
                words, bounds = tokens(block)
                for row, h in seeds(words, bounds, _masks(lengths)):
                    one, two = _slots(h, bits)
                    hit = np.flatnonzero(_probe(field, one))
                    hit = hit[_probe(field, two[hit])]
                    if len(hit):
                        pairs = np.unique(np.stack([T.signed(h[hit]), row[hit]], axis=1), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), batch.column(0).take(pa.array(pairs[:, 1] + block.first))], names=["seed", "key"])

    return run


def diagonals(d: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The diagonals on which a document and an item share a seed, those with most hits first.

    Hits are counted by diagonal and never listed: by the places of the rarer side, or by a Fourier transform where one seed
    has very many places on both sides.
    """
    n = len(d) + len(i)
    count = np.zeros(n, np.int64)
    masks = MASKS if len(i) >= MIN_WORDS else ("1" * len(i),)
    for mask in masks:
        x, y = spaced(d, mask), spaced(i, mask)
        if not len(x) or not len(y):
            continue
        both, place = np.unique(np.concatenate([x, y]), return_inverse=True)
        x, y = place[: len(x)], place[len(x) :]
        often = np.flatnonzero((np.bincount(x, minlength=len(both)) > 0) & (np.bincount(y, minlength=len(both)) > 0))
        if not len(often):
            continue
        held = np.zeros(len(both), bool)
        held[often] = True
        xs, ys = np.flatnonzero(held[x]), np.flatnonzero(held[y])
        xs, ys = xs[np.argsort(x[xs], kind="stable")], ys[np.argsort(y[ys], kind="stable")]
        xc, yc = np.cumsum(np.bincount(x, minlength=len(both)) * held), np.cumsum(np.bincount(y, minlength=len(both)) * held)
        for k in often.tolist():
            a, b = xs[xc[k - 1] if k else 0 : xc[k]], ys[yc[k - 1] if k else 0 : yc[k]]
            if len(a) * len(b) > DENSE:
                size = 1 << (n - 1).bit_length()
                one, two = np.zeros(size), np.zeros(size)
                one[a], two[len(i) - b] = 1, 1
                count += np.rint(np.fft.irfft(np.fft.rfft(one) * np.fft.rfft(two), size)[:n]).astype(np.int64)
            elif len(a) < len(b):
                for p in a.tolist():
                    count[p + len(i) - b] += 1
            else:
                for p in b.tolist():
                    count[a + (len(i) - p)] += 1
    found = np.flatnonzero(count)
    return found[np.argsort(-count[found], kind="stable")] - len(i)


def stretches(same: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of a comparison where matches outnumber ``MISMATCH`` times the others, from left to right: (start, end).

    A stretch starts where the sum is at its lowest so far and ends where it is highest before it falls below that; what
    follows is looked at anew.
    """
    out, at = [], 0
    while at < len(same):
        total = np.cumsum(np.where(same[at:], 1, -MISMATCH))
        up = int(np.argmax(same[at:]))
        if not same[at + up]:
            break
        base = total[up] - 1
        below = np.flatnonzero(total[up:] < base)
        limit = up + int(below[0]) if len(below) else len(total)
        stop = up + int(np.argmax(total[up:limit]))
        out.append((at + up, at + stop + 1))
        at += stop + 1
    return out


def match(d: np.ndarray, i: np.ndarray) -> tuple[int, int, int] | None:
    """(matched words of the item, first and last word in the document), or None if they are no evidence."""
    if len(i) < MIN_WORDS:
        if len(i) < ALONE and len(d) != len(i):
            return None
        for at in diagonals(d, i).tolist():
            if at >= 0 and np.array_equal(d[at : at + len(i)], i):
                return len(i), at, at + len(i)
        return None
    covered = np.zeros(len(i), bool)
    first, last, longest = len(d), 0, 0
    for diagonal in diagonals(d, i).tolist():
        a, b = max(0, -diagonal), min(len(i), len(d) - diagonal)
        same = i[a:b] == d[a + diagonal : b + diagonal]
        for start, end in stretches(same):
            n = int(same[start:end].sum())
            if n >= MIN_WORDS // 2:
                covered[a + start : a + end] |= same[start:end]
                first, last, longest = min(first, a + start + diagonal), max(last, a + end + diagonal), max(longest, n)
        if covered.all():
            break
    n = int(covered.sum())
    return (n, first, last) if n >= MIN_WORDS and (n >= MIN_COVER * len(i) or longest >= LONG_STRETCH) else None


HITS = "key long, item long, matched long, item_words long, first_word long, last_word long"


ITEM_WORDS = 1 << 20  # words of items that a task keeps


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, item, text) come ordered by key, first the document (null item), then the items to compare it with."""
    names = [x.split()[0] for x in HITS.split(", ")]
    words = lambda column, k: tokens(next(T.blocks(column.slice(k, 1))))[0]
    d = np.zeros(0, np.uint64)
    kept: dict[int, np.ndarray] = {}
    size = 0
    for batch in batches:
        out = []
        keys, items, texts = (batch.column(c) for c in range(3))
        for k, (key, item) in enumerate(zip(keys.to_pylist(), items.to_pylist(), strict=True)):
            if item is None:
                d = words(texts, k)
                continue
            if item not in kept:
                i = words(texts, k)
                size += len(i)
                if size > ITEM_WORDS:
                    kept, size = {}, len(i)
                kept[item] = i
            if found := match(d, kept[item]):
                out.append((key, item, found[0], len(kept[item]), *found[1:]))
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def row_key():
    """A hash of id and text, by which the rows of a table are told apart."""
    return F.xxhash64("doc_id", "text")


def find_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, matched, item_words, first_word, last_word): one row for each document and item that overlap enough.

    Enough: half of the item's words, or ``LONG_STRETCH`` in one stretch; of an item under ``MIN_WORDS`` words all in a row,
    and one under ``ALONE`` words must be all of the document. Null or wordless texts on either side match nothing.
    Repeated rows match alike, and items of equal words too. Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    items = stored(items.mapInArrow(_sizes, "item_id long, item long, n_words long, text string").where("n_words > 0"), "items")
    classes = items.dropDuplicates(["item"]).select("item", "text")
    lengths = [r[0] for r in items.where(f"n_words < {MIN_WORDS}").select("n_words").distinct().collect()]
    keys = stored(classes.mapInArrow(_item_seeds(lengths), "seed long, item long").distinct(), "seeds")
    field = spark.sparkContext.broadcast(_field(keys.select("seed").distinct()))
    rows = id_text(docs).withColumn("key", row_key())
    hits = rows.select("key", "text").mapInArrow(_doc_seeds(field, lengths), "seed long, key long")
    pairs = stored(hits.join(keys, "seed").select("key", "item").distinct(), "pairs")
    texts = rows.select("key", F.col("text").alias("doc_text")).join(pairs.select("key").distinct(), "key").dropDuplicates(["key"])
    # each document is sent and cut into words once, whatever the number of its items
    rows = texts.select("key", F.lit(None).cast("long").alias("item"), F.col("doc_text").alias("text"))
    both = rows.unionAll(pairs.join(classes, "item").select("key", "item", "text")).repartition("key").sortWithinPartitions("key", "item")
    return both.mapInArrow(_verify, HITS).join(items.select("item", "item_id").distinct(), "item").drop("item")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, items, matched) for every row of ``docs``; items: their sorted ids.

    The items of a document are gathered in one row: as many as the benchmark has at most.
    """
    found = find_matches(docs, benchmark).groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("matched").alias("matched"))
    rows = id_text(docs).select("doc_id", row_key().alias("key"))
    joined = rows.join(found, "key", "left")
    return joined.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("matched", F.lit(0)).cast("long").alias("matched"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that no test item contaminates."""
    (key,) = free_names(docs, "key")
    found = find_matches(docs, benchmark).select(F.col("key").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return keyed.join(found, key, "left_anti").select(*docs.columns)
