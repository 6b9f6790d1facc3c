"""Language-model scoring with a weighted backoff automaton.

A text is its words (A-Z lower-cased) with a space after each and an end mark. Byte n-grams up to ``ORDER``, counted over
all training texts, are smoothed by absolute discounting. A context of up to ``ORDER - 1`` bytes that comes ``LEAST`` times is
a state, so the states grow with the corpus; a byte seen after it is an arc with its smoothed probability; every other byte takes
the failure arc to the longest proper suffix, whose weight makes the state's probabilities sum to one.

Arcs are sparse, keyed by (state, byte), and found by hashing. A text is walked from left to right: the state is carried, failure arcs
are followed until an arc reads the byte, and the weights are added up. Long texts are walked in stretches side by side;
``ORDER - 1`` bytes before a stretch settle its state. Held-out texts add nothing to the automaton.

An automaton of at most ``MOST`` arcs is broadcast. Of a larger one the most frequent arcs are; a walk is sure where it reads an arc of
a state of full length. The other steps leave the walk as n-grams of ``ORDER`` bytes, and their failure arcs are followed by joins,
order by order, over the states of the whole automaton (``by_failure``).

Word counts for the base score are exact: the words of a share of ``HEAD_SHARE`` or more are broadcast (at most
1 / HEAD_SHARE), all others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farfield.llm import text as T
from farfield.llm.scratch import crc_mod, id_text, stored

ORDER = 6
LEAST = 2
MOST = 1 << 22
HEAD_SHARE = 1e-6
DISCOUNT = 0.75
END = 10  # closes a text; a word holds no such byte
STRETCH = 256
WALK_BYTES = 1 << 21  # of texts walked side by side
MERGE_GRAMS = 1 << 21
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def streams(block: T.Block) -> tuple[np.ndarray, np.ndarray]:
    """The byte streams of the documents of a block in one array, each: words with a space after each, then END; and bounds."""
    lengths = block.ends - block.starts + 1
    per_doc = np.concatenate([[0], np.cumsum(lengths)])[block.bounds]
    sizes = np.diff(per_doc) + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(bounds[-1], 32, np.uint8)
    out[bounds[1:] - 1] = END
    if len(lengths):
        n = lengths - 1
        begin = np.cumsum(lengths) - lengths + block.document_of_word()
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(begin, n) + step] = _FOLD[block.data[np.repeat(block.starts, n) + step]]
    return out, bounds


def packed(stream: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each byte, it and the ORDER - 1 before it as one number; END stands before the start of a text."""
    value = stream.astype(np.int64)
    place = np.arange(len(stream)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = value.copy()
    for back in range(1, ORDER):
        prior = np.full(len(stream), END, np.int64)
        prior[back:] = value[:-back]
        prior[place < back] = END
        out |= prior << (8 * back)
    return out


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    u, place = np.unique(k, return_inverse=True)
    return u, np.bincount(place, weights=c, minlength=len(u)).astype(np.int64)


def _count(kind: str):
    """(key, n): byte n-grams or words with their counts, added up within a task as far as a bounded table allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def out() -> pa.RecordBatch:
            k, c = _merge(keys, counts) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["key", "n"])

        for batch in batches:
            for block in T.blocks(batch.column(0)):
                if kind == "grams":
                    found = packed(*streams(block))
                else:
                    found = np.concatenate([T.signed(block.word_hashes(lower=True)), np.full(block.rows, END_WORD)])
                k, c = np.unique(found, return_counts=True)
                keys.append(k), counts.append(c)
                size += len(k)
                if size > 2 * MERGE_GRAMS:
                    k, c = _merge(keys, counts)
                    keys, counts, size = [k], [c], len(k)
                    if size > MERGE_GRAMS:
                        yield out()
                        keys, counts, size = [], [], 0
        yield out()

    return run


END_WORD = np.int64(-(2**62) + 11)  # stands for the end among word hashes


class Places:
    """Where each of a set of distinct non-negative numbers stands in its array: a hash table with open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys if len(keys) else np.full(1, -1, np.int64)
        bits = max(4, (2 * len(self.keys) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        at, left = self._first(self.keys), np.arange(len(self.keys))
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            rest = self.slots[at] != left
            at, left = (at[rest] + 1) & self.mask, left[rest]

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return T.signed((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each, or -1."""
        at = self._first(wanted)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != wanted))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = self.slots[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[out[open_]] != wanted[open_])]
        return out


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(ORDER + 1)], np.int64)
_LENGTH = 8 * (ORDER - 1)  # a state is its context, with the length above it; an arc is its state, then the byte


class Automaton:
    """States and arcs with log10 weights. ``key``: of the arcs (state, byte); ``fail``: the weight of the failure arc of the arc's state.

    ``bottom`` is the weight of a byte that even the empty context has no arc for. With each arc goes the length of the state that it
    leads to, the longest suffix that is one; failure arcs lead to the suffix one byte shorter, which always is one.
    """

    def __init__(self, key: np.ndarray, weight: np.ndarray, fail: np.ndarray, bottom: float):
        self.arcs, self.weight, self.bottom = Places(key), weight.astype(np.float32), np.float32(bottom)
        states, at = np.unique(key >> 8, return_index=True)
        self.states, self.fail = Places(states), fail[at].astype(np.float32)
        self.target = self._longest(key & _MASKS[ORDER], np.minimum((key >> 8 + _LENGTH) + 1, ORDER - 1))
        full = np.full(1, int.from_bytes(bytes([END] * ORDER), "big"), np.int64)
        length = int(self._longest(full, np.full(1, ORDER - 1))[0])
        self.start = length << _LENGTH | int(full[0] & _MASKS[length])

    def _longest(self, value: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The length of the longest suffix, of at most ``most`` bytes, that is a state."""
        out = np.zeros(len(value), np.int8)
        for k in range(1, ORDER):
            held = self.states.find(k << _LENGTH | value & _MASKS[k]) >= 0
            out[held & (most >= k)] = k
        return out

    def read(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the states after a byte, its log10 probabilities, whether an arc of a state of full length read it)."""
        cell = state << 8 | byte
        at = self.arcs.find(cell)
        hit = at >= 0
        weight = np.where(hit, self.weight[at], np.float32(0))
        length = np.where(hit, self.target[at], 0).astype(np.int64)
        sure = hit & (state >> _LENGTH == ORDER - 1)
        open_ = np.flatnonzero(~hit)
        now = state[open_]
        while len(open_):  # failure arcs
            at = self.states.find(now)
            depth = now >> _LENGTH
            weight[open_] += np.where(depth == 0, self.bottom, np.where(at >= 0, self.fail[at], np.float32(0)))
            open_, now, depth = open_[depth > 0], now[depth > 0], depth[depth > 0] - 1
            now = depth << _LENGTH | now & _MASKS[depth]
            at = self.arcs.find(now << 8 | byte[open_])
            hit = at >= 0
            weight[open_[hit]] += self.weight[at[hit]]
            length[open_[hit]] = self.target[at[hit]]
            open_, now = open_[~hit], now[~hit]
        return length << _LENGTH | cell & _MASKS[length], weight, sure

    def walk(self, stream: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of a block's documents: its log10 probability after all that is before it in its document, and ``sure``."""
        sizes = np.diff(bounds)
        parts = -(-sizes // STRETCH)
        doc = np.repeat(np.arange(len(sizes)), parts)
        begin = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * STRETCH
        lead = np.minimum(begin, ORDER - 1)  # bytes walked before the stretch, only to reach its state
        length = np.minimum(sizes[doc] - begin, STRETCH) + lead
        order = np.argsort(-length, kind="stable")
        at, lead, length = (bounds[doc] + begin - lead)[order], lead[order], length[order]
        state = np.where(lead > 0, 0, self.start)
        out, sure = np.zeros(len(stream), np.float32), np.zeros(len(stream), bool)
        live = len(at)
        for k in range(int(length[0]) if len(length) else 0):
            while live and length[live - 1] <= k:
                live -= 1
            here = at[:live] + k
            state[:live], weight, whole = self.read(state[:live], stream[here].astype(np.int64))
            counts = lead[:live] <= k
            out[here[counts]], sure[here[counts]] = weight[counts], whole[counts]
        return out, sure


def levels(grams: DataFrame) -> list[DataFrame]:
    """For each order, (gram, n, p, fail, state): the n-grams of ``grams`` (key, n), the probability of the last byte after the others,
    the weight of their failure arc, and whether they are a state. A context that is none passes on what its suffix gives."""
    out: list[DataFrame] = []
    for k in range(ORDER):
        counts = grams.groupBy(F.expr(f"key & {_MASKS[k + 1]}L").alias("gram")).agg(F.sum("n").alias("n"))
        context = Window.partitionBy(F.shiftright("gram", 8))
        level = counts.withColumns({"total": F.sum("n").over(context), "kinds": F.count("*").over(context)})
        if k:
            level = level.withColumn("suffix", F.expr(f"gram & {_MASKS[k]}L")).join(out[-1].select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        else:
            level = level.withColumn("lower", F.lit(1 / 256))
        own = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("lower")
        state = F.col("total") >= (LEAST if k else 1)
        level = level.select("gram", "n", F.when(state, own / F.col("total")).otherwise(F.col("lower")).alias("p"), (DISCOUNT * F.col("kinds") / F.col("total")).alias("fail"), state.alias("state"))
        out.append(stored(level.where("state") if k == ORDER - 1 else level, f"order{k + 1}"))
    return out


def arcs(orders: list[DataFrame]) -> DataFrame:
    """(key, n, weight, fail) of all arcs of the automaton: the key is the length of the state, its context and the byte."""
    parts = [level.where("state").select((F.col("gram") + F.lit(k << _LENGTH + 8)).alias("key"), "n", F.log10("p").cast("float").alias("weight"), F.log10("fail").cast("float").alias("fail")) for k, level in enumerate(orders)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole


def frequent(whole: DataFrame) -> tuple[DataFrame, bool]:
    """The arcs to broadcast, at most ``MOST``, and whether these are all. Of more, those whose count reaches the least power of
    two that leaves no more than MOST; with an arc, those of the suffixes and of the contexts it passes are in as well."""
    sizes = sorted(whole.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("size")).collect(), reverse=True)
    held = 0
    for row in sizes:  # a row for each power of two
        held += row["size"]
        if held > MOST:
            return whole.where(F.col("n") >= F.lit(2 ** (row["power"] + 1))), False
    return whole, True


def by_failure(steps: DataFrame, orders: list[DataFrame], bottom: float) -> DataFrame:
    """(gram, weight) for the distinct n-grams of ``ORDER`` bytes in ``steps`` (gram): failure arcs followed by joins, longest context first."""

    def follow(now: DataFrame, k: int) -> DataFrame:
        # the arcs of a state are at most 256
        arc = F.struct(F.expr("gram & 255L"), F.log10("p"))
        states = orders[k].where("state").groupBy(F.shiftright("gram", 8).alias("context")).agg(F.log10(F.first("fail")).alias("fail"), F.map_from_entries(F.collect_list(arc)).alias("arcs"))
        now = now.withColumn("context", F.expr(f"shiftright(gram, 8) & {_MASKS[k]}L")).join(states, "context", "left")
        read = F.coalesce("weight", F.col("passed") + F.try_element_at("arcs", F.expr("gram & 255L")))
        return now.select("gram", read.alias("weight"), (F.col("passed") + F.coalesce("fail", F.lit(0.0))).alias("passed"))

    first = stored(follow(steps.select("gram").distinct().select("gram", F.lit(None).cast("double").alias("weight"), F.lit(0.0).alias("passed")), ORDER - 1), "failing")
    rest = first.where("weight is null")
    for k in range(ORDER - 2, 0, -1):
        rest = follow(rest, k)
    root = orders[0].select(F.col("gram").alias("byte"), F.log10("p").alias("own"))  # at most 256 rows
    rest = rest.join(F.broadcast(root), F.expr("gram & 255L") == F.col("byte"), "left")
    return first.where("weight is not null").select("gram", "weight").unionAll(rest.select("gram", F.coalesce("weight", F.col("passed") + F.coalesce("own", F.lit(bottom)))))


def _place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` stand in the sorted ``keys``, and whether they do."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _score(steps, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, whole = steps.value
        keys, logs, end, least = head.value
        for batch in batches:
            for block in T.blocks(batch.column(1), WALK_BYTES):
                stream, bounds = streams(block)
                weight, sure = automaton.walk(stream, bounds)
                score = np.add.reduceat(np.where(sure | whole, weight, np.float32(0)).astype(float), bounds[:-1])
                at, known = _place(keys, T.signed(block.word_hashes(lower=True)))
                owner = block.document_of_word()
                base = np.bincount(owner[known], weights=logs[at[known]], minlength=block.rows)
                n_known = np.bincount(owner[known], minlength=block.rows)
                columns = [block.n_words + 1, n_known.astype(np.int64), base + end, score]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), *map(pa.array, columns)], names=["key", "n_tokens", "head_known", "head_base", "head_score"])

    return run


def _rare_words(head):
    """(word, key) of the words that the head doesn't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = head.value[0]
        for batch in batches:
            for block in T.blocks(batch.column(1)):
                words = T.signed(block.word_hashes(lower=True))
                rest = np.flatnonzero(~_place(keys, words)[1])
                rows = block.document_of_word()[rest] + block.first
                yield pa.RecordBatch.from_arrays([pa.array(words[rest]), batch.column(0).take(pa.array(rows))], names=["word", "key"])

    return run


def _rare_steps(steps):
    """(gram, key, times) of the steps where the walk is not sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = steps.value[0]
        for batch in batches:
            for block in T.blocks(batch.column(1)):
                stream, bounds = streams(block)
                found, place = np.unique(packed(stream, bounds), return_inverse=True)
                # a walk is sure just where the automaton holds the arc of full length
                rare = np.flatnonzero((automaton.arcs.find((ORDER - 1 << _LENGTH + 8) + found) < 0)[place])
                owner = np.searchsorted(bounds, rare, side="right") - 1
                pairs, times = np.unique(place[rare] * block.rows + owner, return_counts=True)
                rows = pa.array(pairs % block.rows + block.first)
                yield pa.RecordBatch.from_arrays([pa.array(found[pairs // block.rows]), batch.column(0).take(rows), pa.array(times)], names=["gram", "key", "times"])

    return run


def score(docs: DataFrame, held_mod: int = 7, held_rest: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from the rows whose crc32(doc_id) mod ``held_mod`` is not ``held_rest``; a null doc_id is never held out. Null
    text reads as empty: one token, the end. Repeated rows are answered alike and counted as often as they come. With no
    training row every token is unknown, and the automaton gives every byte the same probability. ``score`` is that of the
    automaton alone.
    """
    spark = docs.sparkSession
    held = F.coalesce(crc_mod("doc_id", held_mod) == held_rest, F.lit(False))
    rows = id_text(docs).withColumn("held_out", held).withColumn("key", F.xxhash64("doc_id", "text"))
    train = rows.where("not held_out").select("text")
    words = stored(train.mapInArrow(_count("words"), "key long, n long").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n")), "words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = words.where(F.col("n") >= HEAD_SHARE * n).toArrow()
    keys, counts = top.column("word").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(keys)
    scale = np.log10(n + v + 1.0)
    keys, logs = keys[order], np.log10(counts[order] + 1.0) - scale
    ends = counts[keys_at] if len(keys_at := np.flatnonzero(top.column("word").to_numpy() == END_WORD)) else np.zeros(1, np.int64)
    if not len(ends) or not ends[0]:  # the end is rarer than the head, or there is no training row
        got = words.where(F.col("word") == int(END_WORD)).select("n").first()
        ends = np.array([got[0] if got else 0])
    end_count = int(ends[0])
    if not len(keys):
        keys, logs = np.array([np.iinfo(np.int64).max]), np.zeros(1)
    end = float(np.log10(end_count + 1.0) - scale)
    head = spark.sparkContext.broadcast((keys, logs, end, -float(scale)))
    grams = stored(train.mapInArrow(_count("grams"), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "grams")
    orders = levels(grams)
    held, whole = frequent(arcs(orders))
    rows_ = held.select("key", "weight", "fail").toArrow()
    kinds = orders[0].count()
    read = orders[0].agg(F.sum("n")).first()[0]
    bottom = float(np.log10((DISCOUNT * kinds / read if read else 1.0) / 256))
    automaton = Automaton(*(rows_.column(c).to_numpy() for c in ("key", "weight", "fail")), bottom)
    steps = spark.sparkContext.broadcast((automaton, whole))
    texts = rows.select("key", "text")
    main = texts.mapInArrow(_score(steps, head), "key long, n_tokens long, head_known long, head_base double, head_score double")
    own = F.log10(F.col("n") + 1.0) - float(scale)
    # a row that repeats k times sends its words and n-grams k times
    rare = texts.mapInArrow(_rare_words(head), "word long, key long").join(words.where(F.col("n") < HEAD_SHARE * n), "word")
    per_key = rare.groupBy("key").agg(F.count("*").alias("known"), F.sum(own).alias("logs"))
    if whole:
        per_key = per_key.withColumn("steps", F.lit(0.0))
    else:
        rest = stored(texts.mapInArrow(_rare_steps(steps), "gram long, key long, times long"), "steps")
        weights = by_failure(rest, orders, bottom)
        per_key = per_key.join(rest.join(weights, "gram").groupBy("key").agg(F.sum(F.col("times") * F.col("weight")).alias("steps")), "key", "full")
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"), F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"))
    joined = main.join(copies.join(per_key, "key", "left"), "key")
    each = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0))
    known = F.coalesce(F.expr("known div copies"), F.lit(0)) + F.col("head_known")
    unknown = F.col("n_tokens") - 1 - known
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (known + (1 if end_count else 0)).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("head_base") + each("logs") + unknown * F.lit(-float(scale))).alias("base_score"),
        (F.col("head_score") + each("steps")).alias("score"),
    )
