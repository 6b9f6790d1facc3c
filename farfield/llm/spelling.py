"""Spelling variants: words of the corpus at one edit from each other, and the form that each rare one stands for.

The vocabulary is counted in Spark. Words that differ by one edit agree on all but one piece of the shorter one, so they
meet in a group of words with the same start and the same end around a piece (halves at first; a group above ``hot`` is
dealt into the halves of its piece, again and again, down to one letter, where the alphabet bounds it). Within a group the
words are the bits of sets, one set for each position and letter, and for each query word four sets are carried over its
letters at once: no error so far, a letter replaced, a letter too many, a letter missing.

Defined results: null or empty texts have no words; a null id names no letter to delete; repeated rows count as often as
they come; of equally frequent near words the first in code-point order is the form; columns other than id and text are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farfield.llm.scratch import id_text, stored

RUN = r"[A-Za-zÀ-ÿ]+"
MODULUS = 199  # a run is misspelt if this divides its hash
LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5  # a form is at least this many times as frequent
HOT = 4096  # words of a group before its piece is halved
PAIRS = 1 << 18  # (query word, 64 bits of a set) at a time
CELLS = 1 << 22  # 64-bit cells of an index


def vocabulary(docs: DataFrame, modulus: int = MODULUS, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z lower-cased and misspelt by their hash, with their occurrences."""
    runs = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = id_text(docs).select("doc_id", F.explode(F.regexp_extract_all(runs, F.lit(RUN), 0)).alias("run"))
    h = F.coalesce(F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary")), F.lit(1))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % modulus == 0, cut).otherwise(F.col("run"))
    counted = each.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _keyed(words: DataFrame, pieces: int) -> DataFrame:
    """Rows (m, piece, word, n) with their key: what stands before and after the piece of a word of m letters or one more."""
    m, i, size = F.col("m"), F.col("piece"), F.length("word")
    start, rest = F.floor(i * m / pieces).cast("int"), (m - F.floor((i + 1) * m / pieces)).cast("int")
    key = F.concat_ws(" ", m.cast("string"), F.lit(pieces), i.cast("string"), F.substring("word", F.lit(1), start), F.substring("word", size - rest + 1, rest))
    return words.withColumn("key", key)


def grouped(words: DataFrame, least_letters: int = LEAST_LETTERS, hot: int = HOT) -> DataFrame:
    """(key, m, pieces, piece, word, n): each pair of near words shares a key, and no key has more than ``hot`` words.

    But for keys whose piece is one letter at most: their words differ in that letter, so the alphabet bounds them.
    """
    sizes = F.filter(F.array(F.length("word") - 1, F.length("word")), lambda m: m >= least_letters)
    rows = words.select("word", "n", F.explode(sizes).alias("m"))
    pieces = 2
    rows = stored(_keyed(rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("piece")), pieces), "spellings")
    done = None
    while True:
        large = stored(rows.where(F.col("m") > pieces).groupBy("key").count().where(F.col("count") > hot).select("key"), "large")
        columns = ("key", "m", F.lit(pieces).alias("pieces"), "piece", "word", "n")
        if large.isEmpty():
            last = rows.select(*columns)
            return last if done is None else done.union(last)
        kept = rows.join(large, "key", "left_anti").select(*columns)
        done = kept if done is None else done.union(kept)
        halves = rows.join(large, "key", "left_semi").select("word", "n", "m", F.explode(F.array(2 * F.col("piece"), 2 * F.col("piece") + 1)).alias("piece"))
        pieces *= 2
        rows = stored(_keyed(halves, pieces), "spellings")


class Index:
    """Words of some groups as bits: a set for each (position, letter) that occurs, over slots of 64 words.

    The words of a group take slots of their own, so a set is read only where the group of the query has its bits.
    """

    def __init__(self, words: list[str], group: np.ndarray):
        sizes = np.bincount(group)
        slots = -(-sizes // 64)
        first = np.concatenate([[0], np.cumsum(slots)])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        self.bit = first[group] * 64 + np.arange(len(words)) - begin[group]
        self.word_at = np.full(first[-1] * 64, -1)
        self.word_at[self.bit] = np.arange(len(words))
        self.slots, self.first, self.group, self.n_slots = slots, first, group, int(first[-1])
        self.size = np.array([len(w) for w in words])
        self.offset = np.concatenate([[0], np.cumsum(self.size)])
        self.letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        position = np.arange(len(self.letters)) - np.repeat(self.offset[:-1], self.size)
        self.codes, row = np.unique(position << 32 | self.letters, return_inverse=True)
        of = np.repeat(np.arange(len(words)), self.size)
        self.sets = self._bits(row, of, len(self.codes) + 1)  # the last set is empty
        self.sizes, row = np.unique(self.size, return_inverse=True)
        self.of_size = self._bits(row, np.arange(len(words)), len(self.sizes) + 1)

    def _bits(self, row: np.ndarray, word: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros((rows, self.n_slots), np.uint64)
        bit = self.bit[word]
        np.bitwise_or.at(out, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        return out

    def _set(self, position: np.ndarray | int, letter: np.ndarray) -> np.ndarray:
        code = np.where(position >= 0, position << 32 | letter, -1)
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[np.minimum(at, len(self.codes) - 1)] == code, at, len(self.codes))

    def _of_size(self, size: int, slot: np.ndarray) -> np.ndarray:
        at = int(np.searchsorted(self.sizes, size))
        return self.of_size[at if at < len(self.sizes) and self.sizes[at] == size else -1, slot]

    def near(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) at exactly one edit, for queries of one length; each against the words of its group."""
        size = int(self.size[queries[0]])
        ends = np.cumsum(self.slots[self.group[queries]])
        a = 0
        while a < len(queries):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
            yield self._near(queries[a:b], size)
            a = b

    def _near(self, queries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        slots = self.slots[self.group[queries]]
        query = np.repeat(queries, slots)
        slot = np.arange(len(query)) - np.repeat(np.cumsum(slots) - slots, slots) + np.repeat(self.first[self.group[queries]], slots)
        exact = np.full(len(query), ~np.uint64(0))
        replaced, extra, missing = (np.zeros(len(query), np.uint64) for _ in range(3))
        letters = self.letters[self.offset[queries][:, None] + np.arange(size)]
        for j in range(size):
            here, before, after = (self.sets[np.repeat(self._set(j + d, letters[:, j]), slots), slot] for d in (0, -1, 1))
            replaced = replaced & here | exact & ~here
            extra = extra & before | exact
            missing = (missing | exact) & after
            exact &= here
        found = replaced & self._of_size(size, slot) | extra & self._of_size(size - 1, slot) | (missing | exact) & self._of_size(size + 1, slot)
        hit = np.flatnonzero(found)
        bits = np.unpackbits(found[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        return query[hit[at]], self.word_at[slot[hit[at]] * 64 + bit]


def _same_end(words: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters that the two words share at their ends."""
    out = np.zeros(len(a), np.int64)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        v, w = words[x], words[y]
        n, most = 0, min(len(v), len(w))
        while n < most and v[-1 - n] == w[-1 - n]:
            n += 1
        out[k] = n
    return out


def _counted(words: list[str], n: np.ndarray, m: np.ndarray, pieces: np.ndarray, piece: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
    """(word, n_near, form, form_n) of the words of whole groups; within a group they come most frequent first."""
    index = Index(words, group)
    near, form = np.zeros(len(words), np.int64), np.full(len(words), -1)
    for size in np.unique(index.size):
        for query, word in index.near(np.flatnonzero(index.size == size)):
            shorter = m[query]
            ok = (index.size[query] == shorter) | (index.size[word] == shorter)  # pairs of two longer words are another group's
            query, word, shorter = query[ok], word[ok], shorter[ok]
            edit = shorter - np.minimum(_same_end(words, query, word), shorter)  # the earliest place of the edit
            p, k = pieces[query], piece[query]
            mine = ((k + 1) * shorter // p >= edit) & ((k == 0) | (k * shorter // p < edit))
            query, word = query[mine], word[mine]
            np.add.at(near, query, 1)
            best = np.full(len(words), len(words))
            np.minimum.at(best, query, word)
            form = np.where(best < len(words), np.where(form < 0, best, np.minimum(form, best)), form)
    got = np.flatnonzero(near)
    return pa.RecordBatch.from_arrays(
        [pa.array([words[k] for k in got], pa.string()), pa.array(near[got]), pa.array([words[form[k]] for k in got], pa.string()), pa.array(n[form[got]])], names=["word", "n_near", "form", "form_n"]
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, in each key most frequent first; as many whole groups at a time as an index should hold."""
    held: list[tuple[int, int, int, str, int]] = []
    group: list[int] = []
    key, letters = None, 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, group, letters
        if held:
            m, pieces, piece, words, n = zip(*held, strict=True)
            yield _counted(list(words), np.array(n), np.array(m), np.array(pieces), np.array(piece), np.array(group))
        held, group, letters = [], [], 0

    pending: list[tuple[int, int, int, str, int]] = []

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal letters
        if len(pending) > 1:  # a word alone has no near word
            held.extend(pending)
            group.extend([group[-1] + 1 if group else 0] * len(pending))
            letters += sum(len(x[3]) for x in pending)
            if len(held) >= 8192 or letters * (len(held) // 64 + group[-1] + 1) >= CELLS * 64:
                yield from flush()
        pending.clear()

    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                yield from close()
                key = k
            pending.append(tuple(row))
    yield from close()
    yield from flush()


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS, hot: int = HOT) -> DataFrame:
    """(word, n_near, best) of each word with a near one; best: struct (minus n, form) of the most frequent near word."""
    rows = grouped(words, least_letters, hot).select("key", "m", "pieces", "piece", "word", "n")
    dealt = rows.repartition("key").sortWithinPartitions("key", F.desc("n"), "word")
    found = dealt.mapInArrow(_neighbours, "word string, n_near long, form string, form_n long")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word with a form: the end of its chain of forms. Chains only go to more frequent words.

    Each round doubles what a pointer spans, so there are few.
    """
    going = forms.select("word", F.col("form").alias("root"))
    while True:
        step = stored(going.join(going.select(F.col("word").alias("root"), F.col("root").alias("over")), "root", "left").select("word", "root", "over"), "roots")
        if step.where("over is not null").isEmpty():
            return step.select("word", "root")
        going = step.select("word", F.coalesce("over", "root").alias("root"))


def variants(docs: DataFrame, modulus: int = MODULUS, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of at least ``least_letters`` letters and ``least_count`` occurrences."""
    words = stored(vocabulary(docs, modulus, least_letters, least_count), "words")
    near = near_words(words, least_letters, hot)
    told = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    enough = F.col("form_n") >= times * F.col("n")
    told = stored(told.select("word", "n", "n_near", F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")), "variants")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
