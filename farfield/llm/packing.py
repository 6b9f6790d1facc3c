"""Order-preserving sequence packing by dynamic programming.

The tokens of the documents of a partition form one stream, in order. Windows of at most ``length`` tokens tile it; a
window may end after a document (free), after a sentence (a small penalty) or inside a long sentence (a larger one). The
cut points that minimise padding plus penalties follow from f(j) = c(j) + length - p(j) + min(f(i) + p(i)) over the cut
points i at most ``length`` tokens before j; the minimum slides with j, so a monotone queue makes the whole linear.
"""

from __future__ import annotations

import itertools
import json
import os
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farfield.llm import text as T
from farfield.llm.scratch import id_text

END_ID = 2
SENTENCE_PENALTY, INSIDE_PENALTY, INSIDE_EVERY = 4, 16, 64
GROUP_TOKENS = 1 << 20
CACHE_WORDS = 300_000

SLOTS = 1 << 20
JOINED = 64

#: what this module knows of a tokenizer: white space parts a text, and words of letters, digits and other ASCII are split on.
#: A file with another normaliser, splitter or word end is refused.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

#: by byte: 0 white space, 1 letters (bytes over 127 are letters in a plain word), 2 digits, 3 other ASCII
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
#: bytes of a word that isn't plain: control characters, the apostrophe (contractions), letters outside of U+00C0 to U+017F
_ODD = np.ones(256, bool)
_ODD[[*range(32, 39), *range(40, 127), 9, 10, 11, 12, 13, *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = False


def split_points(block: T.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, plain) of the pieces that the tokenizer treats one by one.

    A plain word is cut into runs of letters, single digits and runs of other characters; any other word is one piece, which
    the tokenizer may cut on. Plain: ASCII and the letters from U+00C0 to U+017F without the one whose lower case is two characters;
    no apostrophe and no start of a special token.
    """
    data = block.data
    if not len(data):
        return block.starts, block.ends, np.zeros(0, bool)
    before, after = np.concatenate([[0], data[:-1]]), np.concatenate([data[1:], [0]])
    odd = _ODD[data] | ((before == 0xC3) & ((data == 0x97) | (data == 0xB7))) | ((before == 0xC4) & (data == 0xB0)) | ((data == 60) & (after == 124))
    so_far = np.concatenate([[0], np.cumsum(odd)])
    plain = so_far[block.ends] == so_far[block.starts]
    kind = _KIND[data]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[block.starts[plain]], inside[block.ends[plain]] = 1, -1
    both = np.intersect1d(block.starts[plain], block.ends[plain], assume_unique=True)
    inside[both] = 0  # one word ends where the next document begins with another
    within = np.cumsum(inside[:-1]) > 0
    cut = within & ((kind == 2) | (kind != np.concatenate([[0], kind[:-1]])))
    cut[block.starts] = True
    starts = np.flatnonzero(cut)
    word = np.searchsorted(block.starts, starts, side="right") - 1
    ends = np.minimum(np.concatenate([starts[1:], [len(data)]]), block.ends[word])
    return starts, ends, plain[word]


class Encoder:
    """Ids of whole texts, by a tokenizer that treats the pieces of a text one by one.

    Pieces are told apart by 64-bit hashes; each is encoded once and kept in a table of open addressing, which starts anew
    when it holds ``CACHE_WORDS``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _check(path)
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys, self.values, self.count, self.used = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), 0, 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first, self.size, self.end = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The places of the pieces, -1 for those that are new."""
        out = np.full(len(hashes), -1, np.int64)
        at = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        live = np.arange(len(hashes))
        while len(live):
            have = self.keys[at[live]]
            hit = have == hashes[live]
            out[live[hit]] = self.values[at[live[hit]]]
            live = live[~hit & (have != 0)]
            at[live] = (at[live] + 1) & (SLOTS - 1)
        return out

    def _keep(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> None:
        """Adds new distinct pieces."""
        n, m = len(hashes), len(ids)
        while self.used + m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + n > len(self.first):
            self.first, self.size, self.end = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.end))
        self.flat[self.used : self.used + m] = ids
        place = slice(self.count, self.count + n)
        self.first[place] = self.used + np.cumsum(sizes) - sizes
        self.size[place], self.end[place] = sizes, ends
        at = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        live = np.arange(n)
        while len(live):
            free = live[self.keys[at[live]] == 0]
            self.keys[at[free]] = hashes[free]
            won = free[self.keys[at[free]] == hashes[free]]  # of several that want one slot the last got it
            self.values[at[won]] = self.count + won
            lost = np.ones(n, bool)
            lost[won] = False
            live = live[lost[live]]
            at[live] = (at[live] + 1) & (SLOTS - 1)
        self.count, self.used = self.count + n, self.used + m

    def _learn(self, block: T.Block, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> None:
        for kind in (True, False):
            new = np.flatnonzero(plain == kind)
            if not len(new):
                continue
            raw, bounds = block.spans(starts[new], ends[new])
            if kind:  # many in one string: each piece's last id closes a word
                cuts = [*bounds[:-1:JOINED].tolist(), int(bounds[-1])]
                texts = [raw[a:b].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            else:
                texts = [raw[a : b - 1].tobytes().decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32)
            if kind:
                stops = np.flatnonzero(self.closes[ids]) + 1
                if len(stops) != len(new):
                    raise ValueError("a piece doesn't end with a closing id")
                sizes = np.diff(np.concatenate([[0], stops]))
            else:
                sizes = np.fromiter(map(len, found), np.int64, len(found))
            last = raw[bounds[1:] - 2]
            dots = np.concatenate([[0], np.cumsum(raw == 46)])
            closes = np.isin(last, (46, 33, 63)) | (dots[bounds[1:]] > dots[bounds[:-1]])
            self._keep(hashes[new], ids, sizes, closes)

    def encode(self, block: T.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, bounds, sentences): the ids of the block's documents, those of document k at ``bounds[k]:bounds[k+1]``, and
        the places after a sentence."""
        starts, ends, plain = split_points(block)
        hashes = block.span_hashes(starts, ends, T._LOWER)  # the tokenizer lower-cases
        hashes[hashes == 0] = 1
        if self.count > CACHE_WORDS:
            self._clear()
        at = self._find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            distinct, index = np.unique(hashes[new], return_index=True)
            if self.count + len(distinct) > SLOTS // 2:
                self._clear()
                distinct, index = np.unique(hashes, return_index=True)
                new = np.arange(len(hashes))
            index = new[index]
            for k in range(0, len(index), SLOTS // 2):
                self._learn(block, distinct[k : k + SLOTS // 2], starts[index[k : k + SLOTS // 2]], ends[index[k : k + SLOTS // 2]], plain[index[k : k + SLOTS // 2]])
            at[new] = self._find(hashes[new])
        size = self.size[at]
        after = np.cumsum(size)
        n = int(after[-1]) if len(after) else 0
        ids = self.flat[np.arange(n) + np.repeat(self.first[at] - (after - size), size)]
        bounds = np.concatenate([[0], after])[np.searchsorted(starts, block.offsets)]
        return ids, bounds, after[self.end[at]]


def _check(path: str) -> None:
    with open(path) as f:
        made = json.load(f)
    steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
    splits = [x.get("pattern", {}).get("Regex") for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
    if steps != NORMALIZERS or splits != [SPLIT] or made["model"].get("end_of_word_suffix") != WORD_END or any("<|" not in t["content"] for t in made["added_tokens"]):
        raise ValueError(f"{path}: a tokenizer of another kind; only lower-case word BPE with {WORD_END} is supported")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def best_cuts(points: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Indexes into ``points`` (ascending, from 0 to the end, no gap above ``length``) at which windows end, at least cost."""
    p, c = points.tolist(), penalties.tolist()
    value, back = [0] * len(p), [0] * len(p)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + p(i), i), ascending in both
    for j in range(1, len(p)):
        at = p[j]
        while p[queue[0][1]] < at - length:
            queue.popleft()
        best, back[j] = queue[0]
        value[j] = best + length - at + c[j]
        mine = value[j] + at
        while queue and queue[-1][0] >= mine:
            queue.pop()
        queue.append((mine, j))
    cuts, j = [], len(p) - 1
    while j > 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def cut_points(sentences: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a document of n tokens may be cut (its end included), and the penalty of each place."""
    marks = np.unique(np.concatenate([sentences[(sentences > 0) & (sentences < n)], [n]]))
    gaps = np.diff(np.concatenate([[0], marks]))
    inside = [np.arange(m - g + INSIDE_EVERY, m, INSIDE_EVERY) for m, g in zip(marks[gaps > INSIDE_EVERY], gaps[gaps > INSIDE_EVERY], strict=True)]
    points = np.concatenate([marks, *inside])
    penalties = np.full(len(points), SENTENCE_PENALTY)
    penalties[len(marks) :] = INSIDE_PENALTY
    penalties[len(marks) - 1] = 0
    order = np.argsort(points, kind="stable")
    return points[order], penalties[order]


class Packer:
    """Packs a stream of documents; ``pieces`` gathers (doc row, start, length, ids, doc_tokens, sequence, offset)."""

    def __init__(self, length: int):
        self.length, self.sequence = length, 0
        self.open: list[tuple] = []  # (row, start, ids, doc_tokens, points, penalties): points relative to the part
        self.tokens = 0
        self.pieces: list[tuple] = []

    def add(self, row, ids: np.ndarray, sentences: np.ndarray) -> None:
        points, penalties = cut_points(sentences, len(ids))
        self.open.append((row, 0, ids, len(ids), points, penalties))
        self.tokens += len(ids)
        if self.tokens >= GROUP_TOKENS:
            self._pack(last=False)

    def close(self) -> None:
        if self.open:
            self._pack(last=True)

    def _pack(self, last: bool) -> None:
        base = np.cumsum([0, *(len(x[2]) for x in self.open)])
        points = np.concatenate([[0], *(x[4] + b for x, b in zip(self.open, base, strict=False))])
        penalties = np.concatenate([[0], *(x[5] for x in self.open)])
        ends = points[best_cuts(points, penalties, self.length)].tolist()
        if last:  # what no full window takes: sequences of a power of two, which need no padding
            at = ends[-2] if len(ends) > 1 else 0
            rest = ends.pop() - at
            for bit in range(rest.bit_length() - 1, -1, -1):
                if rest >> bit & 1:
                    at += 1 << bit
                    ends.append(at)
        else:
            ends.pop()
        self._emit(ends, base)
        done = ends[-1] if ends else 0
        left = []
        for (row, start, ids, total, points, penalties), b in zip(self.open, base.tolist(), strict=False):
            skip = max(0, done - b)
            if skip < len(ids):
                more = points > skip
                left.append((row, start + skip, ids[skip:], total, points[more] - skip, penalties[more]))
        self.open, self.tokens = left, sum(len(x[2]) for x in left)

    def _emit(self, ends: list[int], base: np.ndarray) -> None:
        begin, k = 0, 0
        for end in ends:
            while begin < end:
                row, start, ids, total, _, _ = self.open[k]
                b = int(base[k])
                stop = min(end, b + len(ids))
                if stop > begin:
                    where = ends_before if (ends_before := self._window_start) is not None else begin
                    self.pieces.append((row, start + begin - b, stop - begin, ids[begin - b : stop - b], total, self.sequence, begin - where))
                    self._window_start = where
                    begin = stop
                if stop == b + len(ids):
                    k += 1
            self._window_start = None
            self.sequence += 1

    _window_start: int | None = None


def _run(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path), Packer(length)
        first = TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            got, packer.pieces = packer.pieces, []
            cols = list(zip(*got, strict=True)) if got else [()] * 7
            ids = pa.array([x.astype("<u4").tobytes() for x in cols[3]], pa.binary())
            longs = [pa.array(cols[i], pa.int64()) for i in (0, 1, 2, 4)]
            sequence, offset = pa.array([first + s for s in cols[5]], pa.int64()), pa.array(cols[6], pa.int64())
            return pa.RecordBatch.from_arrays([*longs[:3], ids, longs[3], sequence, offset], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            for block in T.blocks(texts):
                ids, bounds, sentences = enc.encode(block)
                marks = np.searchsorted(sentences, bounds, side="right")
                of_docs = docs.slice(block.first, block.rows).to_pylist()
                for doc, a, b, x, y in zip(of_docs, bounds[:-1].tolist(), bounds[1:].tolist(), marks[:-1].tolist(), marks[1:].tolist(), strict=True):
                    packer.add(doc, np.append(ids[a:b], np.uint32(END_ID)), sentences[x:y] - a)
                if packer.pieces:
                    yield out()
        packer.close()
        yield out()

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = 4096) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row for each piece; ids are little-endian uint32.

    Documents keep the order of their partition; each is its ids and then ``END_ID``. Null or empty text: that id alone.
    A document longer than a sequence is cut at sentences, or every ``INSIDE_EVERY`` tokens where a sentence is longer.
    Only a partition's last window can fall short; it becomes sequences of powers of two. sequence_id is unique over
    partitions and the same on every attempt as long as the input's partitions are (a scan of files is). Null doc_ids,
    repeated rows and other columns need no care; no rows give no rows.
    """
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return id_text(docs).mapInArrow(_run(tokenizer or default_tokenizer(), length), schema)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
