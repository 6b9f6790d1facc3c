"""Substring deduplication by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id. Its index holds blocks of ``window`` consecutive words;
a block is kept under its own hash with its first occurrence (least document, first position). A document is factored
greedily from left to right: the longest run of blocks that continue one reference occurrence is a factor, the next
starts where it ends. Factors of ``window`` words or more are duplicate spans; blocks that cross the boundary of two
factors are looked up as well, so that a span counts whatever the parse chose before it.

Only blocks that can repeat are indexed. Each block is represented by the least hash of the ``SEED``-word grams in it:
equal blocks have equal representatives, and a representative that occurs in one text alone rules its blocks out. Equal
texts are settled before that: all but the first are duplicates as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farfield.llm import text as T
from farfield.llm.scratch import id_text, stored

SEED = 12


def _representatives(block: T.Block, window: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(document, representative of each block, hashes of the words) of the documents that have a block."""
    words = block.word_hashes()
    grams = T.gram_hashes(words, SEED)
    out = []
    for k in np.flatnonzero(block.n_words >= window).tolist():
        a, b = int(block.bounds[k]), int(block.bounds[k + 1])
        out.append((k, T.sliding_min(grams[a : b - SEED + 1], window - SEED + 1), words[a:b]))
    return out


def _seeds(window: int):
    """(seed, doc_id, h1, h2): the distinct representatives of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in T.blocks(batch.column(3)):
                found = [(k, np.unique(r)) for k, r, _ in _representatives(block, window)]
                rows = np.repeat([k for k, _ in found], [len(r) for _, r in found]).astype(np.int64) + block.first
                seeds = T.signed(np.concatenate([r for _, r in found])) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(seeds), *(batch.column(i).take(pa.array(rows)) for i in range(3))], names=["seed", "doc_id", "h1", "h2"])

    return run


def _windows(window: int):
    """(block, doc_id, h1, at, fresh): the blocks whose representative repeats; fresh: their first place in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column(3)
            for block in T.blocks(batch.column(2)):
                rows, hashes, places, fresh = [], [], [], []
                for k, representative, words in _representatives(block, window):
                    listed = np.asarray(seeds[block.first + k].values).view(np.uint64)
                    at = np.flatnonzero(np.isin(representative, listed))
                    hashed = T.gram_hashes(words, window)[at]
                    new = np.zeros(len(at), bool)
                    new[np.unique(hashed, return_index=True)[1]] = True
                    rows.append(np.full(len(at), block.first + k))
                    hashes.append(hashed), places.append(at), fresh.append(new)
                if not rows:
                    continue
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(T.signed(np.concatenate(hashes))), batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(fresh))],
                    names=["block", "doc_id", "h1", "at", "fresh"],
                )

    return run


def factors(at: np.ndarray, ref_doc: np.ndarray, ref_at: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """The greedy parse: (start, words, reference document, its start) of each factor of ``window`` words or more.

    ``at`` are the sorted positions of the blocks that the reference holds. A run of blocks that continues one
    occurrence is one factor. A block that crosses the end of a factor opens a factor of its own that overlaps it.
    """
    if not len(at):
        return []
    goes_on = (np.diff(at) == 1) & (np.diff(ref_at) == 1) & (ref_doc[1:] == ref_doc[:-1])
    first = np.concatenate([[0], np.flatnonzero(~goes_on) + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return [(int(at[i]), int(at[j] - at[i]) + window, int(ref_doc[i]), int(ref_at[i])) for i, j in zip(first, last, strict=True)]


FACTORS = "array<struct<start:int,words:int,ref_doc_id:long,ref_start:int>>"


def _parse(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            hits = batch.column(3)
            ids, copies = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for row, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode().split()
                n, parsed = len(words), []
                if n >= window and copies[row] is not None:
                    parsed = [(0, n, copies[row], 0)]
                elif hits[row].is_valid:
                    found = hits[row].values
                    at, doc, ref = (found.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                    _, order = np.unique(at, return_index=True)
                    parsed = factors(at[order].astype(np.int64), doc[order], ref[order].astype(np.int64), window)
                end, kept = 0, []
                for start, length, _, _ in parsed:
                    kept += words[end:start]
                    end = max(end, start + length)
                kept += words[end:]
                out[0].append(ids[row]), out[1].append(n), out[2].append(n - len(kept)), out[3].append(b" ".join(kept).decode())
                out[4].append([dict(zip(("start", "words", "ref_doc_id", "ref_start"), f, strict=True)) for f in parsed])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_doc_id", pa.int64()), ("ref_start", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], kind)], names=["doc_id", "n_words", "n_removed", "kept", "factors"])

    return run


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, factors) for every row.

    A word goes if a block of ``window`` words over it also starts in a document with a smaller doc_id; blocks are judged
    on the input. ``kept`` joins the words left by one space. Null or empty text: no words, kept is empty. Texts under
    ``window`` words stay whole. Rows with a null doc_id take no part and stay whole. Rows with the same doc_id never
    count against each other; repeated rows are returned as often as they come. Other columns are ignored.
    """
    if window < SEED:
        raise ValueError(f"window must be at least {SEED} words")
    rows = id_text(docs).withColumns({"h1": F.xxhash64("text"), "h2": F.hash("text")})
    known = rows.where("doc_id is not null and length(text) > 0")
    first = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    seeds = stored(known.select("doc_id", "h1", "h2", "text").mapInArrow(_seeds(window), "seed long, doc_id long, h1 long, h2 int"), "seeds")
    repeats = seeds.groupBy("seed").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("seed")
    own = seeds.join(repeats, "seed").join(first.select("h1", "h2", F.col("first_id").alias("doc_id")), ["h1", "h2", "doc_id"])
    per_doc = own.groupBy("doc_id", "h1").agg(F.collect_set("seed").alias("seeds"))
    open_docs = known.select("doc_id", "h1", "text").join(per_doc, ["doc_id", "h1"]).select("doc_id", "h1", "text", "seeds")
    places = stored(open_docs.mapInArrow(_windows(window), "block long, doc_id long, h1 long, at int, fresh boolean"), "blocks")
    new = F.when(F.col("fresh"), F.col("doc_id"))
    index = places.groupBy("block").agg(F.min("doc_id").alias("ref_doc"), F.max("doc_id").alias("last"), F.min_by("at", new).alias("ref_at")).where("ref_doc < last").drop("last")
    index = stored(index, "index")  # both sides of the next join are then dealt out anew, and a block of very many documents can be split
    hits = places.join(index, "block").where("ref_doc < doc_id").groupBy("doc_id", "h1").agg(F.collect_list(F.struct("at", "ref_doc", "ref_at")).alias("hits"))
    copies = known.select("doc_id", "h1", "h2").distinct().join(first.where("n > 1"), ["h1", "h2"]).where("first_id < doc_id").select("doc_id", "h1", F.col("first_id").alias("copy_of"))
    marks = hits.join(copies, ["doc_id", "h1"], "full")
    whole = rows.join(marks, ["doc_id", "h1"], "left").select("doc_id", "text", "copy_of", "hits")
    return whole.mapInArrow(_parse(window), f"doc_id long, n_words long, n_removed long, kept string, factors {FACTORS}")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def reference_parse(texts: dict[int, str | None], window: int = 50) -> dict[int, tuple[int, int, str]]:
    """Brute force over a small table, for tests: doc_id to (n_words, n_removed, kept_sha256)."""
    seen: set[tuple[bytes, ...]] = set()
    out = {}
    for doc_id in sorted(texts):
        words = (texts[doc_id] or "").encode().split()
        blocks = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
        gone = set()
        for i, block in enumerate(blocks):
            if block in seen:
                gone.update(range(i, i + window))
        seen.update(blocks)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out
