"""Substring dedup by level-wise doubling.

A window is ``length`` consecutive words of one document.  Level by level, windows that occur once at one length are out; those that are
left are extended to twice that length, until the wanted length is reached or no window survives.  The first level looks
at the least-hashed window of ``first`` words within each window of twice as many: a window that occurs twice has its
least part twice, so nothing is lost, and a sixth of the windows is counted.  What survives a level is known to the next
by a sieve of fixed size; the last level is exact."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.shared import SIEVE_BITS, Sieve, arrow_map, lists, sieve_of
from loamgrid.llm.words import Words, follow, joined, signed, words_of

LENGTH, FIRST = 20, 10
TOP = np.uint64(2**64 - 1)
NO_ID = -(2**63)


def _starts(words: Words, length: int) -> np.ndarray:
    """Whether a window of ``length`` words starts at each word, within its row."""
    ends = np.repeat(words.bounds[1:], np.diff(words.bounds))
    return np.arange(len(words.hashes)) + length <= ends


def _slide(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over x[i : i + width] for every i that has them, in about log2(width) passes."""
    span, out = 1, x
    while span * 2 <= width:
        out, span = op(out[:-span], out[span:]) if len(out) > span else out[:0], span * 2
    return op(out[:len(out) - (width - span)], out[width - span:]) if width > span and len(out) > width - span else out[:max(0, len(x) - width + 1)]


def _least(words: Words, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the ``first``-word windows; for each place that starts a window of twice as many words, the least hash in it; those places."""
    n = len(words.hashes)
    short = np.full(n, TOP)
    made = joined(words.hashes, first)
    short[:len(made)] = made
    whole = _starts(words, 2 * first)
    least = np.full(n, TOP)
    slid = _slide(short, first + 1, np.minimum)
    least[:len(slid)] = slid
    return short, least, whole


def _chosen(words: Words, first: int) -> np.ndarray:
    """Hashes of the least windows, once for each place that holds one."""
    short, least, whole = _least(words, first)
    held = np.where(whole, least, np.uint64(0))
    reach = _slide(np.concatenate((np.zeros(first, np.uint64), held)), first + 1, np.maximum)      # over the windows that contain the place
    return short[(reach == short) & (reach > 0)] if len(reach) == len(short) else short[:0]


def _survivors(words: Words, first: int, length: int, sieves: list[Sieve]) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the ``length``-word windows that the levels so far leave: one sieve per level, of ``first``, 2 * first, ... words."""
    _, least, whole = _least(words, first)
    left = np.flatnonzero(whole)
    left = left[sieves[0].holds(least[left])]
    hashes, size = joined(words.hashes, 2 * first), 2 * first
    for sieve in sieves[1:]:
        keep = np.zeros(len(words.hashes) + size, bool)
        keep[left[sieve.holds(hashes[left])]] = True
        left = np.flatnonzero(keep[:len(words.hashes)] & keep[size:size + len(words.hashes)] & _starts(words, 2 * size))
        hashes, size = follow(hashes, hashes, size), 2 * size
    assert size == length
    return left, hashes[left]


def _level(docs: DataFrame, first: int, length: int, sieves: list[Sieve]) -> DataFrame:
    """``key, seen``: the surviving windows of ``length`` words; a document's each once with the number of places."""
    held = docs.sparkSession.sparkContext.broadcast(sieves) if sieves else None

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for words in words_of(batch.column("text")):
            hashes = _survivors(words, first, length, held.value)[1] if held else _chosen(words, first)
            keys, seen = np.unique(hashes, return_counts=True)
            yield pa.record_batch([pa.array(signed(keys)), pa.array(seen)], names=["key", "seen"])
    return arrow_map(docs.select("text"), scan, "key long, seen long")


def _sieves(docs: DataFrame, first: int, length: int, bits: int) -> list[Sieve]:
    sieves, size = [], first
    while size < length:
        level = _level(docs, first, size, sieves).groupBy("key").agg(F.sum("seen").alias("seen")).where("seen > 1")
        sieves.append(sieve_of(level, "key", bits))
        size *= 2
    return sieves


def repeat_levels(docs: DataFrame, first: int = FIRST, bits: int = SIEVE_BITS) -> list[tuple[int, int]]:
    """(length, number of different windows of it that occur more than once), doubling until none survives."""
    found, sieves, size = [], [], first
    while True:
        level = _level(docs, first, size, sieves).groupBy("key").agg(F.sum("seen").alias("seen")).where("seen > 1")
        sieves.append(sieve_of(level, "key", bits))
        found.append((size, level.count()))
        if not found[-1][1]:
            return found
        size *= 2


def without_repeats(docs: DataFrame, length: int = LENGTH, first: int = FIRST, bits: int = SIEVE_BITS, texts: bool = False) -> DataFrame:
    """``docs (doc_id, text, ...)`` with every word removed that a window covers whose word sequence also starts earlier.

    Earlier is a smaller doc_id, or the same document and an earlier start; windows are those of the input.  ``length`` is ``first`` doubled
    some times.  Returns ``doc_id, n_words, n_removed, kept_sha256`` (of the kept words joined by one space), or with ``texts`` all
    columns of ``docs`` with ``text`` replaced (unchanged where nothing was removed) and ``n_words, n_removed`` behind.

    Null and empty texts have no words; a null doc_id comes before all others; rows that share a doc_id are versions of one document, of which none comes
    earlier than another; documents shorter than ``length`` words keep all."""
    if first < 1 or length < 2 * first or length % first or (length // first) & (length // first - 1):
        raise ValueError("length has to be first doubled at least once")
    added = ["n_words", "n_removed"]
    docs = docs.drop(*added) if texts else docs.select("doc_id", "text")
    sieves = _sieves(docs, first, length, bits)
    held = docs.sparkSession.sparkContext.broadcast(sieves)
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID))

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("owner_").to_numpy()
        for words in words_of(batch.column("text")):
            places, hashes = _survivors(words, first, length, held.value)
            cuts = np.searchsorted(places, words.bounds)
            rows = [r for r in range(words.last - words.first) if cuts[r] < cuts[r + 1]]
            parts = [np.unique(hashes[cuts[r]:cuts[r + 1]]) for r in rows]
            yield pa.record_batch([pa.array(ids[words.first:words.last][rows]), lists([signed(p) for p in parts], pa.int64())], names=["owner_", "keys"])

    found = arrow_map(docs.select(key.alias("owner_"), "text"), scan, "owner_ long, keys array<long>")
    owned = (found.select("owner_", F.explode("keys").alias("key")).groupBy("key").agg(F.min("owner_").alias("owner_"))
             .groupBy("owner_").agg(F.collect_list("key").alias("owned_")))
    joint = docs.select("*", key.alias("owner_")).join(owned, "owner_", "left")
    rest = [c for c in docs.columns if texts or c == "doc_id"]
    schema = docs.select(rest).schema

    def finish(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column, owners = batch.column("text").fill_null(""), batch.column("owned_")
        kept, n_words, n_removed, same = [], [], [], []
        for words in words_of(column):
            places, hashes = _survivors(words, first, length, held.value)
            cuts = np.searchsorted(places, words.bounds)
            for r in range(words.last - words.first):
                row, at, n = words.first + r, places[cuts[r]:cuts[r + 1]], int(words.bounds[r + 1] - words.bounds[r])
                gone = np.zeros(n + 1, np.int64)
                if len(at):
                    own = owners[row].values
                    own = np.sort(own.to_numpy()) if own is not None else np.empty(0, np.int64)
                    mine = signed(hashes[cuts[r]:cuts[r + 1]])
                    spot = np.searchsorted(own, mine)
                    first_here = np.zeros(len(at), bool)
                    first_here[np.unique(mine, return_index=True)[1]] = True
                    is_own = np.zeros(len(at), bool)
                    if len(own):
                        is_own = own[np.minimum(spot, len(own) - 1)] == mine
                    bad = at[~(first_here & is_own)] - words.bounds[r]
                    np.add.at(gone, bad, 1)
                    np.add.at(gone, np.minimum(bad + length, n), -1)
                gone = np.cumsum(gone)[:n] > 0
                n_words.append(n)
                n_removed.append(int(gone.sum()))
                same.append(n_removed[-1] == 0)
                split = column[row].as_py().encode().split() if not (texts and same[-1]) else []
                line = b" ".join([w for w, g in zip(split, gone.tolist()) if not g] if n_removed[-1] else split)
                kept.append(line if texts else hashlib.sha256(line).hexdigest())
        if texts:
            old = batch.column("text")
            kept = [old[i].as_py() if s else k.decode() for i, (k, s) in enumerate(zip(kept, same))]
            columns = [pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in rest]
            yield pa.record_batch([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*rest, "n_words", "n_removed"])
        else:
            yield pa.record_batch([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                  names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    if texts:
        out = schema.add("n_words", "long").add("n_removed", "long")
    else:
        out = schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    return arrow_map(joint.select(*dict.fromkeys([*rest, "text"]), "owned_"), finish, out)
