"""Document fingerprints from closed syncmers.

A stretch of ``K`` code points is a closed syncmer if the least of its ``K - S + 1`` inner stretches of ``S`` code points lies at one of its ends.  Whether it is one
depends on the stretch alone, so an edit moves or keeps all other anchors, and every ``K`` code points or so hold one.  A fingerprint
keeps the least-hashed syncmer of each of ``SLOTS`` classes with its position; two fingerprints are matched along positions."""
from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.words import mix
from loamgrid.session import shuffle_width

K, S, SLOTS = 24, 9, 128
SHORTER = ((96, 8, 3), (16, 3, 1))   # below so many code points, anchors of these sizes are added
STRETCH = 1 << 18                    # code points looked at once
NO_ID = -(2**63)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POSITION = 1 << 32


def _stretch_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive values, put together by doubling."""
    out, have, step, span, left = None, 0, points, 1, width
    while left:
        if left & 1:
            out, have = (step, span) if out is None else (out[:len(step) - have] * _power(span) + step[have:], have + span)
        left >>= 1
        if left:
            step, span = step[:-span] * _power(span) + step[span:], span * 2
    return mix(out[:len(points) - width + 1])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_ODD), n, 1 << 64))


def syncmers(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the closed syncmers of a text, in order."""
    hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for begin in range(0, max(1, len(text) - k + 1), STRETCH):
        points = mix(np.frombuffer(text[begin:begin + STRETCH + k - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _ODD)
        if len(points) < k:
            break
        inner = _stretch_hashes(points, s)
        width, least, span = k - s + 1, inner, 1
        while span * 2 <= width:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        if span < width:
            least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
        at = np.flatnonzero((least == inner[:len(least)]) | (least == inner[width - 1:]))
        hashes.append(_stretch_hashes(points, k)[at])
        places.append(at + begin)
    return np.concatenate(hashes), np.concatenate(places)


def fingerprint(text: str, slots: int = SLOTS) -> str:
    """``slots`` times eight hexadecimal digits of an anchor's hash and eight of its position; ``-`` for an empty class.

    A text without syncmer is one anchor; an empty text has none.  Equal texts have equal fingerprints."""
    if not text:
        return ""
    hashes, places = map(np.concatenate, zip(syncmers(text), *(syncmers(text, k, s) for below, k, s in SHORTER if len(text) < below)))
    if not len(hashes):
        hashes = np.frombuffer(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8], np.uint64)
        places = np.zeros(1, np.int64)
    hashes, first = np.unique(hashes, return_index=True)
    shift = 64 - (slots - 1).bit_length()
    least = np.searchsorted(hashes, np.arange(slots, dtype=np.uint64) << np.uint64(shift))
    out = []
    for slot, i in enumerate(least.tolist()):
        held = i < len(hashes) and int(hashes[i]) >> shift == slot
        out.append(f"{int(hashes[i]) & 0xFFFFFFFF:08x}{int(places[first[i]]) % _POSITION:08x}" if held else "-")
    return ".".join(out)


def likeness(one: str, other: str) -> float:
    """Share of anchors that two fingerprints have in common, 0 to 1.

    Of the classes in which both hold the same anchor, the largest number counts whose positions rise together; over the classes that either
    uses, this estimates the overlap over the union of the anchors, from which the share of both follows."""
    if one == other:
        return 1.0
    if not one or not other:
        return 0.0
    both, used = [], 0
    for a, b in zip(one.split("."), other.split(".")):
        used += a != "-" or b != "-"
        if a != "-" and a[:8] == b[:8]:
            both.append((int(a[8:], 16), int(b[8:], 16)))
    rising: list[int] = []
    for _, position in sorted(both):
        at = bisect_left(rising, position)
        rising[at:at + 1] = [position]
    overlap = len(rising) / used if used else 0.0
    return 2 * overlap / (1 + overlap)


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``following``, or all of them."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _firsts(keys: np.ndarray, range_of: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """The least key of each range among these."""
    keys = np.sort(keys)
    where, at = np.unique(range_of(keys), return_index=True)
    return pa.record_batch([pa.array(where.astype(np.int32)), pa.array(keys[at])], names=["range", "key"])


def with_following(docs: DataFrame, fn: Callable[[list[tuple], list[str]], pa.RecordBatch], schema: str, parts: int | None = None) -> DataFrame:
    """``fn(rows, following)`` over ``docs (doc_id, text)`` in ascending order: lists of (doc_id, text) and the text behind each.

    Rows are dealt once, by ranges of doc_id (null first; rows of one id by text); the first row of each range also goes to the range before it."""
    parts = parts or shuffle_width(docs)
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    quantiles = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 10000).alias("q")).first()["q"] if parts > 1 else None
    marks = np.unique(np.array(quantiles or [], np.int64))

    def range_of(keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(marks, keys)

    firsts = rows.select("key").mapInArrow(lambda batches: (_firsts(b.column("key").to_numpy(), range_of) for b in batches), "range int, key long")
    firsts = firsts.groupBy("range").agg(F.min("key").alias("key")).orderBy("range").collect()           # one row per range
    if not firsts:
        return docs.sparkSession.createDataFrame([], schema)
    heads = np.array([r["key"] for r in firsts], np.int64)
    before = np.array([firsts[i - 1]["range"] for i in range(len(firsts))], np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to its range; the first of a range also to the range before, behind all its rows."""
        for batch in batches:
            keys = batch.column("key").to_numpy()
            at = np.searchsorted(heads, keys)
            head = np.flatnonzero((at < len(heads)) & (heads[np.minimum(at, len(heads) - 1)] == keys))
            for part, where, behind in ((batch, range_of(keys), 0), (batch.take(pa.array(head)), before[at[head]], 1)):
                if part.num_rows:
                    yield pa.record_batch([pa.array(where.astype(np.int32)), pa.array(np.full(len(where), behind, np.int32)), *part.columns],
                                          names=["range", "behind", *part.schema.names])

    dealt = rows.mapInArrow(deal, "range int, behind int, key long, doc_id long, text string").repartitionById(len(marks) + 1, F.col("range"))
    dealt = dealt.sortWithinPartitions("range", "behind", "key", "text").select("range", "behind", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, None                # the row that waits for the one behind it; the range that has ended
        for batch in batches:
            rows, following = [], []
            for where, behind, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                if where == done:
                    continue
                text = text.as_py()
                if held is not None:
                    rows.append(held[1:])
                    following.append(text)
                held = None if behind else (where, doc_id, text)
                done = where if behind else done
            if rows:
                yield fn(rows, following)
    return dealt.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for ``docs (doc_id, text, ...)``.

    The text behind a document is that of the next doc_id, behind the last that of the first (itself, if it is alone).  Null texts count as empty; rows without
    doc_id come first; rows with one doc_id follow each other by text."""
    def fn(rows: list[tuple], following: list[str]) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(7)]
        known: dict[str, str] = {}
        for (doc_id, text), behind in zip(rows, following):
            changed = edited(text, behind)
            prints = []
            for t in (text, changed, behind):
                if t not in known:
                    if len(known) > 64:
                        known.clear()
                    known[t] = fingerprint(t, slots)
                prints.append(known[t])
            row = (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), prints[0], prints[1],
                   likeness(prints[0], prints[1]), likeness(prints[0], prints[2]))
            for column, value in zip(columns, row):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)],
                               names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
    return with_following(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fn,
                          "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
