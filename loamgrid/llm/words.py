"""Words of whole texts as 64-bit hashes, many rows at a time.

A word is a run of bytes other than 0x20 and 0x09-0x0D, as in the pattern ``[^\\x20\\x09-\\x0D]+``.  Hashes are polynomials over the
bytes, taken from running sums, so that a batch of rows costs a few passes of numpy and no loop over words.  Texts are
taken in pieces of some megabytes; a longer text is cut at white space and its hashes are put together again."""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 2 << 20                      # bytes of text hashed at once
_BASE = 0x9E3779B97F4A7C15           # odd, and 5 modulo 8: powers have a long period
_SEED = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


class Words(NamedTuple):
    """Words of rows ``first`` to ``last - 1``: those of row r are ``bounds[r - first]`` to ``bounds[r - first + 1]``."""
    first: int
    last: int
    hashes: np.ndarray               # uint64
    bounds: np.ndarray               # int64, one more than rows


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < size:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def spans(data: np.ndarray, apart: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes; ``apart`` says for each byte value whether it separates words."""
    white = apart[data]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if len(data) and not white[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(data)]))
    return edge[0::2], edge[1::2]


class RunningHash:
    """Hashes of stretches of bytes (at most a few pieces long): equal bytes, equal hash."""

    def __init__(self, data: np.ndarray):
        up, self._down = _power_tables(max(PIECE + 64, len(data) + 1))
        self._total = np.empty(len(data) + 1, np.uint64)
        self._total[0] = 0
        np.cumsum(_SEED[data] * up[:len(data)], out=self._total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._total[ends] - self._total[starts]) * self._down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return RunningHash(data).of(starts, ends)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a column of strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def _cuts(data: np.ndarray, begin: int, end: int) -> list[int]:
    """Places within a long text to cut it at, each before white space (or inside a word of over a piece's length: never)."""
    cuts = [begin]
    while end - cuts[-1] > PIECE:
        at = cuts[-1] + PIECE
        while at < end and not _WHITE[data[at]]:
            at += 1
        cuts.append(at)
    return [*cuts, end] if cuts[-1] < end else cuts


def words_of(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[Words]:
    """Hashed words of a column of texts, group by group of rows; ``lower`` lower-cases A-Z first."""
    data, offsets = buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        begin, end = int(offsets[first]), int(offsets[last])
        cuts, found, firsts = _cuts(data, begin, end) if last == first + 1 else [begin, end], [], []
        for a, b in zip(cuts, cuts[1:]):
            part = LOWER[data[a:b]] if lower else data[a:b]
            if last > first + 1:                          # words end where their row does
                starts, ends = _row_spans(part, offsets[first:last + 1] - begin)
            else:
                starts, ends = spans(part)
            found.append(hash_spans(part, starts, ends))
            firsts.append(starts + a)
        hashes = np.concatenate(found) if found else np.empty(0, np.uint64)
        at = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
        yield Words(first, last, hashes, np.searchsorted(at, offsets[first:last + 1]).astype(np.int64))
        first = last


def _row_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``spans``, but a word never runs on into the next row."""
    white = _WHITE[data]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    change = np.empty(len(data) + 1, bool)
    change[0], change[-1] = True, True
    np.not_equal(white[1:], white[:-1], out=change[1:-1])
    change[inner] = True
    edge = np.flatnonzero(change)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~white[edge[:-1]]
    return edge[:-1][inside], edge[1:][inside]


def joined(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` consecutive values (one per start, ``length - 1`` fewer than values), put together by doubling."""
    out, have, step, span, left = None, 0, hashes, 1, length
    while left:
        if left & 1:
            out, have = (step, span) if out is None else (follow(out, step, have), have + span)
        left >>= 1
        if left:
            step, span = follow(step, step, span), span * 2
    return out[:max(0, len(hashes) - length + 1)]


def follow(first: np.ndarray, second: np.ndarray, gap: int) -> np.ndarray:
    """Hash of each sequence in ``first`` followed by the sequence of ``second`` that starts ``gap`` values later."""
    n = max(0, min(len(first), len(second) - gap))
    return mix(first[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + second[gap:gap + n] + np.uint64(gap))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
