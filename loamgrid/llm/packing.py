"""Bounded-space online packing of documents into token sequences.

Each partition keeps a fixed number of open sequences.  A document's full stretches become sequences of their own; its rest goes where the least room stays
free (best fit).  If it fits nowhere, the fullest sequence is filled up with the rest's head and emitted.  What is open at the end of a partition is merged
with that of other partitions.  Texts are never shuffled; of token ids only those in open sequences leave their task."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.tokens import ByteBpe, added_tokens
from loamgrid.session import cut_lineage

CAPACITY, OPEN, MERGED = 2048, 8, 64
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict[tuple[str, str, str], ByteBpe] = {}


def _encoder(path: str, pattern: str, json_path: str) -> ByteBpe:
    key = (path, pattern, json_path)
    if key not in _encoders:
        _encoders[key] = ByteBpe(path, pattern, added_tokens(json_path))
    return _encoders[key]


class _Packer:
    """One partition's sequences.  A piece is [doc_id, start, length, crc, doc_tokens, sequence, offset, ids or None]."""

    def __init__(self, first_sequence: int, capacity: int, most_open: int):
        self.next, self.capacity, self.most_open = first_sequence, capacity, most_open
        self.open: list[list] = []                   # [used, pieces]
        self.done: list[list] = []

    def _piece(self, doc: tuple, start: int, length: int, offset: int) -> list:
        doc_id, ids, n = doc
        return [doc_id, start, length, 0, n, None, offset, ids[4 * start:4 * (start + length)]]

    def _close(self, pieces: list[list]) -> None:
        for p in pieces:
            p[3], p[5], p[7] = zlib.crc32(p[7]), self.next, None
        self.done += pieces
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        doc, start = (doc_id, ids, n), 0
        while n - start >= self.capacity:
            self._close([self._piece(doc, start, self.capacity, 0)])
            start += self.capacity
        while start < n:
            rest = n - start
            fits = [w for w in self.open if self.capacity - w[0] >= rest]
            if fits:
                window = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.most_open:
                window = [0, []]
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
            length = min(rest, self.capacity - window[0])
            window[1].append(self._piece(doc, start, length, window[0]))
            window[0] += length
            start += length
            if window[0] == self.capacity:
                self.open.remove(window)
                self._close(window[1])

    def left(self) -> list[list]:
        out = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open = []
        return out

    def emitted(self) -> list[list]:
        out, self.done = self.done, []
        return out


def pack(docs: DataFrame, capacity: int = CAPACITY, most_open: int = OPEN, merged: int = MERGED, end_id: int = 1,
         ranks_path: str | None = None, pattern: str | None = None, json_path: str | None = None) -> DataFrame:
    """Pieces of ``docs (doc_id, text, ...)`` in sequences of at most ``capacity`` tokens.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.  A document is the ids of its text (those of the tokenizer in ``json_path``, whose added tokens
    are ids of their own), then ``end_id``; a null or empty text is ``end_id``
    alone; repeated rows are packed each.  All sequences are full but the last of every ``merged`` partitions (at most ``merged * most_open`` open
    sequences meet in a task).  The sequence's ids are unique, not dense.  An empty table gives no row."""
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part"]
    kinds = [pa.int64()] * 7 + [pa.binary(), pa.int64()]

    def table(pieces: list[list], part: int) -> pa.RecordBatch:
        columns = list(zip(*pieces)) if pieces else [()] * 8
        return pa.record_batch([pa.array(c, k) for c, k in zip([*columns, [part] * len(pieces)], kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, packer = _encoder(ranks_path, pattern, json_path).ids, _Packer(part << 32, capacity, most_open)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                packer.add(doc_id, encode(text.as_py() or "") + end)
            yield table(packer.emitted(), part)
        if packer.open:
            yield table(packer.left(), part)

    pieces = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{_PIECE}, ids binary, part long"))

    def merge(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        packer = _Packer((1 << 30) + int(key[0]) << 32, capacity, 1)
        window = [0, []]
        for doc_id, start, length, n, ids in zip(left.doc_id.astype(object), left.start, left.length, left.doc_tokens, left.ids):
            at = 0
            while at < length:
                take = min(length - at, capacity - window[0])
                window[1].append([None if pd.isna(doc_id) else int(doc_id), start + at, take, 0, n, None, window[0], ids[4 * at:4 * (at + take)]])
                window[0], at = window[0] + take, at + take
                if window[0] == capacity:
                    packer._close(window[1])
                    window = [0, []]
        packer._close(window[1])
        out = pd.DataFrame([p[:7] for p in packer.emitted()], columns=names[:7])
        return out.astype({"doc_id": "Int64"})

    left = pieces.where("ids is not null").withColumn("group", F.expr(f"part div {merged}"))
    closed = pieces.where("ids is null").select(*names[:7])
    return closed.union(left.select("group", *(c for c in names if c not in ("sequence_id", "ids_crc32"))).groupBy("group").applyInPandas(merge, _PIECE))
