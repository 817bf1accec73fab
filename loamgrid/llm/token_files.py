"""Token ids in Parquet files, in the order of the documents.

A row is a document: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids``.  ``ids`` is a list column with a dictionary, so an id takes as many bits as
the ids of its row group need; the other columns ascend and are stored as deltas.  Row groups and pages have set sizes, and the pages' least and
greatest values stand in the page index, so that reading some documents, some stretch of ids, or lengths alone touches few pages."""
from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.regular_sort import merged, segment_sums, sorted_runs
from loamgrid.llm.shared import arrow_map, lists
from loamgrid.llm.tokens import ByteBpe

END_ID = 2
FILE_DOCUMENTS = 200_000             # rows of a file, on average; there are as many files as shuffle partitions, if that is more
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 64 << 10, 2_000
STORED = "doc_id long, start long, n_tokens long, ids array<int>"
_encoders: dict[tuple[str, str, str, int], tuple[ByteBpe, int]] = {}


def _encoder(json_path: str, ranks_path: str, pattern: str, end_id: int) -> tuple[ByteBpe, int]:
    """The encoder, and the bytes of an id: 2 if the vocabulary and ``end_id`` allow it, else 4."""
    key = (json_path, ranks_path, pattern, end_id)
    if key not in _encoders:
        with open(json_path) as file:
            tokenizer = json.load(file)
        added = {t["content"]: t["id"] for t in tokenizer["added_tokens"]}
        width = 2 if max(end_id, *tokenizer["model"]["vocab"].values(), *added.values()) < 1 << 16 else 4
        _encoders[key] = ByteBpe(ranks_path, pattern, added, by_word=False, width=width), width
    return _encoders[key]


def encoded(docs: DataFrame, end_id: int = END_ID, json_path: str | None = None, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids`` of ``docs (doc_id, text, ...)``: the ids of the whole text and ``end_id``, as little-endian unsigned numbers of 2 or 4 bytes.

    The ids are those of the tokenizer in ``json_path`` without special tokens being added; its added tokens inside a text are ids of their own."""
    paths = (json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder, width = _encoder(*paths, end_id)
        end = int(end_id).to_bytes(width, "little")
        ids = [encoder.ids(t.as_py() or "") + end for t in batch.column("text")]
        yield pa.record_batch([batch.column("doc_id"), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, "doc_id long, n_tokens long, ids binary")


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID, file_documents: int = FILE_DOCUMENTS, row_group: int = ROW_GROUP, page: int = PAGE,
                 page_rows: int = PAGE_ROWS, **tokenizer: str) -> None:
    """Write the ids of ``docs (doc_id, text, ...)`` in ascending order of doc_id (null first) to Parquet files below ``path``, as table ``STORED``.

    Texts are encoded where they are read; the ids are sorted once by regular sampling, and sums ahead of each segment give ``start`` before anything is written.  Files, and the
    rows in each, are in order.  Null and empty texts are ``end_id`` alone; rows that share an id follow each other by a digest of their ids; an empty table gives no row.
    ``row_group`` and ``page`` are bytes, ``page_rows`` rows."""
    order = {"with_": F.col("doc_id").isNotNull().cast("long"), "id_": F.coalesce("doc_id", F.lit(0)), "digest_": F.xxhash64("ids")}
    runs = sorted_runs(encoded(docs, end_id, **tokenizer), order, file_documents)

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, column = batch.column("n_tokens").to_numpy(), batch.column("ids")
        ids = lists([np.frombuffer(x.as_buffer(), f"<u{len(x.as_buffer()) // n}").astype(np.int32) for x, n in zip(column, sizes.tolist())], pa.int32())
        return pa.record_batch([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), ids], names=["doc_id", "start", "n_tokens", "ids"])

    ordered = merged(runs, segment_sums(runs, "n_tokens"), "start", weight="n_tokens", last=(listed, STORED))
    options = {"parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": page_rows, "parquet.writer.version": "v2",
               "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "compression": "zstd"}
    ordered.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; select columns and filter by ``doc_id`` or ``start`` before an action, and other columns and pages are not read."""
    return spark.read.schema(STORED).parquet(path)


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens``; ids are not read."""
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens")


def ids_between(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """``doc_id, start, ids``: what the documents have of the ids at ``begin`` to ``end - 1`` of the whole sequence, ``start`` being the place of the first.

    The length of the longest document ahead is found from lengths alone, so that the filter on ``start`` leaves out row groups and pages that end before."""
    first = lengths(spark, path).where((F.col("start") <= begin) & (F.col("start") + F.col("n_tokens") > begin)).agg(F.min("start")).first()[0]
    rows = read_tokens(spark, path).where((F.col("start") >= (begin if first is None else first)) & (F.col("start") < end))

    def clip(at: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.lit(at) - F.col("start"))).cast("int")
    cut = F.slice("ids", clip(begin) + 1, clip(end) - clip(begin))
    return rows.select("doc_id", (F.col("start") + clip(begin)).alias("start"), cut.alias("ids")).where(F.size("ids") > 0)


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the stored table: unsigned CRC-32 of the ids as little-endian unsigned 32-bit numbers, ``n_tokens`` counted from the list."""
    def check(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column("ids")
        bounds, values = column.offsets.to_numpy(), column.values.to_numpy().astype("<i4", copy=False)
        crcs = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield pa.record_batch([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crcs, pa.int64())],
                              names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return arrow_map(tokens.select("doc_id", "start", "ids"), check, "doc_id long, start long, n_tokens long, ids_crc32 long")
