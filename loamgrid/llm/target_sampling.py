"""Resampling of documents towards a target distribution.

Features (runs of consecutive words) are counted in hashed buckets, over all documents and over the target's texts.  A bucket's gain is the
logarithm of its share in the target over its share in the documents; a document's weight is the mean gain of its features, taken from an array.  Weights
with noise from the id are drawn in order of score (Gumbel top-k); exact ranks come from parallel sorting by regular sampling."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.regular_sort import merged, segment_sums, sorted_runs
from loamgrid.llm.shared import arrow_map

BUCKETS, MAX_RUN, SEED = 10_000, 1, 2024
SHARE, LEAST_WORDS = (10, 100), 20
SEGMENT_ROWS = 500_000               # rows ranked by one task, on average
PIECE = 1 << 20                      # bytes of a text whose words are held at once
# Bytes that part words become blanks, A-Z become a-z; all bytes of characters beyond ASCII belong to words.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some at a time."""
    plain, begin = text.translate(_PLAIN), 0
    while len(plain) - begin > PIECE:
        cut = plain.find(b" ", begin + PIECE)
        if cut < 0:
            break
        yield plain[begin:cut].split()
        begin = cut
    yield plain[begin:].split()


def _runs(text: bytes, max_run: int) -> Iterator[tuple[list[bytes], int]]:
    """(features, number of words) of the text's pieces; features that cross a cut belong to the later piece."""
    carried: list[bytes] = []
    for words in _pieces(text):
        found = [words]
        for length in range(2, max_run + 1):
            line = carried[max(0, len(carried) - length + 1):] + words
            found.append([b" ".join(line[i:i + length]) for i in range(len(line) - length + 1)])
        carried = (carried + words)[-max_run + 1:] if max_run > 1 else carried
        yield list(chain.from_iterable(found)) if max_run > 1 else words, len(words)


def _bytes_of(text: pa.StringScalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _in_buckets(features: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(crc32, features), np.int64, len(features)) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> np.ndarray:
    """How many features of all ``texts (text)`` fall into each bucket.  A task sends one number per bucket; null texts have none."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                for features, _ in _runs(_bytes_of(text), max_run):
                    total += np.bincount(_in_buckets(features, buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts


def bucket_gains(everywhere: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed share in the target over that in all documents, rounded down."""
    n, s, t = len(everywhere), everywhere.astype(float), target.astype(float)
    ratio = (t + 1.0) * (s.sum() + n) / ((s + 1.0) * (t.sum() + n))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a standard Gumbel variate made of an id, rounded down; no id counts as the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, max_run: int = MAX_RUN, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row of ``docs (doc_id, text, ...)``."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            n_words = n = total = 0
            for features, words in _runs(_bytes_of(text), max_run):
                n, n_words, total = n + len(features), n_words + words, total + int(held.value[_in_buckets(features, buckets)].sum())
            weight = total // n if n else 0
            rows.append((doc_id, n_words, n, weight, weight + noise(doc_id, seed)))
        names = ["doc_id", "n_words", "n_features", "weight", "score"]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), score, "doc_id long, n_words long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS,
              max_run: int = MAX_RUN, seed: int = SEED, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs (doc_id, text, ...)``, drawn towards the texts of ``target (text, ...)``.

    Of the N documents of at least ``least_words`` words, the N * share[0] // share[1] of the highest scores have ranks 1, 2, ...; ties go to the smaller
    doc_id, then to fewer features; a null doc_id comes last.  All others have a null rank.  Null and empty texts have no features and weight 0; rows that repeat an
    id have the same noise and are ranked each; an empty target gives gains against equal shares; an empty table gives no row."""
    gains = bucket_gains(bucket_counts(docs, buckets, max_run), bucket_counts(target, buckets, max_run))
    rows = scored(docs, gains, max_run, seed)
    order = {"late_": F.when(F.col("n_words") >= least_words, 0).otherwise(1).cast("long"), "falling_": -F.col("score"),
             "without_": F.col("doc_id").isNull().cast("long"), "id_": F.coalesce("doc_id", F.lit(0)), "size_": F.col("n_features")}
    runs = sorted_runs(rows, order, segment_rows)
    drawn = runs.table.where("late_ = 0").count() * share[0] // share[1]
    ranked = merged(runs, segment_sums(runs), "before_", most=drawn, below="undrawn_")
    rank = F.when(F.col("before_") < drawn, F.col("before_") + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def oracle_sql() -> str:
    """DuckDB SQL of the registered query; checksums are made of the distinct words, bit by bit."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def words(table: str, key: str) -> str:
        return rf"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM {table}"
    return rf"""
WITH steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
docs AS ({words('documents', 'doc_id')}),
wanted AS ({words('benchmark', 'item_id')}),
uses AS (SELECT unnest(words) AS word, 1 AS here, 0 AS there FROM docs UNION ALL SELECT unnest(words), 0, 1 FROM wanted),
vocabulary AS (SELECT word, sum(here) AS here, sum(there) AS there FROM uses GROUP BY word),
hashed AS (
  SELECT word, here, there,
         xor(list_reduce(list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket
  FROM vocabulary, steps),
counts AS (SELECT bucket, sum(here) AS s, sum(there) AS t FROM hashed GROUP BY bucket),
sums AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + {BUCKETS}) / ((s + 1)::DOUBLE * (all_t + {BUCKETS}))))::BIGINT AS gain FROM counts, sums),
features AS (SELECT doc_id, unnest(words) AS word FROM docs),
means AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM features JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scores AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM docs d LEFT JOIN means m ON d.doc_id = m.doc_id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scores WHERE n_features >= {LEAST_WORDS})
SELECT s.doc_id::BIGINT AS doc_id, n_features, weight, score,
       CASE WHEN place <= {SHARE[0]} * (SELECT count(*) FROM placed) // {SHARE[1]} THEN place END::BIGINT AS rank
FROM scores s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""
