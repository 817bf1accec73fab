"""A stored keyword index, and exact top-k search over it.

Chunks are dealt into shards once.  A shard's terms are lists of chunks in blocks, the heaviest first, each block with its largest weight; a search never sees the
texts again.  The blocks of the words asked for are read where they lie: the table is bucketed by shard, so the search shuffles nothing but k rows per question and shard."""
from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.english import STOP_WORDS, with_stems
from ..session import cut_lineage, fits_broadcast, shared_path, shuffle_width
from .postings import FIELD_WEIGHTS, query_terms, top_per_query

SHARD_ROWS, BLOCK, QUESTIONS = 20_000, 128, 5_000       # chunks of a shard; chunks of a block; questions that meet a shard at once
SHARD_WORDS, LOT_WORDS = 200, 1_000_000                 # different words of a chunk above which shards hold fewer chunks; words counted at once
ASKED = 500_000                                         # words of questions (some 30 MB) that every task may be given
UNITS = 10 ** 9                                         # weights of fields are added as whole numbers of this part, so that equal uses weigh the same in any order
DIGITS, SLACK = 9, 2e-9                                 # sums that agree in these digits are ties; what sums may differ by and still be ties


class Bm25(NamedTuple):
    k1: float = 1.2
    b: float = 0.75


class KeywordIndex(NamedTuple):
    """Tables of one index: ``chunks (shard, no, key)``, ``terms (term, chunks, factor)`` with ``stem`` of an English one, and the bucketed ``blocks``."""
    chunks: DataFrame
    terms: DataFrame
    blocks: str
    key: str
    english: bool


def _counted(batch: pa.RecordBatch, units: Mapping[str, int]) -> pa.RecordBatch:
    """``length, terms`` beside the first column: the different words of each row, from one list of words per field; a row without any list has no length."""
    rows, words, edges, missing = [], [], [0], True
    for field in units:
        lists = batch[field]
        missing = missing & lists.is_null().to_numpy(zero_copy_only=False)
        rows.append(np.repeat(np.arange(len(batch)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        words.append(lists.flatten())
        edges.append(edges[-1] + len(words[-1]))
    coded = pa.concat_arrays(words).dictionary_encode()
    known = max(1, len(coded.dictionary))
    row = np.concatenate(rows)
    places, which = np.unique(row * known + coded.indices.to_numpy(), return_inverse=True)
    weights = np.zeros(len(places), dtype=np.int64)
    for unit, a, b in zip(units.values(), edges, edges[1:]):
        weights += np.bincount(which[a:b], minlength=len(places)) * unit
    terms = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(places % known)), pa.array(weights / UNITS)], ["term", "weight"])
    bounds = np.searchsorted(places, np.arange(len(batch) + 1) * known).astype(np.int32)
    return pa.RecordBatch.from_arrays([batch[0], pa.array(np.bincount(row, minlength=len(batch)).astype(np.int32), mask=missing), pa.ListArray.from_arrays(pa.array(bounds), terms)],
                                      [batch.schema.names[0], "length", "terms"])


def term_counts(df: DataFrame, key: str, fields: Mapping[str, float]) -> DataFrame:
    """``key, length, terms``: the different words of a row with the sum of their fields' weights, and the number of uses (null if all fields are).  Nothing leaves the row.

    Words are counted in lots of rows that have about ``LOT_WORDS`` words."""
    names = [f"_{i}" for i in range(len(fields))]
    units = {name: round(weight * UNITS) for name, weight in zip(names, fields.values())}
    listed = df.select(key, *[tx.words(F.col(c)).alias(name) for name, c in zip(names, fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(sum(batch[name].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for name in names))
            start = 0
            while start < len(batch):
                stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + LOT_WORDS, "right")))
                yield _counted(batch.slice(start, stop - start), units)
                start = stop
    return listed.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, length int, terms array<struct<term: string, weight: double>>")


def _shard_blocks(table: pa.Table, key: str, block: int, scoring: Bm25 | None, mean: float) -> pa.Table:
    """The blocks of one shard, whose chunks are numbered by key."""
    numbers = np.empty(len(table), dtype=np.int32)
    numbers[pc.sort_indices(table[key]).to_numpy()] = np.arange(len(table), dtype=np.int32)
    lists = table["terms"].combine_chunks()
    sizes, flat = lists.value_lengths().to_numpy(), lists.flatten()
    nos, weights = np.repeat(numbers, sizes), flat.field("weight").to_numpy()
    if scoring:
        k1, b = scoring
        weights = weights * (k1 + 1.0) / (weights + k1 * ((1.0 - b) + b * np.repeat(table["length"].to_numpy(), sizes) / mean))
    coded = flat.field("term").dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.lexsort((nos, -weights, codes))
    codes, nos, weights = codes[order], nos[order], weights[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    place = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
    starts = np.flatnonzero(place % block == 0)
    bounds = pa.array(np.append(starts, len(codes)).astype(np.int32))
    return pa.table({"shard": pa.repeat(table["shard"][0], len(starts)), "rep": pa.repeat(table["rep"][0], len(starts)), "term": coded.dictionary.take(pa.array(codes[starts])),
                     "block": pa.array((place[starts] // block).astype(np.int32)), "top": pa.array(weights[starts]),
                     "nos": pa.ListArray.from_arrays(bounds, pa.array(nos)), "weights": pa.ListArray.from_arrays(bounds, pa.array(weights))})


def build_index(df: DataFrame, key: str = "id", fields: Mapping[str, float] = FIELD_WEIGHTS, hashed: str | None = None, scoring: Bm25 | None = None,
                english: bool = False, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> KeywordIndex:
    """Index ``df`` by the words of ``fields``; with ``hashed`` rows without a value in that column are left out.

    With ``english`` stop words are not searchable, and a word asks for all words of its stem; stems are made once per different word, not per use.

    A word weighs the sum of its fields' weights over its uses or, with ``scoring``, what Okapi BM25 gives its uses (``factor`` being its rarity).  Of the texts only counts per word are
    shuffled, once to their shards, which are made into blocks and written there.  A shard holds about ``shard_rows`` chunks, and fewer if these have many different words.  Its lists
    are ordered by weight; its chunks are numbered by key, so that ties go to the smaller key."""
    spark = df.sparkSession
    rows = df if hashed is None else df.where(F.col(hashed).isNotNull())
    counted = cut_lineage(term_counts(rows, key, fields))
    facts = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.sum(F.size("terms")).alias("uses")).first()
    n, mean = facts["n"], facts["mean"] or 1.0
    shards = max(shuffle_width(df), -(-n // shard_rows), -(-(facts["uses"] or 0) // (SHARD_ROWS * SHARD_WORDS)))
    counted = counted.withColumn("shard", F.pmod(F.hash(key), F.lit(shards)))
    chunks = cut_lineage(counted.select("shard", (F.row_number().over(Window.partitionBy("shard").orderBy(key)) - 1).alias("no"), key))
    terms = counted.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("chunks"))
    rarity = F.ln(F.lit(1.0) + (n - F.col("chunks") + 0.5) / (F.col("chunks") + 0.5)) if scoring else F.lit(1.0)
    terms = terms.withColumn("factor", rarity)
    terms = cut_lineage(with_stems(terms.where(~F.col("term").isin(*STOP_WORDS)), "term", "stem") if english else terms)

    def run(table: pa.Table) -> pa.Table:
        return _shard_blocks(table, key, block, scoring, mean)
    kind = df.schema[key].dataType.simpleString()
    reps = F.broadcast(chunks.where("no = 0").select("shard", F.col(key).alias("rep")))                  # one row per shard; its hash is the shard's number
    blocks = (counted.join(reps, "shard").repartition(shards, "rep").groupBy("rep")
              .applyInArrow(run, f"shard int, rep {kind}, term string, block int, top double, nos array<int>, weights array<double>"))
    name = f"keyword_blocks_{uuid.uuid4().hex}"
    blocks.write.bucketBy(shards, "rep").sortBy("rep", "term", "block").option("path", shared_path(spark, name)).saveAsTable(name)
    return KeywordIndex(chunks, terms, name, key, english)


def asked_terms(index: KeywordIndex, queries: DataFrame) -> DataFrame:
    """``query_id, term, factor``: the index's words that a question asks for."""
    asked = query_terms(queries)
    if not index.english:
        return asked.join(index.terms.select("term", "factor"), "term").select("query_id", "term", "factor")
    words = cut_lineage(with_stems(asked.select("term").distinct().where(~F.col("term").isin(*STOP_WORDS)), "term", "stem").withColumnRenamed("term", "_word"))
    forms = words.join(index.terms.select("term", "factor", "stem"), "stem")
    return asked.withColumnRenamed("term", "_word").join(forms, "_word").select("query_id", "term", "factor").distinct()


def _best(docs: np.ndarray, weights: np.ndarray, bounds: np.ndarray, tops: np.ndarray, following: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of the k greatest sums, ties to the smaller number.  Blocks come by falling ``tops``; ``following`` is the top of the next block of the same term.

    When what is left of the terms cannot lift a new chunk over the k-th sum so far, chunks that cannot reach it go out, and further blocks only add to the others.
    The sums that are returned are added in the order of the weights, so that chunks of the same weights have the same sum, whatever blocks these lie in."""
    total = np.zeros(size)
    firsts = tops.sum() - following.sum()                    # what a chunk that no block has held yet can have at most
    rest = firsts + np.cumsum(following - tops)
    slack = SLACK + 2 * len(tops) * np.spacing(tops.sum())   # with what ``rest`` may be off by
    done, step = 0, 16
    while done < len(tops):
        stop = min(len(tops), done + step)
        a, b = bounds[done], bounds[stop]
        total += np.bincount(docs[a:b], weights[a:b], size)
        done, step = stop, step * 2
        if done < len(tops) and size > k:
            kth = np.partition(total, size - k)[size - k]
            if kth > rest[done - 1] + slack:
                open_ = total + rest[done - 1] >= kth - slack
                a = bounds[done]
                held = open_[docs[a:]]
                total += np.bincount(docs[a:][held], weights[a:][held], size)
                total[~open_] = 0.0
                break
    found = np.flatnonzero(total > 0)
    if len(found) > k:
        least = np.partition(total[found], len(found) - k)[len(found) - k]
        found = found[total[found] >= least - slack]
    kept = np.zeros(size, dtype=bool)
    kept[found] = True
    kept = np.flatnonzero(kept[docs])
    kept = kept[np.lexsort((weights[kept], docs[kept]))]
    sums = np.add.reduceat(weights[kept], np.flatnonzero(np.diff(docs[kept], prepend=-1))) if len(found) else np.empty(0)
    order = np.lexsort((found, -np.round(sums, DIGITS)))[:k]
    return found[order], sums[order]


def _search(table: pa.Table, k: int) -> pa.Table:
    """One shard and one lot of questions: ``query_id, shard, no, score`` of each question's k best chunks."""
    table = table.sort_by([("term", "ascending"), ("block", "ascending")]).combine_chunks()
    blocks, tops = table["block"].to_numpy(), table["top"].to_numpy()
    lists, sizes = table["nos"].combine_chunks(), table["weights"].combine_chunks()
    bounds, docs, weights = lists.offsets.to_numpy(), lists.values.to_numpy(), sizes.values.to_numpy()[sizes.offsets[0].as_py():]
    docs, bounds = docs[bounds[0]:], bounds - bounds[0]
    starts = np.flatnonzero(blocks == 0)
    ends = np.append(starts[1:], len(blocks))
    next_top = np.append(tops[1:], 0.0)
    next_top[ends - 1] = 0.0
    wanted: dict[object, list[tuple[int, float]]] = {}
    for t, asked in enumerate(table["asked"].take(pa.array(starts)).to_pylist()):
        for q in asked:
            wanted.setdefault(q["query_id"], []).append((t, q["factor"]))
    size = int(docs.max()) + 1
    out: tuple[list, list, list] = ([], [], [])
    for query, terms in wanted.items():
        rows = np.concatenate([np.arange(starts[t], ends[t]) for t, _ in terms])
        factor = np.concatenate([np.full(ends[t] - starts[t], f) for t, f in terms])
        order = np.argsort(-tops[rows] * factor, kind="stable")
        rows, factor = rows[order], factor[order]
        lengths = bounds[rows + 1] - bounds[rows]
        edges = np.concatenate(([0], np.cumsum(lengths)))
        spots = np.arange(edges[-1]) + np.repeat(bounds[rows] - edges[:-1], lengths)
        nos, scores = _best(docs[spots], weights[spots] * np.repeat(factor, lengths), edges, tops[rows] * factor, next_top[rows] * factor, size, k)
        out[0].extend([query] * len(nos)), out[1].extend(nos.tolist()), out[2].extend(scores.tolist())
    shard = table["shard"][0].as_py()
    return pa.table({"query_id": pa.array(out[0], table["asked"].type.value_type.field("query_id").type), "shard": pa.array([shard] * len(out[0]), pa.int32()),
                     "no": pa.array(out[1], pa.int32()), "score": pa.array(out[2], pa.float64())})


def search_index(index: KeywordIndex, queries: DataFrame, k: int = 40) -> DataFrame:
    """``query_id, key, score, rank``: each question's ``k`` chunks of the greatest sum of weights of its words, exactly; ties (sums alike in ``DIGITS`` digits)
    go to the smaller key.

    Questions meet a shard in lots of about ``QUESTIONS``; a lot's words are joined to the blocks by Spark, so no table passes through the driver."""
    spark = queries.sparkSession
    asked = asked_terms(index, queries)
    lots = max(1, -(-queries.select("query_id").count() // QUESTIONS))
    asked = cut_lineage(asked.withColumn("lot", F.pmod(F.xxhash64("query_id"), F.lit(lots)).cast("int")))
    per_term = asked.groupBy("term", "lot").agg(F.collect_list(F.struct("query_id", "factor")).alias("asked"))
    if fits_broadcast(asked, ASKED):
        per_term = F.broadcast(per_term)                     # the blocks stay where they lie
    met = spark.table(index.blocks).join(per_term, "term").select("shard", "rep", "lot", "term", "block", "top", "nos", "weights", F.when(F.col("block") == 0, F.col("asked")).alias("asked"))
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        return _search(table, k)
    found = met.groupBy("rep", "lot").applyInArrow(run, f"query_id {kind}, shard int, no int, score double")
    named = found.join(index.chunks, ["shard", "no"]).select("query_id", index.key, "score")
    return top_per_query(named, F.round("score", DIGITS), k, key=index.key)


def keyword_hits(index: KeywordIndex, queries: DataFrame, k: int = 40) -> DataFrame:
    """As ``postings.keyword_topk``, from the index: ``query_id, key, keyword_score, rank`` with the sum squashed to s/(s+1)."""
    found = search_index(index, queries, k).withColumn("score", F.round("score", DIGITS))
    return found.select("query_id", index.key, (F.col("score") / (F.col("score") + 1.0)).alias("keyword_score"), "rank")
